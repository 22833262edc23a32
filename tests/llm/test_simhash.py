"""Leaves of the vantage-point trees: bounded at any size and skew, no pair lost."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import simhash


def sizes(leaves):
    r = leaves.groupBy("leaf").count().agg(F.max("count").alias("largest"), F.sum("count").alias("rows")).first()
    return r.largest, r.rows


def test_parts_divide_the_bits_left():
    used = 0xFFFF
    masks = simhash.parts(used, 4, np.arange(1 << 12, dtype=np.uint64) << np.uint64(20))
    assert all((m & 0xFFF00000).bit_count() == 3 for m in masks)
    assert sum(m.bit_count() for m in masks) == 48 and not any(a & b for a, b in combinations([used, *masks], 2))
    assert used | masks[0] | masks[1] | masks[2] | masks[3] == 2 ** 64 - 1


def test_leaves_and_copies_stay_flat(spark):
    for n in (5000, 40000):
        largest, rows = sizes(simhash.leaves_of(spark.range(n).select(F.xxhash64("id").alias("fp")), leaf=500))
        assert largest <= 2 ** simhash.REST and rows <= 6 * n


@pytest.mark.parametrize("free", [14, 40])
def test_fingerprints_alike_in_most_bits_are_divided_and_keep_their_links(spark, free):
    """All fingerprints agree in the bits above ``free``: the trees of the other parts cannot divide them."""
    rng = np.random.default_rng(free)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << free, 900, dtype=np.int64), np.arange(3000, dtype=np.int64) * 4]))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    leaves = simhash.leaves_of(df, leaf=600)
    largest, rows = sizes(leaves)
    assert largest <= 2 ** simhash.REST and rows <= 20 * len(fps)
    held = {}
    for r in leaves.collect():
        held.setdefault(r.fp, set()).add(r.leaf)
    assert set(held) == set(fps.tolist())
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= simhash.MAX_BITS
    for i, j in np.argwhere(np.triu(near, 1))[::7]:
        assert held[int(fps[i])] & held[int(fps[j])]


def test_no_fingerprints(spark):
    empty = spark.createDataFrame([], "fp long")
    assert simhash.linked_components(empty).count() == 0
