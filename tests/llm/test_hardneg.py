"""Hard negatives against plain Python integers."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from lexiflow.llm import hardneg

ROWS = "vec_id long, embedding array<double>, label int, id string, q string, i int, j int, score int"


def brute(rows):
    part = {}
    for i, v, lab, *_ in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None
                                 and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[2], r[1])):
        part.setdefault(i, (i, [math.floor(256 * x) for x in v], lab))
    out = []
    for a, va, la in part.values():
        if a % 10:
            continue
        s = sorted((-max(-hardneg.LONG, min(hardneg.LONG, sum(x * y for x, y in zip(va, v)))), i, lab) for i, v, lab in part.values() if i != a)
        for p, pid, lab in [x for x in s if x[2] == la][:5]:
            near = [x for x in s if x[2] != la and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(a, pid, k, nid, -p, -n) for k, (n, nid, _) in enumerate(near, 1)]
    return sorted(out)


def table(rnd, n, scale=1.0):
    rows = []
    for i in range(n):
        v = [rnd.gauss(0.05, 0.2) * scale for _ in range(12 if i % 9 else 7)]
        rows.append((i, v, rnd.choice([0, 0, 0, 1, 2])))
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(60)]                     # copies under several labels
    rows += [(1100, [0.0] * 12, 1), (1110, [], 1), (1120, rows[5][1], 77), rows[0], (0, [9.0] * 12, 5)]
    rows += [(None, rows[1][1], 1), (1130, None, 1), (1140, rows[1][1], None), (1150, [1.0, None], 1), (1160, [math.nan, 1.0], 1), (1170, [math.inf], 1)]
    return [(*r, "x", "y", 1, 2, 3) for r in rows]


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e30])
def test_mine_equals_plain_integers(spark, monkeypatch, scale):
    monkeypatch.setattr(hardneg, "CELLS", 12 * 60)            # several blocks of both sides
    monkeypatch.setattr(hardneg, "TILE", 5)
    rows = table(random.Random(7), 260 if scale == 1.0 else 120, scale)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = sorted(map(tuple, hardneg.mine(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == brute(rows) and len(got) >= 100


def test_packed_scores_are_exact_and_several_to_an_integer():
    rng = np.random.default_rng(1)
    c, a = rng.integers(-110, 110, (1001, 64)).astype(float), rng.integers(-110, 110, (30, 64)).astype(float)
    p = hardneg.Packed(c, a)
    assert p.fields >= 2 and not p.wide
    assert (p.scores(0, 30) == (a.astype(np.int64) @ c.T.astype(np.int64))).all()
    w = hardneg.Packed(c * 2.0 ** 34, a)
    assert w.wide and (w.scores(3, 9) == (a[3:9].astype(np.int64) @ c.T.astype(np.int64) << 34)).all()
    assert hardneg.Packed(np.full((3, 2), 7.0), np.zeros((2, 2))).scores(0, 2).tolist() == [[0] * 3] * 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROWS)
    assert hardneg.mine(none, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(10, [1.0], 1, "", "", 0, 0, 0)], ROWS)
    assert hardneg.mine(alone, F.col("vec_id") % 10 == 0).count() == 0
    assert hardneg.mine(alone, F.lit(False)).count() == 0
