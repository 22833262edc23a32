"""SimHash near-duplicates through sharded vantage-point trees.

A 64-bit fingerprint per document (majority of the bits of its shingles' XXH64).
Equal fingerprints form one class at once. On all 64 bits a radius hardly prunes: the
distances of unrelated fingerprints lie close to 32, so the boundary of ``max_bits``
around any radius holds a third of them. The bits are therefore split into
``max_bits + 1`` parts of like information, and each part has a vantage-point tree of its own: two
fingerprints within ``max_bits`` agree in one part at least, and by the triangle
inequality their distances to a vantage point of that part's tree are equal, so they
meet in a leaf of that tree without boundary copies. A fingerprint stands in
``max_bits + 1`` leaves, however large the table is.

A tree is fitted on a bounded sample. The points of a leaf that is still above ``bound``
are dealt again, by trees over the bits not yet agreed on, fitted on these points; when
``REST`` bits or fewer are left, the agreed bits themselves divide the leaf. Within a leaf,
points are sorted by the distance to a vantage point on all bits and cut into shards;
each shard meets those whose distances overlap its own by ``max_bits``, where pairs are
computed exactly. A leaf returns one row per linked fingerprint with its leaf-local
component, never the pairs; components that share a fingerprint are then joined by label
propagation over the components alone.

Defined results: null text is the empty text; a text without words has
fingerprint zero; shorter texts hash their whole word sequence; repeated rows fall
in one class; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.common import bounded_sample, materialize

SHINGLE = 3
MAX_BITS = 3
SAMPLE = 32768         # fingerprints that a round's trees are fitted on, at most
LEAF = 2000            # distinct fingerprints aimed at per leaf; leaves of over twice as many are dealt again
REST = 11              # bits that 2,048 distinct fingerprints may still differ in
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 14       # shingles whose bits are unpacked at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    if len(words) < shingle:
        grams = [" ".join(words)]
    else:
        grams = map(" ".join, zip(*(words[i:] for i in range(shingle))))
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(g.encode("utf-8", "replace"), 42) for g in grams), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _BLOCK):
        part = np.unpackbits(h[i:i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text_col: str, out_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``df`` plus its fingerprint as a signed long (the same 64 bits)."""
    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(text_col)), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], [*b.schema.names, out_col])
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.LongType())])
    return df.mapInArrow(run, schema)


def distances(fps: np.ndarray, v) -> np.ndarray:
    return np.bitwise_count(fps ^ v).astype(np.int16)


def parts(used: int, n: int, sample: np.ndarray) -> list[int]:
    """Masks of ``n`` parts of the bits outside ``used``; bits that divide the sample evenly are
    spread over the parts, so that no part is left with bits in which all points agree."""
    free = [b for b in range(64) if not used >> b & 1]
    ones = np.array([float((sample >> np.uint64(b) & np.uint64(1)).mean()) for b in free])
    even = np.array(free)[np.argsort(-ones * (1 - ones), kind="stable")]
    return [sum(1 << int(b) for b in even[i::n]) for i in range(n)]


def fit_tree(sample: np.ndarray, leaves: int, part: int):
    """Nested (vantage, radius, left, right) over the bits of ``part``; a leaf is None.
    Of some sample points and radii, those are taken whose larger side is smallest."""
    if leaves <= 1 or len(sample) < 16:
        return None
    mask, best = np.uint64(part), None
    for v in sample[:: max(1, len(sample) // 8)]:
        inside = np.cumsum(np.bincount(distances(sample & mask, v & mask), minlength=65))
        larger = np.maximum(inside, len(sample) - inside)
        r = int(larger.argmin())
        if best is None or larger[r] < best[0]:
            best = (int(larger[r]), v, r)
    if best[0] == len(sample):
        return None
    _, v, r = best
    near = distances(sample & mask, v & mask) <= r
    left = max(1, round(leaves * float(near.mean())))
    return (v, r, fit_tree(sample[near], left, part), fit_tree(sample[~near], max(1, leaves - left), part))


def deal(tree, fps: np.ndarray, part: int) -> np.ndarray:
    """The leaf of every point: its path in the tree, 1 at the root."""
    mask, leaf = np.uint64(part), np.ones(len(fps), np.int64)

    def down(node, idx):
        if node is None or len(idx) == 0:
            return
        v, r, a, b = node
        far = distances(fps[idx] & mask, v & mask) > r
        leaf[idx] = 2 * leaf[idx] + far
        down(a, idx[~far])
        down(b, idx[far])

    down(tree, np.arange(len(fps)))
    return leaf


def dealt_again(points: DataFrame, largest: int, max_bits: int, leaf: int) -> DataFrame:
    """(fp, leaf, used): the points of ``points`` (the same columns) in the leaves of new
    trees, one for each part of the bits that their leaves have not agreed on yet."""
    n = max_bits + 1
    forest = {}
    for used in sorted(r.used for r in points.select("used").distinct().collect()):     # n ** round at most
        mask = used & (2 ** 64 - 1)
        if 64 - mask.bit_count() <= REST:
            continue
        sample = np.array([r.fp for r in bounded_sample(points.where(F.col("used") == used), "fp", SAMPLE).collect()], np.int64).view(np.uint64)
        sample = np.unique(sample)
        forest[used] = [(part, fit_tree(sample, -(-largest // leaf), part)) for part in parts(mask, n, sample)]

    def run(batches):
        for b in batches:
            fp, old, was = (b.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "leaf", "used"))
            for used in np.unique(was):
                here = was == used
                x, mask = fp[here].view(np.uint64), int(used) & (2 ** 64 - 1)
                trees = forest.get(int(used))
                if trees is None:      # few bits left: the agreed ones are the leaf
                    out = [(x & np.uint64(mask)).view(np.int64)], [mask]
                else:
                    out = [deal(tree, x, part) for part, tree in trees], [mask | part for part, _ in trees]
                for tree, (name, now) in enumerate(zip(*out)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp[here]), pa.array(old[here]), pa.array(np.full(len(x), tree, np.int32)), pa.array(name),
                         pa.array(np.full(len(x), now, np.uint64).view(np.int64))], ["fp", "old", "tree", "name", "used"])

    new = points.select("fp", "leaf", "used").mapInArrow(run, "fp long, old long, tree int, name long, used long")
    return new.select("fp", F.xxhash64("old", "tree", "name", "used").alias("leaf"), "used")


def leaves_of(fps: DataFrame, max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """(fp, leaf) of the distinct fingerprints ``fps`` (fp): every two within ``max_bits``
    share a leaf; no leaf holds more than ``2 * leaf``, or ``2 ** REST`` if that is more."""
    bound, least = 2 * leaf, 2 ** REST
    points = fps.select("fp", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("used"))
    done = []
    while True:
        sizes = points.groupBy("leaf", "used").agg(F.count(F.lit(1)).alias("size"))
        # few free bits and the agreed bits as the leaf: nothing is left to divide
        last = F.bit_count("used") >= 64 - REST
        over = sizes.where(F.col("size") > F.when(last, max(bound, least)).otherwise(bound))
        largest = over.agg(F.max("size")).first()[0]
        if largest is None:
            done.append(points)
            break
        big = over.select("leaf")
        done.append(points.join(big, "leaf", "left_anti"))
        points = materialize(dealt_again(points.join(big, "leaf", "left_semi"), largest, max_bits, leaf), "simhash-dealt")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("fp", "leaf")


def leaf_components(fps: np.ndarray, max_bits: int):
    """Label (smallest index) per point of a leaf; points sorted by the distance to
    a vantage point are compared only within ``max_bits`` of it, in blocks."""
    n = len(fps)
    d = distances(fps, fps[0]) if n else np.zeros(0, np.int16)
    order = np.argsort(d, kind="stable")
    p, d = fps[order], d[order]
    lab = np.arange(n)
    block = 256
    for i in range(0, n, block):
        e = min(n, i + block)
        hi = int(np.searchsorted(d, d[e - 1] + max_bits, "right"))
        near = np.bitwise_count(p[i:e, None] ^ p[None, i:hi]) <= max_bits
        hits = near.sum(axis=1)
        for k in np.nonzero(hits > 1)[0]:
            u = np.unique(lab[i:hi][near[k]])
            if len(u) > 1:
                lab[np.isin(lab, u)] = u[0]
    out = np.empty(n, np.int64)
    out[order] = lab
    return out


def linked_components(fps: DataFrame, max_bits: int = MAX_BITS, leaf: int = LEAF) -> DataFrame:
    """(fp, label) of the distinct fingerprints ``fps`` (fp) that link to another; label is a fingerprint."""
    def components(t: pa.Table) -> pa.Table:
        x = np.unique(t.column("fp").to_numpy())
        lab = leaf_components(x.view(np.uint64), max_bits)
        many = np.bincount(lab, minlength=len(x))[lab] > 1
        leaf_name = t.column("leaf")[0].as_py()
        return pa.table({"fp": x[many], "leaf": np.full(int(many.sum()), leaf_name), "root": x[lab[many]]},
                        schema=pa.schema([("fp", pa.int64()), ("leaf", pa.int64()), ("root", pa.int64())]))

    local = materialize(leaves_of(fps, max_bits, leaf).groupBy("leaf").applyInArrow(components, "fp long, leaf long, root long")
                        .select("fp", F.struct("leaf", "root").alias("comp")), "simhash-local")
    prev = F.lag("comp").over(Window.partitionBy("fp").orderBy("comp"))
    edges = (local.withColumn("prev", prev).where(F.col("prev").isNotNull())
             .select(F.col("prev").alias("a"), F.col("comp").alias("b")).distinct())
    label = component_labels(edges)
    return (local.join(label, local["comp"] == label["node"], "left")
            .select("fp", F.coalesce("label", "comp").alias("label")).distinct())


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label): smallest node of each component of ``edges`` (a, b), by hooking
    nodes to their smallest neighbour and halving the paths, until nothing changes.
    A component's edges shrink to one star per round; finished stars leave."""
    pairs = materialize(edges.select("a", "b"), "simhash-edges")
    while True:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(small, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct())
        # now every edge points to a smaller node: link each node's smaller neighbours to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = (large.join(low, "a")
               .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                         F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
               .select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct())
        nxt = materialize(nxt, "simhash-edges")
        norm = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        same = nxt.exceptAll(norm).isEmpty() and norm.exceptAll(nxt).isEmpty()
        pairs = nxt
        if same:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def simhash_components(df: DataFrame, text_col="text", id_col="doc_id", shingle=SHINGLE,
                       max_bits=MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint hex, component_id): one row per row of ``df``."""
    docs = materialize(with_fingerprint(
        df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", "fp", shingle)
        .select("doc_id", "fp"), "simhash-docs")
    classes = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    linked = materialize(linked_components(classes, max_bits), "simhash-linked")
    firsts = linked.join(classes, "fp").groupBy("label").agg(F.min("first_id").alias("component_id"))
    merged = classes.join(linked.join(firsts, "label").select("fp", "component_id"), "fp", "left")
    merged = materialize(merged.select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "simhash-merged")
    return (docs.join(merged, "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one_per_component(df: DataFrame, text_col="text", id_col="doc_id", **kw) -> DataFrame:
    """Rows of ``df``, one per component: that of the smallest id. Of repeated rows
    with this id, one stays (first by a hash of the row). Rows without id stay."""
    comp = simhash_components(df, text_col, id_col, **kw)
    keep, nth = (f"_simhash_{uuid.uuid4().hex}" for _ in range(2))       # no column of ``df`` has such a name
    best = comp.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(keep)).distinct()
    kept = df.join(best, df[id_col] == best[keep], "left_semi")
    one = Window.partitionBy(F.col(id_col)).orderBy(F.xxhash64(text_col), F.col(text_col))
    kept = kept.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).drop(nth)
    return kept.unionByName(df.where(F.col(id_col).isNull()))
