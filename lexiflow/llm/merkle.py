"""Merkle manifest of a dataset: checkpoint and recompute.

Every row is a leaf. The leaves of a group (a source), in order, are the lowest level of
a tree whose nodes are the digests of ``FANOUT`` consecutive nodes below; the groups'
tops, in order, are the leaves of one more tree, whose top is the root. Only every
``stride``-th level is kept (levels 0, stride, 2 stride, ...). A stored node's aligned
subtree holds the at most FANOUT ** stride stored nodes below it: building hashes them up
to the next stored level and forgets the levels between; extracting proofs regenerates
these levels from the stored descendants, emits the siblings on each path, and discards
them again. Paths are extracted from the top down, so what lies above a subtree is
computed once for it and not for each leaf.

A leaf's place in its group is counted over ranges of (group, order), and a subtree is
keyed by (group, block), so a large group is spread over as many tasks as it has subtrees.
Row contents stay in the scan: only digests are shuffled.

Defined results: a null field is hashed as ``-``; null groups come first, as one group;
null orders come first in their group; rows of one group and order are ordered by digest;
repeated rows are separate leaves; a group of one row has its leaf as top, one group has
its top as root; an empty table has no leaves, no root and no proofs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import materialize
from lexiflow.operators.cleaning import rank_rows

FANOUT = 16
STRIDE = 2
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def encoded(field: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    s = field.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def row_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def _runs(n: Column, width: int) -> Column:
    return F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int"))


def _cut(nodes: Column, width: int):
    """The r-th run of ``width`` nodes (the last may be shorter)."""
    return lambda r: F.slice(nodes, r * width + 1, F.lit(width))


def _above(digests: Column) -> Column:
    """One level up: digests of FANOUT consecutive nodes."""
    runs = F.transform(_runs(F.size(digests), FANOUT), _cut(digests, FANOUT))
    return F.transform(runs, lambda run: F.sha2(F.array_join(run, ""), 256))


def _subtrees(nodes: DataFrame, stride: int, *carried: str) -> DataFrame:
    """(tree, block, size, nodes): the aligned subtrees of one stored level."""
    span = FANOUT ** stride
    item = F.struct("pos", "digest", *carried)
    return (nodes.groupBy("tree", "size", F.floor(F.col("pos") / span).alias("block"))
            .agg(F.array_sort(F.collect_list(item)).alias("nodes")))


def build_levels(leaves: DataFrame, stride: int = STRIDE) -> list[DataFrame]:
    """The stored levels of a forest of trees, lowest first: (tree, pos, digest, size) of
    all nodes, ``size`` being the tree's number of nodes on that level. A tree ends at its
    top, which is the last level's node or that of one between (then stored as the next)."""
    levels = [leaves]
    while True:
        below = levels[-1]
        if below.where(F.col("size") > 1).isEmpty():
            return levels
        up = _subtrees(below.where(F.col("size") > 1), stride)
        up = up.withColumn("d", F.transform("nodes", lambda x: x["digest"]))
        for _ in range(stride):           # a finished tree (one node) is not hashed further
            up = (up.withColumn("d", F.when(F.col("size") > 1, _above(F.col("d"))).otherwise(F.col("d")))
                  .withColumn("size", F.ceil(F.col("size") / FANOUT)))
        levels.append(materialize(up.select("tree", F.col("block").alias("pos"), F.col("d")[0].alias("digest"), "size"), "merkle-level"))


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): the top of every tree."""
    out = None
    for nodes in levels:
        top = nodes.where(F.col("size") == 1).select("tree", "digest")
        out = top if out is None else out.unionByName(top)
    return out


def proofs(levels: list[DataFrame], above: DataFrame, stride: int = STRIDE, carried: tuple = ()) -> DataFrame:
    """(tree, pos, digest, carried..., above's columns, path): the lowest level's nodes with their
    path to the root, an array of (left, right): the siblings' digests on either side, level by level.
    ``above`` (tree, path, ...) is what lies above each tree's top."""
    more = [c for c in above.columns if c not in ("tree", "path")]
    found = None
    for k in range(len(levels) - 1, -1, -1):
        nodes, keep = levels[k], carried if k == 0 else ()
        done = nodes.where(F.col("size") == 1).join(above, "tree").select("tree", "pos", "digest", *keep, *more, "path")
        if found is not None:
            parents = found.select("tree", F.col("pos").alias("block"), *more, F.col("path").alias("upper"))
            sub = _subtrees(nodes.where(F.col("size") > 1), stride, *keep).join(parents, ["tree", "block"])
            done = done.unionByName(_extend(sub, stride, keep, more))
        found = done if k == 0 else materialize(done, "merkle-paths")
    return found


def _extend(sub: DataFrame, stride: int, carried, more) -> DataFrame:
    """Paths of a subtree's lowest nodes, from its top down: regenerate the digests of its FANOUT parts from the stored
    nodes, emit each part's siblings, and go on with the parts alone."""
    sub = sub.select("tree", "size", *more, "nodes", F.col("upper").alias("path"))
    for j in range(stride - 1, -1, -1):
        width = FANOUT ** j           # stored nodes below one part

        parts, digests = F.col("nodes"), F.transform("nodes", lambda x: x["digest"])
        if j:
            parts = F.transform(_runs(F.size("nodes"), width), _cut(F.col("nodes"), width))
            for _ in range(j):
                digests = _above(digests)
        sub = sub.select("tree", "size", *more, "path", digests.alias("d"), F.posexplode(parts).alias("i", "nodes"))
        sibling = F.struct(F.array_join(F.slice("d", F.lit(1), F.col("i")), "").alias("left"),
                           F.array_join(F.slice("d", F.col("i") + 2, F.lit(FANOUT)), "").alias("right"))
        path = F.when(F.col("size") > width, F.concat(F.array(sibling), "path")).otherwise(F.col("path"))   # else above the tree's top
        sub = sub.select("tree", "size", *more, "nodes", path.alias("path"))
    return sub.select("tree", "nodes.pos", "nodes.digest", *[f"nodes.{c}" for c in carried], *more, "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root recomputed from a leaf and its path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


class Manifest:
    """The stored levels of a dataset: ``leaves`` (group, order and other columns of the rows given,
    tree, pos, digest, size), ``levels`` of the groups' trees, ``upper`` of the tree over the groups."""

    def __init__(self, rows: DataFrame, group: str, order: str, digest: str = "digest", stride: int = STRIDE):
        self.stride, self.group = stride, group
        rows = materialize(rows.withColumnRenamed(digest, "digest"), "merkle-rows")       # contents are read and hashed once
        placed = materialize(rank_rows(rows, [order, "digest"], [group], "pos"), "merkle-ranked")
        groups = materialize(rank_rows(placed.groupBy(group).agg(F.count(F.lit(1)).alias("size")), [group], name="tree"), "merkle-groups")
        self.extra = [c for c in placed.columns if c not in ("pos", "digest")]
        keyed = groups.select(F.col(group).alias("_merkle_group"), "tree", "size")
        self.leaves = materialize(placed.join(keyed, placed[group].eqNullSafe(keyed["_merkle_group"]))
                                  .select("tree", "pos", "digest", "size", *self.extra), "merkle-leaves")
        self.levels = build_levels(self.leaves, stride)
        n = groups.count()
        self.subroots = tops(self.levels)
        own = self.subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", F.lit(n).cast("long").alias("size"))
        self.upper = build_levels(materialize(own, "merkle-subroots"), stride)

    def root(self) -> DataFrame:
        """(root): one row, none for an empty table."""
        return tops(self.upper).select(F.col("digest").alias("root"))

    def proofs(self) -> DataFrame:
        """(tree, pos, digest, the rows' other columns, subroot, root, path) of every leaf."""
        top = self.root().select(F.lit(0).cast("long").alias("tree"), "root", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
        over = proofs(self.upper, top, self.stride)
        over = over.select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
        return proofs(self.levels, materialize(over, "merkle-over"), self.stride, tuple(self.extra))


def manifest_of(docs: DataFrame, stride: int = STRIDE, claims: dict | None = None) -> Manifest:
    """Manifest of ``documents`` rows by source and doc_id; ``claims`` names further digests to carry."""
    cols = {k: v for k, v in (claims or {}).items()}
    return Manifest(docs.select("source", "doc_id", row_digest([F.col(c) for c in FIELDS]).alias("digest"),
                                *[v.alias(k) for k, v in cols.items()]), "source", "doc_id", stride=stride)


def audit(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Proofs of all rows, checked against copies of which some are tampered with (the text's A-Z lower-cased where 5
    divides the CRC-32 of doc_id): (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
                     row_digest([lower if c == "text" else F.col(c) for c in FIELDS]))
    p = manifest_of(docs, stride, {"claim": changed}).proofs()
    p = p.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                 fold(F.coalesce("claim", "digest"), F.col("path")).alias("folded_root"))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))


def _level_sql(name: str, below: str) -> str:
    """One level up; a tree of one node stays as it is."""
    return f"""{name} AS (
  SELECT tree, pos // 16 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE max(d) END AS d,
         max(n + 15) // 16 AS n FROM {below} GROUP BY tree, pos // 16)"""


def _siblings_sql(name: str, level: str) -> str:
    """Siblings left and right of each node, empty at a top."""
    w = "OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
    return f"""{name} AS (
  SELECT tree, pos, n, coalesce(string_agg(d, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(d, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {level})"""


def _oracle(depth: int = 5) -> str:
    """SQL of ``audit`` level by level, up to 16 ** depth rows a source and as many sources."""
    def enc(c):
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(text):
        return "sha256(" + " || ".join(enc(text if c == "text" else c) for c in FIELDS) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # CRC-32 bit by bit: each byte enters with the first of its eight steps
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = (f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), "
           "lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)), 4294967295)")
    parts = [f"""leaves AS (
  SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS claim FROM documents)""",
             """ranked AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n FROM leaves)""",
             "a0 AS (SELECT tree, pos, leaf AS d, n FROM ranked)"]
    for k in range(depth):
        parts += [_siblings_sql(f"sa{k}", f"a{k}"), _level_sql(f"a{k + 1}", f"a{k}")]
    parts.append(f"b0 AS (SELECT 0 AS tree, tree AS pos, d, count(*) OVER () AS n FROM a{depth})")
    for k in range(depth):
        parts += [_siblings_sql(f"sb{k}", f"b{k}"), _level_sql(f"b{k + 1}", f"b{k}")]
    joins = [f"JOIN sa{k} ON sa{k}.tree = r.tree AND sa{k}.pos = r.pos // {16 ** k}" for k in range(depth)]
    joins += [f"JOIN sb{k} ON sb{k}.pos = r.tree // {16 ** k}" for k in range(depth)]
    names = [f"{t}{k}" for t in ("sa", "sb") for k in range(depth)]
    sides = " || ".join(f"{s}.l || {s}.r" for s in names)
    steps = "[" + ", ".join(f"{{'l': {s}.l, 'r': {s}.r, 'n': {s}.n}}" for s in names) + "]"
    parts.append(f"""paths AS (
  SELECT r.doc_id, r.leaf, coalesce(r.claim, r.leaf) AS h0, top.d AS subroot, b{depth}.d AS root, sha256({sides}) AS proof_sha256,
         {steps} AS steps FROM ranked r {' '.join(joins)} JOIN a{depth} top ON top.tree = r.tree CROSS JOIN b{depth})""")
    last = "paths"
    for k in range(2 * depth):
        parts.append(f"""f{k} AS (SELECT * REPLACE (CASE WHEN steps[{k + 1}].n > 1 THEN sha256(steps[{k + 1}].l || h0 || steps[{k + 1}].r)
  ELSE h0 END AS h0) FROM {last})""")
        last = f"f{k}"
    return ("WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, proof_sha256, h0 AS folded_root, h0 = root AS verified FROM {last}""")


ORACLE = _oracle()
