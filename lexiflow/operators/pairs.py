"""Skip-gram training pairs with negative samples, hashed ids and PMI.

A file is one row, so all per-file work needs no shuffle: neighbour shifts and
context lists are array functions inside the row, seeded permutations for
negatives are taken on Arrow batches of files. A batch of files of bounded
size is one group, a larger one is ordered by ranges. The unit of the negative-sample permutation is the file (see README).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.functions.hashing import hash32, hash32_words
from lexiflow.operators.cleaning import number_rows, rank_rows, with_once
from lexiflow.session import stage

FILES = 128                # files whose context rows are held at once
ROWS = 4096                # context rows labelled at once
BATCH_CHARS = 1 << 22      # characters of a batch whose negatives are drawn in one task; larger batches go by ranges


def file_batches(files: DataFrame, batch_size: int = 100, id_col: str = "doc_id") -> DataFrame:
    """The listed files in id order, ``batch_size`` to a batch (the last may be smaller)."""
    return (number_rows(files, id_col)
            .withColumn("batch_id", F.floor(F.col("_n") / F.lit(batch_size)).cast("bigint")).drop("_n"))


def manifest_filter(files: DataFrame, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Keep only files listed in the manifest (semi join)."""
    return files.join(manifest.select(id_col), id_col, "left_semi")


def line_tokens(text: Column) -> Column:
    """T03 over the lines of a file: empty lines skipped, each line split on
    single spaces (empty tokens kept), flattened in file order."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda ln: ln != "")
    return F.flatten(F.transform(lines, lambda ln: F.split(ln, " ")))


def context_list(tokens: Column, window: int = 1) -> Column:
    """Array of (pos, side, center, context) in center order, the
    neighbours at distances 1..window on the left then the right; empty
    contexts dropped.

    Built from shifted slices combined with ``zip_with``: every lambda sees
    only its own arguments, so the token array is evaluated a fixed number
    of times per row however long the file is.
    """
    n = F.size(tokens)

    def pairs(d, side):
        m = F.greatest(n - d, F.lit(0))
        head, tail = F.slice(tokens, 1, m), F.slice(tokens, d + 1, m)
        if side > 0:   # centre p, right neighbour p + d
            z = F.zip_with(head, tail, lambda c, x: F.struct(c.alias("center"), x.alias("context")))
            off = 0
        else:          # centre p + d, left neighbour p
            z = F.zip_with(tail, head, lambda c, x: F.struct(c.alias("center"), x.alias("context")))
            off = d
        return F.transform(z, lambda s, i: F.struct((i + off).alias("pos"), F.lit(side).alias("side"),
                                                    s["center"].alias("center"), s["context"].alias("context")))

    parts = []
    for d in range(1, window + 1):
        parts += [pairs(d, -d), pairs(d, d)]
    return F.filter(F.sort_array(F.concat(*parts)), lambda s: s["context"] != "")


def _contexts(files: DataFrame, window: int, text_col: str, id_col: str) -> DataFrame:
    t = with_once(files.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_t", line_tokens(F.col("_text")))
    return with_once(t.select("doc_id", "_t"), "c", context_list(F.col("_t"), window)).select("doc_id", "c")


def skipgram_pairs(files: DataFrame, window: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, r, center_word, context_word): positive pairs, r = index in the file's context list."""
    x = _contexts(files, window, text_col, id_col)
    # inline() of an indexed struct array: the generator reads the array once
    # (posexplode of the computed array re-evaluated it per output row).
    rows = F.transform("c", lambda s_, i: F.struct(i.cast("bigint").alias("r"), s_["center"].alias("center_word"),
                                                   s_["context"].alias("context_word")))
    return x.select("doc_id", F.inline(rows))


def _negative_rows(doc_id: pa.Array, key: list, tokens: pa.Array, seeds: list[int], window: int, whole: bool) -> list:
    """Columns (doc_id, r, center, context, neg_0..neg_{k-1}) of the given files: the context rows of ``context_list``
    in file order, and as negatives the contexts in the order of a seeded hash of (doc, r), within each file or,
    with ``whole``, over all of them, which come in the order of their ids."""
    sides = np.array([d for d in range(-window, window + 1) if d])
    words, n = tokens.flatten(), pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
    first = np.cumsum(n) - n
    file = np.repeat(np.arange(len(n)), n)
    center = np.repeat(np.arange(len(words)), len(sides))
    context = center + np.tile(sides, len(words))
    of = file[center]
    kept = (context >= first[of]) & (context < (first + n)[of])
    center, context, of = center[kept], context[kept], of[kept]
    kept = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[context]
    center, context, of = center[kept], context[kept], of[kept]
    r = np.arange(len(of)) - np.searchsorted(of, of)                       # index in the file's context list
    if whole and len(set(key)) < len(key):                                 # files of one id are numbered as one, by r
        place = np.cumsum([k != p for k, p in zip(key, [None, *key])])
        order = np.lexsort((r, place[of]))
        center, context, of, r = center[order], context[order], of[order], r[order]
    places = [f"{key[f]}:{i}" for f, i in zip(of.tolist(), r.tolist())]
    known = np.array([k is not None for k in key], bool)[of]               # a file without an id keeps its order
    out = [doc_id.take(pa.array(of)), pa.array(r), words.take(pa.array(center)), words.take(pa.array(context))]
    for h in hash32_words(places, seeds):
        h = np.where(known, h, 0)
        out.append(words.take(pa.array(context[np.argsort(h, kind="stable") if whole else np.argsort((of << 32) + h, kind="stable")])))
    return out


def _tokenized(files: DataFrame, *more: str) -> DataFrame:
    return files.select(*more, "doc_id", F.col("doc_id").cast("string").alias("key"), line_tokens(F.col("text")).alias("tokens"))


def negative_samples(files: DataFrame, seeds: list[int], window: int = 1, text_col: str = "text",
                     id_col: str = "doc_id") -> DataFrame:
    """(doc_id, r, center_word, context_word, neg_0..neg_{k-1}).

    Negative k of row r is the context at position r of the k-th seeded
    permutation of the file's context column, so negatives follow the
    context unigram distribution of the file (no collision rejection).
    """
    x = _tokenized(files.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    schema = T.StructType([x.schema["doc_id"], T.StructField("r", T.LongType()), T.StructField("center_word", T.StringType()),
                           T.StructField("context_word", T.StringType()), *(T.StructField(f"neg_{k}", T.StringType()) for k in range(len(seeds)))])

    def negatives(batches):
        for b in batches:
            for at in range(0, b.num_rows, FILES):
                part = b.slice(at, FILES)
                yield pa.RecordBatch.from_arrays(_negative_rows(part.column("doc_id"), part.column("key").to_pylist(), part.column("tokens"), seeds, window, False),
                                                 schema.names)

    out = x.mapInArrow(negatives, schema)
    out._steps = x, [negatives]
    return out


def negative_samples_batch(files: DataFrame, seeds: list[int], batch_size: int = 100, window: int = 1,
                           text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """W04 over the batch: (batch_id, row, doc_id, center_word, context_word, neg_0..neg_{k-1}).

    The context rows of a batch of ``batch_size`` files are numbered in file
    order; negative k of row r is the context that a seeded permutation of the
    whole batch puts at place r, so every negative column holds the batch's
    contexts, each as often as it occurs. A permutation is the order of a
    seeded hash. The tokens of a batch of at most ``BATCH_CHARS`` characters
    meet in one task, where context rows are made and permuted, so that no
    context row is shuffled; a larger batch is numbered by ranges (``rank_rows``)
    and its columns meet by (batch, row), so a batch may be of any size.
    """
    ids = file_batches(files.select(id_col), batch_size, id_col).select(F.col(id_col).alias("doc_id"), "batch_id")
    x = files.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id")
    x = stage(x, "batch-files")
    chars = x.groupBy("batch_id").agg(F.sum(F.length("text")).alias("_chars"))
    large = chars.where(F.col("_chars") > BATCH_CHARS).select("batch_id")
    small = x.join(large, "batch_id", "left_anti")
    out = _batch_negatives(small, seeds, window)
    if large.isEmpty():
        return out
    return out.unionByName(_batch_negatives_by_ranges(x.join(large, "batch_id", "left_semi"), seeds, window))


def _batch_negatives(files: DataFrame, seeds: list[int], window: int) -> DataFrame:
    """Negatives of whole batches, each in one task."""
    names = ["center_word", "context_word", *(f"neg_{k}" for k in range(len(seeds)))]
    schema = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("row", T.LongType()), files.schema["doc_id"],
                           *(T.StructField(n, T.StringType()) for n in names)])

    def negatives(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("doc_id")
        doc_id, tokens = (batch.column(c).combine_chunks() for c in ("doc_id", "tokens"))
        doc_id, _, *words = _negative_rows(doc_id, batch.column("key").to_pylist(), tokens, seeds, window, True)
        number = batch.column("batch_id")[0].as_py()
        return pa.Table.from_arrays([pa.array(np.full(len(doc_id), number, np.int64)), pa.array(np.arange(len(doc_id))), doc_id, *words], schema.names)

    return _tokenized(files, "batch_id").groupBy("batch_id").applyInArrow(negatives, schema)


def _batch_negatives_by_ranges(files: DataFrame, seeds: list[int], window: int) -> DataFrame:
    """The same for batches of any size: permutations are orders by ranges, and the columns meet by (batch, row)."""
    t = files.select("batch_id", "doc_id", context_list(line_tokens(F.col("text")), window).alias("c"))
    rows = F.transform("c", lambda s_, i: F.struct(i.cast("bigint").alias("r"), s_["center"].alias("center_word"),
                                                   s_["context"].alias("context_word")))
    x = stage(t.select("batch_id", "doc_id", F.inline(rows)), "batch-contexts")
    out = rank_rows(x, ["doc_id", "r"], ["batch_id"], "row")
    place = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("r").cast("string"))
    for k, s in enumerate(seeds):
        mixed = x.select("batch_id", "doc_id", "r", F.col("context_word").alias(f"neg_{k}"), hash32(place, s).alias("_h"))
        mixed = rank_rows(mixed, ["_h", "doc_id", "r"], ["batch_id"], "row")
        out = out.join(mixed.select("batch_id", "row", f"neg_{k}"), ["batch_id", "row"])
    return out.select("batch_id", "row", "doc_id", "center_word", "context_word", *[f"neg_{k}" for k in range(len(seeds))])


def label_pairs(neg: DataFrame, k: int) -> DataFrame:
    """[positive, neg_0..neg_{k-1}] exploded with labels [1, 0, ..., 0]."""
    arr = F.array(F.col("context_word"), *[F.col(f"neg_{i}") for i in range(k)])
    out = neg.select("doc_id", "r", "center_word", F.posexplode(arr).alias("slot", "ctx")).select(
        "doc_id", "r", F.col("slot").cast("bigint").alias("slot"), "center_word",
        F.col("ctx").alias("context_word"), F.when(F.col("slot") == 0, 1).otherwise(0).alias("label"))
    source, steps = _steps(neg)
    if steps:
        out._steps = source, [*steps, _labelled(k)]
    return out


def _steps(df: DataFrame) -> tuple[DataFrame, list]:
    """(source, functions of Arrow batches) that ``df`` is made by, or (df, []): an operator that goes on in Arrow runs them
    before its own function in one Python pass, so the rows between do not go through the JVM."""
    return df.__dict__.get("_steps", (df, []))


def _labelled(k: int):
    """``label_pairs`` on Arrow batches, of at most ``ROWS`` rows put in."""
    def step(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                row, slot = np.repeat(np.arange(b.num_rows), k + 1), np.tile(np.arange(k + 1), b.num_rows)
                words = pa.concat_arrays([b.column(c) for c in ("context_word", *(f"neg_{i}" for i in range(k)))])
                doc_id, r, center = (b.column(c).take(pa.array(row)) for c in ("doc_id", "r", "center_word"))
                yield pa.RecordBatch.from_arrays([doc_id, r, pa.array(slot), center, words.take(pa.array(slot * b.num_rows + row)), pa.array((slot == 0).astype(np.int32))],
                                                 ["doc_id", "r", "slot", "center_word", "context_word", "label"])
    return step


def hash_features(pairs: DataFrame, seeds: list[int]) -> DataFrame:
    """Seeded 32-bit hashes of centre and context words (BIGINT, unsigned range).

    Words repeat within a batch of rows, so each distinct one is hashed once per batch and seed."""
    words = {"centw": "center_word", "contw": "context_word"}
    schema = T.StructType([*pairs.schema.fields, *(T.StructField(f"{w}_{i}", T.LongType()) for w in words for i in range(len(seeds)))])
    source, steps = _steps(pairs)

    def features(batches):
        for step in steps:
            batches = step(batches)
        for b in batches:
            columns = list(b.columns)
            both = pa.concat_arrays([b.column(c).cast(pa.string()) for c in words.values()]).dictionary_encode()
            hashes = [pa.array(h) for h in hash32_words(both.dictionary.to_pylist(), seeds)]
            for at in (both.indices[:b.num_rows], both.indices[b.num_rows:]):
                columns += [h.take(at) for h in hashes]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(features, schema)


def pmi_pairs(pairs: DataFrame) -> DataFrame:
    """(center_word, context_word, n_ij, pmi) with pmi = ln(n * n_ij / (n_i * n_j)).

    Marginals are per-word aggregates joined back (no window over a word),
    the total is a scalar subquery.
    """
    p = pairs.select("center_word", "context_word")
    n = p.select(F.count(F.lit(1))).scalar()
    cij = p.groupBy("center_word", "context_word").agg(F.count(F.lit(1)).alias("n_ij"))
    ci = p.groupBy("center_word").agg(F.count(F.lit(1)).alias("n_i"))
    cj = p.groupBy("context_word").agg(F.count(F.lit(1)).alias("n_j"))
    return (cij.join(ci, "center_word").join(cj, "context_word")
               .select("center_word", "context_word", "n_ij",
                       F.log(n * F.col("n_ij") / (F.col("n_i") * F.col("n_j"))).alias("pmi")))
