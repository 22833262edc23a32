"""Removal of repeated passages with suffix arrays built by two-stage sorting.

A window is ``length`` consecutive bytes of a text; it is repeated if its bytes also start
anywhere else. The windows of all texts are dealt to suffix arrays as follows. Each window has an
anchor, the ``GRAM``-byte string in it with the smallest hash, which depends on its bytes alone:
equal windows have equal anchors, so it suffices to bring together the places of one anchor. Consecutive
windows with one anchor place share a context, the bytes from the first window's start to the last
one's end. Only hashes of anchors and contexts are shuffled at first. A context that occurs twice
is repeated whole, and one of its places stands for it; an anchor with one place has no repeated
window; the contexts of all other anchors are cut out of the texts and sorted in shards.

A shard's suffix array is built in two stages (``suffix_order``): only the suffixes smaller than their
successors are sorted directly; all others are induced from them by one scan over the buckets of first
bytes. Windows whose adjacent common prefix reaches ``length`` are repeated.

Sizes: a shard holds whole anchors, about ``SHARD`` bytes. An anchor with more than ``MOST`` different
contexts (a passage that ends differently in very many texts) is left to ``crowded``, which counts its
windows by 128-bit digests, combined within each batch before the shuffle; nothing is left out.
The records of an anchor (24 bytes a place, combined within each batch) meet in one sort partition.

Defined results: null text is empty; texts shorter than ``length`` lose nothing; repeated rows are separate
texts, so all of a repeated text of ``length`` bytes or more goes; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import materialize

LENGTH = 200
GRAM = 32
PIECE = 1 << 20        # bytes whose anchors are found at once
SHARD = 4 << 20        # bytes of contexts per suffix array
MOST = 1 << 15         # contexts of one anchor in a suffix array
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring strings from their hashes."""
    x = a * _ODD[0]
    x ^= b * _ODD[1] + _ODD[2]
    x ^= x >> np.uint64(32)
    x *= _ODD[3]
    x ^= x >> np.uint64(29)
    return x


def _words(data: np.ndarray, big=False) -> np.ndarray:
    """The eight bytes from every position (zeros behind the end) as one integer."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8" if big else "<u8", padded.data, strides=(1,)).astype(np.uint64)


def piece_anchors(data: np.ndarray, ends: np.ndarray, length: int):
    """(first window, windows, anchor hash, context hash) of the contexts in a piece; ``ends`` holds, for
    every byte, the end of its text."""
    n = len(data) - length + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
    x = _words(data)
    x16 = _join(x[:-8], x[8:])
    h = _join(x16[:-16], x16[16:])                        # of GRAM = 32 bytes
    width = length - GRAM + 1
    place = np.uint64((1 << 21) - 1)
    low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span:width - span + n])
    at = np.flatnonzero(np.arange(length, n + length) <= ends[:n])       # windows inside a text
    if not len(at):
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
    anchor = (low[at] & place).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, count = at[new], np.diff(np.append(new, len(at)))
    size = count - 1 + length
    c = size.astype(np.uint64)
    for j in range(-(-(width - 1 + length) // 16)):       # 16-byte strings that cover the context
        c = _join(c, x16[first + np.minimum(16 * j, size - 16)])
    return first, count, h[anchor[new]], c


def text_anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(text, first window, windows, anchor hash, context hash) for texts between ``offsets``, piece by piece;
    a text longer than a piece continues in the next, which starts with its next window."""
    out = []
    at, n = int(offsets[0]), int(offsets[-1])
    while at < n:
        stop = min(n, at + PIECE)
        last = int(np.searchsorted(offsets, stop, "right")) - 1      # the text that reaches over the end of the piece
        begin = max(at, int(offsets[last]))
        go_on = stop if begin == stop else begin if begin > at else stop - length + 1
        if stop == n:
            go_on = n
        rows = np.searchsorted(offsets, np.arange(at, stop), "right") - 1 if stop - at < 4096 else np.repeat(
            np.arange(len(offsets) - 1), np.clip(offsets[1:], at, stop) - np.clip(offsets[:-1], at, stop))
        first, count, h, c = piece_anchors(data[at:stop], offsets[rows + 1] - at, length)
        row = rows[first]
        keep = first + at < go_on
        out.append([x[keep] for x in (row, first + at - offsets[row], count, h, c)])
        at = go_on
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2


def _combined(keys: list[np.ndarray], places: list[np.ndarray]):
    """Equal keys of a batch as one row: (key columns, places as records of 24 bytes)."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if len(order) else order
    records = np.ascontiguousarray(np.stack([p[order] for p in places], axis=1).astype("<i8"))
    ends = (np.append(new, len(order)) * 24).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(records.tobytes())])
    return [k[new].view(np.int64) for k in keys], binary


def _text_bytes(column):
    """(bytes, offsets) of an Arrow text column."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; ``s`` ends with its smallest symbol."""
    less = np.append(s[:-1] < s[1:], True)
    change = np.append(np.flatnonzero(s[:-1] != s[1:]), len(s) - 1)
    return np.repeat(less[change], np.diff(np.concatenate([[-1], change])))


def _sorted_directly(words: np.ndarray, left: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Positions in the order of their first ``length`` bytes, eight bytes at a time, ties only; ``left`` holds the bytes
    up to the end of a position's string, behind which zeros are read."""
    order = at[np.argsort(words[at], kind="stable")]
    group = np.cumsum(np.concatenate([[False], words[order[1:]] != words[order[:-1]]])[:len(order)])
    live = np.arange(len(order))
    for depth in range(8, length, 8):
        tied = np.zeros(len(live) + 1, bool)
        tied[1:-1] = group[live[1:]] == group[live[:-1]]
        live = live[tied[1:] | tied[:-1]]
        if not len(live):
            break
        g, w = group[live], np.where(left[order[live]] > depth, words[np.minimum(order[live] + depth, len(words) - 1)], 0)
        by = np.lexsort((w, g))
        order[live], w, g = order[live][by], w[by], g[by]
        # a tie ends where these eight bytes differ: number the new groups by their first place
        first = np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])])
        group[live] = live[np.maximum.accumulate(np.where(first, np.arange(len(live)), 0))]
    return order


def _left(s: np.ndarray) -> np.ndarray:
    """Symbols from each position to the end of its string."""
    ends = np.flatnonzero(s == 0)
    return np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(len(s))


def suffix_order(s: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The wanted suffixes of ``s`` in the order of their first ``length`` symbols. ``s`` is a text of bytes + 1 in which
    strings end with 0; suffixes are compared up to the end of their string.

    Stage one sorts the suffixes smaller than their successors directly; stage two scans the buckets of first symbols in
    order and puts each suffix's predecessor, if that is larger than it, next in the predecessor's bucket. A suffix is
    induced from its successor, so the needed ones are those wanted and their successors up to one sorted directly."""
    small = types(s)
    need = wanted.copy()
    frontier = np.flatnonzero(need & ~small) + 1
    while len(frontier):
        frontier = frontier[~need[frontier]]
        need[frontier] = True
        frontier = frontier[~small[frontier]] + 1
    left = _left(s)
    words = _words((s - (s > 0)).astype(np.uint8), big=True)
    short = np.flatnonzero(left < 8)           # bytes behind a string's end count as zeros
    over = (8 * (8 - left[short])).astype(np.uint64)
    words[short] = np.where(left[short] > 0, words[short] >> np.minimum(over, np.uint64(63)) << np.minimum(over, np.uint64(63)), np.uint64(0))
    direct = _sorted_directly(words, left, np.flatnonzero(need & small), length)
    direct = direct[np.argsort(s[direct], kind="stable")]
    bounds = np.searchsorted(s[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def induce(found: np.ndarray, symbol: int):
        """Put the larger predecessors into their buckets; return those of this bucket."""
        before = found[found > 0] - 1
        before = before[need[before] & ~small[before]]
        symbols = s[before]
        by = np.argsort(symbols, kind="stable")
        before, symbols = before[by], symbols[by]
        cuts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])) if len(before) else []
        same = before[:0]
        for lo, hi in zip(cuts, np.append(cuts[1:], len(before))):
            if symbols[lo] == symbol:
                same = before[lo:hi]
            else:
                waiting[symbols[lo]].append(before[lo:hi])
        return same

    for symbol in range(257):
        found = np.concatenate(waiting[symbol]) if waiting[symbol] else direct[:0]
        while len(found):                      # larger suffixes come first in a bucket; runs of one symbol induce each other
            out.append(found)
            found = induce(found, symbol)
        found = direct[bounds[symbol]:bounds[symbol + 1]]
        if len(found):
            out.append(found)
            induce(found, symbol)
    order = np.concatenate(out) if out else direct
    return order[wanted[order]]


def common_prefixes(s: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, up to ``length`` (which both must hold)."""
    lcp = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    words = _words((s - (s > 0)).astype(np.uint8), big=True)
    depth = 0
    while len(live) and depth < length:
        step = min(8, length - depth)
        shift = np.uint64(64 - 8 * step)
        a, b = (words[np.minimum(order[k] + depth, len(s) - 1)] >> shift for k in (live, live - 1))
        differ = a ^ b
        equal = differ == 0
        high = sum((differ[~equal] >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(step))     # equal leading bytes
        lcp[live[~equal]] = depth + high
        live = live[equal]
        depth += step
        lcp[live] = depth
    return lcp


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """Per context, the places of its windows that occur twice among all contexts."""
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    s = np.zeros(int((sizes + 1).sum()), np.int16)
    inside = np.ones(len(s), bool)
    inside[starts + sizes] = False
    s[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int16) + 1
    order = suffix_order(s, _left(s) >= length, length)
    twice = common_prefixes(s, order, length) >= length
    twice |= np.append(twice[1:], False)
    places = np.sort(order[twice])
    of = np.searchsorted(starts, places, "right") - 1
    cuts = np.searchsorted(of, np.arange(len(contexts) + 1))
    return [places[a:b] - x for a, b, x in zip(cuts, cuts[1:], starts)]


def _runs(places: np.ndarray):
    """(first, last) of the runs of consecutive places."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.append(cut, len(places) - 1)].tolist()) if len(places) else ()


_PLACE = "key long, tk long, first long, last long"


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, tk, first, last): runs of repeated windows of the texts in ``docs`` (key, tk, text), by their first bytes;
    (key, tk) names a text. Runs may overlap."""
    def mark(batches):
        for b in batches:
            data, offsets = _text_bytes(b.column("text"))
            row, first, count, h, c = text_anchors(data, offsets, length)
            key, tk = (b.column(x).to_numpy()[row] for x in ("key", "tk"))
            (h, c), places = _combined([h, c], [key, tk, first << 16 | count - 1])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), places], ["h", "c", "places"])

    marks = docs.where(F.octet_length("text") >= length).select("key", "tk", "text").mapInArrow(mark, "h long, c long, places binary")
    n = F.floor(F.octet_length("places") / 24)
    same, anchor = Window.partitionBy("h", "c"), Window.partitionBy("h")
    marks = (marks.withColumn("nth", F.row_number().over(same.orderBy("places"))).withColumn("copies", F.sum(n).over(same))
             .withColumn("total", F.sum(n).over(anchor)).withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(anchor))
             .where(F.col("total") > 1).select("h", "places", "copies", "kinds", (F.col("nth") == 1).alias("stands")))
    marks = materialize(marks, "suffix-marks")

    def spread(batches):
        """Places of contexts that occur twice; all their windows are repeated."""
        for b in batches:
            x = np.frombuffer(b"".join(b.column("places").to_pylist()), "<i8").reshape(-1, 3)
            first = x[:, 2] >> 16
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[:, 0], x[:, 1], first, first + (x[:, 2] & 65535))], ["key", "tk", "first", "last"])

    whole = marks.where(F.col("copies") > 1).select("places").mapInArrow(spread, _PLACE)

    def one(batches):
        for b in batches:
            x = np.array([np.frombuffer(p, "<i8", 3) for p in b.column("places").to_pylist()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2]), *(b.column(c) for c in ("h", "copies", "kinds"))],
                                             ["key", "tk", "at", "h", "copies", "kinds"])

    stand = marks.where(F.col("stands") & (F.col("kinds") > 1)).mapInArrow(one, "key long, tk long, at long, h long, copies long, kinds long")
    wanted = stand.groupBy("key", "tk").agg(F.collect_list(F.struct("at", "h", "copies", "kinds")).alias("wanted"))

    def cut(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            for key, tk, text, want in zip(*(b.column(c) for c in ("key", "tk", "text", "wanted"))):
                text = memoryview(text.as_buffer())
                for w in want.as_py():
                    first, count = w["at"] >> 16, (w["at"] & 65535) + 1
                    for c, v in zip(out, (w["h"], key.as_py(), tk.as_py(), first, w["copies"], w["kinds"], bytes(text[first:first + count - 1 + length]))):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())],
                                             ["h", "key", "tk", "first", "copies", "kinds", "context"])

    contexts = docs.select("key", "tk", "text").join(wanted, ["key", "tk"]).mapInArrow(
        cut, "h long, key long, tk long, first long, copies long, kinds long, context binary")
    volume = stand.agg(F.sum(F.col("at").bitwiseAND(F.lit(65535)) + length).alias("bytes"), F.max("kinds").alias("kinds")).first()
    shards = max(1, -(-(volume.bytes or 0) // SHARD))

    def sort(t: pa.Table) -> pa.Table:
        out = [], [], [], []
        keys = [t.column(c).to_pylist() for c in ("key", "tk", "first", "copies")]
        for key, tk, first, copies, places in zip(*keys, repeated_windows(t.column("context").to_pylist(), length)):
            if copies == 1:                    # else repeated whole, as known
                for a, z in _runs(places):
                    for c, v in zip(out, (key, tk, first + a, first + z)):
                        c.append(v)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["key", "tk", "first", "last"])

    if (volume.kinds or 0) > MOST:
        contexts = materialize(contexts, "suffix-contexts")
    few = contexts.where(F.col("kinds") <= MOST)
    found = few.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(int(shards)))).groupBy("shard").applyInArrow(sort, _PLACE)
    if (volume.kinds or 0) > MOST:
        found = found.unionByName(crowded(contexts.where(F.col("kinds") > MOST), length))
    return whole.unionByName(found)


def crowded(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of anchors with very many different contexts, by the windows' digests."""
    def windows(batches):
        for b in batches:
            place, digest = [], []
            for key, tk, first, text in zip(*(b.column(c).to_pylist() for c in ("key", "tk", "first", "context"))):
                for i in range(len(text) - length + 1):
                    place.append((key, tk, first + i))
                    digest.append(xxhash.xxh3_128_digest(text[i:i + length]))
            d = np.frombuffer(b"".join(digest), "<u8").reshape(-1, 2)
            p = np.array(place, np.int64).reshape(-1, 3)
            (a, z), places = _combined([d[:, 0], d[:, 1]], [p[:, 0], p[:, 1], p[:, 2]])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z), places], ["a", "z", "places"])

    def spread(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column("places").to_pylist()), "<i8").reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in (0, 1, 2, 2)], ["key", "tk", "first", "last"])

    total = F.sum(F.octet_length("places")).over(Window.partitionBy("a", "z"))
    return (contexts.mapInArrow(windows, "a long, z long, places binary").withColumn("total", total).where(F.col("total") > 24)
            .select("places").mapInArrow(spread, _PLACE))


def keyed(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, key, tk, text): rows with the name of their text."""
    return (df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .select("id", F.coalesce("id", F.lit(0)).alias("key"), F.xxhash64("text").alias("tk"), "text"))


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_bytes, spans ARRAY<STRUCT<first, stop>>, kept BINARY): each text's removed byte runs and what is left of it."""
    docs = keyed(df, id_col, text_col)
    runs = repeats(docs, length).groupBy("key", "tk").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    span = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))

    def clean(batches):
        for b in batches:
            size, spans, kept = [], [], []
            for text, found in zip(b.column("text"), b.column("runs")):
                data = text.as_buffer()
                data = data.to_pybytes() if data is not None else b""
                gone: list[list[int]] = []
                for x in sorted((r["first"], r["last"] + length) for r in found.as_py() or ()):
                    if gone and x[0] <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], x[1])
                    else:
                        gone.append(list(x))
                at, left = 0, []
                for a, z in gone:
                    left.append(data[at:a])
                    at = z
                size.append(len(data))
                spans.append([{"first": a, "stop": z} for a, z in gone])
                kept.append(b"".join(left) + data[at:])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                                             ["id", "n_bytes", "spans", "kept"])

    return (docs.join(runs, ["key", "tk"], "left").select("id", "text", "runs")
            .mapInArrow(clean, "id long, n_bytes long, spans array<struct<first:bigint,stop:bigint>>, kept binary"))


def removal_report(df: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): counts and digest of ``remove_repeats``."""
    return remove_repeats(df, length).select(F.col("id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                                             F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
