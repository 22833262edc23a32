"""Best-fit packing by length patterns and non-negative least squares.

Documents become token pieces (only those longer than a sequence are cut). The
histogram of piece lengths has at most ``capacity`` entries whatever the corpus, so
the plan is made from it alone: patterns of two to four lengths that fill a
sequence exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded down, and what remains is packed by best
fit, longest first, again as patterns with repeat counts. A piece finds its
place by its rank among the pieces of its length; ranks are prefix sums over salted
groups, so a common length is not ordered in one task.

Defined results: null text is empty; an empty document is one end token; repeated
rows are packed as separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import materialize

CAPACITY = 2048
CELL = 20000           # pieces of one length that are ranked in one task, about
TOP = 24               # commonest lengths from which patterns of three and four are formed
SWEEPS = 30


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


_TOKENIZERS: dict = {}


def _tokenizer(path):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


CACHE = 800_000        # tokenized chunks that a Python worker keeps at once; the rest are encoded anew
SLICE = 8 << 20        # bytes of text that are split into chunks at once


class _Chunks:
    """Token ids of the chunks met so far, one after the other. When there are too many, those met in one slice only
    are forgotten (and all, should that not be enough)."""

    def __init__(self):
        self._hold({}, np.zeros(0, "<u4"), *[np.zeros(0, np.int64)] * 3)

    def _hold(self, at, ids, first, size, met):
        self.at, self.ids, self.first, self.size, self.met = at, ids, first, size, met

    def _forget(self):
        keep = np.flatnonzero(self.met > 1)
        if len(keep) > CACHE // 2:
            return self.__init__()
        size = self.size[keep]
        first = np.cumsum(size) - size
        ids = self.ids[np.repeat(self.first[keep] - first, size) + np.arange(size.sum())]
        often = self.met > 1
        at = {w: i for i, w in enumerate(w for w, i in self.at.items() if often[i])}
        self._hold(at, ids, first, size, np.ones(len(keep), np.int64))

    def places(self, tokenizer, words: list) -> np.ndarray:
        """Place of each of the distinct ``words``; new ones are encoded."""
        if len(self.at) > CACHE:
            self._forget()
        new = [w for w in words if w not in self.at]
        if new:
            found = [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), "<u4", int(size.sum()))
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
            self._hold(self.at, *(np.concatenate(x) for x in ((self.ids, ids), (self.first, len(self.ids) + np.cumsum(size) - size),
                                                              (self.size, size), (self.met, np.zeros(len(new), np.int64)))))
        places = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        self.met[places] += 1
        return places


_CHUNKS: dict = {}


def encode_column(tokenizer, texts: pa.Array):
    """(token ids of all texts one after the other, offsets of the texts). The vocabulary drops white space, so a text's
    ids are those of its chunks between spaces and line feeds. The chunks of all texts are split and dictionary-encoded
    in Arrow, each distinct chunk is encoded once, and the ids are gathered by offsets."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
    chunks = pc.split_pattern(texts, " ")
    coded = chunks.flatten().dictionary_encode()
    known = _CHUNKS.setdefault(id(tokenizer), _Chunks())
    at = known.places(tokenizer, coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
    size = known.size[at]
    ends = np.concatenate([[0], np.cumsum(size)])
    ids = known.ids[np.repeat(known.first[at] - ends[:-1], size) + np.arange(ends[-1])]
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(chunks).to_numpy())])
    return ids, ends[bounds]


def encode_whole(tokenizer, texts: list) -> list:
    """Token ids of whole texts as little-endian bytes."""
    ids, ends = encode_column(tokenizer, pa.array(texts, pa.large_string()))
    return [ids[a:z].tobytes() for a, z in zip(ends, ends[1:])]


def _slices(batch: pa.RecordBatch):
    """Consecutive rows with about ``SLICE`` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(size // SLICE, prepend=0)) if len(size) else []
    at = 0
    for cut in [*(int(c) for c in cuts if c > 0), batch.num_rows]:
        if cut > at:
            yield batch.slice(at, cut - at)
            at = cut


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every whole text."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        t = _tokenizer(tokenizer_path)
        for b in batches:
            for part in _slices(b):
                out = [[] for _ in names]
                ids, ends = encode_column(t, part.column("text"))
                ids = memoryview(ids).cast("B")
                for doc_id, a, z in zip(part.column("doc_id").to_pylist(), (4 * ends).tolist(), (4 * ends[1:]).tolist()):
                    last = (z - a) // (4 * capacity)        # the piece that the end token is in
                    for i in range(last + 1):
                        p = ids[a + 4 * capacity * i:min(z, a + 4 * capacity * (i + 1))]
                        crc, n = zlib.crc32(p), len(p) // 4
                        if i == last:
                            crc, n = zlib.crc32(end, crc), n + 1
                        for c, v in zip(out, (doc_id, i, capacity * i, n, crc)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()),
                                                  *(pa.array(c, pa.int64()) for c in out[2:])], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def enumerate_patterns(hist: np.ndarray, capacity: int):
    """Tuples of two to four present lengths that sum to the capacity."""
    present = set(np.nonzero(hist)[0].tolist())
    top = sorted(sorted(present, key=lambda a: (-hist[a], a))[:TOP])
    found = {(capacity - a, a) for a in present if capacity - a in present and 2 * a <= capacity}
    for i, a in enumerate(top):
        for j, b in enumerate(top[i:], i):
            if capacity - a - b in present:
                found.add(tuple(sorted((a, b, capacity - a - b), reverse=True)))
            for c in top[j:]:
                if capacity - a - b - c in present:
                    found.add(tuple(sorted((a, b, c, capacity - a - b - c), reverse=True)))
    return sorted(found, reverse=True)


def nnls(patterns, hist: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|, by coordinate descent."""
    x, rest = np.zeros(len(patterns)), hist.astype(float).copy()
    cols = [np.unique(p, return_counts=True) for p in patterns]
    for _ in range(SWEEPS):
        moved = 0.0
        for k, (rows, mult) in enumerate(cols):
            step = max(-x[k], float(rest[rows] @ mult) / float(mult @ mult))
            x[k] += step
            rest[rows] -= step * mult
            moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan_packing(hist: np.ndarray, capacity: int):
    """[(pattern, repeats)] that uses up ``hist`` (count per length) exactly."""
    left, plan = hist.astype(np.int64).copy(), []

    def use(pattern, times):
        rows, mult = np.unique(pattern, return_counts=True)
        n = int(min(times, (left[rows] // mult).min()))
        if n > 0:
            left[rows] -= n * mult
            plan.append((pattern, n))

    use((capacity,), int(left[capacity]))
    patterns = enumerate_patterns(left, capacity)
    x = nnls(patterns, left)
    for k in np.argsort(-x, kind="stable"):
        use(patterns[k], int(x[k]))
    while left.any():
        present = np.nonzero(left)[0]
        room, pattern, used = capacity, [], {}
        i = len(present) - 1
        while i >= 0:
            a = int(present[i])
            n = min(room // a, int(left[a]))
            pattern += [a] * n
            room -= n * a
            i = min(i - 1, int(np.searchsorted(present, room, "right")) - 1)
        use(tuple(pattern), int(left.max()))
    return plan


def plan_slots(plan):
    """Arrays (key, first rank, first sequence, offset) sorted by key = length, first rank."""
    cursor, rows, seq = {}, [], 0
    for pattern, n in plan:
        offset = 0
        for a in pattern:
            first = cursor.get(a, 0)
            rows.append((a << 44 | first, first, seq, offset))
            cursor[a] = first + n
            offset += a
        seq += n
    rows.sort()
    return [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 4


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece."""
    pieces = token_pieces(docs, tokenizer_path or default_tokenizer(), capacity)
    pieces = materialize(pieces.withColumn("nr", F.monotonically_increasing_id()), "packing-pieces")
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():   # at most ``capacity`` rows
        hist[r["length"]] = r["count"]
    key, first, seq, offset = plan_slots(plan_packing(hist, capacity))
    # a common length is ranked in cells, which are as many as it has pieces; equal rows differ in their number
    salts = F.element_at(F.lit([int(n // CELL) + 1 for n in hist]), F.col("length").cast("int") + 1)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("nr"), salts))
    cells = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_start"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("nr"))
    ranked = (pieces.withColumn("nth", nth).join(starts, ["length", "salt"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("cell_start") + F.col("nth") - 1).alias("rank")))

    def place(batches):
        for b in batches:
            rank, length = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rank", "length"))
            k = np.searchsorted(key, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq[k] + rank - first[k]), pa.array(offset[k])],
                                             [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
