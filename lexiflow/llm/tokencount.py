"""Edit-aware token counts.

A document is kept as segments of whole pre-tokens (runs between spaces and line
feeds) under two sum trees, of code points and of tokens. An edit re-encodes only the
segments it touches, with the next segment as context where the edit removes the
separator between them, and updates the sums on the path to the root.

Edits are (start, stop, text) in code points of the text as it then stands, applied in
order; positions beyond the text are moved to its end.

``build_trees`` gives the leaves as a table to keep; ``edit_trees`` takes that table and a batch of edits, and gives the
table after them. ``count_edited`` does both for edits that come with their documents.

Defined results: null text is empty and counts 0; null edits are none; repeated rows
are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.packing import CACHE, _tokenizer, default_tokenizer

SEGMENT = 256          # code points of a segment, at least
_CUT = re.compile(r".{%d,}?(?:[ \n]|\Z)" % SEGMENT, re.S)


def segments(text: str) -> list:
    """Pieces of the text, each ending at a separator or at the end."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        out.append(m[0])
        at = m.end()
    if at < len(text) or not out:
        out.append(text[at:])
    return out


class Counted:
    """A text with its token count; ``encoded`` is the number of code points encoded so far."""

    def __init__(self, text: str, count):
        leaves = segments(text)
        self._fill(leaves, count(leaves), count)
        self.encoded = len(text)

    def _fill(self, leaves, tokens, count):
        self._count, self.leaf, self.encoded, self.size = count, leaves, 0, 1
        while self.size < len(self.leaf):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, n in enumerate(tokens):
            self.chars[self.size + i], self.tokens[self.size + i] = len(self.leaf[i]), n
        for i in range(self.size - 1, 0, -1):
            self._pull(i)

    def kept(self):
        """(segments, their token counts) that are not empty."""
        held = [(x, n) for x, n in zip(self.leaf, self.tokens[self.size:]) if x]
        return [x for x, _ in held], [n for _, n in held]

    def _pull(self, i):
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(self.leaf)

    def _find(self, at: int):
        """(leaf that holds position ``at``, its first position); the last filled leaf for the end."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _set(self, leaf: int, text: str, tokens: int):
        self.leaf[leaf] = text
        i = self.size + leaf
        self.chars[i], self.tokens[i] = len(text), tokens
        while i > 1:
            i //= 2
            self._pull(i)

    @classmethod
    def stored(cls, leaves: list, tokens: list, count):
        """A document from its kept segments, without encoding anything."""
        doc = cls.__new__(cls)
        doc._fill(leaves or [""], tokens or [0], count)
        return doc

    def edit(self, start: int | None, stop: int | None, new: str | None):
        """Replace start..stop; a null start is the text's end, a null stop the start, a null text empty."""
        start = self.chars[1] if start is None else min(max(0, start), self.chars[1])
        stop = start if stop is None else min(max(start, stop), self.chars[1])
        new = new or ""
        first, at = self._find(start)
        last, merged, n = first, self.leaf[first], len(self.leaf)
        while at + len(merged) < stop:
            last += 1
            merged += self.leaf[last]
        merged = merged[:start - at] + new + merged[stop - at:]
        while last + 1 < n and not merged.endswith((" ", "\n")):
            last += 1
            merged += self.leaf[last]
        for i in range(first + 1, last + 1):
            if self.leaf[i]:
                self._set(i, "", 0)
        self.encoded += len(merged)
        self._set(first, merged, self._count([merged])[0])


def count_edited(docs: DataFrame, edits_col: str, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens_before, n_tokens, n_chars, n_edits, reencoded_chars) of every row;
    ``edits_col`` is ARRAY<STRUCT<start, stop, text>>."""
    path = tokenizer_path or default_tokenizer()
    names = ["doc_id", "n_tokens_before", "n_tokens", "n_chars", "n_edits", "reencoded_chars"]

    def run(batches):
        count = _counter(path)
        for b in batches:
            out = [[] for _ in names]
            for doc_id, text, edits in zip(b.column("doc_id"), b.column("text"), b.column("edits")):
                doc = Counted(text.as_py() or "", count)
                before, whole = doc.n_tokens, doc.encoded
                edits = [e for e in edits.as_py() or () if e is not None]
                for e in edits:
                    doc.edit(e["start"], e["stop"], e["text"])
                for c, x in zip(out, (doc_id.as_py(), before, doc.n_tokens, doc.chars[1], len(edits), doc.encoded - whole)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(edits_col).alias("edits"))
            .mapInArrow(run, ", ".join(f"{c} long" for c in names)))


_TREES = "doc_id long, leaves array<string>, tokens array<int>, n_tokens long, n_chars long, reencoded_chars long"
_KINDS = pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()


def _tree_rows(docs) -> pa.RecordBatch:
    rows = [(i, *d.kept(), d.n_tokens, d.chars[1], d.encoded) for i, d in docs]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], [c.split()[0] for c in _TREES.split(", ")])


_SIZES: dict = {}      # token counts of the chunks met so far


def _counter(path):
    """Token counts of a few texts at a time; equal chunks between spaces and line feeds are encoded once."""
    t = _tokenizer(path)

    def count(texts):
        chunks = [x.replace("\n", " ").split(" ") for x in texts]
        if len(_SIZES) > CACHE:
            _SIZES.clear()
        new = [c for c in {c for cs in chunks for c in cs} if c not in _SIZES]
        for c, e in zip(new, t.encode_batch_fast(new, add_special_tokens=False)):
            _SIZES[c] = len(e.ids)
        return [sum([_SIZES[c] for c in cs]) for cs in chunks]

    return count


def build_trees(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The leaves of every document's trees, to be kept as a table: (doc_id, leaves, tokens, n_tokens, n_chars, reencoded_chars)."""
    path = tokenizer_path or default_tokenizer()

    def run(batches):
        count = _counter(path)
        for b in batches:
            yield _tree_rows((i.as_py(), Counted(t.as_py() or "", count)) for i, t in zip(b.column("doc_id"), b.column("text")))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _TREES)


def edit_trees(trees: DataFrame, edits: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """The kept trees after a batch of ``edits`` (doc_id, nr, start, stop, text), applied by ``nr``: only segments that an
    edit touches are encoded again, which ``reencoded_chars`` counts; documents without edits pass as they are. Edits of
    unknown documents change nothing."""
    path = tokenizer_path or default_tokenizer()
    by_doc = edits.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_doc")).agg(
        F.array_sort(F.collect_list(F.struct("nr", "start", "stop", "text"))).alias("edits"))

    def run(batches):
        count = _counter(path)
        for b in batches:
            docs = []
            for i, leaves, tokens, change in zip(*(b.column(c).to_pylist() for c in ("doc_id", "leaves", "tokens", "edits"))):
                doc = Counted.stored(leaves, tokens, count)
                for e in change or ():
                    doc.edit(e["start"], e["stop"], e["text"])
                docs.append((i, doc))
            yield _tree_rows(docs)

    return (trees.join(by_doc, trees["doc_id"] == by_doc["_doc"], "left").select("doc_id", "leaves", "tokens", "edits").mapInArrow(run, _TREES))
