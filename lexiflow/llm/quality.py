"""Quality rules: base rules and gradient-boosted trees over document statistics.

Each document's statistics come from its whole text. The trees are fitted on a
bounded sample of labelled documents (``SAMPLE``), with monotonic constraints on
chosen statistics (more symbols, repeats or capitals never raise the score), and
flattened into numpy node arrays, so that a batch is scored by array steps.

Defined results: null text has no words and fails the base rules; without usable
labels (none, or of one class) the base rules alone decide; repeated rows get equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.common import bounded_sample

SAMPLE = 4000          # labelled documents the trees are fitted on, at most
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
TREES, DEPTH, RATE, BINS, MIN_LEAF = 40, 3, 0.3, 32, 10
GOOD_LOST = 0.002      # share of good sample documents below the threshold, at most
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
            "mark_share", "digit_share", "distinct_share"]
MONOTONE = np.array([0, 0, -1, -1, -1, -1, 0, 0, 0])


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words inside a window of ``window`` words that the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i:] for i in range(window))))
    count = Counter(grams)
    if len(count) == n:
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.array([i for i, g in enumerate(grams) if count[g] > 1])
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def statistics(text: str | None):
    """(base statistics, model features) of one whole text."""
    text = text or ""
    words = _WORD.findall(text)
    seen, dup, n_lines = set(), 0, 0
    for line in text.split("\n"):
        if _WORD.search(line):
            n_lines += 1
            dup += line in seen
            seen.add(line)
    chars = sum(map(len, words))
    base = [len(words), chars, len(_SYMBOL.findall(text)), dup, repeated_words(words)]
    b = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=128)
    n, c = max(1, len(words)), max(1, chars)
    return base, [np.log1p(len(words)), chars / n, base[2] / n, dup / max(1, n_lines), base[4] / n, b[65:91].sum() / c,
                  (b[33:48].sum() + b[58:65].sum()) / c, b[48:58].sum() / c, len(set(words)) / n]


def base_failed(base) -> bool:
    return base[0] < MIN_WORDS or 100 * base[4] > MAX_REPEAT_PERCENT * base[0]


def _best_split(bins, g, h, lo, hi):
    """(gain, feature, bin) of the best allowed split of one node's rows."""
    def value(gs, hs):
        return np.clip(-gs / (hs + 1.0), lo, hi)
    best = (1e-6, None, None)
    gt, ht, n = g.sum(), h.sum(), len(g)
    for f in range(bins.shape[1]):
        x = bins[:, f]
        gl, hl = np.cumsum(np.bincount(x, g, BINS))[:-1], np.cumsum(np.bincount(x, h, BINS))[:-1]
        nl = np.cumsum(np.bincount(x, minlength=BINS))[:-1]
        gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
        ok = (nl >= MIN_LEAF) & (n - nl >= MIN_LEAF)
        if MONOTONE[f]:
            ok &= MONOTONE[f] * (value(gt - gl, ht - hl) - value(gl, hl)) >= 0
        gain = np.where(ok, gain, 0)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, k)
    return best


def fit_trees(x: np.ndarray, y: np.ndarray):
    """Boosted trees as flat arrays (roots, feature, cut, left, right, value); feature -1 marks a leaf.
    Bounds passed down the branches keep the constrained features monotonic in every tree."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    nodes, roots, score = [], [], np.zeros(len(y))

    def grow(rows, g, h, depth, lo, hi):
        at = len(nodes)
        nodes.append(None)
        val = float(np.clip(-g[rows].sum() / (h[rows].sum() + 1.0), lo, hi))
        gain, f, k = _best_split(bins[rows], g[rows], h[rows], lo, hi) if depth else (0, None, None)
        if f is None:
            nodes[at] = (-1, 0.0, at, at, val * RATE)
            score[rows] += val * RATE
            return at
        go = bins[rows, f] <= k
        a, b = rows[go], rows[~go]
        va, vb = (float(np.clip(-g[r].sum() / (h[r].sum() + 1.0), lo, hi)) for r in (a, b))
        mid = (va + vb) / 2
        la, ha, lb, hb = lo, hi, lo, hi
        if MONOTONE[f] < 0:
            la, hb = mid, mid
        elif MONOTONE[f] > 0:
            ha, lb = mid, mid
        left = grow(a, g, h, depth - 1, la, ha)
        right = grow(b, g, h, depth - 1, lb, hb)
        nodes[at] = (f, float(cuts[f][k]), left, right, 0.0)
        return at

    every = np.arange(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(every, p - y, p * (1 - p), DEPTH, -np.inf, np.inf))
    f, c, a, b, v = (np.array(z) for z in zip(*nodes))
    return {"roots": np.array(roots), "feature": f, "cut": c, "left": a, "right": b, "value": v}


def score_trees(m, x: np.ndarray) -> np.ndarray:
    """Log-odds of good quality, all rows and trees at once."""
    at = np.tile(m["roots"], (len(x), 1))
    row = np.arange(len(x))[:, None]
    for _ in range(DEPTH):
        f = m["feature"][at]
        go = x[row, np.maximum(f, 0)] <= m["cut"][at]
        at = np.where(f < 0, at, np.where(go, m["left"][at], m["right"][at]))
    return m["value"][at].sum(axis=1)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Model from at most ``sample`` labelled documents, or None without two classes."""
    lab = bounded_sample(labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality"), "doc_id", sample)
    # the broadcast side has at most ``sample`` rows
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(lab.groupBy("doc_id").agg(F.min("quality").alias("quality"))), "doc_id"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([[float(v) for v in statistics(t.as_py())[1]] for t in b.column("text")], pa.list_(pa.float64())),
                 b.column("quality").cast(pa.float64())], ["doc_id", "x", "y"])

    # one row per labelled id, however often it is repeated: at most ``sample`` rows
    one = rows.mapInArrow(run, "doc_id long, x array<double>, y double").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r"))
    got = sorted((r.y, tuple(r.x)) for r in one.select("r.*").collect())
    if len({y for y, _ in got}) < 2:
        return None
    y, x = np.array([g[0] for g in got]), np.array([g[1] for g in got])
    m = fit_trees(x, y)
    s = score_trees(m, x)
    m["threshold"] = min(0.0, float(np.quantile(s[y == 1], GOOD_LOST)))
    return m


def _verdicts(batch, model):
    got = [statistics(t.as_py()) for t in batch.column("text")]
    base = np.array([g[0] for g in got], np.int64).reshape(-1, 5)
    failed = np.array([base_failed(g[0]) for g in got], bool)
    if model is None or not got:
        return base, failed, np.zeros(len(got)), ~failed
    s = score_trees(model, np.array([g[1] for g in got]))
    return base, failed, s, ~failed & (s >= model["threshold"])


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, base statistics, base_failed, kept, score): one row per document."""
    model = fit_quality(docs, labels)

    def run(batches):
        for b in batches:
            base, failed, s, kept = _verdicts(b, model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(base[:, i]) for i in range(5)), pa.array(failed),
                                              pa.array(kept), pa.array(s)], ["doc_id", *BASE, "base_failed", "kept", "score"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    model = fit_quality(docs, labels)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_verdicts(b, model)[3], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
