"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w . x - theta_k): one weight vector is shared by all ordered
thresholds. Features are hashed lower-case words, 1 + log(count). Grades: 0 for
documents labelled clean; labelled toxic ones are 1 or 2 by whether the number of
their distinct marker words (those that set the toxic sample apart) exceeds the median.
The model is fitted on a bounded sample of labelled documents (``SAMPLE``); only
marker words carry weight, so the length of a text adds no noise. Scoring reads every whole text.

Defined results: null or empty text has no features, and its severity is that of
the thresholds alone; without two label classes every severity is 0 and nothing is
rejected; repeated rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiflow.llm.common import bounded_sample

SAMPLE = 6000          # labelled documents the model is fitted on, at most
BITS = 20              # hashed feature space
MIN_Z, MIN_SEEN, MIN_RATIO = 3.0, 4, 4.0   # a word carries weight if it sets the toxic sample apart by so many
                       # deviations, in so many toxic documents, and is so many times as common there
GRADES = 3
STEPS, STEP, L2 = 1200, 0.1, 1e-4
REJECT = 0.5           # P(grade > 0), classes weighing alike, from which a document is rejected
_WORD = re.compile(r"\w+")


def word_ids(text: str | None):
    """(sorted feature ids, counts) of a whole text."""
    c: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        c[xxhash.xxh32_intdigest(w.encode("utf-8", "replace")) >> (32 - BITS)] += n
    ids = sorted(c)
    return ids, [c[i] for i in ids]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ordinal(docs, toxic: np.ndarray):
    """Model {ids, w, theta} from [(ids, counts)] and 0/1 labels, or None."""
    n, n1 = len(toxic), int(toxic.sum())
    if n1 == 0 or n1 == n:
        return None
    seen, seen1 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for (ids, _), y in zip(docs, toxic):
        seen[ids] += 1
        if y:
            seen1[ids] += 1
    p, q = (seen1 + 0.5) / (n1 + 1), (seen - seen1 + 0.5) / (n - n1 + 1)
    z = (p - q) / np.sqrt(np.maximum(1e-12, p * (1 - p) / n1 + q * (1 - q) / (n - n1)))
    chosen = np.nonzero((z >= MIN_Z) & (seen1 >= MIN_SEEN) & (p >= MIN_RATIO * q))[0]
    place = {int(f): k for k, f in enumerate(chosen)}
    row, col, val, marks = [], [], [], np.zeros(n)
    for i, (ids, counts) in enumerate(docs):
        for f, c in zip(ids, counts):
            k = place.get(f)
            if k is not None:
                row.append(i), col.append(k), val.append(1 + np.log(c))
                marks[i] += 1
    row, col, val = np.array(row, int), np.array(col, int), np.array(val, float)
    cut = np.median(marks[toxic == 1])
    grade = np.where(toxic == 1, 1 + (marks > cut), 0)
    above = np.stack([grade > k for k in range(GRADES - 1)], axis=1).astype(float)
    share = np.where(toxic == 1, 0.5 / n1, 0.5 / (n - n1))      # both classes weigh alike
    w, theta = np.zeros(len(chosen)), np.array([1.0, 2.0])
    m, v = np.zeros(len(w) + GRADES - 1), np.zeros(len(w) + GRADES - 1)
    for t in range(1, STEPS + 1):
        s = np.bincount(row, val * w[col], n) if len(row) else np.zeros(n)
        err = (_sigmoid(s[:, None] - theta) - above) * share[:, None]
        gw = np.bincount(col, val * err.sum(axis=1)[row], len(w)) if len(row) else np.zeros(len(w))
        g = np.concatenate([gw + L2 * w / len(theta), -err.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = STEP * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, theta = np.maximum(0.0, w - d[:len(w)]), np.sort(theta - d[len(w):])   # markers only ever add
    return {"w": {int(f): float(x) for f, x in zip(chosen, w)}, "theta": theta}


def severity(model, text):
    """(expected grade, P(grade > 0)) of one whole text."""
    if model is None:
        return 0.0, 0.0
    w = model["w"]
    ids, counts = word_ids(text)
    s = sum(w[f] * (1 + np.log(c)) for f, c in zip(ids, counts) if f in w)
    p = _sigmoid(s - model["theta"])
    return float(p.sum()), float(p[0])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    lab = bounded_sample(labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic"), "doc_id", sample)
    # the broadcast side has at most ``sample`` rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))), "doc_id")

    def run(batches):
        for b in batches:
            f = [word_ids(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in f], pa.list_(pa.int32())),
                                              pa.array([x[1] for x in f], pa.list_(pa.int32())), b.column("toxic").cast(pa.int32())],
                                             ["doc_id", "ids", "counts", "toxic"])

    # one row per labelled id, however often it is repeated: at most ``sample`` rows
    one = F.min(F.struct(F.xxhash64("ids", "counts").alias("h"), "ids", "counts", "toxic")).alias("r")
    got = rows.mapInArrow(run, "doc_id long, ids array<int>, counts array<int>, toxic int").groupBy("doc_id").agg(one).select("r.*").collect()
    got.sort(key=lambda r: (r.toxic, r.ids, r.counts))
    return fit_ordinal([(r.ids, r.counts) for r in got], np.array([r.toxic for r in got], int))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, p_toxic, rejected): one row per document."""
    model = fit_toxicity(docs, labels)

    def run(batches):
        for b in batches:
            s = [severity(model, t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in s], pa.float64()), pa.array([x[1] for x in s], pa.float64()),
                                              pa.array([x[1] >= REJECT for x in s], pa.bool_())], ["doc_id", "severity", "p_toxic", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, severity double, p_toxic double, rejected boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, all columns unchanged."""
    model = fit_toxicity(docs, labels)

    def run(batches):
        for b in batches:
            keep = [severity(model, t.as_py())[1] < REJECT for t in b.column("text")]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
