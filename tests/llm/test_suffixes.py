"""Removal of repeated passages against a count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lexiflow.llm import suffixes as S

DOCS = "doc_id long, text string, key long, tk string, first int, runs string, h int, id int, kept string, spans int"


def windows(texts, length):
    return Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))


def brute(rows, length=200):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    count, out = windows([d for _, d in data], length), []
    for i, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if count[d[p:p + length]] > 1:
                gone[p:p + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(11)
    vocab = ["".join(rnd.choices("abcdefgé日\n", k=rnd.randint(1, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(rnd.choices(vocab, k=n))

    passages = [prose(k) for k in (12, 30, 40, 45, 60, 200)]
    texts = [None, "", "short", "x" * 199, "x" * 200, "y" * 200, "x " * 700, "ab" * 400 + prose(30), passages[3] * 3]
    for _ in range(50):
        t = prose(rnd.randint(1, 200))
        for p in rnd.sample(passages, rnd.randint(0, 3)):
            t = t[:rnd.randint(0, len(t))] + p[rnd.randint(0, 9):] + t[rnd.randint(0, len(t)):]
        texts.append(t)
    near = texts[20] + prose(60)
    texts += [near, near[:150] + "!" + near[151:], near, "z" + near, texts[30], texts[30]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "x " * 700), (7, prose(90)), (None, passages[4] + "q"), (None, prose(40) + passages[4])]
    return [(*r, 1, "t", 2, "r", 3, 4, "k", 5) for r in rows]


def report(spark, rows):
    return sorted((tuple(r) for r in S.removal_report(spark.createDataFrame(rows, DOCS).repartition(3)).collect()), key=str)


def test_report_equals_count_of_windows(spark):
    rows = corpus()
    got = report(spark, rows)
    assert got == brute(rows) and sum(r[2] > 0 for r in got) > 30


@pytest.mark.parametrize("name, value", [("MOST", 3), ("PIECE", 700), ("SHARD", 1000)])
def test_other_bounds_give_the_same(spark, monkeypatch, name, value):
    rows = corpus()
    monkeypatch.setattr(S, name, value)
    assert report(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert report(spark, []) == []
    assert report(spark, [(1, None, *corpus()[0][2:])]) == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_two_stages_order_suffixes():
    rnd = random.Random(2)
    for _ in range(60):
        letters = rnd.choice([b"ab", b"\x00\xff", bytes(range(256))])
        strings = [bytes(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(rnd.randint(1, 9))] + [b"a" * 50]
        s = np.concatenate([np.append(np.frombuffer(x, np.uint8).astype(np.int16) + 1, 0) for x in strings]).astype(np.int16)
        order = S.suffix_order(s, s > 0, 20)
        text = b"".join(x + b"\n" for x in strings)
        ends = np.flatnonzero(s == 0)
        key = [text[i:min(i + 20, ends[np.searchsorted(ends, i)])].ljust(20, b"\0") for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(s > 0).tolist() and key == sorted(key)
        lcp = S.common_prefixes(s, order, 20)
        same = [next((j for j in range(20) if a[j] != b[j]), 20) for a, b in zip(key, key[1:])]
        full = S._left(s)[order] >= 20
        assert all(x == y for x, y, f, g in zip(lcp[1:].tolist(), same, full[1:], full) if f and g)
        got = [r.tolist() for r in S.repeated_windows(strings, 7)]
        count = windows(strings, 7)
        assert got == [[i for i in range(len(x) - 6) if count[x[i:i + 7]] > 1] for x in strings]


def test_only_suffixes_smaller_than_their_successors_are_sorted(monkeypatch):
    seen, real = [], S._sorted_directly
    monkeypatch.setattr(S, "_sorted_directly", lambda w, left, at, n: seen.append(at) or real(w, left, at, n))
    s = np.append(np.frombuffer(b"mississippi banana", np.uint8).astype(np.int16) + 1, 0).astype(np.int16)
    S.suffix_order(s, s > 0, 18)
    small = S.types(s)
    assert small[seen[0]].all() and 0 < len(seen[0]) < (s > 0).sum()
