"""Merkle manifest against a plain Python tree."""

import hashlib
import zlib

import pytest

from lexiflow.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos string, digest string, size string, path string"


def H(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def build(leaves):
    """(top, siblings of each leaf level by level) of one tree."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k - k % 16
            paths[i].append(("".join(level[run:k]), "".join(level[k + 1:run + 16])))
            at[i] = k // 16
        level = [H(*level[i:i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def brute(rows):
    def leaf(r, text):
        return H(*map(enc, (r[0], r[3], r[2], r[4], text)))

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        rs = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((rs, *build([leaf(r, r[1]) for r in rs])))
    root, upper = build([t[1] for t in trees])
    out = []
    for (rs, top, paths), over in zip(trees, upper):
        for r, p in zip(rs, paths):
            path, own, h = p + over, leaf(r, r[1]), leaf(r, r[1])
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                h = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for a, b in path:
                h = H(a, h, b)
            out.append((r[0], own, top, root, H(*(a + b for a, b in path)), h, h == root))
    return out


def rows_of(n):
    clash = ("t", "p", "d", "s", "q")
    rows = [(i * 7 % n - 3, None if i % 11 == 0 else f"Text É {i} ABC" * (i % 4), None if i % 5 == 0 else "en",
             "hot" if i % 3 else (None if i % 2 else f"s{i % 40}"), None if i % 7 == 0 else i, *clash) for i in range(n)]
    same = (4, "Repeated", "en", "hot", 8, *clash)
    return rows + [same] * 40 + [(4, "Other", "en", "hot", 5, *clash), (None, "No id", None, "Ünï", None, *clash), (1, "", "x", "", 0, *clash)]


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("stride", [1, 2])
def test_audit_equals_a_plain_tree(spark, stride):
    rows = rows_of(700)
    got = merkle.audit(spark.createDataFrame(rows, DOCS).repartition(5), stride)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in got.collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_one_row_and_no_rows(spark):
    row = (5, None, None, None, None, "", "", "", "", "")
    got = merkle.audit(spark.createDataFrame([row], DOCS)).collect()
    assert [tuple(r) for r in got] == brute([row]) and got[0].root == got[0].leaf and got[0].verified
    empty = merkle.manifest_of(spark.createDataFrame([], DOCS))
    assert empty.root().count() == 0 and empty.proofs().count() == 0


def test_only_every_second_level_is_stored(spark):
    m = merkle.manifest_of(spark.createDataFrame(rows_of(700), DOCS))
    sizes = [df.count() for df in m.levels]
    assert sizes[0] == 743 and len(sizes) <= 3
    hot = m.leaves.groupBy("tree").count().orderBy("count", ascending=False).first()
    assert m.levels[1].where(f"tree = {hot['tree']}").count() == -(-hot["count"] // 256)
    p = m.proofs().where("source = 'hot'").first()
    assert len(p.path) == 3 + 2 and p.root == m.root().first().root
