"""The dealt operators against brute force on small fixtures: nulls, empty and long
texts, ties, repeated rows, empty tables, clashing extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflow.llm import ann, chat, html, licenses, mixing, packing, quality, queries, simhash, tokencount, toxicity
from lexiflow.llm.common import read

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, target double, row string, rank long, label string"


def docs_of(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, None, 7, 7, 7.0, "x", 7, "y") for i, (t, s) in enumerate(zip(texts, sources))], DOCS)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(400)]
    out = [None, "", " \t\n ", "one", "two words", "Ünïcode ß ẞ 日本 \x00x", "under the MIT license", "x " * 30000]
    for _ in range(60):
        out.append(" ".join(rnd.choices(vocab, k=rnd.randint(1, 300))))
    for t in out[10:20]:
        w = t.split()
        out.append(t)
        out.append(" ".join(w[:-1] + ["zz"]))
    return out


def components(fps, ids, bits):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= bits:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_fingerprint_is_sparks_xxhash64(spark):
    import xxhash
    got = spark.range(1).select(F.xxhash64(F.lit("héllo wörld x")).alias("h")).first().h
    assert got & (2 ** 64 - 1) == xxhash.xxh64_intdigest("héllo wörld x".encode(), 42)


def test_simhash_components(spark, texts):
    got = {r.doc_id: r for r in simhash.simhash_components(docs_of(spark, texts)).collect()}
    assert len(got) == len(texts)
    fps = [simhash.fingerprint(t) for t in texts]
    want = components(fps, list(range(len(texts))), 3)
    for i, f in enumerate(fps):
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == want[i]
    assert got[0].component_id == got[2].component_id == 0
    kept = [r.doc_id for r in simhash.keep_one_per_component(docs_of(spark, texts)).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_simhash_tree_finds_all_links_over_many_leaves(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150, dtype=np.int64)
    rows = list(base)
    for x in base[:60]:
        y = int(x)
        for _ in range(4):                      # chains: each link flips three bits
            for b in rng.choice(63, 3, replace=False):
                y ^= 1 << int(b)
            rows.append(y)
    fps = sorted({int(x) for x in rows})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.fp: r.label for r in simhash.linked_components(df, 3, leaf=20).collect()}
    want = components(fps, fps, 3)
    size = Counter(want.values())
    assert set(got) == {f for f in fps if size[want[f]] > 1}
    groups = defaultdict(set)
    for f, lab in got.items():
        groups[lab].add(want[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == sum(n > 1 for n in size.values())


def test_quality_base_rules(spark, texts):
    rnd = ["a b c d e f g h a b c d e f g h", "l1 #\nl1 #\n\n \nl2 <|>"]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    all_texts = texts + rnd
    for r in quality.quality_report(docs_of(spark, all_texts), labels).collect():
        t = all_texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        if len(w) > 5000:
            continue
        grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        c = Counter(grams)
        cover = {i + j for i, g in enumerate(grams) if c[g] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == len(cover)
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and r.kept == (not r.base_failed)


def test_quality_trees_are_monotonic_and_accurate():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 9))
    y = ((x[:, 2] + 0.3 * x[:, 0] + 0.1 * rng.standard_normal(3000)) < 0.6).astype(float)
    m = quality.fit_trees(x[:2000], y[:2000])
    assert ((quality.score_trees(m, x[2000:]) > 0) == (y[2000:] > 0.5)).mean() > 0.85
    for f in np.nonzero(quality.MONOTONE)[0]:
        up = x[:300].copy()
        up[:, f] += 0.5
        assert (quality.score_trees(m, up) <= quality.score_trees(m, x[:300]) + 1e-9).all()


def test_toxicity_held_out(spark):
    d, lab = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fit_toxicity(d, lab.where("doc_id % 3 != 0"))
    rows = d.join(lab.where("doc_id % 3 = 0"), "doc_id").collect()
    hit = [(toxicity.severity(model, r.text)[1] >= toxicity.REJECT) == bool(r.toxic) for r in rows]
    assert np.mean(hit) > 0.95
    assert toxicity.toxicity_report(d.limit(0), lab).count() == 0
    none = toxicity.toxicity_report(docs_of(spark, [None, "", "x"]), lab.limit(0)).collect()
    assert [r.rejected for r in none] == [False] * 3


def test_packing(spark, texts):
    rows = packing.pack(docs_of(spark, texts)).collect()
    tok = packing._tokenizer(packing.default_tokenizer())
    want = {}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            p = ids[s:s + 2048]
            want[i, k] = (s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert len(seqs) <= -(-sum(v[1] for v in want.values()) // 2048) + 2
    assert packing.pack(docs_of(spark, texts).limit(0)).count() == 0


def test_mixing(spark, texts):
    src = [["a", "b", None, "c", "a"][i % 5] for i in range(len(texts))]
    rows = mixing.systematic_copies(docs_of(spark, texts, src)).collect()
    size = defaultdict(int)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.row.doc_id] or "")) and 0 <= r.copies <= 2
        size[r.row.source] += r.size
    target = {r.row.source: r.target for r in rows}
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert all(target[s] <= 2 * size[s] + 1e-9 for s in size)
    level = {s: target[s] / w for s, w in zip(["a", "b", "c", None], [5, 2, 1, 5]) if target[s] < 2 * size[s] - 1e-9}
    assert max(level.values()) - min(level.values()) < 1e-6
    mixed = mixing.mix(docs_of(spark, texts, src))
    assert mixed.columns == docs_of(spark, texts, src).columns
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(docs_of(spark, texts).limit(0)).count() == 0


def test_licenses_base(spark, texts):
    more = texts + ["Apache License, Version 2.0 under the MIT-License cc by-nc under the mit license", "mit license 日under the mit license"]
    for r in licenses.scan(docs_of(spark, more)).collect():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in more[r.doc_id] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(i, lab) for p, lab in licenses.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        assert r.n_words == len(w) and r.n_base == len(at)
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        base = {x[1] for x in at}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(",")) | (set() if base else {""})
        assert 0 <= r.score <= 1


def test_licenses_containment(spark):
    rows = licenses.scan(docs_of(spark, [
        "Licensed under the GNU Lesser General Public License version 2.1", "Creative Commons Attribution-NonCommercial license",
        "SPDX-License-Identifier: BSD-3-Clause", "nothing here"])).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["lgpl-2.1", "cc-by-nc", "bsd-3-clause", ""]


def test_chat(spark):
    bad = r"</s>[INST] ok [/INST] \ <s>" + "\n\\"
    rows = [(1, 1, "assistant", bad), (1, 0, "user", None), (1, 2, None, ""), (2, 0, "we\nird", bad), (3, 0, "assistant", "x" * 200000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digests(chat.format_records(chat.records_from_turns(df), "record", "conv_id")).collect()}
    for c in (1, 2, 3):
        turns = sorted((t, r or "", x or "") for i, t, r, x in rows if i == c)
        flat = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert out[c].n_turns == len(turns) and out[c].turns_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert out[c].loss_chars == len(loss) and out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.records_from_turns(df.limit(0)).count() == 0
    fp, turns = chat.canonical_turns({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]})
    assert turns == [("user", "a"), ("assistant", "b")]
    assert chat.canonical_turns({"instruction": "a", "output": "b"})[1] == [("user", "a"), ("assistant", "b")]
    assert chat.canonical_turns({"what": 1})[1] is None


def test_ann_recall_and_ties(spark):
    e = read(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding").collect()
    rows = [(r.vec_id, r.embedding) for r in e] + [(10000 + i, e[0].embedding) for i in range(60)]
    rows += [(-1, None), (-2, [0.0] * 64), (-3, [float("nan")] * 64), (-4, [None] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, np.array(v, np.float64)) for i, v in rows if i >= 0]
    hits = total = 0
    for q, x in good:
        if q % 20 == 0:
            want = sorted((-float(v @ x), i) for i, v in good if i != q)[:20]
            assert len(got[q]) == 20
            hits += len({i for _, i in want} & {i for i, _ in got[q]})
            total += 20
    assert hits / total >= 0.9
    assert [i for i, _ in got[0]] == [10000 + i for i in range(20)]
    few = ann.search(df.where("vec_id between 0 and 5"), df.where("vec_id = 0")).collect()
    assert len(few) == 5 and ann.search(df.limit(0), df.limit(0)).count() == 0


def test_html(spark):
    page = ("<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body><nav><ul><li><a>m{0}</a></ul></nav>"
            "<div class='ad'>buy</div><article><h1>T &amp; {0}</h1><p>a<b>b</b>\n c<br>d<p>same passage<div class='comments'><p>bad</p></div></article>"
            "<div class=x>same box</div><footer>&copy; f")
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(12)] + [(50, None, None), (51, "http://h.example/x", "<p>own text<div class=x>same box</div>"), (51, "u", "plain &lt;")]
    got = defaultdict(list)
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert all(got[i] == [f"T & {i} ab c d same passage"] for i in range(12))
    assert got[50] == [""] and sorted(got[51]) == ["own text", "plain <"]


def test_token_counts_after_edits(spark, texts):
    tok = packing._tokenizer(packing.default_tokenizer())

    def count(xs):
        return [len(e.ids) for e in tok.encode_batch(xs, add_special_tokens=False)]
    rnd = random.Random(2)
    for t in texts:
        doc, plain = tokencount.Counted(t or "", count), t or ""
        for _ in range(12):
            a = rnd.randint(0, len(plain) + 2)
            b = a + rnd.choice([0, 1, 5, 300])
            new = rnd.choice(["", " ", "word", "a b\nc", "x" * 700])
            doc.edit(a, b, new)
            plain = plain[:a] + new + plain[b:]
            assert doc.text() == plain
        assert doc.n_tokens == count([plain])[0]


def test_queries_read_whole_tables(spark):
    n = {t: read(spark, SF, t).count() for t in ("documents", "pages")}
    for name in ("op3_license_scan", "op5_mixing", "op6_token_counts", "op8_html_extraction", "op9_quality_rules"):
        assert queries.QUERIES[name](spark, SF).count() == n["pages" if name.startswith("op8") else "documents"]


def test_pipeline(spark):
    import corpus_pipeline
    d = read(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d.limit(0), SF).columns == d.columns
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0


def drawn_vectors(n):
    """``n`` distinct vectors drawn from the mean and covariance of each label of sf0.1; its own 2,000 for 2,000."""
    import pyarrow.parquet as pq
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x, label = np.array(t["embedding"].to_pylist()), np.array(t["label"])
    if n > len(x):
        rng = np.random.default_rng(0)
        x = np.vstack([rng.multivariate_normal(x[label == c].mean(0), np.cov(x[label == c].T), n // 10) for c in np.unique(label)])
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def recall_of(spark, tmp_path, n, queries):
    import pyarrow as pa
    import pyarrow.parquet as pq
    x = drawn_vectors(n)
    assert len(np.unique(x, axis=0)) == len(x) == n
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x)}), f"{tmp_path}/e.parquet", row_group_size=n // 8)
    e = spark.read.parquet(f"{tmp_path}/e.parquet")
    got = defaultdict(set)
    for r in ann.search(e, e.where(F.col("vec_id") % (n // queries) == 0)).collect():
        got[r.query_id].add(r.vec_id)
    x = x.astype(np.float64)
    hits = total = 0
    for q in range(0, n, n // queries):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(got[q]) == 20
        hits += len(got[q] & set(np.argpartition(-s, 20)[:20].tolist()))
        total += 20
    print(f"recall of {total // 20} queries on {n} vectors: {hits / total:.4f}")
    return hits / total


@pytest.mark.parametrize("n", [2000, 20000, 100000])
def test_ann_recall_holds_as_the_table_grows(spark, tmp_path, n):
    assert recall_of(spark, tmp_path, n, 250) >= 0.9


def test_ann_footrule_ranks_small_files_across_the_query(spark, tmp_path, monkeypatch):
    found, real = [], ann.measure
    monkeypatch.setattr(ann, "measure", lambda *a: found.append(real(*a)) or found[-1], raising=False)
    assert recall_of(spark, tmp_path, 20000, 50) >= 0.9
    assert found[0][0] < 0.8 * 20000 * ann.POSTED and 0 < found[0][1] < 0.5 * ann.REFERENCE      # files hold 106 postings in the mean
    monkeypatch.setattr(ann, "measure", lambda deep, near, worst: (20000 * ann.POSTED, worst))
    assert recall_of(spark, tmp_path, 20000, 50) == 1
    monkeypatch.setattr(ann, "measure", lambda deep, near, worst: (20000 * ann.POSTED, 0))
    assert recall_of(spark, tmp_path, 20000, 50) < 0.9
    print(found)


def test_html_main_part_is_where_the_text_is():
    body = "<div><p>The body of this page.</p></div>"
    for other in ("<aside><article><p>teaser</p></article></aside>", "<article class='comment'><p>a reader</p></article>", "<article> </article>",
                  "<nav><main>menu</main></nav>", "<div hidden><article>draft</article></div>"):
        assert html.main_text(body + other) == html.main_text(other + body) == "The body of this page."
    assert html.main_text("<article><p>main</p><article class='comment'><p>a reader</p></article></article><p>rest") == "main"
    assert html.main_text("<article class='related'>only this</article>") == "only this"
    box = "<article><div class=x>same box</div></article>"
    boxes = frozenset(s[0] for s in html.parse(box).subtrees)
    assert html.main_text(box + body, boxes) == "The body of this page."


def test_html_marks_are_whole_names_and_need_another_sign_in_the_article():
    for name in ("layout has-sidebar", "no-sidebar", "sidebar", "widget nav"):
        assert html.main_text(f"<div class='{name}'><article>the article</article></div>") == "the article"
    page = ("<article><div class='article-header'><h1>T</h1></div><div class=header><h2>U</h2></div><p class='related-work'>work</p>"
            "<p>a <span class='social'>social</span> b</p><section id='notice-of-appeal'>appeal</section><p class=notice>{}</p>{}</article>")
    long = " ".join(["real words"] * 20)
    away = ("<div class=ad>buy</div><div class='x share'>" + "<a href=/>share this</a> " * 20 + "</div><div class=comments><p>" + "bad " * 90
            + "</p></div><ul class=comments><li><article>bad</article></ul>")
    assert html.main_text(page.format(long, away)) == f"T U work a social b appeal {long}"
    assert html.main_text("<div class='big sidebar'>menu</div><span id=social>s</span><p>body") == "body"


def test_html_template_of_a_small_host(spark):
    page = "<div class=top>boilerplate</div><div class=b>body {}</div>"
    rows = [(i, f"http://h{n}.example/{i}", page.format(i)) for n in (2, 3, 9) for i in range(100 * n, 100 * n + n)]
    rows += [(1000 + i, f"http://big.example/{i}", f"<div>{'twice' if i < 9 else 'own'} {i // 9 if i < 9 else i}</div><div>always</div>") for i in range(19)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in (2, 3, 9):
        assert all(got[i] == ("boilerplate " if n < 3 else "") + f"body {i}" for i in range(100 * n, 100 * n + n))
    assert all(got[1000 + i] == ("twice 0" if i < 9 else f"own {i}") for i in range(19))


def test_readme_names_what_is_not_built():
    import pathlib
    import __spark_entry__
    table = [x for x in (pathlib.Path(__spark_entry__.__file__).parent / "README.md").read_text().splitlines() if x.startswith("| ")]
    for key, name in (("V05", "prepare_corpus"), ("S12", "persist_corpus")):
        assert name in __spark_entry__.queries() or any(x.startswith(f"| {key} | not built") for x in table)
