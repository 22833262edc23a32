"""Layouts with wrong types, kept trees over several batches, repeated labelled rows, clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from lexiflow.llm import chat, packing, quality, simhash, tokencount, toxicity


@pytest.mark.parametrize("record", [
    {"instruction": 1, "output": "b"}, {"turns": [{"role": "user", "text": "a"}, 5]}, {"messages": [{"role": {}, "content": "x"}]},
    {"prompt": ["a"], "completion": "b"}, {"messages": [None]}, {"messages": "text"}, {"messages": [["a"]]}, {"question": True, "answer": "b"},
    {"messages": [{"role": "user", "content": ["a"]}]}, [], 3, None, "x", {}, {"turns": {}}])
def test_wrong_types_are_unknown_layouts(record):
    fp, turns = chat.canonical_turns(record)
    assert turns is None and len(fp) == 16


def layout_record(paths, mapping, turns):
    if isinstance(mapping, tuple):
        parts = any("content[]" in p for p in paths)
        return {mapping[0]: [{mapping[1]: r, mapping[2]: [{"type": "text", "text": t}] if parts else t} for r, t in turns] if len(paths) > 1 else []}
    return {f: t for (_, f), (_, t) in zip(mapping, turns)}


@pytest.mark.parametrize("paths", list(chat.LAYOUTS))
def test_every_layout_gives_its_turns(spark, paths):
    mapping = chat.LAYOUTS[paths]
    names = [r for r, _ in mapping] if isinstance(mapping, list) else ["user", "assistant"]
    for texts in (["a </s> b", "c\\d\n", "e"], [None, "x", None], ["", "", ""]):
        turns = list(zip(names, texts))
        record = layout_record(paths, mapping, turns)
        _, got = chat.canonical_turns(record)
        want = [] if len(paths) == 1 else [(r, t or "") for (r, t), f in zip(turns, [f for _, f in mapping] if isinstance(mapping, list) else names)
                                           if f != "input" or t]
        assert got == want and chat.read_turns(chat.format_turns(got)[0]) == want
    if "messages" in paths:
        assert chat.canonical_turns({"id": 7, "messages": [{"role": "user", "content": "x", "name": 5}]})[1] == [("user", "x")]


def test_one_bad_record_does_not_stop_the_others(spark):
    rows = [(1, json.dumps({"instruction": 1, "output": "b"})), (2, json.dumps({"messages": [{"role": "user", "content": "x"}]})), (3, "{"), (4, None)]
    got = {r.id: r.turns for r in chat.format_records(spark.createDataFrame(rows, "id long, record string"), "record", "id").collect()}
    assert got[1] is None and got[3] is None and got[4] is None and [tuple(t) for t in got[2]] == [("user", "x")]


def test_kept_trees_over_two_batches(spark):
    tok = packing._tokenizer(packing.default_tokenizer())
    texts = {1: "some words " * 400, 2: None, 3: "short", 4: "line\nbreaks " * 90}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    trees = tokencount.build_trees(docs)
    batches = [[(1, 0, 1000, 1010, "inserted text"), (1, 1, None, None, " at the end"), (2, 0, 0, 5, "now some"), (99, 0, 0, 0, "nobody"), (None, 0, 0, 0, "x")],
               [(1, 0, 5, None, None), (2, 0, None, 3, " more"), (3, 0, 0, 100, None), (4, 0, 17, 300, "z")]]
    plain = {k: v or "" for k, v in texts.items()}
    for batch in batches:
        trees = tokencount.edit_trees(trees, spark.createDataFrame(batch, "doc_id long, nr int, start long, stop long, text string"))
        for i, _, a, z, new in sorted((b for b in batch if b[0] in plain), key=lambda b: b[:2]):
            t = plain[i]
            a = len(t) if a is None else min(a, len(t))
            z = a if z is None else min(max(a, z), len(t))
            plain[i] = t[:a] + (new or "") + t[z:]
        got = {r.doc_id: r for r in trees.collect()}
        assert set(got) == set(plain)
        for i, t in plain.items():
            assert "".join(got[i].leaves) == t and got[i].n_chars == len(t)
            assert got[i].n_tokens == len(tok.encode(t, add_special_tokens=False).ids)
    assert 0 < got[1].reencoded_chars < 1500 and got[3].reencoded_chars <= 5
    none = spark.createDataFrame([], docs.schema)
    assert tokencount.edit_trees(tokencount.build_trees(none), spark.createDataFrame([], "doc_id long, nr int, start long, stop long, text string")).count() == 0


def test_edits_with_null_fields(spark):
    df = spark.createDataFrame([(1, "a b", [(None, None, "c"), None, (0, 1, None)])], "doc_id long, text string, edits array<struct<start:long,stop:long,text:string>>")
    r = tokencount.count_edited(df, "edits").first()
    assert r.n_chars == 3 and r.n_edits == 2


def test_repeated_labelled_rows_count_once(spark):
    docs = [(i, ("bad " if i % 2 else "good ") * 30 + str(i)) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, toxic int, quality int")
    once = spark.createDataFrame(docs, "doc_id long, text string")
    often = once.unionByName(spark.createDataFrame([docs[3]] * 500, once.schema))
    a, b = (toxicity.fit_toxicity(d, labels) for d in (once, often))
    assert a["w"] == b["w"] and (a["theta"] == b["theta"]).all()
    a, b = (quality.fit_quality(d, labels) for d in (once, often))
    assert all((a[k] == b[k]).all() if hasattr(a[k], "all") else a[k] == b[k] for k in a)


def test_kept_documents_have_their_columns(spark):
    rows = [(1, "a b c", 5, "k"), (2, "a b c", 6, "l"), (3, "other words here", 7, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _nth int, _keep string")
    got = simhash.keep_one_per_component(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
    assert simhash.keep_one_per_component(df.limit(0)).count() == 0
