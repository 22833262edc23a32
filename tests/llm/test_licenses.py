"""License rules: the notices that are met in the wild, and suppression against a plain scan of all rules."""

import random
import re

import pytest

from lexiflow.llm import licenses

CASES = {
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or": "gpl-2",
    "GNU General Public License, version 2": "gpl-2", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": "gpl-3",
    "the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License": "lgpl-2.1",
    "GNU Affero General Public License v3": "agpl-3", "Apache License 2.0": "apache-2", "Apache License, Version 2.0": "apache-2",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2", "Mozilla Public License Version 2.0": "mpl-2",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2", "Eclipse Public License - v 2.0": "epl-2",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "we talked about the general public and a license": "", "the apache tribe, version 2": "", "": "",
}


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text):
    """Labels by every rule at every word, then suppression over the whole text."""
    words = words_of(text)
    norm, starts = " " + " ".join(words) + " ", {}
    at = 0
    for i, w in enumerate(words):
        starts[at + 1] = i
        at += len(w) + 1
    found = []
    for _, label, priority, relevance, regex in licenses.rules():
        for m in re.finditer(rf"(?<= )(?=({regex}) )", norm):
            found.append((starts[m.start()], -(starts[m.start()] + len(m[1].split())), priority, label, relevance))
    ends, labels, score = {1: -1, 2: -1, 3: -1}, set(), 0.0
    for start, last, priority, label, relevance in sorted(found):
        inside = any(ends[p] >= -last for p in range(1, priority + 1))
        ends[priority] = max(ends[priority], -last)
        if not inside:
            labels.add(label)
            score = max(score, relevance)
    return labels, score


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(df).collect()}


def test_notices_titles_and_openings(spark):
    got = scan(spark, list(CASES))
    assert {t: got[i].labels for i, t in enumerate(CASES)} == CASES


def test_labels_equal_a_plain_scan_of_all_rules(spark):
    rnd = random.Random(9)
    bits = [*CASES, "under the MIT license", "licensed under the terms of the", "or", "the license", "released under", "cc by nc sa 4 0", "word", "GPL v2", "license GPL 3", "all rights reserved"]
    texts = [" ".join(rnd.sample(bits, rnd.randint(1, 6))) for _ in range(150)] + list(CASES)
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        labels, score = plain(t)
        base = set(got[i].base_labels.split(",")) - {""}
        assert set(got[i].labels.split(",")) - {""} == labels | base, t
        if not base:
            assert got[i].score == pytest.approx(score)


def test_suppression_by_priority(spark):
    got = scan(spark, ["licensed under the GNU General Public License version 2 license", "license GPL 2 license", "the MIT license MIT"])
    assert [got[i].labels for i in range(3)] == ["gpl-2", "gpl-2", "mit"]


def test_no_texts(spark):
    assert scan(spark, []) == {}
