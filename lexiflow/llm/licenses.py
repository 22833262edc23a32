"""License scans by ordered signature rules (DataFrame functions only).

A text becomes its words between single spaces. Three stages, each on what the one
before lets through: anchor words that every rule needs, a keyword per license
family, and the family's regexes. A detection is an interval of words with a label
and a priority; one that lies inside another of equal or better priority is
suppressed. Base phrases are counted apart and always keep their labels.

Standard notices, titles and openings of license texts have rules of their own; the
others are built from families (label, keyword, name regex) and templates (priority,
relevance, regex around the name). A match consists of rule words only
(words that occur in some rule), so one pass cuts a text at all other words, and the
rules run on the few runs of rule words that hold an anchor and a keyword. Intervals
that contain one another lie in one run, so suppression within runs is complete.

Defined results: null text is empty (no words, no label, score 0); repeated rows
get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: (label, keyword, regex of the name in normalised words)
FAMILIES = [
    ("mit", "mit", r"mit(?: x11)?"),
    ("mit", "expat", r"expat(?: x11)?"),
    ("apache-2", "apache", r"apache(?: software)?(?: license)?(?: version)?(?: v)? ?2(?: 0)?"),
    ("apache-1", "apache", r"apache(?: software)?(?: license)?(?: version)? 1(?: [01])?"),
    ("gpl-2", "gnu", r"gnu (?:gpl|general public license)(?: gpl)?(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "gnu", r"gnu (?:gpl|general public license)(?: gpl)?(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.1", "gnu", r"gnu (?:lgpl|(?:lesser|library) general public license)(?: version| v)? ?2(?: [01])?"),
    ("lgpl-3", "gnu", r"gnu (?:lgpl|lesser general public license)(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "gnu", r"gnu (?:agpl|affero general public license)(?: version| v)? ?3(?: 0)?"),
    ("gfdl", "gnu", r"gnu free documentation license"),
    ("gpl-2", "gpl", r"gpl(?: version)? ?v?2(?: 0)?"),
    ("gpl-3", "gpl", r"gpl(?: version)? ?v?3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"lgpl(?: version)? ?v?2(?: [01])?"),
    ("lgpl-3", "lgpl", r"lgpl(?: version)? ?v?3(?: 0)?"),
    ("agpl-3", "agpl", r"agpl(?: version)? ?v?3(?: 0)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? 1(?: [01])?"),
    ("mpl-2", "mozilla", r"mozilla public license(?: version)? 2(?: 0)?"),
    ("mpl-2", "mpl", r"mpl(?: version)? ?v?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public license(?: version| v)? 1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public license(?: version| v)? 2(?: 0)?"),
    ("cddl-1", "cddl", r"(?:common development and distribution license )?cddl(?: version)?(?: 1(?: [01])?)?"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: version)?(?: 1 2)?"),
    ("artistic-2", "artistic", r"artistic license(?: version)? 2(?: 0)?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost-1", "boost", r"boost software license(?: version)?(?: 1 0)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2", "python", r"python software foundation(?: license)?(?: version)?(?: 2)?"),
    ("python-2", "psf", r"psf(?: license)?(?: version)?(?: 2)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl"),
    ("php-3", "php", r"php license(?: version)?(?: 3(?: 01)?)?"),
    ("ofl-1.1", "sil", r"sil open font license(?: version)?(?: 1 1)?"),
    ("odbl", "database", r"open database license"),
    ("cc0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?"),
    ("cc-by", "creative", r"creative commons attribution(?: (?:[1-4] [05]))?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:atives|s)"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:atives|s)"),
]
#: (priority, relevance, regex around {n})
TEMPLATES = [
    (1, 1.0, r"spdx license identifier {n}"),
    (1, 1.0, r"licen[cs]ed under (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?"),
    (1, 0.95, r"(?:released|distributed|available|published|made available) under (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?"),
    (2, 0.9, r"(?:subject to|governed by|pursuant to) (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?"),
    (2, 0.85, r"under (?:the )?(?:terms of )?(?:the )?{n} licen[cs]e"),
    (3, 0.8, r"(?:the )?{n} licen[cs]e"),
    (3, 0.7, r"licen[cs]e {n}"),
]
#: Rules outside the families: (label, keyword, priority, relevance, regex)
EXTRA = [
    ("mit", "permission", 1, 1.0, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution", 1, 0.95, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc", "permission", 1, 0.95, r"permission to use copy modify and or distribute this software for any purpose"),
    ("public-domain", "domain", 2, 0.8, r"(?:released|dedicated|placed)(?: in)?(?: to)? the public domain"),
    ("proprietary", "reserved", 3, 0.4, r"all rights reserved"),
    ("cc-by-nc-sa", "cc", 3, 0.85, r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc", 3, 0.85, r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", 3, 0.8, r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", 3, 0.85, r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", 3, 0.85, r"cc by nd(?: [1-4] [05])?"),
    ("cc-by", "cc", 3, 0.7, r"cc by(?: [1-4] [05])?"),
    # standard notices
    ("gpl-2", "gnu", 1, 1.0, r"gnu general public license as published by the free software foundation either version 2(?: of the license)?"),
    ("gpl-3", "gnu", 1, 1.0, r"gnu general public license as published by the free software foundation either version 3(?: of the license)?"),
    ("gpl-2", "gnu", 1, 1.0, r"gnu general public license version 2(?: only)? as published by the free software foundation"),
    ("gpl-3", "gnu", 1, 1.0, r"gnu general public license version 3(?: only)? as published by the free software foundation"),
    ("lgpl-2.1", "gnu", 1, 1.0, r"gnu (?:lesser|library) general public license as published by the free software foundation either version 2(?: 1)?(?: of the license)?"),
    ("lgpl-3", "gnu", 1, 1.0, r"gnu lesser general public license as published by the free software foundation either version 3(?: of the license)?"),
    ("agpl-3", "gnu", 1, 1.0, r"gnu affero general public license as published by the free software foundation either version 3(?: of the license)?"),
    ("gfdl", "gnu", 1, 0.95, r"copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "mozilla", 1, 1.0, r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-1.1", "mozilla", 1, 1.0, r"subject to the mozilla public license version 1 1"),
    ("apache-2", "apache", 1, 0.95, r"www apache org licenses license 2 0"),
    ("epl-2", "eclipse", 1, 0.95, r"made available under the terms of the eclipse public license 2 0"),
    ("boost-1", "boost", 1, 0.95, r"distributed under the boost software license version 1 0"),
    # titles of license texts
    ("gpl-2", "gnu", 3, 0.75, r"gnu general public license(?: version| v)? ?2(?: 0)?"),
    ("gpl-3", "gnu", 3, 0.75, r"gnu general public license(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.1", "gnu", 3, 0.75, r"gnu (?:lesser|library) general public license(?: version| v)? ?2(?: [01])?"),
    ("lgpl-3", "gnu", 3, 0.75, r"gnu lesser general public license(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "gnu", 3, 0.75, r"gnu affero general public license(?: version| v)? ?3(?: 0)?"),
    ("apache-2", "apache", 3, 0.75, r"apache(?: software)? license(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", 3, 0.75, r"mozilla public license(?: version| v)? ?1 [01]"),
    ("mpl-2", "mozilla", 3, 0.75, r"mozilla public license(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", 3, 0.75, r"eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "eclipse", 3, 0.75, r"eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("boost-1", "boost", 3, 0.75, r"boost software license(?: version)? 1 0"),
    ("eupl-1.2", "european", 3, 0.75, r"european union public licen[cs]e(?: version| v)? ?1 2"),
    ("artistic-2", "artistic", 3, 0.75, r"the artistic license(?: version)? 2 0"),
    # openings of license texts
    ("bsd-3-clause", "neither", 2, 0.95, r"neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("unlicense", "unencumbered", 1, 1.0, r"this is free and unencumbered software released into the public domain"),
    ("zlib", "altered", 2, 0.9, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("ofl-1.1", "font", 2, 0.9, r"this font software is licensed under the sil open font license version 1 1"),
]
ANCHORS = ["licen", "permi", "redistribution", " neither ", " unencumbered ", " misrepresented ", " spdx ", " under ", " cc ", " domain ", " reserved ", " subject to ", " governed by ", " pursuant to "]


def rules():
    """(keyword, label, priority, relevance, regex) in order."""
    out = [(k, label, p, w, r) for label, k, p, w, r in EXTRA]
    for label, k, name in FAMILIES:
        out += [(k, label, p, w, t.format(n=name)) for p, w, t in TEMPLATES]
    return out


def phrases(regex: str) -> set:
    """All strings that a rule's regex (literals, [classes], (?:a|b) and ?) matches."""
    at = 0

    def either():
        nonlocal at
        out = sequence()
        while regex[at:at + 1] == "|":
            at += 1
            out = out | sequence()
        return out

    def sequence():
        nonlocal at
        out = {""}
        while at < len(regex) and regex[at] not in "|)":
            if regex.startswith("(?:", at):
                at += 3
                one = either()
                at += 1
            elif regex[at] == "[":
                end = regex.index("]", at)
                c = regex[at + 1:end]
                one = {chr(x) for x in range(ord(c[0]), ord(c[2]) + 1)} if c[1:2] == "-" else set(c)
                at = end + 1
            else:
                one = {regex[at]}
                at += 1
            if regex[at:at + 1] == "?":
                one = one | {""}
                at += 1
            out = {a + b for a in out for b in one}
        return out

    return either()


def rule_words() -> list:
    """Every word that a match of some rule can hold."""
    regexes = [r for *_, r in EXTRA] + [n for _, _, n in FAMILIES] + [t.format(n="") for *_, t in TEMPLATES]
    return sorted({w for r in regexes for p in phrases(r) for w in p.split()})


def normalised(text: Column) -> Column:
    """Words (ASCII letters lower, digits, everything beyond ASCII) between single spaces."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def spaces(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


MARK, STOP = "\x01", "\x02"     # never in normalised words


def _detections(norm: Column, rule: Column) -> Column:
    """Intervals [start, end) of words that match one rule, at every start."""
    marked = F.regexp_replace(norm, F.concat(F.lit("(?<= )(?=("), rule["pattern"], F.lit(") )")), F.lit(f"{MARK}$1{STOP}"))
    pieces = F.split(marked, MARK)
    head = F.element_at(pieces, 1)
    init = F.struct(spaces(head).cast("long").alias("at"),
                    F.array().cast("array<struct<start:bigint,last:bigint,priority:int,label:string,relevance:double>>").alias("found"))

    def step(acc, piece):
        hit, rest = F.substring_index(piece, STOP, 1), F.substring_index(piece, STOP, -1)
        start = acc["at"] - 1
        one = F.struct(start.alias("start"), (-(start + spaces(hit) + 1)).alias("last"), rule["priority"].alias("priority"),
                       rule["label"].alias("label"), rule["relevance"].alias("relevance"))
        return F.struct((acc["at"] + spaces(rest)).alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    found = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), init, step, lambda a: a["found"])
    return F.when(F.regexp_like(norm, F.concat(F.lit(" "), rule["pattern"], F.lit(" "))), found).otherwise(
        F.array().cast("array<struct<start:bigint,last:bigint,priority:int,label:string,relevance:double>>"))


def _resolve(found: Column) -> Column:
    """Fold detections sorted by (start, longest first, priority): (labels, score) of those not
    inside an earlier one of equal or better priority."""
    zero = F.struct(*[F.lit(-1).cast("long").alias(f"end{p}") for p in (1, 2, 3)],
                    F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc, d):
        end = -d["last"]
        inside = ((acc["end1"] >= end) | ((d["priority"] >= 2) & (acc["end2"] >= end)) | ((d["priority"] >= 3) & (acc["end3"] >= end)))
        ends = [F.when(d["priority"] == p, F.greatest(acc[f"end{p}"], end)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in (1, 2, 3)]
        return F.struct(*ends, F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
                        F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], d["relevance"])).alias("score"))

    return F.aggregate(F.array_sort(found), zero, step, lambda a: F.struct(a["labels"].alias("labels"), a["score"].alias("score")))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    every = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(label).alias("label"), F.lit(p).alias("priority"),
                               F.lit(w).alias("relevance"), F.lit(r).alias("pattern")) for k, label, p, w, r in rules()])
    base_re = "(?<= )(?=(?:" + "|".join(p for p, _ in BASE) + ") )"
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    d = d.withColumn("n_words", (spaces(F.col("norm")) - 1).cast("long"))
    norm = F.col("norm")
    anchors, keywords = (F.lit("|".join(x)) for x in (ANCHORS, sorted({k for k, *_ in rules()})))
    other = " (?!(?:" + "|".join(rule_words()) + ") )[^ ]++(?= )"      # one word at a time: a repeated group would use the stack
    runs = F.transform(F.split(F.regexp_replace(norm, other, MARK), f"{MARK}+"), lambda x: F.concat(x, F.lit(" ")))
    d = d.withColumn("runs", F.when(F.regexp_like(norm, anchors) & F.regexp_like(norm, keywords),
                                    F.filter(runs, lambda x: F.regexp_like(x, anchors) & F.regexp_like(x, keywords)))
                     .otherwise(F.array().cast("array<string>")))

    def scan_run(run):
        chosen = F.filter(every, lambda r: F.contains(run, r["keyword"]))
        return _resolve(F.flatten(F.transform(chosen, lambda r: _detections(run, r))))

    d = d.withColumn("results", F.transform(F.array_distinct("runs"), scan_run))
    d = d.withColumn("method", F.struct(F.array_distinct(F.flatten("results.labels")).alias("labels"),
                                        F.coalesce(F.array_max("results.score"), F.lit(0.0)).alias("score")))
    d = d.withColumn("marked", F.when(F.regexp_like(norm, F.lit("(?: " + "| ".join(p for p, _ in BASE) + ") ")),
                                      F.regexp_replace(norm, base_re, MARK)))
    d = d.withColumn("n_base", F.coalesce(F.length("marked") - F.length(F.replace("marked", F.lit(MARK), F.lit(""))), F.lit(0)).cast("long"))
    base = F.filter(F.array(*[F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE]), lambda x: x.isNotNull())
    hit = F.col("n_base") > 0
    return d.select(
        "doc_id", "n_words", "n_base",
        F.when(hit, spaces(F.substring_index("marked", MARK, 1)) - 1).cast("long").alias("first_word"),
        F.when(hit, F.col("n_words") - spaces(F.substring_index("marked", MARK, -1))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("method.labels"))), ",").alias("labels"),
        F.when(hit, F.lit(1.0)).otherwise(F.col("method.score")).alias("score"))
