"""Language statistics over a comment table and language detection.

Every statistic is one grouped aggregate (partial + final, so a hot language
never lands whole in one task). Totals that a per-language row needs are
taken with an unpartitioned window over the already-grouped rows, whose
count is the number of distinct languages, not the number of comments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.order_stats import median
from lexiflow.session import stage

PACKED = 3                     # longest n-gram whose code points (21 bits each) fit one long
CHARS = 1 << 20                # characters looked at at once
COUNTED = 1 << 22              # counters held at once; more distinct keys are sorted
MAX_CELLS = 1 << 23            # grams x languages sent to the tasks; more are matched by joins
MAX_LANGS = 256                # languages scored as columns; more are matched by joins


def _all():
    return Window.partitionBy()


def language_distribution(df: DataFrame, lang_col: str = "language", top_n: int = 20) -> DataFrame:
    """Count and percent of all rows per language, top ``top_n``."""
    g = df.groupBy(F.col(lang_col).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return (g.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(_all()), 6))
            .orderBy(F.desc("n"), F.asc("language"))
            .limit(top_n))


def language_summary(df: DataFrame, lang_col: str = "language") -> DataFrame:
    """Distinct languages, modal language (ties -> smallest code), its count and percent."""
    g = df.groupBy(F.col(lang_col).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    # The ranking window runs over one row per language, not per comment.
    ranked = g.withColumn("rk", F.row_number().over(
        Window.orderBy(F.desc("n"), F.asc("language"))))
    return (ranked.agg(
        F.count("language").cast("bigint").alias("n_languages"),
        F.max(F.when(F.col("rk") == 1, F.col("language"))).alias("top_language"),
        F.max(F.when(F.col("rk") == 1, F.col("n"))).alias("top_n"),
        F.round(F.max(F.when(F.col("rk") == 1, F.col("n"))) * 100.0 / F.sum("n"), 6).alias("top_percent"),
    ))


def language_confidence(df: DataFrame, score_col: str = "language_score",
                        high: float = 0.9, low: float = 0.5) -> DataFrame:
    """Mean and exact median score; count and percent above ``high`` / below ``low``.

    The median is found by counted ranges (``order_stats``), so no state
    grows with the number of distinct scores.
    """
    s = F.col(score_col)
    n = F.count(s)
    middle = median(df, score_col)
    return df.agg(
        F.round(F.avg(s), 6).alias("mean_score"),
        F.round(F.lit(middle).cast("double"), 6).alias("median_score"),
        F.count_if(s > high).alias("n_high"),
        F.round(F.count_if(s > high) * 100.0 / n, 6).alias("pct_high"),
        F.count_if(s < low).alias("n_low"),
        F.round(F.count_if(s < low) * 100.0 / n, 6).alias("pct_low"),
    )


def language_crosstab(df: DataFrame, lang_col: str = "language", by: str = "platform",
                      values: tuple[str, str] = ("YouTube", "Telegram"), top_n: int = 10) -> DataFrame:
    """Per-language counts for two groups (missing -> 0), total, percent of all, top n."""
    a, b = values
    p = (df.groupBy(F.col(lang_col).alias("language"))
         .pivot(by, list(values)).agg(F.count(F.lit(1)))
         .na.fill(0, subset=[a, b]))
    p = p.select("language", F.col(a).cast("bigint").alias(f"n_{a.lower()}"),
                 F.col(b).cast("bigint").alias(f"n_{b.lower()}"))
    p = p.withColumn("total", F.col(f"n_{a.lower()}") + F.col(f"n_{b.lower()}"))
    return (p.withColumn("percent", F.round(F.col("total") * 100.0 / F.sum("total").over(_all()), 6))
            .orderBy(F.desc("total"), F.asc("language")).limit(top_n))


def filter_language(df: DataFrame, lang: str, lang_col: str = "language") -> DataFrame:
    """Keep rows of one language; a null label never matches."""
    return df.filter(F.col(lang_col) == F.lit(lang))


def _edged(text_col: str) -> Column:
    """The lower-cased text, white space runs as one space, with spaces marking word edges."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+", " "), F.lit(" "))


def char_ngrams(text_col: str, n: int = 3) -> F.Column:
    """Character n-grams of the lower-cased text with spaces marking word edges.

    The text becomes an array of code points; n-grams are shifted slices
    joined with ``zip_with`` (lambdas see only their own arguments).
    """
    chars = F.regexp_extract_all(_edged(text_col), F.lit("(?s)."), 0)
    size = F.size(chars)
    acc = chars
    for k in range(1, n):
        acc = F.zip_with(acc, F.slice(chars, k + 1, F.greatest(size - k, F.lit(0))),
                         lambda a, b: F.concat(a, b))
    return F.filter(acc, lambda g: g.isNotNull())


def _coded(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, grams, code): where an n-gram without line feed starts, the distinct ones ascending, and which of them
    stands at each place. A gram is its code points, 21 bits each. Few distinct characters are looked up in a table."""
    m = max(len(codes) - n + 1, 0)
    inside = np.ones(m, bool)
    feeds = np.flatnonzero(codes == 10)
    for k in range(n):
        at = feeds - k
        inside[at[(at >= 0) & (at < m)]] = False
    places = np.flatnonzero(inside)
    used = np.flatnonzero(np.bincount(codes))
    table = len(used) ** n <= COUNTED
    if table:
        small = np.zeros(used[-1] + 1 if len(used) else 0, np.int64)
        small[used] = np.arange(len(used))
        codes = small[codes]
    gram = np.zeros(m, np.int64)
    for k in range(n):
        gram = gram * len(used) + codes[k:k + m] if table else gram << 21 | codes[k:k + m]
    gram = gram[inside]
    if not table:
        return places, *np.unique(gram, return_inverse=True)
    hit = np.zeros(len(used) ** n, bool)
    hit[gram] = True
    found = np.flatnonzero(hit)
    rank = np.zeros(len(hit), np.int32)
    rank[found] = np.arange(len(found))
    grams = np.zeros(len(found), np.int64)
    for k in range(n):
        grams |= used[found // len(used) ** k % len(used)] << 21 * k
    return places, grams, rank[gram].astype(np.int64)


def _grams_of(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, grams, code) of edged texts, about ``CHARS`` at once: the row of each n-gram, the distinct grams and which it is."""
    def coded(rows, parts):
        codes = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)     # edged texts hold no line feed
        row = np.repeat(np.array(rows, np.int64), np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
        places, grams, code = _coded(codes, n)
        return row[places], grams, code

    rows, parts, held = [], [], 0
    for i, t in enumerate(texts.to_pylist()):
        for k in range(0, max(len(t) - n + 1, 1), CHARS):
            rows.append(i)
            parts.append(t[k:k + CHARS + n - 1])
            held += len(parts[-1])
            if held >= CHARS:
                yield coded(rows, parts)
                rows, parts, held = [], [], 0
    if rows:
        yield coded(rows, parts)


def _counted(group: np.ndarray, n_groups: int, grams: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, gram, count) of the distinct (group, gram)."""
    g = max(len(grams), 1)
    key = group * g + code
    if n_groups * g <= COUNTED:
        n = np.bincount(key, minlength=n_groups * g)
        keys = np.flatnonzero(n)
        n = n[keys]
    else:
        keys, n = np.unique(key, return_counts=True)
    return keys // g, grams[keys % g], n


def gram_counts(df: DataFrame, by: str, n: int = 3, text_col: str = "text") -> DataFrame:
    """(by, g, c): how often each character n-gram occurs in the texts of each ``by`` value (null is a value).

    Up to ``PACKED`` characters a gram is a long, and each batch of texts is
    counted in its task, so that only partial counts leave it. Longer grams
    are strings, one row each.
    """
    if n > PACKED:
        return df.select(F.col(by).alias("by"), F.explode(char_ngrams(text_col, n)).alias("g")).groupBy("by", "g").agg(F.count(F.lit(1)).alias("c"))
    docs = df.select(F.struct(F.col(by).alias("v")).alias("by"), _edged(text_col).alias("t"))
    schema = docs.select("by").schema.add("g", "long").add("c", "long")
    by_text = dict(df.select(by).dtypes)[by] == "string"

    def count(batches):
        for b in batches:
            values, of = b.column("by"), np.arange(b.num_rows)
            if by_text:                                   # texts of one label are counted together
                label = values.field("v").dictionary_encode()
                of = label.indices.fill_null(len(label.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.unique(of, return_index=True)
                values, of = values.take(pa.array(first[1])), np.searchsorted(first[0], of)
            for row, grams, code in _grams_of(b.column("t"), n):
                group, gram, c = _counted(of[row], len(values), grams, code)
                yield pa.RecordBatch.from_arrays([values.take(pa.array(group)), pa.array(gram), pa.array(c)], names=["by", "g", "c"])

    return docs.mapInArrow(count, schema).groupBy(F.col("by.v").alias("by"), "g").agg(F.sum("c").alias("c"))


def detect_language(train: DataFrame, docs: DataFrame, n: int = 3, text_col: str = "text",
                    lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, language, confidence) from a character n-gram naive Bayes.

    Profiles are (language, gram) counts from labelled rows. With add-one
    smoothing over the gram vocabulary V, a document's score for language l
    is ``ln P(l) + sum_g c_g ln(c_lg + 1) - N_known ln(T_l + V)``: only grams
    a language has seen add to the sum. Confidence is the softmax of the
    scores; a document with no known gram is ``unknown``.

    The training texts are read once. The profiles, a dictionary of checked
    size, go to every task, which sums a document's grams where it reads them;
    one row a document is shuffled. Larger profiles are matched by joins.
    """
    tg = stage(gram_counts(train, lang_col, n, text_col).select(F.col("by").alias("lang"), "g", F.col("c").alias("c_lg")), "profiles")
    langs = train.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n_docs"))
    totals = tg.groupBy("lang").agg(F.sum("c_lg").alias("t_l"))
    v = tg.agg(F.count_distinct("g")).first()[0]
    n_train = train.count()
    prior = stage(langs.join(totals, "lang")
                  .select("lang", F.log(F.col("n_docs") / n_train).alias("_base"),
                          F.log(F.col("t_l") + v).alias("_lt")), "priors")
    n_langs = prior.count()
    if n > PACKED or v * n_langs > MAX_CELLS or n_langs > MAX_LANGS:
        return _detect_by_joins(prior, tg, docs, n, text_col, id_col)
    known = prior.orderBy("lang").collect()
    if not known:
        return docs.where("false").select(F.col(id_col).alias("doc_id"), F.lit("").alias("language"), F.lit(0.0).alias("confidence"))
    sums = _gram_sums(tg, [p.lang for p in known], docs, n, text_col, id_col)
    at = [F.when(F.col("doc_id").isNull(), 0.0).otherwise(F.sum(f"_s{i}")) for i in range(len(known))]
    x = sums.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.when(F.col("doc_id").isNull(), 0).otherwise(F.sum("n_known")).alias("n_known"), *[s.alias(f"_s{i}") for i, s in enumerate(at)])
    scores = F.array(*[F.lit(p._base) + F.col(f"_s{i}") - F.col("n_known") * F.lit(p._lt) for i, p in enumerate(known)])
    x = x.select("doc_id", "_rows", "n_known", scores.alias("_scores"))
    # The first language among those of the highest rounded score.
    rounded = F.transform("_scores", lambda s: F.round(s, 9))
    k = F.array_position(rounded, F.array_max(rounded)).cast("int")
    p = F.transform("_scores", lambda s: F.exp(s - F.array_max("_scores")))
    conf = F.element_at(p, k) / (F.aggregate(p, F.lit(0.0), lambda a, y: a + y) * F.col("_rows"))
    return x.select("doc_id",
                    F.when(F.col("n_known") == 0, F.lit("unknown")).otherwise(F.element_at(F.array(*[F.lit(r.lang) for r in known]), k)).alias("language"),
                    F.when(F.col("n_known") == 0, F.lit(0.0)).otherwise(F.round(conf, 6)).alias("confidence"))


def _gram_sums(tg: DataFrame, langs: list[str], docs: DataFrame, n: int, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, n_known, _s0, _s1, ...) per row of ``docs``: its known grams, and by language their summed ``ln(c_lg + 1)``."""
    profile = tg.toArrow()
    grams, at = np.unique(profile.column("g").to_numpy(), return_inverse=True)
    lang = profile.column("lang").to_pylist()
    place = {x: i for i, x in enumerate(langs)}
    held = np.array([place.get(x, len(langs)) for x in lang], np.int64)     # rows without a label make a gram known only
    weights = np.zeros((len(langs) + 1, len(grams) + 1))
    weights[held, at] = np.log(profile.column("c_lg").to_numpy() + 1)
    weights[:, -1] = 0.0
    weights = weights[:-1]
    rows = docs.select(F.col(id_col).alias("doc_id"), _edged(text_col).alias("t"))
    schema = rows.select("doc_id").schema.add("n_known", "long")
    for i in range(len(langs)):
        schema = schema.add(f"_s{i}", "double")

    def add(batches):
        for b in batches:
            n_known, sums = np.zeros(b.num_rows, np.int64), np.zeros((len(weights), b.num_rows))
            for row, found, which in _grams_of(b.column("t"), n):
                k = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
                k[grams[k] != found] = len(grams)
                k = k[which]
                n_known += np.bincount(row[k < len(grams)], minlength=b.num_rows)
                for s, w in zip(sums, weights):
                    s += np.bincount(row, w[k], b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_known), *map(pa.array, sums)], names=schema.names)

    return rows.mapInArrow(add, schema)


def _detect_by_joins(prior: DataFrame, tg: DataFrame, docs: DataFrame, n: int, text_col: str, id_col: str) -> DataFrame:
    """The same for profiles of any size: the documents' gram counts are joined with them, one row per gram that a language has seen."""
    dg = gram_counts(docs, id_col, n, text_col).select(F.col("by").alias("doc_id"), "g", F.col("c").alias("c_g"))
    known = dg.join(tg.select("g").distinct(), "g", "left_semi")
    n_known = known.groupBy("doc_id").agg(F.sum("c_g").alias("n_known"))
    seen = (known.join(tg, "g").groupBy("doc_id", "lang")
                 .agg(F.sum(F.col("c_g") * F.log(F.col("c_lg") + 1)).alias("_s")))
    lang_list = prior.select(F.collect_list(F.struct("lang", "_base", "_lt"))).scalar()
    grid = (docs.select(F.col(id_col).alias("doc_id")).withColumn("_l", lang_list)
                .select("doc_id", F.explode("_l").alias("p"))
                .select("doc_id", F.col("p.lang").alias("lang"), F.col("p._base").alias("_base"),
                        F.col("p._lt").alias("_lt")))
    sc = (grid.join(n_known, "doc_id", "left").join(seen, ["doc_id", "lang"], "left")
              .withColumn("n_known", F.coalesce("n_known", F.lit(0)))
              .withColumn("score", F.col("_base") + F.coalesce("_s", F.lit(0.0))
                          - F.col("n_known") * F.col("_lt")))
    w = Window.partitionBy("doc_id")
    sc = sc.withColumn("_m", F.max("score").over(w))
    sc = sc.withColumn("_p", F.exp(F.col("score") - F.col("_m")))
    sc = sc.withColumn("conf", F.col("_p") / F.sum("_p").over(w))
    best = sc.withColumn("_rk", F.row_number().over(w.orderBy(F.desc(F.round("score", 9)), "lang"))).filter("_rk = 1")
    return best.select("doc_id",
                       F.when(F.col("n_known") == 0, F.lit("unknown")).otherwise(F.col("lang")).alias("language"),
                       F.when(F.col("n_known") == 0, F.lit(0.0)).otherwise(F.round("conf", 6)).alias("confidence"))
