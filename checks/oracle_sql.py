"""Independent DuckDB SQL for every SQL-checkable query in the catalog.

Views ``documents orders embeddings labels ...`` are the driver's parquet
tables. Shared building blocks are CTE strings composed below.
"""

from __future__ import annotations

# Comment table: same definition as lexiflow.sources.tables.comments.
COMMENTS = """
comments AS (
  SELECT d.doc_id, d.text AS comment, o.o_orderdate AS published_at, d.lang AS language,
         CAST((('0x' || substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 8))::BIGINT % 1000) AS DOUBLE) / 1000.0
           AS language_score,
         CASE WHEN CAST(substr(d.source, 4) AS INT) % 2 = 0 THEN 'YouTube' ELSE 'Telegram' END AS platform
  FROM documents d LEFT JOIN orders o ON d.doc_id = o.o_orderkey
)"""

SQL: dict[str, str] = {}

SQL["language_distribution"] = f"""
WITH {COMMENTS},
g AS (SELECT language, count(*) AS n FROM comments GROUP BY language)
SELECT language, n, round(n * 100.0 / sum(n) OVER (), 6) AS percent
FROM g ORDER BY n DESC, language LIMIT 20"""

SQL["language_summary"] = f"""
WITH {COMMENTS},
g AS (SELECT language, count(*) AS n FROM comments GROUP BY language),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, language) AS rk FROM g)
SELECT count(language)::BIGINT AS n_languages,
       max(CASE WHEN rk = 1 THEN language END) AS top_language,
       max(CASE WHEN rk = 1 THEN n END) AS top_n,
       round(max(CASE WHEN rk = 1 THEN n END) * 100.0 / sum(n), 6) AS top_percent
FROM r"""

SQL["language_confidence"] = f"""
WITH {COMMENTS}
SELECT round(avg(language_score), 6) AS mean_score,
       round(median(language_score), 6) AS median_score,
       count(*) FILTER (WHERE language_score > 0.9) AS n_high,
       round(count(*) FILTER (WHERE language_score > 0.9) * 100.0 / count(language_score), 6) AS pct_high,
       count(*) FILTER (WHERE language_score < 0.5) AS n_low,
       round(count(*) FILTER (WHERE language_score < 0.5) * 100.0 / count(language_score), 6) AS pct_low
FROM comments"""

SQL["language_crosstab"] = f"""
WITH {COMMENTS},
g AS (SELECT language,
             count(*) FILTER (WHERE platform = 'YouTube') AS n_youtube,
             count(*) FILTER (WHERE platform = 'Telegram') AS n_telegram
      FROM comments GROUP BY language),
t AS (SELECT language, n_youtube, n_telegram, n_youtube + n_telegram AS total FROM g)
SELECT language, n_youtube, n_telegram, total, round(total * 100.0 / sum(total) OVER (), 6) AS percent
FROM t ORDER BY total DESC, language LIMIT 10"""

SQL["filter_language"] = f"""
WITH {COMMENTS}
SELECT doc_id, published_at, platform, length(comment)::BIGINT AS n_chars
FROM comments WHERE language = 'en'"""


# ---------------------------------------------------------------- text family
STOP = "['a','an','and','are','as','at','be','by','for','from','in','is','it','of','on','or','that','the','this','to','was','with']"
URLM = r"http\S+|www\S+|@[\p{L}\p{N}_]+"


def _nz(x):
    return f"coalesce({x}, '')"


def _collapse(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _keep(x, extra=""):
    return f"regexp_replace({x}, '[^\\p{{L}}\\s{extra}]', '', 'g')"


def _lower_or_empty(x):
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE lower({x}) END"


def _urls(x):
    return f"regexp_replace({x}, '{URLM}', '', 'g')"


def clean_normalized(x):
    return _collapse(_keep(_urls(f"lower({_nz(x)})")))


CLEAN = {
    "clean_strict": lambda x: (
        f"array_to_string(list_filter(string_split({_collapse(_keep(f'lower({_nz(x)})'))}, ' '), "
        f"lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w)), ' ')"),
    "clean_punct": lambda x: _keep(_collapse(_urls(_lower_or_empty(x))), ".,!?;:\\-"),
    "clean_light": lambda x: _keep(_collapse(_urls(_lower_or_empty(x))), ".,!?\\-"),
    "clean_letters": lambda x: _keep(_collapse(_urls(_lower_or_empty(x)))),
    "clean_letters_normalized": clean_normalized,
}
for _k, _f in CLEAN.items():
    SQL[_k] = f"WITH {COMMENTS} SELECT doc_id, {_f('comment')} AS clean FROM comments"


def tok_words(x):
    return f"list_filter(regexp_split_to_array(lower({_nz(x)}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"


def tok_vec(x):
    return f"list_filter({tok_words(x)}, lambda t: length(t) >= 2)"


TOK = {
    "tokenize_words": tok_words,
    "tokenize_whitespace": lambda x: f"list_filter(regexp_split_to_array({_nz(x)}, '\\s+'), lambda t: t <> '')",
    "tokenize_space": lambda x: f"string_split({_nz(x)}, ' ')",
    "tokenize_vectorizer": tok_vec,
    "tokenize_segments": lambda x: f"regexp_extract_all({_nz(x)}, '\\p{{L}}+|\\p{{N}}+|[^\\s\\p{{L}}\\p{{N}}]')",
    "ngrams": lambda x: (
        f"list_concat(list_transform(range(1, len({x}) + 1), lambda i: {x}[i]), "
        f"list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"),
    "remove_stopwords": lambda x: f"list_filter({x}, lambda t: NOT list_contains({STOP}, t))",
}
for _k, _f in TOK.items():
    _src = "comment" if _k not in ("ngrams", "remove_stopwords") else "w"
    SQL[_k] = (f"WITH {COMMENTS}, c AS (SELECT doc_id, comment, {tok_words('comment')} AS w FROM comments), "
               f"t AS (SELECT doc_id, {_f(_src)} AS tokens FROM c) "
               f"SELECT doc_id, len(tokens)::BIGINT AS n_tokens, array_to_string(tokens, '|') AS joined FROM t")

CLEANED = f"""{COMMENTS},
cleaned AS (SELECT *, {clean_normalized('comment')} AS clean FROM comments),
docs AS (SELECT *, {tok_vec('clean')} AS tokens FROM cleaned)"""

SQL["filter_min_length"] = f"""WITH {CLEANED}
SELECT doc_id, length(clean)::BIGINT AS n_chars FROM docs WHERE language = 'en' AND length(clean) >= 15"""

SQL["drop_empty"] = f"""WITH {COMMENTS}, c AS (SELECT doc_id, published_at, {CLEAN['clean_strict']('comment')} AS clean FROM comments)
SELECT doc_id, clean FROM c WHERE published_at IS NOT NULL AND clean IS NOT NULL AND clean <> ''"""

SQL["parse_time_coerce"] = f"""WITH {COMMENTS}
SELECT doc_id, try_strptime(strftime(published_at, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS parsed_ok,
       try_strptime(substr(comment, 1, 19), '%Y-%m-%d %H:%M:%S') AS parsed_bad FROM comments"""

SQL["calendar_parts"] = f"""WITH {COMMENTS}
SELECT doc_id, 'fixture' AS source_name, year(published_at)::BIGINT AS year, month(published_at)::BIGINT AS month,
       strftime(published_at, '%Y-%m') AS year_month FROM comments"""

H32 = "('0x' || substr(md5({seed} || ':' || CAST({x} AS VARCHAR)), 1, 8))::BIGINT"


def h32(x, seed):
    return H32.format(seed=f"'{seed}'", x=x)


SQL["sample_exact_n"] = f"""WITH {COMMENTS}
SELECT doc_id, published_at FROM comments ORDER BY {h32('doc_id', 42)}, doc_id LIMIT 100"""

SQL["stratified_split"] = f"""WITH {COMMENTS},
c AS (SELECT doc_id, strftime(published_at, '%Y-%m') AS slice FROM comments),
r AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY {h32('doc_id', 42)}, doc_id) AS rk,
             count(*) OVER (PARTITION BY slice) AS n FROM c)
SELECT doc_id, slice, CASE WHEN rk <= round(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM r"""

SQL["doc_length"] = f"WITH {CLEANED} SELECT doc_id, len(tokens)::BIGINT AS dl FROM docs"

SQL["avg_doc_length"] = f"""WITH {CLEANED}
SELECT count(*) AS n_docs, sum(len(tokens))::BIGINT AS n_tokens,
       coalesce(sum(len(tokens)) / nullif(count(*), 0), 1.0)::DOUBLE AS avg_dl FROM docs"""

SQL["term_frequency"] = f"""WITH {CLEANED}, t AS (SELECT doc_id, unnest(tokens) AS term FROM docs)
SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term"""

SQL["document_frequency"] = f"""WITH {CLEANED}, t AS (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM docs WHERE language = 'en')
SELECT term, count(*) AS df FROM t GROUP BY term"""

VOCAB = f"""{CLEANED},
toks AS (SELECT doc_id, unnest(tokens) AS term FROM docs),
stats AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM toks GROUP BY term),
kept AS (SELECT * FROM stats WHERE df >= 2 AND df <= floor(0.9 * (SELECT count(*) FROM docs))
         ORDER BY tf DESC, term LIMIT 5000),
vocab AS (SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term, tf, df FROM kept),
bow AS (SELECT doc_id, term_id, count(*) AS tf FROM toks JOIN vocab USING (term) GROUP BY doc_id, term_id)"""

SQL["build_vocabulary"] = f"WITH {VOCAB} SELECT term_id, term, tf, df FROM vocab"
SQL["bag_of_words"] = f"WITH {VOCAB} SELECT doc_id, term_id, tf FROM bow"
SQL["filter_min_terms"] = f"""WITH {VOCAB}
SELECT doc_id, sum(tf)::BIGINT AS n_terms FROM bow GROUP BY doc_id HAVING sum(tf) >= 50"""
SQL["time_word_frequency"] = f"""WITH {VOCAB}
SELECT year(d.published_at) || 'Q' || quarter(d.published_at) AS time_slice, b.term_id, sum(b.tf)::BIGINT AS tf
FROM bow b JOIN docs d USING (doc_id) GROUP BY 1, 2"""

SQL["slice_month"] = f"""WITH {COMMENTS}
SELECT doc_id, strftime(published_at, '%Y-%m') AS slice_month,
       year(published_at) || 'Q' || quarter(published_at) AS slice_quarter,
       date_trunc('month', published_at) AS month_start, date_trunc('quarter', published_at) AS quarter_start
FROM comments"""

PREPARED = f"""{COMMENTS},
pc AS (SELECT doc_id, platform, strftime(published_at, '%Y-%m') AS slice, {CLEAN['clean_strict']('comment')} AS processed
       FROM comments WHERE published_at IS NOT NULL),
tm AS (SELECT slice, count(*) AS n_docs, row_number() OVER (ORDER BY slice) - 1 AS t FROM pc WHERE processed <> ''
       GROUP BY slice HAVING count(*) >= 10),
pd AS (SELECT pc.*, tm.t, tm.n_docs FROM pc JOIN tm USING (slice) WHERE processed <> ''),
pt AS (SELECT doc_id, unnest({tok_vec('processed')}) AS term FROM pd),
pv AS (SELECT term FROM (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM pt GROUP BY term)
       WHERE df >= 5 AND df <= floor(0.9 * (SELECT count(*) FROM pd)) ORDER BY tf DESC, term LIMIT 10000),
pb AS (SELECT doc_id, term, count(*) AS tf FROM pt JOIN pv USING (term) GROUP BY doc_id, term),
ps AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY slice ORDER BY {h32('doc_id', 42)}, doc_id)
                           <= round(count(*) OVER (PARTITION BY slice) * 0.1) THEN 'test' ELSE 'train' END AS split FROM pd)"""
SQL["prepare_corpus"] = f"""WITH {PREPARED}
SELECT doc_id, platform, slice, t, split, coalesce(sum(tf), 0)::BIGINT AS n_tokens, count(term) AS n_terms
FROM ps LEFT JOIN pb USING (doc_id) GROUP BY ALL"""
SQL["persist_corpus"] = f"""WITH {PREPARED}
SELECT split, doc_id, slice, n_docs, term, tf FROM ps JOIN pb USING (doc_id)"""

MONTHS = f"""{COMMENTS}, c AS (SELECT doc_id, strftime(published_at, '%Y-%m') AS slice FROM comments),
v AS (SELECT slice, count(*) AS n_docs FROM c GROUP BY slice HAVING count(*) >= 10)"""
SQL["valid_slices"] = f"WITH {MONTHS} SELECT slice, n_docs FROM v"
SQL["slice_index"] = f"WITH {MONTHS} SELECT slice, (dense_rank() OVER (ORDER BY slice) - 1)::BIGINT AS t FROM v"

TOPICS = f"""{COMMENTS},
dt AS (SELECT c.*, coalesce(e.label, -1)::INT AS topic FROM comments c LEFT JOIN embeddings e ON c.doc_id = e.vec_id)"""

SQL["nearest_slice"] = f"""WITH {TOPICS},
s AS (SELECT DISTINCT date_trunc('quarter', published_at) AS ts FROM dt WHERE topic <> -1),
si AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t FROM s),
cand AS (SELECT d.doc_id, d.published_at, si.t,
                row_number() OVER (PARTITION BY d.doc_id
                                   ORDER BY abs(epoch_us(si.ts) - epoch_us(d.published_at)), si.t) AS rk
         FROM dt d, si)
SELECT doc_id, published_at, t::BIGINT AS t FROM cand WHERE rk = 1"""

SQL["nearest_slice_asof"] = SQL["nearest_slice"].replace("date_trunc('quarter'", "date_trunc('day'")

SQL["equal_width_bins"] = f"""WITH {COMMENTS},
b AS (SELECT min(epoch_us(published_at)) AS lo, max(epoch_us(published_at)) AS hi FROM comments)
SELECT doc_id, published_at,
       least(CASE WHEN hi = lo THEN 0 ELSE floor((epoch_us(published_at) - lo) / ((hi - lo) / 20.0)) END, 19)::BIGINT AS bin
FROM comments, b"""


# ---------------------------------------------------------------- topic family
TDOCS = f"""{TOPICS},
td0 AS (SELECT dt.*, {CLEAN['clean_letters']('comment')} AS processed FROM dt),
td AS (SELECT doc_id, published_at, platform, topic, processed, {tok_vec('processed')} AS tokens,
              date_trunc('quarter', published_at) AS quarter, date_trunc('month', published_at) AS month
       FROM td0 WHERE length(processed) >= 15)"""


def ctfidf_ctes(src, slice_col, prefix, tuned=False):
    """CTEs for class TF-IDF over time on `src`; final CTE `{prefix}ot`(topic, timestamp, words, frequency)."""
    p = prefix
    s = f"""
{p}ct AS (SELECT topic, term, count(*) AS tf FROM (SELECT topic, unnest(tokens) AS term FROM {src}) GROUP BY topic, term),
{p}f AS (SELECT term, sum(tf) AS f FROM {p}ct GROUP BY term),
{p}idf AS (SELECT term, ln(1.0 + (SELECT sum(tf) / count(DISTINCT topic) FROM {p}ct) / f) AS idf FROM {p}f),
{p}cq AS (SELECT topic, {slice_col} AS ts, term, count(*) AS tf
          FROM (SELECT topic, {slice_col}, unnest(tokens) AS term FROM {src}) GROUP BY topic, ts, term),
{p}cqt AS (SELECT topic, ts, sum(tf) AS tot FROM {p}cq GROUP BY topic, ts),
{p}w0 AS (SELECT q.topic, q.ts, q.term, q.tf / t.tot * i.idf AS weight
          FROM {p}cq q JOIN {p}cqt t USING (topic, ts) JOIN {p}idf i USING (term)),"""
    if tuned:
        s += f"""
{p}ctt AS (SELECT topic, sum(tf) AS tot FROM {p}ct GROUP BY topic),
{p}g AS (SELECT c.topic, c.term, c.tf / t.tot * i.idf AS g FROM {p}ct c JOIN {p}ctt t USING (topic) JOIN {p}idf i USING (term)),
{p}w1 AS (SELECT w.topic, w.ts, w.term, (w.weight + coalesce(g.g, 0.0)) / 2 AS weight
          FROM {p}w0 w LEFT JOIN {p}g g USING (topic, term)),
{p}si AS (SELECT ts, dense_rank() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM {p}w1)),
{p}w2 AS (SELECT w.*, s.i FROM {p}w1 w JOIN {p}si s USING (ts)),
{p}w AS (SELECT a.topic, a.ts, a.term, CASE WHEN b.weight IS NULL THEN a.weight ELSE (a.weight + b.weight) / 2 END AS weight
         FROM {p}w2 a LEFT JOIN {p}w2 b ON b.topic = a.topic AND b.term = a.term AND b.i = a.i - 1),"""
    else:
        s += f"\n{p}w AS (SELECT * FROM {p}w0),"
    s += f"""
{p}top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, ts ORDER BY round(weight, 10) DESC, term) AS rk
                          FROM {p}w) WHERE rk <= 10),
{p}wl AS (SELECT topic, ts, list(term ORDER BY rk) AS words FROM {p}top GROUP BY topic, ts),
{p}fr AS (SELECT topic, {slice_col} AS ts, count(*) AS frequency FROM {src} GROUP BY topic, ts),
{p}ot AS (SELECT f.topic, f.ts AS timestamp, coalesce(w.words, []::VARCHAR[]) AS words, f.frequency
          FROM {p}fr f LEFT JOIN {p}wl w USING (topic, ts))"""
    return s


SQL["topics_over_time"] = f"""WITH {TDOCS}, {ctfidf_ctes('td', 'quarter', 'q_')}
SELECT topic, timestamp, array_to_string(words, ', ') AS words, frequency FROM q_ot"""

SQL["topics_over_time_tuned"] = f"""WITH {TDOCS}, {ctfidf_ctes('td', 'quarter', 'q_', tuned=True)}
SELECT topic, timestamp, array_to_string(words, ', ') AS words, frequency FROM q_ot"""

TOPIC_WORDS = f"""
ct AS (SELECT topic, term, count(*) AS tf FROM (SELECT topic, unnest(tokens) AS term FROM td) GROUP BY topic, term),
f AS (SELECT term, sum(tf) AS f FROM ct GROUP BY term),
idf AS (SELECT term, ln(1.0 + (SELECT sum(tf) / count(DISTINCT topic) FROM ct) / f) AS idf FROM f),
ctt AS (SELECT topic, sum(tf) AS tot FROM ct GROUP BY topic),
wt AS (SELECT c.topic, c.term, c.tf / t.tot * i.idf AS weight FROM ct c JOIN ctt t USING (topic) JOIN idf i USING (term)),
tw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 10) DESC, term) AS rank
                      FROM wt) WHERE rank <= 10)"""

SQL["topic_words"] = f"WITH {TDOCS}, {TOPIC_WORDS} SELECT topic, rank, term, round(weight, 6) AS weight FROM tw"

SQL["topic_similarity"] = f"""WITH {TDOCS}, {TOPIC_WORDS},
big AS (SELECT topic, count(*) AS n FROM td WHERE topic <> -1 GROUP BY topic ORDER BY n DESC, topic LIMIT 20),
bw AS (SELECT * FROM wt JOIN big USING (topic)),
nm AS (SELECT topic, sqrt(sum(weight * weight)) AS norm FROM bw GROUP BY topic),
dp AS (SELECT a.topic AS topic_a, b.topic AS topic_b, sum(a.weight * b.weight) AS dot FROM bw a JOIN bw b USING (term) GROUP BY ALL)
SELECT a.topic AS topic_a, b.topic AS topic_b, round(coalesce(dot, 0.0) / (a.norm * b.norm), 6) AS similarity
FROM nm a CROSS JOIN nm b LEFT JOIN dp ON dp.topic_a = a.topic AND dp.topic_b = b.topic"""

SQL["topic_info"] = f"""WITH {TDOCS}, {TOPIC_WORDS},
cnt AS (SELECT topic, count(*) AS n_docs FROM td GROUP BY topic),
w5 AS (SELECT topic, list(term ORDER BY rank) AS words FROM tw WHERE rank <= 5 GROUP BY topic)
SELECT c.topic, c.n_docs, array_to_string(coalesce(w5.words, []::VARCHAR[]), ', ') AS words
FROM cnt c LEFT JOIN w5 USING (topic)"""

SQL["topic_distribution"] = f"""WITH {TDOCS}
SELECT topic, count(*) AS n_docs FROM td GROUP BY topic ORDER BY n_docs DESC, topic LIMIT 20"""

SQL["topics_per_platform"] = f"""WITH {TDOCS}
SELECT platform, count(DISTINCT topic) AS n_topics FROM td GROUP BY platform"""

SQL["select_topics_by_docs"] = f"""WITH {TDOCS}
SELECT topic, count(*) AS n_docs FROM td WHERE topic <> -1 GROUP BY topic ORDER BY n_docs DESC, topic LIMIT 30"""

SQL["select_topics_by_frequency"] = f"""WITH {TDOCS}, {ctfidf_ctes('td', 'quarter', 'q_')}
SELECT topic, sum(frequency)::BIGINT AS frequency FROM q_ot WHERE topic <> -1
GROUP BY topic ORDER BY frequency DESC, topic LIMIT 30"""

SQL["topic_report"] = f"""WITH {TDOCS}, {TOPIC_WORDS},
cnt AS (SELECT topic, count(*) AS n_docs FROM td WHERE topic <> -1 GROUP BY topic),
w5 AS (SELECT topic, list(term ORDER BY rank) AS words FROM tw WHERE rank <= 5 GROUP BY topic),
top AS (SELECT c.topic, c.n_docs, array_to_string(coalesce(w5.words, []::VARCHAR[]), ', ') AS words
        FROM cnt c LEFT JOIN w5 USING (topic) ORDER BY n_docs DESC, topic LIMIT 10)
SELECT 'summary' AS section, 'total_comments' AS key, CAST(count(*) AS VARCHAR) AS value FROM td
UNION ALL SELECT 'summary', 'date_range', CAST(min(published_at) AS VARCHAR) || ' to ' || CAST(max(published_at) AS VARCHAR) FROM td
UNION ALL SELECT 'platform', platform, CAST(count(*) AS VARCHAR) FROM td GROUP BY platform
UNION ALL SELECT 'topics', 'total_topics', CAST(count(DISTINCT topic) FILTER (WHERE topic <> -1) AS VARCHAR) FROM td
UNION ALL SELECT 'topics', 'outliers', CAST(count(*) FILTER (WHERE topic = -1) AS VARCHAR) FROM td
UNION ALL SELECT 'top_topics', CAST(topic AS VARCHAR), CAST(n_docs AS VARCHAR) || ': ' || words FROM top"""

SQL["over_time_summary"] = f"""WITH {TDOCS},
tdy AS (SELECT * FROM td WHERE platform = 'YouTube'), tdt AS (SELECT * FROM td WHERE platform = 'Telegram'),
{ctfidf_ctes('tdy', 'quarter', 'y_')}, {ctfidf_ctes('tdt', 'quarter', 't_')},
u AS (SELECT 'YouTube' AS platform, * FROM y_ot UNION ALL SELECT 'Telegram', * FROM t_ot)
SELECT platform, count(*) AS n_rows, count(DISTINCT topic) AS n_topics, min(timestamp) AS first_ts, max(timestamp) AS last_ts
FROM u GROUP BY platform"""


def parse_words_sql(x, strip):
    t = f"list_transform({x}, lambda w: trim(w))"
    if strip:
        t = f"list_transform({t}, lambda w: CASE WHEN starts_with(w, 'clustering ') THEN substr(w, 12) ELSE w END)"
    return f"list_slice(list_filter({t}, lambda w: w <> ''), 1, 10)"


def vocab_sql(prefix, src, min_df, max_df, max_features):
    p = prefix
    lo = f"df >= {min_df}"
    hi = f"df <= floor({max_df} * (SELECT count(*) FROM {src}))" if isinstance(max_df, float) else f"df <= {max_df}"
    return f"""
{p}toks AS (SELECT doc_id, unnest(vtokens) AS term FROM {src}),
{p}stats AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM {p}toks GROUP BY term),
{p}vocab AS (SELECT term AS w FROM (SELECT * FROM {p}stats WHERE {lo} AND {hi} ORDER BY tf DESC, term LIMIT {max_features}))"""


def dtm_ctes(variant, src="td", p="m_", ot=None):
    """CTEs ending in {p}topic_time, {p}topic, {p}time, {p}overall for one preset."""
    slice_col = "month" if variant == "B" else "quarter"
    s = "" if ot else ctfidf_ctes(src, slice_col, p + "o") + ","
    ot = ot or f"{p}oot"
    if variant == "D":
        sel = f"""{p}sel AS (SELECT topic FROM {ot} WHERE topic <> -1 GROUP BY topic ORDER BY sum(frequency) DESC, topic LIMIT 30)"""
    elif variant == "B":
        sel = f"""{p}sel AS (SELECT DISTINCT topic FROM {src} WHERE topic <> -1)"""
    else:
        sel = f"""{p}sel AS (SELECT topic FROM {src} WHERE topic <> -1 GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 30)"""
    s += f"""
{sel},
{p}st AS (SELECT timestamp, dense_rank() OVER (ORDER BY timestamp) - 1 AS t FROM (SELECT DISTINCT timestamp FROM {ot})),
{p}g0 AS (SELECT s.topic, st.t FROM {p}sel s CROSS JOIN {p}st st),
{p}otw AS (SELECT o.topic, st.t, o.words FROM {ot} o JOIN {p}st st USING (timestamp)),
{p}grid AS (SELECT g.topic, g.t::INT AS t, {parse_words_sql('coalesce(o.words, []::VARCHAR[])', variant == 'A')} AS words
            FROM {p}g0 g LEFT JOIN {p}otw o ON o.topic = g.topic AND o.t = g.t),
{p}gw AS (SELECT topic, t, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM {p}grid),"""
    if variant == "D":
        s += f"""
{p}corpus AS (SELECT CAST(topic AS VARCHAR) || ':' || CAST(t AS VARCHAR) AS doc_id,
                     list_filter(regexp_split_to_array(array_to_string(words, ' '), '\\s+'), lambda x: x <> '') AS tokens
              FROM {p}grid WHERE len(words) > 0),
{p}vocab AS (SELECT DISTINCT w FROM {p}gw),"""
    else:
        where = "" if variant == "B" else f"WHERE topic IN (SELECT topic FROM {p}sel)"
        s += f"""
{p}corpus AS (SELECT doc_id, list_filter(regexp_split_to_array(processed, '\\s+'), lambda x: x <> '') AS tokens,
                     {tok_vec('processed')} AS vtokens FROM {src} {where}),"""
        if variant == "A":
            s += vocab_sql(p, f"{p}corpus", 2, 0.9, 5000) + ","
        elif variant == "B":
            s += vocab_sql(p, f"{p}corpus", 5, 0.9, 10000) + ","
        else:
            s += vocab_sql(p, f"{p}corpus", 1, 1.0, 5000) + ","
    n = f"(SELECT count(*) FROM {p}corpus)"
    T = f"(SELECT count(*) FROM {p}st)"
    if variant == "B":
        ttc_rows = f"""{p}cat AS (SELECT a.topic, a.t, a.pos, a.w FROM {p}gw a
                         WHERE EXISTS (SELECT 1 FROM {p}gw b WHERE b.topic = a.topic AND b.t = a.t + 1)
                       UNION ALL
                       SELECT b.topic, b.t - 1 AS t, b.pos + (SELECT len(g.words) FROM {p}grid g WHERE g.topic = b.topic AND g.t = b.t - 1), b.w
                       FROM {p}gw b WHERE EXISTS (SELECT 1 FROM {p}gw a WHERE a.topic = b.topic AND a.t = b.t - 1)),
{p}ttc_rows AS (SELECT a.topic, a.t, a.w AS wi, b.w AS wj FROM {p}cat a JOIN {p}cat b
                ON a.topic = b.topic AND a.t = b.t AND a.pos < b.pos)"""
        score = (f"CASE WHEN c_ij / {n} >= 1.0 THEN 1.0 ELSE ln((c_ij / {n}) / ((c_i / {n}) * (c_j / {n}) + 1e-10)) "
                 f"/ (-ln(c_ij / {n} + 1e-10)) END")
    else:
        ttc_rows = f"""{p}ttc_rows AS (SELECT a.topic, a.t, a.w AS wi, b.w AS wj FROM {p}gw a JOIN {p}gw b
                ON a.topic = b.topic AND b.t = a.t + 1)"""
        score = f"ln((c_ij / {n} + 1e-10) / ((c_i / {n}) * (c_j / {n}) + 1e-10))"
    last = T if variant == "B" else f"{T} - 1"
    cells = f"{p}grid" if variant == "B" else f"(SELECT * FROM {p}grid WHERE len(words) > 0)"
    s += f"""
{p}needed AS (SELECT DISTINCT w FROM {p}gw WHERE w IN (SELECT w FROM {p}vocab)),
{p}inc AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(tokens) AS w FROM {p}corpus)
           WHERE w IN (SELECT w FROM {p}needed)),
{p}ci AS (SELECT w, count(*) AS c FROM {p}inc GROUP BY w),
{ttc_rows},
{p}tc_rows AS (SELECT a.topic, a.t, a.w AS wi, b.w AS wj FROM {p}gw a JOIN {p}gw b
               ON a.topic = b.topic AND a.t = b.t AND a.pos < b.pos),
{p}pairs AS (SELECT DISTINCT wi, wj FROM (SELECT wi, wj FROM {p}ttc_rows UNION ALL SELECT wi, wj FROM {p}tc_rows)
             WHERE wi IN (SELECT w FROM {p}needed) AND wj IN (SELECT w FROM {p}needed)),
{p}co AS (SELECT p.wi, p.wj, count(*) AS c_ij FROM {p}pairs p JOIN {p}inc a ON a.w = p.wi
          JOIN {p}inc b ON b.doc_id = a.doc_id AND b.w = p.wj GROUP BY p.wi, p.wj),
{p}cnts AS (SELECT co.wi, co.wj, ci.c AS c_i, cj.c AS c_j, co.c_ij FROM {p}co co
            JOIN {p}ci ci ON ci.w = co.wi JOIN {p}ci cj ON cj.w = co.wj),
{p}scores AS (SELECT wi, wj, {score} AS score FROM {p}cnts),
{p}ttc AS (SELECT r.topic, r.t, avg(s.score) AS ttc FROM {p}ttc_rows r JOIN {p}scores s USING (wi, wj) GROUP BY r.topic, r.t),
{p}nx AS (SELECT a.topic, a.t, a.words, b.words AS nwords FROM {p}grid a LEFT JOIN {p}grid b ON b.topic = a.topic AND b.t = a.t + 1),
{p}tts AS (SELECT topic, t, CASE WHEN len(words) > 0 AND nwords IS NOT NULL AND len(nwords) > 0
                THEN len(list_intersect(words, nwords)) / len(list_distinct(list_concat(words, nwords))) ELSE 0.0 END AS tts
           FROM {p}nx),
{p}topic_time AS (SELECT g.topic, g.t, CASE WHEN g.t + 1 < {T} THEN coalesce(c.ttc, 0.0) ELSE 0.0 END AS ttc,
                         coalesce(s.tts, 0.0) AS tts
                  FROM {p}grid g LEFT JOIN {p}ttc c USING (topic, t) LEFT JOIN {p}tts s USING (topic, t)
                  WHERE g.t < {last}),
{p}topic AS (SELECT s.topic, coalesce(q.ttq, 0.0) AS ttq FROM (SELECT DISTINCT topic FROM {p}grid) s
             LEFT JOIN (SELECT topic, avg(ttc * tts) AS ttq FROM {p}topic_time GROUP BY topic) q USING (topic)),
{p}tcc AS (SELECT r.topic, r.t, avg(s.score) AS tc FROM {p}tc_rows r JOIN {p}scores s USING (wi, wj) GROUP BY r.topic, r.t),
{p}tct AS (SELECT c.t, avg(coalesce(x.tc, 0.0)) AS tc FROM {cells} c LEFT JOIN {p}tcc x USING (topic, t) GROUP BY c.t),
{p}tdt AS (SELECT t, count(DISTINCT w) / count(*) AS td FROM {p}gw GROUP BY t),
{p}time AS (SELECT a.t, coalesce(c.tc, 0.0) AS tc, coalesce(d.td, 0.0) AS td, coalesce(c.tc, 0.0) * coalesce(d.td, 0.0) AS tq
            FROM (SELECT DISTINCT t FROM {p}grid) a LEFT JOIN {p}tct c USING (t) LEFT JOIN {p}tdt d USING (t)),
{p}ov AS (SELECT 'TTC' AS metric, coalesce(avg(ttc), 0.0) AS value FROM {p}topic_time
          UNION ALL SELECT 'TTS', coalesce(avg(tts), 0.0) FROM {p}topic_time
          UNION ALL SELECT 'TTQ', coalesce(avg(ttq), 0.0) FROM {p}topic
          UNION ALL SELECT 'TC', coalesce(avg(tc), 0.0) FROM {p}time
          UNION ALL SELECT 'TD', coalesce(avg(td), 0.0) FROM {p}time
          UNION ALL SELECT 'TQ', coalesce(avg(tq), 0.0) FROM {p}time),
{p}overall AS (SELECT metric, value FROM {p}ov
               UNION ALL SELECT 'DTQ', 0.5 * sum(value) FILTER (WHERE metric IN ('TQ', 'TTQ')) FROM {p}ov)"""
    return s


DESC = {
    "TTC": "Temporal Topic Coherence - semantic consistency over time",
    "TTS": "Temporal Topic Smoothness - smooth evolution over time",
    "TTQ": "Temporal Topic Quality - TTC × TTS",
    "TC": "Topic Coherence - semantic coherence per time slice",
    "TD": "Topic Diversity - topic diversity per time slice",
    "TQ": "Topic Quality - TC × TD",
    "DTQ": "Dynamic Topic Quality - overall DTM quality measure",
}
DESC_CASE = "CASE metric " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DESC.items()) + " END"

for _v in "ABCD":
    _l = _v.lower()
    _c = f"WITH {TDOCS}, {dtm_ctes(_v)}"
    SQL[f"dtm_overall_{_l}"] = f"{_c} SELECT metric, round(value, 6) AS value, {DESC_CASE} AS description FROM m_overall"
    SQL[f"dtm_topic_time_{_l}"] = f"{_c} SELECT topic, t, round(ttc, 6) AS ttc, round(tts, 6) AS tts FROM m_topic_time"
    SQL[f"dtm_topic_{_l}"] = f"{_c} SELECT topic, round(ttq, 6) AS ttq FROM m_topic"
    SQL[f"dtm_time_{_l}"] = f"{_c} SELECT t, round(tc, 6) AS tc, round(td, 6) AS td, round(tq, 6) AS tq FROM m_time"

SQL["topic_word_grid"] = f"WITH {TDOCS}, {dtm_ctes('C')} SELECT topic, t, array_to_string(words, ', ') AS words FROM m_grid"
SQL["reference_corpus"] = f"WITH {TDOCS}, {dtm_ctes('A')} SELECT w FROM m_vocab"
SQL["topic_word_corpus"] = f"WITH {TDOCS}, {dtm_ctes('D')} SELECT doc_id, array_to_string(tokens, ' ') AS text FROM m_corpus"
SQL["pair_cooccurrence"] = f"WITH {TDOCS}, {dtm_ctes('A')} SELECT wi, wj, c_i, c_j, c_ij FROM m_cnts"
SQL["coherence_pmi"] = f"WITH {TDOCS}, {dtm_ctes('A')} SELECT wi, wj, round(score, 6) AS score FROM m_scores"
SQL["coherence_npmi"] = f"WITH {TDOCS}, {dtm_ctes('B')} SELECT wi, wj, round(score, 6) AS score FROM m_scores"
SQL["temporal_evolution"] = f"""WITH {TDOCS}, {dtm_ctes('A')}
SELECT t, round(avg(ttc), 6) AS mean_ttc, round(avg(tts), 6) AS mean_tts FROM m_topic_time GROUP BY t"""
SQL["integrated_profile"] = f"""WITH {TDOCS}, {ctfidf_ctes('td', 'quarter', 'q_')}, {dtm_ctes('D', ot='q_ot')}
SELECT o.topic, sum(frequency)::BIGINT AS frequency_sum, round(avg(frequency), 6) AS frequency_mean,
       count(DISTINCT timestamp) AS time_periods, min(timestamp) AS start_date, max(timestamp) AS end_date,
       round(coalesce(any_value(m.ttq), 0.0), 6) AS ttq,
       date_diff('day', CAST(min(timestamp) AS DATE), CAST(max(timestamp) AS DATE))::BIGINT AS duration_days
FROM q_ot o LEFT JOIN m_topic m USING (topic) WHERE o.topic <> -1 GROUP BY o.topic"""


# ------------------------------------------------------ sketches and vectors
TEXTDOCS = """docs AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'),
                                                     lambda t: t <> '') AS tokens FROM documents),
dfq AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM docs) GROUP BY term)"""


def sk_ctes(p, width, seeds, sign_seeds, signed, src="dfq"):
    vals = ", ".join(f"({r}, {s}, {g})" for r, (s, g) in enumerate(zip(seeds, sign_seeds)))
    val = "df * sign" if signed else "df"
    return f"""
{p}rows AS (SELECT * FROM (VALUES {vals}) t(row, seed, sign_seed)),
{p}tr AS (SELECT d.term, d.df, r.row,
                 ('0x' || substr(md5(CAST(r.seed AS VARCHAR) || ':' || d.term), 1, 8))::BIGINT % {width} AS bucket,
                 CASE WHEN ('0x' || substr(md5(CAST(r.sign_seed AS VARCHAR) || ':' || d.term), 1, 8))::BIGINT % 2 = 0
                      THEN 1 ELSE -1 END AS sign
          FROM {src} d CROSS JOIN {p}rows r),
{p}cells AS (SELECT row::BIGINT AS row, bucket, sum({val})::BIGINT AS cnt FROM {p}tr GROUP BY row, bucket HAVING sum({val}) <> 0),
{p}est AS (SELECT t.term, {'median(t.sign * coalesce(c.cnt, 0))' if signed else 'min(coalesce(c.cnt, 0))'}::DOUBLE AS estimate
           FROM {p}tr t LEFT JOIN {p}cells c ON c.row = t.row AND c.bucket = t.bucket GROUP BY t.term)"""


SKETCHES = (f"{TEXTDOCS}, {sk_ctes('cms_', 27183, [1, 2, 3, 4, 5], [1, 2, 3, 4, 5], False)}, "
            f"{sk_ctes('cs_', 10000, [1, 2, 3, 4, 5], [6, 7, 8, 9, 10], True)}")
SQL["cms_build"] = f"WITH {SKETCHES} SELECT row, bucket, cnt FROM cms_cells"
SQL["cs_build"] = f"WITH {SKETCHES} SELECT row, bucket, cnt FROM cs_cells"
SQL["cms_query"] = f"WITH {SKETCHES} SELECT term, estimate FROM cms_est"
SQL["cs_query"] = f"WITH {SKETCHES} SELECT term, estimate FROM cs_est"
# Merging the sketches of any split of the documents equals the one-shot build.
SQL["sketch_merge"] = SQL["cms_build"]

NDOCS = "(SELECT count(*) FROM docs)"


def bm25_idf(p):
    return (f"CASE WHEN {p} < 1 THEN 0.0 ELSE ln(({NDOCS} - least({p}, {NDOCS}) + 0.5) / "
            f"(least({p}, {NDOCS}) + 0.5 + 1e-9)) END")


SQL["sidf_weight"] = f"""WITH {SKETCHES}
SELECT a.term, round({bm25_idf('a.estimate')}, 6) AS bm25_cms, round({bm25_idf('b.estimate')}, 6) AS bm25_cs,
       round(CASE WHEN a.estimate < 1 THEN 0.0 ELSE ln({NDOCS} / a.estimate) END, 6) AS tfidf_cms
FROM cms_est a JOIN cs_est b USING (term)"""


def emb_ctes(model):
    if model == "bm25":
        tw = ("x.tf * 2.2::DOUBLE / CASE WHEN den > 0 THEN den ELSE 1.0 END")
        i1, i2 = bm25_idf("x.p_cms"), bm25_idf("x.p_cs")
    else:
        tw = "x.tf::DOUBLE"
        i1 = f"CASE WHEN x.p_cms > 0 THEN ln({NDOCS} / x.p_cms) ELSE 0.0 END"
        i2 = f"CASE WHEN x.p_cs > 0 THEN ln({NDOCS} / x.p_cs) ELSE 0.0 END"
    return f"""{SKETCHES},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM docs) GROUP BY doc_id, term),
avgdl AS (SELECT coalesce(sum(len(tokens)) / nullif(count(*), 0), 1.0) AS a FROM docs),
x0 AS (SELECT tf.doc_id, tf.term, tf.tf, len(d.tokens) AS dl, c.estimate AS p_cms, s.estimate AS p_cs
       FROM tf JOIN cms_est c USING (term) JOIN cs_est s USING (term) JOIN docs d USING (doc_id)),
x AS (SELECT *, tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT a FROM avgdl)) AS den FROM x0),
emb AS (SELECT doc_id, ('0x' || substr(md5('42:' || term), 1, 8))::BIGINT % 300 AS bucket,
               sum(({i1}) * ({tw})) AS w_cms, sum(({i2}) * ({tw})) AS w_cs
        FROM x GROUP BY doc_id, bucket)"""


SQL["embed_tfidf"] = f"WITH {emb_ctes('tfidf')} SELECT doc_id, bucket, round(w_cms, 6) AS weight FROM emb"
SQL["embed_bm25"] = f"WITH {emb_ctes('bm25')} SELECT doc_id, bucket, round(w_cms, 6) AS weight FROM emb"
SQL["embed_dual"] = f"""WITH {emb_ctes('bm25')}
SELECT doc_id, bucket, round(w_cms, 6) AS w_cms, round(w_cs, 6) AS w_cs FROM emb"""
SQL["embedding_pipeline"] = f"""WITH {emb_ctes('bm25')}
SELECT d.doc_id, 300::BIGINT AS dim, round(coalesce(sqrt(n.s), 0.0), 6) AS norm
FROM docs d LEFT JOIN (SELECT doc_id, sum(w_cms * w_cms) AS s FROM emb GROUP BY doc_id) n USING (doc_id)"""

VEC = """ev AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
nrm AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM ev GROUP BY vec_id),
evn AS (SELECT e.vec_id, e.i, e.x / CASE WHEN n.n = 0 THEN 1.0 ELSE n.n END AS x FROM ev e JOIN nrm n USING (vec_id))"""

SQL["normalize_vectors"] = f"WITH {VEC} SELECT vec_id, (i - 1)::BIGINT AS idx, round(x, 6) AS value FROM evn"


def knn_sql(src, dist, order):
    return f"""WITH {VEC},
q AS (SELECT * FROM {src} WHERE vec_id IN (0, 5)),
d AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id, {dist} AS dist
      FROM {src} e JOIN q ON q.i = e.i GROUP BY q.vec_id, e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9) {order}, neighbor_id) - 1 AS rank FROM d)
SELECT query_id, rank::BIGINT AS rank, neighbor_id, round(dist, 6) AS dist FROM r WHERE rank < 5"""


SQL["knn_l2"] = knn_sql("ev", "sum((e.x - q.x) * (e.x - q.x))", "ASC")
SQL["knn_cosine"] = knn_sql("evn", "sum(e.x * q.x)", "DESC")
SQL["knn_l2_blocks"] = SQL["knn_l2"]
SQL["knn_cosine_blocks"] = SQL["knn_cosine"]
SQL["farthest_k"] = knn_sql("ev", "sum((e.x - q.x) * (e.x - q.x))", "DESC")

H42 = "('0x' || substr(md5('{salt}:' || CAST(r AS VARCHAR)), 1, 8))::BIGINT"
SQL["distance_correlation"] = f"""WITH {emb_ctes('bm25')},
ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM docs),
draws AS (SELECT r, {H42.format(salt='42a')} % n AS a, {H42.format(salt='42b')} % (n - 1) AS step, n
          FROM range(1000) t(r), (SELECT count(*) AS n FROM docs)),
pairs AS (SELECT r, x.doc_id AS i, y.doc_id AS j FROM draws d JOIN ids x ON x.pos = d.a JOIN ids y ON y.pos = (d.a + 1 + d.step) % d.n),
nn AS (SELECT doc_id, sqrt(sum(w_cms * w_cms)) AS n1, sqrt(sum(w_cs * w_cs)) AS n2 FROM emb GROUP BY doc_id),
embn AS (SELECT e.doc_id, e.bucket, e.w_cms, e.w_cs,
                e.w_cms / CASE WHEN n.n1 = 0 THEN 1.0 ELSE n.n1 END AS u1,
                e.w_cs / CASE WHEN n.n2 = 0 THEN 1.0 ELSE n.n2 END AS u2
         FROM emb e JOIN nn n USING (doc_id)),
pe AS (SELECT p.r, e.bucket, e.w_cms AS a, e.w_cs AS b, e.u1, e.u2, 1 AS side FROM pairs p JOIN embn e ON e.doc_id = p.i
       UNION ALL
       SELECT p.r, e.bucket, -e.w_cms, -e.w_cs, e.u1, e.u2, 2 FROM pairs p JOIN embn e ON e.doc_id = p.j),
bk AS (SELECT r, bucket, sum(a) AS da, sum(b) AS db,
              coalesce(max(u1) FILTER (WHERE side = 1), 0) * coalesce(max(u1) FILTER (WHERE side = 2), 0) AS p1,
              coalesce(max(u2) FILTER (WHERE side = 1), 0) * coalesce(max(u2) FILTER (WHERE side = 2), 0) AS p2
       FROM pe GROUP BY r, bucket),
dd AS (SELECT p.r, coalesce(sqrt(sum(da * da)), 0.0) AS l1, coalesce(sqrt(sum(db * db)), 0.0) AS l2,
              1.0 - coalesce(sum(p1), 0.0) AS c1, 1.0 - coalesce(sum(p2), 0.0) AS c2
       FROM pairs p LEFT JOIN bk USING (r) GROUP BY p.r)
SELECT 'l2' AS metric, round(corr(l1, l2), 6) AS corr FROM dd
UNION ALL SELECT 'cosine', round(corr(c1, c2), 6) FROM dd"""


# ------------------------------------------------------------ pair builder
MF = """mf AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
lt AS (SELECT doc_id, flatten(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: l <> ''),
                                             lambda l: string_split(l, ' '))) AS t FROM mf),
tk AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS p FROM lt)"""


def ctx_sql(window):
    parts = []
    for d in range(1, window + 1):
        parts.append(f"SELECT a.doc_id, a.p AS pos, {-d} AS side, a.w AS center, b.w AS context FROM tk a "
                     f"JOIN tk b ON b.doc_id = a.doc_id AND b.p = a.p - {d}")
        parts.append(f"SELECT a.doc_id, a.p AS pos, {d} AS side, a.w AS center, b.w AS context FROM tk a "
                     f"JOIN tk b ON b.doc_id = a.doc_id AND b.p = a.p + {d}")
    return f"""ctx AS ({' UNION ALL '.join(parts)}),
pr AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, side) - 1 AS r, center, context
       FROM ctx WHERE context <> '')"""


NEG = [101, 102, 103, 104, 105]


def neg_sql():
    perms = []
    for k, s in enumerate(NEG):
        perms.append(f"""n{k} AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id
                       ORDER BY ('0x' || substr(md5('{s}:' || CAST(doc_id AS VARCHAR) || ':' || CAST(r AS VARCHAR)), 1, 8))::BIGINT, r) - 1 AS r,
                       context AS neg FROM pr)""")
    joins = " ".join(f"JOIN n{k} ON n{k}.doc_id = pr.doc_id AND n{k}.r = pr.r" for k in range(len(NEG)))
    cols = ", ".join(f"n{k}.neg AS neg_{k}" for k in range(len(NEG)))
    return ",\n".join(perms) + f""",
neg AS (SELECT pr.doc_id, pr.r, pr.center AS center_word, pr.context AS context_word, {cols} FROM pr {joins}),
lp AS (SELECT doc_id, r, 0::BIGINT AS slot, center_word, context_word, 1 AS label FROM neg
       {' '.join(f"UNION ALL SELECT doc_id, r, {k + 1}::BIGINT, center_word, neg_{k}, 0 FROM neg" for k in range(len(NEG)))})"""


SQL["manifest_filter"] = f"WITH {MF} SELECT doc_id, length(text)::BIGINT AS n_chars FROM mf"
SQL["file_batches"] = f"WITH {MF} SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS batch_id FROM mf"
SQL["sink_parquet_batches"] = f"""WITH {MF}, {ctx_sql(1)},
bt AS (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS batch_id FROM mf)
SELECT batch_id, count(*) AS n_pairs FROM pr JOIN bt USING (doc_id) GROUP BY batch_id"""
SQL["skipgram_pairs"] = f"WITH {MF}, {ctx_sql(1)} SELECT doc_id, r::BIGINT AS r, center AS center_word, context AS context_word FROM pr"
SQL["skipgram_window_n"] = f"WITH {MF}, {ctx_sql(2)} SELECT doc_id, r::BIGINT AS r, center AS center_word, context AS context_word FROM pr"
SQL["negative_samples"] = f"WITH {MF}, {ctx_sql(1)}, {neg_sql()} SELECT * FROM neg"
_bn = ",\n".join(f"""bn{k} AS (SELECT batch_id, row_number() OVER (PARTITION BY batch_id
  ORDER BY ('0x' || substr(md5('{s}:' || CAST(doc_id AS VARCHAR) || ':' || CAST(r AS VARCHAR)), 1, 8))::BIGINT, doc_id, r) - 1 AS row,
  context AS neg_{k} FROM bp)""" for k, s in enumerate(NEG))
SQL["negative_samples_batch"] = f"""WITH {MF}, {ctx_sql(1)},
bt AS (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS batch_id FROM mf),
bp AS (SELECT batch_id, doc_id, r, center, context, row_number() OVER (PARTITION BY batch_id ORDER BY doc_id, r) - 1 AS row
       FROM pr JOIN bt USING (doc_id)),
{_bn}
SELECT batch_id, row, doc_id, center AS center_word, context AS context_word, {', '.join(f'neg_{k}' for k in range(len(NEG)))}
FROM bp {' '.join(f'JOIN bn{k} USING (batch_id, row)' for k in range(len(NEG)))}"""
SQL["label_pairs"] = f"WITH {MF}, {ctx_sql(1)}, {neg_sql()} SELECT * FROM lp"
_hc = ", ".join([f"('0x' || substr(md5('{s}:' || center_word), 1, 8))::BIGINT AS centw_{i}" for i, s in enumerate(range(1, 11))]
                + [f"('0x' || substr(md5('{s}:' || context_word), 1, 8))::BIGINT AS contw_{i}" for i, s in enumerate(range(1, 11))])
SQL["hash_features"] = f"WITH {MF}, {ctx_sql(1)}, {neg_sql()} SELECT doc_id, r, slot, label, {_hc} FROM lp"
SQL["pmi_pairs"] = f"""WITH {MF}, {ctx_sql(1)},
cij AS (SELECT center AS center_word, context AS context_word, count(*) AS n_ij FROM pr GROUP BY ALL),
ci AS (SELECT center AS center_word, count(*) AS n_i FROM pr GROUP BY ALL),
cj AS (SELECT context AS context_word, count(*) AS n_j FROM pr GROUP BY ALL)
SELECT center_word, context_word, n_ij, round(ln((SELECT count(*) FROM pr) * n_ij / (n_i * n_j)), 6) AS pmi
FROM cij JOIN ci USING (center_word) JOIN cj USING (context_word)"""


# ------------------------------------------------------------ streaming
SQL["stream_clean"] = f"""WITH {CLEANED}
SELECT doc_id, clean FROM docs WHERE language = 'en' AND length(clean) >= 15"""
SQL["stream_language_counts"] = """
SELECT make_timestamp((floor(epoch_us(o.o_orderdate) / 2592000000000) * 2592000000000)::BIGINT) AS window_start,
       d.lang AS language, count(*) AS n
FROM documents d JOIN orders o ON d.doc_id = o.o_orderkey GROUP BY 1, 2"""
# Cells merged over micro-batches equal the one-shot build.
SQL["stream_sketch"] = SQL["cms_build"]


# ------------------------------------------------------------ model-based
SQL["topic_activity"] = f"""WITH {TDOCS},
th0 AS (SELECT doc_id, t AS topic,
               ((('0x' || substr(md5('theta:' || CAST(doc_id AS VARCHAR) || ':' || CAST(t AS VARCHAR)), 1, 8))::BIGINT % 1000) + 1)::DOUBLE AS r
        FROM td, range(0, 10) AS g(t)),
th AS (SELECT doc_id, topic, r / sum(r) OVER (PARTITION BY doc_id) AS weight FROM th0)
SELECT th.topic::BIGINT AS topic, td.quarter, round(avg(th.weight), 6) AS activity
FROM th JOIN td USING (doc_id) GROUP BY th.topic, td.quarter"""

SQL["cluster_quality"] = f"""WITH {TOPICS},
j AS (SELECT dt.topic, l.quality AS label FROM dt JOIN labels l USING (doc_id)),
ct AS (SELECT topic, label, count(*) AS n FROM j GROUP BY ALL),
tot AS (SELECT sum(n) AS n FROM ct),
nk AS (SELECT topic, sum(n) AS nk FROM ct GROUP BY topic),
nj AS (SELECT label, sum(n) AS nj FROM ct GROUP BY label),
hk AS (SELECT -sum(nk / (SELECT n FROM tot) * ln(nk / (SELECT n FROM tot))) AS v FROM nk),
hj AS (SELECT -sum(nj / (SELECT n FROM tot) * ln(nj / (SELECT n FROM tot))) AS v FROM nj),
mi AS (SELECT sum(ct.n / (SELECT n FROM tot) * ln((SELECT n FROM tot) * ct.n / (nk.nk * nj.nj))) AS v
       FROM ct JOIN nk USING (topic) JOIN nj USING (label))
SELECT 'purity' AS metric, round((SELECT sum(m) FROM (SELECT max(n) AS m FROM ct GROUP BY topic)) / (SELECT n FROM tot), 6) AS value
UNION ALL
SELECT 'nmi', round(CASE WHEN ((SELECT v FROM hk) + (SELECT v FROM hj)) / 2 > 0
                         THEN (SELECT v FROM mi) / (((SELECT v FROM hk) + (SELECT v FROM hj)) / 2) ELSE 0.0 END, 6)"""

SQL["topic_diversity"] = f"""WITH {TDOCS}, {TOPIC_WORDS}
SELECT round(coalesce(count(DISTINCT term) / nullif(count(term), 0), 0.0), 6) AS diversity FROM tw"""

SQL["joint_coherence"] = f"""WITH {TDOCS}, {TOPIC_WORDS},
corp AS (SELECT doc_id, list_filter(regexp_split_to_array(processed, '\\s+'), lambda x: x <> '') AS tokens,
                tokens AS vtokens FROM td),
{vocab_sql('j_', 'corp', 1, 1.0, 5000)},
w AS (SELECT DISTINCT topic, term AS w FROM tw WHERE term IN (SELECT w FROM j_vocab)),
nw AS (SELECT topic, count(*) AS n_w FROM w GROUP BY topic HAVING count(*) >= 2),
toks AS (SELECT doc_id, unnest(tokens) AS w FROM corp),
jf AS (SELECT w, count(*) / (SELECT count(*) FROM corp) AS f FROM toks WHERE w IN (SELECT w FROM w) GROUP BY w),
inc AS (SELECT DISTINCT doc_id, w FROM toks WHERE w IN (SELECT w FROM w)),
tg AS (SELECT topic, count(*) AS together FROM (
         SELECT w.topic, i.doc_id, count(*) AS c, any_value(nw.n_w) AS n_w FROM w JOIN nw USING (topic)
         JOIN inc i USING (w) GROUP BY w.topic, i.doc_id) WHERE c = n_w GROUP BY topic),
pr AS (SELECT w.topic, exp(sum(ln(jf.f))) AS prod FROM w JOIN nw USING (topic) JOIN jf USING (w) GROUP BY w.topic)
SELECT nw.topic, round(CASE WHEN coalesce(tg.together, 0) = 0 THEN 0.0
                       ELSE ln((tg.together / (SELECT count(*) FROM corp) + 1e-10) / (pr.prod + 1e-10)) END, 6) AS coherence
FROM nw LEFT JOIN tg USING (topic) JOIN pr USING (topic)"""


# ------------------------------------------------------------ sources and sinks
SQL["scan_comments_recovered"] = f"""WITH {COMMENTS}
SELECT doc_id, comment, published_at, language, platform, CAST(NULL AS VARCHAR) AS malformed FROM comments
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, doc_id || ',"never closed ' || language
FROM comments WHERE doc_id % 7 = 0 AND NOT contains(comment, chr(10))"""
SQL["scan_comments"] = f"WITH {COMMENTS} SELECT doc_id, comment, published_at, language, platform FROM comments"
SQL["scan_text_lines"] = """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars FROM l"""
SQL["scan_text_documents"] = """SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, length(text)::BIGINT AS n_chars FROM documents"""
SQL["scan_jsonlines"] = """SELECT CAST(l.quality AS VARCHAR) AS label, count(*) AS n
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1"""
SQL["persist_sketch"] = SQL["cms_query"]
SQL["persist_embeddings"] = f"""WITH {emb_ctes('bm25')}
SELECT d.doc_id, 'document ' || d.doc_id AS name, round(coalesce(sqrt(sum(w_cms * w_cms)), 0.0), 6) AS norm_cms,
       round(coalesce(sqrt(sum(w_cs * w_cs)), 0.0), 6) AS norm_cs
FROM docs d LEFT JOIN emb e USING (doc_id) GROUP BY d.doc_id"""


def _grams(src_cols, src):
    return f"""(SELECT {src_cols}, substr(t, i, 3) AS g FROM (
              SELECT {src_cols}, t, unnest(range(1, length(t) - 1)) AS i FROM {src}))"""


SQL["detect_language"] = f"""WITH
tr AS (SELECT lang, ' ' || regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') || ' ' AS t FROM documents),
tg AS (SELECT lang, g, count(*) AS c_lg FROM {_grams('lang', 'tr')} GROUP BY lang, g),
langs AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang),
tot AS (SELECT lang, sum(c_lg) AS t_l FROM tg GROUP BY lang),
pr AS (SELECT l.lang, ln(n_docs / (SELECT count(*) FROM documents)) AS base,
              ln(t_l + (SELECT count(DISTINCT g) FROM tg)) AS lt FROM langs l JOIN tot USING (lang)),
dq AS (SELECT conv_id || ':' || turn AS doc_id,
              ' ' || regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') || ' ' AS t FROM conversations),
dg AS (SELECT doc_id, g, count(*) AS c_g FROM {_grams('doc_id', 'dq')} GROUP BY doc_id, g),
known AS (SELECT * FROM dg WHERE g IN (SELECT g FROM tg)),
nk AS (SELECT doc_id, sum(c_g) AS n_known FROM known GROUP BY doc_id),
seen AS (SELECT k.doc_id, tg.lang, sum(k.c_g * ln(tg.c_lg + 1)) AS s FROM known k JOIN tg USING (g) GROUP BY k.doc_id, tg.lang),
grid AS (SELECT d.doc_id, p.lang, p.base, p.lt FROM (SELECT DISTINCT doc_id FROM dq) d CROSS JOIN pr p),
sc AS (SELECT g.doc_id, g.lang, coalesce(nk.n_known, 0) AS n_known,
              g.base + coalesce(seen.s, 0) - coalesce(nk.n_known, 0) * g.lt AS score
       FROM grid g LEFT JOIN nk USING (doc_id) LEFT JOIN seen USING (doc_id, lang)),
sm AS (SELECT *, exp(score - max(score) OVER (PARTITION BY doc_id)) AS p FROM sc),
cf AS (SELECT *, p / sum(p) OVER (PARTITION BY doc_id) AS conf,
              row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, lang) AS rk FROM sm)
SELECT CAST(split_part(doc_id, ':', 1) AS BIGINT) AS conv_id, CAST(split_part(doc_id, ':', 2) AS BIGINT) AS turn, CASE WHEN n_known = 0 THEN 'unknown' ELSE lang END AS language,
       CASE WHEN n_known = 0 THEN 0.0 ELSE round(conf, 6) END AS confidence FROM cf WHERE rk = 1"""

_A = f"WITH {TDOCS}, {dtm_ctes('A')}"
SQL["quality_bands"] = f"""{_A},
v AS (SELECT metric, value FROM m_overall)
SELECT metric, round(value, 6) AS value,
       CASE metric WHEN 'DTQ' THEN CASE WHEN value > 0.7 THEN 'Excellent' WHEN value > 0.5 THEN 'Good'
                                        WHEN value > 0.3 THEN 'Moderate' ELSE 'Poor' END
                   WHEN 'TTC' THEN CASE WHEN value > 0.1 THEN 'High' WHEN value > 0.05 THEN 'Medium' ELSE 'Low' END
                   WHEN 'TTS' THEN CASE WHEN value > 0.5 THEN 'High' WHEN value > 0.3 THEN 'Medium' ELSE 'Low' END
                   WHEN 'TTQ' THEN CASE WHEN value > 0.5 THEN 'Excellent' WHEN value > 0.3 THEN 'Good'
                                        WHEN value > 0.1 THEN 'Moderate' ELSE 'Poor' END END AS band
FROM v
UNION ALL SELECT 'advice_DTQ', round(value, 6),
          CASE WHEN value > 0.7 THEN 'Continue using current parameters'
               WHEN value > 0.5 THEN 'Consider fine-tuning parameters for potential improvements'
               WHEN value > 0.3 THEN 'Consider adjusting model parameters, preprocessing steps, or number of topics'
               ELSE 'Review data preprocessing, model parameters, and topic number selection' END FROM v WHERE metric = 'DTQ'
UNION ALL SELECT 'advice_TTC', round(value, 6), 'Consider improving topic coherence across time' FROM v
          WHERE metric = 'TTC' AND value < 0.05
UNION ALL SELECT 'advice_TTS', round(value, 6), 'Topics change significantly over time' FROM v
          WHERE metric = 'TTS' AND value < 0.3"""

SQL["rank_topics_and_slices"] = f"""{_A}
SELECT 'topic' AS kind, row_number() OVER (ORDER BY round(ttq, 10) DESC, topic)::BIGINT AS rank, topic::BIGINT AS id,
       round(ttq, 6) AS value FROM m_topic QUALIFY rank <= 10
UNION ALL
SELECT 'slice', row_number() OVER (ORDER BY round(tq, 10) DESC, t)::BIGINT, t::BIGINT, round(tq, 6) FROM m_time
QUALIFY row_number() OVER (ORDER BY round(tq, 10) DESC, t) <= 5"""


_C = f"WITH {TDOCS}, {dtm_ctes('C')},"
DYN = f"""{_C}
dc AS (SELECT td.doc_id, st.t, list_filter(regexp_split_to_array(td.processed, '\\s+'), lambda x: x <> '') AS tokens
       FROM td JOIN m_st st ON st.timestamp = td.quarter),
dinc AS (SELECT DISTINCT t, doc_id, w FROM (SELECT t, doc_id, unnest(tokens) AS w FROM dc) WHERE w IN (SELECT w FROM m_needed)),
dpairs AS (SELECT topic, t, wi, wj FROM m_tc_rows WHERE wi IN (SELECT w FROM m_needed) AND wj IN (SELECT w FROM m_needed)),
dco AS (SELECT p.t, p.wi, p.wj, count(*) AS c_ij FROM (SELECT DISTINCT t, wi, wj FROM dpairs) p
        JOIN dinc a ON a.t = p.t AND a.w = p.wi JOIN dinc b ON b.t = p.t AND b.doc_id = a.doc_id AND b.w = p.wj
        GROUP BY p.t, p.wi, p.wj),
dci AS (SELECT t, w, count(*) AS c FROM dinc GROUP BY t, w),
dn AS (SELECT t, count(*) AS n FROM dc GROUP BY t),
dsc AS (SELECT co.t, co.wi, co.wj,
               CASE WHEN co.c_ij / dn.n >= 1.0 THEN 1.0
                    ELSE ln((co.c_ij / dn.n) / ((a.c / dn.n) * (b.c / dn.n) + 1e-10)) / (-ln(co.c_ij / dn.n + 1e-10)) END AS score
        FROM dco co JOIN dci a ON a.t = co.t AND a.w = co.wi JOIN dci b ON b.t = co.t AND b.w = co.wj JOIN dn ON dn.t = co.t),
dcell AS (SELECT p.topic, p.t, avg(s.score) AS tc FROM dpairs p JOIN dsc s USING (t, wi, wj) GROUP BY p.topic, p.t)"""
SQL["dynamic_coherence"] = f"""{DYN}
SELECT g.t, g.topic, round(coalesce(c.tc, 0.0), 6) AS tc FROM m_grid g LEFT JOIN dcell c USING (topic, t) WHERE len(g.words) > 0"""
SQL["dynamic_diversity"] = f"""{_C}
dc AS (SELECT st.t, unnest(list_filter(regexp_split_to_array(td.processed, '\\s+'), lambda x: x <> '')) AS w
       FROM td JOIN m_st st ON st.timestamp = td.quarter),
sw AS (SELECT DISTINCT t, w FROM dc),
gw2 AS (SELECT g.t, g.w FROM m_gw g WHERE EXISTS (SELECT 1 FROM sw WHERE sw.t = g.t AND sw.w = g.w))
SELECT t, round(count(DISTINCT w) / count(*), 6) AS td FROM gw2 GROUP BY t"""


SQL["platform_comparison"] = f"""WITH {TDOCS},
tdy AS (SELECT * FROM td WHERE platform = 'YouTube'), tdt AS (SELECT * FROM td WHERE platform = 'Telegram'),
{dtm_ctes('D', src='tdy', p='y_')}, {dtm_ctes('D', src='tdt', p='t_')}
SELECT coalesce(y.metric, t.metric) AS metric, round(y.value, 4) AS youtube, round(t.value, 4) AS telegram
FROM y_overall y FULL OUTER JOIN t_overall t ON y.metric = t.metric"""

SQL["combined_report"] = f"""WITH {TDOCS}, {ctfidf_ctes('td', 'quarter', 'q_')}, {dtm_ctes('C', ot='q_ot')},
ov AS (SELECT max(value) FILTER (WHERE metric = 'TTC') AS overall_ttc, max(value) FILTER (WHERE metric = 'TTS') AS overall_tts,
              max(value) FILTER (WHERE metric = 'TTQ') AS overall_ttq, max(value) FILTER (WHERE metric = 'TC') AS overall_tc,
              max(value) FILTER (WHERE metric = 'TD') AS overall_td, max(value) FILTER (WHERE metric = 'TQ') AS overall_tq,
              max(value) FILTER (WHERE metric = 'DTQ') AS overall_dtq FROM m_overall)
SELECT o.topic, o.timestamp, array_to_string(o.words, ', ') AS words, o.frequency,
       round(tm.tc, 6) AS tc, round(tm.td, 6) AS td, round(tm.tq, 6) AS tq, round(tp.ttq, 6) AS ttq,
       round(tt.ttc, 6) AS ttc, round(tt.tts, 6) AS tts,
       round(ov.overall_ttc, 6) AS overall_ttc, round(ov.overall_tts, 6) AS overall_tts, round(ov.overall_ttq, 6) AS overall_ttq,
       round(ov.overall_tc, 6) AS overall_tc, round(ov.overall_td, 6) AS overall_td, round(ov.overall_tq, 6) AS overall_tq,
       round(ov.overall_dtq, 6) AS overall_dtq
FROM q_ot o JOIN m_st st USING (timestamp) LEFT JOIN m_time tm ON tm.t = st.t LEFT JOIN m_topic tp ON tp.topic = o.topic
LEFT JOIN m_topic_time tt ON tt.topic = o.topic AND tt.t = st.t CROSS JOIN ov"""
SQL["stream_sketch_ledger"] = SQL["cms_build"]
SQL["stream_windows_append"] = """
WITH e AS (SELECT event_id, ts, event_type, least(4, (day(ts) - 1) // 6) AS due FROM events),
a AS (SELECT *, date_trunc('day', ts) AS s, date_trunc('day', ts) + INTERVAL 1 DAY AS z,
             CASE WHEN event_id % 97 = 0 AND due < 3 THEN 4 ELSE due END AS arrival FROM e),
m AS (SELECT max(ts) FILTER (WHERE arrival < 3) - INTERVAL 3 DAY AS before_last, max(ts) - INTERVAL 3 DAY AS final FROM a),
l AS (SELECT a.*, arrival = 4 AND z <= before_last AS late, z <= final AS closed FROM a, m)
SELECT CAST(s AS TIMESTAMP) AS window_start, CAST(z AS TIMESTAMP) AS window_end, event_type AS key, count(*) AS n, closed
FROM l WHERE NOT late GROUP BY ALL
UNION ALL SELECT NULL, NULL, 'late', count(*) FILTER (WHERE late), NULL FROM l"""
SQL["topic_bundle"] = f"""WITH {PREPARED}
SELECT doc_id, t, 20::BIGINT AS n_topics, 1.0::DOUBLE AS total, TRUE AS same FROM ps WHERE split = 'test'"""
_w20 = f"({TOK['tokenize_words']('comment')})[1:20]"
SQL["sink_csv"] = f"""WITH {COMMENTS}, w AS (SELECT doc_id, platform, {_w20} AS w FROM comments)
SELECT doc_id, platform, CASE WHEN len(w) > 0 THEN array_to_string(w, ', ') END AS words FROM w"""
SQL["sink_json"] = f"""WITH {COMMENTS}, w AS (SELECT doc_id, platform, {_w20} AS w FROM comments)
SELECT doc_id, platform, len(w)::BIGINT AS n_words, array_to_string(w, '|') AS words FROM w"""
SQL["parse_time_strict"] = f"""WITH {COMMENTS}
SELECT doc_id, date_trunc('second', published_at) AS parsed FROM comments WHERE published_at IS NOT NULL"""
SQL["parse_topic_words"] = f"""WITH {COMMENTS},
w AS (SELECT doc_id, list_transform(string_split({_nz('comment')}, ','), lambda x: trim(x, ' ')) AS w FROM comments)
SELECT doc_id, array_to_string((list_filter(list_transform(w, lambda x: CASE WHEN starts_with(x, 'the ') THEN substr(x, 5) ELSE x END),
                                            lambda x: x <> ''))[1:10], '|') AS words FROM w"""
SQL["add_model_prefix"] = f"""WITH {COMMENTS}
SELECT doc_id, md5('clustering: ' || {CLEAN['clean_letters_normalized']('comment')}) AS digest FROM comments"""
