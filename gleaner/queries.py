"""Registered queries over the retrieval operators, and the SQL that each must equal.

The collection is the reports of ``reuters`` (title, line break, body), the query batch all items of
``benchmark``, the category map ``doc_categories``. Scores are rounded to six places, language
models compared by logarithms, and the SQL repeats the token rules with RE2.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import stemming, stemming_sql, text
from gleaner.operators import feedback, index as ix, lexicon, phrases, ranking, summary
from gleaner.operators.candidates import tier_filter
from gleaner.plans.search import Searcher
from gleaner.runtime import cut, scratch_dir, still_there
from gleaner.sources import sgml
from gleaner.sources.tables import distinct_by, stamp, table

TOP = 10
PATTERNS = ("pro*", "*tion", "m*er", "pen*ty", "re*ed")
MISSPELT = ("takeovr bid markit", "quartely prafit", "reffinery turbin", "vacine tryal")

_made: dict = {}


def corpus(spark: SparkSession, d: str) -> DataFrame:
    reports = distinct_by(table(spark, d, "reuters"), "newid", "title", "body")
    return reports.select(F.col("newid").alias("doc_id"), sgml.joined(F.col("title"), F.col("body")).alias("text"))


def workload(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def searcher(spark: SparkSession, d: str) -> Searcher:
    """The index of a collection, built once a session and state of its files."""
    return _once(spark, d, "index", lambda: Searcher(ix.Index.build(corpus(spark, d))), lambda s: s.index.postings)


def stemmed_searcher(spark: SparkSession, d: str) -> Searcher:
    return _once(spark, d, "stemmed index", lambda: Searcher(ix.Index.build(corpus(spark, d), use_stem=True)), lambda s: s.index.postings)


def _once(spark: SparkSession, d: str, name: str, make, table_of=lambda x: x):
    key = (spark.sparkContext.applicationId, d, name, stamp(spark, d, "reuters"), stamp(spark, d, "benchmark"))
    if key not in _made or not still_there(table_of(_made[key])):
        _made[key] = make()
    return _made[key]


def _query(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "query", lambda: cut(ix.query_terms(workload(spark, d))))


def _made_rows(spark: SparkSession, values: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(values, 1)], schema)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return register


# ---- the same analysis in SQL


def _sql_tokens(expression: str) -> str:
    for pattern, new in text.TOKEN_STEPS:
        escaped = pattern.replace("'", "''")
        expression = f"regexp_replace({expression}, '{escaped}', '{new.replace('$', chr(92))}', 'g')"
    return f"list_filter(regexp_split_to_array({expression}, '{text.BLANK}+'), lambda w: w <> '')"


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _sql_terms(expression: str) -> str:
    return f"list_filter({_sql_tokens(f'lower({expression})')}, lambda w: regexp_full_match(w, '\\p{{L}}+') AND w NOT IN ({_STOP}))"


_DOCS = """docs AS (SELECT newid AS doc_id, CASE WHEN coalesce(title, '') = '' OR coalesce(body, '') = '' THEN coalesce(title, '') || coalesce(body, '')
  ELSE title || chr(10) || body END AS text FROM (SELECT newid, any_value(title) AS title, any_value(body) AS body FROM reuters WHERE newid IS NOT NULL GROUP BY newid))"""
_BASE = f"""WITH {_DOCS},
arrs AS (SELECT doc_id, {_sql_terms('text')} AS terms FROM docs),
tok AS (SELECT doc_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS pos FROM arrs),
tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, len(terms) AS len FROM arrs),
dfs AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term),
st AS (SELECT count(*) AS n_docs, CAST(sum(len) AS BIGINT) AS total_len, avg(len) AS avgdl, (SELECT count(*) FROM dfs) AS n_terms FROM dl),
post AS (SELECT term, doc_id, tf, len, df, tf >= 5 AS is_high FROM tf JOIN dl USING (doc_id) JOIN dfs USING (term)),
qarr AS (SELECT item_id AS qid, {_sql_terms('text')} AS terms FROM benchmark),
qtok AS (SELECT qid, unnest(terms) AS term FROM qarr),
q AS (SELECT qid, term, CAST(count(*) AS DOUBLE) AS weight FROM qtok GROUP BY ALL),
nq AS (SELECT qid, count(*) AS n_query FROM q GROUP BY qid),
okapi AS (SELECT qid, doc_id, sum(log10(n_docs / CAST(df AS DOUBLE)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM post JOIN q USING (term), st GROUP BY ALL),
top AS (SELECT qid, rank, doc_id, score FROM (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM okapi) WHERE rank <= {TOP})
"""


# ---- text analysis


@query(f"WITH {_DOCS}, t AS (SELECT doc_id, {_sql_tokens('text')} AS a FROM docs) SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS token FROM t")
def tokenize(spark, d):
    rows = corpus(spark, d).select("doc_id", text.tokenize(F.col("text")).alias("a"))
    return rows.select("doc_id", F.posexplode_outer("a").alias("pos", "token")).where("token is not null")


@query(f"WITH {_DOCS}, t AS (SELECT DISTINCT unnest({_sql_tokens('lower(text)')}) AS word FROM docs) SELECT word, regexp_full_match(word, '\\p{{L}}+') AND word NOT IN ({_STOP}) AS apt FROM t")
def apt_filter(spark, d):
    words = corpus(spark, d).select(F.explode_outer(text.tokenize(F.lower("text"))).alias("word")).where("word is not null").distinct()
    return words.select("word", text.is_apt(F.col("word")).alias("apt"))


@query(_BASE + "SELECT doc_id, CAST(pos AS INTEGER) AS pos, term FROM tok")
def preprocess(spark, d):
    return text.exploded(text.with_terms(corpus(spark, d)))


@query(f"WITH {_DOCS} SELECT doc_id, regexp_replace(regexp_replace(text, '[’”“]', ' ', 'g'), '{text.BLANK}+', ' ', 'g') AS text FROM docs")
def clean_text(spark, d):
    return corpus(spark, d).select("doc_id", text.clean_text(F.col("text")).alias("text"))


_CLEAN = f"regexp_replace(regexp_replace(text, '[’”“]', ' ', 'g'), '{text.BLANK}+', ' ', 'g')"
_SENTENCES = f"list_filter(string_split(regexp_replace({_CLEAN}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


@query(f"WITH {_DOCS}, t AS (SELECT doc_id, {_SENTENCES} AS a FROM docs) SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS sentence FROM t")
def sentences(spark, d):
    return corpus(spark, d).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


_KNOWN = "|".join(a.replace(".", r"\.") for a in text.ABBREVIATIONS)
_WITH_ABBREVIATIONS = rf"regexp_replace(regexp_replace({_CLEAN}, '([.!?]) ', '\1' || chr(1), 'g'), '(?i)(^|[^\p{{L}}.])({_KNOWN}|\p{{L}})\.\x01', '\1\2. ', 'g')"


@query(f"WITH {_DOCS}, t AS (SELECT doc_id, list_filter(string_split({_WITH_ABBREVIATIONS}, chr(1)), lambda s: trim(s) <> '') AS a FROM docs) SELECT doc_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS sentence FROM t")
def sentences_abbreviated(spark, d):
    """With breaks behind abbreviations taken back."""
    return corpus(spark, d).select("doc_id", F.posexplode(text.sentences(F.col("text"), abbreviations=True)).alias("pos", "sentence"))


# ---- index and statistics


@query(_BASE + "SELECT term, doc_id, tf FROM tf")
def term_freq(spark, d):
    return ix.term_freq(text.exploded(text.with_terms(corpus(spark, d))))


@query(_BASE + "SELECT term, df, cf FROM dfs")
def doc_freq(spark, d):
    return searcher(spark, d).index.terms


@query(_BASE + "SELECT doc_id, len FROM dl")
def doc_length(spark, d):
    return searcher(spark, d).index.lengths


@query(_BASE + "SELECT n_docs, total_len, round(avgdl, 6) AS avgdl, n_terms FROM st")
def corpus_stats(spark, d):
    return _round(searcher(spark, d).index.stats_row(spark), "avgdl")


@query(_BASE + "SELECT term AS word, cf AS freq FROM dfs")
def dictionary(spark, d):
    return searcher(spark, d).index.dictionary()


@query(_BASE + "SELECT term, doc_id, tf, len, df, is_high FROM post")
def inverted_index(spark, d):
    return searcher(spark, d).index.postings.select("term", "doc_id", "tf", "len", "df", "is_high")


@query(_BASE + "SELECT term, doc_id, tf FROM post")
def index_roundtrip(spark, d):
    """Written, checked by its fingerprint and read again."""
    index = searcher(spark, d).index
    path, mark = f"{scratch_dir(spark)}/gleaner/index-{uuid.uuid5(uuid.NAMESPACE_URL, spark.sparkContext.applicationId + d).hex}", ix.fingerprint(index.documents, high_tf=ix.HIGH_TF)
    index.save(path, mark)
    return ix.Index.load(spark, path, mark).postings.select("term", "doc_id", "tf")


@query(_BASE + "SELECT term, count(*) FILTER (WHERE is_high) AS n_high, count(*) FILTER (WHERE NOT is_high) AS n_low, df FROM post GROUP BY term, df")
def high_low_index(spark, d):
    rows = searcher(spark, d).index.postings.groupBy("term", "df")
    return rows.agg(F.count_if("is_high").alias("n_high"), F.count_if(~F.col("is_high")).alias("n_low"))


@query("SELECT category, doc_id, count(*) AS n FROM doc_categories WHERE category IS NOT NULL GROUP BY ALL")
def categories(spark, d):
    return sgml.category_map(table(spark, d, "doc_categories"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """The reports as markup, with references for the reserved characters and for é."""

    def esc(c):
        c = F.col(c) if isinstance(c, str) else c
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("é", "&#233;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return F.coalesce(c, F.lit(""))

    reports = distinct_by(table(spark, d, "reuters"), "newid", "title", "body", *sgml.TAGS)
    tags = [F.concat(F.lit(f"<{t}>"), F.array_join(F.transform(F.filter(F.coalesce(t, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("<D>"), esc(x), F.lit("</D>"))), ""), F.lit(f"</{t}>")) for t in sgml.TAGS]
    return reports.select(F.concat(F.lit('<REUTERS OLDID="1" NEWID="'), F.col("newid"), F.lit('">'), *tags, F.lit("<TITLE>"), esc("title"), F.lit("</TITLE><BODY>"), esc("body"), F.lit("</BODY>")).alias("element"))


@query(f"WITH {_DOCS} SELECT doc_id, text FROM docs")
def parse_docs(spark, d):
    return sgml.documents(_elements(spark, d))


@query(f"WITH {_DOCS} SELECT doc_id, text FROM docs")
def scan_sgml(spark, d):
    """Written as markup files, scanned and parsed again."""
    path = f"{scratch_dir(spark)}/gleaner/sgml-{uuid.uuid4().hex}"
    sgml.write(_elements(spark, d), path)
    return sgml.documents(sgml.scan(spark, path, "part-*"))


@query(" UNION ALL ".join(f"SELECT unnest(x) AS category, newid AS doc_id FROM (SELECT newid, any_value({t}) AS x FROM reuters WHERE newid IS NOT NULL GROUP BY newid)" for t in sgml.TAGS).join(("SELECT * FROM (", ") WHERE category IS NOT NULL")))
def extract_categories(spark, d):
    return sgml.categories(_elements(spark, d))


# ---- lexicon


@query(_BASE + "SELECT unnest(list_transform(range(1, length(term) + 2), lambda i: substring('$' || term || '$', CAST(i AS INTEGER), 2))) AS gram, term AS word FROM dfs")
def kgram_index(spark, d):
    return searcher(spark, d).kgrams


def _sql_soundex(w: str) -> str:
    x = f"translate(substring({w}, 2), '{text.SOUNDEX_LETTERS}', '{text.SOUNDEX_DIGITS}')"
    for k in "0123456":
        x = f"regexp_replace({x}, '{k}+', '{k}', 'g')"
    for k in "123456":
        x = f"regexp_replace({x}, '{k}0{k}$', '{k}')"
    return f"CASE WHEN regexp_full_match({w}, '.[a-z]*') THEN rpad(substring({w}, 1, 1) || substring(replace({x}, '0', ''), 1, 3), 4, '0') END"


@query(_BASE + f"SELECT term AS word, {_sql_soundex('term')} AS code FROM dfs")
def soundex_code(spark, d):
    return searcher(spark, d).dictionary.select("word", text.soundex(F.col("word")).alias("code"))


@query(_BASE + f", s AS (SELECT term AS word, {_sql_soundex('term')} AS code FROM dfs) SELECT code, word FROM s WHERE code IS NOT NULL")
def soundex_index(spark, d):
    return searcher(spark, d).soundex


@query(_BASE + " UNION ALL ".join(f"SELECT '{p}' AS pattern, term AS word FROM dfs WHERE regexp_full_match(term, '{p.replace('*', '.*')}')" for p in PATTERNS))
def wildcard(spark, d):
    s = searcher(spark, d)
    return lexicon.wildcard_options(s.kgrams, _made_rows(spark, PATTERNS, "n int, pattern string").select("pattern"))


@query(
    _BASE + ", m AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, t in enumerate(MISSPELT, 1) for w in t.split()) + ") v(qid, word)), "
    f"u AS (SELECT DISTINCT CAST(qid AS BIGINT) AS qid, word, {_sql_soundex('word')} AS code FROM m WHERE word NOT IN (SELECT term FROM dfs)), "
    f"s AS (SELECT term, {_sql_soundex('term')} AS code FROM dfs) SELECT qid, word, term AS suggestion FROM u JOIN s USING (code)"
)
def soundex_suggest(spark, d):
    s = searcher(spark, d)
    return lexicon.soundex_suggestions(s.analyse(_made_rows(spark, MISSPELT, "qid long, text string")), s.index.terms, s.soundex)


_BATCH = (*PATTERNS, *MISSPELT)


@query(
    _BASE + ", m AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, t in enumerate(_BATCH, 1) for w in t.split() if "*" not in w) + ") v(qid, word)), "
    f"u AS (SELECT DISTINCT CAST(qid AS BIGINT) AS qid, word, {_sql_soundex('word')} AS code FROM m WHERE word NOT IN (SELECT term FROM dfs)), s AS (SELECT term, {_sql_soundex('term')} AS code FROM dfs), w AS ("
    + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS qid, 'wildcard' AS kind, '{p}' AS word, term AS suggestion FROM dfs WHERE regexp_full_match(term, '{p.replace('*', '.*')}')" for i, p in enumerate(_BATCH, 1) if "*" in p)
    + ") SELECT * FROM w UNION ALL SELECT qid, 'soundex', word, term FROM u JOIN s USING (code)"
)
def suggestions(spark, d):
    """Both kinds for one batch."""
    return searcher(spark, d).suggestions(_made_rows(spark, _BATCH, "qid long, text string"))


# ---- scorers


@query(_BASE + "SELECT qid, doc_id, round(score, 6) AS score FROM okapi")
def bm25(spark, d):
    return _round(ranking.bm25(searcher(spark, d).index, _query(spark, d)), "score")


_COSINE = "SELECT qid, doc_id, round(sum(tf * weight * log10(n_docs / CAST(df AS DOUBLE)) * log10(n_docs / CAST(df AS DOUBLE))) / any_value(len), 6) AS score FROM post JOIN q USING (term), st {} GROUP BY ALL"


@query(_BASE + _COSINE.format(""))
def tfidf_cosine(spark, d):
    return _round(ranking.tfidf_length_norm(searcher(spark, d).index, _query(spark, d)), "score")


@query(_BASE + "SELECT qid, doc_id, round(sum(log10(n_docs / CAST(df AS DOUBLE)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM post JOIN q USING (term), st WHERE is_high GROUP BY ALL")
def bm25_high(spark, d):
    return _round(ranking.bm25(searcher(spark, d).index, _query(spark, d), high_only=True), "score")


@query(_BASE + _COSINE.format("WHERE is_high"))
def cosine_high(spark, d):
    return _round(ranking.tfidf_length_norm(searcher(spark, d).index, _query(spark, d), high_only=True), "score")


_TIERS = f""", td AS (SELECT qid, doc_id, count(*) AS n, count(*) FILTER (WHERE is_high) AS h, any_value(n_query) AS m FROM post JOIN q USING (term) JOIN nq USING (qid) GROUP BY ALL),
tc AS (SELECT qid, CASE WHEN count(*) FILTER (WHERE h = m) >= {TOP} THEN 1 WHEN count(*) FILTER (WHERE n = m) >= {TOP} THEN 2 WHEN count(*) FILTER (WHERE h > 0) >= {TOP} THEN 3 ELSE 4 END AS tier FROM td GROUP BY qid),
tiers AS (SELECT qid, CAST(tier AS BIGINT) AS tier, doc_id FROM td JOIN tc USING (qid) WHERE tier = 4 OR (tier = 1 AND h = m) OR (tier = 2 AND n = m) OR (tier = 3 AND h > 0))
"""


@query(_BASE + _TIERS + "SELECT qid, tier, doc_id FROM tiers", name="tier_filter")
def candidate_tiers(spark, d):
    return tier_filter(searcher(spark, d).index, _query(spark, d), TOP)


def _matching(spark, d):
    return ranking.matched(searcher(spark, d).index, _query(spark, d)).select("qid", "doc_id").distinct()


_LM = """SELECT qid, doc_id, round(sum(ln((0.1 + coalesce(tf, 0)) / (len + 0.1 * n_terms))), 6) AS log_score
FROM (SELECT DISTINCT qid, doc_id FROM {}) c JOIN q USING (qid) JOIN dl USING (doc_id) LEFT JOIN tf USING (term, doc_id), st GROUP BY ALL"""


@query(_BASE + _LM.format("okapi"))
def lm_additive(spark, d):
    return _round(ranking.lm_additive(searcher(spark, d).index, _query(spark, d), _matching(spark, d)), "log_score")


@query(
    _BASE + """SELECT qid, doc_id, CASE WHEN count(cf) = count(*) THEN round(sum(ln(0.5 * coalesce(tf, 0) / len + 0.5 * cf / CAST(total_len AS DOUBLE))), 6) END AS log_score
FROM (SELECT DISTINCT qid, doc_id FROM okapi) c JOIN q USING (qid) JOIN dl USING (doc_id) LEFT JOIN dfs USING (term) LEFT JOIN tf USING (term, doc_id), st GROUP BY ALL"""
)
def lm_jm(spark, d):
    return _round(ranking.lm_jelinek_mercer(searcher(spark, d).index, _query(spark, d), _matching(spark, d)), "log_score")


@query(_BASE + _TIERS + _LM.format("tiers"))
def inexact_lm(spark, d):
    index, q = searcher(spark, d).index, _query(spark, d)
    return _round(ranking.lm_additive(index, q, tier_filter(index, q, TOP)), "log_score")


_CATS = """, cats AS (SELECT category, doc_id FROM doc_categories WHERE category IS NOT NULL AND doc_id IS NOT NULL),
cl AS (SELECT category, CAST(sum(len) AS DOUBLE) AS len FROM cats JOIN dl USING (doc_id) GROUP BY category),
ct AS (SELECT qid, category, term, CAST(sum(tf) AS DOUBLE) AS tf FROM post JOIN q USING (term) JOIN cats USING (doc_id) GROUP BY ALL),
cq AS (SELECT DISTINCT qid, category FROM ct)
"""
_CAT_ROWS = "FROM cq JOIN q USING (qid) JOIN cl USING (category) LEFT JOIN ct USING (qid, category, term), st WHERE cl.len > 0 GROUP BY ALL"


@query(_BASE + _CATS + "SELECT qid, category, round(sum(ln((0.1 + coalesce(ct.tf, 0)) / (cl.len + 0.1 * n_terms))), 6) AS log_score " + _CAT_ROWS)
def category_lm_additive(spark, d):
    return _round(ranking.category_lm_additive(searcher(spark, d).index, _query(spark, d), table(spark, d, "doc_categories").select("category", "doc_id")), "log_score")


@query(_BASE + _CATS + "SELECT qid, category, round(sum(ln((0.1 + coalesce(ct.tf, 0)) / cl.len + 0.1 * n_terms)), 6) AS log_score " + _CAT_ROWS)
def category_lm_additive_compat(spark, d):
    return _round(ranking.category_lm_additive(searcher(spark, d).index, _query(spark, d), table(spark, d, "doc_categories").select("category", "doc_id"), compat=True), "log_score")


@query(
    _BASE + _CATS + """SELECT qid, category, CASE WHEN count(cf) = count(*) THEN round(sum(ln(0.5 * coalesce(ct.tf, 0) / cl.len + 0.5 * cf / CAST(total_len AS DOUBLE))), 6) END AS log_score
FROM cq JOIN q USING (qid) JOIN cl USING (category) LEFT JOIN dfs USING (term) LEFT JOIN ct USING (qid, category, term), st WHERE cl.len > 0 GROUP BY ALL"""
)
def category_lm_jm(spark, d):
    return _round(ranking.category_lm_jelinek_mercer(searcher(spark, d).index, _query(spark, d), table(spark, d, "doc_categories").select("category", "doc_id")), "log_score")


# ---- phrases


def _sql_pmi(n: int, freq: int, least: float, arrs: str = "arrs", key: str = "doc_id") -> str:
    words = [f"x[{j + 1}]" for j in range(n)]
    counts = " * ".join(f"len(list_filter(terms, lambda w: w = gram[{j + 1}]))" for j in range(n))
    return f"""SELECT {key}, gram, tf, log2(tf * CAST(len(terms) AS DOUBLE) ** {n - 1} / ({counts})) AS pmi FROM (
  SELECT {key}, gram, count(*) AS tf, any_value(terms) AS terms FROM (SELECT {key}, terms, unnest(list_transform(range(1, len(terms) - {n - 2}), lambda i: list_slice(terms, i, i + {n - 1}))) AS gram FROM {arrs})
  GROUP BY {key}, gram HAVING count(*) >= {freq}) WHERE log2(tf * CAST(len(terms) AS DOUBLE) ** {n - 1} / ({counts})) >= {least - 1e-12!r}"""


def _pmi(spark, d, n):
    rows = phrases.pmi(searcher(spark, d).index.terms_of, n, *phrases.BUILD[n])
    return _round(rows.select("doc_id", F.array_join("gram", " ").alias("gram"), "tf", "pmi"), "pmi")


@query(_BASE + f"SELECT doc_id, array_to_string(gram, ' ') AS gram, tf, round(pmi, 6) AS pmi FROM ({_sql_pmi(2, *phrases.BUILD[2])})")
def bigram_pmi(spark, d):
    return _pmi(spark, d, 2)


@query(_BASE + f"SELECT doc_id, array_to_string(gram, ' ') AS gram, tf, round(pmi, 6) AS pmi FROM ({_sql_pmi(3, *phrases.BUILD[3])})")
def trigram_pmi(spark, d):
    return _pmi(spark, d, 3)


_PHRASES = f""", ok AS (SELECT DISTINCT array_to_string(gram, ' ') AS gram FROM ({_sql_pmi(2, *phrases.BUILD[2])} UNION ALL {_sql_pmi(3, *phrases.BUILD[3])})),
grams AS (SELECT doc_id, array_to_string(unnest(list_concat(list_transform(range(1, len(terms)), lambda i: list_slice(terms, i, i + 1)), list_transform(range(1, len(terms) - 1), lambda i: list_slice(terms, i, i + 2)))), ' ') AS gram FROM arrs),
pp AS (SELECT gram, doc_id, count(*) AS tf FROM grams WHERE gram IN (SELECT gram FROM ok) GROUP BY ALL),
ps AS (SELECT gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM pp GROUP BY gram)
"""


@query(_BASE + _PHRASES + "SELECT gram, df, cf FROM ps")
def phrase_index(spark, d):
    return searcher(spark, d).phrase_index.terms.withColumnRenamed("term", "gram")


@query(
    _BASE + _PHRASES + f""", qp AS (SELECT DISTINCT qid, array_to_string(gram, ' ') AS gram FROM ({_sql_pmi(2, *phrases.QUERY[2], arrs='qarr', key='qid')} UNION ALL {_sql_pmi(3, *phrases.QUERY[3], arrs='qarr', key='qid')}))
SELECT qid, doc_id, round(sum(log10(n_docs / CAST(df AS DOUBLE)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM pp JOIN ps USING (gram) JOIN qp USING (gram) JOIN dl USING (doc_id), st GROUP BY ALL"""
)
def phrase_bm25(spark, d):
    wanted = phrases.query_phrases(searcher(spark, d).index.analyse(workload(spark, d), "qid"))
    return _round(ranking.bm25(searcher(spark, d).phrase_index, wanted), "score")


# ---- search, summaries, feedback


@query(_BASE + "SELECT qid, rank, doc_id, score FROM top")
def search_topk(spark, d):
    return ranking.top_k(ranking.bm25(searcher(spark, d).index, _query(spark, d)), TOP, digits=6)


def _top(spark, d):
    return _once(spark, d, "top", lambda: cut(search_topk(spark, d)))


def _top_texts(spark, d):
    return _top(spark, d).join(searcher(spark, d).index.documents, "doc_id").select("qid", "rank", "doc_id", "text")


def _top_terms(spark, d):
    return _top(spark, d).join(searcher(spark, d).index.terms_of, "doc_id").select("qid", "rank", "doc_id", "terms")


_SCORED = f""", td AS (SELECT qid, rank, doc_id, text FROM top JOIN docs USING (doc_id)),
ts AS (SELECT qid, doc_id, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT qid, doc_id, {_SENTENCES} AS a FROM td)),
tw AS (SELECT qid, doc_id, pos, sentence, unnest({_sql_terms('sentence')}) AS term FROM ts),
ntf AS (SELECT doc_id, term, tf / CAST(max(tf) OVER (PARTITION BY doc_id) AS DOUBLE) AS norm_tf FROM tf),
ss AS (SELECT qid, doc_id, sentence, sum(norm_tf * weight) AS score, min(pos) AS first_pos FROM tw JOIN ntf USING (doc_id, term) JOIN q USING (qid, term) GROUP BY ALL)
"""


@query(_BASE + _SCORED + "SELECT doc_id, term, round(norm_tf, 6) AS norm_tf FROM ntf")
def norm_tf(spark, d):
    return _round(summary.norm_tf(searcher(spark, d).index.terms_of), "norm_tf")


@query(_BASE + _SCORED + "SELECT qid, doc_id, sentence, round(score, 6) AS score, CAST(first_pos AS INTEGER) AS first_pos FROM ss")
def sentence_scores(spark, d):
    return _round(summary.sentence_scores(_top_texts(spark, d), _query(spark, d), terms_of=searcher(spark, d).index.terms_of), "score")


_SUMMARY = ", sr AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(score, 9) DESC, first_pos) AS r FROM ss), sm AS (SELECT qid, doc_id, string_agg(sentence || ' ', '' ORDER BY r) AS summary FROM sr WHERE r <= 5 GROUP BY qid, doc_id) "


@query(_BASE + _SCORED + _SUMMARY + "SELECT qid, doc_id, coalesce(summary, '') AS summary FROM top LEFT JOIN sm USING (qid, doc_id)")
def summarise(spark, d):
    return summary.summaries(_top_texts(spark, d).select("qid", "doc_id", "text"), _query(spark, d), terms_of=searcher(spark, d).index.terms_of)


@query()
def highlight(spark, d):
    """Marks the query's words in the summaries; tested on fixtures."""
    return summary.highlighted(summarise(spark, d), _query(spark, d))


@query(_BASE + f"SELECT qid, doc_id, rank, rank <= least(count(*) OVER (PARTITION BY qid) // 2, 2) AS relevant FROM top")
def feedback_docs(spark, d):
    return feedback.feedback_docs(_top(spark, d), 2)


_VECTORS = """, vec AS (SELECT qid, doc_id, term, tf * log10(n_docs / CAST(df AS DOUBLE)) AS w, first_pos FROM top JOIN (SELECT doc_id, term, count(*) AS tf, min(pos) AS first_pos FROM tok GROUP BY ALL) USING (doc_id) JOIN dfs USING (term), st)
"""


@query(_BASE + _VECTORS + "SELECT qid, doc_id, term, round(w, 6) AS w FROM vec")
def doc_vectors(spark, d):
    return _round(feedback.doc_vectors(_top_terms(spark, d), searcher(spark, d).index).select("qid", "doc_id", "term", "w"), "w")


def _sql_rocchio(relevant_n: int, gamma: float) -> str:
    return _BASE + _VECTORS + f""", fb AS (SELECT qid, doc_id, rank, rank <= least(count(*) OVER (PARTITION BY qid) // 2, {relevant_n}) AS relevant FROM top),
fs AS (SELECT qid, count(*) FILTER (WHERE relevant) AS n_rel, count(*) FILTER (WHERE NOT relevant) AS n_non FROM fb GROUP BY qid),
ce AS (SELECT qid, term, sum(w) FILTER (WHERE relevant) AS pos, sum(w) FILTER (WHERE NOT relevant) AS neg, min(rank * 1000000000 + first_pos) FILTER (WHERE relevant) AS seen FROM vec JOIN fb USING (qid, doc_id) GROUP BY ALL),
al AS (SELECT qid, term, weight, pos, neg, seen, n_rel, n_non, CASE WHEN coalesce(n_rel, 0) > 0 THEN 0.75 * coalesce(pos, 0) / n_rel END AS cand FROM q FULL JOIN ce USING (qid, term) LEFT JOIN fs USING (qid) WHERE weight IS NOT NULL OR pos IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cand, 9) DESC NULLS LAST, weight IS NULL, seen NULLS FIRST, term) AS place FROM al),
nw AS (SELECT *, CASE WHEN place <= 2 AND cand IS NOT NULL THEN cand ELSE weight END AS new FROM rk)
SELECT qid, term, round(CASE WHEN cand IS NOT NULL AND n_non > 0 AND {gamma} * coalesce(neg, 0) > 0 THEN greatest(0.0, new - {gamma} * coalesce(neg, 0) / n_non) ELSE new END, 6) AS weight FROM nw WHERE new IS NOT NULL"""


@query(_sql_rocchio(5, 0.15))
def rocchio(spark, d):
    texts = cut(_top_terms(spark, d))
    vectors = feedback.doc_vectors(texts, searcher(spark, d).index)
    return _round(feedback.rocchio(_query(spark, d), vectors, feedback.feedback_docs(texts, 5)), "weight")


@query(_sql_rocchio(2, 0.0))
def prf(spark, d):
    return _round(feedback.pseudo_relevance(_query(spark, d), cut(_top_terms(spark, d)), searcher(spark, d).index, 2), "weight")


def _sql_results(scored: str, p: str = "f", q: str = "q", stems: bool = False) -> str:
    """{p}ound: the top documents of ``scored(qid, doc_id, score)``; {p}m: their summaries for the weighted queries ``q``. docs and tf are given."""
    return f""", {p}ound AS (SELECT qid, rank, doc_id, score FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({scored})) WHERE rank <= {TOP}),
{p}d AS (SELECT DISTINCT doc_id, text FROM {p}ound JOIN docs USING (doc_id)), {p}s AS (SELECT doc_id, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT doc_id, {_SENTENCES} AS a FROM {p}d)),
{p}v AS (SELECT doc_id, pos, sentence, unnest({_sql_terms('sentence')}) AS word FROM {p}s), {p}w AS (SELECT doc_id, pos, sentence, {'stem' if stems else 'word'} AS term FROM {p}v {'JOIN sm USING (word)' if stems else ''}), {p}n AS (SELECT doc_id, term, tf / CAST(max(tf) OVER (PARTITION BY doc_id) AS DOUBLE) AS norm_tf FROM tf),
{p}c AS (SELECT qid, doc_id, sentence, sum(norm_tf * weight) AS score, min(pos) AS first_pos FROM {p}ound JOIN {p}w USING (doc_id) JOIN {p}n USING (doc_id, term) JOIN {q} USING (qid, term) GROUP BY qid, doc_id, sentence),
{p}r AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY round(score, 9) DESC, first_pos) AS r FROM {p}c), {p}m AS (SELECT qid, doc_id, string_agg(sentence || ' ', '' ORDER BY r) AS summary FROM {p}r WHERE r <= 5 GROUP BY qid, doc_id)
"""


def _sql_found(scored: str, p: str = "f", q: str = "q", stems: bool = False) -> str:
    return _sql_results(scored, p, q, stems) + f"SELECT qid, rank, doc_id, round(score, 6) AS score, coalesce(summary, '') AS summary FROM {p}ound LEFT JOIN {p}m USING (qid, doc_id)"


_OKAPI = "SELECT qid, doc_id, sum(log10(n_docs / CAST(df AS DOUBLE)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM post JOIN (SELECT DISTINCT qid, term FROM {}) USING (term), st GROUP BY ALL"
_FED_BACK = f""", sv AS (SELECT qid, doc_id, unnest(a) AS term, generate_subscripts(a, 1) - 1 AS pos FROM (SELECT qid, doc_id, {_sql_terms("coalesce(summary, '')")} AS a FROM found LEFT JOIN fm USING (qid, doc_id))),
vec AS (SELECT qid, doc_id, term, count(*) * coalesce(log10(any_value(n_docs) / CAST(any_value(df) AS DOUBLE)), 0) AS w, min(pos) AS first_pos FROM sv LEFT JOIN dfs USING (term), st GROUP BY qid, doc_id, term),
fb AS (SELECT qid, doc_id, rank, rank <= least(count(*) OVER (PARTITION BY qid) // 2, 2) AS relevant FROM found), rs AS (SELECT qid, count(*) FILTER (WHERE relevant) AS n_rel FROM fb GROUP BY qid),
ce AS (SELECT qid, term, sum(w) FILTER (WHERE relevant) AS pos, min(rank * 1000000000 + first_pos) FILTER (WHERE relevant) AS seen FROM vec JOIN fb USING (qid, doc_id) GROUP BY ALL),
al AS (SELECT qid, term, weight, seen, CASE WHEN coalesce(n_rel, 0) > 0 THEN 0.75 * coalesce(pos, 0) / n_rel END AS cand FROM q FULL JOIN ce USING (qid, term) LEFT JOIN rs USING (qid) WHERE weight IS NOT NULL OR pos IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cand, 9) DESC NULLS LAST, weight IS NULL, seen NULLS FIRST, term) AS place FROM al),
q2 AS (SELECT qid, term, weight FROM (SELECT qid, term, CASE WHEN place <= 2 AND cand IS NOT NULL THEN cand ELSE weight END AS weight FROM rk) WHERE weight IS NOT NULL)
"""


@query(_BASE + _sql_results(_OKAPI.format("q")) + _FED_BACK + _sql_found(_OKAPI.format("q2"), "g", "q2"))
def search_expanded(spark, d):
    """Search, feed the summaries back, search again."""
    return _round(searcher(spark, d).search(workload(spark, d), TOP, expansion=True, suggest=False), "score")


@query(
    _BASE + _PHRASES + f""", qp AS (SELECT DISTINCT qid, array_to_string(gram, ' ') AS gram FROM ({_sql_pmi(2, *phrases.QUERY[2], arrs='qarr', key='qid')} UNION ALL {_sql_pmi(3, *phrases.QUERY[3], arrs='qarr', key='qid')}))"""
    + _sql_found("SELECT qid, doc_id, sum(log10(n_docs / CAST(df AS DOUBLE)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score FROM pp JOIN ps USING (gram) JOIN qp USING (gram) JOIN dl USING (doc_id), st GROUP BY ALL")
)
def search_phrases(spark, d):
    return _round(searcher(spark, d).search(workload(spark, d), TOP, phrase=True, suggest=False), "score")


_LM_SCORES = """SELECT qid, doc_id, sum(ln((0.1 + coalesce(tf, 0)) / (len + 0.1 * n_terms))) AS score
FROM (SELECT DISTINCT qid, doc_id FROM tiers) c JOIN q USING (qid) JOIN dl USING (doc_id) LEFT JOIN tf USING (term, doc_id), st GROUP BY ALL"""


@query(_BASE + _TIERS + _sql_found(_LM_SCORES))
def search_inexact_lm(spark, d):
    return _round(searcher(spark, d).search(workload(spark, d), TOP, scoring="lm", inexact=True, suggest=False), "score")


# ---- stems


_STEM_BASE = f"""WITH {_DOCS},
words AS (SELECT doc_id, {_sql_terms('text')} AS terms FROM docs), qwords AS (SELECT item_id AS qid, {_sql_terms('text')} AS terms FROM benchmark),
lines AS (SELECT unnest({_SENTENCES}) AS sentence FROM docs),
vocabulary AS MATERIALIZED (SELECT unnest(terms) AS word FROM words UNION SELECT unnest(terms) FROM qwords UNION SELECT unnest({_sql_terms('sentence')}) FROM lines),
{stemming_sql.ctes('vocabulary')},
tok AS (SELECT doc_id, stem AS term FROM (SELECT doc_id, unnest(terms) AS word FROM words) JOIN sm USING (word)),
tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, len(terms) AS len FROM words),
dfs AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term),
st AS (SELECT count(*) AS n_docs, avg(len) AS avgdl FROM dl),
post AS (SELECT term, doc_id, tf, len, df FROM tf JOIN dl USING (doc_id) JOIN dfs USING (term)),
q AS (SELECT qid, stem AS term, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT qid, unnest(terms) AS word FROM qwords) JOIN sm USING (word) GROUP BY ALL)
"""


@query(_STEM_BASE + "SELECT word, stem FROM sm WHERE word IN (SELECT unnest(terms) FROM words)")
def stem(spark, d):
    """The stemmer over the vocabulary."""
    return stemming.stem_table(searcher(spark, d).dictionary)


@query(_STEM_BASE + "SELECT term, df, cf FROM dfs")
def stemmed_index(spark, d):
    return stemmed_searcher(spark, d).index.terms


@query(_STEM_BASE + f"SELECT qid, rank, doc_id, score FROM (SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM ({_OKAPI.format('q')})) WHERE rank <= {TOP}")
def bm25_stemmed(spark, d):
    s = stemmed_searcher(spark, d)
    return ranking.top_k(ranking.bm25(s.index, s.analyse(workload(spark, d))), TOP, digits=6)


@query(_STEM_BASE + _sql_found(_OKAPI.format("q"), stems=True))
def search_stemmed(spark, d):
    """Search and summaries on stems."""
    return _round(stemmed_searcher(spark, d).search(workload(spark, d), TOP, suggest=False), "score")
