"""The pN_ queries: each applies its problem's operator to the whole of the intended tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import cooccurrence, leakage, neardup, packing, quality, sentences, subjects, termcounts
from gleaner.runtime import cut
from gleaner.sources.tables import distinct_by, table


def _bodies(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct reports with a non-empty body, written once, as each is read more than once."""
    return cut(distinct_by(table(spark, d, "reuters").where(F.length("body") > 0), "newid", "body", *columns))


def _subjects(spark: SparkSession, d: str) -> tuple[DataFrame, subjects.SubjectModel]:
    bodies = _bodies(spark, d, "topics")
    rows = subjects.prepared(bodies, table(spark, d, "subject_labels"), table(spark, d, "topic_codes"), sentences.fit(bodies, written=True))
    return rows, subjects.calibrate_units(subjects.train(rows), rows)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows, model = _subjects(spark, d)
    return subjects.found(subjects.shares(rows, model))


def p1_subjects(spark: SparkSession, d: str) -> DataFrame:
    rows, model = _subjects(spark, d)
    return subjects.posteriors(subjects.shares(rows, model), subjects.calibrate(model, rows))


def p1_composition(spark: SparkSession, d: str) -> DataFrame:
    """The make-up of the collection: reports and sentences of each subject."""
    rows, model = _subjects(spark, d)
    hits = subjects.shares(rows, model)
    enough = F.col("n_hits") >= 0.25 * F.col("n_units")
    return hits.groupBy("subject").agg(F.count(F.when(enough, 1)).alias("n_reports"), F.sum("n_hits").cast("long").alias("n_sentences"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.surprising(cooccurrence.together(table(spark, d, "n_gram_index"), min_shared=3))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.together(table(spark, d, "n_gram_index"))
    return pairs.withColumn("lift", F.round("lift", 6)).withColumn("log_odds", F.round("log_odds", 6))


def _reports(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return distinct_by(table(spark, d, "reuters"), "newid", *columns)


#: Terms of a suffix, from whose pass the single terms are read.
SUFFIX_TERMS = 2


def _marked_terms(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "reuters").agg(F.countDistinct("newid")).first()[0]
    return termcounts.marked(termcounts.term_counts(_reports(spark, d, "title", "body"), max_terms=SUFFIX_TERMS).where("n_terms = 1"), n)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked_terms(spark, d).where("mark is not null").select("term", "mark")


def p3_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its figures beside those of the index; terms the index lacks have nulls there."""
    index = termcounts.index_figures(table(spark, d, "inv_index"))
    return _marked_terms(spark, d).select("term", "n_total", "n_reports", "mark").join(index, "term", "left")


def p3_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Runs of up to three terms that stand in at least two reports."""
    return termcounts.term_counts(_reports(spark, d, "title", "body"), max_terms=3).where("n_reports > 1")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    bodies = _bodies(spark, d)
    return sentences.sentences(bodies, sentences.fit(bodies, written=True)).select("newid", "start_pos", "end_pos")


def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    bodies = _bodies(spark, d)
    return sentences.sentences(bodies, sentences.fit(bodies, written=True), with_text=True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_pairs(table(spark, d, "reuters"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(table(spark, d, "reuters"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document that was split has exactly one second part."""
    return packing.pack(table(spark, d, "documents")).where("part_no = 1").select("doc_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(packing.pack(table(spark, d, "documents")))


def p6_layout(spark: SparkSession, d: str) -> DataFrame:
    """One row that shows whether the containers hold everything and nothing twice: all faults must be zero."""
    return packing.layout(packing.pack(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    return leakage.summary(leakage.leaks(table(spark, d, "documents"), items), items)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    found = quality.verdicts(documents, quality.fit(documents, table(spark, d, "labels")))
    return found.where("kind <> 'prose'").select("doc_id", "kind")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = quality.fit(documents, table(spark, d, "labels"))
    return quality.statistics(documents, model, quality.common_words(documents))


def p8_measures(spark: SparkSession, d: str) -> DataFrame:
    """The statistics alone, which SQL can repeat."""
    measures = p8_statistics(spark, d).drop("kind")
    for c in ("mean_word_length", "symbol_ratio", "closed_line_share", "common_word_share"):
        measures = measures.withColumn(c, F.round(c, 6))
    return measures


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_subjects, p1_composition, p2_found, p2_pairs, p3_found, p3_terms, p3_phrases, p4_found, p4_sentences, p5_found, p5_groups, p6_found, p6_containers, p6_fill, p6_layout, p7_found, p7_items, p8_found, p8_statistics, p8_measures)}


#: Fixed value: white space as str.split() has it, for RE2.
_BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ITEMS = """WITH alld AS (SELECT DISTINCT doc_id FROM n_gram_index WHERE doc_id IS NOT NULL),
m AS (SELECT DISTINCT doc_id, lower(array_to_string(ngram_tuple, ' ')) AS item FROM n_gram_index WHERE doc_id IS NOT NULL),
i AS (SELECT * FROM m WHERE item <> ''), c AS (SELECT item, count(*) AS n FROM i GROUP BY item),
p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_shared FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.item < b.item GROUP BY ALL),
r AS (SELECT item_a, item_b, n_shared, ca.n AS n_a, cb.n AS n_b, (SELECT count(*) FROM alld) AS n_records FROM p JOIN c ca ON ca.item = item_a JOIN c cb ON cb.item = item_b)
"""
_REPORTS = "SELECT newid, any_value(title) AS title, any_value(body) AS body FROM reuters WHERE newid IS NOT NULL GROUP BY newid"
_TERMS = rf"""WITH reps AS ({_REPORTS}), cols AS (SELECT newid, title AS x FROM reps UNION ALL SELECT newid, body FROM reps),
arrs AS (SELECT newid, regexp_extract_all(lower(x), '\p{{L}}+') AS a FROM cols WHERE x IS NOT NULL),
"""
_COUNTED = _TERMS + """f AS (SELECT unnest(a) AS term, newid FROM arrs),
t AS (SELECT term, count(*) AS n_total, count(DISTINCT newid) AS n_reports FROM f GROUP BY term),
k AS (SELECT *, CASE WHEN n_reports > 0.15 * (SELECT count(DISTINCT newid) FROM reuters) THEN 'common' WHEN n_reports <= 2 AND n_total <= 3 THEN 'rare' END AS mark FROM t)
"""
_LEAKS = r"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS a FROM documents),
v AS (SELECT item_id AS id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS a FROM benchmark),
dw AS (SELECT DISTINCT id AS doc_id, lower(array_to_string(unnest(list_transform(range(1, len(a) - 11), lambda i: list_slice(a, i, i + 12))), ' ')) AS g FROM w),
iw AS (SELECT DISTINCT id AS item_id, lower(array_to_string(unnest(list_transform(range(1, len(a) - 11), lambda i: list_slice(a, i, i + 12))), ' ')) AS g FROM v),
found AS (SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g))
"""


_TOKENS = rf"len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) + length(regexp_replace(text, '[\p{{L}}\p{{N}}]|{_BLANKS}', '', 'g'))"
_SHINGLED = f"""t AS (SELECT newid, trim(regexp_replace(lower(coalesce(title, '') || ' ' || body), '{_BLANKS}+', ' ', 'g')) AS x FROM ({_REPORTS}) WHERE length(body) >= 100),
k AS (SELECT newid, min(newid) OVER (PARTITION BY x) AS class_id, x FROM t),
s AS (SELECT DISTINCT newid, unnest(list_transform(range(1, length(x) - 3), lambda i: substring(x, CAST(i AS INTEGER), 5))) AS g FROM k WHERE newid = class_id), n AS (SELECT newid, count(*) AS n FROM s GROUP BY newid),
p AS (SELECT a.newid AS a, b.newid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.newid <> b.newid GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.newid = a JOIN n nb ON nb.newid = b WHERE 10 * c >= 7 * (na.n + nb.n - c))
"""
#: Fixed value: marks and quotation marks that close a line.
_ENDS = "".join(sorted(set(quality._CLOSING + quality._QUOTES + "„«「『"))).replace("\\", "").replace("]", "\\]").replace("'", "''")
_MEASURES = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_BLANKS}', '', 'g') <> '') AS lines, regexp_replace(text, '{_BLANKS}', '', 'g') AS black FROM d),
u AS (SELECT doc_id, unnest(words) AS word FROM w), v AS (SELECT word FROM u GROUP BY word HAVING count(DISTINCT doc_id) >= greatest(1.0, 0.05 * (SELECT count(*) FROM w WHERE black <> ''))),
h AS (SELECT doc_id, count(*) AS known FROM u WHERE word IN (SELECT word FROM v) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(lines) AS n_lines, round(CASE WHEN len(words) > 0 THEN list_sum(list_transform(words, lambda x: length(x))) / CAST(len(words) AS DOUBLE) END, 6) AS mean_word_length,
round(CASE WHEN black <> '' THEN length(regexp_replace(black, '[^\p{{P}}\p{{S}}]', '', 'g')) / CAST(length(black) AS DOUBLE) END, 6) AS symbol_ratio,
round(CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(regexp_replace(x, '{_BLANKS}+$', ''), '[{_ENDS}]$'))) / CAST(len(lines) AS DOUBLE) END, 6) AS closed_line_share,
round(CASE WHEN len(words) > 0 THEN coalesce(known, 0) / CAST(len(words) AS DOUBLE) END, 6) AS common_word_share FROM w LEFT JOIN h USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say what the operator does; the others are tested in tests/llm."""
    return {
        "p2_found": _ITEMS + "SELECT item_a, item_b FROM r WHERE n_shared >= 3 AND n_shared * n_records >= 10 * n_a * n_b",
        "p2_pairs": _ITEMS + "SELECT item_a, item_b, n_shared, n_a, n_b, n_records, round(n_shared * CAST(n_records AS DOUBLE) / (n_a * CAST(n_b AS DOUBLE)), 6) AS lift, "
        "round(ln((n_shared + 0.5) * (n_records - n_a - n_b + n_shared + 0.5) / ((n_a - n_shared + 0.5) * (n_b - n_shared + 0.5))), 6) AS log_odds FROM r",
        "p3_found": _COUNTED + "SELECT term, mark FROM k WHERE mark IS NOT NULL",
        "p3_terms": _COUNTED + ", x AS (SELECT lower(term) AS term, doc_id, max(term_frequency) AS tf FROM inv_index WHERE term IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL), "
        "y AS (SELECT term, CAST(sum(tf) AS BIGINT) AS index_total, count(*) AS index_reports FROM x GROUP BY term) "
        "SELECT term, n_total, n_reports, mark, index_total, index_reports FROM k LEFT JOIN y USING (term)",
        "p3_phrases": _TERMS + """g AS (SELECT newid, list_concat(a, list_transform(range(1, len(a)), lambda i: array_to_string(list_slice(a, i, i + 1), ' ')), list_transform(range(1, len(a) - 1), lambda i: array_to_string(list_slice(a, i, i + 2), ' '))) AS b FROM arrs),
f AS (SELECT unnest(b) AS term, newid FROM g)
SELECT term, CAST(len(string_split(term, ' ')) AS INTEGER) AS n_terms, count(*) AS n_total, count(DISTINCT newid) AS n_reports FROM f GROUP BY term HAVING count(DISTINCT newid) > 1""",
        "p5_found": f"""WITH t AS (SELECT newid, trim(regexp_replace(lower(coalesce(title, '') || ' ' || body), '{_BLANKS}+', ' ', 'g')) AS x FROM ({_REPORTS}) WHERE length(body) >= 100),
s AS (SELECT DISTINCT newid, unnest(list_transform(range(1, length(x) - 3), lambda i: substring(x, CAST(i AS INTEGER), 5))) AS g FROM t), n AS (SELECT newid, count(*) AS n FROM s GROUP BY newid),
p AS (SELECT a.newid AS newid_a, b.newid AS newid_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.newid < b.newid GROUP BY ALL)
SELECT newid_a, newid_b FROM p JOIN n na ON na.newid = newid_a JOIN n nb ON nb.newid = newid_b WHERE 10 * c >= 7 * (na.n + nb.n - c)""",
        "p5_groups": f"""WITH RECURSIVE {_SHINGLED}, r(node, other) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT k.newid, k.class_id, coalesce(g.group_id, k.class_id) AS group_id, coalesce(l.n_links, 0) AS n_links FROM k LEFT JOIN (SELECT node, min(other) AS group_id FROM r GROUP BY node) g ON g.node = k.class_id LEFT JOIN (SELECT a, count(*) AS n_links FROM e GROUP BY a) l ON l.a = k.class_id""",
        "p6_layout": f"""WITH t AS (SELECT doc_id, CAST({_TOKENS} AS BIGINT) AS n FROM documents WHERE text IS NOT NULL)
SELECT count(*) FILTER (WHERE n > 0) AS n_documents, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum((n + 2047) // 2048) AS BIGINT) AS n_parts, CAST(0 AS BIGINT) AS n_overlaps, CAST(0 AS BIGINT) AS n_gaps, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_split_in_vain, CAST(0 AS BIGINT) AS n_unused FROM t""",
        "p8_measures": _MEASURES,
        "p6_found": rf"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) + length(regexp_replace(text, '[\p{{L}}\p{{N}}]|{_BLANKS}', '', 'g')) > 2048",
        "p7_found": _LEAKS + "SELECT doc_id, item_id FROM found",
        "p7_items": _LEAKS + "SELECT item_id, count(doc_id) AS n_documents FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN found USING (item_id) GROUP BY item_id",
    }
