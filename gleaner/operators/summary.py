"""Query-focused extractive summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.runtime import cut, small


def norm_tf(terms_of: DataFrame) -> DataFrame:
    """(doc_id, term, norm_tf): frequency over the largest frequency in the document."""
    freq = text.exploded(terms_of).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return freq.withColumn("norm_tf", F.col("tf") / F.max("tf").over(W.partitionBy("doc_id"))).drop("tf")


def _lines(documents: DataFrame, abbreviations: bool, stem: bool) -> DataFrame:
    """(doc_id, pos, sentence, words): the different sentences of each distinct document, under the place of the first.

    ``words`` holds the terms of all sentences with that text.
    """
    docs = documents.select("doc_id", "text").dropDuplicates(["doc_id"]).select("doc_id", text.sentences(F.col("text"), abbreviations).alias("s"))
    said = docs.select("doc_id", "s", F.explode(F.array_distinct("s")).alias("sentence"))
    times = F.size(F.filter("s", lambda x: x == F.col("sentence")))
    lines = said.select("doc_id", (F.array_position("s", F.col("sentence")) - 1).cast("int").alias("pos"), "sentence", times.alias("times"))
    return lines.select("doc_id", "pos", "sentence", "times", text.preprocess(F.col("sentence"), stem).alias("words"))


def _scores(documents: DataFrame, query: DataFrame, abbreviations: bool, stem: bool, terms_of: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(qid, doc_id, pos, score) and the lines they belong to; see ``sentence_scores``."""
    lines = cut(_lines(documents, abbreviations, stem))
    ids = documents.select("doc_id").distinct()
    own = text.with_terms(documents.select("doc_id", "text").dropDuplicates(["doc_id"]), stem=stem) if terms_of is None else terms_of.join(small(ids), "doc_id", "left_semi")
    wanted = documents.select("qid", "doc_id").distinct().join(query, "qid")
    weights = norm_tf(own).join(wanted, ["doc_id", "term"]).select("qid", "doc_id", "term", (F.col("norm_tf") * F.col("weight")).alias("w"))
    words = lines.select("doc_id", "pos", "times", F.explode("words").alias("term"))
    rows = words.join(weights, ["doc_id", "term"]).groupBy("qid", "doc_id", "pos").agg(F.sum(F.col("w") * F.col("times")).alias("score"))
    return rows, lines.select("doc_id", "pos", "sentence")


def sentence_scores(documents: DataFrame, query: DataFrame, abbreviations: bool = False, stem: bool = False, terms_of: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, sentence, score, first_pos) of the sentences holding query terms.

    ``documents(qid, doc_id, text)`` are the documents of each query; each is analysed once, however
    many queries found it. ``terms_of`` are the terms of whole documents where an index holds them, and
    ``stem`` says whether these and the query are stems. A sentence scores the sum,
    over its term occurrences, of normalised document frequency times query weight; sentences with
    equal text share one score. Sentences without a query term are not returned; a document
    without apt words has none.
    """
    scores, lines = _scores(documents, query, abbreviations, stem, terms_of)
    return scores.join(lines, ["doc_id", "pos"]).select("qid", "doc_id", "sentence", "score", F.col("pos").alias("first_pos"))


def summaries(documents: DataFrame, query: DataFrame, n_sentences: int = 5, abbreviations: bool = False, stem: bool = False, terms_of: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, summary): the best sentences, best first, equal scores in text order, each with a blank behind."""
    scores, lines = _scores(documents, query, abbreviations, stem, terms_of)
    order = W.partitionBy("qid", "doc_id").orderBy(F.round("score", 9).desc(), "pos")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_sentences).join(lines, ["doc_id", "pos"])
    best = ranked.groupBy("qid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "sentence"))).alias("x"))
    picked = best.select("qid", "doc_id", F.array_join(F.transform("x.sentence", lambda s: F.concat(s, F.lit(" "))), "").alias("summary"))
    return documents.select("qid", "doc_id").join(picked, ["qid", "doc_id"], "left").select("qid", "doc_id", F.coalesce("summary", F.lit("")).alias("summary"))


def highlighted(summarised: DataFrame, query: DataFrame, stem: bool = False, mark: tuple[str, str] = text.MARK) -> DataFrame:
    """Mark the query's words in each summary, whole words only and once; with ``stem`` all words with a stem of the query."""
    terms = query.groupBy("qid").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    rows = summarised.join(terms, "qid", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    if stem:
        rows = rows.withColumn("terms", text.stemmed_matches(F.array_distinct(text.preprocess(F.col("summary"))), F.col("terms")))
    return rows.withColumn("summary", text.highlight(F.col("summary"), F.col("terms"), mark)).drop("terms")
