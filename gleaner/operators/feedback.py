"""Relevance feedback and query expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators.index import Index


def feedback_docs(ranked: DataFrame, k: int = 5) -> DataFrame:
    """(qid, doc_id, rank, relevant): of n ranked documents the first min(n / 2, k) are taken as relevant."""
    n = F.count("*").over(W.partitionBy("qid"))
    return ranked.select("qid", "doc_id", "rank", (F.col("rank") <= F.least(F.floor(n / 2), F.lit(k))).alias("relevant"))


def doc_vectors(documents: DataFrame, index: Index) -> DataFrame:
    """(qid, doc_id, term, w, first_pos) of ``documents(qid, doc_id, text)``: tf * log10(N / df), 0 for unknown terms.

    Texts (summaries, say) go through the index's analysis; whole documents of the index may come with
    their ``terms`` instead of a text.
    """
    words = F.col("terms") if "terms" in documents.columns else text.preprocess(F.col("text"), index.stemmed)
    terms = documents.select("qid", "doc_id", words.alias("terms")).select("qid", "doc_id", F.posexplode("terms").alias("pos", "term"))
    freq = terms.groupBy("qid", "doc_id", "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first_pos"))
    idf = F.log10(F.lit(float(index.stats["n_docs"])) / F.col("df"))
    return freq.join(index.terms.select("term", "df"), "term", "left").select("qid", "doc_id", "term", (F.col("tf") * F.coalesce(idf, F.lit(0.0))).alias("w"), "first_pos")


def rocchio(query: DataFrame, vectors: DataFrame, judged: DataFrame, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15, top: int | None = 2) -> DataFrame:
    """(qid, term, weight) of the changed queries.

    With ``top`` the best terms of the centroid of the relevant documents overwrite or join the
    query's weights (which may lower one); with None all of the centroid is added. The centroid of
    the others is then taken off the terms of the new query, never below zero. Equal candidates: query
    terms first, then by rank of document and place in it. Queries without relevant documents
    only have their weights times ``alpha``.
    """
    docs = judged.select("qid", "doc_id", "rank", "relevant")
    sizes = docs.groupBy("qid").agg(F.count_if("relevant").alias("n_rel"), F.count_if(~F.col("relevant")).alias("n_non"))
    rows = vectors.join(docs, ["qid", "doc_id"])
    seen = F.when(F.col("relevant"), F.struct("rank", "first_pos"))
    centre = rows.groupBy("qid", "term").agg(F.sum(F.when(F.col("relevant"), F.col("w"))).alias("pos"), F.sum(F.when(~F.col("relevant"), F.col("w"))).alias("neg"), F.min(seen).alias("seen"))
    both = query.join(centre, ["qid", "term"], "full_outer").join(sizes, "qid", "left")
    base = F.col("weight") * F.lit(alpha)
    cand = F.lit(beta) * F.coalesce("pos", F.lit(0.0)) / F.col("n_rel")
    rows = both.where("weight is not null or pos is not null").withColumn("base", base).withColumn("cand", F.when(F.coalesce("n_rel", F.lit(0)) > 0, cand))
    if top is None:
        new = rows.withColumn("new", F.when(F.col("cand").isNull(), F.col("base")).otherwise(F.coalesce("base", F.lit(0.0)) + F.col("cand")))
    else:
        order = W.partitionBy("qid").orderBy(F.desc_nulls_last(F.round("cand", 9)), F.col("weight").isNull(), F.col("seen").asc_nulls_first(), "term")
        ranked = rows.withColumn("at", F.row_number().over(order))
        new = ranked.withColumn("new", F.when((F.col("at") <= top) & F.col("cand").isNotNull(), F.col("cand")).otherwise(F.col("base")))
    less = F.when((F.col("cand").isNotNull()) & (F.col("n_non") > 0) & F.lit(gamma > 0), F.lit(gamma) * F.coalesce("neg", F.lit(0.0)) / F.col("n_non")).otherwise(0.0)
    clamped = F.when(less > 0, F.greatest(F.lit(0.0), F.col("new") - less)).otherwise(F.col("new"))
    return new.where("new is not null").select("qid", "term", clamped.alias("weight"))


def pseudo_relevance(query: DataFrame, ranked_texts: DataFrame, index: Index, relevant_n: int = 5, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.0) -> DataFrame:
    """Rocchio on ``ranked_texts(qid, rank, doc_id, text or terms)``, the better half (at most ``relevant_n``) taken as relevant."""
    return rocchio(query, doc_vectors(ranked_texts, index), feedback_docs(ranked_texts, relevant_n), alpha, beta, gamma)
