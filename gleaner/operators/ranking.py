"""Scorers: (qid, doc_id, score) from postings and weighted query terms.

Only documents holding a query term are touched. The language models are products over all query
terms; the factors of absent terms are the same for a document whatever the term, so they are
multiplied in afterwards and no cross join of documents and query terms is needed. Products are
kept as sums of logarithms (log_score), which do not underflow on long queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.operators.index import Index
from gleaner.runtime import small


#: Distinct query terms up to which they are pushed into the scan of the postings.
PUSHED_TERMS = 2_000


def narrowed(postings: DataFrame, query: DataFrame) -> DataFrame:
    """Push the terms of a small query batch into the scan: postings are sorted by term, so row groups are skipped."""
    if "_gleaner_terms" not in query.__dict__:  # asked once for the same batch
        query._gleaner_terms = query.select("term").where("term is not null").distinct().limit(PUSHED_TERMS + 1).collect()
    terms = query._gleaner_terms
    return postings.where(F.col("term").isin([t[0] for t in terms])) if len(terms) <= PUSHED_TERMS else postings


def matched(index: Index, query: DataFrame, high_only: bool = False) -> DataFrame:
    postings = index.postings.where("is_high") if high_only else index.postings
    return narrowed(postings, query).join(small(query), "term")


def _matched_terms(index: Index, query: DataFrame, high_only: bool = False) -> DataFrame:
    """Postings of the distinct terms of each query, without their weights."""
    if "_gleaner_pairs" not in query.__dict__:
        query._gleaner_pairs = query.select("qid", "term").distinct()
    return matched(index, query._gleaner_pairs, high_only)


def bm25(index: Index, query: DataFrame, k1: float = 1.2, b: float = 0.75, high_only: bool = False) -> DataFrame:
    """Okapi BM25 over distinct query terms (weights play no part); unknown terms add nothing.

    ``high_only`` scores only postings of the high tier, with document frequencies over both.
    """
    idf = F.log10(F.lit(float(index.stats["n_docs"])) / F.col("df"))
    norm = F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("len") / F.lit(float(index.stats["avgdl"] or 1)))
    rows = _matched_terms(index, query, high_only)
    return rows.groupBy("qid", "doc_id").agg(F.sum(idf * F.col("tf") * F.lit(k1 + 1) / norm).alias("score"))


def tfidf_length_norm(index: Index, query: DataFrame, high_only: bool = False) -> DataFrame:
    """Sum of tf * query weight * idf squared, over the document's length (known as cosine)."""
    idf = F.log10(F.lit(float(index.stats["n_docs"])) / F.col("df"))
    rows = matched(index, query, high_only)
    return rows.groupBy("qid", "doc_id").agg((F.sum(F.col("tf") * F.col("weight") * idf * idf) / F.first("len")).alias("score"))


cosine = tfidf_length_norm


def _query_sizes(query: DataFrame) -> DataFrame:
    return query.groupBy("qid").agg(F.countDistinct("term").alias("n_query"))


def lm_additive(index: Index, query: DataFrame, candidates: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Unigram language model with additive smoothing: product of (alpha + tf) / (len + alpha |V|)."""
    floor = F.log(F.lit(alpha))
    hits = _matched_terms(index, query).groupBy("qid", "doc_id").agg(F.sum(F.log(F.lit(alpha) + F.col("tf")) - floor).alias("gain"))
    rows = candidates.select("qid", "doc_id").join(hits, ["qid", "doc_id"], "left").join(index.lengths, "doc_id").join(small(_query_sizes(query)), "qid")
    per = floor - F.log(F.col("len") + F.lit(alpha * index.stats["n_terms"]))
    return rows.select("qid", "doc_id", (F.coalesce("gain", F.lit(0.0)) + F.col("n_query") * per).alias("log_score"))


def lm_jelinek_mercer(index: Index, query: DataFrame, candidates: DataFrame, lam: float = 0.5) -> DataFrame:
    """Jelinek-Mercer smoothing: product of lam tf / len + (1 - lam) cf / C; a term outside the collection makes it zero (log null)."""
    terms, base = _collection_part(index, query, lam)
    hits = narrowed(index.postings, query).join(small(terms), "term").groupBy("qid", "doc_id").agg(F.sum(F.log(F.lit(lam) * F.col("tf") / F.col("len") + F.col("p")) - F.log("p")).alias("gain"))
    rows = candidates.select("qid", "doc_id").join(hits, ["qid", "doc_id"], "left").join(small(base), "qid")
    return rows.select("qid", "doc_id", (F.coalesce("gain", F.lit(0.0)) + F.col("base")).alias("log_score"))


def _collection_part(index: Index, query: DataFrame, lam: float) -> tuple[DataFrame, DataFrame]:
    """(qid, term, p) with p = (1 - lam) cf / C, and (qid, base): the sum of ln p, null with an unknown term."""
    p = F.lit(1 - lam) * F.col("cf") / F.lit(float(index.stats["total_len"] or 1))
    terms = small(query.select("qid", "term").distinct()).join(index.terms.select("term", "cf"), "term", "left").select("qid", "term", p.alias("p"))
    base = terms.groupBy("qid").agg(F.when(F.count("*") == F.count("p"), F.sum(F.log("p"))).alias("base"))
    return terms.where("p is not null"), base


def category_lengths(index: Index, categories: DataFrame) -> DataFrame:
    """(category, len) over the bag of (category, doc_id): a document listed twice counts twice."""
    return categories.join(index.lengths, "doc_id").groupBy("category").agg(F.sum("len").alias("len"))


def _category_hits(index: Index, query: DataFrame, categories: DataFrame) -> DataFrame:
    """(qid, category, term, tf): only postings of query terms meet the category map."""
    rows = _matched_terms(index, query).select("qid", "term", "doc_id", "tf")
    return rows.join(categories.where("category is not null"), "doc_id").groupBy("qid", "category", "term").agg(F.sum("tf").alias("tf"))


def category_lm_additive(index: Index, query: DataFrame, categories: DataFrame, alpha: float = 0.1, compat: bool = False) -> DataFrame:
    """Log score of every category holding a query term.

    ``compat`` takes (alpha + tf) / len + alpha |V| as the factor, without the sum in the
    denominator. A category of length zero has no score.
    """
    v = F.lit(alpha * index.stats["n_terms"])
    a, tf, n = F.lit(alpha), F.col("tf"), F.col("len")
    term, absent = (F.log((a + tf) / n + v), F.log(a / n + v)) if compat else (F.log((a + tf) / (n + v)), F.log(a / (n + v)))
    rows = _category_hits(index, query, categories).join(category_lengths(index, categories), "category").where("len > 0")
    scored = rows.groupBy("qid", "category").agg(F.sum(term - absent).alias("gain"), F.first(absent).alias("absent")).join(small(_query_sizes(query)), "qid")
    return scored.select("qid", "category", (F.col("gain") + F.col("n_query") * F.col("absent")).alias("log_score"))


def category_lm_jelinek_mercer(index: Index, query: DataFrame, categories: DataFrame, lam: float = 0.5) -> DataFrame:
    terms, base = _collection_part(index, query, lam)
    rows = _category_hits(index, query, categories).join(category_lengths(index, categories), "category").where("len > 0").join(small(terms), ["qid", "term"])
    gain = F.sum(F.log(F.lit(lam) * F.col("tf") / F.col("len") + F.col("p")) - F.log("p"))
    return rows.groupBy("qid", "category").agg(gain.alias("gain")).join(small(base), "qid").select("qid", "category", (F.col("gain") + F.col("base")).alias("log_score"))


def top_k(scores: DataFrame, k: int, score: str = "score", digits: int | None = None) -> DataFrame:
    """(qid, rank, doc_id, score): best first, equal scores by smaller doc_id, null scores last.

    Scores count as equal that agree to nine places, since a sum depends on the order of its terms.
    """
    s = F.round(score, digits) if digits is not None else F.col(score)
    ranked = scores.select("qid", "doc_id", s.alias("score")).withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc_nulls_last(F.round("score", 9)), "doc_id")))
    return ranked.where(F.col("rank") <= k).select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "score")
