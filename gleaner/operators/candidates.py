"""Tiered candidate selection before scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.index import Index
from gleaner.operators.ranking import matched
from gleaner.runtime import cut, small


def tier_filter(index: Index, query: DataFrame, min_docs: int) -> DataFrame:
    """(qid, tier, doc_id): the first tier with at least ``min_docs`` documents.

    1: every term in the high tier; 2: every term anywhere; 3: any term in the high tier; 4: any
    term anywhere, which is also taken when even that is too small. Tiers are tried in this order
    (the third may be smaller than the second). An unknown term leaves tiers 1 and 2 empty.
    """
    terms = query.select("qid", "term").distinct()
    sizes = terms.groupBy("qid").agg(F.count("*").alias("n_query"))
    docs = matched(index, terms).groupBy("qid", "doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("is_high")).alias("h"))
    docs = cut(docs.join(small(sizes), "qid"))  # counted and filtered from one aggregation
    flags = {1: F.col("h") == F.col("n_query"), 2: F.col("n") == F.col("n_query"), 3: F.col("h") > 0}
    chosen = docs.groupBy("qid").agg(*(F.count_if(f).alias(f"n{t}") for t, f in flags.items()))
    tier = F.lit(4)
    for t in (3, 2, 1):
        tier = F.when(F.col(f"n{t}") >= min_docs, t).otherwise(tier)
    rows = docs.join(small(cut(chosen.select("qid", tier.alias("tier")))), "qid")
    keep = F.col("tier") == 4
    for t, f in flags.items():
        keep = keep | ((F.col("tier") == t) & f)
    return rows.where(keep).select("qid", F.col("tier").cast("long").alias("tier"), "doc_id")
