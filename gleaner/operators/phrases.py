"""Phrases: runs of two or three words picked by pointwise mutual information within a document."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.index import HIGH_TF, Index
from gleaner.runtime import cut, map_arrow, small

#: (least frequency, least PMI) of pairs and triples: in the index, and in queries.
BUILD = {2: (2, 6.0), 3: (2, 12.0)}
QUERY = {2: (0, 1.0), 3: (0, 1.0)}


def ngrams(terms: Column, n: int) -> Column:
    """Array of the runs of n neighbouring elements; shorter arrays have none."""
    if n not in (2, 3):
        raise ValueError("phrases have two or three words")
    last = F.size(terms) - n
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.array(*(F.get(terms, i + j) for j in range(n))))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<array<string>>"))


def pmi(terms_of: DataFrame, n: int, min_freq: int, min_pmi: float, key: str = "doc_id") -> DataFrame:
    """(key, gram, tf, pmi) of the n-grams of each document that reach both bounds.

    log2(c N^(n-1) / product of the counts of the words), N being the apt words of the document.
    With two occurrences or more this is at most log2(N / 2) (pairs) or log2(N^2 / 4) (triples), so
    shorter documents are passed over. All figures belong to one document, so they are counted where
    its row is, by sorting word numbers: nothing is shuffled.
    """
    import pyarrow as pa

    if n not in (2, 3):
        raise ValueError("phrases have two or three words")

    def run(batches):
        for b in batches:
            for rows in (b.slice(i, PMI_ROWS) for i in range(0, b.num_rows, PMI_ROWS)):
                yield _pmi_batch(rows, n, min_freq, min_pmi, key)

    size = F.size("terms")
    rows = terms_of.where(size >= n)
    if min_freq >= 2:
        rows = rows.where(size >= 2 ** (min_pmi / (n - 1) + 1))
    kind = terms_of.schema[key].dataType.simpleString()
    return map_arrow(rows.select(key, "terms"), run, f"{key} {kind}, gram array<string>, tf long, pmi double")


#: Documents whose n-grams are counted together.
PMI_ROWS = 256


def _pmi_batch(rows, n: int, min_freq: int, min_pmi: float, key: str):
    """The n-grams of a slice of (key, terms) that reach the bounds, as an Arrow batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    terms = rows.column(1)
    coded = terms.flatten().dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    _, used, uses = np.unique(doc * len(coded.dictionary) + word, return_inverse=True, return_counts=True)
    count = uses[used].astype(np.float64)  # of each position's word in its document
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
    code, product = doc[at], np.ones(len(at))
    for j in range(n):
        # numbers of the prefixes so far, kept dense so that the next word fits beside them
        code = np.unique(code * len(coded.dictionary) + word[at + j], return_inverse=True)[1]
        product *= count[at + j]
    _, first, tf = np.unique(code, return_index=True, return_counts=True)
    value = np.log2(tf * size[doc[at[first]]].astype(np.float64) ** (n - 1) / product[first])
    keep = (tf >= min_freq) & (value >= min_pmi - 1e-12)
    start = at[first[keep]]
    words = coded.dictionary.take(pa.array(word[(start[:, None] + np.arange(n)).ravel()]))
    gram = pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1, dtype=np.int32) * n), words)
    return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc[start])), gram, pa.array(tf[keep].astype(np.int64)), pa.array(value[keep])], names=[key, "gram", "tf", "pmi"])


def accepted(terms_of: DataFrame, bounds: dict = BUILD) -> DataFrame:
    """(gram): phrases that pass in at least one document."""
    parts = [pmi(terms_of, n, f, p).select("gram") for n, (f, p) in bounds.items()]
    return parts[0].unionAll(parts[1]).distinct() if len(parts) > 1 else parts[0].distinct()


def phrase_postings(terms_of: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, doc_id, tf) of every accepted phrase in all documents that hold it: one hash join on the phrase.

    Few phrases pick their n-grams before anything is counted or shuffled.
    """
    both = terms_of.select("doc_id", F.explode(F.concat(ngrams(F.col("terms"), 2), ngrams(F.col("terms"), 3))).alias("gram"))
    return both.join(small(grams), "gram", "left_semi").groupBy("gram", "doc_id").agg(F.count("*").alias("tf"))


def phrase_stats(postings: DataFrame) -> DataFrame:
    """(gram, df, cf)."""
    return postings.groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_phrases(query_terms_of: DataFrame) -> DataFrame:
    """(qid, term, weight): the phrases of each query, joined by blanks, each with weight 1."""
    parts = [pmi(query_terms_of, n, f, p, "qid").select("qid", "gram") for n, (f, p) in QUERY.items()]
    return parts[0].unionAll(parts[1]).select("qid", F.array_join("gram", " ").alias("term"), F.lit(1.0).alias("weight")).distinct()


def phrase_view(index: Index, bounds: dict = BUILD) -> Index:
    """The index with phrases (joined by blanks) for terms, so every scorer works on phrases; lengths stay those of words."""
    found = cut(phrase_postings(index.terms_of, cut(accepted(index.terms_of, bounds))))
    stats = cut(phrase_stats(found))
    term = F.array_join("gram", " ").alias("term")
    postings = found.join(stats.select("gram", "df"), "gram").join(index.lengths, "doc_id").select(term, "doc_id", "tf", "len", "df", (F.col("tf") >= HIGH_TF).alias("is_high"))
    return replace(index, postings=postings, terms=stats.select(term, "df", "cf"))
