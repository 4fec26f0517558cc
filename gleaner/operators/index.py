"""The inverted index and its statistics, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.runtime import cut, drop, parallelism, spread, written

HIGH_TF = 5


def term_freq(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def term_stats(freq: DataFrame) -> DataFrame:
    """(term, df, cf): documents holding the term, occurrences in the collection."""
    return freq.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def doc_lengths(terms: DataFrame) -> DataFrame:
    """(doc_id, len) from (doc_id, terms); documents without apt words have length 0."""
    return terms.select("doc_id", F.size("terms").cast("long").alias("len"))


@dataclass
class Index:
    """Tables of one collection, and its analyser. ``stats`` has n_docs, total_len, avgdl and n_terms.

    Whatever is compared with the terms of an index (queries, sentences, feedback) goes through
    ``analyse`` or takes its ``stemmed``.
    """

    documents: DataFrame  # doc_id, text
    terms_of: DataFrame  # doc_id, terms (in order)
    postings: DataFrame  # term, doc_id, tf, len, df, is_high
    terms: DataFrame  # term, df, cf
    lengths: DataFrame  # doc_id, len
    stats: dict
    stemmed: bool = False

    @classmethod
    def build(cls, documents: DataFrame, high_tf: int = HIGH_TF, use_stem: bool = False) -> Index:
        """Index ``documents(doc_id, text)``, words as they are or (``use_stem``) by their stems.

        doc_id must be unique and not null (a repeated id is refused); null and empty texts count
        as documents of length 0. Other columns are ignored.
        """
        documents = documents.select("doc_id", "text")
        terms_of = cut(text.with_terms(spread(documents), stem=use_stem))
        lengths = doc_lengths(terms_of)
        n, distinct, total = lengths.agg(F.count("*"), F.countDistinct("doc_id"), F.coalesce(F.sum("len"), F.lit(0))).first()
        if n != distinct:
            raise ValueError("doc_id must be unique and not null")
        freq = term_freq(text.exploded(terms_of))
        freq = cut(freq.join(lengths, "doc_id"))
        terms = cut(term_stats(freq))
        # range partitions of (term, doc_id): a term in very many documents spans several
        postings = _with_df(freq, terms).withColumn("is_high", F.col("tf") >= high_tf)
        postings = cut(postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"))
        stats = {"n_docs": n, "total_len": total, "avgdl": total / n if n else 0.0, "n_terms": terms.count()}
        return cls(documents, terms_of, postings, terms, lengths, stats, use_stem)

    def dictionary(self) -> DataFrame:
        """(word, freq) of the unstemmed apt words, whatever the index holds."""
        if not self.stemmed:
            return self.terms.select(F.col("term").alias("word"), F.col("cf").alias("freq"))
        words = text.exploded(text.with_terms(self.documents))
        return words.groupBy(F.col("term").alias("word")).agg(F.count("*").alias("freq"))

    def stats_row(self, spark: SparkSession) -> DataFrame:
        s = self.stats
        return spark.createDataFrame([(s["n_docs"], s["total_len"], s["avgdl"], s["n_terms"])], "n_docs long, total_len long, avgdl double, n_terms long")

    def analyse(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, terms) of rows(key, text), by the analysis of the index."""
        return text.with_terms(rows, stem=self.stemmed, key=key)

    @classmethod
    def open_or_build(cls, documents: DataFrame, path: str, high_tf: int = HIGH_TF, use_stem: bool = True) -> Index:
        """The index kept at ``path`` if it was built from these documents with these settings, else built and kept there."""
        spark = documents.sparkSession
        mark = fingerprint(documents, high_tf=high_tf, use_stem=use_stem)
        if not written(spark, f"{path}/manifest") or cls.load(spark, path, mark) is None:
            cls.build(documents, high_tf, use_stem).save(path, mark)
        return cls.load(spark, path, mark)

    TABLES = ("documents", "terms_of", "postings", "terms", "lengths")

    def save(self, path: str, fingerprint: str) -> None:
        """Write every table under ``path``; the manifest with the fingerprint comes last, so a broken run leaves none."""
        drop(self.documents.sparkSession, f"{path}/manifest")
        for name in self.TABLES:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.documents.sparkSession
        s = self.stats
        row = [(fingerprint, s["n_docs"], s["total_len"], s["avgdl"], s["n_terms"], self.stemmed)]
        spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str, fingerprint: str) -> Index | None:
        """The index at ``path`` if it is complete and of this fingerprint, else None."""
        manifest = f"{path}/manifest"
        if not written(spark, manifest):
            return None
        row = spark.read.schema(_MANIFEST).parquet(manifest).first()
        if row is None or row.fingerprint != fingerprint:
            return None
        stats = {k: row[k] for k in ("n_docs", "total_len", "avgdl", "n_terms")}
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.TABLES), stats, row.stemmed)


_MANIFEST = "fingerprint string, n_docs long, total_len long, avgdl double, n_terms long, stemmed boolean"


def fingerprint(documents: DataFrame, **config) -> str:
    """Changes with any document or setting: order-free sum of row hashes, count and configuration."""
    row = documents.agg(F.count("*"), F.sum(F.xxhash64("doc_id", "text").cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}:{sorted(config.items())}"


#: Occurrences from which a term counts as frequent, whatever the number of partitions.
FREQUENT_DF = 10_000


def _with_df(freq: DataFrame, terms: DataFrame) -> DataFrame:
    """Add df to the postings.

    The terms with more than a fraction of a partition's postings are few by construction (their number is
    bounded by the number of partitions) and are broadcast; so a term in every document is never gathered
    in one task. The others take a plain join.
    """
    total = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    least = max(FREQUENT_DF, total // (8 * parallelism(freq.sparkSession)))
    df = terms.select("term", "df")
    frequent = F.broadcast(df.where(F.col("df") >= least))
    return freq.join(frequent, "term").unionAll(freq.join(frequent, "term", "left_anti").join(df.where(F.col("df") < least), "term"))


def query_terms(queries: DataFrame, use_stem: bool = False) -> DataFrame:
    """(qid, term, weight) from (qid, text): the same analysis as documents, weights are counts."""
    rows = text.exploded(text.with_terms(queries, stem=use_stem, key="qid"), "qid")
    return rows.groupBy("qid", "term").agg(F.count("*").cast("double").alias("weight"))
