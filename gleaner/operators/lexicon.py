"""Spelling: k-gram and phonetic indexes over the dictionary, wildcard and sounds-like suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.runtime import small


def kgram_index(dictionary: DataFrame, k: int = 2) -> DataFrame:
    """(gram, word), a row an occurrence: a gram that repeats in a word repeats its row."""
    return dictionary.select(F.explode(text.kgrams(F.col("word"), k)).alias("gram"), "word")


def soundex_index(dictionary: DataFrame) -> DataFrame:
    """(code, word) of every word that has a code."""
    return dictionary.select(text.soundex(F.col("word")).alias("code"), "word").where("code is not null")


def wildcard_options(kgrams: DataFrame, patterns: DataFrame, dictionary: DataFrame | None = None, k: int = 2) -> DataFrame:
    """(pattern, word): dictionary words that match each pattern of ``patterns(pattern)``.

    The grams of a pattern that hold no star select words first, then the whole pattern is matched.
    A pattern without such a gram (``*``, ``*a*``) is matched against ``dictionary`` if that is
    given, and has no options otherwise. An empty index gives no rows.
    """
    lit = F.transform(F.split("pattern", r"\*"), lambda p: F.regexp_replace(p, r"([.^$|()\[\]{}+?\\])", r"\\$1"))
    wanted = patterns.select("pattern").distinct().withColumn("regex", F.concat(F.lit("^("), F.array_join(lit, ".*"), F.lit(")$")))
    grams = F.filter(F.array_distinct(text.kgrams(F.col("pattern"), k)), lambda g: ~g.contains("*"))
    wanted = wanted.withColumn("grams", grams)
    needed = small(wanted.select("pattern", "regex", F.size("grams").alias("n"), F.explode("grams").alias("gram")))
    # only rows of the wanted grams are counted (a gram may stand in a word more than once)
    hits = kgrams.join(needed, "gram").groupBy("pattern", "regex", "n", "word").agg(F.countDistinct("gram").alias("found"))
    out = hits.where((F.col("found") == F.col("n")) & F.expr("rlike(word, regex)")).select("pattern", "word")
    if dictionary is not None:
        free = small(wanted.where(F.size("grams") == 0).select("pattern", "regex"))
        out = out.unionAll(dictionary.select("word").join(free, F.expr("rlike(word, regex)")).select("pattern", "word"))
    return out


def first_wildcard(queries: DataFrame) -> DataFrame:
    """(qid, pattern): the first token with a star of each raw query that has one, in lower case."""
    stars = F.filter(text.tokenize(F.lower(F.col("text"))), lambda w: w.contains("*"))
    return queries.select("qid", F.get(stars, F.lit(0)).alias("pattern")).where("pattern is not null")


def soundex_suggestions(query: DataFrame, terms: DataFrame, soundex: DataFrame) -> DataFrame:
    """(qid, word, suggestion): for each query term outside the index, the words of the same code."""
    unknown = query.select("qid", "term").distinct().join(terms.select("term"), "term", "left_anti")
    coded = small(unknown.select("qid", F.col("term").alias("word"), text.soundex(F.col("term")).alias("code")).where("code is not null"))
    return soundex.withColumnRenamed("word", "suggestion").join(coded, "code").select("qid", "word", "suggestion")
