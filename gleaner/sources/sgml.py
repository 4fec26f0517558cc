"""SGML news files: elements with an id, title, body and category tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.runtime import map_arrow

#: The category tags, and the named entities that are decoded.
TAGS = ("topics", "places", "people", "orgs", "exchanges", "companies")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def scan(spark: SparkSession, path: str, pattern: str = "*.sgm") -> DataFrame:
    """(path, element): one row an element of every file of that pattern in a directory, read as Latin-1.

    A file is read as a whole (a news file holds about a thousand elements); files are the unit of
    parallelism. Elements of any letter case are found; what stands outside elements is passed over.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    content = F.decode("content", "ISO-8859-1")
    rows = files.select("path", F.explode(F.split(content, r"(?i)</reuters>")).alias("element"))
    return rows.where(F.col("element").rlike(r"(?is)<reuters[\s>]"))


def _field(tag: str) -> Column:
    return decode_entities(F.regexp_extract("element", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))


def decode_entities(text: Column) -> Column:
    """Named and decimal character references; control references vanish."""
    text = F.regexp_replace(text, r"&#([0-9]|1[0-9]|2[0-9]|3[01]|127);", "")
    refs = F.regexp_extract_all(text, F.lit(r"&#([0-9]{2,7});"), F.lit(1))
    text = F.aggregate(F.array_distinct(refs), text, lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), _char(n)))
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def _char(number: Column) -> Column:
    """The character of a decimal code, by way of UTF-32 bytes (char() stops at 255)."""
    return F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")


def joined(title: Column, body: Column) -> Column:
    """Title, line break, body; plain concatenation if either is empty or null."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    return F.when((t == "") | (b == ""), F.concat(t, b)).otherwise(F.concat(t, F.lit("\n"), b))


def documents(elements: DataFrame) -> DataFrame:
    """(doc_id, text); elements without a title or body have empty text, those without an id are left out."""
    newid = F.regexp_extract("element", r'(?is)<reuters[^>]*\snewid="?([0-9]+)', 1)
    return elements.where(newid != "").select(newid.cast("long").alias("doc_id"), joined(_field("title"), _field("body")).alias("text"))


def categories(elements: DataFrame) -> DataFrame:
    """(category, doc_id): a row for each entry of the six tags, in one name space, repeats kept."""
    newid = F.regexp_extract("element", r'(?is)<reuters[^>]*\snewid="?([0-9]+)', 1)
    bodies = F.array(*(F.regexp_extract("element", rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1) for t in TAGS))
    entries = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(r"(?is)<d>(.*?)</d>"), F.lit(1))))
    rows = elements.where(newid != "").select(newid.cast("long").alias("doc_id"), F.explode(entries).alias("category"))
    return rows.select(decode_entities(F.col("category")).alias("category"), "doc_id")


def category_map(categories: DataFrame) -> DataFrame:
    """(category, doc_id, n): how often each document stands under each category; null categories are dropped.

    Rows and not a list a category, which could hold every document.
    """
    return categories.where("category is not null").groupBy("category", "doc_id").agg(F.count("*").alias("n"))


def write(elements: DataFrame, path: str) -> None:
    """Write an ``element`` column as text files of plain ASCII: other characters become references."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            plain = [x.encode("ascii", "xmlcharrefreplace").decode() + "</REUTERS>" for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(plain, pa.string())], names=["value"])

    map_arrow(elements.select("element").where("element is not null"), run, "value string").write.text(path)
