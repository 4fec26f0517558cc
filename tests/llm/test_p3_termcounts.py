from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F

from gleaner.llm import codepoints
from gleaner.llm import termcounts

ROWS = [
    (1, "Oil PRICES", "oil prices rose; oil's up 3pct", 5), (2, None, "über-oil ÜBER", 5), (3, "", "", 5), (4, None, None, 5),
    (5, "x", "x x x x x", 5), (6, "ราคา", "ราคาน้ำมัน 油价上涨。油价", 5), (7, "a b c", "a b c a b c", 5), (8, "a b c", "b c", 5),
]
SCHEMA = "newid long, title string, body string, n long"


def brute(rows, most):
    cf, df = Counter(), Counter()
    for _, title, body, _ in rows:
        seen = set()
        for x in (title, body):
            w = regex.findall(r"\p{L}+", (x or "").lower())
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    g = " ".join(w[i : i + k])
                    cf[g] += 1
                    seen.add(g)
        df.update(seen)
    return {g: (cf[g], df[g]) for g in cf}


def test_against_brute_force(spark, prose, monkeypatch):
    rows = ROWS + [(100 + i, None if i % 5 else "The field", prose(i, 3), 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for most in (1, 3):
        got = {r.term: (r.n_total, r.n_reports) for r in termcounts.term_counts(df, max_terms=most).collect()}
        assert got == brute(rows, most)


def test_heavy_first_terms_are_split(spark, prose, monkeypatch):
    rows = ROWS + [(100 + i, None if i % 5 else "The field", prose(i, 3), 0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(termcounts, "HEAVY_SUFFIXES", 12)
    for most in (2, 3):
        got = [(r.term, (r.n_total, r.n_reports)) for r in termcounts.term_counts(df.repartition(5), max_terms=most).collect()]
        assert len(got) == len(dict(got)) and dict(got) == brute(rows, most)


def test_a_task_sends_a_suffix_once(prose, monkeypatch):
    import pyarrow as pa

    texts = [prose(i, 6) for i in range(80)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts)), pa.array(texts)], names=["r", "t"])
    monkeypatch.setattr(codepoints, "BLOCK_CHARS", 500)
    sent = lambda: [r for out in termcounts._suffix_rows(1, 2)([batch, batch]) for r in out.to_pylist()]
    rows = sent()
    assert len(rows) == len({r["suffix"] for r in rows})
    monkeypatch.setattr(termcounts, "MERGE_ROWS", 200)
    monkeypatch.setattr(termcounts, "HELD_ROWS", 300)
    again = sent()
    assert len(again) > len(rows)
    add = lambda rows: {k: tuple(sum(r[c] for r in rows if r["suffix"] == k) for c in ("n", "d1", "d2")) for k in {r["suffix"] for r in rows}}
    assert add(again) == add(rows)


def test_batches_that_part_a_prefix():
    """The stack carries open prefixes of every length over the end of a batch."""
    import pyarrow as pa

    rows = [("c", 2, 1, 0), ("b b", 1, 1, 1), ("b a", 3, 2, 2), ("b", 1, 1, 0), ("a b", 5, 4, 4), ("a", 1, 0, 0)]
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["suffix", "n", "d1", "d2"])
    want = sorted(tuple(r.values()) for out in termcounts._stack(2)([whole]) for r in out.to_pylist())
    assert want == [("a", 1, 6, 4), ("a b", 2, 5, 4), ("b", 1, 5, 4), ("b a", 2, 3, 2), ("b b", 2, 1, 1), ("c", 1, 2, 1)]
    for step in (1, 2, 4):
        parts = [whole.slice(i, step) for i in range(0, 6, step)]
        assert sorted(tuple(r.values()) for out in termcounts._stack(2)(parts) for r in out.to_pylist()) == want


def test_small_blocks_give_the_same(monkeypatch):
    """The stack over several blocks of the map side equals one block."""
    import pyarrow as pa

    texts = [("a b a b", "b"), ("b a", None), ("a", "a b c")] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t for t, _ in texts]), pa.array([b for _, b in texts])], names=["r", "t", "b"])
    results = []
    for size in (1 << 20, 12):
        monkeypatch.setattr(codepoints, "BLOCK_CHARS", size)
        rows = [r for out in termcounts._suffix_rows(2, 2)([batch]) for r in out.to_pylist()]
        rows.sort(key=lambda r: r["suffix"], reverse=True)
        sent = pa.Table.from_pylist([{k: r[k] for k in ("suffix", "n", "d1", "d2")} for r in rows]).to_batches()
        results.append(sorted(tuple(r.values()) for out in termcounts._stack(2)(sent) for r in out.to_pylist()))
    assert results[0] == results[1]
    assert ("a", 1, 7 * 5, 7 * 3) in results[0]


def test_marks(spark):
    df = spark.createDataFrame([("a", 50, 16), ("b", 50, 15), ("c", 3, 2), ("d", 4, 2), ("e", 3, 3)], "term string, n_total long, n_reports long")
    assert {r.term: r.mark for r in termcounts.marked(df, 100).collect()} == {"a": "common", "b": None, "c": "rare", "d": None, "e": None}


def test_index_figures(spark):
    rows = [("Oil", 1, 2), ("oil", 1, 2), ("oil", 1, None), ("oil", 2, 5), (None, 1, 1), ("x", None, 1), ("y", 3, None)]
    got = termcounts.index_figures(spark.createDataFrame(rows, "term string, doc_id long, term_frequency long"))
    assert {r.term: (r.index_total, r.index_reports) for r in got.collect()} == {"oil": (7, 2), "y": (None, 1)}


def test_empty(spark):
    assert termcounts.term_counts(spark.createDataFrame([], SCHEMA)).collect() == []
