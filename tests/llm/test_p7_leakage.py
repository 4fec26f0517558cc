import random

from gleaner.llm import leakage


def brute(docs, items, run):
    grams = {}
    for i, t in items:
        w = leakage.words(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    return {(d, i) for d, t in docs for w in [leakage.words(t)] for k in range(len(w) - run + 1) for i in grams.get(tuple(w[k : k + run]), ())}


def test_against_brute_force(spark, prose):
    r = random.Random(6)
    items = [(i, prose(1000 + i, 4)) for i in range(12)] + [(50, "too short"), (51, None), (52, prose(1000, 4))]
    docs = [(i, prose(i, 12)) for i in range(80)]
    for i in range(0, 80, 2):
        source = r.choice(items[:12])[1].split()
        n = r.choice([11, 12, 13, 14, 25])
        k = r.randrange(max(1, len(source) - n))
        words = docs[i][1].split()
        words[r.randrange(len(words)) : 0] = [w.upper() + r.choice(["", ",", " -"]) for w in source[k : k + n]]
        docs[i] = (i, " ".join(words))
    docs += [(900, None), (901, ""), (902, " "), docs[0]]
    df, it = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 13)
    assert len(want) > 10
    assert sorted(tuple(x) for x in leakage.leaks(df, it).collect()) == sorted(want)
    counts = {r.item_id: r.n_documents for r in leakage.summary(leakage.leaks(df, it), it).collect()}
    assert counts == {i: sum(1 for _, x in want if x == i) for i, _ in items}


def test_empty(spark, prose):
    docs, items = spark.createDataFrame([(1, prose(1))], "doc_id long, text string"), spark.createDataFrame([(1, prose(2))], "item_id long, text string")
    assert leakage.leaks(docs.limit(0), items).collect() == []
    assert leakage.leaks(docs, items.limit(0)).collect() == []


def test_case_that_depends_on_the_place(spark):
    """A sigma at the end of a word has another small form; the dotted I has two characters."""
    text = "Η ΟΔΟΣ ΕΙΝΑΙ ΜΕΓΑΛΗ ΚΑΙ Ο ΔΡΟΜΟΣ ΤΗΣ ΠΟΛΗΣ ΕΙΝΑΙ ΚΛΕΙΣΤΟΣ ΑΠΟ ΧΘΕΣ ΠΙΑ"
    turkish = "İSTANBUL VE İZMİR " + " ".join(f"w{i}" for i in range(11))
    docs = spark.createDataFrame([(1, text), (2, text.lower()), (3, turkish)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(w.lower() for w in text.split())), (8, turkish)], "item_id long, text string")
    assert sorted(tuple(r) for r in leakage.leaks(docs, items).collect()) == [(1, 7), (2, 7), (3, 8)]


def test_many_items_and_a_full_map(spark, prose, monkeypatch):
    """More items than are broadcast, and a map so full that it passes everything: the join decides."""
    monkeypatch.setattr(leakage, "MAP_LEAST", 8)
    monkeypatch.setattr(leakage, "MAP_MOST", 8)
    monkeypatch.setattr(leakage, "small", lambda df: df.hint("merge"))
    items = [(i, prose(i, 5)) for i in range(60)]
    docs = [(i, prose(i % 90, 5) + " " + prose(i + 500, 3)) for i in range(200)]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(docs, items, 13))


def test_map_holds_every_value(spark):
    import numpy as np

    values = np.random.default_rng(1).integers(0, 1 << 63, 5000)
    df = spark.createDataFrame([(int(v),) for v in values], "value long").repartition(3)
    bitmap = leakage.value_map(df, 5000)
    assert leakage.is_set(bitmap, values.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 5000).view(np.uint64)
    assert leakage.is_set(bitmap, others).mean() < 0.03
