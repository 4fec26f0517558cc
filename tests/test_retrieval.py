"""The hand-worked mini corpus: four documents, one of them empty."""

import math

import pytest
from pyspark.sql import functions as F

from gleaner.functions import stemming, text
from gleaner.operators import feedback, index as ix, lexicon, phrases, ranking, summary
from gleaner.operators.candidates import tier_filter
from gleaner.plans.search import Searcher, format_results

MINI = [(1, "apple apple banana"), (2, "apple cherry"), (3, "banana banana banana banana banana date"), (4, "")]


@pytest.fixture(scope="module")
def index(spark):
    return ix.Index.build(spark.createDataFrame(MINI, "doc_id long, text string"))


def q(spark, *texts):
    return ix.query_terms(spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "qid long, text string"))


def scores(df, column="score"):
    return {r["doc_id"]: round(r[column], 6) for r in df.collect()}


def test_statistics(index):
    assert index.stats == {"n_docs": 4, "total_len": 11, "avgdl": 2.75, "n_terms": 4}
    assert {r.term: (r.df, r.cf) for r in index.terms.collect()} == {"apple": (2, 3), "banana": (2, 6), "cherry": (1, 1), "date": (1, 1)}
    assert {r.doc_id: r.len for r in index.lengths.collect()} == {1: 3, 2: 2, 3: 6, 4: 0}


@pytest.mark.parametrize(
    ("query", "expected"),
    [("apple", {1: 0.403597, 2: 0.338834}), ("banana", {3: 0.455878, 1: 0.290236}), ("apple banana", {1: 0.693833, 3: 0.455878, 2: 0.338834}), ("apple apple", {1: 0.403597, 2: 0.338834}), ("zebra", {}), ("", {})],
)
def test_bm25(spark, index, query, expected):
    assert scores(ranking.bm25(index, q(spark, query))) == expected


def test_other_scores(spark, index):
    assert scores(ranking.cosine(index, q(spark, "apple"))) == {1: 0.060413, 2: 0.045310}
    assert scores(ranking.bm25(index, q(spark, "apple banana"), high_only=True)) == {3: 0.455878}
    assert scores(ranking.cosine(index, q(spark, "banana"), high_only=True)) == {3: 0.075516}


@pytest.mark.parametrize(
    ("query", "least", "tier", "docs"),
    [("banana", 1, 1, {3}), ("banana", 2, 2, {1, 3}), ("banana", 3, 4, {1, 3}), ("apple banana", 1, 2, {1}), ("apple banana", 2, 4, {1, 2, 3}), ("apple banana", 4, 4, {1, 2, 3}), ("banana cherry", 1, 3, {3}), ("banana zebra", 1, 3, {3})],
)
def test_tiers(spark, index, query, least, tier, docs):
    got = tier_filter(index, q(spark, query), least).collect()
    assert ({r.tier for r in got}, {r.doc_id for r in got}) == ({tier}, docs)


def _candidates(spark, *ids):
    return spark.createDataFrame([(1, i) for i in ids], "qid long, doc_id long")


def test_language_models(spark, index):
    lm = ranking.lm_additive(index, q(spark, "apple"), _candidates(spark, 1, 2))
    assert {k: round(math.exp(v), 6) for k, v in scores(lm, "log_score").items()} == pytest.approx({1: 0.617647, 2: 0.458333}, abs=2e-6)
    both = ranking.lm_additive(index, q(spark, "apple banana"), _candidates(spark, 1))
    assert math.exp(both.first().log_score) == pytest.approx(0.199827, abs=1e-6)
    jm = ranking.lm_jelinek_mercer(index, q(spark, "apple"), _candidates(spark, 1, 2))
    assert {k: math.exp(v) for k, v in scores(jm, "log_score").items()} == pytest.approx({1: 0.469697, 2: 0.386364}, abs=2e-6)
    assert ranking.lm_jelinek_mercer(index, q(spark, "apple zebra"), _candidates(spark, 1)).first().log_score is None


def test_categories(spark, index):
    cats = spark.createDataFrame([("X", 1), ("X", 2), (None, 1), ("E", 4)], "category string, doc_id long")
    value = lambda df: {r.category: math.exp(r.log_score) for r in df.collect()}
    assert value(ranking.category_lm_additive(index, q(spark, "apple"), cats)) == pytest.approx({"X": 0.574074}, abs=1e-6)
    assert value(ranking.category_lm_additive(index, q(spark, "apple"), cats, compat=True)) == pytest.approx({"X": 1.02}, abs=1e-6)
    assert value(ranking.category_lm_jelinek_mercer(index, q(spark, "apple"), cats)) == pytest.approx({"X": 0.436364}, abs=1e-6)


def test_wildcards_and_sounds(spark, index):
    s = Searcher(index)
    assert s.kgrams.where("word = 'banana'").count() == 7
    pattern = lambda *p: spark.createDataFrame([(x,) for x in p], "pattern string")
    assert {tuple(r) for r in lexicon.wildcard_options(s.kgrams, pattern("b*a", "d.te", "*a*")).collect()} == {("b*a", "banana")}
    assert {r.word for r in lexicon.wildcard_options(s.kgrams, pattern("*a*"), s.dictionary).collect()} == {"apple", "banana", "date"}
    queries = spark.createDataFrame([(1, "appel pie"), (2, "b*a"), (3, "apple")], "qid long, text string")
    assert {tuple(r) for r in s.suggestions(queries).collect()} == {(1, "soundex", "appel", "apple"), (2, "wildcard", "b*a", "banana")}
    assert {r.qid for r in s.search(queries, 3).collect()} == {3}


def test_phrases(spark):
    df = spark.createDataFrame([(1, "x y x y".split()), (2, ["one"]), (3, [])], "doc_id long, terms array<string>")
    got = {(r.doc_id, *r.gram) for n in (2, 3) for r in phrases.pmi(df, n, 0, 1.0).collect()}
    assert got == {(1, "x", "y"), (1, "x", "y", "x"), (1, "y", "x", "y")}
    with pytest.raises(ValueError, match="two or three"):
        phrases.ngrams(F.col("terms"), 4)


def _rocchio(spark, index, texts, gamma):
    docs = spark.createDataFrame([(1, r, 10 + r, t) for r, t in enumerate(texts, 1)], "qid long, rank long, doc_id long, text string")
    vectors, judged = feedback.doc_vectors(docs, index), feedback.feedback_docs(docs, 2)
    return {r.term: round(r.weight, 6) for r in feedback.rocchio(q(spark, "apple"), vectors, judged, gamma=gamma).collect()}


def test_rocchio(spark, index):
    assert _rocchio(spark, index, ["apple cherry cherry", "banana banana"], 0) == {"apple": 0.225772, "cherry": 0.90309}
    assert _rocchio(spark, index, ["apple cherry cherry", " ".join(["apple"] * 8)], 0.15) == {"apple": 0.0, "cherry": 0.90309}
    assert _rocchio(spark, index, ["apple"], 0) == {"apple": 1.0}


def test_summary(spark):
    docs = spark.createDataFrame([(1, 7, "Apple pie. Banana split. Apple apple."), (1, 8, "12 34"), (1, 9, None)], "qid long, doc_id long, text string")
    got = {r.doc_id: r.summary for r in summary.summaries(docs, q(spark, "apple")).collect()}
    assert got == {7: "Apple apple. Apple pie. ", 8: "", 9: ""}


def test_search(spark, index):
    s = Searcher(index)
    queries = spark.createDataFrame([(1, "apple banana"), (2, "cherry")], "qid long, text string")
    got = [(r.qid, r.rank, r.doc_id) for r in s.search(queries, 2).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 3), (2, 1, 2)]
    for options in ({"scoring": "cosine"}, {"scoring": "lm"}, {"scoring": "lm", "inexact": True}, {"inexact": True}, {"phrase": True}, {"expansion": True}, {"expansion": True, "feedback_on": "document", "strict_compat": True}):
        assert s.search(queries, 2, **options).columns == ["qid", "rank", "doc_id", "score", "summary"]
        s.search(queries, 2, **options).collect()
    assert "document 1" in format_results(s.search(queries, 1).collect())
    with pytest.raises(ValueError, match="scoring"):
        s.search(queries, 2, scoring="other").collect()


def test_ties_go_to_the_smaller_document(spark):
    rows = spark.createDataFrame([(1, 9, 0.5), (1, 3, 0.5), (1, 4, 0.7)], "qid long, doc_id long, score double")
    assert [r.doc_id for r in ranking.top_k(rows, 2).orderBy("rank").collect()] == [4, 3]


def test_repeated_ids_are_refused(spark):
    with pytest.raises(ValueError, match="unique"):
        ix.Index.build(spark.createDataFrame([(1, "a b"), (1, "c")], "doc_id long, text string"))


def test_nulls_and_empty_tables(spark):
    index = ix.Index.build(spark.createDataFrame([(1, None), (2, "pear")], "doc_id long, text string"))
    assert scores(ranking.bm25(index, q(spark, "pear"))) == {2: pytest.approx(math.log10(2) * 2.2 / (1 + 1.2 * (0.25 + 0.75 / 0.5)), abs=1e-6)}
    none = ix.Index.build(spark.createDataFrame([], "doc_id long, text string"))
    assert none.stats["n_docs"] == 0
    assert ranking.bm25(none, q(spark, "pear")).count() == 0


def test_round_trip_and_fingerprint(spark, index, tmp_path):
    mark = ix.fingerprint(index.documents, high_tf=5)
    assert ix.Index.load(spark, str(tmp_path / "i"), mark) is None
    index.save(str(tmp_path / "i"), mark)
    again = ix.Index.load(spark, str(tmp_path / "i"), mark)
    assert again.stats == index.stats
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, index.postings.collect()))
    assert ix.Index.load(spark, str(tmp_path / "i"), "other") is None


def test_stemmed_index(spark):
    docs = spark.createDataFrame([(1, "running runs"), (2, "nothing"), (3, "")], "doc_id long, text string")
    index = ix.Index.build(docs, use_stem=True)
    assert {r.term: r.cf for r in index.terms.collect()} == {"run": 2, "noth": 1}
    assert index.stats["n_docs"] == 3
    query = ix.query_terms(spark.createDataFrame([(1, "run")], "qid long, text string"), use_stem=True)
    assert set(scores(ranking.bm25(index, query))) == {1}
    assert {r.word for r in index.dictionary().collect()} == {"running", "runs", "nothing"}


STEMS = [(1, "Companies were running. Nothing else."), (2, "A company runs. The river ran."), (3, "Fish swim.")]


def test_stemmed_search(spark):
    """Stems: compani run noth els / compani run river ran / fish swim."""
    s = Searcher(ix.Index.build(spark.createDataFrame(STEMS, "doc_id long, text string"), use_stem=True))
    queries = spark.createDataFrame([(1, "companies running")], "qid long, text string")
    score = 2 * math.log10(3 / 2) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / (10 / 3)))
    for expansion in (False, True):
        got = s.search(queries, 2, suggest=False, expansion=expansion).orderBy("rank").collect()
        assert [(r.doc_id, r.summary) for r in got] == [(1, "Companies were running. "), (2, "A company runs. ")]
        assert [r.score for r in got] == pytest.approx([score] * 2)
    found = spark.createDataFrame(got)
    marked = {r.doc_id: r.summary for r in s.highlighted(found, queries).collect()}
    assert marked[2] == "A \x1b[31mcompany\x1b[0m \x1b[31mruns\x1b[0m. "
    # the stems that feedback sees: of document 1, both at 0.75 * log10(3 / 2)
    top = found.select("qid", "rank", "doc_id", F.col("summary").alias("text"))
    changed = {r.term: r.weight for r in feedback.pseudo_relevance(s.analyse(queries), top, s.index, 2).collect()}
    assert changed == pytest.approx({"compani": 0.75 * math.log10(1.5), "run": 0.75 * math.log10(1.5)})
    phrase = Searcher(ix.Index.build(spark.createDataFrame([(1, " ".join(f"w{'abcdefghij'[i % 10] * (i // 10 + 1)} x" for i in range(70)) + " running companies runs company")], "doc_id long, text string"), use_stem=True))
    assert {tuple(r.gram) for r in phrases.accepted(phrase.index.terms_of, {2: (2, 5.0)}).collect()} == {("run", "compani")}
    found = phrases.query_phrases(phrase.index.analyse(spark.createDataFrame([(1, "run company")], "qid long, text string"), "qid"))
    assert [tuple(r) for r in found.collect()] == [(1, "run compani", 1.0)]
    unknown = spark.createDataFrame([(1, "rivver")], "qid long, text string")
    assert [tuple(r) for r in s.suggestions(unknown).collect()] == [(1, "soundex", "rivver", "river")]


def test_stems_of_arrays(spark):
    rows = [(1, ["running", "runs", None]), (2, []), (3, None), (4, ["companies"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, words array<string>").repartition(1)
    got = {r[0]: r[1] for r in df.select("doc_id", stemming.stems(F.col("words"))).collect()}
    assert got == {1: ["run", "run", None], 2: [], 3: None, 4: ["compani"] * 3}


def test_kept_tables_follow_the_documents(spark, tmp_path):
    docs = spark.createDataFrame(STEMS, "doc_id long, text string")
    s = Searcher.open_or_build(docs, str(tmp_path))
    words, grams, sounds, terms = ({tuple(r) for r in t.collect()} for t in (s.dictionary, s.kgrams, s.soundex, s.phrase_index.terms))
    folders = sorted(p.name for p in next(tmp_path.iterdir()).iterdir())
    assert {"dictionary", "kgrams2", "soundex", "phrases", "phrase_terms", "postings", "manifest"} <= set(folders)
    written = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*")}
    again = Searcher.open_or_build(docs.repartition(2), str(tmp_path))
    assert [{tuple(r) for r in t.collect()} for t in (again.dictionary, again.kgrams, again.soundex, again.phrase_index.terms)] == [words, grams, sounds, terms]
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("part-*")} == written
    more = Searcher.open_or_build(docs.unionAll(spark.createDataFrame([(4, "A new word.")], docs.schema)), str(tmp_path))
    assert more.index.stats["n_docs"] == 4 and more.dictionary.where("word = 'new'").count() == 1
    plain = Searcher.open_or_build(docs, str(tmp_path), use_stem=False)
    assert not plain.index.stemmed and plain.index.terms.where("term = 'companies'").count() == 1


def test_models_take_their_settings(spark, index):
    s = Searcher(index)
    queries = spark.createDataFrame([(1, "apple")], "qid long, text string")
    jm = {r.doc_id: math.exp(r.score) for r in s.search(queries, 3, scoring="lm", lam=0.5, suggest=False).collect()}
    assert jm == pytest.approx({1: 0.469697, 2: 0.386364}, abs=2e-6)
    half = {r.doc_id: math.exp(r.score) for r in s.search(queries, 3, scoring="lm", alpha=0.5, suggest=False).collect()}
    assert half == pytest.approx({1: 2.5 / 5, 2: 1.5 / 4})
    flat = {r.doc_id: r.score for r in s.search(queries, 3, b=0.0, suggest=False).collect()}
    assert flat == pytest.approx({1: math.log10(2) * 2 * 2.2 / 3.2, 2: math.log10(2)})
    with pytest.raises(ValueError, match="phrases"):
        s.search(queries, 3, scoring="lm", phrase=True)
    with pytest.raises(ValueError, match="scoring"):
        s.search(queries, 3, scoring="nonsense", phrase=True)
    assert s.search(queries, 3, scoring="lm", phrase=True, strict_compat=True).count() == 0
    high = s.search(spark.createDataFrame([(1, "banana")], "qid long, text string"), 1, inexact=True, restrict_to_candidates=True)
    assert [r.doc_id for r in high.collect()] == [3]


def test_console(spark, index):
    said = []
    s = Searcher(index)
    assert [d for d, _ in s.answer("apple banana", 2, said.append)] == [1, 3]
    assert "\x1b[31mapple\x1b[0m" in said[1] and said[0].endswith("2 results") and said[2].endswith("seconds")
    said.clear()
    assert s.answer("appel", 2, said.append) == [] and said == ["appel sounds like: apple"]
    said.clear()
    assert s.answer("b*a", 2, said.append) == [] and said == ["Did you mean for b*a: banana"]


def test_frequent_terms_take_the_broadcast_way(spark, index, monkeypatch):
    monkeypatch.setattr(ix, "FREQUENT_DF", 2)
    monkeypatch.setattr(ix, "parallelism", lambda spark: 10)
    again = ix.Index.build(index.documents)
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, index.postings.collect()))


def test_phrases_against_brute_force(spark):
    import random
    from collections import Counter

    r = random.Random(4)
    docs = [(i, [r.choice("abcdefg") for _ in range(r.randint(0, 60))]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, terms array<string>").repartition(3)
    for n in (2, 3):
        want = {}
        for i, t in docs:
            one, grams = Counter(t), Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
            want |= {(i, g): (c, round(v, 9)) for g, c in grams.items() if c >= 2 and (v := math.log2(c * len(t) ** (n - 1) / math.prod(one[w] for w in g))) >= 0.5}
        got = {(x.doc_id, tuple(x.gram)): (x.tf, round(x.pmi, 9)) for x in phrases.pmi(df, n, 2, 0.5).collect()}
        assert got == want and want


def test_plans(spark, index):
    plan = ranking.bm25(index, q(spark, "apple"))._jdf.queryExecution().toString()
    assert "EqualTo(term,apple)" in plan or "In(term, [apple])" in plan
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "mapInArrow" not in plan.lower()
    tokens = text.exploded(text.with_terms(spark.createDataFrame(MINI, "doc_id long, text string")))
    assert tokens._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
