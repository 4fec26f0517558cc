"""Batch search: raw queries in, ranked and summarised documents out, as one lazy plan."""

from __future__ import annotations

import hashlib
import time
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import feedback, lexicon, phrases, ranking, summary
from gleaner.operators.candidates import tier_filter
from gleaner.operators.index import HIGH_TF, Index, fingerprint, query_terms
from gleaner.runtime import cut, kept, small, written

SCORINGS = ("okapi", "cosine", "lm")


class Searcher:
    """Search over one index; lexicon and phrase tables are made when first needed."""

    def __init__(self, index: Index, kgram: int = 2, path: str | None = None):
        """With ``path`` these tables are kept there, beside the index they were made from."""
        self.index = index
        self.kgram = kgram
        self.path = path
        self._made: dict[str, object] = {}

    @classmethod
    def open_or_build(cls, documents: DataFrame, path: str, high_tf: int = HIGH_TF, use_stem: bool = True, kgram: int = 2) -> Searcher:
        """Everything a search needs, read from ``path`` where it was made from these documents with these settings."""
        mark = hashlib.sha256(fingerprint(documents, high_tf=high_tf, use_stem=use_stem).encode()).hexdigest()[:16]
        return cls(Index.open_or_build(documents, f"{path}/{mark}", high_tf, use_stem), kgram, f"{path}/{mark}")

    def _once(self, name: str, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def _table(self, name: str, make) -> DataFrame:
        return self._once(name, lambda: cut(make()) if self.path is None else kept(f"{self.path}/{name}", make))

    @property
    def dictionary(self) -> DataFrame:
        return self._table("dictionary", self.index.dictionary)

    @property
    def kgrams(self) -> DataFrame:
        return self._table(f"kgrams{self.kgram}", lambda: lexicon.kgram_index(self.dictionary, self.kgram))

    @property
    def soundex(self) -> DataFrame:
        return self._table("soundex", lambda: lexicon.soundex_index(self.dictionary))

    @property
    def phrase_index(self) -> Index:
        """The phrases as an index; its lengths and corpus figures stay those of words."""
        if self.path is None:
            return self._once("phrases", lambda: phrases.phrase_view(self.index))
        view = self._once("phrase_view", lambda: phrases.phrase_view(self.index) if not written(self.index.documents.sparkSession, f"{self.path}/phrases") else None)
        terms = self._table("phrase_terms", lambda: view.terms)
        return replace(self.index, postings=self._table("phrases", lambda: view.postings), terms=terms)

    def analyse(self, queries: DataFrame) -> DataFrame:
        """(qid, term, weight) of raw queries(qid, text)."""
        return query_terms(queries, self.index.stemmed)

    def suggestions(self, queries: DataFrame, strict_compat: bool = False) -> DataFrame:
        """(qid, kind, word, suggestion): wildcard options of the first starred token, else words that sound like unknown terms.

        A pattern without a star-free k-gram is matched against the whole dictionary
        (``strict_compat``: has no options).
        """
        first = lexicon.first_wildcard(queries)
        options = lexicon.wildcard_options(self.kgrams, first.select("pattern"), None if strict_compat else self.dictionary, self.kgram)
        starred = small(first).join(options, "pattern").select("qid", F.lit("wildcard").alias("kind"), F.col("pattern").alias("word"), F.col("word").alias("suggestion"))
        starred = cut(starred)
        rest = self.analyse(queries).join(starred.select("qid").distinct(), "qid", "left_anti")
        sounding = lexicon.soundex_suggestions(rest, self.index.terms, self.soundex)
        return starred.unionAll(sounding.select("qid", F.lit("soundex").alias("kind"), "word", "suggestion"))

    def scores(
        self, query: DataFrame, k: int, scoring: str = "okapi", inexact: bool = False, restrict_to_candidates: bool = False, strict_compat: bool = False,
        alpha: float = 0.1, lam: float | None = None, k1: float = 1.2, b: float = 0.75,
    ) -> DataFrame:
        """(qid, doc_id, score) of weighted queries.

        ``k1`` and ``b`` belong to BM25; ``alpha`` is the additive smoothing of the language model, which
        ``lam`` replaces by that of Jelinek and Mercer.

        Inexact BM25 and cosine score the high tier (``restrict_to_candidates``: and of it only the
        candidates). The language model ranks by log probability over the candidates, or, when exact,
        over every document with a query term (``strict_compat``: exact search with it is BM25).
        """
        if scoring not in SCORINGS:
            raise ValueError(f"scoring must be one of {SCORINGS}")
        if scoring == "lm" and (inexact or not strict_compat):
            candidates = tier_filter(self.index, query, k) if inexact else ranking.matched(self.index, query).select("qid", "doc_id").distinct()
            scored = ranking.lm_additive(self.index, query, candidates, alpha) if lam is None else ranking.lm_jelinek_mercer(self.index, query, candidates, lam)
            return scored.withColumnRenamed("log_score", "score")
        scored = ranking.tfidf_length_norm(self.index, query, inexact) if scoring == "cosine" else ranking.bm25(self.index, query, k1, b, inexact)
        if inexact and restrict_to_candidates:
            scored = scored.join(tier_filter(self.index, query, k).select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
        return scored

    def search(
        self, queries: DataFrame, k: int, scoring: str = "okapi", inexact: bool = False, summary_len: int = 5, expansion: bool = False, phrase: bool = False,
        suggest: bool = True, strict_compat: bool = False, feedback_on: str = "summary", relevant_n: int = 2, restrict_to_candidates: bool = False,
        alpha: float = 0.1, lam: float | None = None, k1: float = 1.2, b: float = 0.75,
    ) -> DataFrame:
        """(qid, rank, doc_id, score, summary) of raw queries(qid, text).

        Queries with suggestions are left out (ask ``suggestions``) unless ``suggest`` is off. Inexact
        search wins over phrases, which have no language model (``strict_compat``: BM25 then). The last five
        settings are those of ``scores``. With expansion the first results feed back through their summaries
        (or ``feedback_on="document"``) and the changed queries are searched again, with the same
        settings (``strict_compat``: by inexact BM25).
        """
        if scoring not in SCORINGS:
            raise ValueError(f"scoring must be one of {SCORINGS}")
        if feedback_on not in ("summary", "document"):
            raise ValueError("feedback_on must be 'summary' or 'document'")
        if phrase and not inexact and scoring == "lm" and not strict_compat:
            raise ValueError("phrases are scored by okapi or cosine")
        models = {"restrict_to_candidates": restrict_to_candidates, "strict_compat": strict_compat, "alpha": alpha, "lam": lam, "k1": k1, "b": b}
        if suggest:
            queries = queries.join(self.suggestions(queries, strict_compat).select("qid").distinct(), "qid", "left_anti")
        query = cut(self.analyse(queries))
        if phrase and not inexact:
            wanted = phrases.query_phrases(self.index.analyse(queries, "qid"))
            scored = ranking.tfidf_length_norm(self.phrase_index, wanted) if scoring == "cosine" else ranking.bm25(self.phrase_index, wanted, k1, b)
        else:
            scored = self.scores(query, k, scoring, inexact, **models)
        found = self._summarised(cut(ranking.top_k(scored, k)), query, summary_len)
        if not expansion:
            return found
        found = cut(found)
        texts = found.select("qid", "rank", "doc_id", F.col("summary").alias("text"))
        if feedback_on == "document":
            texts = found.select("qid", "rank", "doc_id").join(self.index.terms_of, "doc_id").select("qid", "rank", "doc_id", "terms")
        changed = cut(feedback.pseudo_relevance(query, texts, self.index, relevant_n))
        again = self.scores(changed, k, "okapi" if strict_compat else scoring, inexact or strict_compat, **models)
        return self._summarised(cut(ranking.top_k(again, k)), changed, summary_len)

    def _summarised(self, top: DataFrame, query: DataFrame, n: int) -> DataFrame:
        docs = self.index.documents.join(top.select("qid", "doc_id"), "doc_id").select("qid", "doc_id", "text")
        return top.join(summary.summaries(docs, query, n, stem=self.index.stemmed, terms_of=self.index.terms_of), ["qid", "doc_id"], "left").select("qid", "rank", "doc_id", "score", "summary")


    def highlighted(self, found: DataFrame, queries: DataFrame) -> DataFrame:
        """The results of ``search`` with the words of the raw queries marked in their summaries."""
        return summary.highlighted(found, self.analyse(queries), self.index.stemmed)

    def answer(self, query: str, k: int, put=print, **options) -> list[tuple[int, float]]:
        """Answer one raw query on a console: suggestions, or the marked summaries of the results and the time taken.

        Returns (doc_id, score), best first; a query with suggestions has no results.
        """
        started = time.monotonic()
        queries = self.index.documents.sparkSession.createDataFrame([(1, query)], "qid long, text string")
        if options.get("suggest", True):
            hints = self.suggestions(queries, options.get("strict_compat", False)).orderBy("kind", "word", "suggestion").collect()
            if hints:
                put(format_suggestions(hints))
                return []
        rows = self.highlighted(self.search(queries, k, **{**options, "suggest": False}), queries).orderBy("rank").collect()
        put(f"{query} ({options.get('scoring', 'okapi')}): {len(rows)} results")
        put(format_results(rows))
        put(f"{time.monotonic() - started:.3f} seconds")
        return [(r.doc_id, r.score) for r in rows]


def format_results(rows: list) -> str:
    """Collected result rows as text for a console."""
    return "\n".join(f"[{r['qid']}] {r['rank']}. document {r['doc_id']} ({r['score']:.6f})\n{(r['summary'] or '').strip()}\n" for r in rows)


def format_suggestions(rows: list) -> str:
    """Collected suggestions, a line a word: what a pattern may stand for, or what an unknown word sounds like."""
    words: dict[tuple, list[str]] = {}
    for r in rows:
        words.setdefault((r["kind"], r["word"]), []).append(r["suggestion"])
    return "\n".join((f"Did you mean for {w}: " if kind == "wildcard" else f"{w} sounds like: ") + ", ".join(s) for (kind, w), s in words.items())
