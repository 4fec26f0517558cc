"""The Porter stemmer (Porter 1980) with the usual later extensions.

``stem_table`` maps a vocabulary; ``stems`` maps a column of word arrays, an Arrow batch at a time, in
which each distinct word is stemmed once, so that no token is shuffled for its stem.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.runtime import map_arrow, ship

#: Irregular forms and the suffix tables of steps 2 to 4.
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _measure(stem: str) -> int:
    shape = [_vowel(stem, i) for i in range(len(stem))]
    return sum(1 for a, b in zip(shape, shape[1:]) if a and not b)


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y; or a two-letter word of vowel and consonant."""
    n = len(w)
    if n == 2:
        return _vowel(w, 0) and not _vowel(w, 1)
    return n > 2 and not _vowel(w, n - 3) and _vowel(w, n - 2) and not _vowel(w, n - 1) and w[-1] not in "wxy"


def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    # 1a: plurals
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b: past and progressive
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((s for s in ("ed", "ing") if w.endswith(s) and _has_vowel(w[: -len(s)])), None)
        if cut:
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w):
                w = w if w[-1] in "lsz" else w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    # 1c: y to i behind a consonant that isn't the first letter
    if w.endswith("y") and len(w) > 2 and not _vowel(w, len(w) - 2):
        w = w[:-1] + "i"
    w = _replace(w, STEP2)
    if w.endswith("logi") and _measure(w[:-3]) > 0:
        w = w[:-1]
    w = _replace(w, STEP3)
    w = _drop(w)
    # 5: final e and double l
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def _replace(w: str, table: tuple) -> str:
    if table is STEP2 and w.endswith("alli") and _measure(w[:-4]) > 0:
        return _replace(w[:-4] + "al", table)
    for suffix, new in sorted(table, key=lambda x: -len(x[0])):
        if w.endswith(suffix):
            return w[: -len(suffix)] + new if _measure(w[: -len(suffix)]) > 0 else w
    return w


def _drop(w: str) -> str:
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                return rest
            return w
    return w


#: Stems that a Python worker remembers.
KEPT_STEMS = 1 << 18
_kept = lru_cache(KEPT_STEMS)(stem)


def stem_arrays(words):
    """Stems of an Arrow array of word lists; null lists stay null, null words too."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    coded = words.flatten().dictionary_encode()
    stemmed = pa.array([_kept(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), stemmed, mask=words.is_null())


def stems(words: Column) -> Column:
    """The stem of every word of an array column, in order."""
    ship(SparkSession.active())

    def run(column):
        return stem_arrays(column)

    run.__annotations__ = _arrow_types()
    return F.arrow_udf(run, "array<string>")(words)


def _arrow_types() -> dict:
    import pyarrow as pa

    return {"column": pa.Array, "return": pa.Array}


def stem_table(vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem) of a table of distinct words; null words are left out."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            words = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([stem(w) for w in words], pa.string())], names=["word", "stem"])

    return map_arrow(vocabulary.select(vocabulary[word].alias("word")).where("word is not null"), run, "word string, stem string")
