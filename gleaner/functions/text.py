"""Text analysis as column expressions: tokens, cleaning, sentences, k-grams, phonetic codes.

The regular expressions stay inside the subset that Java and RE2 read alike (no look-around, no
back-references), with white space spelled out, so the same analysis can be written in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import stemming

#: The stop words.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its",
    "of", "on", "that", "the", "to", "was", "were", "will", "with",
)
BLANK = r"[ \t\n\r\f\x{A0}\x{3000}]"
#: Separation of words from punctuation: (pattern, replacement), applied in this order.
TOKEN_STEPS = (
    (r"[;@#$%&?!<>(){}\[\]\"“”«»‘’„`]|--|[.][.]+", " "),
    (r"[:,]([^0-9])", " $1"),
    (r"[:,]\z", " "),
    (r"[.]" + BLANK, " "),
    (r"[.]\z", " "),
    (r"'(s|m|d|ll|re|ve)?" + BLANK, " "),
    (r"'(s|m|d|ll|re|ve)?\z", " "),
)
APT = r"^\p{L}+$"
#: The digit of each letter from a to z.
SOUNDEX_LETTERS, SOUNDEX_DIGITS = "abcdefghijklmnopqrstuvwxyz", "01230120022455012623010202"


def tokenize(text: Column) -> Column:
    """Array of tokens: punctuation stripped, case kept; null text gives an empty array."""
    x = F.coalesce(text, F.lit(""))
    for pattern, replacement in TOKEN_STEPS:
        x = F.regexp_replace(x, pattern, replacement)
    return F.filter(F.split(x, BLANK + "+"), lambda w: w != "")


def is_apt(word: Column) -> Column:
    """Letters only and no stop word (both as written: the stop list is lower case)."""
    return word.rlike(APT) & ~word.isin(*STOP_WORDS)


def preprocess(text: Column, stem: bool = False) -> Column:
    """Lower-case, tokenise, keep apt words; with ``stem`` then their stems (stop words go by the word as written)."""
    words = F.filter(tokenize(F.lower(text)), is_apt)
    return stemming.stems(words) if stem else words


def clean_text(text: Column) -> Column:
    """Typographic quotation marks to blanks, then each run of white space to one blank."""
    return F.regexp_replace(F.regexp_replace(text, "[’”“]", " "), BLANK + "+", " ")


#: Abbreviations after which a sentence goes on.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "gov", "sen", "rep", "st", "no", "fig", "vs", "jan", "feb", "mar", "apr", "aug", "sept", "oct", "nov", "dec", "e.g", "i.e", "cf", "approx")


def sentences(text: Column, abbreviations: bool = False) -> Column:
    """Array of sentences of the cleaned text: breaks behind . ! ? and a blank.

    With ``abbreviations`` the breaks behind well-known abbreviations and single initials are taken
    back. Splitting marks the breaks with a control character first, which the cleaned text lacks.
    """
    marked = F.regexp_replace(clean_text(text), r"([.!?]) ", "$1\x01")
    if abbreviations:
        known = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
        marked = F.regexp_replace(marked, rf"(?i)(^|[^\p{{L}}.])({known}|\p{{L}})\.\x01", "$1$2. ")
    return F.filter(F.split(marked, "\x01"), lambda s: F.trim(s) != "")


def kgrams(word: Column, k: int) -> Column:
    """Windows of k characters of ``$word$``, in order, repeats kept; shorter words have none."""
    padded = F.concat(F.lit("$"), word, F.lit("$"))
    last = F.length(word) + F.lit(3 - k)
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(padded, i, F.lit(k)))
    return F.when(last >= 1, windows).otherwise(F.array().cast("array<string>"))


def soundex(word: Column) -> Column:
    """Four-character phonetic code; null for words with a letter outside a-z after the first.

    Runs of a digit collapse (zeros separate them), and a last digit equal to the one put out
    before it is dropped.
    """
    d = F.translate(F.substring(word, F.lit(2), F.length(word)), SOUNDEX_LETTERS, SOUNDEX_DIGITS)
    for k in "0123456":
        d = F.regexp_replace(d, f"{k}+", k)
    for k in "123456":
        d = F.regexp_replace(d, f"{k}0{k}$", k)
    code = F.rpad(F.concat(F.substring(word, 1, 1), F.substring(F.replace(d, F.lit("0"), F.lit("")), 1, 3)), 4, "0")
    return F.when(word.rlike(r"^.[a-z]*$"), code)


#: Red on a console, and back.
MARK = ("\x1b[31m", "\x1b[0m")


def highlight(text: Column, terms: Column, mark: tuple[str, str] = MARK) -> Column:
    """Every whole word of ``terms`` in ``text`` once between the marks, whatever its case."""
    on, off = (F.lit(m) for m in mark)
    words = F.concat(F.lit(r"(?iu)(?<!\p{L})("), F.array_join(F.array_distinct(terms), "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, words, F.concat(on, F.lit("$1"), off))).otherwise(text)


def stemmed_matches(words: Column, terms: Column) -> Column:
    """The ``words`` whose stems are among ``terms``."""
    stems = stemming.stems(words)
    return F.filter(F.transform(F.arrays_zip(words.alias("w"), stems.alias("s")), lambda x: F.when(F.array_contains(terms, x["s"]), x["w"])), lambda w: w.isNotNull())


def with_terms(documents: DataFrame, text: str = "text", stem: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, terms): the apt words (or their stems) of every document in order."""
    return documents.select(key, preprocess(F.col(text), stem).alias("terms"))


def exploded(with_terms: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, term). The outer form keeps the optimizer from computing the array twice."""
    rows = with_terms.select(key, F.posexplode_outer("terms").alias("pos", "term"))
    return rows.where(F.col("term").isNotNull())
