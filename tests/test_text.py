import pytest
from pyspark.sql import functions as F

from gleaner.functions import stemming, text


def one(spark, column_of, value):
    return spark.createDataFrame([(value,)], "x string").select(column_of(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("Apple's pie, 3,000 tons (or 4.5).", ["Apple", "pie", "3,000", "tons", "or", "4.5"]),
        ("ab*re pl*y -- end...", ["ab*re", "pl*y", "end"]),
        ("x: y;z", ["x", "y", "z"]),
        ("", []),
        (None, []),
        ("full-time well-known", ["full-time", "well-known"]),
    ],
)
def test_tokenize(spark, given, expected):
    assert one(spark, text.tokenize, given) == expected


def test_preprocess_drops_whole_tokens_and_stop_words(spark):
    assert one(spark, text.preprocess, "The price of U.S. oil rose 3pct; Öl is Über-teuer") == ["price", "oil", "rose", "öl"]
    assert one(spark, text.preprocess, None) == []


def test_clean_text_and_sentences(spark):
    assert one(spark, text.clean_text, "a “b”\n\n c") == "a b c"
    assert one(spark, text.sentences, "One two. Three! Four") == ["One two.", "Three!", "Four"]
    assert one(spark, lambda c: text.sentences(c, True), "Mr. Fox met J. Doe. He left. No. 5 won.") == ["Mr. Fox met J. Doe.", "He left.", "No. 5 won."]


def test_kgrams_keep_repeats(spark):
    assert one(spark, lambda c: text.kgrams(c, 2), "banana") == ["$b", "ba", "an", "na", "an", "na", "a$"]
    assert one(spark, lambda c: text.kgrams(c, 5), "ab") == []


@pytest.mark.parametrize(
    ("word", "code"),
    [("apple", "a140"), ("banana", "b550"), ("cherry", "c600"), ("date", "d300"), ("herman", "h650"), ("bobob", "b100"), ("bobobo", "b110"), ("pfister", "p123"), ("i", "i000"), ("naïve", None), (None, None)],
)
def test_soundex(spark, word, code):
    assert one(spark, text.soundex, word) == code


def test_highlight_marks_whole_words_once(spark):
    df = spark.createDataFrame([("Apple apples APPLE", ["apple"]), ("none", [])], "t string, w array<string>")
    got = [r[0] for r in df.select(text.highlight(F.col("t"), F.col("w"), ("<", ">"))).collect()]
    assert got == ["<Apple> apples <APPLE>", "none"]


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
        ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"),
        ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"), ("feudalism", "feudal"), ("hopefulness", "hope"), ("sensibiliti", "sensibl"),
        ("triplicate", "triplic"), ("formative", "form"), ("electriciti", "electr"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("replacement", "replac"),
        ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("dying", "die"), ("is", "is"),
    ],
)
def test_stem(word, stem):
    assert stemming.stem(word) == stem


def test_stem_table(spark):
    df = spark.createDataFrame([("hopping",), ("cats",), (None,)], "word string")
    assert dict(stemming.stem_table(df).collect()) == {"hopping": "hop", "cats": "cat"}
