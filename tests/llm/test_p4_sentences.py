import random

import pytest

from gleaner.llm import sentences

SENTENCES = {
    "en": ["Dr. Alda Moss of Fern Corp. said output rose 4.5 pct.", "Will the court rule?", '"No comment!" was all J. R. Hale would say.', '"We never saw it coming."', "Prices hit $3.2 mln in 1998...", "The plan ... was dropped on Nov. 7.", "It was sold to Brook Inc.", "Talks began at 9 a.m. on Monday.", "It has approx. 40 people."],
    "de": ["Das Werk kostete 3,2 Mio. Euro.", "Er kam am 3. Mai, z. B. mit Hr. Vogt.", "„Das ist gut.“"],
    "ja": ["「もう待てない！」と森氏は叫んだ。", "価格は3.5%上がった。", "林氏は「行く。」と述べた。"],
    "th": ["ราคาน้ำมันเพิ่มขึ้นแล้ว", "นาย Somchai กล่าวว่า 58 บริษัทปิด", "เมื่อวานนี้ฝนตก"],
    "hi": ["डॉ. राम ने कहा कि दाम बढ़े।", "क्या यह सच है?"],
}
SPACE = {"ja": ""}


def make(r, lang, n=6):
    text, units = "", []
    pick = [r.choice(SENTENCES[lang]) for _ in range(n)]
    for i, s in enumerate(pick):
        units.append((len(text), len(text) + len(s)))
        text += s + ("" if i == n - 1 else "\n\n" if r.random() < 0.35 else SPACE.get(lang, " "))
    return text, units


@pytest.fixture(scope="module")
def model():
    r = random.Random(5)
    return sentences.train([make(r, lang)[0] for _ in range(250) for lang in SENTENCES])


@pytest.mark.parametrize("lang", list(SENTENCES))
def test_languages(model, lang):
    r = random.Random(99)
    right = 0
    for _ in range(60):
        text, units = make(r, lang)
        right += sentences.split_text(text, model) == units
    assert right >= 58


def test_misspelt_abbreviations(model):
    for word in ("approx", "aprpox", "appox"):
        assert len(sentences.split_text(f"It has {word}. 40 people. Will the court rule?", model)) == 2


def test_layout(model):
    text = "   Talks began\nat 9 a.m. on Monday.\n \nNet   30  vs   94\nRevs  96  vs   12\n\n-- The desk\n"
    assert [text[s:e] for s, e in sentences.split_text(text, model)] == ["Talks began\nat 9 a.m. on Monday.", "Net   30  vs   94", "Revs  96  vs   12", "-- The desk"]
    assert sentences.split_text("Will the court rule?It was sold to Brook Inc.", model) == [(0, 20), (20, 45)]


def test_run_on_and_wide_blanks(model):
    text = "The plan was sold to Brook Inc.Dr. Alda Moss of Fern Corp. said output rose 4.5 pct."
    assert [text[s:e] for s, e in sentences.split_text(text, model)] == [text[:31], text[31:]]
    text = "It was sold in 1998.  The plan rose 4.5\npct.  It was sold to 30 of\n40 firms.  Talks began at 9 a.m. on Monday."
    assert [text[s:e] for s, e in sentences.split_text(text, model)] == ["It was sold in 1998.", "The plan rose 4.5\npct.", "It was sold to 30 of\n40 firms.", "Talks began at 9 a.m. on Monday."]


@pytest.mark.parametrize("text", [None, "", "  \n\n ", "　"])
def test_nothing(model, text):
    assert sentences.split_text(text, model) == []


def test_viterbi_is_the_best_path(model):
    import itertools

    r = random.Random(2)
    text, _ = make(r, "en")
    cands = sentences.candidates(text.replace("\n\n", " "), False)[:8]

    def score(tags):
        total, prev, last = 0.0, True, 0
        for c, y in zip(cands, tags):
            total += model.weights.get(f"T{int(prev)}{int(y)}{sentences._gap(last, c[0])}", 0.0)
            total += sum(model.weights.get(f, 0.0) for f in sentences._features(c, model)) if y else 0.0
            prev, last = y, c[0]
        return total

    best = max(itertools.product([False, True], repeat=len(cands)), key=score)
    assert score(tuple(sentences.decode(cands, model))) == pytest.approx(score(best))


def test_operator(spark, model):
    df = spark.createDataFrame([(1, "Will the court rule? It was sold to Brook Inc.", "x"), (2, None, "x"), (3, "", "x"), (4, " \n", None), (1, "Will the court rule? It was sold to Brook Inc.", "x")], "newid long, body string, unit_no string")
    got = sorted(tuple(r) for r in sentences.sentences(df, model, with_text=True).collect())
    assert got == [(1, 0, 0, 20, "Will the court rule?")] * 2 + [(1, 1, 21, 46, "It was sold to Brook Inc.")] * 2
    assert sentences.sentences(df.limit(0), model).collect() == []


def test_long_and_odd_texts(model):
    long = "The plan was dropped on Nov. 7. " * 5000
    assert len(sentences.split_text(long, model)) == 5000
    for odd in ('"""' * 50, "." * 1000, "».»«„“", "a" * 10000, "퟿\U0001f600. X", ") . ( ! "):
        units = sentences.split_text(odd, model)
        assert all(0 <= s < e <= len(odd) for s, e in units)


def test_marks_of_other_scripts(model):
    """Closing marks come from a Unicode property, doubled ones too; none of these scripts was in the training texts."""
    arabic = "هل توافق المحكمة؟ نعم توافق."
    assert [arabic[s:e] for s, e in sentences.split_text(arabic, model)] == ["هل توافق المحكمة؟", "نعم توافق."]
    armenian = "Գինը բարձրացավ։ Դատարանը որոշեց։"
    assert len(sentences.split_text(armenian, model)) == 2
    urdu = "قیمت بڑھ گئی۔ عدالت نے فیصلہ کیا۔"
    assert len(sentences.split_text(urdu, model)) == 2
    assert len(sentences.split_text("価格は上がった｡林氏は述べた｡", model)) == 2
    for mark in ("‼", "⁇", "⁈", "?!", "!!!"):
        assert len(sentences.split_text(f"Will the court rule{mark} It was sold to Brook Inc.", model)) == 2, mark


def test_contexts_of_any_length(model):
    """Long tokens have contexts of their own; a long run of marks takes linear time."""
    a, b = "x" * 59 + "a", "x" * 59 + "b"
    left = [c[2] for c in sentences.candidates(f"{a}. Next {b}. Next {a}. Next", False)]
    assert left[0] == left[2] != left[1] and len(left[0]) < 40
    right = [c[3] for c in sentences.candidates(f"One. {a} two. {b} three. {a} four", False)]
    assert right[0] == right[2] != right[1] and len(right[0]) < 40
    for hard in ("a." * 200_000, "1.1-" * 100_000 + " 1. X", "ab.cd" * 80_000, ("z" * 200_000 + ".") * 3, "「" * 100_000 + "。" + " " * 100_000 + "」"):
        assert sentences.split_text(hard, model)[-1][1] <= len(hard)


def test_unpunctuated_text_is_learned_without_marks():
    """Thai with marks and the same without give one model: what is learned needs no mark."""
    r = random.Random(4)
    texts = [make(r, "th")[0] for _ in range(200)]
    marked = [t.replace("แล้ว ", "แล้ว! ").replace("ฝนตก\n", "ฝนตก.\n") for t in texts]
    assert sum(a != b for a, b in zip(texts, marked)) > 50
    models = [sentences.train(x) for x in (texts, marked)]
    assert models[0].weights == models[1].weights
    text = "ราคาน้ำมันเพิ่มขึ้นแล้ว เมื่อวานนี้ฝนตก นาย Somchai กล่าวว่า 58 บริษัทปิด"
    assert [text[s:e] for s, e in sentences.split_text(text, models[1])] == text.replace("ฝนตก ", "ฝนตก|").replace("แล้ว ", "แล้ว|").split("|")


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"Text {i}.") for i in range(500)], "newid long, body string")
    assert 0 < len(sentences.sample_texts(df, "newid", "body", 50)) <= 50
    assert 0 < sum(map(len, sentences.sample_texts(df, "newid", "body", 50, chars=100))) <= 100


def test_rare_abbreviations_count_in_all_reports(spark):
    """A context too rare for the sample is learned from the counts of the whole collection."""
    r = random.Random(8)
    reports = [(i, " ".join(filter(None, [make(r, "en")[0], "It met Zqu. Brook on Monday." if i % 25 == 0 else "", "Prices rose."]))) for i in range(1500)]
    model = sentences.fit(spark.createDataFrame([*reports, *reports[:30]], "newid long, body string"), fit_reports=75)
    assert len(sentences.split_text("Will the court rule? It met Zqu. Brook on Monday. Prices rose.", model)) == 3
    counted = {r[1]: r[3] for r in sentences.count_marks(spark.createDataFrame(reports, "newid long, body string")) if r[0] == "L"}
    assert counted["Zqu"] == 60


def test_sample_is_independent_of_the_order(spark):
    rows = [(i, f"Text {i}.") for i in range(500)]
    picked = [sentences.sample_texts(spark.createDataFrame(x, "newid long, body string").coalesce(1), "newid", "body", 50) for x in (rows, rows[::-1], rows + rows[:250])]
    assert picked[0] == picked[1] == picked[2] and len(picked[0]) == 50
