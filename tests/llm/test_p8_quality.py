import random

import numpy as np
import pytest

from gleaner.llm import quality


def document(r, kind, prose):
    if kind == "prose":
        return prose(r.random(), r.randint(3, 9)) + "\n\n" + prose(r.random(), 4)
    if kind == "list":
        mark = r.choice(["- ", "* ", "[x] ", ""])
        return "\n".join(mark + r.choice(["Alder Group", "the oil price", "Dr. Moss", "Port Elm office"]) for _ in range(r.randint(8, 20)))
    if kind == "table":
        sep = r.choice([",", "\t", "   ", " | "])
        return "\n".join(sep.join(["Row", *(str(r.randint(1, 999)) for _ in range(4))]) for _ in range(r.randint(6, 15)))
    return "\n".join("".join(r.choice("#$%&*!?/|~^" if k % 2 else "qwrtzpsdfghjklxcvbnm0189") for _ in range(70)) for k in range(r.randint(4, 9)))


@pytest.fixture
def labelled(prose):
    r = random.Random(7)
    kinds = [r.choice(["prose", "prose", "list", "table", "junk"]) for _ in range(400)]
    return [document(r, k, prose) for k in kinds], kinds


def test_held_out_accuracy(labelled):
    texts, kinds = labelled
    model = quality.train(texts[:250], kinds[:250])
    by, lines, _ = quality.shares(texts[250:], model)
    got = [quality.KINDS[i] for i in by.argmax(1)]
    assert sum(a == b for a, b in zip(got, kinds[250:])) >= 145
    assert lines.tolist() == [sum(1 for x in t.split("\n") if x.strip()) for t in texts[250:]]
    mixed = texts[kinds.index("prose")] + "\n\n" + texts[kinds.index("table")][:40]
    assert quality.shares([mixed], model)[0].argmax() == 0


def test_viterbi_is_the_best_path(labelled):
    import itertools

    texts, kinds = labelled
    model = quality.train(texts[:100], kinds[:100])
    x, doc, chars = quality.line_features([texts[0][:200] + "\n- a\n- b\n1,2,3\n#$%", "one line", texts[1][:60]])
    e, tags = model.line_scores(x, doc, chars), model.tag(x, doc, chars)
    for d in np.unique(doc):
        at = np.flatnonzero(doc == d)[:6]
        if len(at) < (doc == d).sum():
            continue
        score = lambda p: model.start[p[0]] + sum(model.move[a, b] for a, b in zip(p, p[1:])) + sum(e[i, s] for i, s in zip(at, p))  # noqa: E731, B023
        best = max(itertools.product(range(4), repeat=len(at)), key=score)
        assert score(tuple(tags[at])) == pytest.approx(score(best))


def test_operator(spark, labelled):
    texts, kinds = labelled
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(9001, None, "x"), (9002, "", "x"), (9003, " \n\n", "x"), (9004, "w" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(kinds[:200])] + [(None, "junk"), (5, None), (6, "other")], "doc_id long, kind string")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.kind for r in quality.verdicts(docs, model).collect()}
    assert not {9001, 9002, 9003} & set(got)
    assert sum(got[i] == k for i, k in enumerate(kinds)) >= 385
    common = quality.common_words(docs)
    stats = {r.doc_id: r for r in quality.statistics(docs, model, common).collect()}
    assert len(stats) == len(rows)
    assert (stats[9001].n_words, stats[9001].mean_word_length, stats[9001].kind) == (0, None, None)
    i = kinds.index("prose")
    words = "".join(c if c.isalpha() else " " for c in texts[i]).split()
    assert stats[i].n_words == len(words)
    assert stats[i].mean_word_length == pytest.approx(sum(map(len, words)) / len(words))
    black = [c for c in texts[i] if not c.isspace()]
    assert stats[i].symbol_ratio == pytest.approx(sum(not c.isalnum() for c in black) / len(black))
    assert stats[i].closed_line_share == 1.0
    assert {r.kind for r in quality.verdicts(docs, model).collect()} <= set(quality.KINDS)


FOREIGN = {
    "ja": ("グハミ社は 実験装置 を 測定した。", "中央銀行", "株価"), "zh": ("中央银行 昨天 超过了 玛德洛公司。", "教练组", "风电场"),
    "th": ("ผู้รักษาประตู กล่าวว่า วัคซีน ดีขึ้น", "อัยการ", "วัคซีน"), "hi": ("अस्पताल ने उर्वरक की पुष्टि की।", "गोलकीपर", "उर्वरक"),
}


def foreign(r, language, kind):
    sentence, *names = FOREIGN[language]
    words = sentence.split()
    if kind == "prose":
        glue = "" if language in ("ja", "zh") else " "
        return "\n\n".join(glue.join(glue.join(r.sample(words, len(words))) for _ in range(r.randint(3, 7))) for _ in range(r.randint(2, 4)))
    if kind == "list":
        return "\n".join("- " + r.choice(names) for _ in range(r.randint(8, 20)))
    return "\n".join("\t".join([r.choice(names), *(str(r.randint(1, 999)) for _ in range(4))]) for _ in range(r.randint(6, 15)))


def test_wrong_labels_do_not_turn_a_language(prose):
    """5 % wrong labels, among them Chinese and Japanese prose called junk; ten draws of the labels."""
    for draw in range(10):
        r = random.Random(draw)
        made = []
        for _ in range(700):
            kind = r.choice(["prose", "prose", "prose", "list", "table", "junk"])
            language = r.choice(["en", "en", *FOREIGN]) if kind != "junk" else "en"
            made.append((document(r, kind, prose) if language == "en" else foreign(r, language, kind), kind, language))
        fit, test = made[:450], made[450:]
        given = [r.choice(quality.KINDS) if r.random() < 0.05 else k for _, k, _ in fit]
        for language in ("zh", "ja"):
            given[next(i for i, m in enumerate(fit) if m[1:] == ("prose", language))] = "junk"
        by, _, _ = quality.shares([t for t, _, _ in test], quality.train([t for t, _, _ in fit], given))
        got = [quality.KINDS[i] for i in by.argmax(1)]
        for language in ("en", *FOREIGN):
            pairs = [(g, k) for g, (_, k, x) in zip(got, test) if x == language]
            assert sum(g == k for g, k in pairs) >= 0.97 * len(pairs), (draw, language, [p for p in pairs if p[0] != p[1]])


def test_doubtful_labels_are_found(labelled):
    texts, kinds = labelled
    r = random.Random(3)
    wrong = set(r.sample(range(len(texts)), 16))
    given = [r.choice([x for x in quality.KINDS if x != k]) if i in wrong else k for i, k in enumerate(kinds)]
    x, doc, chars = quality.line_features(texts)
    bad = set(np.flatnonzero(quality.doubtful(x, doc, chars, np.array([quality.KINDS.index(k) for k in given]))).tolist())
    assert len(bad & wrong) >= 15 and len(bad - wrong) <= 4


def test_conflicting_labels_have_no_say(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)] + [(0, "text 0")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, "prose"), (0, "prose"), (1, "prose"), (1, "junk"), (2, "list"), (3, None)], "doc_id long, kind string")
    assert quality._labelled(docs, labels, 100, 1000) == (["text 0", "text 2"], ["prose", "list"])
    assert len(quality._labelled(docs, labels, 100, 8)[0]) == 1


def test_empty(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, kind string")
    model = quality.fit(docs, labels)
    assert quality.verdicts(docs, model).collect() == []
    assert quality.statistics(docs, model, quality.common_words(docs)).collect() == []
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert quality.verdicts(one, model).count() == 1
