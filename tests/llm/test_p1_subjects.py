import random

import numpy as np
import pytest

from gleaner.llm import sentences, subjects

TOPICS = {"law": "court judge verdict appeal jury".split(), "sport": "goal match referee league striker".split(), "energy": "oil rig pipeline refinery turbine".split()}
FILLER = "the of a from with city mentioned again people said".split()


def _body(r, shares):
    lines = []
    for subject, n in shares.items():
        for _ in range(n):
            words = [r.choice(TOPICS[subject]) for _ in range(3)] if subject else []
            words += [r.choice(FILLER) for _ in range(5)]
            r.shuffle(words)
            lines.append(" ".join(words).capitalize() + ".")
    r.shuffle(lines)
    return " ".join(lines)


@pytest.fixture(scope="module")
def trained(spark):
    r = random.Random(3)
    reports, labels, truth = [], [], {}
    for i in range(600):
        main = r.choice(list(TOPICS))
        other = r.choice(list(TOPICS))
        shares = {main: r.randint(4, 6), None: r.randint(1, 3)}
        if other != main:
            shares[other] = r.choice([1, 4])
        total = sum(shares.values())
        truth[i] = {s for s, n in shares.items() if s and n * 4 >= total}
        code = r.choice(list(TOPICS)) if r.random() < 0.1 else main  # one code in ten is wrong
        reports.append((i, _body(r, shares), None if i % 3 else [f" {code.title()}-1 ", "zz", None]))
        if i % 6 == 0:
            labels += [(i, s) for s in truth[i]]
    reports += [(9001, "", None), (9002, None, []), (9003, "   ", ["LAW-1"])]
    schema = "newid long, body string, topics array<string>"
    lab = spark.createDataFrame([*labels, (None, "law"), (3, None), (77777, "law")], "newid long, subject string")
    codes = spark.createDataFrame([*((f"{s.upper()}-1", s) for s in TOPICS), ("GEN", None)], "code string, subject string")
    boundaries = sentences.train([b for _, b, _ in reports if b])
    rows = subjects.prepared(spark.createDataFrame(reports, schema), lab, codes, boundaries)
    return rows, subjects.train(rows), truth


def test_subjects_by_share_of_sentences(trained):
    rows, model, truth = trained
    got = {}
    for r in subjects.found(subjects.shares(rows, model)).collect():
        got.setdefault(r.newid, set()).add(r.subject)
    wrong = sum(got.get(i, set()) != t for i, t in truth.items())
    assert wrong <= 0.03 * len(truth)
    assert not {9001, 9002, 9003} & set(got)


def test_calibrated_posteriors(trained):
    rows, model, truth = trained
    model = subjects.calibrate(model, rows)
    for r in subjects.posteriors(subjects.shares(rows, model), model).collect():
        assert 0 <= r.posterior <= 1
        if r.unit_share > 0.6:
            assert r.posterior > 0.5


def test_complement_weights_shrink_rare_features():
    counts = np.zeros((4, subjects.NONE + 1))
    counts[0, 0], counts[1, 1], counts[2] = 100, 100, 30
    counts[3, 0] = 2
    w = subjects.complement(counts)
    assert w[0, 0] > 1 > abs(w[2, 0]) and w[3, 0] == 0


def test_empty_tables(spark):
    rows = subjects.prepared(spark.createDataFrame([], "newid long, body string, topics array<string>"), spark.createDataFrame([], "newid long, subject string"), spark.createDataFrame([], "code string, subject string"), sentences.train([]))
    assert subjects.found(subjects.shares(rows, subjects.train(rows, passes=1))).collect() == []


def _document(newid, subject, features):
    """A row of ``featured`` whose sentences have one feature each."""
    label = 1 << subjects.SUBJECTS.index(subject) if subject else 0
    return newid, label, 0, len(features), bytearray(np.arange(len(features), dtype=np.int32).tobytes()), bytearray(np.array(features, np.int32).tobytes())


FEATURED = "newid long, label int, hint int, n_units int, units binary, feats binary"


@pytest.mark.parametrize("about, other", [(9.0, 5.0), (-5.0, -9.0)])
def test_found_is_decided_by_calibrated_evidence(spark, about, other):
    """Skewed evidence (9 against 5, or -5 against -9) is put right by the labelled sample."""
    weights = np.zeros((1 << subjects.BITS, subjects.NONE + 1), np.float32)
    weights[0], weights[1], weights[2] = -30, -30, -30
    law, sport = map(subjects.SUBJECTS.index, ("law", "sport"))
    weights[0, law], weights[1, law], weights[1, sport] = about, other, 15
    docs = [_document(i, ("law", "sport", None, None)[i % 4], [i % 2, 2, 2, 2]) for i in range(400)]
    rows = spark.createDataFrame(docs, FEATURED)
    raw = subjects.SubjectModel(weights, np.zeros(subjects.NONE + 1))
    wrong = []
    for model in (raw, subjects.calibrate_units(raw, rows)):
        got = {r.newid for r in subjects.found(subjects.shares(rows, model)).where("subject = 'law'").collect()}
        wrong.append(len(got ^ {i for i in range(400) if i % 2 == 0}))
    assert wrong == [200, 0]


def test_queries_use_calibrated_evidence(spark, sf):
    from gleaner.llm import queries

    assert queries._subjects(spark, sf)[1].unit_scale is not None


def test_reports_without_a_hit_are_calibrated(spark):
    """Labelled reports that the model misses in all subjects count in the fit, and have posteriors."""
    weights = np.zeros((1 << subjects.BITS, subjects.NONE + 1), np.float32)
    law = subjects.SUBJECTS.index("law")
    weights[0, law], weights[1] = 9, -9
    model = subjects.SubjectModel(weights, np.zeros(subjects.NONE + 1))
    hits = [_document(i, "law", [0, 0, 1, 1]) for i in range(40)]
    missed = [_document(100 + i, "law", [1, 1]) for i in range(160)]
    shifts = [subjects.calibrate(model, spark.createDataFrame(x, FEATURED)).shift[law] for x in (hits, hits + missed)]
    rows = spark.createDataFrame([*hits, *missed, (999, 1, 0, 0, bytearray(), bytearray())], FEATURED)
    got = subjects.posteriors(subjects.shares(rows, model), subjects.calibrate(model, rows)).collect()
    assert shifts[1] > 0 and shifts[1] > shifts[0]
    assert len(got) == 200 * subjects.NONE and min(r.posterior for r in got if r.newid >= 100 and r.subject == "law") > 0.5
    assert subjects.found(subjects.shares(rows, model)).count() == 40


def test_posteriors_are_reliable_on_labels_held_out(trained):
    """By subject, the mean posterior of the labels held out is near the share of those that are right."""
    rows, model, _ = trained
    model = subjects.calibrate(subjects.calibrate_units(model, rows), rows)
    held = rows.where(subjects._held_out() & (rows.label > 0)).select("newid", "label").collect()
    assert 8 <= len(held) <= 40
    label = {r.newid: r.label for r in held}
    got = subjects.posteriors(subjects.shares(rows, model), model).collect()
    for subject in TOPICS:
        mine = [(r.posterior, label[r.newid] >> subjects.SUBJECTS.index(subject) & 1) for r in got if r.subject == subject and r.newid in label]
        assert len(mine) == len(held)
        assert abs(sum(p for p, _ in mine) - sum(y for _, y in mine)) <= 0.1 * len(mine)
        assert sum((p > 0.5) == bool(y) for p, y in mine) >= 0.9 * len(mine)


def test_labels_held_out_are_not_trained_on(spark):
    """Wrong labels of the reports held out change no weight."""
    docs = [_document(i, ("law", "sport")[i % 2], [1 + i % 2, 7]) for i in range(200)]
    rows = spark.createDataFrame([(*d, 2) for d in docs], FEATURED + ", n_feats long")
    held = {r.newid for r in rows.where(subjects._held_out()).collect()}
    wrong = [_document(i, "health", [1 + i % 2, 7]) if i in held else d for i, d in enumerate(docs)]
    again = spark.createDataFrame([(*d, 2) for d in wrong], FEATURED + ", n_feats long")
    assert 20 < len(held) < 60
    assert np.allclose(subjects.train(rows, passes=2).weights, subjects.train(again, passes=2).weights)


def test_table_grows_with_the_collection():
    assert subjects.slot_bits(0) == subjects.slot_bits(10_000) == subjects.BITS
    sizes = [subjects.slot_bits(10**k) for k in range(4, 13)]
    assert sizes == sorted(sizes) and sizes[-1] == subjects.MOST_BITS and len(set(sizes)) == 3


def test_counts_of_many_tasks_add_up(spark):
    """Only slots that a task saw are sent; the sum is that of one task."""
    r = np.random.default_rng(3)
    docs = [(*_document(i, None, (r.integers(0, 1 << 31, 30)).tolist()), 30) for i in range(60)]
    rows = spark.createDataFrame(docs, FEATURED + ", n_feats long")

    def weigh(batch):
        label, _, n, doc, unit, feats = subjects._load(batch, 18)
        return np.tile(np.arange(1, subjects.NONE + 2, dtype=float), (len(feats), 1)), feats

    one, many = (subjects._counted(x, weigh, 18) for x in (rows.coalesce(1), rows.repartition(5)))
    assert np.array_equal(one, many) and one[:, 0].sum() == 1800 and one[:, 8].sum() == 9 * 1800
