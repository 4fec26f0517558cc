import random
from collections import Counter, defaultdict

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import packing

TOKEN = regex.compile(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")


def laid_out(runs):
    bins = defaultdict(list)
    for size, lo, hi, first, each, offset in runs:
        for r in range(lo, hi):
            bins[first + (r - lo) // each].append((offset + (r - lo) % each * size, size))
    return bins


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=25))
def test_plans_are_packings(counts):
    bins = laid_out(packing.plan(counts, 40))
    assert Counter(s for b in bins.values() for _, s in b) == Counter(counts)
    assert sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        at = 0
        for place, size in sorted(b):
            assert place == at
            at += size
        assert at <= 40
        assert sum(3 * s > 40 for _, s in b) <= 2
    least = -(-sum(s * n for s, n in counts.items()) // 40)
    assert len(bins) <= max(1, 1.6 * least + 1) or any(2 * s > 40 for s in counts)


def test_plan_is_short_and_tight():
    r = random.Random(8)
    counts = Counter(min(2048, max(1, int(r.lognormvariate(5.3, 0.9)))) for _ in range(200_000))
    runs = packing.plan(counts)
    used = sum(s * n for s, n in counts.items())
    assert len(runs) < 20_000
    assert used / 2048 / (1 + max(f + (hi - lo - 1) // e for _, lo, hi, f, e, _ in runs)) > 0.995


def test_wrong_sizes():
    with pytest.raises(ValueError, match="capacity"):
        packing.plan({50: 1}, 40)


@pytest.mark.parametrize("group", [1_000_000, 7])
def test_pack(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "RANK_GROUP", group)
    r = random.Random(2)
    texts = ["ab, c-d 3.5 ราคา 油价。 x　y", None, "", " \n", "a " * 45, "a " * 20, "." * 41] + ["w " * r.randint(1, 12) for _ in range(80)] + ["w w w"] * 30
    rows = [(i, t, i, "clash") for i, t in enumerate(texts)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, size long, container string"), capacity=20).collect()
    size = {i: len(TOKEN.findall(t or "")) for i, t, *_ in rows}
    parts, bins = defaultdict(dict), defaultdict(list)
    for x in got:
        parts[x.doc_id][x.part_no] = x.n_tokens
        if size[x.doc_id]:
            bins[x.container].append((x.place, x.n_tokens))
        else:
            assert x.container is None and x.place is None
    assert {i: sum(p.values()) for i, p in parts.items()} == size
    assert all(len(p) == max(1, -(-size[i] // 20)) for i, p in parts.items())
    for b in bins.values():
        at = 0
        for place, n in sorted(b):
            assert place == at
            at += n
        assert at <= 20
    row = packing.fill(packing.pack(spark.createDataFrame(rows, "doc_id long, text string, a long, b string"), 20), 20).first()
    assert (row.n_containers, row.n_tokens) == (len(bins), sum(size.values()))


def test_layout_shows_faults(spark):
    good = [(1, 0, 5, 0, 0), (2, 0, 3, 0, 5), (3, 0, 8, 1, 0), (3, 1, 2, 2, 0)]
    schema = "doc_id long, part_no int, n_tokens long, container long, place long"
    row = lambda rows: tuple(packing.layout(spark.createDataFrame(rows, schema), 8).first())
    assert row(good) == (3, 18, 4, 0, 0, 0, 0, 0)
    assert row([*good[:1], (2, 0, 3, 0, 4), *good[2:]])[3] == 1
    assert row([*good[:1], (2, 0, 3, 0, 6), *good[2:]])[4:6] == (1, 1)
    assert row([*good, (4, 0, 1, 4, 0), (4, 1, 1, 5, 0)])[6:] == (1, 1)
    assert row([]) == (0,) * 8


def test_empty(spark):
    df = packing.pack(spark.createDataFrame([], "doc_id long, text string"))
    assert df.collect() == []
    assert packing.fill(df).first().n_containers == 0
