import itertools
import math
import random
from collections import Counter, defaultdict

import pytest

from gleaner.llm import cooccurrence

SCHEMA = "ngram_tuple array<string>, doc_id long, tf long, item string"


def brute(rows):
    docs, seen = defaultdict(set), set()
    for words, doc, *_ in rows:
        if doc is not None:
            seen.add(doc)
            item = " ".join(w for w in words or [] if w is not None).lower()
            if item:
                docs[doc].add(item)
    n, p = Counter(), Counter()
    for items in docs.values():
        n.update(items)
        p.update(itertools.combinations(sorted(items), 2))
    return n, p, len(seen)


@pytest.mark.parametrize("block, bits", [(512, 31), (4, 31), (512, 3)])
def test_against_brute_force(spark, monkeypatch, block, bits):
    """Also with more items than half a code holds."""
    monkeypatch.setattr(cooccurrence, "ITEM_BITS", bits)
    r = random.Random(1)
    rows = [([r.choice("abCdefgh"), r.choice("xyz")], r.randint(1, 40), r.choice([None, 2]), "clash") for _ in range(400)]
    rows += [([f"w{i}", "q"], 99, 1, None) for i in range(60)]  # one record holds many items
    rows += [(None, 5, 1, None), ([], 6, 1, None), (["a", None, "x"], 7, 1, None), (["a", "x"], None, 1, None), (["lone", "pair"], 1000, 1, None)]
    n, p, total = brute(rows)
    got = {(x.item_a, x.item_b): x for x in cooccurrence.together(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    assert {k: x.n_shared for k, x in got.items()} == dict(p)
    for (a, b), x in got.items():
        assert (x.n_a, x.n_b, x.n_records) == (n[a], n[b], total)
        assert x.lift == pytest.approx(x.n_shared * total / (n[a] * n[b]))
        s = x.n_shared
        assert x.log_odds == pytest.approx(math.log((s + 0.5) * (total - n[a] - n[b] + s + 0.5) / ((n[a] - s + 0.5) * (n[b] - s + 0.5))))
    least = cooccurrence.together(spark.createDataFrame(rows, SCHEMA), min_shared=3, block=block)
    assert {(x.item_a, x.item_b) for x in least.collect()} == {k for k, c in p.items() if c >= 3}
    assert {tuple(x) for x in cooccurrence.surprising(least).collect()} == {k for k, c in p.items() if c >= 3 and c * total >= 10 * n[k[0]] * n[k[1]]}


def test_empty(spark):
    assert cooccurrence.together(spark.createDataFrame([], SCHEMA)).collect() == []
