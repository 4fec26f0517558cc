import random

import pytest

WORDS = "oil price union court harvest server clinic goal bond probe field trial cell market team river stone paper light cloud".split()


@pytest.fixture
def prose():
    """Deterministic running text."""

    def make(seed, sentences=8):
        r = random.Random(seed)
        return " ".join(" ".join(r.choice(WORDS) for _ in range(r.randint(5, 11))).capitalize() + "." for _ in range(sentences))

    return make
