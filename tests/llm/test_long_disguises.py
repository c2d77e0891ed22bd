"""Words in long disguises."""

import random
from collections import Counter

import pytest

from chainloom.llm import toxicity

WORDS = "you are such an idiot and nobody wants the window near this garden where people walk along every morning".split()


@pytest.fixture(scope="module")
def chars():
    grams: Counter = Counter()
    rng = random.Random(4)
    for _ in range(3000):
        code = [0, 0, *[toxicity.INDEX.get(c, 0) for c in rng.choice(WORDS)], 0]
        grams.update((a * toxicity.K + b) * toxicity.K + c for a, b, c in zip(code, code[1:], code[2:], strict=False))
    return toxicity.CharModel(grams)


def test_a_spaced_run_is_read_to_its_end(chars):
    rng = random.Random(9)
    run = " ".join("".join(rng.choice(WORDS[5:]) for _ in range(120)) + "idiot")
    assert len(run) > 900
    assert "idiot" in toxicity.doc_words(run, chars, {})


def test_long_tokens_are_read(chars):
    for token in ["garden-" * 12 + "1d10t", "i" * 90 + "diot", "window.morning." * 8 + "1.d.1.0.t"]:
        assert len(token) > 60
        assert any("idiot" in w for w in toxicity.restored(token, chars))
    assert "garden" in toxicity.restored("garden-" * 12 + "1d10t", chars)


def test_a_very_long_token_takes_one_pass(chars):
    assert len(toxicity.viterbi("1d10t-" * 3000, chars)) >= 5 * 3000
