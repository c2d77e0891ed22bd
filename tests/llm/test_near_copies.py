"""The near-copy stage against the true likeness of sets of 5-word shingles."""

import random

import numpy as np
import pyarrow as pa
import pytest

from chainloom.llm import near_copies
from tests.llm import plain

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def say(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def share(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def pair(rng, n, lost):
    """Texts of ``n`` shingles, of which the end of the second differs in ``lost``: likeness (n - lost) / (n + lost)."""
    a = say(rng, n + 4)
    return " ".join(a), " ".join(a[: n + 4 - lost] + say(rng, lost))


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)


@pytest.mark.parametrize(("lost", "linked"), [(33, True), (30, True), (34, False), (37, False), (43, False)])
def test_pairs_close_to_the_limit(spark, lost, linked):
    rng = random.Random(lost)
    texts = [t for _ in range(200) for t in pair(rng, 300, lost)]
    sets = [set(plain.shingles(t, 5)) for t in texts]
    assert all((share(sets[k], sets[k + 1]) >= 0.8) == linked for k in range(0, 400, 2))
    left = corpus_pipeline.drop_near_copies(spark, docs_of(spark, texts), "").count()
    # pairs below the limit never link; of those just above, no key brings 5 of 1,000 together
    assert left <= 203 and left >= 200 if linked else left == 400


def test_groups_by_all_pairs(spark):
    rng = random.Random(8)
    texts = [None, "", "one", "One", "a b c d e", "a b c d f"]
    texts += [t for _ in range(10) for t in pair(rng, 9, 1)]  # exactly 0.8
    for _ in range(6):  # chains, where the ends are less alike than neighbours, in any order
        words = say(rng, 120)
        chain = []
        for k in range(8):
            chain.append(" ".join(words))
            words[14 * k : 14 * k + 9] = say(rng, 9 if k % 3 else 5)
        rng.shuffle(chain)
        texts += chain
    hot = say(rng, 200)
    for k in range(40):
        copy = list(hot)
        for at in rng.sample(range(200), 1 + k % 6):
            copy[at] = f"x{k}"
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    sets = [set(plain.shingles(t, 5)) for t in texts]
    label = plain.closure(len(texts), lambda i, j: share(sets[i], sets[j]) >= 0.8)
    got = {r.doc_id: r.component for r in near_copies.near_copies(docs_of(spark, texts)).collect()}
    assert got == dict(enumerate(label))
    assert 20 < len(set(label)) < len(texts) - 20


def test_candidates_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", 0)
    rng = random.Random(1)
    texts = [t for _ in range(5) for t in pair(rng, 300, 20)]
    got = {r.doc_id: r.component for r in near_copies.near_copies(docs_of(spark, texts)).collect()}
    assert got == {i: i // 2 * 2 for i in range(10)}


def test_texts_that_share_an_id(spark):
    a, b = pair(random.Random(2), 300, 20)
    rows = [(7, "other text of the same id"), (7, b), (3, a), (None, a), (None, "nameless"), (9, "other text of the same id")]
    got = {(r.doc_id, r.component) for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(7, 3), (3, 3), (None, 3), (None, None), (9, 3)}


def test_a_key_with_very_many_rows(monkeypatch):
    monkeypatch.setattr(near_copies, "HOT", 60)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, near_copies.WORDS, dtype=np.uint64)
    fps = np.tile(base, (400, 1))
    for k in range(1, 400):  # copies around the first, and every eighth a stranger
        if k % 8 == 0:
            fps[k] = rng.integers(0, 2**63, near_copies.WORDS, dtype=np.uint64)
        else:
            for b in rng.choice(512, 20, replace=False):
                fps[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    head = fps[:, : near_copies.HEAD].copy().view(np.int64)
    rows = pa.RecordBatch.from_arrays([pa.array([7] * 400), *(pa.array(head[:, k]) for k in range(2)), pa.array([100] * 400), pa.array(range(400))], names=["key", "a", "b", "n", "id"])
    out = [r for b in near_copies._clusters(0.8)([rows]) for r in b.to_pylist()]
    assert {r["id"] for r in out} == set(range(400)) and len({r["cluster"] for r in out}) == 1
    assert {r["hub"] for r in out if r["near"]} == {0}
    assert sum(r["near"] for r in out) == 350

    def across(comp, nearest):
        cols = [pa.array([1] * 400), pa.array(range(400)), pa.array(comp), pa.array([100] * 400), pa.array([f.tobytes() for f in fps], pa.binary())]
        rows = pa.RecordBatch.from_arrays(cols, names=["cluster", "id", "comp", "n", "fp"])
        return [(r["hub"], r["id"]) for b in near_copies._across(0.8, nearest)([rows]) for r in b.to_pylist()]

    comp = [k if k % 8 == 0 or k == 5 else 0 for k in range(400)]
    assert {i for _, i in across(comp, True)} >= {5}
    pairs = {tuple(sorted(p)) for p in across(comp, False)}
    assert pairs == {tuple(sorted((5, k))) for k in range(400) if k != 5 and (k % 8 or k == 0)}
    assert not across([0 if k % 8 or k == 0 else k for k in range(400)], False)


def test_keys_bring_together_what_the_layout_says():
    for sets in (100, 10**6, 10**9):
        width, keys = near_copies.layout(sets, 0.8)
        assert (1 - (1 - near_copies.differing(0.8)) ** width) ** keys <= near_copies.LOST
        assert near_copies.key_bits(width, keys).shape == (keys, width)


def test_an_empty_table(spark):
    assert near_copies.near_copies(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_the_likeness_is_a_share_of_the_union():
    a = np.arange(9, dtype=np.uint64)
    assert near_copies.alike(a[:8], np.r_[a[:8], np.uint64(20), np.uint64(21)], 0.8)
    assert not near_copies.alike(a, np.r_[a[:7], np.uint64(20), np.uint64(21)], 0.8)
