"""Large groups of near copies: what is compared inside tasks, and how many rows that takes."""

import random

import pytest

from chainloom.llm import near_copies
from tests.llm import plain
from tests.llm.test_near_copies import docs_of, say, share


def around(rng, core, own, copies):
    """Texts of one passage of ``core`` shingles, each with ``own`` of its own."""
    passage = say(rng, core + 4)
    return [" ".join(passage + say(rng, own)) for _ in range(copies)]


def test_rows_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    rng = random.Random(3)
    texts = around(rng, 100, 14, 600)  # likeness 0.78: every pair is a candidate, and none links
    for k in range(0, 60, 2):  # but for 30 pairs at 0.92
        texts[k + 1] = " ".join(texts[k].split()[:-5] + say(rng, 5))
    rows, links = [], []
    verified, joined = near_copies.verified, getattr(near_copies, "joined", None)

    def counted(f):
        def run(docs, given, size, likeness):
            out = f(docs, given, size, likeness)
            rows.append(given.count()), links.append(out.count())
            return out

        return run

    monkeypatch.setattr(near_copies, "verified", counted(verified))
    if joined:
        monkeypatch.setattr(near_copies, "joined", counted(joined))
    got = {r.doc_id: r.component for r in near_copies.near_copies(docs_of(spark, texts)).collect()}
    assert got == {k: k - k % 2 if k < 60 else k for k in range(600)}
    _, keys = near_copies.layout(600, 0.8)
    assert sum(rows) <= 3 * keys * 600 < 600 * 599 / 2
    assert links[-1] <= 30


@pytest.mark.parametrize("held", [300, 1 << 20])
def test_blocks_and_bins_by_all_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(near_copies, "HELD", held)
    rng = random.Random(held)
    texts = around(rng, 60, 8, 40) + [t for n in (9, 14) for t in around(rng, 100, n, 20)]
    for k in range(0, 40, 3):
        words = texts[k].split()
        texts.append(" ".join([*words[:-6], *say(rng, 6)]))
        texts.append(" ".join([*say(rng, 8), *words]))
    sets = [set(plain.shingles(t, 5)) for t in texts]
    label = plain.closure(len(texts), lambda i, j: share(sets[i], sets[j]) >= 0.8)
    docs = docs_of(spark, texts).cache()
    bytes_of = docs.selectExpr("doc_id id", "cast(text as binary) text")
    rows = spark.createDataFrame([(c, i, i, len(s), 0) for c in (5, 6) for i, s in enumerate(sets) if c == 5 or i % 2 == 0], "cluster bigint, id bigint, comp bigint, n bigint, low bigint")
    links = [(r.u, r.v) for r in near_copies.joined(bytes_of, rows, 5, 0.8).collect()]
    assert all(share(sets[u], sets[v]) >= 0.8 for u, v in links)
    together = {frozenset(x) for x in links}
    assert plain.closure(len(texts), lambda i, j: frozenset((i, j)) in together) == label
    assert 10 < len(set(label)) < len(texts) - 10
    # the groups found before are not joined again
    rows = spark.createDataFrame([(5, i, c, len(s), 0) for i, (s, c) in enumerate(zip(sets, label, strict=True))], rows.schema)
    assert not near_copies.joined(bytes_of, rows, 5, 0.8).count()
    assert {r.doc_id: r.component for r in near_copies.near_copies(docs).collect()} == dict(enumerate(label))


def test_a_bin_with_shared_ids_and_empty_texts():
    one = near_copies._Bin(0.8)
    a, b, none = near_copies.shingle_set(b"a b c d e f", 5), near_copies.shingle_set(b"p q r s t u", 5), near_copies.shingle_set(b"", 5)
    for i, comp, s, held in [(1, 1, a, [7]), (1, 1, b, [7]), (1, 1, b, [7]), (2, 2, none, [8])]:
        one.hold(i, comp, s, held, [])
    out = [link for i, comp, s, met in [(3, 3, b, [7, 9]), (4, 4, none, [8]), (5, 3, a, [7]), (6, 6, a, [8])] for link in one.meet(i, comp, s, met)]
    assert out == [(1, 3), (2, 4)]
    assert list(near_copies._Bin(0.8).close()) == []
