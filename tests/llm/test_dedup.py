import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chainloom.llm import sharding, simhash, substring_dedup, suffix_dedup
from tests.llm import plain


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**16 - 1), min_size=1, max_size=120), st.integers(0, 3), st.integers(1, 3))
def test_the_trie_finds_all_near_pairs(values, budget, groups):
    rest = np.array(sorted(values), np.uint64)
    group = np.array([i * groups // len(values) for i in range(len(values))])
    label = simhash.trie_self_join(group, rest, 16, budget, lambda u, v: np.ones(len(u), bool))
    want = plain.closure(len(values), lambda i, j: group[i] == group[j] and (int(rest[i]) ^ int(rest[j])).bit_count() <= budget)
    assert label.tolist() == want


def test_dense_nodes_go_down_together():
    rng = np.random.default_rng(1)
    rest = np.unique(rng.integers(0, 2**12, 3000).astype(np.uint64))
    label = simhash.trie_self_join(np.zeros(len(rest), int), rest, 12, 1, lambda u, v: np.ones(len(u), bool))
    assert set(label.tolist()) == {0}


def test_simhash_by_brute_force(make, odd):
    got = sorted((r.doc_id, r.fp, r.component) for r in simhash.simhash_components(make(odd)).collect() if r.doc_id is not None)
    named = sorted((i, t) for i, t in odd if i is not None)
    prints = [plain.simhash(t, 3) for _, t in named]
    label = plain.closure(len(named), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert got == [(i, prints[k].to_bytes(8, "little"), named[label[k]][0]) for k, (i, _) in enumerate(named)]


def test_wide_simhash_by_brute_force(make, odd):
    rows = [x for x in odd if x[0] is not None]
    got = {r.doc_id: r.component for r in simhash.simhash_components(make(rows), shingle=5, blocks=16, total=86).collect()}
    named = sorted(dict(rows).items())
    prints = [simhash.fingerprint((t or "").encode(), 5, 8) for _, t in named]
    block = [np.frombuffer(p, np.uint32) for p in prints]
    near = lambda a, b: plain.bits(prints[a], prints[b]) <= 86 and min(np.bitwise_count(block[a] ^ block[b])) <= 2
    label = plain.closure(len(named), near)
    assert got == {i: named[label[k]][0] for k, (i, _) in enumerate(named)}
    assert len(set(got.values())) < len(got) - 8


def test_components_of_long_chains(spark):
    rng = random.Random(5)
    ids = list(range(60))
    rng.shuffle(ids)
    links = list(zip(ids[:40], ids[1:40], strict=False)) + [(ids[50], ids[51])]
    got = {r.v: r.label for r in simhash.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**dict.fromkeys(ids[:40], min(ids[:40])), **dict.fromkeys(ids[50:52], min(ids[50:52]))}


@pytest.mark.parametrize("window", [3, 20])
def test_substring_dedup_by_brute_force(make, odd, window):
    m = min(window, 5)
    df = make(odd)
    spans = substring_dedup.repeated_spans(df, window=window, minimiser=m)
    assert spans.columns == ["id", "start", "stop"]
    out = substring_dedup.substring_dedup(df, window=window, carry=["key", "size"])
    gone = plain.repeated(odd, window)
    want = Counter((i, len(plain.words(t)), len(g), plain.kept(t, g).decode(), "k", 3) for (i, t), g in zip(odd, gone, strict=True))
    assert Counter(tuple(r) for r in out.collect()) == want


def test_repeated_texts_in_many_tasks(make):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(i, text if i % 3 else f"{text} tail{i}") for i in range(100)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(make(rows).repartition(7), keep="digest").collect()}
    assert got == {i: 0 if i == 0 else 50 for i in range(100)}


@pytest.mark.parametrize(("length", "k"), [(50, 8), (12, 4)])
def test_suffix_dedup_by_brute_force(make, odd, length, k):
    spans = suffix_dedup.repeated_passages(make(odd), length=length, k=k).collect()
    gone = {}
    for r in spans:
        gone.setdefault(r.id, set()).update(range(r.start, r.stop))
    for (i, _), want in zip(odd, plain.repeated(odd, length), strict=True):
        assert gone.get(i, set()) == want


def test_groups_of_equal_grams_are_extended(make):
    rng = random.Random(6)
    say = lambda n: [rng.choice("abcdefgh") for _ in range(n)]
    mid, rows = say(10), []
    for i in range(60):  # many surroundings of one passage, alike to the left or to the right for some words
        left, right = (mid_side[:k] + say(14 - k) for mid_side, k in ((say(14) if i % 3 else ["l"] * 14, i % 14), (["r"] * 14, i % 12)))
        rows.append((i // 2, " ".join(left[::-1] + mid + right)))
    rows = [(i, " ".join(t for j, t in rows if j == i)) for i in range(30)]
    for length, k in ((12, 4), (16, 3), (10, 1)):
        gone = {}
        for r in suffix_dedup.repeated_passages(make(rows), length=length, k=k).collect():
            gone.setdefault(r.id, set()).update(range(r.start, r.stop))
        want = plain.repeated(rows, length)
        assert [gone.get(i, set()) for i, _ in rows] == want and any(want)


@pytest.mark.parametrize("seed", range(8))
def test_the_nearest_earlier_string_shares_most(seed):
    rng = random.Random(seed)
    words = sorted("".join(rng.choice("ab") for _ in range(6)) for _ in range(25))
    places = [rng.randrange(12) for _ in words]
    near = [suffix_dedup.common(list(a), list(b)) for a, b in zip(words, words[1:], strict=False)]
    want = [max([suffix_dedup.common(list(words[i]), list(words[j])) for j in range(25) if places[j] < places[i]], default=-1) for i in range(25)]
    assert suffix_dedup.nearest_earlier(places, near) == want


def test_suffix_rows(make, odd):
    out = suffix_dedup.suffix_dedup(make(odd)).collect()
    gone = plain.repeated(odd, 50)
    want = Counter((i, len(plain.words(t)), len(g)) for (i, t), g in zip(odd, gone, strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_repeated) for r in out) == want
    assert all(a.stop < b.start for r in out for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert any(want[x] and x[2] >= 50 for x in want)


def test_shards_are_even_and_keep_copies_together(make, odd):
    rows = odd + [(1000 + i, f"copy {i // 4}") for i in range(120)] + [(5000 + i, "hot") for i in range(90)] + [(9000 + i, f"single {i}") for i in range(70)]
    out = sharding.balanced_shards(make(rows)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    where = {}
    for r in out:
        if r.doc_id is not None and 1000 <= r.doc_id < 1120:
            where.setdefault((r.doc_id - 1000) // 4, set()).add(r.shard)
    assert sum(len(x) > 1 for x in where.values()) <= 4  # only what balance splits
    hot = {r.shard for r in out if r.doc_id is not None and 5000 <= r.doc_id < 5090}
    assert len(hot) <= 5  # ninety of some three hundred rows need three shards


def test_all_linked_documents_still_balance(make):
    rows = [(i, f"pair {i // 2}") for i in range(50)]
    sizes = Counter(r.shard for r in sharding.balanced_shards(make(rows)).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8


def test_quotas_never_overflow():
    wish = {(0, 1): [5, 5, 5], (1, 2): [1, 0, 0], (2, 1): [4, 4, 4]}
    size = [15, 10, 12]
    upto = sharding._accepted(wish, size, 14)
    moved = {k: sum(v[: upto[k]]) for k, v in wish.items()}
    after = [size[s] + sum(m for (_, b), m in moved.items() if b == s) - sum(m for (a, _), m in moved.items() if a == s) for s in range(3)]
    assert all(n <= max(14, size[s]) for s, n in enumerate(after))
    assert sum(moved.values()) > 0


@pytest.mark.parametrize("run", [simhash.simhash_components, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, sharding.balanced_shards])
def test_empty_tables(make, spark, run):
    assert run(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_carried_columns_whose_names_clash(make):
    out = substring_dedup.substring_dedup(make([(1, "a b")]).withColumnRenamed("v", "n_words"), carry=["n_words", "key"])
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_text", "key"]
    assert out.first().n_words == 2


def test_whole_texts_stay_as_they_are(make):
    rows = [(1, " a  b\t"), (2, None), (3, "x " * 60)]
    out = {r.doc_id: r.kept_text for r in substring_dedup.substring_dedup(make(rows), keep="whole").collect()}
    assert out == {1: " a  b\t", 2: None, 3: " ".join(["x"] * 1)}
