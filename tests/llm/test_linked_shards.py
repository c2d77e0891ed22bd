"""Sharding of tables whose documents are all, or nearly all, linked."""

from collections import Counter

import pytest

from chainloom.llm import sharding

PAIRS = [f"pair {i // 2}" for i in range(1600)]
TABLES = {
    "pairs": PAIRS,
    "pairs and few singles": PAIRS[:1584] + [f"single {i}" for i in range(16)],
    "a hot third": ["hot"] * 533 + PAIRS[:1050] + [f"single {i}" for i in range(17)],
    "hundreds": [f"hundred {i // 100}" for i in range(1400)] + [f"single {i}" for i in range(200)],
}


@pytest.mark.parametrize("name", TABLES)
def test_few_groups_are_split(spark, name):
    rows = list(enumerate(TABLES[name]))
    out = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(rows)))
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    where: dict[str, set] = {}
    for r in out:
        where.setdefault(TABLES[name][r.doc_id], set()).add(r.shard)
    assert sum(len(x) > 1 for x in where.values()) <= 7  # one at each cut at most
