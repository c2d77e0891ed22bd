import json
import time

import pytest
from pyspark.sql import functions as F

from chainloom.operators.chain import Deep
from chainloom.plans.fetch import Limits
from chainloom.sources import blocks as source
from chainloom.sources import manifest
from chainloom.streaming.decoding import Decoding
from chainloom.streaming.follow import Follower, Head, Unstable
from chainloom.streaming.runner import Pipeline
from chainloom.operators.store import Store
from tests.test_store import CATALOG, arriving, held, make, transform


def feed(path, *branches):
    """The source's chain: (salt, low, high) one after the other, each block the child of the one before."""
    rows, parent = [], "root"
    for salt, low, high in branches:
        for h in range(low, high + 1):
            rows.append({"height": h, "hash": f"{salt}{h}", "parent_hash": parent, "timestamp": h, "logs": [f"{salt}{h}"]})
            parent = f"{salt}{h}"
    path.mkdir(exist_ok=True)
    (path / "0.ndjson").write_text("\n".join(map(json.dumps, rows)) + "\n")


def follower(spark, tmp_path, window=8, **limits):
    source.register(spark)
    return Follower(spark, Pipeline(make(spark, tmp_path / "store"), "c", transform, window), {"path": str(tmp_path / "feed")}, 1, Limits(**limits))


def ledger(f):
    return sorted(r.hash for r in f.pipeline.store.read("accepted_blocks").collect())


def test_backfill_then_heads_forks_and_heads_that_are_behind(spark, tmp_path):
    feed(tmp_path / "feed", ("a", 1, 9))
    f = follower(spark, tmp_path, blocks=3)
    assert f.backfill(finality=4) == 6 and f.pipeline.ring.tip == 5
    f.process(Head(7, "a7"))  # ahead: what lies between is fetched
    f.process(Head(7, "a7"))  # known
    f.process(Head(6, "a6"))
    assert f.pipeline.ring.tip == 7
    feed(tmp_path / "feed", ("a", 1, 5), ("b", 6, 9))
    f.process(Head(9, "b9"))  # ahead on another branch
    assert ledger(f) == sorted([*(f"a{h}" for h in range(1, 6)), *(f"b{h}" for h in range(6, 10))]) == held(f.pipeline.store)
    feed(tmp_path / "feed", ("a", 1, 5), ("b", 6, 7), ("c", 8, 8))
    f.process(Head(8, "c8"))  # at or below the tip
    assert ledger(f)[-3:] == ["b6", "b7", "c8"] and f.pipeline.ring.tip == 8
    with pytest.raises(Unstable):
        f.process(Head(8, "gone"))
    f.process(Head(1, "a1"))  # an old ancestor, in the window or below it
    assert f.pipeline.ring.tip == 8


def test_a_head_below_the_window(spark, tmp_path):
    feed(tmp_path / "feed", ("a", 1, 9))
    f = follower(spark, tmp_path, window=4)
    f.backfill(finality=0)
    f.process(Head(4, "a4"))  # the source is behind, nothing forked
    assert f.pipeline.ring.tip == 9
    feed(tmp_path / "feed", ("z", 1, 9))
    with pytest.raises(Deep):
        f.process(Head(4, "z4"))
    with pytest.raises(Deep):
        f.process(Head(9, "z9"))


def test_commits_are_cut_where_they_are_full(spark, tmp_path):
    feed(tmp_path / "feed", ("a", 1, 9))
    f = follower(spark, tmp_path, records=2)
    assert [(a, b) for a, b, _ in f.pieces(1, 9)] == [(1, 2), (3, 4), (5, 6), (7, 8), (9, 9)]
    f = follower(spark, tmp_path, blocks=4)
    assert [(a, b) for a, b, _ in f.pieces(1, 9)] == [(1, 4), (5, 8), (9, 9)]


def test_the_loop_asks_again_and_stops_after_its_commit(spark, tmp_path):
    feed(tmp_path / "feed", ("a", 1, 3))
    f = follower(spark, tmp_path)
    f.backfill(finality=0)
    f.begin()
    f.announce(Head(5, "a5"))  # announced before the source serves it
    time.sleep(0.5)
    feed(tmp_path / "feed", ("a", 1, 5))
    end = time.monotonic() + 60
    while f.pipeline.ring.tip != 5 and time.monotonic() < end:
        time.sleep(0.1)
    f.stop()
    assert ledger(f) == [f"a{h}" for h in range(1, 6)] and not f.thread.is_alive()


def test_contracts_are_handed_over(spark, tmp_path):
    catalog = manifest.build(manifest.parse(CATALOG, "base"))
    swap = catalog["dex/Pool"].named("Swap")[0]
    pool, other = "0x" + "22" * 20, "0x" + "44" * 20
    store = Store(spark, str(tmp_path), catalog.tables(), width=5_000)

    def block(height, name, parent, n):
        logs = [{"log_index": 0, "transaction_hash": "0xt", "transaction_index": 0, "address": pool, "topics": [swap.topic0], "data": f"0x{n:064x}"}]
        return {"height": height, "hash": name, "parent_hash": parent, "timestamp": height, "logs": logs}

    decoding = Decoding(store, catalog, "c")
    pipeline = Pipeline(store, "c", decoding, window=8)
    pipeline.apply(arriving(spark, [block(5, "a5", "a4", 1)]))
    rows = [("dex", "Pool", pool), ("dex", "Unknown", other)]
    place = {"factory_address": F.lit("0xf"), "transaction_hash": F.lit("0xc"), "transaction_index": F.lit(0), "log_index": F.lit(0), "block_number": F.lit(2).cast("bigint"), "block_hash": F.lit("a2"), "block_timestamp": F.timestamp_seconds(F.lit(2))}
    decoding.hand_over(spark.createDataFrame(rows, "protocol string, name string, address string").withColumns(place))
    amounts = lambda: sorted(r.amount for r in store.read("dex_pool_swap").collect())
    marks = lambda: [(r.address, r.block_hash) for r in store.read("handoffs").collect()]
    pipeline.apply(arriving(spark, [block(6, "a6", "a5", 2)]))
    assert amounts() == ["2"] and marks() == [(pool, "a6")] and store.read("contracts").count() == 1
    pipeline.apply(arriving(spark, [block(7, "a7", "a6", 3)]))
    assert amounts() == ["2", "3"] and marks() == [(pool, "a6")]
    pipeline.apply(arriving(spark, [block(6, "b6", "a5", 9)]))  # the record went with its block, so it joins again
    assert amounts() == ["9"] and marks() == [(pool, "b6")] and store.read("contracts").count() == 1
