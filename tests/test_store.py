import json
import random

import pytest
from pyspark.sql import functions as F

from chainloom.operators.store import Locked, Replayed, Store, create_table_sql, index_sql, upsert_sql
from chainloom.plans import backfill
from chainloom.schema import DATASETS, TableDef, check_drift, event_table
from chainloom.functions.abi import parse_signature
from chainloom.sources import blocks as source
from chainloom.sources import manifest
from chainloom.streaming.runner import Pipeline, Ring, plan_batch
from chainloom.operators.chain import Deep

ROWS = TableDef("facts", (("value", "text", False), ("block_number", "uint", False), ("block_hash", "text", False)))
ROW_SCHEMA = "value string, block_number bigint, block_hash string, chain string, dedupe_key string"


def facts(spark, blocks):
    rows = [(f"{h}.{i}", n, h, "c", f"{h}:{i}") for n, h, _ in blocks for i in range(2)]
    return spark.createDataFrame(rows, ROW_SCHEMA)


def ledger(spark, blocks):
    df = spark.createDataFrame(blocks, "height bigint, hash string, parent_hash string")
    return df.withColumn("timestamp", F.timestamp_seconds("height")).withColumn("chain", F.lit("c")).withColumn("dedupe_key", F.concat("hash", F.lit(":accepted_block")))


def reorg(spark, height, head, orphans):
    return spark.createDataFrame([(height, head, json.dumps(orphans), "c", f"{head}:reorg")], "height bigint, new_head_hash string, orphaned_hashes string, chain string, dedupe_key string")


def batch(spark, blocks, orphaned=None):
    out = {"facts": facts(spark, blocks), "accepted_blocks": ledger(spark, blocks)}
    if orphaned:
        out["reorgs"] = reorg(spark, *orphaned)
    return out


FIRST = [(1, "a1", "a0"), (2, "a2", "a1"), (3, "a3", "a2")]
FORK = [(2, "b2", "a1")]
ORPHANED = (2, "b2", ["a3", "a2"])


def held(store, table="facts", column="value"):
    return sorted(r[0] for r in store.read(table).select(column).collect())


def make(spark, path):
    return Store(spark, str(path), {"facts": ROWS}, width=5_000)


def test_a_fork_replaces_blocks(spark, tmp_path):
    store = make(spark, tmp_path)
    store.commit(batch(spark, FIRST))
    store.commit(batch(spark, FORK, ORPHANED))
    assert held(store) == ["a1.0", "a1.1", "b2.0", "b2.1"]
    assert held(store, "accepted_blocks", "hash") == ["a1", "b2"]
    assert store.read("reorgs").count() == 1


@pytest.mark.parametrize("step", ["record", "ledger", "delete", "rows"])
def test_a_crash_behind_any_step_is_repaired(spark, tmp_path, step):
    store = make(spark, tmp_path)
    store.commit(batch(spark, FIRST))
    store.commit(batch(spark, FORK, ORPHANED), stop_after=step)
    again = make(spark, tmp_path)
    again.repair()
    assert held(again) == ["a1.0", "a1.1"]
    assert held(again, "accepted_blocks", "hash") == ["a1"]
    again.commit(batch(spark, FORK))
    assert held(again) == ["a1.0", "a1.1", "b2.0", "b2.1"]


def test_replays_are_refused_and_upserts_are_not(spark, tmp_path):
    store = make(spark, tmp_path)
    store.commit(batch(spark, FIRST))
    with pytest.raises(Replayed):
        store.commit(batch(spark, FIRST[2:]))
    store.upsert("facts", facts(spark, FIRST[2:]).withColumn("value", F.lit("new")))
    assert held(store) == ["a1.0", "a1.1", "a2.0", "a2.1", "new", "new"]
    store.fill("facts", facts(spark, FIRST))
    assert store.read("facts").count() == 6


def test_rewind_prune_compact_and_vacuum(spark, tmp_path):
    store = make(spark, tmp_path)
    for i in range(3):
        store.commit(batch(spark, [(10 * i + 1, f"h{i}", f"h{i - 1}")]))
    assert store.listing("facts")[0][1] >= 3
    assert store.compact("facts", tip=20_000) == [0]
    assert store.listing("facts")[0][1] == 1
    assert store.vacuum("facts", hours=1) == 0
    assert store.vacuum("facts", hours=-1) == 3
    assert store.read("facts").count() == 6
    store.delete_above("facts", 11)
    assert held(store) == ["h0.0", "h0.1", "h1.0", "h1.1"]
    store.prune_ledger(10)
    assert held(store, "accepted_blocks", "hash") == ["h2"]


def test_partitions_are_pruned(spark, tmp_path):
    store = make(spark, tmp_path)
    store.commit(batch(spark, [(1, "x", "w"), (7_000, "y", "x")]))
    assert [k for k, *_ in store.listing("facts")] == [0, 1]
    assert all("/part=1/" in f for f in store.read("facts", 6_000).inputFiles())
    assert store.drift("facts") == []
    assert check_drift(store.read("facts").drop("value"), ROWS) == ["facts.value is missing"]


def test_one_writer(spark, tmp_path):
    store = make(spark, tmp_path)
    store.lock("a")
    store.lock("a")
    with pytest.raises(Locked):
        store.lock("b")
    store.lock("b", stale=-1)
    store.unlock()
    store.lock("c")


def test_sql_of_a_table():
    t = event_table("dex", "Pool", parse_signature("Swap(address indexed sender, int256 amount0)"), None, (("chain", "sender"),))
    assert create_table_sql(t).endswith("PRIMARY KEY (chain, dedupe_key))")
    assert "ON CONFLICT (chain, dedupe_key) DO UPDATE SET address = excluded.address" in upsert_sql(t, "s")
    assert len(index_sql(t)) == 2
    assert len(DATASETS) == 9 and sum(t.bookkeeping for t in DATASETS.values()) == 5


# The running pipeline


def test_a_ring_knows_its_limits():
    ring = Ring(window=3)
    for h, x, p in [(1, "a", "z"), (2, "b", "a"), (3, "c", "b"), (4, "d", "c")]:
        assert ring.accept(h, x, p) == []
    assert ring.accept(4, "d", "c") is None
    assert ring.accept(3, "c2", "b") == [(4, "d"), (3, "c")]
    with pytest.raises(Deep):
        ring.accept(2, "b2", "a")
    with pytest.raises(ValueError, match="follow"):
        ring.accept(9, "x", "y")


def test_blocks_that_a_batch_orphans_itself_are_not_named():
    ring = Ring([(1, "a1")])
    new, reorgs = plan_batch(ring, [(2, "a2", "a1"), (2, "b2", "a1"), (3, "b3", "b2")])
    assert (new, reorgs) == ([(2, "b2"), (3, "b3")], [])


def test_orphans_that_are_adopted_again_stay(spark, tmp_path):
    store = make(spark, tmp_path)
    store.commit(batch(spark, FIRST))
    store.commit(batch(spark, FORK, ORPHANED))
    store.commit(batch(spark, FIRST[1:], (2, "a3", ["b2"])))
    again = make(spark, tmp_path)
    again.repair()
    assert held(again, "accepted_blocks", "hash") == ["a1", "a2", "a3"]
    assert len(held(again)) == 6


def transform(blocks):
    rows = blocks.select(F.explode(F.from_json(F.get_json_object("json", "$.logs"), "array<string>")).alias("value"), F.col("height").alias("block_number"), F.col("hash").alias("block_hash"))
    return {"facts": rows.withColumn("chain", F.lit("c")).withColumn("dedupe_key", F.concat_ws(":", "block_hash", "value"))}


def arriving(spark, feed):
    """Blocks in one partition, in order of arrival."""
    return spark.sparkContext.parallelize([source.row(b) for b in feed], 1).toDF(source.SCHEMA)


def canonical(tree, head):
    out = []
    while head in tree:
        out.append(tree[head])
        head = tree[head]["parent_hash"]
    return out[::-1]


@pytest.mark.parametrize("seed", range(2))
def test_a_store_follows_a_forking_chain(spark, tmp_path, seed):
    """Simulation: random forks and crashes; after each life the store equals its canonical chain."""
    rng = random.Random(seed)
    tree, head, n = {}, "g", 0
    store = make(spark, tmp_path / "store")
    for life in range(4):
        feed = []
        for _ in range(rng.randrange(2, 5)):
            chain = canonical(tree, head)
            parent = head
            if len(chain) > 3 and rng.random() < 0.5:
                back = rng.randrange(1, 3)
                parent = chain[-1 - back]["hash"]
                height = chain[-1 - back]["height"] + 1
                extra = back + 1
            else:
                height, extra = (chain[-1]["height"] + 1 if chain else 1), 1
            for _ in range(extra):
                n += 1
                tree[f"x{n}"] = {"height": height, "hash": f"x{n}", "parent_hash": parent, "timestamp": height, "logs": [f"l{n}.{i}" for i in range(rng.randrange(3))]}
                feed.append(tree[f"x{n}"])
                parent, height = f"x{n}", height + 1
            head = parent
        pipeline = Pipeline(make(spark, tmp_path / "store"), "c", transform, window=8)
        rows = arriving(spark, feed)
        if rng.random() < 0.5:  # a life that ends inside a commit
            step = rng.choice(["record", "ledger", "delete", "rows"])
            commit = pipeline.store.commit
            pipeline.store.commit = lambda out, commit=commit, step=step: commit(out, stop_after=step)
            pipeline.apply(rows)
            pipeline = Pipeline(make(spark, tmp_path / "store"), "c", transform, window=8)
            known = {h for _, h in pipeline.ring.blocks}
            low = pipeline.ring.blocks[0][0] if pipeline.ring.history else 0
            todo = [b for b in canonical(tree, head) if b["hash"] not in known and b["height"] > low]
            rows = arriving(spark, todo)
        pipeline.apply(rows)
        pipeline.apply(rows)  # a batch that comes again changes nothing
        chain = canonical(tree, head)
        assert held(store, "accepted_blocks", "hash") == sorted(b["hash"] for b in chain), life
        assert held(store) == sorted(x for b in chain for x in b["logs"])


def test_a_stream_of_blocks(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    rows = [{"height": h, "hash": f"a{h}", "parent_hash": f"a{h - 1}", "timestamp": h, "logs": [f"l{h}"]} for h in range(1, 6)]
    (feed / "0.ndjson").write_text("\n".join(map(json.dumps, rows)) + "\n")
    source.register(spark)
    store = make(spark, tmp_path / "store")
    pipeline = Pipeline(store, "c", transform)
    stream = spark.readStream.format("chain_blocks").option("path", str(feed)).option("from", "1").load()
    query = pipeline.start(stream, str(tmp_path / "checkpoint"))
    assert query.awaitTermination(120)
    assert held(store) == [f"l{h}" for h in range(1, 6)]


# Replaying stored logs

CATALOG = """
protocol = "dex"
[[contract]]
name = "Factory"
events = ["PoolCreated(address indexed token, address pool)"]
addresses = { base = ["0xfafafafafafafafafafafafafafafafafafafafa"] }
[[contract]]
name = "Pool"
events = ["Swap(int256 amount)"]
created_by = [{ contract = "Factory", event = "PoolCreated", param = "pool" }]
"""


def test_a_replay_fills_what_is_missing(spark, tmp_path):
    catalog = manifest.build(manifest.parse(CATALOG, "base"))
    created, swap = catalog["dex/Factory"].named("PoolCreated")[0], catalog["dex/Pool"].named("Swap")[0]
    pool = "0x" + "22" * 20
    word = lambda n: f"{n % 2**256:064x}"
    pad = "0" * 24 + pool[2:]
    rows = [
        (1, pool, swap.topic0, None, "0x" + word(1)),  # before its creation
        (2, "0x" + "fa" * 20, created.topic0, "0x" + "0" * 24 + "11" * 20, "0x" + pad),
        (3, pool, swap.topic0, None, "0x" + word(-7)),
        (4, pool, swap.topic0, None, "0x12"),  # unreadable
        (5, "0x" + "33" * 20, swap.topic0, None, "0x" + word(9)),  # another contract
    ]
    df = spark.createDataFrame(rows, "log_index int, address string, topic0 string, topic1 string, data string")
    df = df.withColumns({"topic2": F.lit(None).cast("string"), "topic3": F.lit(None).cast("string"), "block_number": F.lit(5).cast("bigint"), "block_hash": F.lit("0xb"), "transaction_hash": F.lit("0xt"), "transaction_index": F.lit(0), "removed": F.lit(False), "block_timestamp": F.timestamp_seconds(F.lit(5)), "chain": F.lit("c"), "dedupe_key": F.concat(F.lit("0xb:0xt:"), "log_index")})
    store = Store(spark, str(tmp_path), catalog.tables(), width=5_000)
    store.append("logs", df)
    contracts = backfill.discover_all(store, catalog, None, 10)
    assert sorted((r.address, r.seed) for r in contracts.collect()) == [(pool, False), ("0x" + "fa" * 20, True)]
    for _ in range(2):
        backfill.replay(store, catalog, 0, 10, contracts)
        assert store.read("dex_factory_pool_created").count() == 1
        # a replay admits all found contracts from the start of its range
        assert sorted((int(r.log_index), r.amount) for r in store.read("dex_pool_swap").collect()) == [(1, "1"), (3, "-7")]
