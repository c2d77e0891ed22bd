import pytest

from chainloom.operators.store import Store
from chainloom.plans.backfill import NotCovered, check_session
from chainloom.sources import blocks as source
from chainloom.sources import manifest
from chainloom.streaming.decoding import Decoding, settle
from chainloom.streaming.runner import Pipeline
from tests.test_store import CATALOG, arriving, batch, make

POOL = "0x" + "22" * 20
FACTORY = "0x" + "fa" * 20


def block(height, name, parent, logs):
    return {"height": height, "hash": name, "parent_hash": parent, "timestamp": height, "logs": logs}


def test_creations_and_reorgs_as_blocks_come(spark, tmp_path):
    catalog = manifest.build(manifest.parse(CATALOG, "base"))
    created, swap = catalog["dex/Factory"].named("PoolCreated")[0], catalog["dex/Pool"].named("Swap")[0]

    def log(i, address, topics, data):
        return {"log_index": i, "transaction_hash": f"0xt{i}", "transaction_index": 0, "address": address, "topics": topics, "data": data}

    def swaps(i, n):
        return log(i, POOL, [swap.topic0], "0x" + f"{n % 2**256:064x}")

    make_pool = [created.topic0, "0x" + "0" * 24 + "11" * 20]
    store = Store(spark, str(tmp_path), catalog.tables(), width=5_000)

    def run(*found):
        pipeline = Pipeline(store, "c", Decoding(store, catalog, "c"), window=8)
        pipeline.apply(arriving(spark, list(found)))

    amounts = lambda: sorted(r.amount for r in store.read("dex_pool_swap").collect())
    run(block(1, "a1", "a0", [swaps(0, 1), log(1, FACTORY, make_pool, "0x" + "0" * 24 + POOL[2:]), swaps(2, 2)]))
    assert amounts() == ["2"]  # not the one before the creation
    run(block(2, "a2", "a1", [swaps(0, -3)]))
    assert amounts() == ["-3", "2"]
    assert store.read("contracts").count() == 1 and store.read("sessions").count() == 2
    check_session(store, catalog)
    other = manifest.build(manifest.parse(CATALOG.replace("Swap(int256 amount)", "Swap(int256 amount)\", \"Burn(uint8 n)"), "base"))
    with pytest.raises(NotCovered, match="EventsDiffer"):
        check_session(store, other)
    run(block(1, "b1", "a0", []), block(2, "b2", "b1", [swaps(0, 9)]))
    assert amounts() == [] and store.read("contracts").count() == 0
    assert [r.hash for r in store.read("accepted_blocks").orderBy("height").collect()] == ["b1", "b2"]
    assert source.SCHEMA.startswith("height")


def test_stores_settle_on_a_common_block(spark, tmp_path):
    a, b = make(spark, tmp_path / "a"), make(spark, tmp_path / "b")
    chain = [(1, "a1", "a0"), (2, "a2", "a1"), (3, "a3", "a2")]
    a.commit(batch(spark, chain))
    b.commit(batch(spark, chain[:2]))
    assert settle([a, b]) == 2
    assert a.read("facts").count() == b.read("facts").count() == 4
    assert settle([make(spark, tmp_path / "c")]) is None
