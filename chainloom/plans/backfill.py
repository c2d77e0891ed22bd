"""Replaying stored logs for contracts that were added later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.operators.decode import decode_event, discover, eligible, first_claims, created
from chainloom.operators.derive import derivations
from chainloom.operators.relate import coverage, with_sender
from chainloom.operators.store import Store
from chainloom.schema import handoff_key, log_key
from chainloom.sources.manifest import Catalog

#: A replay ends this many ledgers below the tip, where nothing can be retracted.
LEDGERS = 4


class NotCovered(ValueError):
    pass


def bound(store: Store, ledger: int) -> int | None:
    tip = store.read("accepted_blocks").agg(F.max("height")).first()[0]
    return None if tip is None else int(tip) - LEDGERS * ledger


def check_session(store: Store, catalog: Catalog) -> None:
    """The newest session must decode exactly what the catalog wants; a difference either way is an error."""
    newest = store.read("sessions").orderBy(F.desc("block_number")).limit(1)
    session = newest.select(F.explode(F.from_json("events", "array<struct<contract:string,event_id:string>>")).alias("e")).select("e.*")
    wanted = catalog.events(store.spark).select(F.col("entry").alias("contract"), F.col("signature").alias("event_id"))
    if (found := coverage(wanted, session).limit(1).collect()):
        raise NotCovered(f"{found[0]['problem']}: {found[0]['contract']} {found[0]['event_id']}")


def discover_all(store: Store, catalog: Catalog, below: DataFrame | None, high: int, cut=lambda df: df) -> DataFrame:
    """Contracts that stored logs, and logs from below the store, create; to a fixpoint."""
    logs = store.read("logs", high=high).drop("block_range")
    if below is not None:
        logs = logs.unionByName(below, allowMissingColumns=True)
    return discover(logs, catalog, cut)


def replay(store: Store, catalog: Catalog, low: int, high: int, contracts: DataFrame) -> None:
    """Decodes the stored logs of a height range again and appends the rows that the tables lack, derived ones included.

    All found contracts count from the start of the range, as a running pipeline restores them. Running it again
    appends nothing.
    """
    spark = store.spark
    logs = store.read("logs", low, high)
    admitted = contracts.withColumn("seed", F.lit(True))
    matched = eligible(logs, admitted, catalog.events(spark)).persist()
    try:
        for c in catalog.contracts:
            for e in c.events.values():
                t = c.tables[e.signature]
                mine = matched.where((F.col("entry") == c.entry) & (F.col("signature") == e.signature))
                rows = decode_event(mine, e).withColumn("dedupe_key", F.concat(log_key(F.col("block_hash"), F.col("transaction_hash"), F.col("log_index")), F.lit(f":{e.topic0}:{e.signature}:decoded")))
                store.fill(t.name, rows)
        for table, run in derivations(catalog).items():
            store.fill(table, run(with_sender(matched, store.read("transactions", low, high))))
    finally:
        matched.unpersist()


def handoffs(contracts: DataFrame, queue: DataFrame, block_hash: str) -> DataFrame:
    """Contracts that a running pipeline must take over and that its queue lacks."""
    new = contracts.withColumn("dedupe_key", handoff_key(F.lit(block_hash), F.col("address")))
    return new.join(queue.select("dedupe_key"), "dedupe_key", "left_anti")


__all__ = ["bound", "check_session", "created", "discover_all", "first_claims", "handoffs", "replay"]
