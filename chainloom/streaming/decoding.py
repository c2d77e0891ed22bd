"""Blocks with their logs into decoded tables, batch by batch, with the contracts found so far as state.

The state is the store's ``contracts`` table: a reorg that orphans a creating block deletes its row there, and a batch
is admitted only when its commit has succeeded. So nothing else has to be kept or undone.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.operators.chain import rewound
from chainloom.operators.decode import contract_rows, created, decode_event, eligible
from chainloom.operators.derive import derivations
from chainloom.operators.relate import newest_common_block, with_sender
from chainloom.operators.store import Store
from chainloom.schema import contract_key, handoff_key, log_key, marker_key, of_values
from chainloom.sources.manifest import Catalog

LOGS = "array<struct<log_index:bigint,transaction_hash:string,transaction_index:bigint,address:string,topics:array<string>,data:string>>"
TRANSACTIONS = "array<struct<hash:string,from_address:string,to_address:string,input:string>>"
#: Contracts that are handed over with one batch; the rest wait for the next ones.
ADOPTED = 10_000


def block_transactions(blocks: DataFrame) -> DataFrame:
    """What derivations read of the transactions of blocks whose JSON has a list ``transactions``."""
    return blocks.select(F.col("hash").alias("block_hash"), F.inline(F.from_json(F.get_json_object("json", "$.transactions"), TRANSACTIONS)))


def block_logs(blocks: DataFrame, chain: str) -> DataFrame:
    """``logs`` rows of blocks whose JSON has a list ``logs``."""
    each = blocks.select(
        F.col("height").cast("decimal(20,0)").alias("block_number"), F.col("hash").alias("block_hash"), F.timestamp_seconds("timestamp").alias("block_timestamp"),
        F.explode(F.from_json(F.get_json_object("json", "$.logs"), LOGS)).alias("l"),
    )
    topic = [F.get(F.col("l.topics"), F.lit(i)).alias(f"topic{i}") for i in range(4)]
    rows = each.select(
        F.col("l.log_index").cast("decimal(20,0)").alias("log_index"), "l.transaction_hash", F.col("l.transaction_index").cast("decimal(20,0)").alias("transaction_index"), F.lower("l.address").alias("address"),
        *topic, "l.data", F.lit(False).alias("removed"), "block_number", "block_hash", "block_timestamp",
    )
    return rows.withColumn("chain", F.lit(chain)).withColumn("dedupe_key", log_key(F.col("block_hash"), F.col("transaction_hash"), F.col("log_index")))


class Decoding:
    """A ``transform`` for ``streaming.runner.Pipeline``."""

    def __init__(self, store: Store, catalog: Catalog, chain: str):
        self.store, self.catalog, self.chain = store, catalog, chain
        self.session_written = False
        self.gone: list[str] = []
        self.waiting: DataFrame | None = None

    def hand_over(self, contracts: DataFrame) -> None:
        """``contracts`` rows that a backfill found, to be decoded from the next batch on.

        They may be handed over again after a restart: what the ``handoffs`` table holds is not adopted twice, and what a
        reorg took off it is adopted again with the block that comes next.
        """
        self.waiting = contracts if self.waiting is None else self.waiting.unionByName(contracts)

    def adopted(self, blocks: DataFrame) -> dict[str, DataFrame]:
        """``handoffs`` rows of the batch's first block, and ``contracts`` rows of those that are new."""
        if self.waiting is None:
            return {}
        held = of_values(self.store.read("handoffs"), "block_hash", self.gone, "left_anti").select("address")
        entries = self.catalog.events(self.store.spark).select(F.split("entry", "/")[0].alias("protocol"), F.split("entry", "/")[1].alias("name")).distinct()
        fresh = self.waiting.dropDuplicates(["address"]).join(held, "address", "left_anti").join(F.broadcast(entries), ["protocol", "name"], "left_semi")
        joining = fresh.orderBy("address").limit(ADOPTED)
        first = blocks.agg(F.min(F.struct("height", "hash", "timestamp")).alias("b")).first()["b"]
        place = {"block_number": F.lit(first["height"]), "block_hash": F.lit(first["hash"]), "block_timestamp": F.timestamp_seconds(F.lit(first["timestamp"])), "chain": F.lit(self.chain)}
        rows = joining.select("protocol", "name", "address").withColumns(place)
        known = of_values(self.store.read("contracts"), "block_hash", self.gone, "left_anti").select("address")
        key = contract_key(log_key(F.col("block_hash"), F.col("transaction_hash"), F.col("log_index")), F.col("address"))
        return {
            "handoffs": rows.withColumn("dedupe_key", handoff_key(F.col("block_hash"), F.col("address"))),
            "contracts": joining.join(known, "address", "left_anti").withColumns({"chain": F.lit(self.chain), "dedupe_key": key}),
        }

    def retract(self, hashes: list[str]) -> None:
        """Blocks that the coming batch orphans: what they created is not known to it."""
        self.gone = hashes

    def known(self, adopted: DataFrame | None = None) -> DataFrame:
        """Seeds, the contracts of earlier commits and those adopted now; these decode every later log."""
        spark = self.store.spark
        held = of_values(self.store.read("contracts"), "block_hash", self.gone, "left_anti").select("protocol", "name", "address")
        if adopted is not None:
            held = held.unionByName(adopted.select("protocol", "name", "address"))
        found = held.select("address", F.concat_ws("/", "protocol", "name").alias("entry"), F.lit(True).alias("seed"), F.lit(None).cast("decimal(20,0)").alias("block_number"), F.lit(None).cast("decimal(20,0)").alias("log_index"))
        return self.catalog.seeds(spark).unionByName(found).dropDuplicates(["address"])

    def __call__(self, blocks: DataFrame) -> dict[str, DataFrame]:
        logs = block_logs(blocks, self.chain)
        handed = self.adopted(blocks)
        base, found = self.known(handed.get("handoffs")), None
        known = base
        while True:  # each round finds a contract at least, and a batch holds finitely many
            new = created(logs, self.catalog, known)
            if new.limit(1).count() == 0:
                break
            found = new
            first = new.groupBy("address", "entry").agg(F.min(F.struct("block_number", "log_index")).alias("at")).select("address", "entry", F.lit(False).alias("seed"), "at.block_number", "at.log_index")
            grown = base.unionByName(first.join(base.select("address"), "address", "left_anti"))
            if grown.count() == known.count():
                break
            known = grown
        out = {"logs": logs}
        if found is not None:
            rows = contract_rows(found).join(logs.select("block_hash", "log_index", "transaction_hash", "transaction_index", "block_timestamp"), ["block_hash", "log_index"])
            key = contract_key(log_key(F.col("block_hash"), F.col("transaction_hash"), F.col("log_index")), F.col("address"))
            part = F.split("entry", "/")
            out["contracts"] = rows.withColumns({"protocol": part[0], "name": part[1], "chain": F.lit(self.chain), "dedupe_key": key})
        if handed:
            out["handoffs"] = handed["handoffs"]
            out["contracts"] = out["contracts"].unionByName(handed["contracts"], allowMissingColumns=True) if found is not None else handed["contracts"]
        matched = eligible(logs, known, self.catalog.events(self.store.spark))
        for c in self.catalog.contracts:
            for e in c.events.values():
                mine = matched.where((F.col("entry") == c.entry) & (F.col("signature") == e.signature))
                key = F.concat(log_key(F.col("block_hash"), F.col("transaction_hash"), F.col("log_index")), F.lit(f":{e.topic0}:{e.signature}:decoded"))
                out[c.tables[e.signature].name] = decode_event(mine, e).withColumn("dedupe_key", key)
        if derive := derivations(self.catalog):
            sent = with_sender(matched, block_transactions(blocks))
            out |= {table: run(sent) for table, run in derive.items()}
        if not self.session_written:
            out["sessions"] = self.session(blocks)
            self.session_written = True
        return out

    def session(self, blocks: DataFrame) -> DataFrame:
        """The row that says what this run decodes, at its first block."""
        events = json.dumps([{"contract": c.entry, "event_id": e.signature} for c in self.catalog.contracts for e in c.events.values()])
        first = blocks.agg(F.min(F.struct("height", "hash", "timestamp")).alias("b"))
        rows = first.select(F.col("b.height").alias("block_number"), F.col("b.hash").alias("block_hash"), F.timestamp_seconds("b.timestamp").alias("block_timestamp"), F.lit(events).alias("events"), F.lit(self.chain).alias("chain"))
        return rows.withColumn("dedupe_key", marker_key(F.col("block_hash"), "session"))


def settle(stores: list[Store]) -> int | None:
    """Rewinds stores to the newest block that all of their ledgers hold, and gives its height.

    A store whose ledger is empty has no say; without a common block nothing is touched.
    """
    ledgers = [s.read("accepted_blocks").select("height", "hash") for s in stores]
    common = newest_common_block(ledgers).first()
    if common is None:
        return None
    height = int(common["height"])
    for s in stores:
        # the ledger goes first: rows above it do not count, whatever happens next
        for t in sorted(s.tables.values(), key=lambda t: t.name != "accepted_blocks"):
            if t.block_number and rewound(s.read(t.name), 1 << 62, t.block_number).where(F.col(t.block_number) > height).limit(1).count():
                s.delete_above(t.name, height)
    return height
