"""The running pipeline on Structured Streaming: blocks in, a store kept equal to the canonical chain.

Each micro-batch brings blocks in the order of their heights. The driver holds the ledger's newest blocks (a bounded
window) and works out what the batch does to them: follow, replace or adopt; rows are transformed as DataFrames and
committed by the store in its order. A batch that comes again after a restart replays onto
itself, because known blocks are left out by the ledger.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.operators.chain import Deep
from chainloom.operators.store import Store
from chainloom.schema import WINDOW


@dataclass
class Ring:
    """The newest blocks (height, hash) and the lowest height that may be retracted."""

    blocks: list[tuple[int, str]] = field(default_factory=list)
    window: int = WINDOW
    history: bool = False  # whether blocks below the first were accepted

    def __post_init__(self):
        if not 1 <= self.window <= WINDOW:
            raise ValueError(f"an undo window has 1 to {WINDOW} blocks")

    @property
    def tip(self) -> int | None:
        return self.blocks[-1][0] if self.blocks else None

    def push(self, height: int, hash_: str) -> None:
        self.blocks.append((height, hash_))
        if len(self.blocks) > self.window:
            self.blocks = self.blocks[-self.window :]
            self.history = True

    def accept(self, height: int, hash_: str, parent: str) -> list[tuple[int, str]] | None:
        """Orphans, newest first, of a block that comes next; None if it is known already."""
        if (height, hash_) in self.blocks:
            return None
        if not self.blocks:
            self.push(height, hash_)
            return []
        low, high = self.blocks[0][0], self.blocks[-1][0]
        if height > high + 1:
            raise ValueError(f"block {height} does not follow {high}")
        if height < low or height == low and self.history:
            raise Deep(f"block {height} is below the undo window")
        keep = [b for b in self.blocks if b[0] < height]
        if keep and keep[-1] != (height - 1, parent):
            raise ValueError(f"block {height} has another parent")
        orphans = [b for b in reversed(self.blocks) if b[0] >= height]
        self.blocks = keep
        self.push(height, hash_)
        return orphans


def plan_batch(ring: Ring, metas: list[tuple[int, str, str]]) -> tuple[list[tuple[int, str]], list[tuple[int, str, list[str]]]]:
    """(accepted blocks, reorgs) of a batch of (height, hash, parent) in publish order, as its net effect.

    A block that the batch itself orphans is neither accepted nor named, and one that it orphans and accepts again stays
    as it was; so a batch that comes again does nothing. There is one reorg at most.
    """
    before = set(ring.blocks)
    orphaned: set[tuple[int, str]] = set()
    accepted: list[tuple[int, str]] = []
    for height, hash_, parent in metas:
        orphans = ring.accept(height, hash_, parent)
        if orphans is None:
            continue
        orphaned.update(orphans)
        orphaned.discard((height, hash_))
        accepted = [b for b in accepted if b not in orphans]
        accepted.append((height, hash_))
    gone = sorted(orphaned & before, reverse=True)
    new = [b for b in accepted if b not in before]
    reorgs = [(gone[-1][0], accepted[-1][1], [h for _, h in gone])] if gone else []
    return new, reorgs


class Pipeline:
    """Applies micro-batches to a store."""

    def __init__(self, store: Store, chain: str, transform: Callable[[DataFrame], dict[str, DataFrame]], window: int = WINDOW):
        """``transform`` turns a batch's blocks (height, hash, parent_hash, timestamp, json) into rows by table."""
        self.store, self.chain, self.transform = store, chain, transform
        self.store.repair()
        rows = store.read("accepted_blocks").orderBy(F.desc("height")).limit(window + 1).select("height", "hash").collect()  # a window at most
        rows = sorted((int(r["height"]), r["hash"]) for r in rows)
        self.ring = Ring(rows[-window:], window, history=len(rows) > window)

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        """One micro-batch; block identities come to the driver, rows do not."""
        batch = batch.persist()
        try:
            # ties of one height keep the order of arrival
            metas = [(r["height"], r["hash"], r["parent_hash"]) for r in batch.select("height", "hash", "parent_hash").collect()]
            ring = Ring(list(self.ring.blocks), self.ring.window, self.ring.history)
            new, reorgs = plan_batch(ring, metas)
            if not new and not reorgs:
                return
            spark = batch.sparkSession
            accepted = spark.createDataFrame(new, "height bigint, hash string")
            fresh = batch.join(F.broadcast(accepted), ["height", "hash"]).dropDuplicates(["hash"])  # one row for each block of a bounded batch
            if hasattr(self.transform, "retract"):  # a transform with state forgets what the batch orphans
                self.transform.retract([h for _, _, o in reorgs for h in o])
            out = self.transform(fresh)
            out["accepted_blocks"] = fresh.select(
                "height", "hash", "parent_hash", F.timestamp_seconds("timestamp").alias("timestamp"), F.lit(self.chain).alias("chain"), F.concat("hash", F.lit(":accepted_block")).alias("dedupe_key")
            )
            if reorgs:
                rows = [(h, n, json.dumps(o), self.chain, f"{n}:reorg") for h, n, o in reorgs]
                out["reorgs"] = spark.createDataFrame(rows, "height bigint, new_head_hash string, orphaned_hashes string, chain string, dedupe_key string")
            self.store.commit(out)
            self.ring = ring
        finally:
            batch.unpersist()

    def start(self, blocks: DataFrame, checkpoint: str, available_now: bool = True):
        """Follows a stream of blocks. The checkpoint holds the source's offsets; the ledger says what is done."""
        writer = blocks.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
        return writer.start()


def catch_up_window(events: DataFrame, at: str, delay: str = "10 minutes") -> DataFrame:
    """An addition of ours: events counted in windows of a minute, updated until they close."""
    return events.withWatermark(at, delay).groupBy(F.window(at, "1 minute")).agg(F.count(F.lit(1)).alias("n"))
