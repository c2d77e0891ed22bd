"""Hash-linked blocks: links, ledgers and reorgs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.schema import WINDOW


class Deep(ValueError):
    """A fork below the undo window; late data is an error here and never dropped."""


def linked(blocks: DataFrame) -> DataFrame:
    """Blocks with ``linked``: whether each follows the one before by height and parent hash.

    A ledger is a bounded list of the newest blocks, so one window over it holds no more than that.
    """
    w = Window.partitionBy("chain").orderBy("height") if "chain" in blocks.columns else Window.partitionBy(F.lit(0)).orderBy("height")
    ok = (F.lag("height").over(w) + 1 == F.col("height")) & (F.lag("hash").over(w) == F.col("parent_hash"))
    return blocks.withColumn("linked", F.coalesce(ok, F.row_number().over(w) == 1))


def link_check(blocks: DataFrame, height: str = "height") -> DataFrame:
    """Blocks whose parent is not the block below; an equi-join, so any number of blocks will do."""
    below = blocks.select((F.col(height) + 1).alias("at"), F.col("hash").alias("below"))
    joined = blocks.join(below, F.col(height) == F.col("at"))
    return joined.where(F.col("parent_hash") != F.col("below")).drop("at", "below")


def linked_suffix(ledger: DataFrame) -> DataFrame:
    """The newest blocks of a ledger that link without a break, with ``chain`` kept apart if present."""
    keys = ["chain"] if "chain" in ledger.columns else []
    down = Window.partitionBy(*keys, F.lit(0)).orderBy(F.desc("height"))
    up = Window.partitionBy(*keys, F.lit(0)).orderBy("height")
    broken = ~((F.lag("height").over(up) + 1 == F.col("height")) & (F.lag("hash").over(up) == F.col("parent_hash")))
    marked = ledger.withColumn("broken", F.coalesce(broken.cast("int"), F.lit(0)))
    above = F.coalesce(F.sum("broken").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("above", above).where("above = 0").drop("broken", "above")


def newest(ledger: DataFrame, n: int = WINDOW, height: str = "height") -> DataFrame:
    """The newest ``n`` blocks, oldest first."""
    return ledger.orderBy(F.desc(height), "hash").limit(n).orderBy(height, "hash")


def pruned(ledger: DataFrame, keep: int, height: str = "height") -> DataFrame:
    """The ledger without blocks more than ``keep`` below its tip."""
    tip = ledger.agg(F.max(height).alias("tip"))
    return ledger.join(F.broadcast(tip)).where(F.col(height) > F.col("tip") - keep).drop("tip")


def plan_reorg(ledger: DataFrame, branch: DataFrame, floor: int, whole_history: bool = False) -> DataFrame:
    """The reorg row for a branch that ends in a new head: height, new_head_hash, orphans newest first.

    ``branch`` has height, hash of the new blocks down to the ancestor or further. ``floor`` is the lowest height that may be
    retracted. A branch without a block of the ledger is refused, unless the ledger holds the whole history and the
    branch replaces its first block.
    """
    common = branch.join(ledger, ["height", "hash"]).agg(F.max("height").alias("ancestor"))
    lowest = branch.agg(F.min("height").alias("lowest")).join(F.broadcast(ledger.agg(F.min("height").alias("first"))))
    whole = F.lit(whole_history) & (F.col("lowest") <= F.col("first"))
    refused = F.raise_error(F.lit("the branch has no block in common with the ledger")).cast("bigint")
    common = common.join(F.broadcast(lowest)).select(F.when(F.col("ancestor").isNotNull() | F.col("first").isNull(), F.col("ancestor")).when(whole, F.col("lowest") - 1).otherwise(refused).alias("ancestor"))
    head = branch.agg(F.max_by("hash", "height").alias("new_head_hash"))
    orphans = ledger.join(F.broadcast(common)).where(F.col("height") > F.col("ancestor"))
    named = orphans.agg(F.sort_array(F.collect_list(F.struct("height", "hash")), asc=False).alias("o"), F.min("height").alias("height"))  # a window of blocks at most
    out = named.join(head).select("height", "new_head_hash", F.to_json(F.transform("o", lambda x: x["hash"])).alias("orphaned_hashes"))
    out = out.withColumn("height", F.when(F.col("height") < floor, F.raise_error(F.lit("the fork is below the undo window"))).otherwise(F.col("height")))
    return out.where("height is not null")


def apply_reorgs(rows: DataFrame, reorgs: DataFrame, hash_: str = "block_hash", height: str = "block_number") -> DataFrame:
    """Rows without those of orphaned blocks at or above the height of their reorg."""
    orphans = reorgs.select(F.col("height").alias("r_height"), F.explode(F.from_json("orphaned_hashes", "array<string>")).alias("r_hash"))
    gone = (F.col(hash_) == F.col("r_hash")) & (F.col(height) >= F.col("r_height"))
    return rows.join(orphans, gone, "left_anti")


def last_copies(rows: DataFrame, seq: str, keys: tuple[str, ...] = ("chain", "dedupe_key")) -> DataFrame:
    """The copy of each key that was published last; partial sums combine before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, seq)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(seq, *rest)).alias("b"))
    return best.select(*keys, F.col(f"b.{seq}").alias(seq), *[F.col(f"b.{c}").alias(c) for c in rest])


def upsert(held: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("chain", "dedupe_key")) -> DataFrame:
    """The table after replaying ``new``: its rows take the place of held rows of the same key."""
    return held.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def rewound(rows: DataFrame, height: int, column: str = "block_number") -> DataFrame:
    """Rows at or below a height."""
    return rows.where(F.col(column) <= height)
