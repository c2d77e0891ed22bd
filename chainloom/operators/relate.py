"""The joins of the pipeline, declared as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_sender(rows: DataFrame, transactions: DataFrame) -> DataFrame:
    """Rows with sender, recipient and input of their transaction, null where it was not fetched."""
    t = transactions.select("block_hash", F.col("hash").alias("transaction_hash"), F.col("from_address").alias("transaction_from_address"), F.col("to_address").alias("transaction_to_address"), F.col("input").alias("transaction_input"))
    return rows.join(t, ["block_hash", "transaction_hash"], "left")


def with_header(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Found logs with height and time of their block; ``problem`` marks those without a header."""
    b = blocks.select(F.col("hash").alias("block_hash"), F.col("number").alias("header_number"), F.col("timestamp").alias("header_timestamp"))
    joined = rows.join(b, "block_hash", "left")
    return joined.withColumn("problem", F.when(F.col("header_number").isNull(), F.lit("log without its header")))


def missing_rows(new: DataFrame, held: DataFrame, keys: tuple[str, ...] = ("chain", "dedupe_key")) -> DataFrame:
    """Rows whose key the table lacks, once each; also the queue of contracts that are handed over."""
    return new.dropDuplicates(list(keys)).join(held.select(*keys), list(keys), "left_anti")


def stray_blocks(rows: DataFrame, ledger: DataFrame, floor: int, hash_: str = "block_hash", height: str = "block_number") -> DataFrame:
    """Block hashes at or above ``floor`` that a table names but the ledger does not."""
    named = rows.where(F.col(height) >= floor).select(F.col(hash_).alias("hash")).distinct()
    return named.join(ledger.select("hash"), "hash", "left_anti")


def unfinished_retractions(reorgs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Reorgs of which the ledger still names an orphan."""
    orphans = reorgs.withColumn("hash", F.explode(F.from_json("orphaned_hashes", "array<string>")))
    return orphans.join(ledger.select("hash"), "hash", "left_semi").drop("hash").dropDuplicates()


def temporal_contracts(logs: DataFrame, contracts: DataFrame) -> DataFrame:
    """Logs of known contracts: a seed counts from the start, a found one from the log after its creation.

    ``contracts`` has address, entry, seed, and block_number and log_index of the creation.
    """
    c = contracts.select(F.col("address"), "entry", "seed", F.col("block_number").alias("since_block"), F.col("log_index").alias("since_log"))
    after = F.struct("block_number", "log_index") > F.struct("since_block", "since_log")
    return logs.join(c, "address").where(F.col("seed") | after).drop("since_block", "since_log", "seed")


def fork_ancestor(branch: DataFrame, ledger: DataFrame) -> DataFrame:
    """The highest height at which branch and ledger name the same hash."""
    return branch.join(ledger, ["height", "hash"]).agg(F.max("height").alias("ancestor"))


def newest_common_block(ledgers: list[DataFrame]) -> DataFrame:
    """The newest (height, hash) that all ledgers hold; a ledger below its own floor has no say.

    Each ledger has height, hash; one that starts above a height cannot deny it, so the vote needs only those whose
    floor is at or below it.
    """
    votes, floors = None, None
    for i, ledger in enumerate(ledgers):
        own = ledger.select("height", "hash").distinct().withColumn("of", F.lit(i))
        low = ledger.agg(F.min("height").alias("floor"))
        votes = own if votes is None else votes.unionByName(own)
        floors = low if floors is None else floors.unionByName(low)
    floors = floors.where("floor is not null")  # one row for each ledger
    counted = votes.groupBy("height", "hash").agg(F.countDistinct("of").alias("yes"))
    entitled = counted.join(F.broadcast(floors), F.col("floor") <= F.col("height")).groupBy("height", "hash", "yes").agg(F.count(F.lit(1)).alias("say"))
    return entitled.where("yes = say").orderBy(F.desc("height"), "hash").limit(1).select("height", "hash")


def against_held(handed: DataFrame, held: DataFrame) -> DataFrame:
    """Handed blocks as the same as held, replacing a held one, or new."""
    h = held.select("height", F.col("hash").alias("held_hash"))
    state = F.when(F.col("held_hash").isNull(), "new").when(F.col("held_hash") == F.col("hash"), "same").otherwise("replaces")
    return handed.join(h, "height", "left").withColumn("state", state).drop("held_hash")


def coverage(wanted: DataFrame, session: DataFrame, keys: tuple[str, ...] = ("contract", "event_id")) -> DataFrame:
    """What keeps a session from covering the wanted set: NotDecoding, or each event of one side only."""
    a = wanted.select(*keys).distinct().withColumn("wanted", F.lit(True))
    b = session.select(*keys).distinct().withColumn("decoding", F.lit(True))
    both = a.join(b, list(keys), "full")
    any_ = F.max("decoding").over(Window.partitionBy(F.lit(1)))  # both sides are catalogs, not data
    differ = both.withColumn("any", any_).where(F.col("wanted").isNull() | F.col("decoding").isNull())
    return differ.select(*keys, F.when(F.col("any").isNull(), "NotDecoding").otherwise("EventsDiffer").alias("problem"))


def children_of(logs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with the log that they come from: a child's key starts with the log's key and a colon.

    The log's key is the child's first three parts, so the prefix is cut off and joined for equality.
    """
    parent = F.substring_index(F.col("dedupe_key"), ":", 3)
    child = rows.withColumn("log_key", parent)
    return child.join(logs.select(F.col("dedupe_key").alias("log_key"), "log_index"), "log_key")


def next_in(rows: DataFrame, events: DataFrame, keys: tuple[str, ...], order: str = "log_index") -> DataFrame:
    """Each row with the first later event of the same keys (as-of forward), null if there is none."""
    both = rows.withColumn("mark", F.lit(None).cast("bigint")).unionByName(events.select(*keys, order).withColumn("mark", F.col(order).cast("bigint")), allowMissingColumns=True)
    later = Window.partitionBy(*keys).orderBy(order).rangeBetween(1, Window.unboundedFollowing)
    return both.withColumn("next", F.min("mark").over(later)).where("mark is null").drop("mark")


def overlapping(ranges: DataFrame, low: int, high: int) -> DataFrame:
    """Files whose range of heights meets [low, high]."""
    return ranges.where((F.col("low") <= high) & (F.col("high") >= low))


def interval_join(points: DataFrame, ranges: DataFrame, at: str, width: int) -> DataFrame:
    """Points inside [low, high] of ranges: joined on buckets of ``width``, then compared."""
    spread = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    placed = points.withColumn("bucket", F.floor(F.col(at) / width))
    return placed.join(spread, "bucket").where(F.col(at).between(F.col("low"), F.col("high"))).drop("bucket")
