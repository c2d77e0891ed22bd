"""Aggregates over tables, files and commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds in seconds of the commit histogram's buckets; the last is open.
COMMIT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 15.0, 60.0)


def newest_partition(table: DataFrame) -> DataFrame:
    return table.agg(F.max("block_range").alias("newest"))


def bounds(batch: DataFrame, height: str = "height") -> DataFrame:
    """First height and tip of a batch."""
    return batch.agg(F.min(height).alias("first"), F.max(height).alias("tip"))


def floor_by_rows(files: DataFrame, wanted: int) -> DataFrame:
    """The height from which files hold ``wanted`` rows, newest first: files whose newer ones hold fewer.

    ``files`` is a listing (low, high, rows), not data.
    """
    newer = Window.partitionBy(F.lit(0)).orderBy(F.desc("high"), F.desc("low")).rowsBetween(Window.unboundedPreceding, -1)
    need = files.withColumn("newer", F.coalesce(F.sum("rows").over(newer), F.lit(0))).where(F.col("newer") < wanted)
    return need.agg(F.min("low").alias("floor"), F.sum("rows").alias("rows"))


def small_files(files: DataFrame, tip: int, window: int, width: int, small: int) -> DataFrame:
    """Finished partitions with more than one small file, worth rewriting."""
    done = files.where(((F.col("block_range") + 1) * width + window <= tip) & (F.col("bytes") < small))
    return done.groupBy("block_range").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes")).where("files > 1")


def commit_histogram(commits: DataFrame, store: str = "store", seconds: str = "seconds") -> DataFrame:
    """Commits of each store by bucket of duration, with counts that add up from the left."""
    bucket = F.lit(len(COMMIT_BUCKETS))
    for i in reversed(range(len(COMMIT_BUCKETS))):
        bucket = F.when(F.col(seconds) <= COMMIT_BUCKETS[i], F.lit(i)).otherwise(bucket)
    counts = commits.groupBy(F.col(store).alias("store"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("store").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum("n").over(upto))


def counters(events: DataFrame, store: str, fields: dict[str, str]) -> DataFrame:
    """Counters of each store: one column for each condition, and the newest height as a gauge."""
    return events.groupBy(store).agg(*[F.count(F.when(F.expr(cond), 1)).alias(name) for name, cond in fields.items()])


def progress(blocks: DataFrame, at: str, height: str, target: str, behind: int = 8) -> DataFrame:
    """One line for each second of catching up by more than ``behind`` blocks."""
    late = blocks.where(F.col(target) - F.col(height) > behind)
    return late.groupBy(F.window(at, "1 second").alias("w")).agg(F.count(F.lit(1)).alias("blocks"), F.max(height).alias("height"), F.max(target).alias("target")).select(F.col("w.start").alias("second"), "blocks", "height", "target")


def log_counts(logs: DataFrame) -> DataFrame:
    """Logs of each transaction."""
    return logs.groupBy("block_hash", "transaction_hash").agg(F.count(F.lit(1)).alias("log_count"))
