"""A chain made of the relational test tables, so that chain operators have an oracle in SQL.

A block is a day of orders, a transaction is an order, a log is a line item and its index the line's number; hashes
are SHA-256 of the ids. The same expressions are easily written in any SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Gas of a line item and of an order on its own.
LOG_GAS, BASE_GAS = 1_000, 21_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def hashed(value: Column | str, tag: str = "") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.concat(F.lit("0x"), F.sha2(F.concat(F.lit(tag), value.cast("string")), 256))


def address(value: Column | str, tag: str) -> Column:
    return F.substring(hashed(value, tag), 1, 42)


def day(at: Column | str) -> Column:
    return F.datediff(F.col(at) if isinstance(at, str) else at, F.lit("1970-01-01").cast("date")).cast("bigint")


def encode(value: Column) -> Column:
    """A long as a 256-bit word in hex."""
    return F.when(value < 0, F.lpad(F.lower(F.hex(value)), 64, "f")).otherwise(F.lpad(F.lower(F.hex(value)), 64, "0"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("block_number", day("o_orderdate"))
    return o.select(
        "o_orderkey", "block_number", hashed("block_number", "b").alias("block_hash"), hashed("o_orderkey").alias("hash"), address("o_custkey", "c").alias("from_address"),
        F.when(F.col("o_orderkey") % 7 != 0, address(F.col("o_custkey") % 10, "t")).alias("to_address"), hashed("o_orderkey", "i").alias("input"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("value"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("o_orderkey", "block_number", "block_hash", F.col("hash").alias("transaction_hash"))
    li = read(spark, sf_dir, "lineitem")
    return li.join(t, li["l_orderkey"] == t["o_orderkey"]).withColumn("log_index", F.col("l_linenumber").cast("bigint")).withColumn("address", address("l_suppkey", "s"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with orders, each the child of the day before that has any."""
    per = transactions(spark, sf_dir).groupBy("block_number", "block_hash").agg(F.count(F.lit(1)).alias("n"))
    return per.select(F.col("block_number").alias("height"), F.col("block_hash").alias("hash"), hashed(F.col("block_number") - 1, "b").alias("parent_hash"), "n")


#: The same frames in SQL.
TX = """(SELECT o_orderkey, bn AS block_number, '0x' || sha256('b' || bn) AS block_hash, '0x' || sha256(o_orderkey::VARCHAR) AS hash, substr('0x' || sha256('c' || o_custkey), 1, 42) AS from_address,
CASE WHEN o_orderkey % 7 <> 0 THEN substr('0x' || sha256('t' || (o_custkey % 10)), 1, 42) END AS to_address, '0x' || sha256('i' || o_orderkey) AS input, round(o_totalprice * 100)::BIGINT AS value
FROM (SELECT *, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS bn FROM orders))"""
LOG = f"""(SELECT l.*, t.block_number, t.block_hash, t.hash AS transaction_hash, l.l_linenumber::BIGINT AS log_index, substr('0x' || sha256('s' || l.l_suppkey), 1, 42) AS address FROM lineitem l JOIN {TX} t ON l.l_orderkey = t.o_orderkey)"""
BLOCK = f"""(SELECT block_number AS height, block_hash AS hash, '0x' || sha256('b' || (block_number - 1)) AS parent_hash, count(*) AS n FROM {TX} GROUP BY 1, 2, 3)"""
