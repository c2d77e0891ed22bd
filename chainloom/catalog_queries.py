"""Registered queries of the chain operators, each with the DuckDB SQL that it must agree with."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.functions import words as W
from chainloom.functions.abi import merge, parse_signature
from chainloom.functions.names import fit_identifier, snake_case
from chainloom.operators import chain, decode, derive, measure, normalize, relate
from chainloom.plans import fetch, route
from chainloom.schema import DATASETS, at_or_above, block_range, contract_key, decoded_key, derived_key, log_key, of_values, transaction_key, within
from chainloom.sources import envelopes, manifest, wire
from chainloom.sources.bridge import BLOCK, LOG, TX, address, blocks, day, encode, hashed, logs, read, transactions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _word(value: str, bits: str = "") -> str:
    """SQL for a non-negative integer as a padded hex word."""
    return f"lpad(lower(to_hex({value})), 64, '0'){bits}"


# Projections and predicates

_N = "1 + l_linenumber % 5"
_RAW = ["'0x' || sha256('f' || l_returnflag)", "'0x' || sha256('g' || l_linestatus)", "'0x' || sha256('s' || l_suppkey)", "'0x' || sha256('p' || l_partkey)"]


@registered(f"SELECT block_hash, transaction_hash, log_index, address, {', '.join(f'CASE WHEN {_N} > {i} THEN {t} END AS topic{i}' for i, t in enumerate(_RAW))} FROM {LOG}")
def project_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics become four columns; a fifth is dropped."""
    all_ = F.array(hashed("l_returnflag", "f"), hashed("l_linestatus", "g"), hashed("l_suppkey", "s"), hashed("l_partkey", "p"), F.lit("0x05"))
    raw = logs(spark, sf_dir).withColumn("topics", F.slice(all_, 1, 1 + F.col("l_linenumber") % 5))
    return normalize.logs(raw.select("block_hash", "transaction_hash", "log_index", "address", "topics"))


@registered(
    f"""SELECT block_hash || ':' || transaction_hash || ':' || log_index AS log_key, block_hash || ':' || transaction_hash || ':tx' AS tx_key, block_hash || ':' || transaction_hash || ':' || log_index || ':0xab:ev:decoded' AS decoded,
block_hash || ':' || transaction_hash || ':' || log_index || ':' || address || ':contract' AS contract, block_hash || ':' || transaction_hash || ':' || log_index || ':swaps:0' AS derived FROM {LOG}"""
)
def dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = log_key(F.col("block_hash"), F.col("transaction_hash"), F.col("log_index"))
    return logs(spark, sf_dir).select(
        key.alias("log_key"), transaction_key(F.col("block_hash"), F.col("transaction_hash")).alias("tx_key"), decoded_key(key, F.lit("0xab"), F.lit("ev")).alias("decoded"),
        contract_key(key, F.col("address")).alias("contract"), derived_key(key, "swaps", F.lit(0)).alias("derived"),
    )


@registered(f"SELECT height::BIGINT AS number, hash, parent_hash, (height * 86400)::BIGINT AS seconds, (n * 21000)::BIGINT AS gas_used, n::BIGINT AS transaction_count, (height * 1000000007)::VARCHAR AS difficulty, NULL::VARCHAR AS base_fee FROM {BLOCK}")
def project_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers as JSON with hex quantities into ``blocks`` rows; absent fields are null."""
    b = blocks(spark, sf_dir)
    header = F.struct(
        W.to_quantity(F.col("height")).alias("number"), "hash", F.col("parent_hash").alias("parentHash"), W.to_quantity(F.col("height") * 86400).alias("timestamp"), W.to_quantity(F.col("n") * 21000).alias("gasUsed"),
        W.to_quantity(F.col("height") * 1_000_000_007).alias("difficulty"), F.array_repeat(F.lit("0x0"), F.col("n").cast("int")).alias("transactions"),
    )
    rows = normalize.blocks(b.select(F.to_json(header).alias("json")))
    return rows.select(
        F.col("number").cast("bigint").alias("number"), "hash", "parent_hash", F.unix_seconds("timestamp").alias("seconds"), F.col("gas_used").cast("bigint").alias("gas_used"),
        F.col("transaction_count").cast("bigint").alias("transaction_count"), "difficulty", F.col("base_fee_per_gas").cast("string").alias("base_fee"),
    )


_IDX = "row_number() OVER (PARTITION BY block_number ORDER BY o_orderkey) - 1"


@registered(
    f"""WITH t AS (SELECT *, {_IDX} AS i, o_orderkey % 4 AS kind, o_orderkey % 2 AS parity, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 8453 END AS cid FROM {TX})
SELECT hash, i::BIGINT AS transaction_index, (21000 + i)::BIGINT AS receipt_gas_used, CASE WHEN kind = 0 THEN CASE WHEN cid IS NULL THEN parity + 27 ELSE parity + 35 + 2 * cid END ELSE parity END::BIGINT AS v,
CASE WHEN kind <> 0 THEN parity END::BIGINT AS y_parity, CASE WHEN kind >= 2 THEN value END::BIGINT AS max_fee FROM t"""
)
def project_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with their receipts, signature values and fee caps."""
    t = transactions(spark, sf_dir)
    t = t.withColumn("transaction_index", (F.row_number().over(Window.partitionBy("block_number").orderBy("o_orderkey")) - 1).cast("bigint"))
    receipts = t.select("block_hash", F.col("hash").alias("transaction_hash"), "transaction_index", (F.col("transaction_index") + 21000).alias("receipt_gas_used"))
    both = normalize.with_receipts(t, receipts).where("problem is null")
    kind, parity = F.col("o_orderkey") % 4, F.col("o_orderkey") % 2
    v, y = normalize.signature(kind, parity, F.when(F.col("o_orderkey") % 3 != 0, F.lit(8453).cast("bigint")))
    cap, _ = normalize.fee_caps(kind, F.col("value"), F.col("value"))
    return both.select("hash", "transaction_index", "receipt_gas_used", v.cast("bigint").alias("v"), y.cast("bigint").alias("y_parity"), cap.alias("max_fee"))


@registered(
    f"""WITH r AS (SELECT height, 0 AS kind_rank, -1 AS tx_rank, -1 AS log_rank, 'block' AS type, hash AS k FROM {BLOCK} UNION ALL SELECT block_number, 1, o_orderkey, -1, 'transaction', hash FROM {TX}
UNION ALL SELECT block_number, 1, l_orderkey, log_index, 'log', transaction_hash || log_index FROM {LOG} UNION ALL SELECT height, 3, -1, -1, 'accepted_block', hash FROM {BLOCK})
SELECT type, height, k AS dedupe_key, (row_number() OVER (PARTITION BY height ORDER BY kind_rank, tx_rank, log_rank, k))::BIGINT AS ordinal FROM r"""
)
def event_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block, each transaction before its logs, and the acceptance at the end."""
    none = F.lit(None).cast("bigint")
    b = blocks(spark, sf_dir).select("height", none.alias("transaction_index"), none.alias("log_index"), F.col("hash").alias("dedupe_key"))
    t = transactions(spark, sf_dir).select(F.col("block_number").alias("height"), F.col("o_orderkey").alias("transaction_index"), none.alias("log_index"), F.col("hash").alias("dedupe_key"))
    g = logs(spark, sf_dir).select(F.col("block_number").alias("height"), F.col("l_orderkey").alias("transaction_index"), "log_index", F.concat("transaction_hash", "log_index").alias("dedupe_key"))
    rows = normalize.ordered({"block": b, "transaction": t, "log": g, "accepted_block": b})
    inside = Window.partitionBy("height").orderBy("kind_rank", "tx_rank", "log_rank", "dedupe_key")
    return rows.select("type", "height", "dedupe_key", F.row_number().over(inside).cast("bigint").alias("ordinal"))


@registered(f"SELECT height + CASE WHEN height % 50 = 0 THEN 1 ELSE 0 END AS height, height AS asked FROM {BLOCK} WHERE height % 50 = 0")
def height_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).select((F.col("height") + F.when(F.col("height") % 50 == 0, 1).otherwise(0)).alias("height"), F.col("height").alias("asked"))
    return normalize.height_check(rows).select("height", "asked")


@registered(f"SELECT l_orderkey, l_linenumber::BIGINT AS line, before::BIGINT AS before FROM (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS before FROM lineitem) WHERE l_linenumber <= before")
def log_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in order of shipping whose number does not ascend."""
    rows = read(spark, sf_dir, "lineitem").withColumn("arrival", F.struct("l_shipdate", "l_linenumber"))
    found = normalize.log_order_check(rows, "l_orderkey", "arrival", "l_linenumber")
    return found.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), F.col("before").cast("bigint").alias("before"))


@registered("SELECT '0x' || sha256(o_orderkey::VARCHAR) AS hash FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def bloom_presence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "orders").select(hashed("o_orderkey").alias("hash"), F.when(F.col("o_orderkey") % 2 == 1, "0x0010").otherwise("0x0000").alias("logs_bloom"))
    some = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(hashed("l_orderkey").alias("block_hash"))
    return normalize.bloom_check(b, some).select("hash")


@registered(f"SELECT block_number, l_orderkey, log_index FROM {LOG} WHERE block_number % 9 = 0")
def leftover_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = blocks(spark, sf_dir).where("height % 9 <> 0").select(F.col("height").alias("number"), "hash")
    return normalize.leftover_check(logs(spark, sf_dir), asked).select("block_number", "l_orderkey", "log_index")


@registered(
    """WITH t AS (SELECT l_orderkey, max(l_linenumber) AS last, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem WHERE l_quantity > 2 GROUP BY 1)
SELECT '0x' || sha256(o_orderkey::VARCHAR) AS hash, CASE WHEN n <> last OR n <> d THEN 'transaction index gap' ELSE 'gas differs' END AS problem FROM orders LEFT JOIN t ON l_orderkey = o_orderkey
WHERE n <> last OR n <> d OR coalesce(last * 10, 0) <> 10 * (1 + o_orderkey % 7)"""
)
def gas_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").where("l_quantity > 2")
    tx = li.select(hashed("l_orderkey").alias("block_hash"), (F.col("l_linenumber") - 1).alias("transaction_index"), (F.col("l_linenumber") * 10).alias("receipt_cumulative_gas_used"))
    b = read(spark, sf_dir, "orders").select(hashed("o_orderkey").alias("hash"), (10 * (1 + F.col("o_orderkey") % 7)).alias("gas_used"))
    return normalize.gas_check(b, tx)


@registered(
    """WITH r AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber = 6) AS nulls, count(*) FILTER (l_linenumber = 7) AS strange FROM lineitem GROUP BY 1),
p AS (SELECT '0x' || sha256(o_orderkey::VARCHAR) AS hash, CASE WHEN nulls > 0 THEN 'malformed: null hash' WHEN strange > 0 THEN 'inconsistent: another block''s' WHEN coalesce(n, 0) = 0 AND 1 + o_orderkey % 5 > 0 THEN 'inconsistent: none'
WHEN coalesce(n, 0) <> 1 + o_orderkey % 5 THEN 'malformed: count' END AS problem FROM orders LEFT JOIN r ON l_orderkey = o_orderkey)
SELECT hash, problem FROM p WHERE problem IS NOT NULL"""
)
def receipts_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = hashed("l_orderkey")
    r = read(spark, sf_dir, "lineitem").select(asked.alias("asked_hash"), F.when(F.col("l_linenumber") == 6, F.lit(None)).when(F.col("l_linenumber") == 7, "0xff").otherwise(asked).alias("block_hash"))
    b = read(spark, sf_dir, "orders").select(hashed("o_orderkey").alias("hash"), (1 + F.col("o_orderkey") % 5).alias("transaction_count"))
    return normalize.receipts_check(b, r)


@registered("SELECT l_orderkey, l_linenumber::BIGINT AS line, (l_orderkey // 100)::BIGINT AS block_range FROM lineitem WHERE l_orderkey BETWEEN 350 AND 920 OR l_orderkey >= 1300")
def partition_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height predicates carry the partition's bound beside the column's."""
    rows = read(spark, sf_dir, "lineitem").withColumn("block_range", block_range(F.col("l_orderkey"), 100))
    return rows.where(within("l_orderkey", 350, 920, 100) | at_or_above("l_orderkey", 1300, 100)).select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), "block_range")


@registered(f"SELECT hash, block_number FROM {TX} WHERE o_orderkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0 AND p_partkey <= 150) AND block_number >= 10000")
def of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [r["h"] for r in spark.range(0, 151).where("id % 3 = 0").select(hashed("id").alias("h")).collect()]  # a fixed list of 51
    return of_values(transactions(spark, sf_dir).where("block_number >= 10000"), "hash", wanted).select("hash", "block_number")


_CATALOG_TOML = """
protocol = "dex"
[[contract]]
name = "Factory"
events = ["PoolCreated(address indexed token, address pool)"]
addresses = { base = ["0xfafafafafafafafafafafafafafafafafafafafa"] }
[[contract]]
name = "Pool"
events = ["Swap(address indexed sender, int256 amount0, int64 amount1, uint64 fee, bool exact)"]
created_by = [{ contract = "Factory", event = "PoolCreated", param = "pool" }]
"""


def dex() -> manifest.Catalog:
    return manifest.build(manifest.parse(_CATALOG_TOML, "base"))


@registered("SELECT * FROM (VALUES ('a', 'blocks'), ('a', 'transactions'), ('a', 'logs'), ('b', 'dex_factory_pool_created'), ('b', 'dex_pool_swap'), ('c', 'logs'), ('c', 'decoded_logs'), ('c', 'dex_pool_swap')) t(store, tbl)")
def route_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = DATASETS | dex().tables()
    stores = {"a": ["blocks", "tr*", "logs"], "b": ["contract_events"], "c": ["*", "!dex_factory*", "!blocks", "!transactions"]}
    return spark.createDataFrame([(s, t) for s, e in stores.items() for t in sorted(route.resolve(e, tables))], "store string, tbl string")


@registered("SELECT store, event_type AS tbl, count(*) AS n FROM events, (VALUES ('a', 'click'), ('a', 'view'), ('b', 'purchase'), ('b', 'click')) r(store, t) WHERE event_type = r.t GROUP BY ALL")
def route_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumnRenamed("event_type", "table")
    taken = route.route_rows(rows, {"a": {"click", "view"}, "b": {"purchase", "click"}})
    return taken.groupBy("store", F.col("table").alias("tbl")).agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT json_object('chain', 'base', 'schema_version', 1, 'type', 'transaction', 'hash', hash, 'from', from_address, 'to', to_address, 'value', '0x' || lower(to_hex(value)))::VARCHAR AS value FROM " + TX)
def wire_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(spark, sf_dir).select("hash", "from_address", "to_address", W.to_quantity(F.col("value")).alias("value"))
    return normalize.to_wire(t, "transaction", "base")


@registered(f"SELECT hash, from_address AS \"from\", coalesce(to_address, '') AS \"to\", value::VARCHAR AS value FROM {TX}")
def envelope_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat JSON lines read back with the columns of their table; unknown fields are ignored."""
    lines = wire_projection(spark, sf_dir).select("value", F.get_json_object("value", "$.chain").alias("chain"), F.get_json_object("value", "$.type").alias("type"))
    rows = envelopes.records(lines, "transaction")
    return rows.select("hash", F.col("from_address").alias("from"), F.coalesce("to_address", F.lit("")).alias("to"), "value")


# Joins


@registered(f"SELECT l.transaction_hash, l.log_index, t.from_address AS sender, t.to_address AS recipient FROM {LOG} l LEFT JOIN (SELECT * FROM {TX} WHERE o_orderkey % 3 <> 0) t ON l.transaction_hash = t.hash")
def sender_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relate.with_sender(logs(spark, sf_dir), transactions(spark, sf_dir).where("o_orderkey % 3 <> 0"))
    return rows.select("transaction_hash", "log_index", F.col("transaction_from_address").alias("sender"), F.col("transaction_to_address").alias("recipient"))


@registered(f"SELECT l.transaction_hash, l.log_index, b.height, CASE WHEN b.height IS NULL THEN 'log without its header' END AS problem FROM {LOG} l LEFT JOIN (SELECT * FROM {BLOCK} WHERE height % 4 <> 0) b ON l.block_hash = b.hash")
def header_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).where("height % 4 <> 0").select("hash", F.col("height").alias("number"), F.timestamp_seconds(F.col("height") * 86400).alias("timestamp"))
    return relate.with_header(logs(spark, sf_dir), b).select("transaction_hash", "log_index", F.col("header_number").alias("height"), "problem")


@registered("SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS line FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def anti_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key the table lacks."""
    key = lambda k: F.concat(k.cast("string"), F.lit(":x"))
    new = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("chain"), key(F.col("l_orderkey")).alias("dedupe_key"), "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"))
    held = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.explode(F.sequence(F.lit(1), F.lit(7))).alias("line"), key(F.col("o_orderkey")).alias("dedupe_key"))
    held = held.select(F.col("line").cast("string").alias("chain"), "dedupe_key")
    return relate.missing_rows(new, held).select("l_orderkey", "line")


@registered(f"SELECT DISTINCT block_hash AS hash FROM {LOG} WHERE block_number >= 10000 AND block_number % 5 = 0")
def stray_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.stray_blocks(logs(spark, sf_dir), blocks(spark, sf_dir).where("height % 5 <> 0"), 10000)


_REORGS = f"SELECT height, hash AS head, json_array(hash, parent_hash)::VARCHAR AS orphans FROM {BLOCK} WHERE height % 10 = 0"


def _reorgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).where("height % 10 = 0")
    return b.select("height", F.col("hash").alias("new_head_hash"), F.to_json(F.array("hash", "parent_hash")).alias("orphaned_hashes"))


@registered(f"SELECT height, head AS new_head_hash, orphans AS orphaned_hashes FROM ({_REORGS}) r WHERE EXISTS (SELECT 1 FROM {BLOCK} b WHERE b.height % 3 = 0 AND b.hash IN (r.head, '0x' || sha256('b' || (r.height - 1))))")
def unfinished_retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relate.unfinished_retractions(_reorgs(spark, sf_dir), blocks(spark, sf_dir).where("height % 3 = 0"))


@registered(f"SELECT max(height) AS ancestor FROM {BLOCK} WHERE height < 10000")
def fork_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = blocks(spark, sf_dir)
    branch = ledger.withColumn("hash", F.when(F.col("height") >= 10000, hashed("height", "fork")).otherwise(F.col("hash")))
    return relate.fork_ancestor(branch.select("height", "hash"), ledger.select("height", "hash"))


@registered(f"SELECT height, hash FROM {BLOCK} WHERE height % 2 = 0 AND height % 3 = 0 AND height < 11000 ORDER BY height DESC LIMIT 1")
def common_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return relate.newest_common_block([b.where("height % 2 = 0"), b.where("height % 3 = 0"), b.where("height < 11000"), b.where("height > 1000000")])


@registered(f"SELECT height, CASE WHEN height % 3 = 0 THEN 'new' WHEN height % 3 = 1 THEN 'same' ELSE 'replaces' END AS state FROM {BLOCK}")
def held_vs_handed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir).select("height", "hash")
    held = b.where("height % 3 <> 0").withColumn("hash", F.when(F.col("height") % 3 == 1, F.col("hash")).otherwise(hashed("height", "old")))
    return relate.against_held(b, held).select("height", "state")


@registered("SELECT contract, event_id, 'EventsDiffer' AS problem FROM (SELECT DISTINCT p_brand AS contract, p_type AS event_id, p_size > 25 AS a FROM part) GROUP BY 1, 2 HAVING count(DISTINCT a) = 1")
def session_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("contract"), F.col("p_type").alias("event_id"), "p_size")
    return relate.coverage(p.where("p_size > 25"), p.where("p_size <= 25"))


@registered(f"SELECT DISTINCT block_hash || ':' || transaction_hash || ':' || log_index || ':swaps:0' AS dedupe_key, log_index FROM {LOG} WHERE l_linenumber <= 3")
def log_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children by the key of their log; log 3's key is no prefix of log 30's children."""
    g = logs(spark, sf_dir)
    key = log_key(F.col("block_hash"), F.col("transaction_hash"), F.col("log_index"))
    children = g.select(derived_key(key, "swaps", F.lit(0)).alias("dedupe_key")).distinct()
    return relate.children_of(g.where("l_linenumber <= 3").select(key.alias("dedupe_key"), "log_index").distinct(), children).select("dedupe_key", "log_index")


@registered("SELECT l_orderkey, l_linenumber::BIGINT AS log_index, (SELECT min(s.l_linenumber) FROM lineitem s WHERE s.l_returnflag = 'A' AND s.l_orderkey = l.l_orderkey AND s.l_linenumber > l.l_linenumber)::BIGINT AS next FROM lineitem l WHERE l_returnflag <> 'A'")
def next_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fill with the next swap of its transaction."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("log_index"), "l_returnflag")
    return relate.next_in(li.where("l_returnflag <> 'A'"), li.where("l_returnflag = 'A'"), ("l_orderkey",)).select("l_orderkey", "log_index", "next")


@registered("SELECT e.event_id, c.low FROM events e JOIN (SELECT (range * 97)::BIGINT AS low, (range * 97 + 40)::BIGINT AS high FROM range(0, 40)) c ON e.event_id BETWEEN c.low AND c.high")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.range(0, 40).select((F.col("id") * 97).alias("low"), (F.col("id") * 97 + 40).alias("high"))
    return relate.interval_join(read(spark, sf_dir, "events"), ranges, "event_id", 64).select("event_id", "low")


@registered("SELECT count(*) AS files, min(low) AS low FROM (SELECT (range * 10)::BIGINT AS low, (range * 10 + 14)::BIGINT AS high FROM range(0, 1000)) WHERE low <= 777 AND high >= 501")
def file_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.range(0, 1000).select((F.col("id") * 10).alias("low"), (F.col("id") * 10 + 14).alias("high"))
    return relate.overlapping(files, 501, 777).agg(F.count(F.lit(1)).alias("files"), F.min("low").alias("low"))


@registered("SELECT DISTINCT s_suppkey, '0xb1:' || substr('0x' || sha256('s' || s_suppkey), 1, 42) || ':handoff' AS dedupe_key FROM supplier WHERE s_suppkey % 4 <> 0")
def handoff_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainloom.plans.backfill import handoffs

    s = read(spark, sf_dir, "supplier").select("s_suppkey", address("s_suppkey", "s").alias("address"))
    queue = s.where("s_suppkey % 4 = 0").select(F.concat_ws(":", F.lit("0xb1"), "address", F.lit("handoff")).alias("dedupe_key"))
    return handoffs(s, queue, "0xb1").select("s_suppkey", "dedupe_key")


# Discovery and decoding

_FACTORY = "0x" + "fa" * 20


def dex_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of a factory and of pools: a supplier's first line of an order creates its pool, others are swaps."""
    g = logs(spark, sf_dir)
    created, swap = dex()["dex/Factory"].named("PoolCreated")[0], dex()["dex/Pool"].named("Swap")[0]
    first = F.col("l_linenumber") == 1
    pool = address("l_suppkey", "s")
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    pad = lambda a: F.concat(F.lit("0" * 24), F.substring(a, 3, 40))
    body = F.concat(encode(price * sign), encode(-F.col("l_partkey")), encode(F.col("l_quantity").cast("bigint")), encode((F.col("l_linestatus") == "O").cast("bigint")))
    return g.select(
        F.when(first, _FACTORY).otherwise(pool).alias("address"), F.when(first, created.topic0).otherwise(swap.topic0).alias("topic0"), F.concat(F.lit("0x"), pad(pool)).alias("topic1"),
        F.lit(None).cast("string").alias("topic2"), F.lit(None).cast("string").alias("topic3"), F.concat(F.lit("0x"), F.when(first, pad(pool)).otherwise(body)).alias("data"),
        F.col("block_number").cast("decimal(20,0)").alias("block_number"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(20,0)").alias("log_index"), "block_hash", "transaction_hash",
        F.lit(0).cast("decimal(20,0)").alias("transaction_index"), F.lit(None).cast("timestamp").alias("block_timestamp"),
    )


_DEX = f"""g AS (SELECT *, l_orderkey * 10 + l_linenumber AS idx FROM {LOG}),
c AS (SELECT address, min((block_number, idx)) AS since FROM (SELECT address, block_number, idx FROM g WHERE l_linenumber = 1) GROUP BY 1)"""


@registered(f"WITH {_DEX} SELECT address, (since[1])::BIGINT AS block_number, (since[2])::BIGINT AS log_index FROM c".replace("since[1]", "struct_extract(since, 1)").replace("since[2]", "struct_extract(since, 2)"))
def discovery_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools by the first log that creates each."""
    found = decode.discover(dex_logs(spark, sf_dir), dex())
    return found.where(~F.col("seed")).select("address", F.col("block_number").cast("bigint").alias("block_number"), F.col("log_index").cast("bigint").alias("log_index"))


_SWAPS = f"""WITH {_DEX} SELECT g.address, g.idx::BIGINT AS log_index, substr('0x' || sha256('s' || l_suppkey), 1, 42) AS sender, (round(l_extendedprice * 100)::BIGINT * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)::VARCHAR AS amount0,
(-l_partkey)::BIGINT AS amount1, l_quantity::BIGINT AS fee, l_linestatus = 'O' AS exact FROM g JOIN c ON g.address = c.address WHERE l_linenumber > 1 AND (block_number, idx) > since"""


@registered(_SWAPS)
def decode_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swaps of discovered pools after their creation, decoded by column expressions."""
    rows = dex_logs(spark, sf_dir)
    catalog = dex()
    known = decode.discover(rows, catalog)
    matched = decode.eligible(rows, known, catalog.events(spark))
    swap = catalog["dex/Pool"].named("Swap")[0]
    out = decode.decode_event(matched.where(F.col("signature") == swap.signature), swap)
    return out.select("address", F.col("log_index").cast("bigint").alias("log_index"), "sender", "amount0", "amount1", F.col("fee").cast("bigint").alias("fee"), "exact")


@registered(_SWAPS.replace("g.idx::BIGINT AS log_index, ", "g.idx::BIGINT AS log_index, ").replace("(-l_partkey)::BIGINT AS amount1, l_quantity::BIGINT AS fee, l_linestatus = 'O' AS exact", "(-l_partkey)::VARCHAR AS amount1, l_quantity::BIGINT::VARCHAR AS fee, (l_linestatus = 'O')::VARCHAR AS exact"))
def decoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same swaps through the Arrow-batched decoder that handles any type."""
    rows = dex_logs(spark, sf_dir)
    catalog = dex()
    docs = decode.decoded_logs(rows, catalog, decode.discover(rows, catalog)).where("name = 'Swap'")
    part = lambda f: F.get_json_object("body", f"$.{f}").alias(f)
    return docs.select("address", F.col("log_index").cast("bigint").alias("log_index"), part("sender"), part("amount0"), part("amount1"), part("fee"), part("exact"))


@registered("SELECT e.event_id, e.user_id FROM events e JOIN (SELECT user_id, min(event_id) AS since FROM events WHERE event_type = 'signup' GROUP BY 1) c ON e.user_id = c.user_id WHERE e.event_id > c.since")
def discovery_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users after the event that created them."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("user_id").alias("address"), F.col("event_id").alias("block_number"), F.lit(0).cast("bigint").alias("log_index"))
    first = decode.first_claims(e.where("event_type = 'signup'").select("address", "block_number", "log_index"))
    known = first.select("address", F.lit("user").alias("entry"), F.lit(False).alias("seed"), "block_number", "log_index")
    return relate.temporal_contracts(e, known).select("event_id", "user_id")


@registered("SELECT user_id AS address, event_type AS entry, min(event_id) AS log_index, ts::DATE::VARCHAR AS block_hash FROM events GROUP BY 1, 2, 4")
def contract_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each created address and block."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("address"), F.col("event_type").alias("entry"), F.to_date("ts").cast("string").alias("block_hash"), day("ts").alias("block_number"), F.col("event_id").alias("log_index"), F.lit("f").alias("factory_address"))
    return decode.contract_rows(e).select("address", "entry", "log_index", "block_hash")


# Aggregates


@registered("SELECT max(l_orderkey // 100)::BIGINT AS newest FROM lineitem")
def newest_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.newest_partition(read(spark, sf_dir, "lineitem").withColumn("block_range", block_range(F.col("l_orderkey"), 100)))


@registered(f"SELECT min(height) AS first, max(height) AS tip FROM {BLOCK}")
def batch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.bounds(blocks(spark, sf_dir))


@registered("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def last_copy_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return chain.last_copies(e, "event_id", ("user_id",))


@registered("SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1 UNION ALL SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events WHERE event_type <> 'purchase') WHERE k = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows take the place of held ones of the same key."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    latest = lambda df: chain.last_copies(df, "event_id", ("user_id",))
    return chain.upsert(latest(e.where("event_type <> 'purchase'")), latest(e.where("event_type = 'purchase'")), ("user_id",)).select("user_id", "event_id", "event_type")


@registered("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS at FROM events GROUP BY 1")
def newest_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("at"))


_FILES = "(SELECT bn // 30 AS p, min(bn) AS low, max(bn) AS high, count(*) AS n FROM (SELECT date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS bn FROM orders) GROUP BY 1)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(day("o_orderdate").alias("bn"))
    return o.groupBy(F.floor(F.col("bn") / 30).alias("p")).agg(F.min("bn").alias("low"), F.max("bn").alias("high"), F.count(F.lit(1)).alias("rows"))


@registered(f"WITH f AS (SELECT *, coalesce(sum(n) OVER (ORDER BY high DESC, low DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM {_FILES}) SELECT min(low) AS floor, sum(n)::BIGINT AS rows FROM f WHERE newer < 500")
def floor_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.floor_by_rows(_files(spark, sf_dir), 500)


@registered("SELECT user_id // 10 AS block_range, count(*) AS files, sum(event_id % 1000)::BIGINT AS bytes FROM events WHERE (user_id // 10 + 1) * 10 + 20 <= 90 AND event_id % 1000 < 300 GROUP BY 1 HAVING count(*) > 1")
def small_file_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).alias("block_range"), (F.col("event_id") % 1000).alias("bytes"))
    return measure.small_files(files, 90, 20, 10, 300)


@registered(f"SELECT block_hash, transaction_hash, count(*) AS log_count FROM {LOG} GROUP BY 1, 2")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.log_counts(logs(spark, sf_dir))


_BUCKET = """CASE WHEN s <= 0.005 THEN 0 WHEN s <= 0.01 THEN 1 WHEN s <= 0.025 THEN 2 WHEN s <= 0.05 THEN 3 WHEN s <= 0.1 THEN 4 WHEN s <= 0.25 THEN 5
WHEN s <= 0.5 THEN 6 WHEN s <= 1 THEN 7 WHEN s <= 2.5 THEN 8 WHEN s <= 5 THEN 9 WHEN s <= 15 THEN 10 WHEN s <= 60 THEN 11 ELSE 12 END"""


@registered(f"WITH c AS (SELECT event_type AS store, {_BUCKET} AS bucket, count(*) AS n FROM (SELECT event_type, (event_id % 9000) / 100.0 AS s FROM events) GROUP BY 1, 2) SELECT store, bucket, n, (sum(n) OVER (PARTITION BY store ORDER BY bucket))::BIGINT AS upto FROM c")
def commit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = read(spark, sf_dir, "events").select(F.col("event_type").alias("store"), (F.col("event_id") % 9000 / 100).alias("seconds"))
    return measure.commit_histogram(commits)


@registered("SELECT event_type AS store, count(*) FILTER (value > 50) AS commits, count(*) FILTER (value <= 50) AS retries FROM events GROUP BY 1")
def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.counters(read(spark, sf_dir, "events").withColumnRenamed("event_type", "store"), "store", {"commits": "value > 50", "retries": "value <= 50"})


@registered("SELECT date_trunc('second', ts) AS second, count(*) AS blocks, max(event_id) AS height, max(event_id + user_id) AS target FROM events WHERE user_id > 8 GROUP BY 1")
def progress_1s(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("target", F.col("event_id") + F.col("user_id"))
    return measure.progress(e, "ts", "event_id", "target").select(F.col("second").cast("timestamp_ntz").alias("second"), "blocks", "height", "target")


@registered("SELECT l_returnflag, sum((l_orderkey::HUGEINT * 1000000007 + l_partkey) * 1000000000039)::VARCHAR AS total FROM lineitem GROUP BY 1")
def exact_u256_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums of integers beyond 64 bits, kept as decimal text."""
    value = ((F.col("l_orderkey").cast("decimal(20,0)") * F.lit(1_000_000_007).cast("decimal(10,0)") + F.col("l_partkey")).cast("decimal(25,0)") * F.lit(1_000_000_000_039).cast("decimal(13,0)")).cast("decimal(38,0)").cast("string")
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(W.exact_sum(value).alias("total"))


# Ordered logic


@registered(f"SELECT c.height, c.hash FROM {BLOCK} c JOIN {BLOCK} p ON p.height = c.height - 1 WHERE c.height % 6 = 0")
def link_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose parent is not the block below."""
    b = blocks(spark, sf_dir)
    return chain.link_check(b.withColumn("parent_hash", F.when(F.col("height") % 6 == 0, F.lit("0xbad")).otherwise(F.col("parent_hash")))).select("height", "hash")


_SUFFIX = f"""WITH l AS (SELECT * FROM {BLOCK} ORDER BY height DESC LIMIT 4096),
b AS (SELECT *, coalesce(CASE WHEN height % 64 = 0 OR lag(height) OVER (ORDER BY height) + 1 <> height THEN 1 ELSE 0 END, 0) AS broken FROM l),
s AS (SELECT *, coalesce(sum(broken) OVER (ORDER BY height DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM b)"""


@registered(f"{_SUFFIX} SELECT height, hash FROM s WHERE above = 0")
def linked_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest blocks of a ledger that link without a break."""
    ledger = chain.newest(blocks(spark, sf_dir))
    broken = ledger.withColumn("parent_hash", F.when(F.col("height") % 64 == 0, F.lit("0xbad")).otherwise(F.col("parent_hash")))
    return chain.linked_suffix(broken).select("height", "hash")


@registered(f"SELECT height, hash FROM {BLOCK} ORDER BY height DESC LIMIT 40")
def ledger_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.newest(blocks(spark, sf_dir).select("height", "hash"), 40)


@registered(f"SELECT height, hash FROM {BLOCK} WHERE height > (SELECT max(height) FROM {BLOCK}) - 100")
def prune_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.pruned(blocks(spark, sf_dir).select("height", "hash"), 100)


@registered("SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 1")
def newest_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes.table_rows(read(spark, sf_dir, "events").withColumn("chain", F.lit("c")), "c", ["event_id", "user_id"], [("event_id", False)], 1)


@registered(f"SELECT l_orderkey, log_index, block_number FROM {LOG} WHERE block_number BETWEEN 9200 AND 9500 AND l_suppkey <= 5")
def lake_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored logs of a height range and some addresses, in chain order."""
    g = logs(spark, sf_dir).withColumn("block_range", block_range(F.col("block_number"), 100))
    few = [r["a"] for r in spark.range(0, 6).select(address("id", "s").alias("a")).collect()]  # a fixed list of 6
    return envelopes.lake_logs(g, 9200, 9500, few, 100).select("l_orderkey", "log_index", "block_number")


# Reorgs and retraction


@registered(f"SELECT l_orderkey, log_index FROM {LOG} WHERE NOT (block_number % 10 = 0 OR (block_number % 10 = 9 AND EXISTS (SELECT 1 FROM {BLOCK} b WHERE b.height = block_number + 1) AND FALSE))")
def reorg_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of orphaned blocks at or above the height of the reorg go; a lower parent it names stays."""
    return chain.apply_reorgs(logs(spark, sf_dir), _reorgs(spark, sf_dir)).select("l_orderkey", "log_index")


@registered(f"SELECT min(height) AS height, '0x' || sha256('fork' || max(height)) AS new_head_hash, CAST(to_json(list(hash ORDER BY height DESC)) AS VARCHAR) AS orphaned_hashes FROM {BLOCK} WHERE height >= (SELECT max(height) - 5 FROM {BLOCK})")
def plan_reorg(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = chain.newest(blocks(spark, sf_dir).select("height", "hash"))
    tip = b.agg(F.max("height").alias("tip"))
    branch = b.join(F.broadcast(tip)).select("height", F.when(F.col("height") >= F.col("tip") - 5, hashed("height", "fork")).otherwise(F.col("hash")).alias("hash"))
    return chain.plan_reorg(b, branch, floor=0)


@registered(f"SELECT l_orderkey, log_index FROM {LOG} WHERE NOT (block_number >= 10000 AND block_number % 2 = 0)")
def delete_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = blocks(spark, sf_dir).where("height % 2 = 0").agg(F.lit(10000).cast("bigint").alias("height"), F.lit("0x").alias("new_head_hash"), F.to_json(F.collect_list("hash")).alias("orphaned_hashes"))  # hashes of a window of blocks
    return chain.apply_reorgs(logs(spark, sf_dir), gone).select("l_orderkey", "log_index")


@registered(f"SELECT l_orderkey, log_index FROM {LOG} WHERE block_number <= 10000")
def rewind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.rewound(logs(spark, sf_dir), 10000).select("l_orderkey", "log_index")


@registered(f"SELECT min(height) AS floor, count(DISTINCT o) AS orphans FROM (SELECT height, unnest([hash, parent_hash]) AS o FROM {BLOCK} WHERE height % 10 = 0)")
def orphan_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans over all buffered reorgs, and the lowest height they start from."""
    each = _reorgs(spark, sf_dir).select("height", F.explode(F.from_json("orphaned_hashes", "array<string>")).alias("o"))
    return each.agg(F.min("height").alias("floor"), F.countDistinct("o").alias("orphans"))


@registered(f"SELECT hash FROM {BLOCK} b WHERE height % 10 = 0 OR EXISTS (SELECT 1 FROM {BLOCK} n WHERE n.height % 10 = 0 AND n.height = b.height + 1)")
def committed_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _reorgs(spark, sf_dir).select(F.explode(F.from_json("orphaned_hashes", "array<string>")).alias("hash"))
    return blocks(spark, sf_dir).select("hash").intersect(named)


@registered("SELECT c_custkey AS address FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey <> 3 UNION SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey <> 3")
def resume_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of all stores without those that held blocks will find again."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address"), F.col("c_nationkey").alias("block"))
    both = c.where("address % 2 = 0").unionByName(c.where("address % 3 = 0")).distinct()
    return both.join(c.where("block = 3").select("block").distinct(), "block", "left_anti").select("address")


# Words and scalars

_PACKED = "(l_partkey * 65536 + (l_linenumber - 4 + 65536) % 65536)"


@registered("SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey AS high, (l_linenumber - 4)::BIGINT AS low, (-l_orderkey)::VARCHAR AS wide, (l_orderkey::HUGEINT * 18446744073709551616 + l_partkey)::VARCHAR AS big, '0x' || lower(to_hex(l_partkey)) AS quantity FROM lineitem")
def unpack_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of packed words, signed and unsigned, up to 256 bits."""
    packed = F.col("l_partkey") * 65536 + (F.col("l_linenumber") - 4 + 65536) % 65536
    w = encode(packed)
    big = F.concat(F.lpad(F.lower(F.hex("l_orderkey")), 48, "0"), F.lpad(F.lower(F.hex("l_partkey")), 16, "0"))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), W.small(W.field(w, 16, 48)).alias("high"), W.signed_small(W.field(w, 0, 16), 16).alias("low"),
        W.signed_text(encode(-F.col("l_orderkey"))).alias("wide"), W.decimal_text(big).alias("big"), W.to_quantity(F.col("l_partkey")).alias("quantity"),
    )


@registered("SELECT l_orderkey, l_partkey::VARCHAR AS from_hex, l_partkey::VARCHAR AS from_decimal, NULL::VARCHAR AS bad, '0x' || lower(to_hex(l_partkey)) AS unpadded, l_orderkey * 86400 AS seconds FROM lineitem")
def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities with leading zeros or as numbers; text that is none is null; seconds to time and back."""
    hexed = F.concat(F.lit("0x000"), F.lower(F.hex("l_partkey")))
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", W.quantity(hexed).alias("from_hex"), W.quantity(F.col("l_partkey").cast("string")).alias("from_decimal"), W.quantity(F.lit("0x")).alias("bad"), wire.padded_quantity(hexed).alias("unpadded"),
        F.unix_seconds(F.timestamp_seconds(F.col("l_orderkey") * 86400)).alias("seconds"),
    )


@registered("SELECT s_suppkey, substr('0x' || sha256('s' || s_suppkey), 1, 42) AS clean, NULL::VARCHAR AS dirty FROM supplier")
def address_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.substring(address("s_suppkey", "s"), 3, 40)
    return read(spark, sf_dir, "supplier").select("s_suppkey", W.address_slot(F.concat(F.lit("0" * 24), a)).alias("clean"), W.address_slot(F.concat(F.lit("1" + "0" * 23), a)).alias("dirty"))


@registered(
    "SELECT * FROM (VALUES ('sqrtPriceX96', 'sqrt_price_x96'), ('tokenID', 'token_id'), ('URLValue', 'url_value'), ('_owner', 'owner'), ('a.b', 'a_b')) t(name, snake)"
)
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["sqrtPriceX96", "tokenID", "URLValue", "_owner", "a.b"]
    return spark.createDataFrame([(n, fit_identifier(snake_case(n))) for n in names], "name string, snake string")


@registered("SELECT 'Transfer(address,address,uint256)' AS signature, '0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef' AS topic0, 3::BIGINT AS topics, 1::BIGINT AS definitions")
def abi_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal definitions are one; the selector is a Keccak hash."""
    e = parse_signature("Transfer(address indexed from, address indexed to, uint256 value)")
    merged = merge([e, parse_signature("Transfer(address indexed from, address indexed to, uint value)")])
    return spark.createDataFrame([(e.signature, e.topic0, e.topics, len(merged))], "signature string, topic0 string, topics bigint, definitions bigint")


@registered("SELECT p_partkey, ((p_partkey % 134217728) << (p_size % 32)::INTEGER)::BIGINT AS price, (CASE WHEN p_size < 10 THEN p_size ELSE 12 + 2 * (p_size - 10) END)::BIGINT AS spread FROM part")
def pseudo_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = F.lpad(F.lower(F.hex(F.shiftleft((F.col("p_size") % 32).cast("bigint"), 27) + F.col("p_partkey") % (1 << 27))), 8, "0")
    return read(spark, sf_dir, "part").select("p_partkey", W.pseudo_float(packed).alias("price"), W.spread(F.col("p_size")).cast("bigint").alias("spread"))


@registered("SELECT e.event_id, (props::JSON->>'k')::BIGINT AS k FROM events e")
def exact_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed value out of a document."""
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@registered("SELECT o_orderkey, 2::BIGINT AS n, '0x' || sha256('b' || o_orderkey) AS last FROM orders")
def joined_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat(hashed("o_orderkey", "a"), F.substring(hashed("o_orderkey", "b"), 3, 64))
    return read(spark, sf_dir, "orders").select("o_orderkey", wire.hashes(both).alias("h")).select("o_orderkey", F.size("h").cast("bigint").alias("n"), F.element_at("h", -1).alias("last"))


@registered("SELECT o_orderkey, json_array(json_object('index', '0x' || lower(to_hex(o_orderkey)), 'validatorIndex', '0x' || lower(to_hex(o_custkey)), 'address', substr('0x' || sha256('c' || o_custkey), 1, 42), 'amount', '0x1'))::VARCHAR AS withdrawals FROM orders")
def binary_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-prefixed binary lists as JSON documents."""

    def text(c):
        n = F.lpad(F.hex(F.length(c)), 2, "0")
        return F.concat(F.lit("01"), n, F.lit("00" * 7), F.hex(F.encode(c, "utf-8")))

    body = F.concat(F.lit("01" + "00" * 7), text(W.to_quantity(F.col("o_orderkey"))), text(W.to_quantity(F.col("o_custkey"))), text(address("o_custkey", "c")), text(F.lit("0x01")))
    return read(spark, sf_dir, "orders").select("o_orderkey", wire.list_json(F.unhex(body), "withdrawals").alias("withdrawals"))


# Derivations

_SIGN = "CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END"


def _half(value):
    return F.substring(encode(value), 33, 32)


@registered(
    f"""SELECT l_orderkey, l_linenumber::BIGINT AS line, (l_partkey * {_SIGN})::VARCHAR AS amount0_raw, (-l_partkey * {_SIGN})::VARCHAR AS amount1_raw, l_returnflag <> 'R' AND l_partkey > 0 AS zero_for_one, l_linestatus = 'O' AS exact_input,
(l_linenumber - 4)::BIGINT AS bin_idx_after, l_orderkey::VARCHAR AS pos_in_bin_after, l_suppkey::VARCHAR AS spread_fee, (l_suppkey + 1)::VARCHAR AS notional_fee FROM lineitem"""
)
def derive_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    amount = F.col("l_partkey") * sign
    flag = F.when(F.col("l_linestatus") == "O", "1").otherwise("0")
    details = F.concat(F.lit("0" * 33), flag, F.lpad(F.lower(F.hex((F.col("l_linenumber") - 4 + 65536) % 65536)), 4, "0"), F.lpad(F.lower(F.hex("l_orderkey")), 26, "0"))
    rows = read(spark, sf_dir, "lineitem").withColumn("line", F.col("l_linenumber").cast("bigint"))
    rows = rows.select("l_orderkey", "line", details.alias("details_word"), F.concat(_half(amount), _half(-amount)).alias("deltas_word"), F.concat(_half(F.col("l_suppkey")), _half(F.col("l_suppkey") + 1)).alias("fees_word"))
    out = derive.swaps(rows, ["l_orderkey", "line"])
    return out.drop("row").withColumnRenamed("platform_spread_fee_scaled", "spread_fee").withColumnRenamed("platform_notional_fee_scaled", "notional_fee")


@registered("SELECT l_orderkey, l_linenumber::BIGINT AS line, (l_linenumber - 4)::BIGINT AS bin_idx, l_partkey::VARCHAR AS delta0_scaled, (-l_suppkey)::VARCHAR AS delta1_scaled, l_suppkey::VARCHAR AS lp_fee_scaled, l_partkey::VARCHAR AS platform_fee_scaled FROM lineitem WHERE l_linenumber <> 7")
def derive_bin_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber").cast("bigint")
    bin_ = encode(F.when(line == 7, F.lit(1 << 20).cast("bigint")).otherwise(line - 4))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("line"), bin_.alias("bin_word"), F.concat(_half(F.col("l_partkey")), _half(-F.col("l_suppkey"))).alias("deltas_word"), F.concat(_half(F.col("l_suppkey")), _half(F.col("l_partkey"))).alias("fees_word"))
    return derive.bin_fills(rows, ["l_orderkey", "line"]).drop("row")


@registered(
    """SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey::VARCHAR, l_suppkey::VARCHAR) - 1)::BIGINT AS row, CASE WHEN l_orderkey % 2 = 0 THEN 'remove' ELSE 'add' END AS direction, l_linenumber::BIGINT AS bin_idx,
l_partkey::VARCHAR AS delta0_scaled, l_suppkey::VARCHAR AS delta1_scaled, (CASE WHEN l_orderkey % 2 = 0 THEN -l_partkey ELSE l_partkey END)::VARCHAR AS shares FROM lineitem WHERE l_orderkey % 5 <> 0"""
)
def derive_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each bin; arrays that differ in length give none."""
    each = F.struct(F.col("l_linenumber").cast("bigint").alias("bin"), F.struct(F.col("l_partkey").cast("string").alias("delta0"), F.col("l_suppkey").cast("string").alias("delta1")).alias("delta"), F.col("l_partkey").cast("string").alias("share"))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(each)).alias("a"))  # an order has seven lines at most
    short = F.col("l_orderkey") % 5 == 0
    shares = F.transform("a", lambda x: x["share"])
    rows = rows.select("l_orderkey", (F.col("l_orderkey") % 2 == 0).alias("removed"), F.transform("a", lambda x: x["bin"]).alias("bins"), F.transform("a", lambda x: x["delta"]).alias("deltas"), F.when(short, F.concat(shares, F.array(F.lit("1")))).otherwise(shares).alias("shares"))
    return derive.liquidity(rows, ["l_orderkey"]).withColumn("row", F.col("row").cast("bigint"))


@registered(
    """WITH b AS (SELECT p_partkey, unnest([{'i': 0, 'l': p_size, 's': 1}, {'i': 1, 'l': p_size + 1, 's': 1}, {'i': -1, 'l': p_size + 2, 's': -1}, {'i': -2, 'l': p_size + 3, 's': -1}]) AS x FROM part)
SELECT p_partkey, x.i::BIGINT AS bin_idx, x.l::BIGINT AS length_e6, 7::BIGINT AS add_fee_buy_e6, 9::BIGINT AS add_fee_sell_e6,
(CASE x.i WHEN 0 THEN -50 WHEN 1 THEN -50 + x.l - 1 WHEN -1 THEN -50 - x.l ELSE -50 - (2 * x.l - 1) END)::BIGINT AS lower_e6, (CASE x.i WHEN 0 THEN -50 + x.l WHEN 1 THEN -50 + 2 * x.l - 1 WHEN -1 THEN -50 ELSE -50 - (x.l - 1) END)::BIGINT AS upper_e6, (x.i + 2)::BIGINT AS row FROM b"""
)
def ladder_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of a ladder with edges that run outward from bin 0, up to the first empty bin of a side."""

    def item(length):
        return F.concat(F.lit("00090007"), F.lpad(F.lower(F.hex(length)), 4, "0"))

    s = F.col("p_size").cast("bigint")
    empty = "000900070000"
    above = F.concat(F.lit("0" * 4), item(s), F.lit(empty), item(s + 1), item(s))  # five bins from the low end: size, size + 1, empty ...
    above = F.concat(F.lit("0" * 4), item(s), item(s), F.lit(empty), item(s + 1), item(s))
    below = F.concat(F.lit("0" * 4), item(s), item(s), F.lit(empty), item(s + 3), item(s + 2))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.lit(-50).cast("bigint").alias("bin0_lower"), F.array(above, above).alias("above"), F.array(below).alias("below"))
    return derive.pool_bins(rows, ["p_partkey"]).withColumn("row", F.col("row").cast("bigint"))


def _push(price, spread0, spread1, ms, slot):
    """A slot word whose feed 1 has a price."""
    feed = F.concat(F.lpad(F.lower(F.hex(price)), 8, "0"), F.lpad(F.lower(F.hex(spread0)), 2, "0"), F.lpad(F.lower(F.hex(spread1)), 2, "0"))
    return F.concat(F.lit("0" * 12), feed, F.lit("0" * 24), F.lpad(F.lower(F.hex(ms)), 14, "0"), F.lpad(F.lower(F.hex(slot)), 2, "0"))


@registered(
    """SELECT p_partkey, (p_partkey + 1)::BIGINT AS price_e8, (CASE WHEN p_size < 10 THEN p_size ELSE 12 + 2 * (p_size - 10) END)::BIGINT AS spread0, 1::BIGINT AS spread1, (1700000000000 + p_partkey)::BIGINT AS feed_timestamp_ms FROM part WHERE p_partkey % 4 <> 0"""
)
def compressed_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest pushed word of the feed's slot; a zero price gives no row."""
    p = read(spark, sf_dir, "part")
    k, size, one = F.col("p_partkey"), F.col("p_size").cast("bigint"), F.lit(1).cast("bigint")
    slot = F.lit(5).cast("bigint")
    new = _push(F.when(k % 4 == 0, 0).otherwise(k + 1), F.when(k % 4 == 0, 0).otherwise(size), one, 1_700_000_000_000 + k, slot)
    old, other = _push(k, size, one, F.lit(1_600_000_000_000).cast("bigint"), slot), _push(k, size, one, F.lit(1_800_000_000_000).cast("bigint"), F.lit(6).cast("bigint"))
    rows = p.select("p_partkey", F.concat(F.lit("0x"), F.lit("ab" * 30), F.lit("0501")).alias("feed_id"), F.concat(F.lit("0x00"), new, old, other).alias("transaction_input"))
    return derive.compressed_prices(rows, ["p_partkey"]).drop("row", "feed_id")


@registered(
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 100000 ELSE p_partkey + 5 END::VARCHAR AS price_e8, CASE WHEN p_partkey % 2 = 0 THEN least(65534, ceil(1000000.0 * p_size / p_partkey))::BIGINT ELSE 0 END AS spread0,
(CASE WHEN p_partkey % 2 = 0 THEN 1700000000000 + p_partkey ELSE (1700000000 + p_partkey) * 1000 END)::BIGINT AS feed_timestamp_ms FROM part WHERE p_partkey % 6 <> 0"""
)
def oracle_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices from signed updates and from reports that lie somewhere in calldata; cut ones give no row."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    fixed = lambda v, n: F.substring(F.lpad(F.lower(F.hex(v)), 16, "0"), 17 - n, n)
    feed = F.concat(F.lit("00000002" + "04" + "00"), fixed(k, 16), F.lit("04" + "fffd" + "05"), fixed(size, 16), F.lit("0c01"), fixed((1_700_000_000_000 + k) * 1000 + 7, 16))
    payload = F.concat(F.lit("93c7d375" + "00" * 8 + "01" + "01"), feed)
    update = F.concat(F.lit("2a22999a" + "11" * 65), fixed((F.length(payload) / 2).cast("bigint"), 4), F.when(k % 6 == 0, F.substr(payload, F.lit(1), F.length(payload) - 2)).otherwise(payload))
    stream = "0004" + "cd" * 30
    report = F.concat(F.lit(stream), encode(F.lit(1).cast("bigint")), encode(1_700_000_000 + k), encode(F.lit(1).cast("bigint")), encode(F.lit(1).cast("bigint")), encode(F.lit(9).cast("bigint")), encode((k + 5) * 10_000_000_000 + 3), encode(F.lit(2).cast("bigint")))
    signed = k % 2 == 0
    rows = read(spark, sf_dir, "part").select("p_partkey", F.when(signed, "0x" + "0" * 63 + "2").otherwise("0x" + stream).alias("feed_id"), F.concat(F.lit("0xdeadbeef00"), F.when(signed, update).otherwise(report)).alias("transaction_input"))
    return derive.oracle_prices(rows, ["p_partkey"]).select("p_partkey", F.col("price_e8").cast("string").alias("price_e8"), "spread0", "feed_timestamp_ms")


# Derivations from encoded logs to the rows of their tables

_METRIC_TOML = """
protocol = "metric_v1"
[[contract]]
name = "MetricOmmPool"
events = [
  "Swap(address indexed sender, address indexed recipient, uint256 details, uint256 amountDeltas, uint256 platformFees)",
  "BinSwapped(int256 binIdx, uint256 binDeltas, uint256 fees)",
  "LiquidityAdded(address indexed provider, uint80 salt, int256[] binIdxs, (int256,int256)[] binBalanceDeltas, uint256[] shares)",
  "LiquidityRemoved(address indexed provider, uint80 salt, int256[] binIdxs, (int256,int256)[] binBalanceDeltas, uint256[] shares)",
]
[[contract]]
name = "MetricOmmPoolFactory"
events = ["PoolCreated(address indexed poolAddress, address a1, address a2, uint256 a3, address a4, address a5, address a6, address[] a7, (uint256,uint256,uint256,uint256,uint256,uint256) a8, uint256 a9, uint256 a10, uint256 a11, uint256 a12, uint24 a13, uint24 a14, uint24 a15, uint24 a16, address a17, int24 curBinDistFromProvidedPriceE6, uint256[] nonNegativeBinDataArray, uint256[] negativeBinDataArray)"]
[[contract]]
name = "CompressedOracle"
events = ["FeedUpdated(bytes32 indexed feedId)"]
"""


def metric() -> manifest.Catalog:
    return manifest.build(manifest.parse(_METRIC_TOML, "base"))


def _derived(spark: SparkSession, sf_dir: str, table: str, encoded: DataFrame, sent: DataFrame | None = None) -> DataFrame:
    """A derivation's rows of encoded logs (``topic1``, ``topic2``, ``data``, ``entry`` and ``event`` beside their place)."""
    catalog = metric()
    events = catalog.events(spark).select(F.col("entry").alias("e"), F.col("name"), "topic0", "signature")
    matched = encoded.join(F.broadcast(events), (F.col("entry") == F.col("e")) & (F.col("event") == F.col("name"))).withColumn("topic3", F.lit(None).cast("string"))
    return derive.derivations(catalog)[table](relate.with_sender(matched, transactions(spark, sf_dir) if sent is None else sent))


_SENT = f"""(SELECT l.*, t.from_address AS transaction_from_address, t.to_address AS transaction_to_address FROM {LOG} l JOIN {TX} t ON l.l_orderkey = t.o_orderkey)"""


@registered(
    f"""SELECT transaction_hash, log_index, transaction_from_address, transaction_to_address, '0x' || substr(sha256('a' || l_suppkey), 1, 40) AS sender, '0x' || substr(sha256('b' || l_partkey), 1, 40) AS recipient,
(l_partkey * {_SIGN})::VARCHAR AS amount0_raw, (-l_partkey * {_SIGN})::VARCHAR AS amount1_raw, l_returnflag <> 'R' AND l_partkey > 0 AS zero_for_one, l_linestatus = 'O' AS exact_input, (l_linenumber - 4)::BIGINT AS bin_idx_after, l_orderkey::VARCHAR AS pos_in_bin_after,
l_suppkey::VARCHAR AS platform_spread_fee_scaled, (l_suppkey + 1)::VARCHAR AS platform_notional_fee_scaled, block_hash || ':' || transaction_hash || ':' || log_index || ':metric_v1_swaps:0' AS dedupe_key FROM {_SENT} WHERE l_orderkey % 9 <> 0"""
)
def derived_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swap logs to rows with sender and recipient; a log whose data is short gives none."""
    li = logs(spark, sf_dir)
    amount = F.col("l_partkey") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    flag = F.when(F.col("l_linestatus") == "O", "1").otherwise("0")
    details = F.concat(F.lit("0" * 33), flag, F.lpad(F.lower(F.hex((F.col("l_linenumber") - 4 + 65536) % 65536)), 4, "0"), F.lpad(F.lower(F.hex("l_orderkey")), 26, "0"))
    data = F.concat(F.lit("0x"), details, _half(amount), _half(-amount), _half(F.col("l_suppkey")), _half(F.col("l_suppkey") + 1))
    who = lambda value, tag: F.concat(F.lit("0x" + "0" * 24), F.substring(hashed(value, tag), 3, 40))
    rows = li.withColumns({"topic1": who("l_suppkey", "a"), "topic2": who("l_partkey", "b"), "data": F.when(F.col("l_orderkey") % 9 == 0, F.substring(data, 1, 130)).otherwise(data), "entry": F.lit("metric_v1/MetricOmmPool"), "event": F.lit("Swap")})
    out = _derived(spark, sf_dir, "metric_v1_swaps", rows)
    return out.drop("row", "address", "block_number", "block_hash")


@registered(f"SELECT transaction_hash, log_index, (l_linenumber - 4)::BIGINT AS bin_idx, l_partkey::VARCHAR AS delta0_scaled, (-l_suppkey)::VARCHAR AS delta1_scaled, l_suppkey::VARCHAR AS lp_fee_scaled, l_partkey::VARCHAR AS platform_fee_scaled FROM {_SENT} WHERE l_linenumber <> 7")
def derived_bin_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bin beyond 16 bits gives no row."""
    line = F.col("l_linenumber").cast("bigint")
    bin_ = encode(F.when(line == 7, F.lit(1 << 20).cast("bigint")).otherwise(line - 4))
    data = F.concat(F.lit("0x"), bin_, _half(F.col("l_partkey")), _half(-F.col("l_suppkey")), _half(F.col("l_suppkey")), _half(F.col("l_partkey")))
    none = F.lit(None).cast("string")
    rows = logs(spark, sf_dir).withColumns({"topic1": none, "topic2": none, "data": data, "entry": F.lit("metric_v1/MetricOmmPool"), "event": F.lit("BinSwapped")})
    return _derived(spark, sf_dir, "metric_v1_bin_fills", rows).select("transaction_hash", "log_index", "bin_idx", "delta0_scaled", "delta1_scaled", "lp_fee_scaled", "platform_fee_scaled")


@registered(
    f"""SELECT t.hash AS transaction_hash, t.from_address AS transaction_from_address, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::BIGINT AS row, CASE WHEN l_orderkey % 2 = 0 THEN 'remove' ELSE 'add' END AS direction,
'0x' || substr(sha256('o' || l_orderkey), 1, 40) AS owner, l_orderkey::VARCHAR AS salt, (l_linenumber - 4)::BIGINT AS bin_idx, l_partkey::VARCHAR AS delta0_scaled, (-l_suppkey)::VARCHAR AS delta1_scaled, (CASE WHEN l_orderkey % 2 = 0 THEN -l_partkey ELSE l_partkey END)::VARCHAR AS shares
FROM lineitem JOIN {TX} t ON l_orderkey = t.o_orderkey WHERE l_orderkey % 5 <> 0 AND l_orderkey % 7 <> 1"""
)
def derived_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each bin; arrays that differ in length, and shares beyond a signed word, leave the record without rows."""
    each = F.struct("l_linenumber", F.col("l_partkey").cast("bigint").alias("p"), F.col("l_suppkey").cast("bigint").alias("s"))
    o = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(each)).alias("a"))  # an order has seven lines at most
    n = F.size("a").cast("bigint")
    short, wide = F.col("l_orderkey") % 5 == 0, F.col("l_orderkey") % 7 == 1
    text = lambda f: F.concat_ws("", F.transform("a", f))
    bins = F.concat(encode(n), text(lambda x: encode((x["l_linenumber"] - 4).cast("bigint"))))
    deltas = F.concat(encode(n), text(lambda x: F.concat(encode(x["p"]), encode(-x["s"]))))
    shares = F.concat(encode(n + F.when(short, 1).otherwise(0)), text(lambda x: F.when(wide, F.lit("f" * 64)).otherwise(encode(x["p"]))), F.when(short, encode(n)).otherwise(""))
    heads = F.concat(encode(F.col("l_orderkey").cast("bigint")), encode(F.lit(128).cast("bigint")), encode(160 + 32 * n), encode(192 + 96 * n))
    owner = F.concat(F.lit("0x" + "0" * 24), F.substring(hashed("l_orderkey", "o"), 3, 40))
    t = transactions(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), "block_hash", F.col("hash").alias("transaction_hash"))
    rows = o.join(t, "l_orderkey").select("block_hash", "transaction_hash", F.lit(0).alias("log_index"), owner.alias("topic1"), F.lit(None).cast("string").alias("topic2"), F.concat(F.lit("0x"), heads, bins, deltas, shares).alias("data"))
    rows = rows.withColumns({"entry": F.lit("metric_v1/MetricOmmPool"), "event": F.when(F.substring("data", 66, 1).isin(*"02468ace"), "LiquidityRemoved").otherwise("LiquidityAdded")})
    out = _derived(spark, sf_dir, "metric_v1_liquidity", rows)
    return out.select("transaction_hash", "transaction_from_address", F.col("row").cast("bigint").alias("row"), "direction", "owner", "salt", "bin_idx", "delta0_scaled", "delta1_scaled", "shares")


def _part_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit("0xb").alias("block_hash"), hashed("p_partkey", "x").alias("transaction_hash"), F.lit(0).alias("log_index"), F.lit(None).cast("string").alias("topic2"))


def _part_sent(rows: DataFrame, data: str | None = None) -> DataFrame:
    return rows.select("block_hash", F.col("transaction_hash").alias("hash"), F.lit("0xf").alias("from_address"), F.lit(None).cast("string").alias("to_address"), (F.col(data) if data else F.lit("0x")).alias("input"))


@registered(
    """WITH b AS (SELECT p_partkey, unnest([{'i': 0, 'l': p_size, 's': 1}, {'i': 1, 'l': p_size + 1, 's': 1}, {'i': -1, 'l': p_size + 2, 's': -1}]) AS x FROM part)
SELECT '0x' || sha256('x' || p_partkey) AS transaction_hash, '0x' || substr(sha256('p' || p_partkey), 1, 40) AS pool, x.i::BIGINT AS bin_idx, x.l::BIGINT AS length_e6, 7::BIGINT AS add_fee_buy_e6, 9::BIGINT AS add_fee_sell_e6,
(CASE x.i WHEN 0 THEN -50 WHEN 1 THEN -50 + x.l - 1 ELSE -50 - x.l END)::BIGINT AS lower_e6, (CASE x.i WHEN 0 THEN -50 + x.l WHEN 1 THEN -50 + 2 * x.l - 1 ELSE -50 END)::BIGINT AS upper_e6, (x.i + 1)::BIGINT AS row FROM b"""
)
def derived_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A creation of 21 arguments, one of them a tuple, to the bins of the pool's ladder."""
    p = _part_logs(spark, sf_dir)
    size = F.col("p_size").cast("bigint")
    item = lambda length: F.concat(F.lit("00090007"), F.lpad(F.lower(F.hex(length)), 4, "0"))
    above = F.concat(F.lit("0" * 4 + "000000000000" * 3), item(size + 1), item(size))
    below = F.concat(F.lit("0" * 4 + "000000000000" * 4), item(size + 2))
    zero, one = "0" * 64, F.lit(1).cast("bigint")
    words = 25  # 20 arguments in the data, of which one takes six words
    place = lambda k: encode(F.lit(32 * (words + k)).cast("bigint"))
    head = F.concat(F.lit(zero * 6), place(0), F.lit(zero * (6 + 4 + 4 + 1)), encode(F.lit(-50).cast("bigint")), place(1), place(3))
    data = F.concat(F.lit("0x"), head, F.lit(zero), encode(one), above, encode(one), below)
    topic = F.concat(F.lit("0x" + "0" * 24), F.substring(hashed("p_partkey", "p"), 3, 40))
    rows = p.withColumns({"topic1": topic, "data": data, "entry": F.lit("metric_v1/MetricOmmPoolFactory"), "event": F.lit("PoolCreated")})
    out = _derived(spark, sf_dir, "metric_v1_pool_bins", rows, _part_sent(rows))
    return out.select("transaction_hash", "pool", "bin_idx", "length_e6", "add_fee_buy_e6", "add_fee_sell_e6", "lower_e6", "upper_e6", F.col("row").cast("bigint").alias("row"))


@registered(
    """SELECT '0x' || sha256('x' || p_partkey) AS transaction_hash, '0x' || repeat('ab', 30) || '0501' AS feed_id, (p_partkey + 1)::BIGINT AS price_e8, (CASE WHEN p_size < 10 THEN p_size ELSE 12 + 2 * (p_size - 10) END)::BIGINT AS spread0, (1700000000000 + p_partkey)::BIGINT AS feed_timestamp_ms
FROM part WHERE p_partkey % 4 <> 0"""
)
def derived_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price that the calldata of an update's transaction pushed; a zero price gives no row."""
    k, size, one = F.col("p_partkey"), F.col("p_size").cast("bigint"), F.lit(1).cast("bigint")
    word = _push(F.when(k % 4 == 0, 0).otherwise(k + 1), size, one, 1_700_000_000_000 + k, F.lit(5).cast("bigint"))
    rows = _part_logs(spark, sf_dir).withColumns({"topic1": F.lit("0x" + "ab" * 30 + "0501"), "data": F.lit("0x"), "calldata": F.concat(F.lit("0x00"), word), "entry": F.lit("metric_v1/CompressedOracle"), "event": F.lit("FeedUpdated")})
    out = _derived(spark, sf_dir, "metric_v1_compressed_oracle_prices", rows, _part_sent(rows, "calldata"))
    return out.select("transaction_hash", "feed_id", F.col("price_e8").cast("bigint").alias("price_e8"), F.col("spread0").cast("bigint").alias("spread0"), "feed_timestamp_ms")


# Plans


@registered("SELECT * FROM (VALUES ('read', 0, 40), ('read', 41, 60), ('commit', 0, 1), ('commit', 2, 2), ('commit', 3, 4)) t(plan, low, high)")
def driver_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges for reading files and for commits."""
    reads = fetch.read_ranges([(0, 20, 60), (15, 40, 60), (41, 70, 30)], 0, 60, 100)
    commits = fetch.commit_parts([(0, 10), (1, 10), (2, 40), (3, 15), (4, 2)], 100, 40)
    return spark.createDataFrame([("read", *r) for r in reads] + [("commit", *r) for r in commits], "plan string, low int, high int")


@registered("SELECT * FROM (VALUES ('datasets', 'logs,transactions'), ('receipts', 'true'), ('logs_only', 'false')) t(what, answer)")
def needed_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is fetched follows from the tables that are stored."""
    tables = DATASETS | dex().tables()
    names = route.needed({"a": {"dex_pool_swap"}, "b": {"transactions", "decoded_logs"}}, tables)
    plan = route.fetch_plan(names)
    return spark.createDataFrame([("datasets", ",".join(sorted(names))), ("receipts", json.dumps(plan["receipts"])), ("logs_only", json.dumps(plan["logs_only"]))], "what string, answer string")


# Additions of ours: what Spark offers beside the reference's operators


@registered("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@registered("SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded swaps by pool, exact sums of their amounts included."""
    swaps = decode_swaps(spark, sf_dir)
    return swaps.groupBy("address").agg(F.count(F.lit(1)).alias("swaps"), W.exact_sum(F.col("amount0")).alias("amount0"))
