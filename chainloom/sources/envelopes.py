"""Scans of stored data: NDJSON envelopes, lake tables and SQL tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.functions.words import quantity
from chainloom.schema import DATASETS, PUSHED_VALUES, TableDef, within

TYPES = {"block": "blocks", "transaction": "transactions", "log": "logs", "decoded": "decoded_logs", "contract": "contracts", "handoff": "handoffs", "reorg": "reorgs", "accepted_block": "accepted_blocks"}


def envelopes(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """NDJSON lines with their chain and type; unknown fields stay in ``value`` and are ignored."""
    reader = spark.readStream if stream else spark.read
    lines = reader.text(path)
    return lines.select("value", F.get_json_object("value", "$.chain").alias("chain"), F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.schema_version").cast("int").alias("schema_version"))


def records(lines: DataFrame, kind: str) -> DataFrame:
    """The rows of one type, with the columns of its dataset table."""
    table = DATASETS[TYPES[kind]]
    text = T.StructType([T.StructField({"from_address": "from", "to_address": "to"}.get(c, c), T.StringType()) for c, _, _ in table.columns])
    parsed = lines.where(F.col("type") == kind).withColumn("r", F.from_json("value", text))
    columns = []
    for (c, k, _), f in zip(table.columns, text.fields, strict=True):
        v = F.col(f"r.{f.name}")
        if k in ("uint", "bigint"):
            v = quantity(v).cast("decimal(20,0)") if k == "uint" else quantity(v)
        elif k == "timestamp":
            v = F.timestamp_seconds(quantity(v).cast("bigint"))
        elif k == "bool":
            v = v.cast("boolean")
        columns.append(v.alias(c))
    return parsed.select("chain", *columns)


def lake_logs(logs: DataFrame, low: int, high: int, addresses: list[str] | DataFrame | None, width: int) -> DataFrame:
    """Stored logs of a height range, of some addresses, in chain order.

    Both height terms reach the scan. Few addresses are pushed as a list; more, or a frame of them, are joined.
    """
    rows = logs.where(within("block_number", low, high, width))
    if isinstance(addresses, list) and len(addresses) <= PUSHED_VALUES:
        rows = rows.where(F.col("address").isin(addresses))
    elif addresses is not None:
        side = rows.sparkSession.createDataFrame([(a,) for a in addresses], "address string") if isinstance(addresses, list) else addresses.select("address").distinct()
        rows = rows.join(side, "address", "left_semi")
    return rows.orderBy("block_number", "log_index")


def table_rows(df: DataFrame, chain: str, columns: list[str], order: list[tuple[str, bool]] = (), limit: int | None = None) -> DataFrame:
    """A store read: some columns of one chain's rows, ordered (column, ascending) and limited."""
    rows = df.where(F.col("chain") == chain).select(*columns)
    if order:
        rows = rows.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order])
    return rows if limit is None else rows.limit(limit)


def jdbc_table(spark: SparkSession, url: str, table: TableDef, **options: str) -> DataFrame:
    """A table of a database that has a JDBC driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table.name, **options).load()
