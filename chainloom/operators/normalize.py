"""Raw blocks, transactions, receipts and logs into dataset rows, and the checks on a source's answer.

Checks return the rows that fail, with the reason in ``problem``; an empty frame is a pass. Nothing is
repaired or dropped: a source that answers inconsistently is asked again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.words import quantity
from chainloom.schema import DATASETS, kind_type, log_key, transaction_key

#: Wire names that a rule (camel case of the column) does not give.
WIRE_NAMES = {
    "ommers_hash": "sha3Uncles", "ommers": "uncles", "transaction_hashes": "transactions", "transaction_type": "type", "from_address": "from", "to_address": "to",
    "receipt_status": "status", "receipt_gas_used": "gasUsed", "receipt_cumulative_gas_used": "cumulativeGasUsed", "receipt_effective_gas_price": "effectiveGasPrice",
    "receipt_contract_address": "contractAddress", "receipt_logs_bloom": "logsBloom", "receipt_blob_gas_used": "blobGasUsed", "receipt_blob_gas_price": "blobGasPrice",
    "receipt_gas_used_for_l1": "gasUsedForL1", "receipt_l1_block_number": "l1BlockNumber",
}


def wire_name(column: str) -> str:
    """The JSON name of a column."""
    if column in WIRE_NAMES:
        return WIRE_NAMES[column]
    head, *rest = column.split("_")
    return head + "".join(w.capitalize() for w in rest)


def typed(value: Column, kind: str) -> Column:
    """A JSON text value as a column of ``kind``; quantities may be hex or decimal."""
    if kind == "uint":
        return quantity(value).cast("decimal(20,0)")
    if kind == "int":
        return quantity(value).cast("bigint")
    if kind == "bigint":
        return quantity(value)
    if kind == "bool":
        return value.isin("0x1", "true", "1")
    if kind == "timestamp":
        return F.timestamp_seconds(quantity(value).cast("bigint"))
    return value.cast(kind_type(kind))


def project(raw: DataFrame, table: str, json: str = "json", skip: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a dataset table read from a JSON text column; absent fields are null."""
    return [typed(F.get_json_object(F.col(json), f"$.{wire_name(c)}"), kind).alias(c) for c, kind, _ in DATASETS[table].columns if c not in skip]


def blocks(raw: DataFrame) -> DataFrame:
    """``blocks`` rows from headers as JSON text in ``json``."""
    hashes = F.get_json_object("json", "$.transactions")
    rows = raw.select(*project(raw, "blocks", skip=("transaction_count",)), F.size(F.from_json(hashes, "array<string>")).cast("decimal(20,0)").alias("transaction_count"))
    return rows.select(*[c for c, _, _ in DATASETS["blocks"].columns])


def signature(kind: Column, parity: Column, chain_id: Column) -> tuple[Column, Column]:
    """(v, y_parity): a legacy v is rebuilt from the parity and the chain id; only typed ones have a parity."""
    legacy = kind == 0
    v = F.when(legacy, F.when(chain_id.isNull(), parity + 27).otherwise(parity + 35 + 2 * chain_id)).otherwise(parity)
    return v, F.when(~legacy, parity)


def fee_caps(kind: Column, max_fee: Column, max_priority: Column) -> tuple[Column, Column]:
    """Fee caps only where the transaction carries them: from type 2 on."""
    return F.when(kind >= 2, max_fee), F.when(kind >= 2, max_priority)


def with_receipts(transactions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Each transaction with its receipt, by block and hash; an index that differs fails the row."""
    r = receipts.select(F.col("block_hash").alias("r_block"), F.col("transaction_hash").alias("r_hash"), F.col("transaction_index").alias("r_index"), *[c for c in receipts.columns if c.startswith("receipt_")])
    joined = transactions.join(r, (F.col("block_hash") == F.col("r_block")) & (F.col("hash") == F.col("r_hash")))
    wrong = F.col("transaction_index") != F.col("r_index")
    return joined.withColumn("problem", F.when(wrong, F.lit("receipt index differs"))).drop("r_block", "r_hash", "r_index")


def logs(raw: DataFrame, topics: str = "topics") -> DataFrame:
    """``logs`` rows: up to four topics become columns, a fifth is dropped."""
    flat = [F.get(F.col(topics), F.lit(i)).alias(f"topic{i}") for i in range(4)]
    return raw.select(*[c for c in raw.columns if c != topics], *flat)


def ordered(parts: dict[str, DataFrame]) -> DataFrame:
    """Records in publish order: a block, each transaction before its logs, loose logs, then the block's acceptance.

    Each frame has ``height``, ``transaction_index`` and ``log_index`` (null where it has none).
    """
    rank = {"block": 0, "transaction": 1, "log": 1, "decoded": 1, "contract": 1, "derived": 1, "accepted_block": 3}
    out = None
    for kind, df in parts.items():
        loose = F.col("transaction_index").isNull() & F.lit(kind == "log")
        row = df.select("height", F.lit(kind).alias("type"), F.when(loose, 2).otherwise(rank[kind]).alias("kind_rank"), F.coalesce("transaction_index", F.lit(-1)).alias("tx_rank"), F.coalesce("log_index", F.lit(-1)).alias("log_rank"), "dedupe_key")
        out = row if out is None else out.unionByName(row)
    return out.orderBy("height", "kind_rank", "tx_rank", "log_rank", "dedupe_key")


def keyed(df: DataFrame, table: str, chain: str) -> DataFrame:
    """With the key pair of ``blocks``, ``transactions`` or ``logs``."""
    key = {
        "blocks": lambda: F.concat(F.col("hash"), F.lit(":block")),
        "transactions": lambda: transaction_key(F.col("block_hash"), F.col("hash")),
        "logs": lambda: log_key(F.col("block_hash"), F.col("transaction_hash"), F.col("log_index")),
    }[table]()
    return df.withColumn("chain", F.lit(chain)).withColumn("dedupe_key", key)


# Checks


def height_check(answers: DataFrame) -> DataFrame:
    """Answers whose height is not the one asked for."""
    return answers.where(~F.col("height").eqNullSafe(F.col("asked"))).withColumn("problem", F.lit("another height"))


def log_order_check(rows: DataFrame, block: str = "block_hash", arrival: str = "arrival", index: str = "log_index") -> DataFrame:
    """Logs whose index does not exceed that of the log before, in order of arrival."""
    before = F.lag(index).over(Window.partitionBy(block).orderBy(arrival))
    return rows.withColumn("before", before).where(F.col(index) <= F.col("before")).withColumn("problem", F.lit("log order"))


def bloom_check(blocks_: DataFrame, logs_: DataFrame) -> DataFrame:
    """Blocks whose bloom filter says that there are logs, but that came without any."""
    some = blocks_.where(~F.coalesce(F.col("logs_bloom").rlike("^0[xX]0*$"), F.lit(True)))
    return some.join(logs_.select(F.col("block_hash").alias("hash")).distinct(), "hash", "left_anti").withColumn("problem", F.lit("bloom without logs"))


def leftover_check(rows: DataFrame, blocks_: DataFrame) -> DataFrame:
    """Rows of blocks that were not asked for."""
    asked = blocks_.select(F.col("number").alias("block_number"), F.col("hash").alias("block_hash")).distinct()
    return rows.join(asked, ["block_number", "block_hash"], "left_anti").withColumn("problem", F.lit("not asked for"))


def gas_check(blocks_: DataFrame, transactions: DataFrame) -> DataFrame:
    """Blocks whose last cumulative gas is not their gas used, or whose transaction indexes have gaps."""
    sums = transactions.groupBy("block_hash").agg(
        F.max_by("receipt_cumulative_gas_used", "transaction_index").alias("last_gas"), F.count(F.lit(1)).alias("n"), F.max("transaction_index").alias("last"), F.countDistinct("transaction_index").alias("d")
    )
    joined = blocks_.join(sums, blocks_["hash"] == sums["block_hash"], "left")
    gaps = (F.col("n") != F.col("last") + 1) | (F.col("d") != F.col("n"))
    problem = F.when(gaps, "transaction index gap").when(F.coalesce(F.col("last_gas"), F.lit(0)) != F.col("gas_used"), "gas differs")
    return joined.withColumn("problem", problem).where("problem is not null").select("hash", "problem")


def receipts_check(blocks_: DataFrame, receipts: DataFrame) -> DataFrame:
    """What is wrong with the receipts of each block: malformed or inconsistent answers."""
    per = receipts.groupBy("asked_hash").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("block_hash").isNull(), 1)).alias("nulls"), F.count(F.when(F.col("block_hash") != F.col("asked_hash"), 1)).alias("foreign")
    )
    joined = blocks_.join(per, blocks_["hash"] == per["asked_hash"], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    problem = (
        F.when(F.col("nulls") > 0, "malformed: null hash")
        .when(F.col("foreign") > 0, "inconsistent: another block's")
        .when((n == 0) & (F.col("transaction_count") > 0), "inconsistent: none")
        .when(n != F.col("transaction_count"), "malformed: count")
    )
    return joined.select("hash", problem.alias("problem")).where("problem is not null")


def to_wire(df: DataFrame, kind: str, chain: str, version: int = 1) -> DataFrame:
    """Rows as one flat JSON text each, nulls written out."""
    own = [F.col(c).alias({"from_address": "from", "to_address": "to"}.get(c, c)) for c in df.columns if c not in ("chain", "dedupe_key")]
    return df.select(F.to_json(F.struct(F.lit(chain).alias("chain"), F.lit(version).alias("schema_version"), F.lit(kind).alias("type"), *own), {"ignoreNullFields": "false"}).alias("value"))
