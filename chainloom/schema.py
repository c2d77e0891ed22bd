"""Column types, table definitions, keys and drift checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainloom.functions.abi import Event, column_type
from chainloom.functions.names import MAX_IDENTIFIER, snake_case, unique

#: Blocks in a partition of a stored table.
WIDTH = 100_000
#: Largest undo window; a partition must be wider.
WINDOW = 4_096

#: Spark types by column kind. Integers beyond 64 bits are decimal text, since decimals end at 38 digits.
KINDS: dict[str, T.DataType] = {
    "uint": T.DecimalType(20, 0),
    "int": T.LongType(),
    "bigint": T.StringType(),
    "text": T.StringType(),
    "bool": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "document": T.StringType(),
}


@dataclass(frozen=True)
class TableDef:
    """A table: columns (name, kind, nullable) and what retraction needs."""

    name: str
    columns: tuple[tuple[str, str, bool], ...]
    block_hash: str | None = "block_hash"
    block_number: str | None = "block_number"
    bookkeeping: bool = False
    kind: str = "dataset"
    indexes: tuple[tuple[str, ...], ...] = ()

    def schema(self) -> T.StructType:
        """With the key pair that all tables end with."""
        fields = [T.StructField(n, kind_type(k), null) for n, k, null in self.columns]
        return T.StructType([*fields, T.StructField("chain", T.StringType(), False), T.StructField("dedupe_key", T.StringType(), False)])


def kind_type(kind: str) -> T.DataType:
    if kind.startswith("list:"):
        return T.ArrayType(KINDS[kind[5:]], True)
    return KINDS[kind]


def _table(name: str, text: str, **more) -> TableDef:
    """Columns are written ``name:kind``, a trailing ? marks nullable ones; the default kind is text."""
    columns = []
    for item in text.split():
        column, _, kind = item.partition(":")
        columns.append((column.rstrip("?"), kind.rstrip("?") or "text", item.endswith("?")))
    return TableDef(name, tuple(columns), **more)


_PLACE = "block_number:uint block_hash block_timestamp:timestamp"
_LOG = "transaction_hash transaction_index:uint log_index:uint"

#: The nine dataset tables, column by column.
DATASETS = {
    t.name: t
    for t in (
        _table(
            "blocks",
            "number:uint hash parent_hash timestamp:timestamp nonce ommers_hash transactions_root state_root receipts_root withdrawals_root? logs_bloom miner difficulty:bigint "
            "total_difficulty:bigint? size:bigint? extra_data gas_limit:uint gas_used:uint transaction_count:uint base_fee_per_gas:uint? blob_gas_used:uint? excess_blob_gas:uint? "
            "parent_beacon_block_root? mix_hash? withdrawals:document? requests_hash? l1_block_number:uint? send_count:uint? send_root? ommers:document transaction_hashes:document",
            block_hash="hash",
            block_number="number",
        ),
        _table(
            "transactions",
            "hash nonce:uint transaction_index:uint from_address to_address? value:bigint gas:uint gas_price:bigint? max_fee_per_gas:bigint? max_priority_fee_per_gas:bigint? "
            "max_fee_per_blob_gas:bigint? input transaction_type:uint chain_id:uint? access_list:document? blob_versioned_hashes:document? authorization_list:document? r? s? v:bigint? y_parity:uint? "
            "receipt_status:bool receipt_gas_used:uint receipt_cumulative_gas_used:uint receipt_effective_gas_price:bigint receipt_contract_address? receipt_logs_bloom receipt_blob_gas_used:uint? "
            "receipt_blob_gas_price:bigint? receipt_gas_used_for_l1:uint? receipt_l1_block_number:uint? log_count:uint block_timestamp:timestamp block_number:uint block_hash",
        ),
        _table("logs", "log_index:uint transaction_hash transaction_index:uint address topic0? topic1? topic2? topic3? data removed:bool block_number:uint block_hash block_timestamp:timestamp"),
        _table("decoded_logs", f"name address protocol contract selector? event_id signature anonymous:bool {_LOG} indexed:document body:document {_PLACE}"),
        _table("contracts", f"protocol name address factory_address {_LOG} {_PLACE}", bookkeeping=True),
        _table("reorgs", "height:uint new_head_hash orphaned_hashes:document", block_hash=None, block_number=None, bookkeeping=True),
        _table("accepted_blocks", "height:uint hash parent_hash timestamp:timestamp", block_hash="hash", block_number="height", bookkeeping=True),
        _table("sessions", "block_number:uint block_hash block_timestamp:timestamp events:document", bookkeeping=True),
        _table("handoffs", f"protocol name address {_PLACE}", bookkeeping=True),
    )
}

_SPARK_KIND = {"boolean": "bool", "decimal(20,0)": "uint", "bigint": "int", "string": "text"}
_LEADING = "address transaction_hash transaction_index:uint log_index:uint"


def event_table(protocol: str, contract: str, e: Event, name: str | None = None, indexes: tuple[tuple[str, ...], ...] = ()) -> TableDef:
    """The table of one event: place of the log, arguments in order, block."""
    title = f"{name or snake_case(protocol) + '_' + snake_case(contract)}_{snake_case(e.name)}"
    if len(title.encode()) > MAX_IDENTIFIER:
        raise ValueError(f"table name {title!r} is too long")
    lead, tail = _table("", _LEADING).columns, _table("", _PLACE).columns
    taken = [c[0] for c in lead + tail] + ["chain", "dedupe_key"]
    own = unique([*taken, *e.columns])[len(taken) :]
    columns = []
    for column, p in zip(own, e.params, strict=True):
        spark = column_type(p)
        kind = f"list:{_SPARK_KIND[spark[6:-1]]}" if spark.startswith("array<") else _SPARK_KIND[spark]
        if kind == "text" and not p.indexed and (p.type.startswith("tuple") or p.type.count("[") > 1):
            kind = "document"
        elif kind == "text" and not p.indexed and p.type.split("[")[0] in ("uint256", "int256") or kind == "text" and _wide(p.type) and "[" not in p.type:
            kind = "bigint"
        columns.append((column, kind, p.type == "string" and not p.indexed))
    return TableDef(title, (*lead, *columns, *tail), kind="event", indexes=indexes)


def _wide(kind: str) -> bool:
    digits = kind.removeprefix("u").removeprefix("int")
    return kind.removeprefix("u").startswith("int") and digits.isdigit() and int(digits) > 64


def derived_table(name: str, columns: tuple[tuple[str, str], ...], indexes: tuple[tuple[str, ...], ...] = ()) -> TableDef:
    """The table of a derivation: place, sender and recipient if known, own columns (name, kind), block."""
    lead = _table("", f"{_LEADING} transaction_from_address? transaction_to_address?").columns
    return TableDef(name, (*lead, *((n, k, False) for n, k in columns), *_table("", _PLACE).columns), kind="derived", indexes=indexes)


def check_drift(df: DataFrame, table: TableDef) -> list[str]:
    """What differs between a stored table and its definition; tables are never migrated."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in table.schema().fields}
    out = [f"{table.name}.{n} is missing" for n in want if n not in have]
    out += [f"{table.name}.{n} is not defined" for n in have if n not in want and n != "block_range"]
    return out + [f"{table.name}.{n} is {have[n].simpleString()}, not {want[n].simpleString()}" for n in want if n in have and have[n].simpleString() != want[n].simpleString()]


# Keys: strings that name a record by its block's hash, so both branches of a fork are different rows.


def block_key(hash_: Column) -> Column:
    return F.concat(hash_, F.lit(":block"))


def transaction_key(block_hash: Column, hash_: Column) -> Column:
    return F.concat_ws(":", block_hash, hash_, F.lit("tx"))


def log_key(block_hash: Column, transaction_hash: Column, log_index: Column) -> Column:
    return F.concat_ws(":", block_hash, transaction_hash, log_index.cast("string"))


def decoded_key(log: Column, selector: Column, event_id: Column) -> Column:
    return F.concat_ws(":", log, selector, event_id, F.lit("decoded"))


def contract_key(log: Column, address: Column) -> Column:
    return F.concat_ws(":", log, F.lower(address), F.lit("contract"))


def derived_key(log: Column, table: str, row: Column) -> Column:
    return F.concat_ws(":", log, F.lit(table), row.cast("string"))


def handoff_key(block_hash: Column, address: Column) -> Column:
    return F.concat_ws(":", block_hash, address, F.lit("handoff"))


def marker_key(hash_: Column, kind: str) -> Column:
    """Of ``reorg``, ``accepted_block`` and ``session`` records."""
    return F.concat(hash_, F.lit(f":{kind}"))


# Heights: a stored table is partitioned by block_range, and Catalyst does not derive that bound itself.


def block_range(height: Column, width: int = WIDTH) -> Column:
    return F.floor(height / width).cast("long")


def at_or_above(column: str, height: int, width: int = WIDTH) -> Column:
    return (F.col("block_range") >= height // width) & (F.col(column) >= height)


def within(column: str, low: int, high: int, width: int = WIDTH) -> Column:
    return F.col("block_range").between(low // width, high // width) & F.col(column).between(low, high)


#: Hashes beyond which a list is joined rather than pushed to the scan.
PUSHED_VALUES = 1_000


def of_values(df: DataFrame, column: str, values: list[str], how: str = "left_semi") -> DataFrame:
    """Rows whose column is one of ``values``: a pushed filter if few, else a join."""
    if len(values) <= PUSHED_VALUES:
        hit = F.col(column).isin(values)
        return df.where(hit if how == "left_semi" else ~F.coalesce(hit, F.lit(False)))
    side = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return df.join(side, column, how)


def of_blocks(df: DataFrame, table: TableDef, hashes: list[str], floor: int | None = None, width: int = WIDTH) -> DataFrame:
    """Rows of the named blocks, at or above a height if that is known."""
    if floor is not None:
        df = df.where(at_or_above(table.block_number, floor, width))
    return of_values(df, table.block_hash, hashes)
