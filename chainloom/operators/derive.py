"""Facts derived from decoded events: packed words, ladders and prices.

Inputs are event tables with their arguments as raw hex words (without 0x where named ``*_word``). Each derivation
gives one row or several for each record, numbered by ``row`` from 0; what cannot be read gives none. ``derived`` goes
from the logs that a catalog's contracts emitted to the tables that it binds.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions import prices
from chainloom.functions.abi import Event, decode_columns, native, raw_words
from chainloom.functions.abi_values import document
from chainloom.functions.words import decimal_text, field, pseudo_float, signed_small, signed_text, small, spread, strip
from chainloom.schema import TableDef, derived_key, derived_table, log_key


#: What a derived row keeps of its log and of its log's transaction.
PLACE = ("address", "transaction_hash", "transaction_index", "log_index", "transaction_from_address", "transaction_to_address", "block_number", "block_hash", "block_timestamp", "chain")


@dataclass(frozen=True)
class Derivation:
    """A table of rows computed from the logs of some events of one contract."""

    protocol: str
    contract: str
    signatures: tuple[str, ...]
    table: str
    columns: tuple[tuple[str, str], ...]
    indexes: tuple[tuple[str, ...], ...]
    #: (column, position, name, type) of the arguments that it reads.
    arguments: tuple[tuple[str, int, str, str], ...]
    #: Rows from arguments as raw words, given the signature's number as a column.
    rows: Callable[[DataFrame, Column, list[str]], DataFrame]

    @property
    def entry(self) -> str:
        return f"{self.protocol}/{self.contract}"

    def definition(self) -> TableDef:
        return derived_table(self.table, self.columns, self.indexes)


def swap_columns(details: Column, deltas: Column, fees: Column) -> dict[str, Column]:
    """A swap's columns from its three packed words."""
    amount0 = field(deltas, 128, 128)
    position = field(details, 0, 104)
    return {
        "amount0_raw": signed_text(amount0, 128),
        "amount1_raw": signed_text(field(deltas, 0, 128), 128),
        "zero_for_one": (F.substring(amount0, 1, 1) < "8") & (amount0 != "0" * 32),
        "exact_input": small(field(details, 120, 4)).bitwiseAND(F.lit(1)) == 1,
        "bin_idx_after": signed_small(field(details, 104, 16), 16),
        "pos_in_bin_after": decimal_text(position, 128),
        "platform_spread_fee_scaled": decimal_text(field(fees, 128, 128), 128),
        "platform_notional_fee_scaled": decimal_text(field(fees, 0, 128), 128),
    }


def swaps(events: DataFrame, keep: list[str]) -> DataFrame:
    """``details_word``, ``deltas_word`` and ``fees_word`` unpacked."""
    cols = swap_columns(F.col("details_word"), F.col("deltas_word"), F.col("fees_word"))
    return events.select(*keep, F.lit(0).alias("row"), *[c.alias(n) for n, c in cols.items()])


def int16(hexed: Column) -> Column:
    """A 256-bit word as a bin index; null unless it fits 16 bits."""
    tail = field(hexed, 0, 16)
    sign = F.when(F.substring(tail, 1, 1) >= "8", F.lit("f" * 60)).otherwise(F.lit("0" * 60))
    return F.when(F.substring(hexed, 1, 60) == sign, signed_small(tail, 16))


def bin_fills(events: DataFrame, keep: list[str]) -> DataFrame:
    """``bin_word``, ``deltas_word`` and ``fees_word`` unpacked; a bin beyond 16 bits gives no row."""
    d, f = F.col("deltas_word"), F.col("fees_word")
    out = events.select(
        *keep, F.lit(0).alias("row"), int16(F.col("bin_word")).alias("bin_idx"), signed_text(field(d, 128, 128), 128).alias("delta0_scaled"), signed_text(field(d, 0, 128), 128).alias("delta1_scaled"),
        decimal_text(field(f, 128, 128), 128).alias("lp_fee_scaled"), decimal_text(field(f, 0, 128), 128).alias("platform_fee_scaled"),
    )
    return out.where("bin_idx is not null")


def liquidity(events: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each bin of ``bins``, ``deltas`` (structs of two) and ``shares``; ``removed`` negates the shares.

    Arrays that differ in length give no row; shares beyond int256 have no sign and give none either.
    """
    same = (F.size("bins") == F.size("deltas")) & (F.size("bins") == F.size("shares"))
    each = events.where(same).select(*keep, "removed", F.posexplode(F.arrays_zip("bins", "deltas", "shares")).alias("row", "b"))
    shares = F.when(F.col("removed") & (F.col("b.shares") != "0"), F.concat(F.lit("-"), F.col("b.shares"))).otherwise(F.col("b.shares"))
    direction = F.when(F.col("removed"), "remove").otherwise("add")
    return each.select(*keep, "row", direction.alias("direction"), F.col("b.bins").alias("bin_idx"), F.col("b.deltas.delta0").alias("delta0_scaled"), F.col("b.deltas.delta1").alias("delta1_scaled"), shares.alias("shares"))


def _side(words: Column) -> Column:
    """Bins (length, buy, sell) of one side, nearest first: five to a word from its low end, up to the first empty one."""
    each = F.flatten(
        F.transform(words, lambda w: F.array(*[F.struct(small(field(w, 48 * k, 16)).alias("length"), small(field(w, 48 * k + 16, 16)).alias("buy"), small(field(w, 48 * k + 32, 16)).alias("sell")) for k in range(5)]))
    )
    numbered = F.transform(each, lambda b, i: F.struct(b["length"].alias("length"), i.alias("i")))
    end = F.array_min(F.transform(F.filter(numbered, lambda b: b["length"] == 0), lambda b: b["i"]))
    return F.slice(each, 1, F.coalesce(end, F.size(each)))


def pool_bins(events: DataFrame, keep: list[str]) -> DataFrame:
    """The ladder of a pool: bins above 0 from ``above`` and below from ``below`` (arrays of words), outward from ``bin0_lower``.

    Edges are running sums of lengths over one record's bins, so they are computed inside its arrays.
    """

    def run(side: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<from:bigint,length:bigint,buy:bigint,sell:bigint>>").alias("out"))
        step = lambda acc, b: F.struct((acc["at"] + b["length"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), b["length"].alias("length"), b["buy"].alias("buy"), b["sell"].alias("sell")))).alias("out"))
        return F.aggregate(side, start, step, lambda acc: acc["out"])

    low = F.col("bin0_lower")
    up = F.transform(run(_side(F.col("above"))), lambda b, i: F.struct(i.cast("bigint").alias("bin_idx"), b["length"], b["buy"], b["sell"], (low + b["from"]).alias("lower"), (low + b["from"] + b["length"]).alias("upper")))
    down = F.transform(run(_side(F.col("below"))), lambda b, i: F.struct((-i - 1).cast("bigint").alias("bin_idx"), b["length"], b["buy"], b["sell"], (low - b["from"] - b["length"]).alias("lower"), (low - b["from"]).alias("upper")))
    kind = "array<struct<bin_idx:bigint,length_e6:bigint,add_fee_buy_e6:bigint,add_fee_sell_e6:bigint,lower_e6:bigint,upper_e6:bigint>>"
    each = events.select(*keep, F.posexplode(F.concat(F.reverse(down).cast(kind), up.cast(kind))).alias("row", "b"))
    return each.select(*keep, "row", "b.*")


#: Fixed value: the selector of the call that pushes one signed word.
UPDATE_BY_SIGNATURE = "7332112d"


def pushed_words(calldata: Column) -> Column:
    """Slot words in hex calldata: after a zero byte, or the one of a signed update."""
    rest = F.substr(calldata, F.lit(3))
    n = F.length(rest)
    many = F.transform(F.sequence(F.lit(0), (n / 64).cast("int") - 1), lambda i: rest.substr(i * 64 + 1, F.lit(64)))
    one = F.substring(calldata, 8 + 64 + 1, 64)
    return (
        F.when((F.substring(calldata, 1, 2) == "00") & (n > 0) & (n % 64 == 0), many)
        .when((F.substring(calldata, 1, 8) == UPDATE_BY_SIGNATURE) & (F.length(one) == 64), F.array(one))
        .otherwise(F.array().cast("array<string>"))
    )


def compressed_prices(events: DataFrame, keep: list[str]) -> DataFrame:
    """The price that a compressed oracle stored for ``feed_id`` (0x hex), from ``transaction_input`` (0x hex).

    Of the pushed words of the feed's slot the newest counts, the last of equal ones.
    """
    feed = strip(F.col("feed_id"))
    place = small(F.substring(feed, 63, 2))
    words = F.filter(pushed_words(strip(F.col("transaction_input"))), lambda w: F.substring(w, 63, 2) == F.substring(feed, 61, 2))
    stamped = F.transform(words, lambda w, i: F.struct(small(F.substring(w, 49, 14)).alias("ms"), i.alias("i"), w.alias("w")))
    rows = events.withColumn("_place", place).withColumn("_newest", F.array_max(stamped))
    item = F.col("_newest.w").substr((F.col("_place") * 12 + 1).cast("int"), F.lit(12))
    rows = rows.where((F.length(feed) == 64) & (F.col("_place") < 4) & F.col("_newest").isNotNull()).withColumn("_item", item)
    rows = rows.where((F.substring("_item", 1, 8) != "0" * 8) & (F.substring("_item", 9, 4) != "ffff"))
    i = F.col("_item")
    return rows.select(
        *keep, F.lit(0).alias("row"), "feed_id", pseudo_float(F.substring(i, 1, 8)).alias("price_e8"), spread(small(F.substring(i, 9, 2))).cast("bigint").alias("spread0"),
        spread(small(F.substring(i, 11, 2))).cast("bigint").alias("spread1"), F.col("_newest.ms").alias("feed_timestamp_ms"),
    )


def oracle_prices(events: DataFrame, keep: list[str]) -> DataFrame:
    """The price that an oracle stored for ``feed_id`` from the payloads in ``transaction_input``.

    Payloads may start at any byte, so they are parsed in Arrow batches.
    """

    @F.pandas_udf("price_e8 decimal(20,0), spread0 bigint, feed_timestamp_ms bigint")
    def read(feed: pd.Series, calldata: pd.Series) -> pd.DataFrame:
        got = [prices.stored(bytes.fromhex(f[2:]), bytes.fromhex(d[2:])) if f and d else None for f, d in zip(feed, calldata, strict=True)]
        none = (None, None, None)
        return pd.DataFrame([g or none for g in got], columns=["price_e8", "spread0", "feed_timestamp_ms"], dtype=object)

    rows = events.withColumn("_p", read("feed_id", "transaction_input")).where("_p.price_e8 is not null")
    return rows.select(*keep, F.lit(0).alias("row"), "feed_id", "_p.price_e8", "_p.spread0", "_p.feed_timestamp_ms")


def text_address(word: str) -> Column:
    return F.concat(F.lit("0x"), F.substring(word, 25, 40))


def _swap_rows(events: DataFrame, signature: Column, keep: list[str]) -> DataFrame:
    named = events.withColumns({"sender": text_address("sender_word"), "recipient": text_address("recipient_word")})
    return swaps(named, [*keep, "sender", "recipient"])


def _fill_rows(events: DataFrame, signature: Column, keep: list[str]) -> DataFrame:
    return bin_fills(events, keep)


def _liquidity_rows(events: DataFrame, signature: Column, keep: list[str]) -> DataFrame:
    """A bin beyond 16 bits or shares beyond a signed word leave the whole record without rows."""
    removed = signature == 1
    lowest = "8" + "0" * 63
    fits = lambda w: (F.substring(w, 1, 1) < "8") | (removed & (w == lowest))
    good = events.where(F.forall("bin_words", lambda w: int16(w).isNotNull()) & F.forall("share_words", fits))
    read = good.select(
        *keep, text_address("owner_word").alias("owner"), decimal_text(F.col("salt_word")).alias("salt"), removed.alias("removed"), F.transform("bin_words", int16).alias("bins"),
        F.transform("delta_words", lambda w: F.struct(signed_text(F.substring(w, 1, 64)).alias("delta0"), signed_text(F.substring(w, 65, 64)).alias("delta1"))).alias("deltas"),
        F.transform("share_words", lambda w: decimal_text(w)).alias("shares"),
    )
    return liquidity(read, [*keep, "owner", "salt"])


def _ladder_rows(events: DataFrame, signature: Column, keep: list[str]) -> DataFrame:
    read = events.select(*keep, text_address("pool_word").alias("pool"), signed_small(field(F.col("lower_word"), 0, 24), 24).alias("bin0_lower"), "above", "below")
    return pool_bins(read, [*keep, "pool"])


def _price_rows(events: DataFrame, signature: Column, keep: list[str], read: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    return read(events.withColumn("feed_id", F.concat(F.lit("0x"), "feed_word")), keep)


#: Tables, their contracts and events, columns and indexes, and the arguments that they are computed from.
DERIVATIONS = (
    Derivation(
        "metric_v1",
        "MetricOmmPool",
        ("Swap(address,address,uint256,uint256,uint256)",),
        "metric_v1_swaps",
        (
            ("sender", "text"),
            ("recipient", "text"),
            ("amount0_raw", "bigint"),
            ("amount1_raw", "bigint"),
            ("zero_for_one", "bool"),
            ("exact_input", "bool"),
            ("bin_idx_after", "int"),
            ("pos_in_bin_after", "bigint"),
            ("platform_spread_fee_scaled", "bigint"),
            ("platform_notional_fee_scaled", "bigint"),
        ),
        (("chain", "address", "block_number", "log_index"),),
        (
            ("sender_word", 0, "sender", "address"),
            ("recipient_word", 1, "recipient", "address"),
            ("details_word", 2, "details", "uint256"),
            ("deltas_word", 3, "amountDeltas", "uint256"),
            ("fees_word", 4, "platformFees", "uint256"),
        ),
        _swap_rows,
    ),
    Derivation(
        "metric_v1",
        "MetricOmmPool",
        ("BinSwapped(int256,uint256,uint256)",),
        "metric_v1_bin_fills",
        (
            ("bin_idx", "int"),
            ("delta0_scaled", "bigint"),
            ("delta1_scaled", "bigint"),
            ("lp_fee_scaled", "bigint"),
            ("platform_fee_scaled", "bigint"),
        ),
        (("chain", "address", "block_number"),),
        (
            ("bin_word", 0, "binIdx", "int256"),
            ("deltas_word", 1, "binDeltas", "uint256"),
            ("fees_word", 2, "fees", "uint256"),
        ),
        _fill_rows,
    ),
    Derivation(
        "metric_v1",
        "MetricOmmPool",
        (
            "LiquidityAdded(address,uint80,int256[],(int256,int256)[],uint256[])",
            "LiquidityRemoved(address,uint80,int256[],(int256,int256)[],uint256[])",
        ),
        "metric_v1_liquidity",
        (
            ("direction", "text"),
            ("owner", "text"),
            ("salt", "bigint"),
            ("bin_idx", "int"),
            ("delta0_scaled", "bigint"),
            ("delta1_scaled", "bigint"),
            ("shares", "bigint"),
        ),
        (("chain", "owner"), ("chain", "transaction_from_address"), ("chain", "address", "owner")),
        (
            ("owner_word", 0, "provider", "address"),
            ("salt_word", 1, "salt", "uint80"),
            ("bin_words", 2, "binIdxs", "int256[]"),
            ("delta_words", 3, "binBalanceDeltas", "(int256,int256)[]"),
            ("share_words", 4, "shares", "uint256[]"),
        ),
        _liquidity_rows,
    ),
    Derivation(
        "metric_v1",
        "MetricOmmPoolFactory",
        (
            "PoolCreated(address,address,address,uint256,address,address,address,address[],"
            "(uint256,uint256,uint256,uint256,uint256,uint256),uint256,uint256,uint256,uint256,"
            "uint24,uint24,uint24,uint24,address,int24,uint256[],uint256[])",
        ),
        "metric_v1_pool_bins",
        (
            ("pool", "text"),
            ("bin_idx", "int"),
            ("length_e6", "int"),
            ("add_fee_buy_e6", "int"),
            ("add_fee_sell_e6", "int"),
            ("lower_e6", "int"),
            ("upper_e6", "int"),
        ),
        (("chain", "pool", "transaction_from_address"),),
        (
            ("pool_word", 0, "poolAddress", "address"),
            ("lower_word", 18, "curBinDistFromProvidedPriceE6", "int24"),
            ("above", 19, "nonNegativeBinDataArray", "uint256[]"),
            ("below", 20, "negativeBinDataArray", "uint256[]"),
        ),
        _ladder_rows,
    ),
    Derivation(
        "metric_v1",
        "OracleProvider",
        ("FeedUpdated(bytes32)",),
        "metric_v1_oracle_prices",
        (("feed_id", "text"), ("price_e8", "uint"), ("spread0", "uint"), ("feed_timestamp_ms", "uint")),
        (("chain", "address", "feed_id", "block_number"), ("chain", "address", "feed_id", "block_timestamp")),
        (("feed_word", 0, "feedId", "bytes32"),),
        partial(_price_rows, read=oracle_prices),
    ),
    Derivation(
        "metric_v1",
        "CompressedOracle",
        ("FeedUpdated(bytes32)",),
        "metric_v1_compressed_oracle_prices",
        (("feed_id", "text"), ("price_e8", "uint"), ("spread0", "uint"), ("spread1", "uint"), ("feed_timestamp_ms", "uint")),
        (("chain", "address", "feed_id", "block_number"), ("chain", "address", "feed_id", "block_timestamp")),
        (("feed_word", 0, "feedId", "bytes32"),),
        partial(_price_rows, read=compressed_prices),
    ),
)


def bound(catalog) -> list[tuple[Derivation, list[Event]]]:
    """Derivations whose every signature their contract declares, with the events in the order of the signatures."""
    out = []
    for d in DERIVATIONS:
        events = {e.signature: e for c in catalog.contracts if c.entry == d.entry for e in c.events.values()}
        if events.keys() >= set(d.signatures):
            out.append((d, [events[s] for s in d.signatures]))
    return out


def arguments(logs: DataFrame, e: Event, wanted: tuple[tuple[str, int, str, str], ...]) -> DataFrame:
    """Readable logs of an event with some of its arguments as raw words."""
    topics = ["topic0", "topic1", "topic2", "topic3"]
    keep = [c for c in (*PLACE, "transaction_input", "_number") if c in logs.columns]

    def raw(x: Callable[[str], Column]) -> list[Column]:
        return [raw_words(e, at, name, kind, [x(t) for t in topics], x("data")).alias(column) for column, at, name, kind in wanted]

    if not native(e):
        read = logs.withColumn("_d", document(e, [F.col(t) for t in topics], F.col("data"))).where("_d.error is null")
        return read.withColumns({c: strip(F.col(c)) for c in [*topics, "data"]}).select(*keep, *raw(F.col))
    stripped = F.array(F.struct(*[strip(F.col(c)).alias(c) for c in ["data", *topics]]))

    def one(x: Column) -> Column:
        return F.struct(*raw(lambda c: x[c]), decode_columns(e, [x[t] for t in topics], x["data"], stripped=True)[1].alias("_problem"))

    return logs.select(*keep, F.inline(F.transform(stripped, one))).where("_problem is null").drop("_problem")


def derived(matched: DataFrame, d: Derivation, events: list[Event]) -> DataFrame:
    """A derivation's table from logs matched with the catalog's events, with their transactions' columns.

    An event whose arguments are not the ones that the derivation reads gives no row, with a warning.
    """
    keep = [c for c in PLACE if c in matched.columns]
    number = F.lit(-1)
    for i, e in enumerate(events):
        number = F.when(F.col("signature") == e.signature, i).otherwise(number)
    mine = matched.where(F.col("entry") == d.entry).withColumn("_number", number)
    layouts: dict[tuple, list[int]] = {}  # events that differ by name only are read in one pass
    for i, e in enumerate(events):
        layouts.setdefault((e.params, e.anonymous, None if native(e) else i), []).append(i)
    parts = []
    for same in layouts.values():
        try:
            parts.append(d.rows(arguments(mine.where(F.col("_number").isin(same)), events[same[0]], d.arguments), F.col("_number"), keep))
        except ValueError as error:
            warnings.warn(f"{d.table}: {error}", stacklevel=2)
    if not parts:
        return matched.sparkSession.createDataFrame([], d.definition().schema())
    rows = reduce(DataFrame.unionByName, parts)
    return rows.withColumn("dedupe_key", derived_key(log_key(F.col("block_hash"), F.col("transaction_hash"), F.col("log_index")), d.table, F.col("row")))


def derivations(catalog) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """By table, what computes its rows from matched logs with their transactions' columns."""
    return {d.table: partial(derived, d=d, events=events) for d, events in bound(catalog)}
