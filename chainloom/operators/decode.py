"""Logs of known contracts decoded into event tables, and the discovery of contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.abi import Event, decode_columns, native, slot
from chainloom.functions.abi_values import document
from chainloom.functions.words import strip
from chainloom.operators.relate import temporal_contracts
from chainloom.schema import decoded_key, log_key
from chainloom.sources.manifest import ZERO, Catalog

_TOPICS = ("topic0", "topic1", "topic2", "topic3")
_PLACE = ("transaction_hash", "transaction_index", "log_index", "block_number", "block_hash", "block_timestamp")


def topics() -> list[Column]:
    return [F.col(t) for t in _TOPICS]


def topic_count() -> Column:
    return F.aggregate(F.array(*[F.when(F.col(t).isNull(), 0).otherwise(1) for t in _TOPICS]), F.lit(0), lambda a, b: a + b)


def eligible(logs: DataFrame, contracts: DataFrame, events: DataFrame) -> DataFrame:
    """Logs of known contracts with a known event: by address and time, then by selector and topics.

    The catalog's events are a few hundred rows from files on the driver, so they are broadcast. Logs with other
    selectors, most of a chain's, go before logs are shuffled by their address.
    """
    selectors = events.select("topic0", F.col("topics").alias("n_topics")).distinct()
    named = logs.withColumn("n_topics", topic_count()).join(F.broadcast(selectors), ["topic0", "n_topics"], "left_semi")
    known = temporal_contracts(named, contracts)
    e = events.select(F.col("entry").alias("e_entry"), F.col("topic0").alias("e_topic0"), "topics", "signature", F.col("name").alias("event_name"))
    return known.join(F.broadcast(e), (F.col("entry") == F.col("e_entry")) & (F.col("topic0") == F.col("e_topic0")) & (F.col("n_topics") == F.col("topics"))).drop("e_entry", "e_topic0", "topics", "n_topics")


def decode_event(logs: DataFrame, e: Event, keep_unreadable: bool = False) -> DataFrame:
    """The event's table from logs that match it; unreadable logs have ``problem`` set, or are left out.

    Arguments are read by column expressions where these can, else by the Arrow-batched decoder.
    """
    keep = [c for c in ("address", *_PLACE, "chain", "entry") if c in logs.columns]
    if native(e):
        # one row each through a generator: a log's words are stripped once, and a filter on the problem stays above it
        words = F.array(F.struct(strip(F.col("data")).alias("data"), *[strip(t).alias(name) for t, name in zip(topics(), _TOPICS, strict=True)]))

        def read(x: Column) -> Column:
            columns, problem = decode_columns(e, [x[t] for t in _TOPICS], x["data"], stripped=True)
            return F.struct(*[v.alias(c if c not in keep else f"{c}_2") for c, v in columns.items()], problem.alias("problem"))

        out = logs.select(*keep, F.inline(F.transform(words, read)))
    else:
        read = logs.withColumn("d", document(e, topics(), F.col("data")))
        out = read.select(*keep, *[F.get_json_object("d.value", f"$.{c}").alias(c if c not in keep else f"{c}_2") for c in e.columns], F.col("d.error").alias("problem"))
    return out if keep_unreadable else out.where("problem is null").drop("problem")


def decoded_logs(logs: DataFrame, catalog: Catalog, contracts: DataFrame) -> DataFrame:
    """Rows of ``decoded_logs``: every readable log, its arguments as one JSON document."""
    matched = eligible(logs, contracts, catalog.events(logs.sparkSession))
    out = None
    for c in catalog.contracts:
        for e in c.events.values():
            mine = matched.where((F.col("entry") == c.entry) & (F.col("signature") == e.signature))
            read = mine.withColumn("d", document(e, topics(), F.col("data"))).where("d.error is null")
            key = decoded_key(log_key(F.col("block_hash"), F.col("transaction_hash"), F.col("log_index")), F.lit(e.topic0), F.lit(e.signature))
            rows = read.select(F.lit(e.name).alias("name"), "address", F.lit(c.protocol).alias("protocol"), F.lit(c.name).alias("contract"), F.lit(e.topic0).alias("selector"), "signature", *_PLACE, F.col("d.value").alias("body"), key.alias("dedupe_key"))
            out = rows if out is None else out.unionByName(rows)
    return out


def created(logs: DataFrame, catalog: Catalog, parents: DataFrame) -> DataFrame:
    """Contracts that logs of ``parents`` create: (address, entry, block_number, log_index, block_hash, factory).

    The address is read from its slot alone, so an unreadable log still creates; the zero address is none.
    """
    selectors = {e.topic0 for c in catalog.contracts for rule in c.created_by for e in catalog[rule.contract].named(rule.event)}
    known = temporal_contracts(logs.where(F.col("topic0").isin(sorted(selectors))), parents)
    out = None
    for c in catalog.contracts:
        for rule in c.created_by:
            for e in catalog[rule.contract].named(rule.event):
                mine = known.where((F.col("entry") == rule.contract) & (F.col("topic0") == e.topic0) & (topic_count() == e.topics))
                rows = mine.select(slot(e, rule.param, topics(), F.col("data")).alias("child"), F.lit(c.entry).alias("child_entry"), "block_number", "log_index", "block_hash", F.col("address").alias("factory_address"))
                rows = rows.where((F.col("child") != ZERO) & F.col("child").isNotNull())
                out = rows if out is None else out.unionByName(rows)
    if out is None:
        return parents.sparkSession.createDataFrame([], "address string, entry string, block_number decimal(20,0), log_index decimal(20,0), block_hash string, factory_address string")
    return out.select(F.col("child").alias("address"), F.col("child_entry").alias("entry"), "block_number", "log_index", "block_hash", "factory_address")


def first_claims(found: DataFrame) -> DataFrame:
    """The first creation of each address, in chain order."""
    rest = [c for c in found.columns if c not in ("address", "block_number", "log_index")]
    best = found.groupBy("address").agg(F.min(F.struct("block_number", "log_index", *rest)).alias("b"))
    return best.select("address", F.col("b.block_number").alias("block_number"), F.col("b.log_index").alias("log_index"), *[F.col(f"b.{c}").alias(c) for c in rest])


def discover(logs: DataFrame, catalog: Catalog, cut=lambda df: df) -> DataFrame:
    """The contract set to a fixpoint: seeds, and what they and their children create.

    There are as many rounds as the catalog's rules are deep; where rules form a cycle, rounds go on until one finds
    no contract. ``cut`` stores a round (for example as a checkpoint), so lineage does not grow.
    """
    seeds = catalog.seeds(logs.sparkSession)
    columns = ["address", "entry", "seed", "block_number", "log_index"]
    known, depth = seeds, _depth(catalog)
    found, held, rounds = None, -1, 0
    while depth is None or rounds < depth:
        rounds += 1
        new = created(logs, catalog, known)
        found = cut(first_claims(new.join(seeds.select("address"), "address", "left_anti")))
        known = seeds.select(*columns).unionByName(found.withColumn("seed", F.lit(False)).select(*columns))
        if depth is None:
            before, held = held, found.count()
            if held == before:
                break
    return known if found is None else known.select(*columns)


def _depth(catalog: Catalog) -> int | None:
    """Length of the longest chain of creation rules; None if there is a cycle."""
    rules = {c.entry: {r.contract for r in c.created_by} for c in catalog.contracts}

    def depth(entry: str, seen: tuple[str, ...]) -> float:
        if entry in seen:
            return float("inf")
        return max((1 + depth(p, (*seen, entry)) for p in rules.get(entry, ())), default=0)

    longest = max((depth(e, ()) for e in rules), default=0)
    return None if longest == float("inf") else int(longest)


def contract_rows(found: DataFrame) -> DataFrame:
    """One ``contracts`` row for each created address and block, so that a reorg of either block retracts its own."""
    first = found.groupBy("address", "entry", "block_number", "block_hash").agg(F.min(F.struct("log_index", "factory_address")).alias("b"))
    return first.select("address", "entry", "block_number", "block_hash", F.col("b.log_index").alias("log_index"), F.col("b.factory_address").alias("factory_address"))
