"""Which tables go to which store, and what must be fetched for them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.schema import DATASETS, TableDef

#: A pattern that stands for all event tables; no table may have its name.
CONTRACT_EVENTS = "contract_events"


class RouteError(ValueError):
    pass


def glob(pattern: str, name: str) -> bool:
    """Whether ``name`` matches; ``*`` is any run of characters and all else is itself."""
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), name, re.S) is not None


def resolve(entries: list[str], tables: dict[str, TableDef]) -> set[str]:
    """Names of the tables that a store writes: the entries' matches without those of ``!`` entries, in any order."""
    if not entries:
        raise RouteError("a store writes no table")
    if CONTRACT_EVENTS in tables:
        raise RouteError(f"a table is named {CONTRACT_EVENTS}, which is reserved")
    wanted: set[str] = set()
    refused: set[str] = set()
    for entry in entries:
        pattern = entry.removeprefix("!")
        if pattern in tables and tables[pattern].bookkeeping:
            raise RouteError(f"{pattern} is written to every store and cannot be listed")
        hits = {n for n, t in tables.items() if not t.bookkeeping and (t.kind == "event" and pattern == CONTRACT_EVENTS or glob(pattern, n))}
        if not hits:
            raise RouteError(f"{entry} matches no table")
        (refused if entry.startswith("!") else wanted).update(hits)
    return wanted - refused


def needed(stores: dict[str, set[str]], tables: dict[str, TableDef]) -> set[str]:
    """Datasets that the stores' tables are made from, over all stores."""
    out: set[str] = set()
    for names in stores.values():
        for n in names:
            kind = tables[n].kind
            if kind == "dataset":
                out.add("logs" if n == "decoded_logs" else n)
            else:
                out.add("logs")
                if kind == "derived":
                    out.add("transactions")
    return out


def fetch_plan(datasets: set[str]) -> dict[str, bool]:
    """What a node is asked for: a dataset that no table needs is not fetched."""
    transactions = "transactions" in datasets
    return {
        "headers": True,
        "full_transactions": transactions,
        "receipts": transactions,
        "logs_only": "logs" in datasets and not transactions,
        "hash_pinned_logs": "logs" in datasets and not transactions and "blocks" not in datasets,
    }


def split(records: dict[str, DataFrame], stores: dict[str, set[str]], tables: dict[str, TableDef]) -> dict[str, dict[str, DataFrame]]:
    """Each store's rows by table; bookkeeping goes to all. Frames are shared, so a cached one is computed once."""
    return {s: {t: df for t, df in records.items() if t in names or t in tables and tables[t].bookkeeping} for s, names in stores.items()}


def route_rows(envelopes: DataFrame, stores: dict[str, set[str]]) -> DataFrame:
    """Envelopes (``table``) with the store that takes each, one row for each taker."""
    pairs = [(s, t) for s, names in sorted(stores.items()) for t in sorted(names | {d.name for d in DATASETS.values() if d.bookkeeping})]
    routes = envelopes.sparkSession.createDataFrame(pairs, "store string, table string")
    return envelopes.join(F.broadcast(routes), "table")  # stores by tables, from the settings
