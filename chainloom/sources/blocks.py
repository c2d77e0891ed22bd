"""A Python data source of blocks, one partition for each range of heights.

It stands where a node client would: the reader asks a ``BlockStore`` for heights. The store that ships here is a
folder of NDJSON files that all executors can read, named by their first height. The option ``client`` names another
(``module:function``, called with the options in each task), such as those of ``sources.node``.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader

from chainloom.sources.node import Inconsistent

SCHEMA = "height bigint, hash string, parent_hash string, timestamp bigint, json string"


class BlockStore:
    """A folder with NDJSON files: one block for each line.

    A file named by a number holds the heights from that number to below the next file's; files with other names may hold any.
    """

    def __init__(self, path: str):
        files = sorted(Path(path).glob("*.ndjson"))
        self.ranged = sorted((int(f.stem), f) for f in files if f.stem.isdigit())
        self.others = [f for f in files if not f.stem.isdigit()]

    def head(self) -> int:
        newest = [f for _, f in self.ranged[-1:]]
        return max((b["height"] for b in self._read([*newest, *self.others])), default=-1)

    def range(self, low: int, high: int) -> Iterator[dict]:
        """Blocks of [low, high] by height; of one height, the last in the files counts."""
        ends = [first for first, _ in self.ranged[1:]] + [high + 1]
        files = [f for (first, f), end in zip(self.ranged, ends, strict=False) if first <= high and end > low]
        found = {b["height"]: b for b in self._read([*files, *self.others]) if low <= b["height"] <= high}
        if missing := set(range(low, high + 1)) - set(found):
            raise Inconsistent(f"no blocks {sorted(missing)[:5]}")
        for h in sorted(found):
            yield found[h]

    def header(self, height: int) -> dict:
        b = next(self.range(height, height))
        return {k: b[k] for k in ("height", "hash", "parent_hash", "timestamp")}

    @staticmethod
    def _read(files: list[Path]) -> Iterator[dict]:
        for f in files:
            with f.open() as lines:
                yield from map(json.loads, lines)


def open_store(options: dict):
    """What answers a source's questions: ``head``, ``header`` and ``range``."""
    if "client" not in options:
        return BlockStore(options["path"])
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


def spans(low: int, high: int, span: int) -> list[tuple[int, int]]:
    return [(a, min(high, a + span - 1)) for a in range(low, high + 1, span)]


def row(b: dict) -> tuple:
    return b["height"], b["hash"], b["parent_hash"], b["timestamp"], json.dumps(b, separators=(",", ":"))


@dataclass
class HeightRange(InputPartition):
    low: int
    high: int


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.low = dict(options), int(options.get("from", 0))
        self.high = int(options["to"]) if "to" in options else None
        self.span = int(options.get("span", 100))

    def partitions(self):
        high = open_store(self.options).head() if self.high is None else self.high
        return [HeightRange(a, b) for a, b in spans(self.low, high, self.span)]

    def read(self, partition):
        for b in open_store(self.options).range(partition.low, partition.high):
            if not partition.low <= b["height"] <= partition.high:
                raise Inconsistent("a block of another height")
            yield row(b)


class HeadReader(SimpleDataSourceStreamReader):
    """Follows the heads: each read gives the blocks above the last one, ``most`` at a time."""

    def __init__(self, options: dict):
        self.options, self.start, self.most = dict(options), int(options.get("from", 0)), int(options.get("most", 1_024))

    def initialOffset(self):
        return {"next": self.start}

    def read(self, start):
        store, at = open_store(self.options), start["next"]
        head = min(store.head(), at + self.most - 1)
        return iter([row(b) for b in (store.range(at, head) if head >= at else ())]), {"next": max(at, head + 1)}

    def readBetweenOffsets(self, start, end):
        if end["next"] > start["next"]:
            yield from (row(b) for b in open_store(self.options).range(start["next"], end["next"] - 1))


class BlockSource(DataSource):
    """``spark.read.format("chain_blocks").option("path", ...)``, with ``from``, ``to`` and ``span``; streams take ``from`` and ``most``.

    With ``client`` instead of ``path``, blocks come from a node.
    """

    @classmethod
    def name(cls):
        return "chain_blocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BlockReader(self.options)

    def simpleStreamReader(self, schema):
        return HeadReader(self.options)


LOG_SCHEMA = "log_index bigint, transaction_hash string, transaction_index bigint, address string, topic0 string, topic1 string, topic2 string, topic3 string, data string, block_number bigint, block_hash string, block_timestamp bigint"


class LogReader(DataSourceReader):
    """Logs found by address and selector, one task for each range of heights."""

    def __init__(self, options: dict):
        self.options, self.low, self.high = dict(options), int(options.get("from", 0)), int(options["to"])
        self.span = int(options.get("span", 1_000_000))
        self.wanted = {k: [v for v in options.get(k, "").split(",") if v] for k in ("address", "topic0")}

    def pushFilters(self, filters: list[Filter]):
        """Equalities of address and selector narrow the question; Spark applies every filter again."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in self.wanted:
                values = [f.value] if isinstance(f, EqualTo) else list(f.value)
                have = self.wanted[name]
                # one value at least, since an empty list asks for all; the filter itself drops its rows
                self.wanted[name] = ([v for v in have if v in values] or have[:1]) if have else values
            yield f

    def partitions(self):
        return [HeightRange(a, b) for a, b in spans(self.low, self.high, self.span)]

    def read(self, partition):
        for x in open_store(self.options).search(partition.low, partition.high, self.wanted["address"], self.wanted["topic0"]):
            topics = [*x["topics"], None, None, None, None][:4]
            yield x["log_index"], x["transaction_hash"], x["transaction_index"], x["address"], *topics, x["data"], x["block_number"], x["block_hash"], x["block_timestamp"]


class LogSource(DataSource):
    """``spark.read.format("chain_logs")`` with ``client``, ``to`` and lists ``address`` and ``topic0``, comma-separated."""

    @classmethod
    def name(cls):
        return "chain_logs"

    def schema(self):
        return LOG_SCHEMA

    def reader(self, schema):
        return LogReader(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # ``chain_logs`` takes filters
    spark.dataSource.register(BlockSource)
    spark.dataSource.register(LogSource)
