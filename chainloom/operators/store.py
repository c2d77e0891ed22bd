"""A table store on Parquet: versioned partitions, retraction by block, and a ledger that is written last.

A table is a folder of ``block_range`` partitions. Each partition has one live folder of files, named in the table's
manifest (one small JSON file that lists the live folder of every partition). A rewrite puts the new files beside the old ones and then
replaces the manifest in one rename, so a reader sees a table before or after a change. A block's rows
count only once its hash is in ``accepted_blocks``: steps run in the order that leaves no
accepted block incomplete, and ``repair`` at open removes what a crash left.

Manifests are read and written through Hadoop's file system, so the store may be in any of its stores.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators.chain import last_copies
from chainloom.operators.relate import stray_blocks
from chainloom.schema import DATASETS, WIDTH, TableDef, block_range, check_drift

#: Tables that are written or read at once.
PARALLEL = 16


class Replayed(ValueError):
    """Blocks that the ledger holds already."""


class Locked(RuntimeError):
    pass


class Files:
    """The few calls of Hadoop's file system that the store needs."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def read(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, replace: bool = True) -> bool:
        """Creates the file, or replaces it in one rename."""
        p, tmp = self._path(path), self._path(f"{path}.{uuid.uuid4().hex}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not replace:
            made = not self._fs.exists(p) and self._fs.rename(tmp, p)
            if not made:
                self._fs.delete(tmp, False)
            return made
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri())
        option = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self._jvm.java.lang.reflect.Array.newInstance(option.getClass(), 1)
        options[0] = option
        context.rename(context.makeQualified(tmp), context.makeQualified(p), options)
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def folders(self, path: str) -> list[tuple[str, int]]:
        """(path, milliseconds of last change) of the folders in a folder."""
        p = self._path(path)
        if not self._fs.exists(p):
            return []
        return [(s.getPath().toString(), s.getModificationTime()) for s in self._fs.listStatus(p) if s.isDirectory()]

    def sizes(self, path: str) -> list[int]:
        p = self._path(path)
        return [s.getLen() for s in self._fs.listStatus(p) if s.getPath().getName().endswith(".parquet")] if self._fs.exists(p) else []


@dataclass
class Store:
    spark: SparkSession
    root: str
    tables: dict[str, TableDef]
    width: int = WIDTH
    files: Files = field(init=False)

    def __post_init__(self):
        if self.width <= 4_096:
            raise ValueError("a partition must be wider than the undo window")
        self.tables = DATASETS | self.tables
        self.files = Files(self.spark, self.root)

    @property
    def _pending(self) -> str:
        return f"{self.root}/_pending.json"

    # Manifests

    def _manifest(self, table: str) -> dict[str, list[str]]:
        return json.loads(self.files.read(f"{self.root}/{table}/_manifest.json") or "{}")

    def _commit(self, table: str, live: dict[str, list[str]]) -> None:
        self.files.write(f"{self.root}/{table}/_manifest.json", json.dumps(live, sort_keys=True))

    def _schema(self, t: TableDef):
        return t.schema().add("block_range", "long")

    def read(self, table: str, low: int | None = None, high: int | None = None) -> DataFrame:
        """The live rows, of the partitions that a height range touches if one is given."""
        t = self.tables[table]
        live = self._manifest(table)
        if low is not None or high is not None:
            first = -1 if low is None else low // self.width
            last = 1 << 62 if high is None else high // self.width
            live = {k: v for k, v in live.items() if first <= int(k) <= last}
        paths = [f"{self.root}/{table}/{f}" for v in live.values() for f in v]
        df = self.spark.read.schema(self._schema(t)).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema(t))
        if t.block_number and low is not None:
            df = df.where(F.col(t.block_number) >= low)
        if t.block_number and high is not None:
            df = df.where(F.col(t.block_number) <= high)
        return df

    def drift(self, table: str) -> list[str]:
        return check_drift(self.read(table), self.tables[table])

    # Writes

    def _placed(self, t: TableDef, rows: DataFrame, before_lake: bool = False) -> DataFrame:
        """Rows with their partition; all in partition 0 if they come from below the stored heights."""
        place = F.lit(0).cast("long") if before_lake or not t.block_number else block_range(F.col(t.block_number), self.width)
        schema = t.schema()
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], place.alias("block_range"))

    def _write(self, table: str, placed: DataFrame, order: str | None) -> dict[str, list[str]]:
        """New folders of rows by partition; not live yet."""
        stamp = uuid.uuid4().hex
        keys = [c for c in ("block_range", order) if c]
        to = f"{self.root}/{table}/{stamp}"
        # rows of a partition sorted by height have tight row groups
        placed.withColumn("part", F.col("block_range")).sortWithinPartitions(*keys).write.partitionBy("part").parquet(to)
        return {p.rpartition("part=")[2]: [f"{stamp}/part={p.rpartition('part=')[2]}"] for p, _ in self.files.folders(to)}

    def append(self, table: str, rows: DataFrame, before_lake: bool = False) -> None:
        t = self.tables[table]
        new = self._write(table, self._placed(t, rows, before_lake), t.block_number)
        live = self._manifest(table)
        for k, v in new.items():
            live[k] = live.get(k, []) + v
        if new:
            self._commit(table, live)

    def _rewrite(self, table: str, keep: DataFrame, ranges: list[str]) -> None:
        """The named partitions hold just ``keep`` from now on."""
        t = self.tables[table]
        new = self._write(table, keep, t.block_number)
        live = {k: v for k, v in self._manifest(table).items() if k not in ranges}
        self._commit(table, live | new)

    def _part(self, table: str, ranges: list[str]) -> DataFrame:
        live = self._manifest(table)
        paths = [f"{self.root}/{table}/{f}" for k in ranges for f in live.get(k, [])]
        t = self.tables[table]
        return self.spark.read.schema(self._schema(t)).parquet(*paths) if paths else self.spark.createDataFrame([], self._schema(t))

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Rows replace held ones of the same key, the last copy of each key; only touched partitions are rewritten."""
        t = self.tables[table]
        rows = last_copies(rows, "seq") if "seq" in rows.columns else rows.dropDuplicates(["chain", "dedupe_key"])
        new = self._placed(t, rows.drop("seq"))
        touched = [str(r["block_range"]) for r in new.select("block_range").distinct().collect()]  # partitions of a batch
        old = self._part(table, touched)
        self._rewrite(table, old.join(new.select("chain", "dedupe_key"), ["chain", "dedupe_key"], "left_anti").unionByName(new), touched)

    def fill(self, table: str, rows: DataFrame, before_lake: bool = False) -> None:
        """Appends the rows whose key the table lacks; doing it twice is the same as once."""
        placed = self._placed(self.tables[table], rows)
        touched = [str(r["block_range"]) for r in placed.select("block_range").distinct().collect()]  # partitions of a batch
        held = self._part(table, touched)
        new = rows.dropDuplicates(["chain", "dedupe_key"]).join(held.select("chain", "dedupe_key"), ["chain", "dedupe_key"], "left_anti")
        self.append(table, new, before_lake)

    def delete_blocks(self, table: str, hashes: DataFrame, floor: int) -> None:
        """Deletes the rows of orphaned blocks (``hash``) at or above a height."""
        t = self.tables[table]
        if t.block_hash is None:
            return
        ranges = [k for k in self._manifest(table) if int(k) >= floor // self.width or int(k) == 0]
        if not ranges:
            return
        old = self._part(table, ranges)
        hit = old.where(F.col(t.block_number) >= floor).join(hashes.select(F.col("hash").alias(t.block_hash)).distinct(), t.block_hash, "left_semi")
        touched = [str(r["block_range"]) for r in hit.select("block_range").distinct().collect()]
        if touched:
            old = self._part(table, touched)
            gone = hashes.select(F.col("hash").alias("gone")).distinct()
            self._rewrite(table, old.join(gone, (F.col(t.block_hash) == F.col("gone")) & (F.col(t.block_number) >= floor), "left_anti"), touched)

    def delete_above(self, table: str, height: int) -> None:
        """Rewinds a table to a height."""
        t = self.tables[table]
        if t.block_number is None:
            return
        ranges = [k for k in self._manifest(table) if int(k) >= (height + 1) // self.width]
        if ranges:
            self._rewrite(table, self._part(table, ranges).where(F.col(t.block_number) <= height), ranges)

    def prune_ledger(self, keep: int) -> None:
        """Drops accepted blocks more than ``keep`` below the tip."""
        tip = self.read("accepted_blocks").agg(F.max("height")).first()[0]
        if tip is None:
            return
        low = int(tip) - keep
        ranges = [k for k in self._manifest("accepted_blocks") if int(k) <= low // self.width]
        if ranges:
            self._rewrite("accepted_blocks", self._part("accepted_blocks", ranges).where(F.col("height") > low), ranges)

    # Commits

    def commit(self, batch: dict[str, DataFrame], stop_after: str | None = None) -> None:
        """Applies a batch: record retractions, take them off the ledger, delete, append rows, append the ledger.

        ``batch`` has rows by table, ``reorgs`` and ``accepted_blocks`` among them. ``stop_after`` ends
        early behind a step, as a crash would (for tests).
        """
        ledger = batch.get("accepted_blocks")
        reorgs = batch.get("reorgs")
        if ledger is not None:
            known = ledger.select("hash").join(self.read("accepted_blocks").select("hash"), "hash", "left_semi")
            if reorgs is not None:
                known = known.join(self._orphans(reorgs), "hash", "left_anti")
            if known.limit(1).count():
                raise Replayed("blocks of the batch are in the ledger")
        others = [t for t in self.tables.values() if t.name not in ("accepted_blocks", "reorgs")]
        if reorgs is not None and (floor := reorgs.agg(F.min("height")).first()[0]) is not None:
            floor, orphans = int(floor), self._orphans(reorgs).persist()
            # what a crash from here on leaves to do; an undo window of hashes at most
            self.files.write(self._pending, json.dumps({"floor": floor, "hashes": sorted(r["hash"] for r in orphans.collect())}))
            self.append("reorgs", reorgs)
            if stop_after == "record":
                return
            self.delete_blocks("accepted_blocks", orphans, floor)
            if stop_after == "ledger":
                return
            self._each(others, lambda t: self.delete_blocks(t.name, orphans, floor))
            orphans.unpersist()
            self.files.delete(self._pending)
            if stop_after == "delete":
                return
        self._each([t for t in others if t.name in batch], lambda t: self.append(t.name, batch[t.name]))
        if stop_after == "rows":
            return
        if ledger is not None:
            self.append("accepted_blocks", ledger)

    def _orphans(self, reorgs: DataFrame) -> DataFrame:
        return reorgs.select(F.explode(F.from_json("orphaned_hashes", "array<string>")).alias("hash")).distinct()

    def _each(self, tables: list[TableDef], run) -> None:
        """Independent tables are written at the same time."""
        with ThreadPoolExecutor(max(1, min(PARALLEL, len(tables)))) as pool:
            list(pool.map(run, tables))

    def repair(self) -> None:
        """Finishes a retraction that was begun, and deletes rows of blocks that the ledger lacks.

        A reorg's orphans may be adopted again later, so the begun one is known by its own file and not by the ``reorgs`` rows.
        """
        if (text := self.files.read(self._pending)) is not None:
            todo = json.loads(text)
            if todo["hashes"]:
                gone = self.spark.createDataFrame([(h,) for h in todo["hashes"]], "hash string")
                self._each([t for t in self.tables.values() if t.name != "reorgs"], lambda t: self.delete_blocks(t.name, gone, todo["floor"]))
            self.files.delete(self._pending)
        ledger = self.read("accepted_blocks")
        low = ledger.agg(F.min("height")).first()[0]
        floor = 0 if low is None else int(low)

        def clean(t: TableDef) -> None:
            strays = stray_blocks(self.read(t.name, floor), ledger, floor, t.block_hash, t.block_number)
            if strays.limit(1).count():
                self.delete_blocks(t.name, strays, floor)

        self._each([t for t in self.tables.values() if t.block_hash and t.name != "accepted_blocks"], clean)

    # Maintenance

    def listing(self, table: str) -> list[tuple[int, int, int]]:
        """(partition, files, bytes) of the live folders."""
        out = []
        for k, folders in self._manifest(table).items():
            sizes = [s for f in folders for s in self.files.sizes(f"{self.root}/{table}/{f}")]
            out.append((int(k), len(sizes), sum(sizes)))
        return sorted(out)

    def compact(self, table: str, tip: int, window: int = 4_096, small: int = 32 << 20, target: int = 128 << 20) -> list[int]:
        """Rewrites finished partitions that have several small files into files of about ``target`` bytes."""
        done = []
        for k, n, size in self.listing(table):
            if (k + 1) * self.width + window <= tip and n > 1 and size / n < small:
                t = self.tables[table]
                rows = self._part(table, [str(k)]).repartitionByRange(max(1, -(-size // target)), t.block_number or "dedupe_key")
                self._rewrite(table, rows, [str(k)])
                done.append(k)
        return done

    def vacuum(self, table: str, hours: float = 168) -> int:
        """Deletes folders that no manifest names and that are older than the retention."""
        live = {f.split("/")[0] for v in self._manifest(table).values() for f in v}
        old = time.time() * 1000 - hours * 3_600_000
        gone = [p for p, changed in self.files.folders(f"{self.root}/{table}") if p.rpartition("/")[2] not in live and changed <= old]
        for p in gone:
            self.files.delete(p)
        return len(gone)

    # One writer

    def lock(self, owner: str, stale: float = 600) -> None:
        """Takes the writer's lease, or that of an owner who has not renewed it for ``stale`` seconds."""
        path, now = f"{self.root}/_lease.json", time.time()
        mine = json.dumps({"owner": owner, "heartbeat": now})
        if self.files.write(path, mine, replace=False):
            return
        held = json.loads(self.files.read(path) or "{}")
        if held.get("owner") != owner and held.get("heartbeat", 0) > now - stale:
            raise Locked(f"held by {held.get('owner')}")
        self.files.write(path, mine)

    def unlock(self) -> None:
        self.files.delete(f"{self.root}/_lease.json")


def to_ndjson(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls written out."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


#: Column types of a SQL store by Spark's.
SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "decimal(20,0)": "DECIMAL(20,0)", "boolean": "BOOLEAN", "timestamp": "TIMESTAMPTZ"}


#: Words of SQL that a column may only be called in quotes.
RESERVED = frozenset(
    "all and any array as asc both case cast check column constraint create default desc distinct do else end except false for foreign from grant group having in initially intersect into "
    "lateral leading limit not null offset on only or order primary references returning select some symmetric table then to trailing true union unique user using variadic when where window with".split()
)


def named(column: str) -> str:
    return f'"{column}"' if column in RESERVED else column


def sql_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return SQL_TYPES[spark_type[6:-1]] + "[]"
    return SQL_TYPES[spark_type]


def create_table_sql(t: TableDef) -> str:
    """DDL of a SQL store with the key pair as its primary key."""
    columns = [f"{named(f.name)} {sql_type(f.dataType.simpleString())}{'' if f.nullable else ' NOT NULL'}" for f in t.schema().fields]
    return f"CREATE TABLE IF NOT EXISTS {t.name} ({', '.join(columns)}, PRIMARY KEY (chain, dedupe_key))"


def upsert_sql(t: TableDef, staging: str) -> str:
    """A staging table merged into the table by its key."""
    names = [named(f.name) for f in t.schema().fields]
    changed = ", ".join(f"{n} = excluded.{n}" for n in names if n not in ("chain", "dedupe_key"))
    return f"INSERT INTO {t.name} ({', '.join(names)}) SELECT {', '.join(names)} FROM {staging} ON CONFLICT (chain, dedupe_key) DO UPDATE SET {changed}"


def index_sql(t: TableDef) -> list[str]:
    """Secondary indexes; a lake has none and sorts by height instead."""
    from chainloom.functions.names import fit_identifier

    indexes = list(t.indexes) + ([("chain", t.block_number)] if t.block_number else [])
    return [f"CREATE INDEX IF NOT EXISTS {fit_identifier(t.name + '_' + '_'.join(i) + '_index')} ON {t.name} ({', '.join(map(named, i))})" for i in indexes]


def delete_blocks_sql(t: TableDef, hashes: str, floor: int) -> str | None:
    """Deletes the rows of blocks that a table ``hashes`` (``hash``) names, at or above a height; none for tables without blocks."""
    if t.block_hash is None:
        return None
    return f"DELETE FROM {t.name} WHERE {t.block_number} >= {floor} AND {t.block_hash} IN (SELECT hash FROM {hashes})"


def bulk_load(df: DataFrame, t: TableDef, path: str, execute: Callable[[str], object]) -> None:
    """Rows into an embedded SQL store: executors write files to a shared folder, and one statement merges them.

    ``execute`` runs SQL in a store that reads Parquet files; rows do not pass through the driver. Of copies of one key
    one is kept, the last if the rows have ``seq``; loading twice is the same as once.
    """
    rows = last_copies(df, "seq") if "seq" in df.columns else df.dropDuplicates(["chain", "dedupe_key"])
    rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in t.schema().fields]).write.mode("overwrite").parquet(path)
    execute(create_table_sql(t))
    execute(upsert_sql(t, f"read_parquet('{path}/*.parquet')"))


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000, **options: str) -> None:
    """Bulk load into a database that has a JDBC driver on the class path."""
    df.write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=str(batch), **options).save()
