"""Sharding by balanced label propagation; DataFrame functions only.

Documents with equal texts are linked (all members of a group to each other, held as a group and
not as pairs). At the start groups lie end to end, in hashed order, and are cut into equal shares, so
at most one group at each cut is split. Each round then moves linked documents to the shard with room that can gather most of
their group, as far as capacity quotas allow: the quota of a shard is its room plus what leaves it
in the same round. Quotas are met in hash buckets of (from, to), so a round needs no global order.
Rounds end when none moves or a round lessens no split. Documents without links fill the shards up, which cuts no edge.

The law is ``rows``: the shards' counts differ by one at most. Sizes, counts of groups and buckets travel; texts do not leave
the scan. The driver sees only tables of shards by buckets, whose sizes are parameters.

Defined results: null text counts as the empty text (size 1, CRC 0); rows with a null id are dealt
like any other; repeated rows are dealt one by one; an empty table gives an empty result. Columns
other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.llm.common import cut, partitions

#: Hash buckets in which quotas are met.
BUCKETS = 512
#: Rows of one group that a join sends to one task, about.
SHARE = 256
#: Rows that a bucket of the final numbering has on average, at most.
NUMBERED = 100_000


def _accepted(wish: dict[tuple[int, int], list[int]], size: list[int], capacity: int) -> dict[tuple[int, int], int]:
    """For each (from, to) the number of leading buckets that may move, so that no shard overflows.

    A shard that would overflow gives up its incoming buckets from the last one down; as that keeps documents in
    other shards, the check runs until all shards fit. What moves only shrinks, so it ends.
    """
    upto = {k: len(v) for k, v in wish.items()}
    moving = {k: sum(v) for k, v in wish.items()}
    shards = range(len(size))
    while True:
        over = False
        for to in shards:
            now = size[to] + sum(moving[k] for k in wish if k[1] == to) - sum(moving[k] for k in wish if k[0] == to)
            start = size[to]
            limit = max(capacity, start)
            while now > limit and any(moving[k] for k in wish if k[1] == to):
                k = max((k for k in wish if k[1] == to and moving[k]), key=lambda k: (upto[k], k))
                upto[k] -= 1
                moving[k] -= wish[k][upto[k]]
                now -= wish[k][upto[k]]
                over = True
        if not over:
            return upto


def _choose(values: list, index):
    """The value at a column of indexes from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _meet(linked: DataFrame, of_group: DataFrame) -> DataFrame:
    """``linked`` (with g1, g2, n) joined with ``of_group``, one row for each g1, g2; the rows of a large group are dealt to several tasks."""
    salts = F.ceil(F.col("n") / SHARE).cast("int")
    rows = linked.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    dealt = of_group.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    return rows.join(dealt, ["g1", "g2", "salt"]).drop("salt")


def propagate(linked: DataFrame, shards: int, capacity: int) -> DataFrame:
    """``linked`` (id, size, crc, g1, g2, n, shard) after the rounds; no shard is over ``capacity``
    unless it was from the start."""
    before, parts = None, None
    while True:
        last, parts = parts, linked.select("g1", "g2", "shard").distinct().count()
        if last is not None and parts >= last:
            return before
        before = linked
        sizes = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}  # ``shards`` rows
        room = _choose([max(0, capacity - sizes.get(s, 0)) for s in range(shards)], F.col("shard"))
        tally = linked.groupBy("g1", "g2", "n", "shard").agg(F.count(F.lit(1)).alias("c")).withColumn("room", room)
        # of the shards with room, that which can gather most of the group
        gather = F.least(F.col("n"), F.col("c") + F.col("room"))
        fits = gather == F.col("n")
        rank = F.struct(fits.alias("fits"), (F.col("room") > 0).alias("open"), gather.alias("gather"), "c", F.xxhash64("g1", "shard").alias("tie"), "shard")
        best = tally.groupBy("g1", "g2", "n").agg(F.max(rank).alias("b"), F.collect_list(F.struct("shard", "c")).alias("in"))  # ``shards`` items at most
        here = F.element_at(F.filter("in", lambda x: x["shard"] == F.col("shard")), 1)["c"]
        want = F.when(F.col("b.fits") | (F.col("b.gather") > here), F.col("b.shard")).otherwise(F.col("shard"))
        # members of a group move together, but a group too large for a shard moves document by document
        bucket = F.pmod(F.when(F.col("n") * 64 > capacity, F.xxhash64("id", "g2")).otherwise(F.xxhash64("g2", "g1")), F.lit(BUCKETS)).cast("int")
        wish = cut(_meet(linked, best).withColumn("want", want).withColumn("bucket", bucket).drop("b", "in"))
        counts = wish.groupBy("shard", "want", "bucket").count().collect()  # shards * shards * BUCKETS rows at most
        size = [0] * shards
        asked: dict[tuple[int, int], list[int]] = {}
        for r in counts:
            size[r["shard"]] += r["count"]
            if r["shard"] != r["want"]:
                asked.setdefault((r["shard"], r["want"]), [0] * BUCKETS)[r["bucket"]] += r["count"]
        upto = _accepted(asked, size, capacity)
        moved = sum(sum(v[: upto[k]]) for k, v in asked.items())
        if not moved:
            return wish.drop("want", "bucket")
        quota = _choose([upto.get((a, b), 0) for a in range(shards) for b in range(shards)], F.col("shard") * shards + F.col("want"))
        linked = cut(wish.withColumn("shard", F.when(F.col("bucket") < quota, F.col("want")).otherwise(F.col("shard"))).drop("want", "bucket"))


def _upto(sizes: list[int], position):
    """The shard of a position from 0, where shards of ``sizes`` rows lie end to end."""
    shard = F.lit(len(sizes) - 1)
    for s in reversed(range(len(sizes) - 1)):
        shard = F.when(position < sum(sizes[: s + 1]), F.lit(s)).otherwise(shard)
    return shard


def end_to_end(linked: DataFrame, groups: DataFrame, shards: int, buckets: int) -> DataFrame:
    """``linked`` (with g1, g2, n) and ``shard``: its groups (g1, g2, n) one after another, cut into equal shares.

    Positions are worked out by group; only rows of groups that lie across a cut are numbered.
    """
    part = groups.withColumn("part", F.pmod(F.xxhash64("g2", "g1"), F.lit(buckets)).cast("int"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("g1", "g2").rowsBetween(Window.unboundedPreceding, -1))
    sums = part.groupBy("part").agg(F.sum("n").alias("rows"))
    ahead = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # ``buckets`` rows
    ahead = sums.select(F.col("part").alias("of_part"), F.coalesce(ahead, F.lit(0)).alias("ahead"))
    total = sums.agg(F.sum("rows")).first()[0] or 0
    share = [total // shards + (s < total % shards) for s in range(shards)]
    placed = part.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(ahead), F.col("part") == F.col("of_part"))
    placed = placed.withColumn("start", F.col("ahead") + F.col("inside")).select("g1", "g2", "n", "start", _upto(share, F.col("start")).alias("shard"), _upto(share, F.col("start") + F.col("n") - 1).alias("end"))
    rows = cut(_meet(linked.drop("shard"), placed))
    across = _numbered(rows.where("shard <> end"), buckets, ["g1", "g2"], "rank")
    across = across.withColumn("shard", _upto(share, F.col("start") + F.col("rank"))).drop("rank")
    return cut(rows.where("shard = end").unionByName(across).drop("start", "end"))


def _numbered(df: DataFrame, buckets: int, by: list[str], name: str) -> DataFrame:
    """``df`` with a number from 0 without gaps inside each value of ``by``.

    Rows are numbered inside hash buckets; the counts of the buckets before are added.
    """
    df = df.withColumn("part", F.pmod(F.xxhash64("id", "g1"), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*by, "part").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offset = counts.select(*[F.col(b).alias(f"of_{b}") for b in by], F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("before"))
    same = F.col("part") == F.col("of_part")
    for b in by:
        same = same & (F.col(b) == F.col(f"of_{b}"))
    inside = F.row_number().over(Window.partitionBy(*by, "part").orderBy("id", "g1", "g2"))
    rows = df.withColumn("inside", inside)
    return rows.join(offset, same).withColumn(name, (F.col("before") + F.col("inside") - 1).cast("long")).drop("before", "inside", "part", "of_part", *[f"of_{b}" for b in by])


def balanced_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8) -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot): shards equal in rows, with groups of equal texts kept together."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit("second"), text).alias("g2"))
    base = cut(base)
    total = base.count()
    groups = base.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = cut(groups)
    marked = cut(base.join(groups, ["g1", "g2"], "left"))
    target = [total // shards + (s < total % shards) for s in range(shards)]
    buckets = max(4 * partitions(df.sparkSession), total // NUMBERED)  # several for each task
    linked = propagate(end_to_end(marked.where("n is not null"), groups, shards, buckets), shards, total // shards)
    single = marked.where("n is null")
    size = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}  # ``shards`` rows
    room = [target[s] - size.get(s, 0) for s in range(shards)]
    # documents without links, in the order of their numbers, fill what room the shards have
    fill = _numbered(single.withColumn("all", F.lit(0)), buckets, ["all"], "number").drop("all")
    dealt = cut(linked.unionByName(fill.withColumn("shard", _upto(room, F.col("number"))).drop("number")))
    rows = _numbered(dealt, buckets, ["shard"], "slot")
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")
