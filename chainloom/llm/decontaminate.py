"""Benchmark decontamination with a broadcast hash set of test n-grams; DataFrame functions only.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. The windows
of an item are its runs of ``size`` consecutive words; a shorter item that has words is one window.
Document windows are hashed (hashes of words are put together two by two, to 2, 4, 8 and so on), probed in the hash set of item
windows, and hits are verified word for word before they count.

Scale: the item side is broadcast only if its windows and item lists take ``BROADCAST_BYTES`` at most, which is counted; beyond,
the same join shuffles ids, places and hashes, and candidates meet their document's words again for the verification. The scan
of the documents has no other shuffle: only hits and slim rows (id, text hash, word count) meet again. The list of
the items that share a window is one value.

Defined results: null text has no words; long texts are read whole; an item without words has no window; repeated rows each
return with the same figures; rows with a null id return with their own hits; an empty benchmark hits nothing, and an empty table of
documents gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import ascii_lower, cut

SIZE = 10
#: Bytes of item windows, with the items that hold them, that may be broadcast.
BROADCAST_BYTES = 64 << 20
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    """The words of a text column, as an array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _BETWEEN), "")


def _side_by_side(a, b, apart: int):
    """Hashes of each item of ``a`` with the item of ``b`` that is ``apart`` places on."""
    n = F.greatest(F.size(b) - apart, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, apart + 1, n), lambda x, y: F.xxhash64(x, y))


def with_hashes(df: DataFrame, sizes: list[int]) -> DataFrame:
    """``df`` (with words ``w``) and, for each size k, a column ``h_k``: the hashes of all windows of k words."""
    kept = df.columns
    df = df.withColumn("h_1", F.transform("w", lambda x: F.xxhash64(x)))
    power = 1
    while 2 * power <= max(sizes):
        df = df.withColumn(f"h_{2 * power}", _side_by_side(F.col(f"h_{power}"), F.col(f"h_{power}"), power))
        power *= 2
    for k in sizes:
        have = 0
        for bit in reversed(range(k.bit_length())):
            if not k >> bit & 1:
                continue
            if have:
                df = df.withColumn(f"h_{have + (1 << bit)}", _side_by_side(F.col(f"h_{have}"), F.col(f"h_{1 << bit}"), have))
            have += 1 << bit
    return df.select(*kept, *[f"h_{k}" for k in sizes])


def _places(k: int):
    """Structs (start, size, hash) for the windows of k words; start counts from 1."""
    return F.transform(f"h_{k}", lambda x, i: F.struct((i + 1).alias("start"), F.lit(k).alias("size"), x.alias("hash")))


def item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows (size, hash, gram, items): the distinct windows and the items (as strings) that hold each."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    rows = rows.withColumn("size", F.least(F.size("w"), F.lit(size))).where("size > 0")
    rows = rows.select("item", "size", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    rows = rows.select("item", "size", F.expr("slice(w, at, size)").alias("gram"))
    rows = rows.groupBy("size", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = with_hashes(rows.withColumn("w", F.col("gram")), list(range(1, size + 1)))
    return rows.select("size", F.element_at(F.array(*[F.get(f"h_{k}", F.lit(0)) for k in range(1, size + 1)]), F.col("size")).alias("hash"), "gram", "items")


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, most: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (id, key, start, size, items) of verified hits; start counts words from 1.

    ``key`` hashes the text, so that rows that share an id but not a text stay apart. Item windows of up to ``most`` bytes
    are broadcast.
    """
    grams = cut(item_windows(items, item_id, item_text, size))
    held = lambda c: F.octet_length(F.array_join(c, "")) + 24 * F.size(c)
    found = grams.groupBy("size").agg(F.sum(held("gram") + held("items") + 64).alias("bytes")).collect()  # at most ``size`` rows
    few = sum(r["bytes"] for r in found) <= most
    short = sorted(r["size"] for r in found if r["size"] < size)
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), words(F.col(text_col)).alias("w"))
    hits = None
    # outer explodes, since others put their arrays into a filter on the scan as well;
    # full windows in one scan, all the shorter sizes, which only short items have, in another
    for sizes in ([size] if len(found) > len(short) else [], short):
        if not sizes:
            continue
        each, passed = with_hashes(base, sizes), ["id", "key", *(["w"] if few else [])]
        if len(sizes) == 1:
            each = each.select(*passed, F.posexplode_outer(f"h_{sizes[0]}").alias("start", "hash"))
            each = each.select(*passed, (F.col("start") + 1).alias("start"), F.lit(sizes[0]).alias("size"), "hash")
        else:
            each = each.select(*passed, F.inline_outer(F.concat(*map(_places, sizes))))
        side = grams.where(F.col("size").isin(sizes)).withColumnRenamed("size", "gram_size").withColumnRenamed("hash", "gram_hash")
        got = each.join(F.broadcast(side) if few else side.hint("merge"), (F.col("hash") == F.col("gram_hash")) & (F.col("size") == F.col("gram_size")))
        if not few:  # words did not travel
            candidates = got.select(F.col("id").alias("of"), F.col("key").alias("of_key"), "start", "size", "gram", "items").distinct()
            got = base.join(candidates, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")))
        # as an equality this would become a key of the join, worked out for every window
        same = F.array_contains(F.array(F.slice("w", F.col("start"), F.col("size"))), F.col("gram"))
        got = got.where(same).select("id", "key", "start", "size", "items")
        hits = got if hits is None else hits.unionByName(got)
    if hits is None:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"id {kind}, key bigint, start int, size int, items array<string>")
    return hits


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """For each row of ``docs``: (id, n_words, n_hit, items, spans); spans are [first word, words]."""
    hits = benchmark_hits(docs, items, id_col, text_col, item_id, item_text, size)
    by_doc = hits.groupBy("id", "key").agg(F.collect_set(F.struct("start", "size")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    by_doc = by_doc.select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key"), "spans", "items", F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))))).alias("n_hit"))
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    rows = slim.join(by_doc, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    return rows.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,size:int>>")).alias("spans"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they are."""
    hits = benchmark_hits(docs, items, id_col, text_col, item_id, item_text, size).select(F.col("id").alias("hit_id"), F.col("key").alias("hit_key")).distinct()
    key = F.xxhash64(docs[text_col].cast("string"))
    return docs.join(hits, docs[id_col].eqNullSafe(F.col("hit_id")) & (key == F.col("hit_key")), "left_anti")
