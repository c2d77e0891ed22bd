"""Document fingerprints: a canonical exact digest, by DataFrame functions only.

The canonical form is NFKC, case-folded, NFKC again, with white space runs as one blank and none at
the ends; the Unicode steps call the ICU library that Spark ships with, in the JVM. The
fingerprint is 128 bits of xxhash of the canonical form. Rows are grouped by it, and inside a
bucket of several ids the canonical bytes are compared with those of the smallest id; rows that
differ from it (a hash collision) are grouped by their bytes.

Scale: buckets are counted on slim rows with map-side sums; only members of buckets with several
ids ship their text again. The ring of neighbours by id is made from slim rows in ranges of ids:
no global sort of texts and no single partition of rows.

Defined results: null text is the empty text; a null id has no neighbour, so its edited text loses
its last quarter and its likeness to the next is 0; repeated rows each return, and where rows
share an id the smallest text of it is the neighbour; a single document is its own neighbour; an empty table gives an empty
result. Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.llm.common import cut, partitions


#: Copies of one text that a task compares with the first, about.
SHARE = 256


def _java(cls: str, method: str, *args):
    return F.call_function("reflect", F.lit(cls), F.lit(method), *args)


def canonical(text):
    """The canonical form of a text column."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    compose = lambda t: _java("com.ibm.icu.text.Normalizer", "compose", t, F.lit(True))
    folded = compose(_java("com.ibm.icu.lang.UCharacter", "foldCase", compose(text), F.lit(True)))
    form = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)
    return F.trim(F.regexp_replace(form, r"[\s\p{Z}\x{85}]+", " "))


def digest(canon):
    """128 bits of xxhash of a canonical column, as 32 hex digits."""
    wide = F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), canon)), 16, "0"))
    return F.lower(wide)


def fingerprint(text):
    """The fingerprint of a text column."""
    return digest(canonical(text))


def likeness(a, b):
    """1 if two fingerprints are equal, else 0: an exact digest knows nothing between."""
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def _named(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.where("id is not null")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fingerprint, group_id): group_id is the smallest id of the same canonical bytes.

    Rows without an id are left out.
    """
    rows = _named(df, id_col, text_col)
    slim = cut(rows.select("id", fingerprint(F.col("text")).alias("fp")))
    # stored, so that the join with it deals out both sides itself and can split a bucket with very many ids
    first = cut(slim.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    salts = F.ceil(F.col("n") / SHARE).cast("int")
    members = cut(slim.join(first, "fp").select("id", "rep", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt")).distinct())
    member = rows.join(members, "id").select("id", "rep", "salt", canonical(F.col("text")).alias("mine"))
    known = first.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"))
    heads = rows.join(known, "id").select(F.col("id").alias("head"), "n", canonical(F.col("text")).alias("theirs"))
    # the first document's text goes to as many tasks as its copies need
    heads = heads.groupBy("head").agg(F.min("theirs").alias("theirs"), F.max(salts).alias("salts"))
    heads = heads.select("head", "theirs", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("of_salt"))
    compared = member.join(heads, (F.col("rep") == F.col("head")) & (F.col("salt") == F.col("of_salt")))
    same = compared.where(F.col("mine") == F.col("theirs")).select("id", F.col("rep").alias("group_id"))
    other = compared.where(F.col("mine") != F.col("theirs"))
    own = other.groupBy("rep", "mine").agg(F.min("id").alias("group_id"))
    apart = other.join(own, ["rep", "mine"]).select("id", "group_id")
    grouped = same.unionByName(apart).groupBy("id").agg(F.min("group_id").alias("group_id"))
    return slim.distinct().join(grouped, "id", "left").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), F.coalesce("group_id", "id").alias("group_id"))


def neighbours(rows: DataFrame) -> DataFrame:
    """Rows (id, next) for the distinct ``id`` of ``rows``; after the largest comes the smallest."""
    ranged = rows.select("id").distinct().repartitionByRange(partitions(rows.sparkSession), "id")
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("next", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    heads = ranged.groupBy("part").agg(F.min("id").alias("head"))  # one row for each partition
    heads = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.min("head").over(Window.partitionBy(F.lit(1)))).alias("after"))
    return inside.join(F.broadcast(heads), "part").select("id", F.coalesce("next", "after").alias("next"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and the likenesses between them.

    The edited text is the text with its last quarter replaced by as many of the next document's
    first code points, or by all it has.
    """
    rows = _named(df, id_col, text_col)
    size = rows.select("id", F.char_length("text").alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    ring = neighbours(rows).join(size, "id")
    asked = cut(ring.select(F.col("next").alias("id"), F.col("id").alias("to"), F.floor(F.col("n") / 4).cast("int").alias("k")))
    lent = rows.join(asked, "id").select("to", F.col("text"), "k")
    lent = lent.select("to", F.expr("substring(text, 1, k)").alias("head"), fingerprint(F.col("text")).alias("next_fp"))
    once = Window.partitionBy("to").orderBy("head", "next_fp")
    lent = lent.withColumn("copy", F.row_number().over(once)).where("copy = 1").select(F.col("to").alias("id"), "head", "next_fp")
    own = rows.join(lent, "id").select(F.col("id"), "text", "head", "next_fp")
    alone = df.where(F.col(id_col).isNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.lit("").alias("head"), F.lit(None).cast("string").alias("next_fp"))
    both = own.unionByName(alone).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 4) as int))"), F.expr("substring(head, 1, cast(floor(n_chars / 4) as int))"))
    out = both.select("id", "n_chars", fingerprint(F.col("text")).alias("fingerprint"), "next_fp", edited.alias("edited"))
    out = out.select("id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fp")
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.coalesce("next_fp", F.lit(""))).alias("near_next"))
