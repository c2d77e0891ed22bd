"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.llm import bpe, decontaminate, near_copies, substring_dedup, toxicity
from chainloom.llm.common import cut, shared_dir, table
from chainloom.llm.queries import VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies: sets of 5-word shingles that share 0.8 of their union or more.
SHINGLE, LIKENESS = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go.

    Null and empty texts hold no evidence and stay, repeated rows share their fate, long texts are read whole; an empty table stays empty.
    """
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs.select(*COLUMNS), scorer).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Null and empty texts are copies of each other; long texts are compared whole. Of rows with one id and one text one stays, and
    all texts of an id that stays do; rows without an id stay, since no id can name them. An empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    group = cut(near_copies.near_copies(docs, shingle=SHINGLE, likeness=LIKENESS))
    copies = group.where("component <> doc_id").select("doc_id").distinct()
    again = group.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    left = docs.join(copies, "doc_id", "left_anti")
    first = Window.partitionBy("doc_id", "text").orderBy("lang", "source", "n_chars")
    some = left.join(again, "doc_id", "left_semi").withColumn("copy", F.row_number().over(first)).where("copy = 1")
    return some.select(*COLUMNS).unionByName(left.join(again, "doc_id", "left_anti").select(*COLUMNS))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by 20-word windows that start earlier elsewhere go; all documents stay.

    A text that loses nothing stays as it is, white space and null included; what is left of the others is joined by
    blanks. Rows without an id lose nothing. An empty table stays empty.
    """
    rows = substring_dedup.substring_dedup(docs.select(*COLUMNS), window=20, keep="whole", carry=["lang", "source", "n_chars"])
    n = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return rows.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a 10-word window of a benchmark item go.

    Null and empty texts stay; an item of fewer words is one window; repeated rows and rows without an id are judged by their text.
    """
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), size=10)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them.

    Null is the empty text, with no ids; repeated rows each return; an empty table gives no rows.
    """
    return bpe.bpe_encode(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: Scoring, trie joins and merges are not expressible in SQL; a brute-force test covers the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    to = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{to}/{k}")
        docs = spark.read.parquet(f"{to}/{k}")
    return docs
