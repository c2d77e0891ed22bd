"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the session is
    local (tests), a temporary folder is taken.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    conf = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(conf)
    return conf


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and forget its lineage, so a lost executor costs no rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text):
    """``text`` with A-Z lower-cased and every other character as it is.

    A text of one byte per character takes the fast path, where ``lower`` does just that.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))
