"""The queries opN_<name> over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm import bpe, chat, decontaminate, exact_digest, html_text, sharding, simhash, substring_dedup, suffix_dedup, toxicity
from chainloom.llm.sql import SQL  # noqa: F401
from chainloom.llm.common import table

#: Parameter: the vocabulary file, which must be readable on every executor; a folder of such files may be named instead.
VOCABULARY = f"{os.environ['TOKENIZER_DIR']}/byte_bpe_50k.json" if "TOKENIZER_DIR" in os.environ else str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles, linked at two differing bits or fewer."""
    rows = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=3, budget=2)
    digits = F.lower(F.hex("fp"))  # of little-endian bytes
    big = F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])
    return rows.select("doc_id", big.alias("fingerprint"), F.col("component").alias("component_id"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards of equal row counts, equal texts together."""
    rows = sharding.balanced_shards(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in passages of 50 words or more that start earlier elsewhere."""
    rows = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=50)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return rows.select("doc_id", "n_words", "n_repeated", spans.alias("spans"))


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as prompt and masked completions."""
    rows = chat.conversations(table(spark, sf_dir, "conversations")).withColumn("pair_id", F.shiftright(F.col("id").cast("long"), 1))
    even = F.pmod("id", F.lit(2)) == 0
    both = chat.preference_format(rows.where(even), rows.where(~even))
    spans = lambda c: F.when(F.col(c).isNotNull(), F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")).alias(c)
    return both.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", spans("chosen_spans"), "rejected", spans("rejected_spans"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents by a model that never saw held-out labels."""
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.with_scores(docs.select("doc_id", "text"), scorer)
    return rows.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    rows = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", F.col("main_text").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 20-word windows that start earlier elsewhere go."""
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=20, keep="digest")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a 10-word window of a benchmark item."""
    rows = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with the byte-level vocabulary and decoded again."""
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact fingerprints of texts and of edited texts, and the group of equal canonical texts."""
    docs = table(spark, sf_dir, "documents")
    groups = exact_digest.exact_groups(docs).select(F.col("doc_id").alias("group_doc"), F.col("fingerprint").alias("group_fp"), "group_id")
    rows = exact_digest.edited_fingerprints(docs)
    joined = rows.join(groups, (rows["doc_id"] == F.col("group_doc")) & (rows["fingerprint"] == F.col("group_fp")), "left")
    return joined.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id")


QUERIES = {"op1_simhash": op1_simhash, "op2_sharding": op2_sharding, "op3_suffix_dedup": op3_suffix_dedup, "op4_preference": op4_preference, "op5_toxicity": op5_toxicity, "op6_html_text": op6_html_text, "op7_substring_dedup": op7_substring_dedup, "op8_decontaminate": op8_decontaminate, "op9_bpe": op9_bpe, "op10_exact_digest": op10_exact_digest}
