"""A pipeline over ``documents``: quality rules, near-duplicates, repeated strings, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  Columns other than doc_id, text and n_chars ride along unseen in one
struct, so that their names cannot clash with a stage's own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, decontaminate, near_dedup, quality, suffix_dedup
from lumenframe.llm.shared import prepare, stored

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): all columns of ``docs`` in ``row`` but the text."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*rest).alias("row"))


def _unpacked(rows: DataFrame, docs: DataFrame, **replaced) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    old = {c: rows["text"] if c == "text" else rows["row"].getField(c) for c in docs.columns}
    return rows.select(*(replaced.get(c, old[c]).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list."""
    prepare(spark)
    rules = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = quality.judge(_packed(docs), rules).where("kept")
    return _unpacked(kept, docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id."""
    prepare(spark)
    rows = _packed(docs).withColumn("text_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    judged = near_dedup.near_duplicates(rows.select("doc_id", "text", "text_key"), key="text_key").where("kept")
    # Rows that share an id and its words are copies too: the one with the smallest digest stays.
    kept = judged.groupBy("doc_id", F.coalesce(F.hex("class"), F.col("text_key")).alias("group")).agg(F.min("text_key").alias("text_key")).select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["kept_id"]) & (rows["text_key"] == kept["kept_key"]), "left_semi")
    return _unpacked(rows.dropDuplicates(["doc_id", "text_key"]), docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 50-byte strings that start in an earlier document too; whole characters only.  All rows stay."""
    prepare(spark)
    cut = suffix_dedup.repeated_strings(_packed(docs))
    cut = cut.select("doc_id", F.col("kept_text").alias("text"), "row", "n_removed")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(cut["row"].getField("n_chars")) if "n_chars" in docs.columns else None
    return _unpacked(cut, docs, **({} if n_chars is None else {"n_chars": n_chars}))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    prepare(spark)
    found = decontaminate.with_leaks(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(found.where(F.size("leaks") == 0), docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids of each whole text."""
    prepare(spark)
    return bpe.round_trip(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, ids="token_ids")


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("repeated strings", suffix_dedup_stage),
    ("benchmark passages", decontamination_stage),
    ("tokens", tokens_stage),
]
#: Similarity, decision lists and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
