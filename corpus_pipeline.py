"""Documents → packed training sequences, one stage after the other, each stage a Parquet table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zonemill.llm import langid, neardup, packing, pii, quality
from zonemill.llm.store import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
LEAST_QUALITY = 0.5
LEAST_LANGUAGE = 0.2  # below, no language fits; texts without letters have 0


def _remainder(divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the learned languages stay; learned from the given documents with a language, outside the held-out quarter."""
    model = langid.train(docs.select("doc_id", "text", "lang"), _remainder(4) != 2)
    found = langid.identified(docs, model).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE))
    return found.select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose quality score is 0.5 or more stay; learned from ``labels``, outside the held-out third."""
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), _remainder(3) != 1)
    return quality.scored(docs, model).where(F.col("quality_score") >= LEAST_QUALITY).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) one row stays: of the smallest doc_id, and of several
    texts with that the one of the smallest hash. Rows without doc_id or without words are in no group and stay."""
    found = stored(neardup.near_duplicates(docs, percent=80, keyed=True).where("doc_id is not null and n_shingles > 0"), "near_dedup")
    row = ["doc_id", "text_key"]
    firsts = found.where("kept").groupBy(*row).count()  # rows of the group's smallest doc_id
    several = firsts.groupBy("doc_id").agg(F.min("text_key").alias("first_key"), F.count("*").alias("texts")).where("texts > 1")
    others = firsts.join(several, "doc_id").where("text_key <> first_key").select(*row)
    dropped = found.where("not kept").select(*row).distinct().unionByName(others)
    repeated = firsts.where("count > 1").select(*row)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key")).join(dropped, row, "left_anti")
    one = rows.join(repeated, row, "left_semi").dropDuplicates(row)
    return rows.join(repeated, row, "left_anti").unionByName(one).select([F.col("doc").getField(c).alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts; every document stays."""
    return pii.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut into sequences of 4096 ids, every window near the proportions of the sources."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("quality", quality_filter), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packed),
]
# Boosted trees, support vector machines and tokenizers can't be written in SQL; tests compare with plain code instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
