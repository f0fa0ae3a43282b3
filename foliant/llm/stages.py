"""The corpus pipeline's stages. All but the last return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import language
from foliant.llm.decontaminate import contamination, judged
from foliant.llm.frames import cut, folder, table
from foliant.llm.minhash import near_duplicates
from foliant.llm.mixing import mixed
from foliant.llm.sharding import assign_shards

REPETITION, BLOCK_TOKENS, SHARD_BYTES = 1.25, 20_000, 1 << 20


def _packed(docs: DataFrame, *more: Column) -> DataFrame:
    """docs as one column, so that no name can clash, beside further ones."""
    return docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("doc"), *more)


def _row() -> Column:
    """64 bits of a row's id and text: rows that share an id, or have none, are judged one by one."""
    return F.xxhash64(F.col("doc_id").cast("string"), F.col("text"))


def _without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """docs without the rows whose key is in gone (key). gone is broadcast up to a million keys."""
    gone = cut(gone.distinct())
    few = gone.count() <= 1_000_000
    return _packed(docs, key.alias("key")).join(F.broadcast(gone) if few else gone, "key", "left_anti").select("doc.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language can't be told: no letters (so null and blank texts), or no language with half the posterior, where none of them is a hypothesis. lang stays as declared."""
    rows = docs.select(*language.evidence(_row(), F.col("text"), F.col("lang"), F.col("source")))
    return _without(docs, _row(), language.identify(rows, language.fit(rows)).where("not accepted").select("key"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays: the one whose id is smallest. Rows that share an id stay or go together; rows without an id, and null and blank texts, stay."""
    gone = near_duplicates(docs, size=5, percent=80).where("not kept").select(F.col("doc_id").alias("key"))
    return _without(docs, F.col("doc_id").cast("long"), gone)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which a twentieth of the words or more are in benchmark windows. Null and blank texts stay."""
    found = judged(contamination(docs.select(_row().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")))
    return _without(docs, _row(), found.where("contaminated").select(F.col("doc_id").alias("key")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their mixture weights: as many tokens as before, no source more than 1.25 times over. A null source is a source."""
    return mixed(_packed(docs, "doc_id", "text", "source"), repetition=REPETITION, block_tokens=BLOCK_TOKENS).select("doc.*")


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard; no shard exceeds the byte limit unless one document does."""
    return assign_shards(docs, SHARD_BYTES)


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]


def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Apply STAGES in order, each written to the shared folder and read again."""
    top = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
