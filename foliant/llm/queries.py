"""Queries of the subpackage: (spark, sf_dir) to a DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.brown import brown_scores
from foliant.llm.decontaminate import contamination, judged
from foliant.llm.frames import remainder, table
from foliant.llm import language, mixing, sharding
from foliant.llm.minhash import near_duplicates
from foliant.llm.pages import main_text
from foliant.llm.pseudonyms import pseudonymise
from foliant.llm.quality import quality_scores
from foliant.llm.subspace import near_vectors


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 3) == 1)


SHARD_BYTES, REPETITION, BLOCK_TOKENS = 1 << 20, 1.25, 20_000


def op2_extendible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes")


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is a stand-in; a real one comes from the caller."""
    out = pseudonymise(table(spark, sf_dir, "documents"), key=b"a key for tests")
    return out.select("doc_id", "text", F.size("kinds").cast("long").alias("n_replaced"), F.array_join("kinds", ",").alias("kinds"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), repetition=REPETITION, block_tokens=BLOCK_TOKENS).select("doc_id", "source", "n_tokens", "epoch", "block")


def op5_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_scores(table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    listed = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated")


def op8_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, whose source is the host, and pages; the trigrams are learnt from documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    key = lambda doc, page: F.struct(F.col(doc).cast("long").alias("doc_id") if doc else F.lit(None).cast("long").alias("doc_id"), F.col(page).cast("long").alias("page_id") if page else F.lit(None).cast("long").alias("page_id"))
    own = docs.select(*language.evidence(key("doc_id", None), F.col("text"), F.col("lang"), F.col("source")))
    web = pages.select(*language.evidence(key(None, "page_id"), language.page_text(F.col("html")), language.page_language(F.col("html")), language.page_host(F.col("url"))))
    out = language.identify(own.unionAll(web), language.fit(own))
    return out.select("key.doc_id", "key.page_id", "declared", "language", "confidence", "accepted")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_extendible, op3_pseudonyms, op4_mixing, op5_style_tree, op6_brown, op7_fm_index, op8_subspace, op9_language, op10_minhash)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_extendible": sharding.SQL.replace("{limit}", str(SHARD_BYTES)),
        "op4_mixing": mixing.SQL.replace("{repetition}", str(REPETITION)).replace("{block}", str(BLOCK_TOKENS)),
    }
