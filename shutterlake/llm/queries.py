"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import chat, divergence, latent, lm, mixing, negatives, order_minhash, packing, pii, pu_quality, quality_rules, sharding, toxicity
from shutterlake.llm.common import fold, table


def _held(modulus: int, left_out: int) -> Column:
    """Whether a row's id is of the fold that nothing is learned from; a row without id is not."""
    return F.coalesce(fold(F.col("doc_id"), modulus) == left_out, F.lit(False))


def _verdict(threshold: float) -> Column:
    return (F.col("score") >= threshold).cast("int").alias("predicted")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), _held(7, 2)
    out = lm.scored(docs, lm.Trained(docs.where(~held)))
    return out.select("doc_id", held.alias("held_out"), *out.columns[1:])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = _held(3, 1)
    out = toxicity.scored(docs, toxicity.trained(docs, labels, ~held)).withColumnRenamed(toxicity.SCORE, "score")
    return out.select("doc_id", held.alias("held_out"), "score", _verdict(toxicity.THRESHOLD))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.rewritten(docs.select("doc_id", "text", "lang", "source", "n_chars"), pii.key_of(spark)).select("doc_id", "text", F.size("found").alias("n_found"), "found")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), _held(5, 0)
    weights, _ = pu_quality.trained(docs, table(spark, sf_dir, "labels"), ~held)
    out = pu_quality.scored(docs, weights)
    return out.select("doc_id", held.alias("held_out"), "score", _verdict(pu_quality.THRESHOLD))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(negatives.relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % negatives.EVERY == 0)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op10_chat": chat.SQL, "op11_divergence": divergence.SQL, "op12_hard_negatives": negatives.SQL, "op13_mixing": mixing.SQL}
