"""The corpus pipeline: toxic documents out, one of each near-duplicate class, no benchmark items, pseudonyms, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import latent, order_minhash, packing, pii, toxicity
from shutterlake.llm.common import table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below toxicity.THRESHOLD by a model of all labelled documents of the tables."""
    model = toxicity.trained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    scored = toxicity.scored(docs, model)
    return scored.where(F.col(scored.columns[-1]) < toxicity.THRESHOLD).select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.deduplicated(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return latent.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.rewritten(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", toxic_out), ("near-dedup", near_copies_out), ("decontamination", benchmark_out), ("pii", personal_data_out), ("packing", packed)]

#: Trained scores, sketches and a tokeniser are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
