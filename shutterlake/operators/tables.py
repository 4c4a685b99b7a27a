"""Changes of tables as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose keys are new."""
    return target.unionByName(rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*target.columns))


def single(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key: of several the largest by its other columns, in their order."""
    other = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(*other)).alias("__row")).select(*keys, *(F.col("__row").getField(c).alias(c) for c in other)) if other else rows.distinct()


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows take the place of target rows with their keys; of rows with one key, that of ``single``."""
    rows = single(rows, keys)
    return target.join(rows.select(*keys), keys, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def replace(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of all rows of a key: those of the target go, the new ones come, as many as they are."""
    return target.join(rows.select(*keys), keys, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def patch(target: DataFrame, rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sets ``columns`` where ``rows`` has a value; of rows with one key, that of ``single``."""
    new = single(rows.select(*keys, *columns), keys).select(*keys, *(F.col(c).alias(f"__new_{c}") for c in columns))
    joined = target.join(new, keys, "left")
    return joined.select(*(F.coalesce(f"__new_{c}", c).alias(c) if c in columns else c for c in target.columns))


def delete(target: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return target.join(ids.select(F.col("id").alias(key)), key, "left_anti")


def soft_delete(media: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    marked = ids.select("id", F.lit(at).cast("bigint").alias("deleted_at")).distinct()
    return patch(media, marked, ["id"], ["deleted_at"])
