"""Tables whose rows belong to owners, replaced owner by owner, as a whole or not at all.

A replacement writes its owners' new rows, then the owners' names, then a row that says so, each into a folder of its number. A
reader takes only numbers that have this row, and of each owner's rows those of the last such number: so it sees the old rows or
the new, never both, and never a part. Writing a number again writes over what a broken write
left, so a micro-batch that runs twice changes nothing (its number is the batch's). Owners without new rows are emptied. No old
file is read or written by a replacement, so its cost is that of its own rows; ``compacted`` brings all into one number.

Defined results: a null owner is an owner like others; repeated rows stay; a table without any number is empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = "__number"


def _done(spark: SparkSession, path: str) -> list[int]:
    """The numbers that are written in whole; a row for each."""
    try:
        return sorted(r[1] for r in spark.read.schema(f"ok boolean, {_NUMBER} int").parquet(f"{path}/done").collect())
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def replace(path: str, rows: DataFrame, owners: DataFrame, number: int) -> None:
    """Puts ``rows`` in the place of all rows of ``owners`` (one column, that of their name in ``rows``); ``rows`` are of these owners only."""
    (key,) = owners.columns
    own = owners.distinct()
    fit = rows.join(own.withColumnRenamed(key, "__owner"), F.col(key).eqNullSafe(F.col("__owner")), "left_semi")
    fit.write.mode("overwrite").parquet(f"{path}/rows/{_NUMBER}={number}")
    own.write.mode("overwrite").parquet(f"{path}/owners/{_NUMBER}={number}")
    rows.sparkSession.range(1).select(F.lit(True).alias("ok")).write.mode("overwrite").parquet(f"{path}/done/{_NUMBER}={number}")


def current(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The rows of all owners as of now."""
    done = _done(spark, path)
    empty = spark.createDataFrame([], schema)
    if not done:
        return empty
    kind = empty.schema[key].dataType.simpleString()
    owners = spark.read.schema(f"`{key}` {kind}, {_NUMBER} int").parquet(f"{path}/owners").where(F.col(_NUMBER).isin(done))
    last = owners.groupBy(F.col(key).alias("__owner")).agg(F.max(_NUMBER).alias("__last"))
    rows = spark.read.schema(f"{schema}, {_NUMBER} int").parquet(f"{path}/rows").where(F.col(_NUMBER).isin(done))
    return rows.join(last, F.col(key).eqNullSafe(F.col("__owner")) & (F.col(_NUMBER) == F.col("__last")), "left_semi").select(*empty.columns)


def compacted(spark: SparkSession, path: str, schema: str, key: str, number: int) -> None:
    """Writes all owners' rows anew as ``number``, after which the folders of smaller numbers are not read for any row."""
    now = current(spark, path, schema, key)
    done = _done(spark, path)
    owners = spark.read.schema(f"`{key}` {now.schema[key].dataType.simpleString()}, {_NUMBER} int").parquet(f"{path}/owners").where(F.col(_NUMBER).isin(done)).select(key) if done else now.select(key)
    replace(path, now, owners, number)


def replacing(path: str, key: str, rebuilt: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: replaces the rows of the batch's owners by what ``rebuilt`` makes of these owners."""

    def write(batch: DataFrame, number: int) -> None:
        owners = batch.select(key).distinct()
        replace(path, rebuilt(owners), owners, number)

    return write
