"""Stored tables that take upserts: Parquet dealt by a hash of the key into a fixed number of buckets.

An upsert reads and rewrites only the buckets that its rows fall into. Their new rows are first
written aside, then take the old ones' place by a dynamic partition overwrite, whose files become
visible when the job commits; the same batch again leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import upsert
from .scratch import materialize

#: Buckets of a stored table; about one for each 128 MB that it may come to hold.
BUCKETS = 64


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """A new stored table; no column may be named `bucket`."""
    _bucketed(rows, keys, buckets).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert_stored(path: str, new: DataFrame, keys: list[str], order: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Put the rows of `new` into the stored table by key (of equal keys the last by `order`); the
    buckets that were rewritten."""
    spark = new.sparkSession
    new = materialize(_bucketed(new, keys, buckets))
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # `buckets` at most
    if not touched:
        return []
    old = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
    merged = materialize(upsert(old.select(*new.columns), new, keys, order))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched
