"""Unions, intersections and copies, where which row stays is decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from .registry import first_by


def first_of(sources: list[DataFrame], key: str, order: str = "pos") -> DataFrame:
    """The union of sources; of equal keys the row of the earlier source stays."""
    every = None
    for k, df in enumerate(sources):
        part = df.withColumn("__source", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    return first_by(every, [key], F.asc("__source"), F.asc(order)).drop("__source")


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def listed(*sources: DataFrame, repeats: bool = True) -> DataFrame:
    """The rows of several lists, one after the other, with repeats or without."""
    every = sources[0]
    for more in sources[1:]:
        every = every.unionByName(more)
    return every if repeats else every.distinct()


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of `a` whose key `b` has."""
    return a.join(b.select(key).distinct(), key, "left_semi")


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(key).distinct(), key, "left_anti")


def by_prefix(rows: DataFrame, text: str = "text", n: int = 100, *order) -> DataFrame:
    """One row for each start of the normalised text."""
    return first_by(rows, [F.substring(normalize(text), 1, n)], *order)


def distinct_content(rows: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The first row, by key, of each distinct text; texts meet as hashes."""
    hashed = rows.withColumn("content_hash", F.sha2(F.col(text), 256))
    first = hashed.groupBy("content_hash").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
    return first
