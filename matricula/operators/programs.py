"""Program tables: verified requirements over given ones, ranks, comparison, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.names import fresh
from ..sources.scratch import materialize

#: Fixed value: the rank of what has none.
NO_RANK = 999


def overlay(programs: DataFrame, verified: DataFrame, keys: list[str]) -> DataFrame:
    """Given values replaced by verified ones wherever a verified row has the field, even as null.

    verified: the keys and `fields`, a map of field to text; a field that is absent says nothing.
    """
    joined = programs.join(verified.select(*keys, "fields"), keys, "left")
    replaced = {
        c: F.when(F.coalesce(F.map_contains_key("fields", c), F.lit(False)), F.col("fields")[c].try_cast(programs.schema[c].dataType)).otherwise(F.col(c))
        for c in programs.columns
        if c not in keys
    }
    return joined.select(*keys, *(v.alias(k) for k, v in replaced.items()))


def with_rank(programs: DataFrame, ranks: DataFrame, keys: list[str], source: str) -> DataFrame:
    joined = programs.join(ranks.select(*keys, "rank"), keys, "left")
    return joined.withColumns({"rank": F.coalesce("rank", F.lit(NO_RANK)), "rank_source": F.when(F.col("rank").isNotNull(), source)})


def top(ranks: DataFrame, n: int) -> DataFrame:
    """The best n ranks with their ties."""
    from pyspark.sql.window import Window as W

    return ranks.withColumn("place", F.rank().over(W.partitionBy("track").orderBy("rank"))).filter(F.col("place") <= n)


def or_default(left: DataFrame, known: DataFrame, keys: list[str], default: Column) -> DataFrame:
    """Every row with its known `value` (a struct), or the default one."""
    return left.join(known.select(*keys, "value"), keys, "left").withColumn("value", F.coalesce("value", default))


#: Orders of the table; a missing or zero figure comes last.
ORDERS = {"rank": "rank", "overall": "overall_rank", "acceptance": "acceptance_rate", "name": None}


def ordered(programs: DataFrame, mode: str = "rank", name: str = "university") -> DataFrame:
    column = ORDERS[mode]
    first = [] if column is None else [F.coalesce(F.nullif(F.col(column), F.lit(0)), F.lit(NO_RANK))]
    return programs.orderBy(*first, F.col(name))


def comparison(programs: DataFrame, ids: list, key: str = "program_id") -> DataFrame:
    """Chosen programs (five at most) in words."""
    asked = lambda c: F.when(F.col(c), "Required").when(~F.col(c), "Not Required").otherwise("N/A")
    said = lambda c, form: F.coalesce(F.format_string(form, F.col(c)), F.lit("N/A"))
    chosen = programs.filter(F.col(key).isin(*ids[:5]))
    return chosen.select(
        key,
        asked("gre_required").alias("gre"),
        F.when(F.coalesce("fee", F.lit(0)) == 0, "N/A").otherwise(F.concat(F.lit("$"), F.col("fee").cast("int"))).alias("fee"),
        F.when(F.coalesce("toefl_min", F.lit(0)) == 0, "N/A").otherwise(F.col("toefl_min").cast("string")).alias("toefl"),
        F.when(F.col("acceptance_rate").isNull(), "N/A").otherwise(said("acceptance_rate", "%.1f%%")).alias("acceptance"),
    )


def stale(programs: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    """Programs last updated before `days` ago, or never."""
    limit = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")
    return programs.filter(F.col("last_updated").isNull() | (F.col("last_updated") < limit))


def in_list_order(programs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Programs of a list (key, pos), in its order."""
    return programs.join(wanted.select(key, "pos"), key).orderBy("pos")


def without(programs: DataFrame, missing: DataFrame, key: str) -> DataFrame:
    return programs.join(missing.select(key).distinct(), key, "left_anti")


def faculty_of(programs: DataFrame, faculty: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Programs with their faculty (name, areas), those with the most areas first; none is an
    empty list."""
    people = faculty.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.size("areas")).alias("order"), "name", "areas"))).alias("faculty"))
    cut = F.slice("faculty", 1, most) if most else F.col("faculty")
    none = F.array().cast("array<struct<order:int,name:string,areas:array<string>>>")
    return programs.join(people.withColumn("faculty", cut), keys, "left").withColumn("faculty", F.coalesce("faculty", none))


def placed(rows: DataFrame, *order) -> DataFrame:
    """`rows` with their place in an order that no two share, from 1: ranges of the order are numbered
    each by itself, and moved by the rows before them."""
    part, earlier = fresh(rows.columns, "_part", "_before")
    ranged = materialize(rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias(part)))
    within = ranged.withColumn("place", F.row_number().over(W.partitionBy(part).orderBy(*order)))
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(part, (F.sum("n").over(W.orderBy(part)) - F.col("n")).alias(earlier))  # one row a range
    return within.join(F.broadcast(before), part).withColumn("place", F.col("place") + F.col(earlier)).drop(part, earlier)
