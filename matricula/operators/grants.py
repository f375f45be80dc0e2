"""Grants: running or not, and which author holds which."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.names import fresh
from ..functions.text import first_name, last_name, name_variants, normalize
from ..sources.scratch import materialize

#: Days that an end date must lie ahead, and years since the start that count.
AHEAD, YEARS = 365, 3


def status(as_of: str, start: str = "start_date", end: str = "end_date") -> Column:
    """is_active and how sure that is: known by the end date, estimated by the start, unknown."""
    today = F.to_date(F.lit(as_of))
    by_end = F.datediff(F.col(end), today) >= AHEAD
    by_start = F.datediff(today, F.col(start)) <= YEARS * 365
    active = F.when(F.col(end).isNotNull(), by_end).when(F.col(start).isNotNull(), by_start).otherwise(False)
    sure = F.when(F.col(end).isNotNull(), "known").when(F.col(start).isNotNull(), "estimated").otherwise("unknown")
    return F.struct(active.alias("is_active"), sure.alias("confidence"))


def with_status(grants: DataFrame, as_of: str) -> DataFrame:
    return grants.withColumn("__s", status(as_of)).select("*", "__s.is_active", "__s.confidence").drop("__s")


def confidence_breakdown(grants: DataFrame) -> DataFrame:
    """Per author: running grants that are known and estimated, and all unknown ones."""
    sure = lambda c: F.col("confidence") == c
    return grants.groupBy("author_id").agg(
        F.count_if(F.col("is_active") & sure("known")).alias("known"), F.count_if(F.col("is_active") & sure("estimated")).alias("estimated"), F.count_if(sure("unknown")).alias("unknown")
    )


def by_name(authors: DataFrame, awards: DataFrame) -> DataFrame:
    """(author_id, grant_id) where any spelling of the author's name is an award's investigator."""
    spelled = authors.select("author_id", F.explode(name_variants("name")).alias("v")).select("author_id", normalize("v").alias("pi")).distinct()
    named = awards.select("grant_id", F.explode("pi_names").alias("p")).select("grant_id", normalize("p").alias("pi")).distinct()
    return spelled.join(named, "pi").select("author_id", "grant_id").distinct()


def by_last_name(authors: DataFrame, awards: DataFrame, few: int = 10) -> DataFrame:
    """(author_id, grant_id, step): last name and institution; authors with fewer than `few` such
    awards also by first name and institution. Authors without an institution get none."""
    known = authors.filter("institution is not null").select("author_id", normalize("institution").alias("place"), normalize(last_name("name")).alias("last"), normalize(first_name("name")).alias("first"))
    named = awards.select("grant_id", normalize("institution").alias("place"), F.explode("pi_names").alias("p"))
    named = named.select("grant_id", "place", normalize(last_name("p")).alias("last"), normalize(first_name("p")).alias("first"))
    one = known.join(named.select("grant_id", "place", "last").distinct(), ["place", "last"]).select("author_id", "grant_id", F.lit(1).alias("step")).distinct()
    enough = one.groupBy("author_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= few)
    rest = known.join(enough, "author_id", "left_anti")
    two = rest.join(named.select("grant_id", "place", "first").distinct(), ["place", "first"]).select("author_id", "grant_id", F.lit(2).alias("step")).distinct()
    return one.unionByName(two)


#: Rows of one author that are put together in one pass; an author with more is put together by steps
#: over all tasks.
ONE_PASS = 200_000


def once(found: DataFrame, one_pass: int = ONE_PASS) -> DataFrame:
    """Each award once per author: rows with the same id, or with the same title and funder, are one
    award, also over several steps of both kinds; of these the earliest `step`, then the least id,
    title and funder is left. Null ids are no id, and null titles no title.

    found: author_id, grant_id, title, funder, step. Rows are dealt by author, and pass in the order of
    what is left; so a task keeps in mind the keys of one author, `one_pass` rows at most.
    """
    number, n = fresh(found.columns, "_row", "_n")
    spark, rows = found.sparkSession, found.withColumn(number, F.monotonically_increasing_id())
    large = materialize(found.groupBy("author_id").agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > one_pass).select(F.col("author_id").alias(n)))
    if large.isEmpty():
        return _once_each(rows, number, spark).select(*found.columns)
    among = F.col("author_id").eqNullSafe(F.col(n))
    few, many = (rows.join(F.broadcast(large), among, how) for how in ("left_anti", "left_semi"))  # one of `one_pass` rows at most
    return _once_each(few, number, spark).select(*found.columns).unionByName(_once_by_steps(many, number).select(*found.columns))


def _order(number: str) -> list[Column]:
    return [F.asc("step"), F.asc_nulls_last("grant_id"), F.asc_nulls_last("title"), F.asc("funder"), F.asc(number)]


def _once_each(rows: DataFrame, number: str, spark: SparkSession) -> DataFrame:
    """`once` for authors with few rows: of the rows of an award, the first in order is left."""
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "author_id").sortWithinPartitions("author_id", *_order(number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        author, above, where, ids, named = object(), [], [], {}, {}
        left: dict[int, tuple[pa.RecordBatch, list[int]]] = {}

        def root(k: int) -> int:
            while above[k] != k:
                above[k] = k = above[above[k]]
            return k

        def end() -> None:
            for k, (batch, i) in enumerate(where):
                if above[k] == k:
                    left.setdefault(id(batch), (batch, []))[1].append(i)

        def told() -> Iterator[pa.RecordBatch]:
            for batch, kept in left.values():
                yield batch.take(pa.array(kept, pa.int64()))
            left.clear()

        for batch in batches:
            for i, (who, grant, title, funder) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("author_id", "grant_id", "title", "funder")), strict=True)):
                if who != author:
                    end()
                    author, above, where, ids, named = who, [], [], {}, {}
                one = None if grant is None else ids.get(grant)
                two = None if title is None else named.get((title, funder))
                if one is None and two is None:
                    k = len(above)
                    above.append(k)
                    where.append((batch, i))
                elif one is None or two is None:
                    k = root(two if one is None else one)
                else:
                    one, two = root(one), root(two)
                    k = min(one, two)  # the earlier one is left
                    above[max(one, two)] = k
                if grant is not None:
                    ids[grant] = k
                if title is not None:
                    named[title, funder] = k
            yield from told()
        end()
        yield from told()

    return dealt.mapInArrow(run, rows.schema)


def _once_by_steps(found: DataFrame, number: str) -> DataFrame:
    """`once` for authors with many rows. Labels (at first a number of each row's own) go to the least of
    all rows that share an id or a title, until none changes."""
    label, new = fresh(found.columns, "_label", "_new")
    rows = materialize(found)
    now = rows.select(number, "author_id", "grant_id", F.when(F.col("title").isNotNull(), F.struct("title", "funder")).alias("named"), F.col(number).alias(label))
    while True:
        least = F.col(label)
        for key in ("grant_id", "named"):
            # rows without a key stand alone: their own number is part of what they are grouped by
            alone = F.when(F.col(key).isNull(), F.col(number))
            least = F.least(least, F.min(label).over(W.partitionBy("author_id", key, alone)))
        moved = materialize(now.withColumn(new, least))
        if moved.filter(F.col(new) < F.col(label)).isEmpty():
            break
        # a label leads on to the label that its own row has got
        onward = moved.select(F.col(number).alias(label), F.col(new).alias("_next"))
        now = moved.drop(label).withColumnRenamed(new, label).join(onward, label).drop(label).withColumnRenamed("_next", label)
    kept = rows.join(now.select(number, label), number).withColumn(new, F.row_number().over(W.partitionBy(label).orderBy(*_order(number)))).filter(F.col(new) == 1)
    return kept.drop(label, new)


def for_authors(authors: DataFrame, nih: DataFrame, nsf: DataFrame, as_of: str) -> DataFrame:
    """Every author with its awards of both dumps (null where there is none), dated and judged."""
    columns = ["grant_id", "title", "funder", "start_date", "end_date"]
    pairs = by_name(authors, nih).withColumn("step", F.lit(1)).join(nih.select(*columns), "grant_id").unionByName(by_last_name(authors, nsf).join(nsf.select(*columns), "grant_id"))
    return authors.select("author_id").join(with_status(once(pairs), as_of), "author_id", "left")
