"""The program registry: current requirement sets, search, details, storage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.names import fresh
from ..sources.scratch import materialize
from .programs import placed

#: What a round is called that has none, and the open statuses.
NO_ROUND = "-"
APPROVED, NEEDS_REVIEW, DRAFT = "approved", "needs_review", "draft"


def first_by(df: DataFrame, keys: list[str | Column], *order: Column) -> DataFrame:
    """The first row of each group in a total order."""
    ranked = df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("__n = 1").drop("__n")


def current_requirements(sets: DataFrame) -> DataFrame:
    """The latest approved set of each track, term and round; no round is a round of its own."""
    approved = sets.filter(F.col("status") == APPROVED)
    return first_by(approved, ["track_id", "term_year", F.coalesce("round_id", F.lit(NO_ROUND))], F.desc("last_verified_at"), F.asc("id"))


def current_requirement(sets: DataFrame, track_id, term_year, round_id=None) -> DataFrame:
    """The current set of one track, term and round."""
    same_round = F.col("round_id").isNull() if round_id is None else F.col("round_id") == F.lit(round_id)
    return current_requirements(sets.filter((F.col("track_id") == F.lit(track_id)) & (F.col("term_year") == F.lit(term_year)) & same_round))


def program_search(institutions: DataFrame, programs: DataFrame, tracks: DataFrame, sets: DataFrame) -> DataFrame:
    """One row per program: its modes of study, and what its approved sets say of it.

    Sets are counted per track before they meet the programs, so that the join stays one to one.
    """
    per_track = sets.filter(F.col("status") == APPROVED).groupBy("track_id").agg(
        F.max("last_verified_at").alias("verified"), F.sum("confidence").alias("total"), F.count("confidence").alias("n")
    )
    per_program = (
        tracks.join(per_track, "track_id", "left")
        .groupBy("program_id")
        .agg(
            F.array_sort(F.collect_set("modality")).alias("modalities"),
            F.array_sort(F.collect_set("schedule")).alias("schedules"),
            F.max("verified").alias("last_verified_at"),
            F.sum("total").alias("total"),
            F.sum("n").alias("n"),
        )
    )
    or_default = lambda column, value: F.when(F.size(F.coalesce(column, F.array())) == 0, F.array(F.lit(value))).otherwise(F.col(column))
    average = F.when(F.col("n") > 0, (F.col("total") / F.col("n")).cast("decimal(3,2)")).otherwise(F.lit("0.50").cast("decimal(3,2)"))
    return (
        programs.join(institutions, "institution_id")
        .join(per_program, "program_id", "left")
        .select(
            "program_id",
            "program_name",
            "degree",
            "priority_tier",
            "institution_name",
            "country",
            or_default("modalities", "in_person").alias("modalities"),
            or_default("schedules", "full_time").alias("schedules"),
            "last_verified_at",
            average.alias("confidence"),
            F.coalesce("n", F.lit(0)).alias("n_sets"),
        )
    )


def search_filter(found: DataFrame, min_confidence: float = 0.7, text: str | None = None, degree: str | None = None, country: str | None = None, modality: str | None = None, literal: bool = False) -> DataFrame:
    """Programs that meet every given condition; `text` is part of a name, institution or degree.

    Its `%` and `_` are wildcards unless `literal`.
    """
    wanted = [F.col("confidence") >= F.lit(min_confidence)]
    if text:
        part = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") if literal else text
        wanted.append(reduce(Column.__or__, (F.col(c).ilike(f"%{part}%") for c in ("program_name", "institution_name", "degree"))))
    wanted += [F.col(c) == F.lit(v) for c, v in (("degree", degree), ("country", country)) if v]
    if modality:
        wanted.append(F.array_contains("modalities", modality))
    return found.filter(reduce(Column.__and__, wanted))


def page(found: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page by tier, confidence and date; the program id settles ties."""
    ordered = found.orderBy(F.asc("priority_tier"), F.desc_nulls_first("confidence"), F.desc_nulls_first("last_verified_at"), F.asc("program_id"))
    return ordered.offset((number - 1) * size).limit(size)


#: The order of a search: (column, whether the greatest comes first); the id settles ties.
PAGE_ORDER = (("priority_tier", False), ("confidence", True), ("last_verified_at", True), ("program_id", False))


def _keys() -> list[Column]:
    """The order as columns of which each ascends and holds no null: greatest-first columns with
    nulls first, the others with nulls first as well."""
    out = []
    for c, down in PAGE_ORDER:
        value = F.col(c)
        if down:
            value = -(F.unix_micros(value) if c.endswith("_at") else value.cast("decimal(20,6)"))
        out += [value.isNotNull().cast("int"), value]
    return out


def after(found: DataFrame, border: dict, size: int = 20) -> DataFrame:
    """The `size` rows that follow a row (its values of PAGE_ORDER) in a search: sought by its values,
    so that nothing before it is sorted or passed over."""
    last = found.sparkSession.createDataFrame([tuple(border[c] for c, _ in PAGE_ORDER)], found.select(*(c for c, _ in PAGE_ORDER)).schema)
    place = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(_keys())))
    behind = found.withColumn("_place", place).join(F.broadcast(last.select(place.alias("_last"))), F.col("_place") > F.col("_last"))  # one row
    return behind.drop("_place", "_last").orderBy(*_keys()).limit(size)


def borders(found: DataFrame, size: int = 20) -> DataFrame:
    """page, the last row before it (`last`) and its own last row (`end`) for each page of a search, by
    numbers that ranges of the order are given, each by itself."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(_keys())]
    numbered = placed(found.select(*keys), *(f"k{i}" for i in range(len(keys))))
    rows = numbered.filter((F.col("place") % size == 0)).select(F.expr(f"place div {size}").alias("page"), F.struct(*(f"k{i}" for i in range(len(keys)))).alias("end"))
    ends = rows.select((F.col("page") + 1).alias("page"), F.col("end").alias("last"))
    return rows.join(ends, "page", "full")


def all_pages(found: DataFrame, size: int = 20) -> DataFrame:
    """Every row of a search with its page, each page sought between its borders. Rows are dealt by
    the first column of the order."""
    place = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(_keys())))
    rows = found.withColumn("_place", place)
    starts = borders(found, size).filter("end is not null").select("page", F.col("end").alias("_place"))
    kind = {c: F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns}
    both = rows.withColumn("page", F.lit(None).cast("long")).unionByName(starts.select(*kind.values(), "_place", "page"))
    ranged = both.repartitionByRange("_place").withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged)
    # a row's page follows the last border before it: in its range, or at the end of the ranges before
    tops = ranged.filter("page is not null").groupBy("_part").agg(F.max("page").alias("top"))
    whole = ranged.select("_part").distinct().join(tops, "_part", "left")
    before = whole.select("_part", F.coalesce(F.max("top").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
    order = W.partitionBy("_part").orderBy("_place", F.asc_nulls_first("page"))
    seen = F.max("page").over(order.rowsBetween(W.unboundedPreceding, -1))
    out = ranged.join(F.broadcast(before), "_part").withColumn("_page", F.coalesce(seen, F.col("_before")) + 1)
    return out.filter("page is null").drop("page", "_place", "_part", "_before").withColumnRenamed("_page", "page")


def create_functions(spark, sets: DataFrame, view: str = "requirement_sets") -> None:
    """The table function get_current_requirement(track, term, round) of SQL, over a view of the sets:
    the latest approved set, of a null round those without one."""
    sets.createOrReplaceTempView(view)
    kinds = {c: sets.schema[c].dataType.simpleString() for c in ("track_id", "term_year", "round_id", "id")}
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION get_current_requirement(track {kinds["track_id"]}, term {kinds["term_year"]}, round {kinds["round_id"]})
        RETURNS TABLE (id {kinds["id"]}, last_verified_at TIMESTAMP)
        RETURN SELECT best.id, best.last_verified_at FROM (SELECT min_by(struct(s.id, s.last_verified_at), struct(s.last_verified_at IS NOT NULL, -unix_micros(s.last_verified_at), s.id)) AS best
          FROM {view} s WHERE s.status = '{APPROVED}' AND s.track_id = track AND s.term_year = term AND coalesce(s.round_id, '{NO_ROUND}') = coalesce(round, '{NO_ROUND}'))""")


def variant_fields(rows: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows with fields of a JSON text, by path and type; the text is parsed once, to a VARIANT. What
    is no JSON, lacks the path or has no such type is null."""
    parsed, = fresh(rows.columns, "_variant")
    read = rows.withColumn(parsed, F.try_parse_json(column))
    return read.withColumns({name: F.try_variant_get(parsed, path, kind) for name, (path, kind) in fields.items()}).drop(parsed)


def page_count(found: DataFrame, size: int = 20) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).alias("pages"))


def program_stats(found: DataFrame) -> DataFrame:
    return found.agg(
        F.count(F.lit(1)).alias("programs"),
        F.count_distinct("institution_name").alias("institutions"),
        F.count_distinct("country").alias("countries"),
        F.avg("confidence").cast("double").alias("avg_confidence"),
        F.count_if(F.col("confidence") >= 0.8).alias("high_confidence"),
        F.count_if(F.array_contains("modalities", "online")).alias("online"),
    )


def country_facet(found: DataFrame) -> DataFrame:
    return found.groupBy("country").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "country")


def hierarchy_summary(institutions: DataFrame, programs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per institution the number of programs, tracks and degrees below it; 0 where there is none."""
    per_program = tracks.groupBy("program_id").agg(F.count(F.lit(1)).alias("tracks"))
    below = programs.join(per_program, "program_id", "left").groupBy("institution_id").agg(
        F.count(F.lit(1)).alias("programs"), F.sum(F.coalesce("tracks", F.lit(0))).alias("tracks"), F.count_distinct("degree").alias("degrees")
    )
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("programs", "tracks", "degrees")]
    return institutions.join(below, "institution_id", "left").select("institution_id", "institution_name", *counts)


def visible(sets: DataFrame, reviewer: bool = False) -> DataFrame:
    """What a role may see: reviewers everything, others approved sets."""
    return sets if reviewer else sets.filter(F.col("status") == APPROVED)


def visible_children(children: DataFrame, sets: DataFrame, key: str = "requirement_set_id", reviewer: bool = False) -> DataFrame:
    ids = visible(sets, reviewer).select(F.col("id").alias(key))
    return children.join(ids, key, "left_semi")


def approved_programs_only(sets: DataFrame) -> DataFrame:
    """Sets whose track, term and round have an approved set; equal nulls count as equal."""
    known = sets.filter(F.col("status") == APPROVED).select("track_id", "term_year", "round_id").distinct()
    same = [sets[c].eqNullSafe(known[c]) for c in known.columns]
    return sets.join(known, reduce(Column.__and__, same), "left_semi")


#: The tests of a set in their order: those with a status of their own, and English
#: tests, which are required where they have a minimum.
STATUS_TESTS, ENGLISH_TESTS = ("GRE", "GMAT", "LSAT", "MCAT"), ("TOEFL", "IELTS", "DET")
_TEST = "test_name string, status string, min_score int, section_minima map<string,int>, code string, validity_months int"


def unpivot_tests(sets: DataFrame) -> DataFrame:
    """One row per test of a set; English tests are required where they have a minimum, others
    carry their status, and unknown ones are left out. A minimum loses its half points. Columns
    that `sets` lacks count as null (toefl_section_min: a map or JSON text of one)."""
    own = lambda c, kind: F.col(c).cast(kind) if c in sets.columns else F.lit(None).cast(kind)
    sections = F.lit(None).cast("map<string,int>")
    if "toefl_section_min" in sets.columns:
        text = sets.schema["toefl_section_min"].dataType.simpleString() == "string"
        sections = F.from_json("toefl_section_min", "map<string,int>") if text else F.col("toefl_section_min").cast("map<string,int>")

    def row(name: str, status: Column, least: Column, minima: Column) -> Column:
        values = (F.lit(name), status, least, minima, own(f"code_{name.lower()}", "string"), own("score_validity_months", "int"))
        return F.struct(*values).cast(f"struct<{_TEST.replace(', ', ',').replace(' ', ':')}>")

    def english(name: str) -> Column:
        least = own(f"{name.lower()}_min", "double")
        given = F.coalesce(least, F.lit(0.0)) != 0
        status = F.when(given, F.lit("required")).otherwise(F.lit("unknown"))
        return row(name, status, F.when(given, least.cast("int")), sections if name == "TOEFL" else F.lit(None).cast("map<string,int>"))

    status = lambda t: F.coalesce(own(f"{t.lower()}_status", "string"), F.lit("unknown"))
    none = F.lit(None)
    rows = [*(row(t, status(t), none.cast("int"), none.cast("map<string,int>")) for t in STATUS_TESTS), *(english(t) for t in ENGLISH_TESTS)]
    return sets.select("id", F.explode(F.array(*rows)).alias("t")).select("id", "t.*").filter("status <> 'unknown'")


def same_text_id(left: DataFrame, right: DataFrame, left_id: str, right_id: str, how: str = "inner") -> DataFrame:
    """Rows whose ids are the same when written as text; the right one's id column goes."""
    cast = right.withColumn("__id", F.col(right_id).cast("string")).drop(right_id)
    return left.withColumn("__id", F.col(left_id).cast("string")).join(cast, "__id", how).drop("__id")


def program_detail(programs: DataFrame, sets: DataFrame, fields: DataFrame) -> DataFrame:
    """Programs with their current set's fields and tests, `incomplete` where none is approved.

    `sets` has program_id; of several current sets the latest counts.
    """
    latest = first_by(current_requirements(sets), ["program_id"], F.desc("last_verified_at"), F.asc("id")).select("program_id", F.col("id"), F.col("last_verified_at"))
    tests = unpivot_tests(fields).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("test_name", "status", "min_score", "code"))).alias("tests"))
    body = latest.join(fields, "id").join(tests, "id", "left")
    joined = programs.join(body.drop("degree"), "program_id", "left")
    no_tests = F.array().cast("array<struct<test_name:string,status:string,min_score:int,code:string>>")
    return joined.withColumns({"status": F.when(F.col("id").isNull(), "incomplete").otherwise("complete"), "tests": F.coalesce("tests", no_tests)})


def set_confidence(sets: DataFrame, issues: DataFrame, cited: DataFrame, tested: DataFrame) -> DataFrame:
    """0.5, more with a citation and with tests (0.2 each), less by 0.1 for each open error."""
    errors = issues.filter((F.col("severity") == "error") & F.col("resolved_at").isNull()).groupBy(F.col("requirement_set_id").alias("id")).agg(F.count(F.lit(1)).alias("errors"))
    flag = lambda df, name: df.select(F.col("requirement_set_id").alias("id")).distinct().withColumn(name, F.lit(0.2))
    joined = sets.join(errors, "id", "left").join(flag(cited, "cited"), "id", "left").join(flag(tested, "tested"), "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    raw = F.lit(0.5) + zero("cited") + zero("tested") - 0.1 * zero("errors")
    return joined.select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("evidence_confidence"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """`old` with the rows of `new` put in by key; of equal keys in `new` the last by `order`."""
    latest = first_by(new, keys, F.desc(order)) if order else new.dropDuplicates(keys)
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and the rows of `new` whose keys it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def natural_id(*columns: str) -> Column:
    """An id that is the same on every run: a hash of the natural key."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)), 256)


#: The levels from institution to term, and what names each below its parent.
LEVELS = (("institution", ["institution"]), ("department", ["institution", "department"]), ("program", ["institution", "department", "program", "degree"]), ("track", ["institution", "department", "program", "degree", "track"]))


def store_chain(existing: dict[str, DataFrame], extracted: DataFrame) -> dict[str, DataFrame]:
    """Each level's table with what `extracted` adds to it, and the new requirement sets.

    Ids are natural-key hashes, so a level needs no lookup of the one above, and a second run of
    the same input adds nothing.
    """
    out = {}
    for k, (level, key) in enumerate(LEVELS):
        parent = [natural_id(*LEVELS[k - 1][1]).alias("parent_id")] if k else []
        rows = extracted.select(natural_id(*key).alias("id"), *parent, F.col(key[-1]).alias("name")).distinct()
        out[level] = insert_missing(existing[level], rows, ["id"]) if level in existing else rows
    sets = extracted.withColumns({"track_id": natural_id(*LEVELS[-1][1]), "id": natural_id(*LEVELS[-1][1], "term_year", "round_id", "parse_version")})
    out["requirement_set"] = insert_missing(existing["requirement_set"], sets, ["id"]) if "requirement_set" in existing else sets.dropDuplicates(["id"])
    return out
