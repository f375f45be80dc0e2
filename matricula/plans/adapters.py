"""Views that give the driver's tables the shape of the registry, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SEGMENT_NO = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END"


def institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = read(spark, sf_dir, "region")
    joined = read(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.selectExpr("n_nationkey AS institution_id", "n_name AS institution_name", "r_name AS country")


def program(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", F.expr(SEGMENT_NO).alias("seg_no")).distinct()
    return one.selectExpr(
        "c_nationkey * 10 + seg_no AS program_id",
        "concat('Program ', c_mktsegment) AS program_name",
        "c_nationkey AS institution_id",
        "element_at(array('MBA', 'MS', 'PhD', 'MA', 'MEng'), seg_no) AS degree",
        "c_nationkey % 3 + 1 AS priority_tier",
    )


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS track_id",
        f"c_nationkey * 10 + {SEGMENT_NO} AS program_id",
        "element_at(array('in_person', 'online', 'hybrid'), CAST(c_custkey % 3 AS INT) + 1) AS modality",
        "element_at(array('full_time', 'part_time'), CAST(c_custkey % 2 AS INT) + 1) AS schedule",
    )


def requirement_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "o_custkey AS track_id",
        "year(o_orderdate) AS term_year",
        "CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS round_id",
        "CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'needs_review' ELSE 'draft' END AS status",
        "CAST((o_orderkey % 101) / 100D AS DECIMAL(3,2)) AS confidence",
        "CAST(o_orderdate AS TIMESTAMP) AS last_verified_at",
        "CAST(o_orderdate AS TIMESTAMP) AS created_at",
        "CAST(o_orderdate AS TIMESTAMP) AS updated_at",
    )


def validation_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS requirement_set_id",
        "l_linenumber AS field_no",
        "CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'warning' ELSE 'info' END AS severity",
        "CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS TIMESTAMP) END AS resolved_at",
    )


def grant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS grant_id",
        "l_suppkey AS author_id",
        "CASE l_returnflag WHEN 'A' THEN 'NIH' WHEN 'N' THEN 'NSF' ELSE 'Private' END AS funder",
        "CAST(l_shipdate AS DATE) AS start_date",
        "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE date_add(CAST(l_shipdate AS DATE), CAST(l_quantity * 30 AS INT)) END AS end_date",
    )


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr("doc_id AS work_id", "source AS author_id", "substr(text, 1, 80) AS title", "text AS abstract", "CAST(2019 + doc_id % 6 AS INT) AS year")


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat requirement fields for every set, spread so that every rule has hits."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "element_at(array('MBA', 'MS', 'PhD', 'MA', 'JD'), CAST(o_orderkey % 5 AS INT) + 1) AS degree",
        "CAST(year(o_orderdate) AS INT) AS term_year",
        "CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(60 + o_orderkey % 66 AS INT) END AS toefl_min",
        "CAST(o_orderkey % 33 AS INT) AS toefl_reading",
        "CAST(20 + o_orderkey % 9 AS INT) AS toefl_writing",
        "5 + (o_orderkey % 9) / 2D AS ielts_min",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'X12' ELSE lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0') END AS code_toefl",
        "element_at(array('required', 'recommended', 'optional', 'not_accepted', 'waived', 'unknown'), CAST(o_orderkey % 6 AS INT) + 1) AS gre_status",
        "element_at(array('required', 'not_accepted', 'unknown'), CAST(o_orderkey % 3 AS INT) + 1) AS gmat_status",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'required' ELSE 'unknown' END AS lsat_status",
        "CAST(o_orderkey % 6 AS INT) AS rec_min",
        "CAST(o_orderkey % 4 AS INT) AS rec_max",
        "(o_orderkey % 50) / 10D AS gpa_min",
        "CAST(o_orderkey % 700 - 20 AS DOUBLE) AS fee_amount",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'native speakers' END AS english_exemptions",
        "CAST(o_orderdate AS TIMESTAMP) AS deadline_ts",
        "CASE WHEN o_orderkey % 2 = 0 THEN array('toefl_min', 'gpa_min') ELSE array() END AS cited_fields",
    )


#: The same views for the oracle; a query takes the ones that it names.
SQL = {
    "institution": "SELECT n_nationkey AS institution_id, n_name AS institution_name, r_name AS country FROM nation JOIN region ON n_regionkey = r_regionkey",
    "program": f"""SELECT c_nationkey * 10 + seg_no AS program_id, 'Program ' || c_mktsegment AS program_name, c_nationkey AS institution_id,
        ['MBA', 'MS', 'PhD', 'MA', 'MEng'][seg_no] AS degree, c_nationkey % 3 + 1 AS priority_tier
        FROM (SELECT DISTINCT c_nationkey, c_mktsegment, {SEGMENT_NO} AS seg_no FROM customer)""",
    "track": f"""SELECT c_custkey AS track_id, c_nationkey * 10 + {SEGMENT_NO} AS program_id,
        ['in_person', 'online', 'hybrid'][c_custkey % 3 + 1] AS modality, ['full_time', 'part_time'][c_custkey % 2 + 1] AS schedule FROM customer""",
    "requirement_set": """SELECT o_orderkey AS id, o_custkey AS track_id, year(o_orderdate) AS term_year,
        CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS round_id,
        CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'needs_review' ELSE 'draft' END AS status,
        CAST((o_orderkey % 101) / 100 AS DECIMAL(3,2)) AS confidence, o_orderdate AS last_verified_at, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders""",
    "validation_issue": """SELECT l_orderkey AS requirement_set_id, l_linenumber AS field_no,
        CASE l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'warning' ELSE 'info' END AS severity,
        CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS resolved_at FROM lineitem""",
    "grants": """SELECT l_orderkey * 10 + l_linenumber AS grant_id, l_suppkey AS author_id,
        CASE l_returnflag WHEN 'A' THEN 'NIH' WHEN 'N' THEN 'NSF' ELSE 'Private' END AS funder, CAST(l_shipdate AS DATE) AS start_date,
        CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity * 30 AS INT) END AS end_date FROM lineitem""",
    "work": "SELECT doc_id AS work_id, source AS author_id, substr(text, 1, 80) AS title, text AS abstract, CAST(2019 + doc_id % 6 AS INT) AS year FROM documents",
    "requirements": """SELECT o_orderkey AS id, ['MBA', 'MS', 'PhD', 'MA', 'JD'][o_orderkey % 5 + 1] AS degree, CAST(year(o_orderdate) AS INT) AS term_year,
        CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE CAST(60 + o_orderkey % 66 AS INT) END AS toefl_min,
        CAST(o_orderkey % 33 AS INT) AS toefl_reading, CAST(20 + o_orderkey % 9 AS INT) AS toefl_writing, 5 + (o_orderkey % 9) / 2e0 AS ielts_min,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'X12' ELSE lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') END AS code_toefl,
        ['required', 'recommended', 'optional', 'not_accepted', 'waived', 'unknown'][o_orderkey % 6 + 1] AS gre_status,
        ['required', 'not_accepted', 'unknown'][o_orderkey % 3 + 1] AS gmat_status, CASE WHEN o_orderkey % 2 = 0 THEN 'required' ELSE 'unknown' END AS lsat_status,
        CAST(o_orderkey % 6 AS INT) AS rec_min, CAST(o_orderkey % 4 AS INT) AS rec_max, (o_orderkey % 50) / 10e0 AS gpa_min, CAST(o_orderkey % 700 - 20 AS DOUBLE) AS fee_amount,
        CASE WHEN o_orderkey % 3 = 0 THEN 'native speakers' END AS english_exemptions, o_orderdate AS deadline_ts,
        CASE WHEN o_orderkey % 2 = 0 THEN ['toefl_min', 'gpa_min'] ELSE [] END AS cited_fields FROM orders""",
}


def sql(body: str, *views: str, more: str = "") -> str:
    """A query over some of the views; `more` are further named parts."""
    parts = [f"{v} AS ({SQL[v]})" for v in views] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {body}" if parts else body
