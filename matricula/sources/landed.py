"""Landed dumps as tables: authors, works, awards, employment, organisations, headings, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse
from ..operators.registry import first_by

_NAMED = "array<struct<display_name:string>>"
AUTHOR = f"id string, display_name string, orcid string, x_concepts {_NAMED}, topics {_NAMED}"
WORK = (
    "id string, title string, doi string, publication_year int, abstract_inverted_index map<string,array<int>>, "
    "authorships array<struct<author:struct<id:string,display_name:string>,institutions:array<struct<id:string,ror:string>>>>"
)
NIH = (
    "project_num string, ProjectNum string, project_title string, ProjectTitle string, project_start_date string, ProjectStartDate string, project_end_date string, ProjectEndDate string, "
    "principal_investigators array<struct<full_name:string>>, PrincipalInvestigators array<string>, organization string, searched_name string"
)
NSF = "id string, title string, startDate string, expDate string, piFirstName string, piLastName string, awardeeName string"
EMPLOYMENT = (
    "orcid string, employments array<struct<title:string,department:string,start_year:int,end_year:int,end_month:int,end_day:int>>, "
    "urls array<struct<name:string,url:string>>, websites array<string>"
)
ORGANISATION = "id string, name string, aliases array<string>, acronyms array<string>, types array<string>, status string, country string"
#: What the ids of the dumps start with.
ID_PREFIXES = r"^https?://(?:openalex\.org|orcid\.org|ror\.org|doi\.org)/"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def bare_id(x: Column | str) -> Column:
    return F.regexp_replace(F.col(x) if isinstance(x, str) else x, ID_PREFIXES, "")


def _names(column: str, n: int = 10) -> Column:
    names = F.transform(F.slice(column, 1, n), lambda c: c["display_name"])
    return F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def authors(dump: DataFrame) -> DataFrame:
    """Authors with a bare id, a name, and their topics: ten concepts, then ten topics, each once."""
    rows = dump.select(bare_id("id").alias("author_id"), F.col("display_name").alias("name"), bare_id("orcid").alias("orcid"), F.array_distinct(F.concat(_names("x_concepts"), _names("topics"))).alias("topics"))
    return rows.filter((F.coalesce("author_id", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))


def works(dump: DataFrame, as_of_year: int) -> DataFrame:
    from ..functions.text import from_inverted_index

    rows = dump.select(bare_id("id").alias("work_id"), "title", bare_id("doi").alias("doi"), F.coalesce("publication_year", F.lit(as_of_year)).alias("year"), from_inverted_index("abstract_inverted_index").alias("abstract"), "authorships")
    return rows.filter((F.coalesce("work_id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))


def authorships(found: DataFrame, institutions: DataFrame) -> DataFrame:
    """(work_id, author_id, name, institution_id) for authors of given institutions (institution_id,
    ror_id, openalex_id), by either id."""
    each = found.select("work_id", F.explode("authorships").alias("a")).select("work_id", bare_id("a.author.id").alias("author_id"), F.col("a.author.display_name").alias("name"), F.explode("a.institutions").alias("i"))
    ids = each.select("work_id", "author_id", "name", F.explode(F.array_compact(F.array(bare_id("i.id"), bare_id("i.ror")))).alias("any_id"))
    known = institutions.select("institution_id", F.explode(F.array_compact(F.array("openalex_id", "ror_id"))).alias("any_id"))
    return ids.join(known, "any_id").select("work_id", "author_id", "name", "institution_id").distinct()


def nih_awards(dump: DataFrame) -> DataFrame:
    """Awards in either spelling of the field names; without investigators the searched name is one."""
    either = lambda a, b: F.coalesce(F.col(a), F.col(b))
    people = F.coalesce(F.transform("principal_investigators", lambda p: p["full_name"]), F.col("PrincipalInvestigators"), F.array().cast("array<string>"))
    people = F.filter(people, lambda p: F.coalesce(p, F.lit("")) != "")
    return dump.select(
        either("project_num", "ProjectNum").alias("grant_id"),
        either("project_title", "ProjectTitle").alias("title"),
        F.lit("NIH").alias("funder"),
        parse(either("project_start_date", "ProjectStartDate")).alias("start_date"),
        parse(either("project_end_date", "ProjectEndDate")).alias("end_date"),
        F.when(F.size(people) > 0, people).otherwise(F.array_compact(F.array("searched_name"))).alias("pi_names"),
        F.col("organization").alias("institution"),
    )


def nsf_awards(dump: DataFrame) -> DataFrame:
    return dump.select(F.col("id").alias("grant_id"), "title", F.lit("NSF").alias("funder"), parse("startDate").alias("start_date"), parse("expDate").alias("end_date"), F.array(F.concat_ws(" ", "piFirstName", "piLastName")).alias("pi_names"), F.col("awardeeName").alias("institution"))


#: Names of addresses that are preferred.
PREFERRED = "homepage|personal|website|lab|research"


def employment(dump: DataFrame) -> DataFrame:
    """The current post of each person: the first without an end, else the one that ended last."""
    each = dump.select("orcid", F.posexplode("employments").alias("pos", "e")).select("orcid", "pos", "e.*")
    part = lambda c: F.coalesce(F.col(c), F.lit(1))
    end = F.struct("end_year", part("end_month"), part("end_day"))
    return first_by(each, ["orcid"], F.desc(F.col("end_year").isNull()), F.desc(end), F.asc("pos")).select("orcid", "title", "department")


def homepage(dump: DataFrame) -> DataFrame:
    """The preferred address of each person: the last that is named as one, else the first valid
    one, else the first website."""
    from ..functions.urls import is_valid

    each = dump.select("orcid", F.posexplode_outer("urls").alias("pos", "u"), "websites").withColumns({"url": F.col("u.url"), "named": F.coalesce(F.lower("u.name").rlike(PREFERRED), F.lit(False))})
    valid = each.filter(is_valid("url"))
    order = F.when(F.col("named"), -F.col("pos")).otherwise(F.col("pos"))
    chosen = first_by(valid, ["orcid"], F.desc("named"), F.asc(order)).select("orcid", F.col("url").alias("chosen"))
    return dump.select("orcid", F.get("websites", F.lit(0)).alias("site")).join(chosen, "orcid", "left").select("orcid", F.coalesce("chosen", "site").alias("homepage"))


def organisations(dump: DataFrame) -> DataFrame:
    """Registry rows; `pos` is the order that settles ties: that of the ids, over all countries."""
    none = F.array().cast("array<string>")
    rows = dump.withColumn("id", bare_id("id")).withColumns({c: F.coalesce(c, none) for c in ("aliases", "acronyms", "types")})
    return rows.withColumn("pos", F.col("id"))


def mesh_terms(records: DataFrame) -> DataFrame:
    """term -> heading and concept terms of its records (term, xml)."""
    names = F.concat(F.xpath("xml", F.lit("//DescriptorRecord/DescriptorName/String/text()")), F.xpath("xml", F.lit("//ConceptList/Concept//TermList/Term/String/text()")))
    return records.select("term", F.array_distinct(names).alias("terms"))


#: Folders of page kinds.
KINDS = (("html", "html"), ("pdf", "pdf"), ("json", "json"), ("xml", "xml"))


def captures(pages: DataFrame) -> DataFrame:
    """Captures with content hash, length and kind (url, html, mime); status, etag and fetched_at
    are kept, null where the capture lacks them."""
    kept = {"status": "int", "etag": "string", "fetched_at": "timestamp"}
    pages = pages.withColumns({c: F.col(c).cast(t) if c in pages.columns else F.lit(None).cast(t) for c, t in kept.items()})
    kind = F.lit("other")
    for name, sign in reversed(KINDS):
        kind = F.when(F.contains(F.lower("mime"), F.lit(sign)), name).otherwise(kind)
    return pages.withColumns({"content_hash": F.sha2("html", 256), "n_bytes": F.octet_length("html"), "kind": kind})


def land(found: DataFrame, path: str) -> None:
    found.write.partitionBy("kind").mode("append").parquet(path)


def query(spark: SparkSession, text: str, **values) -> DataFrame:
    """A SQL query over registered views, with named parameters."""
    return spark.sql(text, args=values)


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dimension from CSV (with a header) or, by its ending, JSON lines, with a given schema."""
    reader = spark.read.schema(schema)
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.option("header", True).csv(path)
