"""CSV exports with fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hyperlink
from ..functions.urls import is_valid

#: Columns of the researcher export, in order.
RESEARCHER = [
    "name", "institution", "department", "title", "openalex_id", "orcid_id", "homepage_url", "topics", "matched_keywords", "recent_publications", "publication_years", "grant_titles",
    "grant_funders", "active_grants", "known_grants", "estimated_grants", "unknown_grants", "is_recruiting", "recruiting_snippet", "recruiting_url", "concept_score", "recent_works_score",
    "grant_score", "final_score", "rationale", "evidence_urls",
]
LISTS = ("topics", "matched_keywords", "recent_publications", "publication_years", "grant_titles", "grant_funders", "evidence_urls")
SCORES = ("concept_score", "recent_works_score", "grant_score", "final_score")


def researchers(found: DataFrame, first: int = 3) -> DataFrame:
    """The 26 columns as text: lists joined, ids as links, scores to three places (half to even),
    the first titles only. Columns that are missing come out empty."""
    have = set(found.columns)

    def one(c: str) -> Column:
        if c not in have:
            return F.lit("")
        if c == "openalex_id":
            return hyperlink(F.concat(F.lit("https://openalex.org/"), F.nullif(F.col(c), F.lit(""))), c)
        if c == "orcid_id":
            return hyperlink(F.concat(F.lit("https://orcid.org/"), F.nullif(F.col(c), F.lit(""))), c)
        if c == "recent_publications":
            return F.array_join(F.slice(c, 1, first), "; ")
        if c in LISTS:
            return F.array_join(F.col(c).cast("array<string>"), "; ")
        if c in SCORES:
            return F.bround(c, 3).cast("string")
        if c == "is_recruiting":
            return F.initcap(F.col(c).cast("string"))
        return F.col(c).cast("string")

    return found.filter(F.coalesce("name", F.lit("")) != "").select(*(F.coalesce(one(c), F.lit("")).alias(c) for c in RESEARCHER))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="")


def summary(rows: DataFrame) -> DataFrame:
    """Rows, and how many have an ORCID, recruit and have running grants; the mean final score."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(filled("orcid_id")).alias("with_orcid"), F.count_if(F.lower("is_recruiting") == "true").alias("recruiting"),
        F.count_if(F.col("active_grants").try_cast("int") > 0).alias("with_grants"), F.avg(F.col("final_score").try_cast("double")).alias("avg_score"),
    )


def cell_issues(rows: DataFrame, required: tuple[str, ...] = ("name", "institution"), urls: tuple[str, ...] = ("homepage_url", "recruiting_url")) -> DataFrame:
    """Required cells that are empty, and addresses without scheme or host."""
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    found = [F.when(~filled(c), F.struct(F.lit(c).alias("field"), F.lit("missing").alias("issue"))) for c in required]
    found += [F.when(filled(c) & ~is_valid(c), F.struct(F.lit(c).alias("field"), F.lit("bad address").alias("issue"))) for c in urls]
    return rows.select("name", F.explode(F.array_compact(F.array(*found))).alias("i")).select("name", "i.*")


#: Columns of the program export, and of each of its three faculty places.
PROGRAM = ["university", "track", "rank", "overall_rank", "acceptance_rate", "toefl_min", "ielts_min", "gre_required", "gpa_min", "letters", "application_fee", "deadline_fall", "website", "last_updated"]
FACULTY = ("name", "title")


def programs(found: DataFrame, places: int = 3) -> DataFrame:
    """Programs as text, with the first faculty members side by side."""
    have = set(found.columns)
    cells = [(F.format_string("%.1f%%", F.col(c)) if c == "acceptance_rate" else F.col(c).cast("string")) if c in have else F.lit("") for c in PROGRAM]
    out = [F.coalesce(v, F.lit("")).alias(c) for c, v in zip(PROGRAM, cells, strict=True)]
    out += [F.coalesce(F.get("faculty", F.lit(k))[part], F.lit("")).alias(f"faculty_{k + 1}_{part}") for k in range(places) for part in FACULTY]
    people = [F.coalesce(F.array_join(F.transform("faculty", lambda p: p["name"]), "; "), F.lit("")).alias("all_faculty"), F.coalesce(F.size("faculty").cast("string"), F.lit("0")).alias("n_faculty")]
    return found.select(*out, *people)
