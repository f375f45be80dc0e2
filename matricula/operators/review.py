"""The review queue: counts, pending work, decisions and their trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import APPROVED, DRAFT, NEEDS_REVIEW

#: Severities from grave to slight.
SEVERITIES = ("error", "warning", "info")


def severity_rank(column: str = "severity") -> Column:
    out = F.lit(len(SEVERITIES) + 1)
    for k, s in enumerate(SEVERITIES):
        out = F.when(F.col(column) == s, k + 1).otherwise(out)
    return out


def open_issues(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("resolved_at").isNull())


def status_counts(sets: DataFrame) -> DataFrame:
    return sets.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").cast("double").alias("avg_confidence"))


def issues_by_severity(issues: DataFrame, sets: DataFrame) -> DataFrame:
    """Open issues of sets that wait for review."""
    waiting = sets.filter(F.col("status") == NEEDS_REVIEW).select(F.col("id").alias("requirement_set_id"))
    return open_issues(issues).join(waiting, "requirement_set_id", "left_semi").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def activity(sets: DataFrame, as_of: str | None = None, days: int = 7) -> DataFrame:
    """Per day how many sets were updated, approved and turned down; the last `days` before
    `as_of`, or all days."""
    recent = sets if as_of is None else sets.filter(F.col("updated_at") >= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS"))
    day = F.to_date("updated_at").alias("day")
    return recent.groupBy(day).agg(F.count(F.lit(1)).alias("updated"), F.count_if(F.col("status") == APPROVED).alias("approved"), F.count_if(F.col("status") == DRAFT).alias("turned_down"))


def high_confidence_pending(sets: DataFrame, least: float = 0.95) -> DataFrame:
    return sets.filter((F.col("status") == NEEDS_REVIEW) & (F.col("confidence") >= least)).agg(F.count(F.lit(1)).alias("n"))


def pending(sets: DataFrame, issues: DataFrame, tracks: DataFrame, programs: DataFrame, institutions: DataFrame, least: float = 0.0, limit: int | None = 20) -> DataFrame:
    """Sets that wait for review, surest first and then oldest, with their open issues.

    The queue is cut before it is joined: only the rows of the page meet the other tables.
    """
    waiting = sets.filter((F.col("status") == NEEDS_REVIEW) & (F.col("confidence") >= least))
    order = [F.desc("confidence"), F.asc("created_at"), F.asc("id")]
    shown = waiting.orderBy(*order).limit(limit) if limit else waiting
    counts = open_issues(issues).groupBy(F.col("requirement_set_id").alias("id")).agg(F.count(F.lit(1)).alias("issues"))
    joined = shown.join(tracks.select("track_id", "program_id"), "track_id").join(programs, "program_id").join(institutions, "institution_id").join(counts, "id", "left")
    return joined.select("id", "institution_name", "program_name", "degree", "term_year", "confidence", "created_at", F.coalesce("issues", F.lit(0)).alias("issues")).orderBy(*order)


def decide(sets: DataFrame, actions: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Apply `approve` or `reject` actions (id, reviewer, at, confidence, notes); the other result
    is the actions that do not apply, because their set is missing or in another state."""
    states, after = ((DRAFT, NEEDS_REVIEW), APPROVED) if kind == "approve" else ((NEEDS_REVIEW,), DRAFT)
    mine = actions.dropDuplicates(["id"]).select("id", F.col("reviewer").alias("__by"), F.col("at").alias("__at"), F.col("confidence").alias("__confidence"))
    joined = sets.join(mine, "id", "left")
    hit = F.col("__by").isNotNull() & F.col("status").isin(*states)
    changed = joined.withColumns({
        "reviewer": F.when(hit, F.col("__by")) if "reviewer" not in sets.columns else F.when(hit, F.col("__by")).otherwise(F.col("reviewer")),
        "updated_at": F.when(hit, F.col("__at")).otherwise(F.col("updated_at")),
        "confidence": F.when(hit & F.lit(kind == "approve"), F.coalesce(F.col("__confidence").cast("decimal(3,2)"), F.col("confidence"))).otherwise(F.col("confidence")),
        "status": F.when(hit, F.lit(after)).otherwise(F.col("status")),
    }).drop("__by", "__at", "__confidence")
    fit = sets.filter(F.col("status").isin(*states)).select("id")
    return changed, actions.join(fit, "id", "left_anti")


def batch_approve(sets: DataFrame, reviewer: str, at: str, least: float = 0.95, limit: int = 50) -> DataFrame:
    """Approve the surest sets that wait for review."""
    chosen = sets.filter((F.col("status") == NEEDS_REVIEW) & (F.col("confidence") >= least)).orderBy(F.desc("confidence"), F.asc("created_at"), F.asc("id")).limit(limit)
    actions = chosen.select("id", F.lit(reviewer).alias("reviewer"), F.to_timestamp(F.lit(at)).alias("at"), F.lit(None).cast("double").alias("confidence"))
    return decide(sets, actions, "approve")[0]


def audit_rows(actions: DataFrame, kind: str) -> DataFrame:
    """An info issue for each action that has notes."""
    noted = actions.filter(F.coalesce("notes", F.lit("")) != "")
    return noted.select(F.col("id").alias("requirement_set_id"), F.lit("review").alias("field_name"), F.lit("info").alias("severity"), F.concat(F.lit(f"{kind} by "), "reviewer", F.lit(": "), "notes").alias("message"))


def set_details(sets: DataFrame, issues: DataFrame) -> DataFrame:
    """Each set with its open issues, grave ones first."""
    listed = open_issues(issues).groupBy(F.col("requirement_set_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(severity_rank().alias("rank"), "field_no", "severity"))).alias("issues"))
    text = F.array_join(F.transform(F.col("issues"), lambda x: F.concat_ws(":", x["severity"], x["field_no"])), ",")
    return sets.join(listed, "id", "left").select("id", "status", "confidence", F.coalesce(text, F.lit("")).alias("open_issues"))


def detail_bundle(sets: DataFrame, issues: DataFrame, citations: DataFrame, tests: DataFrame, deadlines: DataFrame, contacts: DataFrame) -> DataFrame:
    """Each set with arrays of what belongs to it, in order: open issues (grave ones first), citations
    (by field, then the time they were made), tests, deadlines (earliest first) and contacts.

    All have requirement_set_id; issues: severity, field_name, message; citations: field_name,
    created_at, kind, snippet; tests: test_name, status, min_score; deadlines: deadline_ts,
    deadline_type, audience; contacts: contact_type, email."""
    out = sets
    parts = (
        ("issues", open_issues(issues).withColumn("rank", severity_rank()), ("rank", "field_name", "severity", "message")),
        ("citations", citations, ("field_name", "created_at", "kind", "snippet")),
        ("tests", tests, ("test_name", "status", "min_score")),
        ("deadlines", deadlines, ("deadline_ts", "deadline_type", "audience")),
        ("contacts", contacts, ("contact_type", "email")),
    )
    for name, rows, columns in parts:
        listed = rows.groupBy(F.col("requirement_set_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(listed, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out
