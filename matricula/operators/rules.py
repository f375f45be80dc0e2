"""Rules over rows: checks as expressions, issues as rows, verdicts as aggregates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A check that fails where `fails` holds; rules of your own are made the same way."""

    field: str
    severity: str
    message: str
    fails: Column
    value: Column | None = None


def issues(rows: DataFrame, rules: list[Rule], key: str = "id") -> DataFrame:
    """One row per failed check, in one pass over `rows`."""
    one = lambda r: F.when(
        F.coalesce(r.fails, F.lit(False)),
        F.struct(F.lit(r.field).alias("field_name"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), (F.lit(None) if r.value is None else r.value).cast("string").alias("current_value")),
    )
    found = rows.select(key, F.explode(F.array_compact(F.array(*map(one, rules)))).alias("i"))
    return found.select(key, "i.*")


def given(name: str) -> Column:
    """A number, text or list that is there; zero and empty count as missing."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).__ne__("") & ~F.coalesce(F.col(name).cast("string"), F.lit("")).rlike(r"^-?0+(\.0*)?$")


def outside(name: str, low: float, high: float) -> Column:
    return given(name) & ~F.col(name).between(low, high)


#: Ranges of scores.
RANGES = {"toefl_min": (0, 120), "toefl_section": (0, 30), "ielts_min": (0.0, 9.0), "gpa_min": (0.0, 4.0)}
SECTIONS = ("toefl_reading", "toefl_listening", "toefl_speaking", "toefl_writing")
#: Fields that need a citation.
CITED = ("toefl_min", "ielts_min", "code_toefl", "gre_status", "fee_amount", "rec_min", "gpa_min")


def format_rules(columns: list[str], known_codes: list[str]) -> list[Rule]:
    code = F.col("code_toefl")
    four = code.rlike(r"^\d{4}$")
    out = [Rule(c, s, f"outside {low} to {high}", outside(c, low, high), F.col(c)) for c, s in (("toefl_min", "error"), ("ielts_min", "error"), ("gpa_min", "warning")) for low, high in [RANGES[c]]]
    out += [Rule(c, "error", "section outside 0 to 30", F.col(c).isNotNull() & ~F.col(c).between(*RANGES["toefl_section"]), F.col(c)) for c in SECTIONS if c in columns]
    out += [
        Rule("code_toefl", "error", "code is not four digits", given("code_toefl") & ~four, code),
        Rule("fee_amount", "error", "fee is negative", F.col("fee_amount") < 0, F.col("fee_amount")),
        Rule("fee_amount", "warning", "fee is unusually high", F.col("fee_amount") > 500, F.col("fee_amount")),
    ]
    known = F.array(*map(F.lit, known_codes)) if known_codes else F.array().cast("array<string>")
    return [*out, Rule("code_toefl", "warning", "code is not known", given("code_toefl") & four & ~F.array_contains(known, code), code)]


def logical_rules(columns: list[str]) -> list[Rule]:
    have = [c for c in SECTIONS if c in columns]
    total = reduce(Column.__add__, (F.coalesce(F.col(c), F.lit(0)) for c in have)) if have else F.lit(0)
    return [
        Rule("code_toefl", "warning", "minimum without a code", given("toefl_min") & ~given("code_toefl") & ~given("english_exemptions")),
        Rule("rec_min", "error", "more letters at least than at most", given("rec_min") & given("rec_max") & (F.col("rec_min") > F.col("rec_max")), F.col("rec_min")),
        Rule("toefl_section_min", "warning", "sections exceed the total", given("toefl_min") & (total > F.col("toefl_min")), total),
    ]


def business_rules() -> list[Rule]:
    degree, gmat = F.col("degree"), F.col("gmat_status")
    return [
        Rule("gmat_status", "warning", "MBA that takes no GMAT", (degree == "MBA") & (gmat == "not_accepted"), gmat),
        Rule("gmat_status", "info", "MBA with unknown GMAT", (degree == "MBA") & (gmat == "unknown"), gmat),
        Rule("gre_status", "info", "PhD that takes no GRE", (degree == "PhD") & (F.col("gre_status") == "not_accepted"), F.col("gre_status")),
        Rule("lsat_status", "warning", "law degree without LSAT", (degree == "JD") & (F.col("lsat_status") != "required"), F.col("lsat_status")),
        Rule("english_exemptions", "info", "English test without exemptions", (given("toefl_min") | given("ielts_min")) & ~given("english_exemptions")),
    ]


def temporal_rules(as_of: str) -> list[Rule]:
    today, at = F.to_timestamp(F.lit(as_of)), F.col("deadline_ts")
    days = F.floor((F.unix_timestamp(today) - F.unix_timestamp(at)) / 86400)
    return [
        Rule("deadline_ts", "warning", "deadline is past", (at < today) & (days > 30), F.date_format(at, "yyyy-MM-dd")),
        Rule("deadline_ts", "warning", "deadline is over two years ahead", at > today + F.expr("INTERVAL 730 DAYS"), F.date_format(at, "yyyy-MM-dd")),
        Rule("term_year", "info", "term is past", F.col("term_year") < F.year(today), F.col("term_year")),
    ]


def citation_rules() -> list[Rule]:
    there = lambda c: (F.col(c) != "unknown") if c == "gre_status" else F.col(c).isNotNull()
    return [Rule(c, "warning", "no citation", there(c) & ~F.array_contains("cited_fields", c), F.col(c)) for c in CITED]


def peer_rules() -> list[Rule]:
    t = F.col("toefl_min")
    return [Rule("toefl_min", "info", "higher than usual", given("toefl_min") & (t > 110), t), Rule("toefl_min", "info", "lower than usual", given("toefl_min") & (t < 70), t)]


def all_rules(columns: list[str], known_codes: list[str], as_of: str, more: tuple[Rule, ...] = ()) -> list[Rule]:
    return [*format_rules(columns, known_codes), *logical_rules(columns), *business_rules(), *temporal_rules(as_of), *citation_rules(), *peer_rules(), *more]


def report(found: DataFrame, key: str = "id") -> DataFrame:
    return found.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))


def failing(rules: list[Rule], severity: str) -> Column:
    """How many checks of a severity a row fails."""
    return reduce(Column.__add__, (F.when(F.coalesce(r.fails, F.lit(False)), 1).otherwise(0) for r in rules if r.severity == severity), F.lit(0).cast("long"))


def verdict(sets: DataFrame, found: DataFrame) -> DataFrame:
    """id, errors, warnings, confidence and the status that they recommend, by issues of `found`."""
    joined = sets.join(report(found), "id", "left")
    return _verdict(joined, *(F.coalesce(c, F.lit(0)) for c in ("errors", "warnings")))


def _verdict(joined: DataFrame, errors: Column, warnings: Column) -> DataFrame:
    fields = reduce(Column.__add__, [given(c).cast("int") for c in ("toefl_min", "code_toefl", "fee_amount", "rec_min")] + [(F.col("gre_status") != "unknown").cast("int")])
    cites = F.size("cited_fields") / F.greatest(fields, F.lit(1))
    raw = 0.7 - errors * 0.2 - warnings * 0.05 + F.least(F.lit(0.2), cites * 0.2) + F.when(F.col("deadline_ts").isNotNull(), 0.1).otherwise(0.0)
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    status = F.when(errors > 0, "needs_review").when(confidence >= 0.9, "approved").when(confidence >= 0.7, "needs_review").otherwise("draft")
    return joined.select("id", errors.alias("errors"), warnings.alias("warnings"), confidence.alias("confidence"), status.alias("status"))


def validate(sets: DataFrame, known_codes: list[str], as_of: str, more: tuple[Rule, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """All issues of all sets, and a verdict on each set; verdicts count a row's failing checks where
    it lies, without going over the issues."""
    rules = all_rules(sets.columns, known_codes, as_of, more)
    counted = sets.withColumns({"errors": failing(rules, "error"), "warnings": failing(rules, "warning")})
    return issues(sets, rules), _verdict(counted, F.col("errors"), F.col("warnings"))


def not_in(field: str, values: list[str], severity: str = "error") -> Rule:
    return Rule(field, severity, "not a known value", F.col(field).isNotNull() & ~F.col(field).isin(*values), F.col(field))


def not_like(field: str, pattern: str, severity: str = "error") -> Rule:
    return Rule(field, severity, "wrong form", F.col(field).isNotNull() & ~F.col(field).rlike(pattern), F.col(field))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur twice or more; a key with a null is never equal to another."""
    whole = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    return rows.filter(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key is given and names no parent."""
    known = parents.select(F.col(parent_key).alias(child_key)).distinct()
    return children.filter(F.col(child_key).isNotNull()).join(known, child_key, "left_anti")


def citation_checks() -> list[Rule]:
    """A page citation needs a selector, a document citation a page number."""
    return [
        Rule("selector", "error", "page citation without selector", (F.col("kind") == "html") & ~given("selector")),
        Rule("page_num", "error", "document citation without page", (F.col("kind") == "pdf") & F.col("page_num").isNull()),
    ]


def extraction_confidence(rows: DataFrame) -> DataFrame:
    """0.5, a tenth for each of five parts, up to 0.2 for citations; 0 to 1.

    rows: id, toefl_min, code_toefl, fee_amount, deadlines, contacts (counts), citations (count).
    """
    raw = F.lit(0.5) + F.least(F.lit(0.2), F.col("citations") * 0.05)
    for c in ("toefl_min", "code_toefl", "fee_amount", "deadlines", "contacts"):
        raw = raw + F.when(given(c), 0.1).otherwise(0.0)
    return rows.select("id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("extraction_confidence"))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.95, "high").when(c >= 0.8, "medium").otherwise("low")


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)
