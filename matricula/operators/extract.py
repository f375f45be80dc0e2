"""Facts out of page text: requirements, deadlines, recruiting, citations, packed context."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from ..functions.dates import parse_long
from ..functions.names import fresh
from ..functions.text import _col, literals, normalize, once, snippet
from .registry import first_by

#: How pages say each requirement, the patterns in the order in which they are tried,
#: and the range of a usable figure. A dot does not run over a line's end.
ANY = (0.0, float("inf"))
NUMBER_PATTERNS = {
    "gpa_min": ((r"GPA.*?(\d+\.\d+)", r"minimum GPA.*?(\d+\.\d+)", r"grade point average.*?(\d+\.\d+)"), ANY),
    "toefl_min": ((r"TOEFL.*?(\d{2,3})", r"TOEFL iBT.*?(\d{2,3})", r"minimum TOEFL.*?(\d{2,3})"), (70, 120)),
    "ielts_min": ((r"IELTS.*?(\d+(?:\.\d+)?)", r"minimum IELTS.*?(\d+(?:\.\d+)?)"), (5.0, 9.0)),
    "letters": ((r"(\d+).*letters?\s+of\s+recommendation",), ANY),
    "fee": ((r"application fee.*?\$(\d+)",), ANY),
}
GRE_OFF, GRE_ON = r"GRE.*not.*required|GRE.*optional|GRE.*waived", r"GRE.*required|require.*GRE"
FALL_DEADLINES = (r"(December|January|February)\s+(\d{1,2})", r"deadline.*?(Dec|Jan|Feb).*?(\d{1,2})")


def requirements(text: Column | str) -> Column:
    """What a text says of grades, tests, letters, fee and deadline: of each the first pattern whose
    first figure is in range, null where there is none."""
    x = _col(text)
    plain = lambda p: f"(?id){p}"

    def first_usable(patterns: tuple[str, ...], low: float, high: float) -> Column:
        numbers = [F.regexp_extract(x, plain(p), 1).try_cast("double") for p in patterns]
        return F.coalesce(*(F.when(n.between(low, high), n) for n in numbers))

    numbers = [first_usable(patterns, *bounds).alias(k) for k, (patterns, bounds) in NUMBER_PATTERNS.items()]
    gre = F.when(x.rlike(plain(GRE_OFF)), False).when(x.rlike(plain(GRE_ON)), True)
    fall = F.coalesce(*(F.when(x.rlike(plain(p)), F.concat_ws(" ", F.regexp_extract(x, plain(p), 1), F.regexp_extract(x, plain(p), 2))) for p in FALL_DEADLINES))
    return F.struct(*numbers, gre.alias("gre_required"), fall.alias("deadline_fall"))


#: What announces a deadline, and what its date looks like.
_DATE = r"([A-Za-z]+\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}|\d{1,2}\s+[A-Za-z]+\s+\d{4})"
PRIORITY_DEADLINE = rf"(?i)(?:priority|early|preferred)\s+(?:deadline|due)[:\s]*{_DATE}"
DEADLINE = rf"(?i)(?:deadline|apply by|application due|due)[:\s]*{_DATE}"


def deadlines(segments: DataFrame, year: int, key: str = "doc_id") -> DataFrame:
    """Dated deadlines of `year` to two years on, with type and audience by the words around;
    each date, type and audience once per document, from its earliest segment.

    segments: key, pos, text.
    """
    text = F.lower("text")
    has = lambda *w: text.rlike("|".join(w))
    kind = F.when(has("priority", "early"), "priority").when(has("final", "last", "regular"), "final").otherwise("regular")
    audience = F.when(F.contains(text, F.lit("international")), "international").when(F.contains(text, F.lit("domestic")), "domestic").otherwise("both")
    found = F.concat(
        F.transform(F.regexp_extract_all("text", F.lit(PRIORITY_DEADLINE), F.lit(1)), lambda d: F.struct(d.alias("said"), F.lit("priority").alias("kind"), F.lit("both").alias("audience"))),
        F.transform(F.regexp_extract_all("text", F.lit(DEADLINE), F.lit(1)), lambda d: F.struct(d.alias("said"), kind.alias("kind"), audience.alias("audience"))),
    )
    rows = segments.filter(has("deadline", "due", "apply by", "application")).select(key, "pos", F.explode(found).alias("d"))
    dated = rows.select(key, "pos", parse_long("d.said").alias("deadline"), "d.kind", "d.audience")
    kept = dated.filter(F.year("deadline").between(year, year + 2))
    return first_by(kept, [key, "deadline", "kind", "audience"], F.asc("pos"))


#: Phrases of recruiting pages, patterns after them, and signs of an active lab.
RECRUITING = [
    "join our lab", "we are recruiting", "prospective students", "open positions", "phd applicants", "ra wanted", "graduate students", "postdoc", "research assistant",
    "now hiring", "positions available", "accepting applications", "looking for students",
]
RECRUITING_PATTERNS = [
    r"\bposition[s]?\s+available\b", r"\bhiring\b", r"\bapplication[s]?\s+welcome\b", r"\bstudent[s]?\s+wanted\b", r"\bopening[s]?\s+for\b", r"\bgraduate\s+student[s]?\s+position[s]?\b",
    r"\bpostdoc[a-z]*\s+position[s]?\b", r"\bra\s+position[s]?\b", r"\bresearch\s+assistant[s]?\s+position[s]?\b",
]
#: Phrases of the other variant, which looks for them anywhere, and signs of a lab.
LAB_PHRASES = [
    "seeking graduate students", "graduate student positions", "phd positions available", "graduate openings", "prospective students", "accepting graduate students", "graduate student opportunities", "phd opportunities", "doctoral positions",
    "join our lab", "join our research group", "lab positions", "research positions", "graduate research assistants", "research opportunities",
    "applications invited", "now accepting applications", "apply to join", "interested students should contact", "prospective applicants",
    "funded positions", "graduate fellowships", "research assistantships", "full funding available", "funded phd positions",
]
ACTIVITY = ["current projects", "recent publications", "news", "updates", "graduate students", "phd students", "current members"]


def recruiting(rows: DataFrame, phrases: list[str] = RECRUITING, patterns: list[str] = RECRUITING_PATTERNS, text: str = "text") -> DataFrame:
    """`rows` with is_recruiting, the phrase or pattern that hit first, and what stands around it.

    The phrase that comes first in the list decides, then the first pattern.
    """
    plain = normalize(text)
    quoted = [rf"\b{p}\b" for p in phrases]
    (name,) = fresh(rows.columns, "_plain")
    # a text is worked out once for all signs, each of which is compiled once; a phrase without signs
    # of a pattern is first looked for as it stands, plain patterns all at once
    meets = lambda t, p, q: (F.contains(t, F.lit(p)) & t.rlike(q)) if re.fullmatch(r"[a-z ]+", p) else t.rlike(q)
    some = lambda t: t.rlike(rf"\b(?:{'|'.join(p[2:] for p in patterns)})") if patterns and all(re.fullmatch(r"\\b(?:[a-z ]|\[[a-z-]+\]|\\[bs]|[?*+])+", p) for p in patterns) else F.lit(True)
    none = F.lit(None).cast("string")
    phrase = lambda t: (F.when(meets(t, p, q), q) for p, q in zip(phrases, quoted, strict=True))
    hit = once(plain, lambda t: F.coalesce(*phrase(t), F.when(some(t), F.coalesce(*(F.when(t.rlike(p), p) for p in patterns), none))))
    marked = rows.withColumn(name, plain).withColumn("hit", hit)
    around = F.lit(None).cast("string")
    for p in reversed([*quoted, *patterns]):
        around = F.when(F.col("hit") == p, snippet(name, p)).otherwise(around)
    return marked.withColumns({"is_recruiting": F.col("hit").isNotNull(), "snippet": around}).drop(name)


def recruiting_by_phrases(text: Column | str, phrases: list[str] = LAB_PHRASES, activity: list[str] = ACTIVITY, least: int = 3) -> Column:
    """Any phrase, or at least three signs of an active lab."""
    has = lambda plain, values: F.size(F.filter(literals(values), lambda p: F.contains(plain, p)))
    return once(normalize(text), lambda plain: (has(plain, phrases) > 0) | (has(plain, activity) >= least))


def recruiting_first(rows: DataFrame, order: list[str], most: int = 50, **options) -> DataFrame:
    """The first `most` rows, by `order`, that are recruiting."""
    return recruiting(rows, **options).filter("is_recruiting").orderBy(*order).limit(most)


#: What supports a field.
SUPPORT = {"toefl_min": r"(?i)toefl.{0,80}?\d{2,3}", "gre_status": r"(?i)\bgre\b", "rec_min": r"(?i)(?:letters?\s+of\s+recommendation|recommendation\s+letters?)"}


def citations(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos, field_name, snippet): the segments that support a field."""
    rows = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(f).alias("field_name"), F.substring("text", 1, 200).alias("snippet"))) for f, p in SUPPORT.items())))
    return segments.select(key, "pos", F.explode(rows).alias("c")).select(key, "pos", "c.*")


def pack_context(segments: DataFrame, score: Column, header: int = 10, most: int = 8000, key: str = "doc_id") -> DataFrame:
    """The segments that fit a context of `most` signs: best first, ending at the first that does
    not fit, even if a later one would."""
    order = W.partitionBy(key).orderBy(F.desc("relevance"), F.asc("pos"))
    before = F.coalesce(F.sum(F.length("text") + header + 2).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    marked = segments.withColumn("relevance", score).withColumn("over", (before + F.length("text") > most).cast("int"))
    return marked.withColumn("stopped", F.max("over").over(order.rowsBetween(W.unboundedPreceding, 0))).filter("stopped = 0").drop("over", "stopped")


def first_hit(segments: DataFrame, value: Column, key: str) -> DataFrame:
    """Per key the value of the earliest segment that has one."""
    return segments.withColumn("value", value).filter("value is not null").groupBy(key).agg(F.min_by("value", "pos").alias("value"))


def from_response(raw: Column | str, schema: str, default: Column) -> Column:
    """A struct read from JSON text, parts filled from the default, all of it where the text is
    no such JSON."""
    read = F.from_json(_col(raw), schema)
    names = StructType.fromDDL(schema).fieldNames()
    some = reduce(Column.__or__, (read[n].isNotNull() for n in names))
    return F.when(F.coalesce(read.isNotNull() & some, F.lit(False)), F.struct(*(F.coalesce(read[n], default[n]).alias(n) for n in names))).otherwise(default)


#: What a prompt is made of.
PROMPT_FIELDS = (("Institution", "institution"), ("School", "school"), ("Department", "department"), ("Program", "program_name"), ("Degree", "degree"), ("Track", "track"), ("Website", "website"))
PROMPT_END = """
Extract graduate admissions requirements and output valid JSON matching the ExtractedRequirements schema.
Include citations mapping each field to the source text that supports it.
Use null for missing or unclear information.
"""


def segment_header(kind: Column | str = "kind") -> Column:
    """The line that stands before a segment, by its kind. Columns: selector, page, line_start,
    line_end."""
    k = _col(kind)
    return (
        F.when(k == "html", F.format_string("HTML SECTION (selector: %s):", "selector"))
        .when(k == "pdf", F.format_string("PDF SECTION (page %s, lines %s-%s):", *(F.col(c).cast("string") for c in ("page", "line_start", "line_end"))))
        .otherwise("CONTENT SECTION:")
    )


def prompts(programs: DataFrame, segments: DataFrame, key: str = "program_id") -> DataFrame:
    """key and the prompt of each program: its fields, and its packed segments in order of `rank`,
    each under its header; a sentence where there is none.

    programs: key and the fields of PROMPT_FIELDS; segments: key, rank, header, text."""
    part = F.concat(F.col("header"), F.lit("\n"), F.col("text"), F.lit("\n"))
    listed = segments.select(key, F.struct("rank", part.alias("part")).alias("s")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["part"]), "\n").alias("told"))
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for name, c in PROMPT_FIELDS]
    content = F.coalesce("told", F.lit("No relevant content found."))
    text = F.concat(F.lit("\nPROGRAM INFORMATION:\n"), F.concat_ws("\n", *lines), F.lit("\n\nCONTENT TO ANALYZE:\n"), content, F.lit("\n" + PROMPT_END))
    return programs.join(listed, key, "left").select(key, text.alias("prompt"))


#: The first sign that occurs names the school; hosts are taken label by label.
SCHOOLS = (("engineering", "School of Engineering"), ("gsb", "Graduate School of Business"), ("business", "School of Business"), ("law", "School of Law"), ("med", "School of Medicine"), ("ed", "School of Education"))
DEPARTMENTS = (("computer science", "Computer Science"), ("electrical engineering", "Electrical Engineering"), ("mechanical engineering", "Mechanical Engineering"), ("mathematics", "Mathematics"), ("physics", "Physics"), ("chemistry", "Chemistry"), ("biology", "Biology"), ("psychology", "Psychology"))
DEGREES = ((r"ph\.?d|doctoral", "PhD"), (r"\bmba\b", "MBA"), (r"\bm\.?s\b|master of science", "MS"), (r"\bm\.?a\b|master of arts", "MA"))


def place_of(pages: DataFrame, segments: DataFrame) -> DataFrame:
    """School, department and degree of each page: from its address, else from its earliest
    telling segment, else a default. pages: url; segments: url, pos, text."""
    labels = F.split(F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))), r"\.")
    path = F.lower(F.translate(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), "-_/", "   "))

    def pick(pairs, hit) -> Column:
        out = F.lit(None).cast("string")
        for sign, value in reversed(pairs):
            out = F.when(hit(sign), value).otherwise(out)
        return out

    low = F.lower("text")
    by_url = {"school": pick(SCHOOLS, lambda s: F.array_contains(labels, s)), "department": pick(DEPARTMENTS, lambda s: F.contains(path, F.lit(s))), "degree": pick(DEGREES, lambda s: path.rlike(s))}
    by_text = {"school": pick([(v.lower(), v) for _, v in SCHOOLS], lambda s: F.contains(low, F.lit(s))), "department": pick(DEPARTMENTS, lambda s: F.contains(low, F.lit("department of " + s))), "degree": pick(DEGREES, lambda s: low.rlike(s))}
    default = {"school": "Graduate School", "department": "General", "degree": "MS"}
    told = segments.groupBy("url").agg(*(F.min_by(v, F.when(v.isNotNull(), F.col("pos"))).alias(f"__{k}") for k, v in by_text.items()))
    return pages.join(told, "url", "left").select("url", *(F.coalesce(v, F.col(f"__{k}"), F.lit(default[k])).alias(k) for k, v in by_url.items()))
