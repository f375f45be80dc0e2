"""Text, name and array expressions. All are built-in expressions; dictionaries are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word, in any script.
WORD = r"(?U)\w+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize(x: Column | str) -> Column:
    """Lower case, trimmed, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(_col(x)), r"(?U)\s+", " "))


def literals(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def once(x: Column, use) -> Column:
    """`use(x)` with x worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def contained(x: Column | str, keywords: list[str]) -> Column:
    """The keywords that occur in the normalised text, in their order."""
    if not keywords:
        return literals([])
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(" ".join(k.lower().split())).alias("plain")) for k in keywords))
    hits = once(F.coalesce(normalize(x), F.lit("")), lambda t: F.filter(known, lambda s: F.contains(t, s["plain"])))
    return F.transform(hits, lambda s: s["k"])


def words(x: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(x)), F.lit(WORD), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def truncate(x: Column | str, n: int) -> Column:
    return F.when(F.length(_col(x)) > n, F.concat(F.substring(_col(x), 1, n - 3), F.lit("..."))).otherwise(_col(x))


def strip_tags(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(_col(x), r"<[^>]+>", " "), r"(?U)\s+", " "))


def first_name(x: Column | str) -> Column:
    return F.get(F.split(F.trim(_col(x)), r"\s+"), F.lit(0))


def last_name(x: Column | str) -> Column:
    return F.element_at(F.split(F.trim(_col(x)), r"\s+"), -1)


def name_variants(x: Column | str) -> Column:
    """The full name; `Last, First Middle` of three parts; `First Last` if that differs."""
    parts = F.split(F.trim(_col(x)), r"\s+")
    three = F.when(F.size(parts) == 3, F.concat(parts[2], F.lit(", "), parts[0], F.lit(" "), parts[1]))
    ends = F.when(F.size(parts) > 2, F.concat_ws(" ", parts[0], F.element_at(parts, -1)))
    return F.array_distinct(F.array_compact(F.array(F.trim(_col(x)), three, ends)))


def hyperlink(url: Column | str, label: Column | str) -> Column:
    quoted = lambda c: F.replace(_col(c), F.lit('"'), F.lit('""'))
    return F.when(F.coalesce(_col(url), F.lit("")) == "", F.lit("")).otherwise(F.format_string('=HYPERLINK("%s","%s")', quoted(url), quoted(label)))


def title_case(x: Column | str) -> Column:
    """A capital after every sign that is no letter."""
    parts = F.regexp_extract_all(_col(x), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def snippet(text: Column | str, pattern: str, around: int = 100, most: int = 240) -> Column:
    """What stands around the first match, trimmed and cut to `most` signs."""
    found = F.regexp_extract(_col(text), pattern, 0)
    at = F.regexp_instr(_col(text), F.lit(pattern))
    start = F.greatest(at - around, F.lit(1))
    cut = F.substring(_col(text), start, at - start + F.length(found) + around)
    return F.when(at > 0, truncate(F.trim(F.regexp_replace(cut, r"\s+", " ")), most))


def from_inverted_index(index: Column | str) -> Column:
    """The text of a word -> positions map; of words at one position the first by name comes first."""
    pairs = F.flatten(F.transform(F.map_entries(_col(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["w"]), " ")


def inverted_index(text: Column | str) -> Column:
    """word -> positions (from 0) of the words between single blanks."""
    parts = F.split(_col(text), " ")
    return F.map_from_entries(F.transform(F.array_distinct(parts), lambda w: F.struct(w.alias("w"), F.filter(F.transform(parts, lambda x, i: F.when(x == w, i)), lambda p: p.isNotNull()).alias("p"))))


def batches(x: Column | str, n: int) -> Column:
    """An array cut into arrays of n."""
    size = F.size(_col(x))
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(_col(x), i + 1, n))


def cache_key(url: Column | str, params: Column | str) -> Column:
    """md5 of the address and the parameters in order of their names."""
    return F.md5(F.to_json(F.struct(_col(url).alias("url"), F.array_sort(F.map_entries(_col(params))).alias("params"))))


def sha_name(url: Column | str, content: Column | str, stamp: Column | str) -> Column:
    """A file name for a page: host, path, time and the start of the content's hash."""
    host = F.replace(F.coalesce(F.try_parse_url(_col(url), F.lit("HOST")), F.lit("")), F.lit("."), F.lit("_"))
    path = F.translate(F.coalesce(F.try_parse_url(_col(url), F.lit("PATH")), F.lit("")), "/.", "__")
    return F.concat_ws("_", F.concat(host, path), F.date_format(_col(stamp), "yyyyMMdd_HHmmss"), F.substring(F.sha2(_col(content), 256), 1, 8))


#: Keyword tiers of a page segment, from strong to weak.
SEGMENT_TIERS = (
    (2.0, ["toefl", "ielts", "gre", "gmat", "deadline", "admission requirements", "application fee", "english proficiency", "minimum score", "gpa"]),
    (1.0, ["application", "graduate", "international", "transcript", "recommendation", "requirements", "masters", "phd"]),
    (0.5, ["program", "university", "school", "department", "degree", "apply"]),
)
#: Keyword tiers for context packing.
PACKING_TIERS = (
    (2.0, ["toefl", "ielts", "duolingo", "english proficiency", "gre", "gmat", "lsat", "mcat", "application deadline", "deadline", "admission requirements", "requirements", "application fee", "fee"]),
    (1.0, ["graduate", "masters", "phd", "doctoral", "recommendation", "transcript", "gpa", "international", "visa"]),
)
#: What a line of an extracted document may hold, two points each.
DOCUMENT_PATTERNS = (r"\btoefl\s+\d{2,3}\b", r"\bielts\s+\d\.\d\b", r"\bgre\s+\d{3}\b", r"\bcode\s*:?\s*\d{4}\b", r"\bdeadline\s*:?\s*\w+\s+\d{1,2}\b", r"\$\d+", r"\bgpa\s+\d\.\d\b")


def _tiers(lower: Column, tiers) -> Column:
    every = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(weight)).alias("w")) for weight, keywords in tiers for k in keywords))
    hits = once(lower, lambda t: F.filter(every, lambda s: F.contains(t, s["k"])))
    return F.aggregate(hits, F.lit(0.0), lambda total, s: total + s["w"])


def segment_relevance(text: Column | str, tiers=SEGMENT_TIERS) -> Column:
    x = _col(text)
    score = _tiers(F.lower(x), tiers) + F.when(x.rlike(r"\b\d{3,4}\b"), 1.0).otherwise(0.0) + F.when(x.rlike(r"\b\d+\s*(?:months?|years?|days?)\b"), 0.5).otherwise(0.0)
    return F.when(F.length(x) < 100, score * 0.5).otherwise(score)


def packing_relevance(text: Column | str, tiers=PACKING_TIERS) -> Column:
    x = _col(text)
    return _tiers(F.lower(x), tiers) + F.when(x.rlike(r"\b\d{3,4}\b"), 1.0).otherwise(0.0) + F.when(x.rlike(r"\$\d+"), 1.0).otherwise(0.0)


def document_relevance(text: Column | str, keywords: list[str], patterns=DOCUMENT_PATTERNS) -> Column:
    x, lower = _col(text), F.lower(_col(text))
    score = _tiers(lower, ((1.0, keywords),))
    for p in patterns:
        score = score + F.when(lower.rlike(p), 2.0).otherwise(0.0)
    return score + F.when(F.length(x) > 200, 1.0).otherwise(0.0) + F.when(F.length(x) > 500, 1.0).otherwise(0.0)


def keep_relevant(segments: DataFrame, score: Column, long: int | None = 500, least: float = 0.0) -> DataFrame:
    """Segments that score more than `least`, or are longer than `long` (0 and 500 for pages; 0.5 and
    none for laid-out documents)."""
    kept = F.col("relevance") > least
    return segments.withColumn("relevance", score).filter(kept if long is None else kept | (F.length("text") > long))
