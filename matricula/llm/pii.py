"""Personal data in whole texts: patterns propose spans, checksums confirm, context scores them.

All work is built-in expressions. Positions come from the text between matches: a kind's matches
and the pieces that they leave are walked once. Patterns start only where a run of their own
characters starts (or the last match ended), and repeat possessively, which finds the same
leftmost matches in linear time and without deep recursion; places are added up in groups of
matches, so that a text of a million matches is no trouble.

Kinds: email; ip (each part at most 255); card (13 to 19 digits, Luhn); phone (9 to 15 digits);
iban (the length of its country, mod 97). A failing match is dropped, and not tried again further on. Whole words near a span
raise its score. The report drops no span for its score; `redact` takes those that reach a score.

Defined results: null text is empty; null ids, repeated rows and extra columns do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: The signs of an IBAN by country, from the public registry.
IBAN_SIGNS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Two letters of a country, two digits, and as many signs more as its numbers have; so what follows
#: an IBAN, a word in capitals or another IBAN, is not taken for a part of it.
IBAN = "(?:" + "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_SIGNS.items()) + ")"

#: What each kind looks like, a cheap test that a text may hold it, its score when
#: confirmed, and words that make it likelier.
_LOCAL = r"A-Za-z0-9._%+-"
KINDS = {
    "email": (rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "e?mails?|contact|write|reply|address"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, "ip|hosts?|servers?|address|login|clients?"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", 0.8, "cards?|visa|credit|debit|pay|payment|cvv|expir(?:y|es|ed|ation)"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.7, "(?:tele)?phone|tel|call|fax|mobile|sms"),
    "iban": (rf"(?<![A-Za-z0-9]){IBAN}(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", 0.8, "iban|bank|account|transfer|konto|cuenta|compte"),
}
BASE = ("email", "ip", "card", "phone")
#: Code points on either side of a span, up to the next match of its kind, that are searched for
#: its words, and what they add.
NEAR, CONTEXT = 40, 0.1
#: Matches whose places are added up together.
GROUP = 128


def near_pattern(kind: str) -> str:
    """The words of a kind, as whole words of lower-case text."""
    return f"(?:^|[^a-z])(?:{KINDS[kind][3]})(?:$|[^a-z])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def step(total: Column, k: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - k + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(k % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(digit)

    return F.length(digits).between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0)


def _mod97(value: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(rest: Column, sign: Column) -> Column:
        number = F.conv(sign, 36, 10).cast("int")
        return (rest * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def _ip(value: Column) -> Column:
    small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.right(part, F.lit(3))).cast("int") <= 255)
    return F.forall(F.split(value, r"\."), small)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": _ip,
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
    "iban": _mod97,
}

_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
_STEP = "array<struct<gap:int,value:string,before:string,after:string>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, kind: str) -> Column:
    """Confirmed matches of a kind: start and end (code points, end exclusive), the string, and the
    NEAR code points on either side of it, or as many as there are up to the next match."""
    pattern, likely, _, _ = KINDS[kind]

    def steps(gaps: Column, values: Column) -> Column:
        after = F.slice(gaps, 2, F.size(gaps))
        pairs = F.arrays_zip(gaps.alias("gap"), values.alias("value"), after.alias("after"))
        return F.transform(F.slice(pairs, 1, F.size(values)), lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["value"].alias("value"), F.right(x["gap"], F.lit(NEAR)).alias("before"), F.left(x["after"], F.lit(NEAR)).alias("after")))

    def walk(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.array_append(state["found"], span).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def grouped(all_: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.size(all_) / GROUP).cast("int"))
        return F.transform(numbers, lambda g: F.aggregate(F.slice(all_, g * GROUP + 1, GROUP), zero, walk))

    def start(state: Column, group: Column) -> Column:
        return F.struct((state["at"] + group["at"]).alias("at"), F.array_append(state["starts"], state["at"]).alias("starts"))

    def moved(group: Column, by: Column) -> Column:
        return F.transform(group["found"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), *(s[c].alias(c) for c in ("value", "before", "after"))))

    def joined(groups: Column) -> Column:
        starts = F.aggregate(groups, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), start)["starts"]
        return F.flatten(F.zip_with(groups, starts, moved))

    found = _once(F.split(text, pattern, -1), lambda gaps: _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: _once(steps(gaps, values).cast(_STEP), lambda all_: _once(grouped(all_), joined))))
    sure = F.filter(found, lambda s: VALID[kind](s["value"]))
    test = F.contains(text, F.lit("@")) if likely == "@" else text.rlike(likely)
    return F.when(test, sure).otherwise(F.array().cast(_SPAN))


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _score(kind: str, s: Column) -> Column:
    """The kind's own score, and more if one of its words stands near the span."""
    near = F.lower(F.concat_ws(" ", s["before"], s["after"])).rlike(near_pattern(kind))
    return F.lit(KINDS[kind][2]) + F.when(near, CONTEXT).otherwise(0.0)


def _scored(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.format_string("%s:%d:%.2f", F.lit(kind), s["start"], _score(kind, s)))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the text, and per kind an array of confirmed spans."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return source.select("*", *(matches(F.col("text"), k).alias(k) for k in KINDS))


def report(docs: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, all spans, and all scores, one row per document."""
    spans = find_spans(docs)
    joined = lambda kinds: F.array_join(F.concat(*(_listed(k, F.col(k)) for k in kinds)), ",")
    return spans.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(BASE), 256).alias("base_sha256"),
        joined(KINDS).alias("spans"),
        F.array_join(F.concat(*(_scored(k, F.col(k)) for k in KINDS)), ",").alias("scores"),
    )


def redact(docs: DataFrame, min_score: float = 0.0) -> DataFrame:
    """`docs` with each confirmed span of the text that scores `min_score` or more, by its kind and
    the words near it, replaced by its kind in angle brackets.

    Spans that overlap are replaced from the first start on; a span inside a replaced one goes
    with it. Null text stays null.
    """
    chosen = [k for k in KINDS if KINDS[k][2] + CONTEXT >= min_score]
    text = F.coalesce("text", F.lit(""))
    sure = lambda k: F.filter(matches(text, k), lambda s: F.round(_score(k, s), 6) >= min_score)
    names = dict(zip(chosen, fresh(docs.columns, *(f"__{k}" for k in chosen)), strict=True))
    spans = docs.select("*", *(sure(k).alias(names[k]) for k in chosen))
    named = lambda kind: F.transform(names[kind], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    every = F.concat(*(named(k) for k in chosen)) if chosen else F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def cut(state: Column, s: Column) -> Column:
        piece = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), piece.alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.array_sort(every), zero, cut, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return spans.withColumn("text", F.when(F.col("text").isNotNull(), done)).select(*docs.columns)
