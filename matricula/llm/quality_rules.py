"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected in any stratum.

Every rule is a number that grows as a text gets worse, with a fixed list of cutoffs from mild to
strict. The cutoffs of all rules make one path (`PATH`), fixed beforehand: each step makes one rule
stricter, the rules in turn. A labelled holdout (the documents labelled good) counts, per stratum
(language), how many good documents the rules reject together at each step. A step is certified if
the exact binomial (Clopper-Pearson) upper bound of the false rejection rate is at most
`max_rejection` and all steps before it are certified: testing in a fixed order that ends with the
first failure needs no further correction within a stratum, and the level is divided by the number
of strata (Bonferroni). So, at the level, no stratum loses more than `max_rejection` of its good
documents by all rules together.

Each stratum is tested by itself. One with too few good documents for the bound to be met even if
none of them were rejected (`least_tested`) is not tested, takes no share of the level, and, like one
that certifies nothing, rejects nothing; so the guarantee holds for every stratum.

All of it is built-in expressions; the features are computed once and written, and only they
(a few numbers for each document) are joined. Equal windows and lines are found by 64-bit hashes
and by value respectively.

Defined results: null text has no words; base_failed then holds. A null language is the stratum
`und`. Repeated rows and null ids are judged row by row. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WORD_BREAK, materialize

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30

#: Rules: the number, and its cutoffs from mild to strict; a text is rejected above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.25, 0.2, 0.15, 0.1, 0.05, 0.02)),
    "long_words": ("word_chars / greatest(n_words, 1)", (40, 30, 25, 20, 16, 14, 12, 11, 10)),
}
#: The path: (rule, cutoff) by how far a cutoff is along its rule's list.
PATH = [(rule, float(cut)) for _, _, rule, cut in sorted(((i + 1) / len(cuts), k, rule, cut) for k, (rule, (_, cuts)) in enumerate(RULES.items()) for i, cut in enumerate(cuts))]
#: Allowed false rejection of good documents over all rules together, and the level of the test.
MAX_REJECTION, LEVEL = 0.03, 0.05
#: Strata up to which the cutoffs are broadcast; beyond, they are joined by shuffle.
BROADCAST_STRATA = 10_000


def features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of each whole text."""
    text = F.coalesce("text", F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK + "+"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    one = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("und")).alias("stratum"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
        F.transform(lines, lambda x: F.sha2(x, 256)).alias("lines"),
    )
    at = lambda i, k: F.get(F.col("words"), i + k)
    two = one.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") >= WINDOW,
            F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    numbered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    kept = [c for c in two.columns if c != "windows"]
    three = two.select(*kept, F.when(some, numbered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("sorted"))
    same = lambda s, k: F.coalesce(F.get(F.col("sorted"), k)["h"] == s["h"], F.lit(False))
    again = F.array_sort(F.transform(F.filter("sorted", lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"]))

    def cover(state: Column, i: Column) -> Column:
        end = i + WINDOW
        return F.struct(end.alias("end"), (state["n"] + (end - F.greatest(i, state["end"]))).alias("n"))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return three.select(*kept, F.aggregate(again, zero, cover)["n"].cast("long").alias("n_repeat_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial count, summed term by term in logarithms."""
    first = n * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)

    def step(state: Column, i: Column) -> Column:
        term = state["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(term, state["sum"])
        total = top + F.log(F.exp(term - top) + F.exp(state["sum"] - top))
        return F.struct(term.alias("term"), total.alias("sum"))

    start = F.struct(first.cast("double").alias("term"), first.cast("double").alias("sum"))
    summed = F.aggregate(F.sequence(F.lit(1), k.cast("int")), start, step)["sum"]
    return F.when(k == 0, F.exp(first.cast("double"))).when(k > n * p, F.lit(1.0)).otherwise(F.exp(summed))


def fails_at() -> Column:
    """The first step of the path that rejects a text (from 1), null if none does."""
    first = {rule: F.lit(None).cast("int") for rule in RULES}
    for step, (rule, cut) in reversed(list(enumerate(PATH, 1))):
        first[rule] = F.when(F.expr(RULES[rule][0]) > cut, step).otherwise(first[rule])
    return F.least(*first.values())


def least_tested(max_rejection: float = MAX_REJECTION, level: float = LEVEL) -> int:
    """Good documents below which no test can succeed at the level, even undivided."""
    return math.ceil(math.log(level) / math.log1p(-max_rejection))


def certify(measured: DataFrame, good: DataFrame, max_rejection: float = MAX_REJECTION, level: float = LEVEL) -> DataFrame:
    """stratum, n (its good documents), certified (steps of the path), and the cutoff of each rule at
    that step, infinite where there is none; of the strata that are tested.

    Documents that already fail the base rules are no evidence for the cutoffs.
    """
    held = measured.join(good.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").filter("not base_failed")
    by_stratum = materialize(held.groupBy("stratum", "fails_at").agg(F.count(F.lit(1)).alias("n")))
    tests = materialize(by_stratum.groupBy("stratum").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_tested(max_rejection, level)))
    small = level / max(1, tests.count())
    step = F.explode(F.sequence(F.lit(1), F.lit(len(PATH)))).alias("step")
    rejected = by_stratum.filter("fails_at is not null").select("stratum", "n", F.explode(F.sequence("fails_at", F.lit(len(PATH)))).alias("step"))
    rejected = rejected.groupBy("stratum", "step").agg(F.sum("n").alias("k"))
    tested = tests.select("stratum", "n", step).join(rejected, ["stratum", "step"], "left")
    unsure = F.when(binomial_cdf(F.coalesce("k", F.lit(0)), F.col("n"), max_rejection) > small, F.col("step") - 1)
    found = tested.groupBy("stratum", "n").agg(F.coalesce(F.min(unsure), F.lit(len(PATH))).alias("certified"))
    cutoffs = []
    for rule in RULES:
        reached = F.lit(float("inf"))
        for step, (name, cut) in enumerate(PATH, 1):
            if name == rule:
                reached = F.when(F.col("certified") >= step, cut).otherwise(reached)
        cutoffs.append(reached.alias(f"max_{rule}"))
    return found.select("stratum", "n", "certified", *cutoffs)


def judge(docs: DataFrame, labels: DataFrame, max_rejection: float = MAX_REJECTION, level: float = LEVEL) -> DataFrame:
    """One row per document: the counts, base_failed and kept; then the first step of the path that
    rejects it (null: none) and the steps certified in its stratum. `labels`: doc_id, quality (1:
    good)."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    measured = materialize(features(docs).withColumn("base_failed", failed).withColumn("fails_at", fails_at()))
    steps = materialize(certify(measured, labels.filter("quality = 1"), max_rejection, level)).select("stratum", "certified")
    small = F.broadcast(steps) if steps.count() <= BROADCAST_STRATA else steps
    joined = measured.join(small, "stratum", "left").withColumn("certified", F.coalesce("certified", F.lit(0)))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("fails_at") <= F.col("certified"), F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "fails_at", "certified")
