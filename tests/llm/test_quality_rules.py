import math
import re
from collections import Counter

from pyspark.sql import functions as F

from matricula.llm import quality_rules, queries
from tests.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, symbols = len(words), sum(c in "#*$%&|<>" for c in text)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed, len(lines)


def cdf(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def verdicts(docs, good):
    """Base counts and kept, straight from the definitions."""
    rules = {
        "symbols": lambda c: c[2] / max(c[1], 1),
        "dup_lines": lambda c: c[3] / max(c[6], 1),
        "repeats": lambda c: c[4] / max(c[0], 1),
        "long_words": lambda c: c[1] / max(c[0], 1),
    }
    rows = [(d, lang or "und", counts(t)) for d, t, lang in docs]
    first = lambda c: min((i for i, (r, cut) in enumerate(quality_rules.PATH, 1) if rules[r](c) > cut), default=None)
    held = [(s, first(c)) for d, s, c in rows if d in good and not c[5]]
    size = Counter(s for s, _ in held)
    tested = [s for s, n in size.items() if (1 - quality_rules.MAX_REJECTION) ** n <= quality_rules.LEVEL]
    steps = {}
    for t in tested:
        mine = [f for s, f in held if s == t]
        steps[t] = 0
        for step in range(1, len(quality_rules.PATH) + 1):
            k = sum(f is not None and f <= step for f in mine)
            if cdf(k, len(mine), quality_rules.MAX_REJECTION) > quality_rules.LEVEL / len(tested):
                break
            steps[t] = step
    return sorted(((d, *c[:6], not c[5] and not (first(c) and first(c) <= steps.get(s, 0)), first(c), steps.get(s, 0)) for d, s, c in rows), key=str)


def test_query(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert sorted(map(tuple, queries.op3_quality_rules(spark, SF).collect()), key=str) == verdicts(docs, good)


def test_the_method_rejects_and_keeps_its_promise(spark):
    folder = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op3_quality_rules(spark, folder).collect()
    assert any(not r.kept and not r.base_failed for r in rows)
    good = [r for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(not r.kept for r in good) <= quality_rules.MAX_REJECTION * len(good)


def test_cutoffs_need_evidence(spark):
    """Enough good documents certify a cutoff that junk fails; few certify nothing."""
    text = " ".join(f"w{i}" for i in range(30))
    junk = " ".join(f"w{i}***" for i in range(30))
    docs = [(i, text, "en") for i in range(2000)] + [(2000, junk, "en"), (2001, junk, "xx"), (2002, text, "xx"), (2003, junk, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(2000)] + [(2002, 1), (2000, 0)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(frame, labels).collect()}
    assert not kept[2000] and kept[2001] and kept[2002] and kept[2003] and kept[5]


def test_each_stratum_is_tested_by_itself(spark):
    """Two languages of 150 good documents certify, each by itself; one of 90 cannot, and costs the
    others no level."""
    text, junk = (" ".join(f"w{i}{x}" for i in range(30)) for x in ("", "***"))
    docs = [(i, text, "a" if i < 150 else "b" if i < 300 else "c") for i in range(390)] + [(400 + k, junk, x) for k, x in enumerate("abcd")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(390)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(frame, labels).collect()}
    assert [kept[400 + k] for k in range(4)] == [False, False, True, True] and all(kept[i] for i in range(390))
    assert quality_rules.least_tested() == 99


def test_binomial(spark):
    rows = [(k, n) for n in (1, 7, 300, 5000) for k in (0, 1, 3, 10) if k <= n]
    found = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality_rules.binomial_cdf(F.col("k"), F.col("n"), 0.005).alias("p")).collect()
    for r in found:
        if r.k <= r.n * 0.005 or r.k == 0:
            assert math.isclose(r.p, cdf(r.k, r.n, 0.005), rel_tol=1e-9)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (99, None), (None, 1)], "doc_id long, quality int")
    docs = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    assert sorted(map(tuple, quality_rules.judge(odd_docs, labels).collect()), key=str) == verdicts(docs, {1})
    assert quality_rules.judge(no_docs, labels).collect() == []
    assert quality_rules.judge(odd_docs, labels.limit(0)).count() == odd_docs.count()
