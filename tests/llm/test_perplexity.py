import math
from collections import Counter, defaultdict

from matricula.llm import perplexity, queries
from matricula.llm.common import materialize

START, END = "\x02", "\x03"


def taken(counts):
    """Discounts by count, worked out from the published formulas."""
    n = Counter(counts.values())
    if not (n[1] and n[2]):
        return {1: 0.5, 2: 0.5, 3: 0.5}
    y = n[1] / (n[1] + 2 * n[2])
    raw = {1: 1 - 2 * y * n[2] / n[1], 2: 2 - 3 * y * n[3] / n[2], 3: 3 - 4 * y * n[4] / n[3] if n[3] else 1.5}
    return {k: min(max(d, 0.05), k - 0.05) for k, d in raw.items()}


def brute_model(texts, order=5):
    """Interpolated modified Kneser-Ney over dictionaries, by recursion on the order."""
    padded = [START * order + t.lower() + END for t in texts]
    counts = {order: Counter(t[i - order + 1 : i + 1] for t in padded for i in range(order, len(t)))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {n: taken(c) for n, c in counts.items()}
    followers = {n: defaultdict(dict) for n in counts}
    for n, found in counts.items():
        for g, c in found.items():
            followers[n][g[:-1]][g[-1]] = c

    def p(context, sign, n):
        if n == 0:
            return 1 / (len(counts[1]) + 1)
        seen = followers[n].get(context[len(context) - n + 1 :] if n > 1 else "")
        lower = p(context, sign, n - 1)
        if not seen:
            return lower
        d, total = discount[n], sum(seen.values())
        c = seen.get(sign, 0)
        return ((c - d[min(c, 3)]) if c else 0) / total + sum(d[min(x, 3)] for x in seen.values()) / total * lower

    return lambda context, sign: p(context, sign, order)


def test_scores(spark):
    texts = ["the cat sat on the mat", "a cat and a hat", "the dog sat", "that is a hat on the cat", "zzz ###", "", None, "The Cat \u00e9", "\u4e2d\u6587 the", "a\x02b"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    counts = materialize(perplexity.count_grams(docs.filter("doc_id < 4")))
    p = brute_model(texts[:4])
    for top in (0, 40, 1 << 18):  # how many grams skip the join changes nothing
        found = {r.doc_id: r for r in perplexity.likelihoods(docs, counts, top).collect()}
        for i, t in enumerate(texts):
            signs = (t or "").lower().replace(START, "\ufffd")
            assert found[i].n_signs == len(signs)
            if not signs:
                assert found[i].nll is None
                continue
            padded = START * 5 + signs + END
            want = -sum(math.log(p(padded[k - 4 : k], padded[k])) for k in range(5, len(padded))) / (len(signs) + 1)
            assert math.isclose(found[i].nll, want, rel_tol=1e-9)
    signs = {x for t in texts[:4] for x in t} | {END}
    assert math.isclose(sum(p("the ", x) for x in signs) + p("the ", "#"), 1, rel_tol=1e-9)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    import numpy as np

    characters, sizes = perplexity.code_points(["abcdefgh" * 40, "x" * 300, ""])
    whole = [(g.tobytes(), o) for grams, window, owner in perplexity.distinct_windows(characters, sizes, 4) for g, o in zip(grams[window], owner.tolist(), strict=True)]
    monkeypatch.setattr(perplexity, "PLACES", 37)
    parts = [(g.tobytes(), o) for grams, window, owner in perplexity.distinct_windows(characters, sizes, 4) for g, o in zip(grams[window], owner.tolist(), strict=True)]
    assert parts == whole and len(whole) == 320 + 300 + 3 * 2 and isinstance(characters, np.ndarray)


def test_query_keeps_good_text(spark):
    folder = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op4_perplexity(spark, folder).collect()
    assert len(rows) == 1000
    for want, least, most in ((1, 0.98, 1), (0, 0, 0.4)):
        kept = [r.kept for r in rows if quality.get(r.doc_id) == want]
        assert least <= sum(kept) / len(kept) <= most


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 1), (2, 1), (6, 0), (None, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in perplexity.judge(odd_docs, labels).collect()}
    assert set(rows) == set(range(1, 9)) and rows[2].perplexity is None and not rows[3].kept and rows[1].kept
    assert perplexity.judge(no_docs, labels).collect() == []
    assert all(r.kept == (r.perplexity is not None) for r in perplexity.judge(odd_docs, labels.limit(0)).collect())


def test_limits_of_each_language(spark):
    """Verdicts from the documents' own perplexities: medians and quantiles, drawn to the common ones."""
    folder = "/root/testdata/sf0.01"
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 1").collect()}
    rows = queries.op4_perplexity(spark, folder).collect()
    held = {r.doc_id for r in spark.createDataFrame([(i,) for i in good], "doc_id long").filter(perplexity.held_out()).collect()}
    nll = {r.doc_id: math.log(r.perplexity) for r in rows if r.perplexity}
    low = lambda values, q: sorted(values)[max(0, math.ceil(q * len(values)) - 1)]
    mine = [r for r in rows if r.doc_id in held and r.doc_id in nll]
    common, few = low([nll[r.doc_id] for r in mine], 0.5), perplexity.FEW
    median, above = {}, {}
    for lang in {r.lang for r in mine}:
        own = [nll[r.doc_id] for r in mine if r.lang == lang]
        median[lang] = (len(own) * low(own, 0.5) + few * common) / (len(own) + few)

    def over(r):
        m = median.get(r.lang, common)
        return (nll[r.doc_id] * r.n_signs + m * perplexity.PRIOR) / (r.n_signs + perplexity.PRIOR) - m

    every = low([over(r) for r in mine], perplexity.QUANTILE)
    for lang in median:
        own = [over(r) for r in mine if r.lang == lang]
        above[lang] = (len(own) * low(own, perplexity.QUANTILE) + few * every) / (len(own) + few)
    assert len(set(median.values())) == len(median) > 2
    for r in rows:
        m = median.get(r.lang, common)
        gap = (m + above.get(r.lang, every)) * perplexity.MARGIN - (m + over(r)) if r.doc_id in nll else -1
        assert r.kept == (gap >= 0) or abs(gap) < 1e-6
