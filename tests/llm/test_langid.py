import random
import zlib
from collections import Counter

import numpy as np

from matricula.llm import langid, queries


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op8_language_id(spark, folder).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_windows_cover_the_text():
    texts = [b"", b"a" * 256, b"b" * 257, b"c" * 1000]
    x, owner, sizes = langid.windows(texts)
    for k, t in enumerate(texts):
        mine = x[owner == k].reshape(-1)
        assert bytes(mine[: len(t)]) == t and (mine[len(t) :] == 0x20).all()
    assert sizes[owner == 2].tolist() == [256, 1]


def plain_scores(net, window):
    """The network of one window, filter by filter and place by place."""
    pooled = []
    for width, f, b in zip(langid.WIDTHS, net.filters, net.bias, strict=True):
        for k in range(f.shape[1]):
            found = [sum(float(net.embedding[window[at + i]] @ f[i * net.embedding.shape[1] : (i + 1) * net.embedding.shape[1], k]) for i in range(width)) for at in range(len(window) - width + 1)]
            pooled.append(max(0.0, max(found) + float(b[k])))
    return np.array([sum(p * float(w) for p, w in zip(pooled, net.out[:, c], strict=True)) + float(net.shift[c]) for c in range(len(net.languages))])


def test_scores_are_those_of_the_plain_network():
    rng = np.random.default_rng(1)
    net = langid.ByteConvNet(["a", "b", "c"], embedding=3, filters=4)
    for p in (*net.bias, net.shift):
        p[:] = rng.normal(0, 0.1, p.shape)
    x = rng.integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    assert np.allclose(net.scores(x), [plain_scores(net, w) for w in x], atol=1e-4)


def test_a_step_follows_the_numeric_gradient():
    """The first step of Adam goes against the sign of each weight's slope, measured by differences."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(97, 123, (8, langid.WINDOW)).astype(np.uint8), np.array([0, 1] * 4)
    make = lambda: langid.ByteConvNet(["a", "b"], embedding=3, filters=4)

    def loss(net):
        z = net.scores(x).astype(np.float64)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(8), y]))

    moved, net = make(), make()
    moved.train(x, y, epochs=1, rate=1e-3)
    agree = seen = 0
    for name in ("out", "shift", "embedding"):
        flat, after = getattr(net, name).reshape(-1), getattr(moved, name).reshape(-1)
        for i in rng.permutation(len(flat))[:40].tolist():
            old = flat[i]
            flat[i] = old + 1e-2
            high = loss(net)
            flat[i] = old - 1e-2
            slope = (high - loss(net)) / 2e-2
            flat[i] = old
            if abs(slope) > 1e-3:
                seen += 1
                agree += (after[i] - old) * slope < 0
    assert seen > 20 and agree >= 0.9 * seen


def test_gradient():
    """Training lowers the loss of a small sample, and the scores tell its classes apart."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(97, 105, (60, 256)), rng.integers(101, 110, (60, 256))]).astype(np.uint8)
    y = np.repeat([0, 1], 60)
    net = langid.ByteConvNet(["a", "b"])
    net.train(x, y, epochs=8)
    assert (net.scores(x).argmax(axis=1) == y).mean() > 0.95


def test_an_unlearned_language_and_letter_junk_go(spark):
    rng = np.random.default_rng(4)
    finnish = "Talvella järvi jäätyy ja kylän lapset luistelevat sen yli kouluun, mutta keväällä tie kiertää metsän kautta ja matka kestää kaksi kertaa pidempään. "
    russian = "Зимой озеро замерзает, и дети идут в школу по льду, но весной дорога идёт через лес. "
    junk = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz   "), 600))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    planted = spark.createDataFrame([(10**9 + k, t * 2, None) for k, t in enumerate((finnish, russian, junk))], docs.schema)
    kept = {r.doc_id for r in langid.keep_known(docs.unionByName(planted)).select("doc_id").collect()}
    assert not kept & {10**9, 10**9 + 1, 10**9 + 2} and len(kept) >= 0.99 * docs.count()


def test_usual_grams_are_counted_over_all_texts(spark):
    """7,000 texts of a language, more than the network learns from, and another with copies."""
    rng = random.Random(6)
    signs, weights = "abcdefghijklmnopqrstuvwxyzé", [2.0**-k for k in range(27)]
    rows = [(" ".join("".join(rng.choices(signs, weights, k=rng.randrange(2, 9))) for _ in range(12)), "a") for _ in range(7000)]
    rows += [("zq " * k, "b") for k in range(1, 40)] + [("wv wv wv", "b")] * 5000 + [(None, "a"), ("zzz", None)]
    grams, usual = lambda t: [int(g) for g in langid.letter_grams(t)], set()
    for lang in "ab":
        n = Counter(g for t in {t for t, x in rows if x == lang and t} for g in grams(t))
        left = langid.USUAL * sum(n.values())
        for step in sorted(set(n.values()), reverse=True):
            if left > 0:
                usual |= {g for g in n if n[g] == step}
            left -= sum(x for x in n.values() if x == step)
    bits = langid.usual_grams(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    asked = {g: g.to_bytes(3, "big").decode("utf-8", "ignore") for t, _ in rows if t for g in grams(t)}
    asked = {g: t for g, t in asked.items() if grams(t) == [g]}
    shares = langid.shares(list(asked.values()), bits).to_pylist()
    assert {g for g, x in zip(asked, shares, strict=True) if x == 1} == usual & set(asked) and 100 < len(usual & set(asked)) < len(asked)


def test_odd_rows(spark, odd_docs, no_docs):
    found = {r.doc_id: r.lang_pred for r in langid.identify(odd_docs).collect()}
    assert found[2] == found[3] == found[8] == "und" and found[4] in {"en", "fr", "de"}
    assert langid.identify(no_docs).collect() == []
    assert {r.lang_pred for r in langid.identify(odd_docs.withColumn("lang", odd_docs["lang"].substr(9, 1)).replace("", None, "lang")).collect()} == {"und"}
    kept = langid.keep_known(odd_docs.withColumnRenamed("sequence_id", "score"))
    assert kept.columns[-1] == "score" and {r.doc_id for r in kept.collect()} <= {1, 4, 5, 6, 7}


def test_many_languages(spark):
    """1,500 languages of two texts each: all are learned, and have a place in the network."""
    rows = [(f"word{i} text{i} {'abcdefgh'[i % 8] * 9}", f"l{i}") for i in range(1500)]
    languages, picked = langid._sampled(spark.createDataFrame(rows, "text string, lang string"), 3000)
    assert len(languages) == 1500 and picked.count() == 1500
    assert len(langid._sampled(spark.createDataFrame(rows, "text string, lang string"), 100)[0]) == 100
