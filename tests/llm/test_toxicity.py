import zlib

import numpy as np

from matricula.llm import queries, toxicity


def brute_kernel(s, t):
    """Weighted common subsequences of three letters, spans of at most SPAN letters; a unit's start
    is one."""

    def features(x):
        x, out = "^" + x, {}
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, min(len(x), i + toxicity.SPAN)):
                    key = x[i] + x[j] + x[k]
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = features(s), features(t)
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    return dot(a, b) / max(1e-9, (dot(a, a) * dot(b, b)) ** 0.5)


def test_kernel_values():
    words = ["idiot", "idxiot", "idiotischer", "bananenbrot", "banana", "ananas", "nanabana", "ab", "abc", "aaaaaaa", "\u0434\u0443\u0440\u0430\u043a", "\u0434\u0443\u0440\u0430", "\u043a\u043e\u0448\u043a\u0430"]
    landmarks = ["idiot", "banana", "aaaa", "abc", "\u0434\u0443\u0440\u0430\u043a"]
    found = toxicity.Kernel(landmarks).values(words)
    heads = [[w, w[: toxicity.HEAD]] if len(w) > toxicity.HEAD + 1 else [w] for w in words]
    want = [[max(brute_kernel(h, x) for h in head) ** toxicity.POWER for x in landmarks] for head in heads]
    assert np.allclose(found, want, atol=1e-5)


def test_a_sentence_counts_by_its_best_unit():
    kernel = toxicity.Kernel(["idiot", "banana"])
    found = toxicity.Features(kernel).of([["a", "idiott", "banana"], [], ["ananas"] * 40_000, ["idiott"]])
    each = kernel.values(["idiott", "banana", "ananas"])
    want = [np.maximum(np.maximum(each[0], each[1]), kernel.values(["a"])[0]), [0, 0], each[2], each[0]]
    assert np.allclose(found, want, atol=0.5 / 255 + 1e-6)
    small = toxicity.Features(kernel, most=2)  # a memo that is always full
    for _ in range(3):
        assert np.allclose(small.of([["a", "idiott", "banana"], ["xyz", "ananas"]]), [want[0], np.maximum(each[2], kernel.values(["xyz"])[0])], atol=0.5 / 255 + 1e-6)
        assert len(small.number) == 2


def test_pieces_of_long_units():
    def plain(unit):
        signs = [toxicity._START] + [toxicity._sign(c) for c in unit if c.isalpha()]
        return [(signs[at : at + 16] + [0] * 16)[:16] for at in range(0, max(1, len(signs) - 8), 8)]

    units = ["", "a1b!", "x" * 15, "abcdefghijklmnop", "abcdefghijklmnopq", "ab" * 12, "cd" * 12 + "e", "\u0434" * 40, "\U0001d41a b", "..."]
    rows, owner = toxicity.coded(units)
    assert [(int(o), r.tolist()) for o, r in zip(owner, rows, strict=True)] == [(k, r) for k, u in enumerate(units) for r in plain(u)]


def test_exact_svm_finds_the_telling_unit():
    rng, rows = np.random.default_rng(3), []
    y = np.repeat([1.0, -1.0], 300)
    for i in range(600):
        rows += [(i, int(u)) for u in set(rng.integers(1, 50, 8).tolist())] + ([(i, 0)] if i < 200 else [])
    sentence, unit = map(np.array, zip(*rows, strict=True))
    value, margin = toxicity.exact_svm(sentence, unit, y, toxicity.balanced(y), 50, 5.0)
    assert value.argmax() == 0 and margin[:200].mean() > margin[300:].mean() + 0.5
    x = np.zeros((600, 51))
    x[sentence, unit], x[:, 50] = 1, 1
    w = np.append(value, margin[0] - value[unit[sentence == 0]].sum())
    inside = y * (x @ w) < 1
    assert np.abs(5.0 * w + x[inside].T @ (x[inside] @ w - y[inside])).max() < 0.5  # nothing pulls any more


def test_held_out_and_disguised(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = queries.op2_toxicity(spark, folder).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    bad, good = ([r.predicted for r in held if toxic[r.doc_id] == kind] for kind in (1, 0))
    assert sum(bad) / len(bad) >= 0.8 and sum(good) / len(good) <= 0.05
    model = toxicity.train(docs, labels)
    told = ["the idiot of onthan", "an i.d.i.o.t and ering", "thing idiiot is", "so woorthless onea", "a onblean thing is of onthan"]
    margins = dict(zip(told, model.margins([toxicity.units_of(x) for x in told]), strict=True))
    assert all(margins[x] > margins[told[-1]] + 0.5 for x in told[:-1])
    assert "idiot" in toxicity.units_of("you I d i o t now")


def test_hits_of_units():
    kernel = toxicity.Kernel(["idiot", "banana"])
    model = toxicity.Model(kernel, np.array([2.0, -1.0]), 0.4, np.zeros(toxicity.SEEN + 1))
    parts = [["idiot", "idiot", "xyz"], [], ["banana"], ["idiott", "idxiot", "qq"] * 20_000]
    values, hits = toxicity.Features(kernel, model).with_hits(parts)
    own = {u: kernel.values([u])[0] @ model.alpha - model.shift for p in parts for u in p}
    assert hits.tolist() == [[sum(own[u] > t for u in p) for t in toxicity.TOLD] for p in parts]
    assert np.allclose(values[2], kernel.values(["banana"])[0], atol=0.01)


def test_long_sentences_are_cut():
    text = " ".join(f"w{i}" for i in range(40)) + ". Short one!"
    assert [len(x) for x in toxicity.sentences(text)] == [16, 16, 8, 2] and toxicity.sentences(None) == []


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(no_docs, labels).collect() == []
    assert {r.score for r in toxicity.classify(odd_docs, labels.limit(0)).collect()} == {0.0}
