import random
import time

import numpy as np
import pyarrow as pa

from matricula.llm import decontaminate, queries
from tests.conftest import SF


def brute_align(item, text):
    rows = [[0] * (len(text) + 1)]
    for a in item:
        row = [0]
        for j, b in enumerate(text, 1):
            row.append(max(0, rows[-1][j - 1] + (2 if a == b else -1), rows[-1][j] - 1, row[j - 1] - 1))
        rows.append(row)
    return max(map(max, rows))


def test_alignment_scores():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item, text = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(1, 20))
        score, first, last = decontaminate.align(item, text)
        assert score == brute_align(item.tolist(), text.tolist())
        if score:
            assert brute_align(item.tolist(), text[first : last + 1].tolist()) == score


def brute(docs, items):
    """Every item against every text, aligned in full."""
    out = {}
    for doc_id, text in docs:
        words = decontaminate.words_of(text)
        for item_id, item in items:
            codes = {w: i for i, w in enumerate(dict.fromkeys(item))}
            if not item:
                continue
            score, _, _ = decontaminate.align(np.array([codes[w] for w in item]), np.array([codes.get(w, -1) for w in words], dtype=np.int64))
            if score / (2 * len(item)) >= decontaminate.MIN_SCORE or score >= 2 * decontaminate.EXCERPT:
                out[doc_id, item_id] = score / (2 * len(item))
    return out


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id): r.score for r in queries.op7_decontamination(spark, SF).collect()}
    assert found == brute(docs, items)


def test_word_codes():
    """Equal codes for equal words and for no others, and as many as there are words, text by text."""
    rng = np.random.default_rng(12)
    signs = np.frombuffer(b"abAB..!* \t\n\x0b\xc3\xa9-'", np.uint8)
    texts = [b"", None, b" ", b"?!", b"a", b"--a", b"x" * 8, b"x" * 9, b"x" * 64, b"x" * 65, b"x" * 65 + b"y", b"\x1c\x00a \x00a", b"don't (stop)"]
    texts += [rng.choice(signs, rng.integers(1, 300)).tobytes() for _ in range(400)]
    texts += [bytes(rng.choice(signs[:2], k)) for k in range(1, 140)]
    found = decontaminate._Found(pa.array(texts, pa.binary()), np.full((1 << 22) + 4096, 255, np.uint8), [1])
    told = {}
    for k, text in enumerate(texts):
        words = [w for w in (x.strip(decontaminate._STRIP) for x in (text or b"").lower().split()) if w]
        keys = found.key[found.text == k].tolist()
        assert found.place[found.text == k].tolist() == list(range(len(words)))
        assert found.words(k, 0, 10**6) == b" ".join(words).decode("utf-8", "replace") and len(keys) == len(words)
        assert all(told.setdefault(w, key) == key for w, key in zip(words, keys, strict=True))
    assert len(set(told.values())) == len(told) > 1000


def test_no_run_of_words_passes_the_end_of_its_text():
    words = [b"one two three", b"four", None, b"", b"five six. seven eight"]
    found = decontaminate._Found(pa.array(words, pa.binary()), np.full((1 << 22) + 4096, 255, np.uint8), [2, 3])
    assert list(zip(found.text.tolist(), found.place.tolist(), strict=True)) == [(0, 0), (0, 0), (0, 1), (4, 0), (4, 0), (4, 1), (4, 1), (4, 2)]
    assert found.words(4, 1, 3) == "six seven" and found.words(0, 2, 9) == "three"


def test_reading_takes_little_more_than_splitting_at_blanks(spark):
    """CPU time of a text's words and n-grams against that of `split` (before: about 13 times it)."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] * 2
    column, bits = pa.array(texts), np.zeros((1 << 22) + 4096, np.uint8)

    def seconds(work):
        took = []
        for _ in range(3):
            start = time.process_time()
            work()
            took.append(time.process_time() - start)
        return min(took)

    plain = seconds(lambda: [t.encode().lower().split() for t in texts])
    assert seconds(lambda: decontaminate._Found(column, bits, [decontaminate.SEED])) < 6 * plain


def test_edited_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(3000)]
    items = [(k, " ".join(rng.choices(vocabulary, k=40))) for k in range(20)]
    docs, planted = [], set()
    for k in range(200):
        words = rng.choices(vocabulary, k=rng.randrange(50, 400))
        if k % 4 == 0:
            item = rng.randrange(20)
            copy = items[item][1].split()
            for at in rng.sample(range(40), 6):
                copy[at] = rng.choice(vocabulary)
            del copy[rng.randrange(len(copy))]
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in copy]
            planted.add((k, item))
        docs.append((k, " ".join(words)))
    rows = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == planted
    assert all(0.4 <= r.score < 1 for r in rows)


def test_copies_in_a_third_of_the_words_and_in_two_documents(spark):
    rng = random.Random(8)
    common = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(common, k=30))) for k in range(2)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    many = [(k, " ".join(rng.choices(common, k=60)) + (" " + items[0][1] if k % 3 else "")) for k in range(300)]
    rows = decontaminate.find(spark.createDataFrame(many, "doc_id long, text string"), bench).collect()
    assert {r.doc_id for r in rows if r.item_id == 0 and r.score == 1} == {k for k in range(300) if k % 3}
    two = [(1, items[1][1]), (2, "nothing of the kind")]
    rows = decontaminate.find(spark.createDataFrame(two, "doc_id long, text string"), bench).collect()
    assert [(r.doc_id, r.item_id, r.score) for r in rows if r.score == 1] == [(1, 1, 1.0)]


def test_recall_on_items_of_common_words(spark):
    """Copies with a fifth of the words replaced, of items made of fifty words that every text has."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(50)]
    items = [(k, " ".join(rng.choices(common, k=30))) for k in range(10)]
    docs, planted = [], set()
    for k in range(400):
        words = rng.choices(common, k=120)
        if k % 8 == 0:
            copy = items[k % 10][1].split()
            for at in rng.sample(range(30), 6):
                copy[at] = rng.choice(common)
            words[60:60] = copy
            planted.add((k, k % 10))
        docs.append((k, " ".join(words)))
    rows = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    want = brute(docs, [(k, decontaminate.words_of(t)) for k, t in items])
    assert planted <= set(want) and len(found & planted) >= 0.95 * len(planted) and len(found) >= 0.9 * len(want) and found <= set(want)


def test_an_excerpt_of_a_long_item(spark):
    rng = random.Random(10)
    words = [f"x{i}" for i in range(4000)]
    long = " ".join(rng.choices(words, k=500))
    docs = [(1, " ".join([*rng.choices(words, k=50), *long.split()[100:150], *rng.choices(words, k=50)])), (2, " ".join(rng.choices(words, k=300)))]
    rows = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, long)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.first_word, r.last_word) for r in rows] == [(1, 7, 50, 99)]


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "And a second line.", "q"), (2, None, "q"), (3, "", "q"), (4, "Plain text here, with words.", "q"), (4, "words.\nAnd a", "q"), (5, "***!!!", "q")], "item_id long, text string, score string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find(odd_docs, bench).collect()}
    assert found == {(d, i) for d in (1, 5) for i in (1, 4)}
    assert decontaminate.find(no_docs, bench).collect() == []
    assert decontaminate.find(odd_docs, bench.limit(0)).collect() == []
    assert decontaminate.keep_clean(odd_docs, bench).count() == odd_docs.count() - 3
