import random
from itertools import combinations

from matricula.llm import linededup, queries
from tests.conftest import SF


def prepared(text):
    lines = [x.strip() for x in text.encode().split(b"\n")]
    return lines, [x.count(b" ") + 1 if x else 0 for x in lines]


def brute(docs, block_words=linededup.BLOCK_WORDS):
    """Without alignment: every line that some earlier document has is marked, and marked lines go
    where they come to a block. No seeds, no pairs, no order: all earlier documents count."""
    lines = {d: prepared(t) for d, t in docs}
    earlier, out = set(), {}
    for d in sorted(lines):
        own, words = lines[d]
        gone, run = [], []
        for i, x in enumerate([*own, None]):
            if x is not None and not words[i]:
                continue
            if x in earlier:
                run.append(i)
                continue
            if sum(words[k] for k in run) >= block_words:
                gone += [k for k in range(run[0], run[-1] + 1)]
            run = []
        if gone:
            out[d] = [i for i in gone if words[i]]
        earlier |= set(own)
    return out


def test_patience_is_an_increasing_match():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        found = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
        unique = [v for v in a if a.count(v) == 1 and b.count(v) == 1]
        longest = next(k for k in range(len(unique), -1, -1) if any([v for v in b if v in c] == list(c) for c in combinations(unique, k)))
        assert sum(a[i] in unique for i, _ in found) >= longest


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    words = {d: prepared(t)[1] for d, t in docs}
    found = {r.doc_id: [i for i in map(int, r.gone.split(",")) if words[r.doc_id][i]] for r in queries.op10_line_dedup(spark, SF).collect()}
    assert found == brute(docs) and found


def test_passage_goes_from_later_documents_only(spark):
    passage = "\n".join(" ".join(f"p{i}x{k}" for k in range(20)) for i in range(3))
    other = [" ".join(f"d{d}w{k}" for k in range(15)) for d in range(6)]
    docs = [(d, f"{other[d]}\n  {passage}\nend of {d}\n", "en", len(passage)) for d in range(5)] + [(5, f"{other[5]}\nend", "en", 3)]
    out = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long")).collect()}
    assert passage in out[0].text
    for d in range(1, 5):
        assert out[d].text == f"{other[d]}\nend of {d}\n" and out[d].n_chars == len(out[d].text)
    assert out[5].text == docs[5][1] and out[5].n_chars == 3


def test_passages_that_no_unique_line_or_single_holder_shows(spark):
    line = lambda name, n=15: " ".join(f"{name}w{k}" for k in range(n))
    text = lambda *lines: "\n".join(lines)
    passage = [line(f"p{i}") for i in range(4)]
    swapped = [line(f"s{i}") for i in range(4)]
    short = [line(f"k{i}", 5) for i in range(10)]
    split = [line(f"m{i}") for i in range(4)]
    docs = [
        (1, text(*passage, line("one"), *passage)),  # the first holder has it twice
        (2, text(line("two"), *passage)),
        (3, text(*passage, line("three"), *passage)),  # so has a later one
        (10, text(*swapped[::-1])),  # the first holder has its lines in another order
        (11, text(line("eleven"), *swapped)),
        (12, text(line("twelve"), *swapped)),
        (20, text(*short)),  # no line is long enough for a seed
        (21, text(line("x"), *short)),
        (30, text(*split)),  # the first holder's id has another text
        (30, "else"),
        (31, text(*split)),
        (32, text(line("y"), *split)),
    ]
    gone = {r.doc_id: r.gone for r in linededup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert gone == {2: "1,2,3,4", 3: "0,1,2,3,5,6,7,8", 12: "1,2,3,4", 21: "1,2,3,4,5,6,7,8,9,10", 32: "1,2,3,4"}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = linededup.dedup(odd_docs)
    assert rows.columns == odd_docs.columns and rows.count() == odd_docs.count()
    assert linededup.dedup(no_docs).collect() == [] and linededup.report(no_docs).collect() == []
    long = " ".join(f"w{k}" for k in range(60))
    both = spark.createDataFrame([(1, long), (2, long), (2, "else"), (3, long), (None, long)], "doc_id long, text string")
    assert {r.doc_id for r in linededup.report(both).collect()} == {3}
    assert sorted((r.doc_id or 0, r.text) for r in linededup.dedup(both).collect()) == sorted([(1, long), (2, long), (2, "else"), (0, long)])


def test_longest_common_subsequences(monkeypatch):
    import random

    rng = random.Random(7)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for bits in (1 << 26, 50):
        monkeypatch.setattr(linededup, "TABLE_BITS", bits)
        for _ in range(60):
            a, b = ([rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(40))] for _ in range(2))
            found = linededup.longest_common(a, b)
            assert all(a[i] == b[j] for i, j in found) and len(found) == length(a, b)
            assert all(p < q and r < s for (p, r), (q, s) in zip(found, found[1:], strict=False))


def test_few_lines_many_times():
    import time

    start = time.time()
    early = [(1, 2, 3)[i % 3] for i in range(20_000)]
    late = [(1, 3, 2, 2)[i % 4] for i in range(20_000)]
    found = linededup.patience(early, late)
    assert len(found) > 10_000 and time.time() - start < 5
    assert len(linededup.patience(early, early[1:])) == 19_999
