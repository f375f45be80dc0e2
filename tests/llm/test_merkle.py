"""The manifest against trees that are built from sorted lists."""

import hashlib
import random
import zlib

import pytest

from matricula.llm import merkle as M

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(h):
    out = [h]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, r):
    for h in tree[:-1]:
        a = r - r % 8
        yield "".join(h[a:r]), "".join(h[r + 1 : a + 8])
        r //= 8


def brute(rows):
    trees = {}
    for d, text, lang, source, n, *_ in rows:
        leaf = told = H(field(d), field(source), field(lang), field(n), field(text))
        if d is not None and text is not None and zlib.crc32(str(d).encode()) % 3 == 0:
            told = H(field(d), field(source), field(lang), field(n), field(text.translate(LOW)))
        trees.setdefault(lang, []).append((d is not None, d or 0, leaf, told, d))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    each = [levels([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in names]
    top = levels([x[-1][0] for x in each])
    out = []
    for i, k in enumerate(names):
        for r, (_, _, leaf, h, d) in enumerate(sorted(trees[k], key=lambda x: x[:3])):
            steps = [*way(each[i], r), *way(top, i)]
            for a, b in steps:
                h = H(a, h, b)
            out.append((d, leaf, each[i][-1][0], top[-1][0], H(*[a + b for a, b in steps]), h, h == top[-1][0]))
    return sorted(map(str, out))


def built(spark, rows):
    found = M.manifest(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == COLUMNS
    return sorted(str(tuple(r)) for r in found.collect())


def test_several_runs_and_sparse_ids(spark):
    rng = random.Random(1)
    rows = [(i, f"Text {i} ÄB\n", "en", "s", i, "x") for i in range(1100)]
    rows += [(rng.randrange(-(1 << 62), 1 << 62), f"Wide {i}", rng.choice(["de", "fr"]), None, i, "x") for i in range(150)]
    rng.shuffle(rows)
    assert built(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(i, f"Text {i}", random.Random(i).choice(["en", None, "ä", ""]), "s", i, None) for i in range(90)]
    rows += [(None, f"Null {i % 12}", "en", None, None, "y") for i in range(25)] + [(5, f"Again {i % 3}", "en", "s", 3, "y") for i in range(9)]
    rows += [(5, None, "alone", None, None, None), (70, "", "en", "", 0, ""), (71, "LONG word. " * 50_000, "en", "s", 1, "z")]
    assert built(spark, rows) == brute(rows)


def test_more_languages_than_a_node_has_children(spark):
    rows = [(i % 50, f"T {i}", f"l{i % 70}", "s", 1, "x") for i in range(300)]
    assert built(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(3, "A", None, "s", 1, "x")], [(3, "A", "en", "s", 1, "x"), (4, "B", "en", "s", 1, "x")]])
def test_small(spark, rows):
    assert built(spark, rows) == brute(rows)
