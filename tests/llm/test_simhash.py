import random

import numpy as np
import pyarrow as pa
from xxhash import xxh64_intdigest

from matricula.llm import queries, simhash
from tests.conftest import SF


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Component of each place, by comparing every pair."""
    fp = np.array(prints, dtype=np.uint64)
    root = list(range(len(fp)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 4).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fp))]


def check(docs, rows):
    docs = sorted(docs, key=lambda x: x[0])
    prints = [brute_print(t) for _, t in docs]
    roots = brute_components(prints)
    want = sorted((d, f"{p:016x}", docs[r][0]) for (d, _), p, r in zip(docs, prints, roots, strict=True))
    assert sorted(map(tuple, rows)) == want


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(docs, queries.op9_simhash(spark, SF).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    check([(r.doc_id, r.text) for r in odd_docs.collect()], simhash.near_duplicates(odd_docs).collect())
    assert simhash.near_duplicates(no_docs).collect() == []
    assert sorted(r.doc_id for r in simhash.keep_first(odd_docs).collect()) == [1, 2, 4, 6, 7, 8]
    alone = odd_docs.filter("doc_id in (5, 6)")  # repeated rows of the one that stays
    assert sorted(r.doc_id for r in simhash.keep_first(alone).collect()) == [5, 6]


def test_crowded_meetings(spark):
    """A crowd within few bits of one centre goes through the full ball; a chain is one component."""
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for size in (150, 90):
        centre = rng.getrandbits(64)
        prints |= {centre ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for _ in range(size)}
    chain = rng.getrandbits(64)
    for _ in range(40):
        chain ^= sum(1 << k for k in rng.sample(range(64), 4))
        prints.add(chain)
    prints = sorted(prints)
    signed = [int(np.uint64(x).view(np.int64)) for x in prints]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    groups = {}
    for x, r in zip(signed, brute_components(prints), strict=True):
        groups.setdefault(r, set()).add(x)
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_long_run_is_cut_and_marked():
    batches = [pa.record_batch([pa.array([7] * 600_000), pa.array(range(k, k + 600_000))], ["meet", "fp"]) for k in (0, 600_000, 1_200_000)]
    parts = list(simhash._runs(iter(batches)))
    assert sum(len(m) for m, _, _ in parts) == 1_800_000 and parts[-1][2] == 7
