import random
import zlib
from array import array
from collections import defaultdict

from tokenizers import Tokenizer

from matricula.llm import packing, queries
from matricula.llm.tokens import default_path
from tests.conftest import SF


def encoded(texts):
    t = Tokenizer.from_file(default_path())
    return [array("I", t.encode(x or "", add_special_tokens=False).ids).tobytes() for x in texts]


def verify(rows, docs):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    want = defaultdict(list)
    for (doc_id, _), ids in zip(docs, encoded([t for _, t in docs]), strict=True):
        ids += b"\0\0\0\0"
        n = len(ids) // 4
        rest = n % 2048
        cuts = [0, *range(rest or 2048, n + 1, 2048)]
        want[doc_id] += [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert {k: sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    full = defaultdict(list)
    for r in rows:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(full)


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.op1_best_fit_packing(spark, SF).collect()
    used = verify(rows, docs)
    assert used <= 1 + -(-sum(r["length"] for r in rows) // 2048)


def test_odd_rows(spark, odd_docs, no_docs):
    verify(packing.pack(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert packing.pack(no_docs).collect() == []


def test_the_plan_stays_small():
    for n in (10, 16_000):
        runs, _ = packing.plan({1200: n, 800: n, 300: 2 * n}, 2048)
        assert sum(map(len, runs.values())) < 20


def test_plan_places_every_piece_once():
    rng = random.Random(1)
    for capacity in (10, 50, 2048):
        for _ in range(60):
            counts = defaultdict(int)
            for _ in range(rng.randrange(1, 200)):
                counts[rng.randrange(1, capacity)] += rng.choice([1, 1, 1, 40])
            runs, n = packing.plan(dict(counts), capacity)
            bins = defaultdict(list)
            for size, found in runs.items():
                found = sorted(found)
                for i, (first, per, base, offset) in enumerate(found):
                    last = found[i + 1][0] if i + 1 < len(found) else counts[size]
                    for rank in range(first, last):
                        bins[base + (rank - first) // per].append((offset + (rank - first) % per * size, size))
            assert len(bins) == n and sum(map(len, bins.values())) == sum(counts.values())
            for places in bins.values():
                at = 0
                for offset, size in sorted(places):
                    assert offset == at
                    at += size
                assert at <= capacity


def best(items, capacity):
    """Fewest bins by trying everything."""
    items = sorted(items, reverse=True)
    found = [len(items)]

    def go(i, rooms):
        if len(rooms) >= found[0]:
            return
        if i == len(items):
            found[0] = len(rooms)
            return
        for r in {x for x in rooms if x >= items[i]}:
            k = rooms.index(r)
            go(i + 1, [*rooms[:k], r - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return found[0]


def test_reduction_never_costs_a_bin():
    rng = random.Random(2)
    for _ in range(300):
        items = [rng.randrange(1, 20) for _ in range(rng.randrange(1, 9))]
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        fixed = packing.reduce_dominated(counts, 20)
        rest = [s for s, c in counts.items() for _ in range(c)]
        assert sum(t for _, t in fixed) + best(rest, 20) == best(items, 20)
