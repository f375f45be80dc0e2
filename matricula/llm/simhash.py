"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A 64-bit fingerprint sums the XXH64 bits of all 4-word shingles. Two fingerprints link at a
distance of at most 4. If each emits every variant within half that radius, any linked pair
meets in some variant, and all that meet in a variant are linked: a star to the smallest of them
says everything, with no pairs. One fingerprint has 2,081 such variants, too many to shuffle for
a whole corpus, so the same idea first runs on halves of the bits: a linked pair differs in at
most 2 bits of one half, so that it meets in a half variant within 1 bit (33 per half). Where few
fingerprints meet in a half variant their pairs are verified there; the members of larger
meetings emit the full ball of 2,081 variants and are joined by stars. Both ways are exact.

Only distinct fingerprints are compared, so exact copies cost nothing. Components come from
alternating large-star and small-star steps on the links, checkpointed each time.

Defined results: null or blank text has fingerprint zero, linked like any other; fewer than four
words are one shingle; repeated rows stay; rows with a null doc_id keep their fingerprint and
the component of it. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, per_batch

SHINGLE = 4
RADIUS = 4
#: Largest meeting in a half variant whose pairs are compared one by one; beyond it the full
#: ball (2,081 variants for each) is cheaper.
PAIRWISE = 48
#: Rows of variants that a task sorts, about.
PART_ROWS = 8_000_000

_HALF_FLIPS = np.array([0] + [1 << k for k in range(32)], dtype=np.uint64)
_BALL = np.array([0] + [1 << k for k in range(64)] + [(1 << a) | (1 << b) for a, b in combinations(range(64), 2)], dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        hashes = [xxh64_intdigest(b"%b %b %b %b" % x, 42) for x in zip(words, words[1:], words[2:], words[3:], strict=False)]
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp: the fingerprint's 64 bits as a long."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.fromiter((fingerprint(x) for x in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            return pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

        return work

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", make, "doc_id long, fp long")


def _arrays(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[np.ndarray]]:
    for b in batches:
        yield [b.column(n).to_numpy() for n in names]


def _half_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint the 33 variants of either half; half 0 and 1 stay apart."""
    for (fp,) in _arrays(batches, "fp"):
        own = fp.view(np.uint64)
        for at in range(0, len(own), 4096):
            part = own[at : at + 4096]
            low = (part & np.uint64(0xFFFFFFFF))[:, None] ^ _HALF_FLIPS
            high = (part >> np.uint64(32))[:, None] ^ _HALF_FLIPS
            meet = np.concatenate([low, high | np.uint64(1 << 32)], axis=1)
            yield pa.record_batch([pa.array(meet.reshape(-1).view(np.int64)), pa.array(np.repeat(part, 66).view(np.int64))], ["meet", "fp"])


def _full_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (fp,) in _arrays(batches, "fp"):
        own = fp.view(np.uint64)
        for at in range(0, len(own), 64):
            part = own[at : at + 64]
            yield pa.record_batch([pa.array((part[:, None] ^ _BALL).reshape(-1).view(np.int64)), pa.array(np.repeat(part, len(_BALL)).view(np.int64))], ["meet", "fp"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """Rows ordered by `meet`, again in order, cut only where `meet` changes; a meeting of over a
    million is cut too, and its number is given with each part of it."""
    meet, fp, crowd = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for m, f in _arrays(batches, "meet", "fp"):
        meet, fp = np.concatenate([meet, m]), np.concatenate([fp, f])
        cut = int(np.searchsorted(meet, meet[-1])) if len(meet) else 0
        if not cut and len(meet) > 1 << 20:
            cut, crowd = len(meet), int(meet[-1])
        if cut:
            yield meet[:cut], fp[:cut], crowd
            meet, fp = meet[cut:], fp[cut:]
    if len(meet):
        yield meet, fp, crowd


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified pairs of small meetings; members of large ones go on, paired with null."""
    for meet, fp, crowd in _runs(batches):
        starts = np.flatnonzero(np.r_[True, meet[1:] != meet[:-1]])
        sizes = np.diff(np.r_[starts, len(meet)])
        large = (sizes > PAIRWISE) | (False if crowd is None else meet[starts] == crowd)
        a, b = [], []
        for size in np.unique(sizes[(sizes > 1) & ~large]).tolist():
            rows = starts[(sizes == size) & ~large]
            x, y = np.triu_indices(size, 1)
            left, right = (fp[(rows[:, None] + k).reshape(-1)] for k in (x, y))
            near = np.bitwise_count((left ^ right).view(np.uint64)) <= RADIUS
            a.append(left[near])
            b.append(right[near])
        big = [fp[s : s + n] for s, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True)]
        if a and sum(map(len, a)):
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
        for x in big:
            x = np.unique(x)
            yield pa.record_batch([pa.array(x), pa.nulls(len(x), pa.int64())], ["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a meeting with its first; rows are ordered by meeting and fingerprint."""
    last: tuple[int, int] | None = None
    for meet, fp in _arrays(batches, "meet", "fp"):
        if not len(meet):
            continue
        starts = np.r_[last is None or meet[0] != last[0], meet[1:] != meet[:-1]]
        at = np.flatnonzero(starts)
        first = np.empty_like(fp)
        owner = np.cumsum(starts) - 1
        known = owner >= 0
        first[known] = fp[at][owner[known]] if len(at) else 0
        if last is not None:
            first[~known] = last[1]
        last = (int(meet[-1]), int(first[-1]))
        keep = first != fp
        if keep.any():
            yield pa.record_batch([pa.array(fp[keep]), pa.array(first[keep])], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links between distinct fingerprints (column fp), enough to join all within the radius."""
    spark = fps.sparkSession
    halves = fps.mapInArrow(_half_variants, "meet long, fp long")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, fps.count() * 66 // PART_ROWS + 1)
    met = halves.repartition(parts, "meet").sortWithinPartitions("meet").mapInArrow(_verified, "a long, b long").distinct()
    met = materialize(met)
    crowd = met.filter("b is null").select(F.col("a").alias("fp")).distinct()
    parts = max(least, crowd.count() * len(_BALL) // PART_ROWS + 1)
    balls = crowd.repartition(parts, "fp").mapInArrow(_full_variants, "meet long, fp long")
    stars = balls.repartition(parts, "meet").sortWithinPartitions("meet", "fp").mapInArrow(_stars, "a long, b long").distinct()
    return met.filter("b is not null").unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node that it is joined to) for every node of `edges` (a, b).

    Large-star and small-star steps alternate until nothing changes.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable."""
    prints = materialize(fingerprints(docs))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp")))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    found = materialize(joined.join(least, "root").select("fp", "component_id"))
    return prints.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that open their component: one of each group, whole, same columns.

    Of rows that repeat a doc_id with the same text one stays. Rows without a doc_id stay.
    """
    found = materialize(near_duplicates(docs))
    # written, so that its size is known before the join: where it is small no text is shuffled
    gone = materialize(found.filter("component_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct())
    twice = materialize(found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("__id")).count().filter("count > 1").select("__id"))
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["__id"], "left_anti")
    if twice.isEmpty():
        return kept
    same = kept["doc_id"].cast("long") == twice["__id"]
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
