"""Best-fit packing of documents into token sequences of a fixed length.

Documents are tokenized once, where they lie; only the histogram of piece lengths (at most
`capacity` counts, whatever the corpus) is planned on the driver. The plan first fixes the sets
that the Martello-Toth dominance criterion proves optimal, then places the rest best fit,
longest first. Each piece finds its place from its length and its rank among equal lengths, so
no shuffle sees a key that a common length could overload.

Null or empty text is one end id. Repeated rows are packed one by one; a null doc_id is kept.
Other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, per_batch
from .tokens import default_path, tokenizer

CAPACITY = 2048
END = (0).to_bytes(4, "little")
#: Sequence ids of cut documents start here, per task; planned ones stay below.
_OWN = 1 << 40

_PIECES = "doc_id long, task int, n_tokens long, rest int, rank long, own long, crcs array<long>"


def tokenize_pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: its length, the length of its first piece if that is shorter, that
    piece's rank among those of its length in this task, and the crc32 of each piece.

    Ranks hold only within one run, so the result must be written before it is read twice.
    """
    path = tokenizer_path or default_path()

    def make():
        encode = tokenizer(path).encode
        task = TaskContext.get().partitionId()
        ranks: dict[int, int] = defaultdict(int)
        own = 0

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal own
            lengths, rests, rank, first_own, crcs = [], [], [], [], []
            for ids in encode(batch.column("text")):
                ids += END
                n = len(ids) // 4
                rest = n % capacity
                cuts = [0, *range(rest or capacity, n + 1, capacity)]
                lengths.append(n)
                rests.append(rest)
                rank.append(ranks[rest])
                first_own.append((task + 1) * _OWN + own)
                ranks[rest] += 1
                own += n // capacity
                crcs.append([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            return pa.record_batch(
                [batch.column("doc_id"), pa.array([task] * len(lengths), pa.int32()), pa.array(lengths, pa.int64()), pa.array(rests, pa.int32()), pa.array(rank, pa.int64()), pa.array(first_own, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                ["doc_id", "task", "n_tokens", "rest", "rank", "own", "crcs"],
            )

        return work

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", make, _PIECES)


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix sets that dominate every other set with the same item; `counts` keeps the rest.

    For an item j, a set with j dominates all others if (a) nothing else fits beside j: j alone;
    (b) one item k fills the place beside j exactly; (c) no two items fit beside j: j and the
    largest k that fits; (d) no three items fit beside j, and the largest k that fits is no
    smaller than any two that fit together: j and k.

    Fewer items make the smallest ones larger and the largest pairs smaller, so a pair that is
    fixed once by (c) or (d) is fixed as often as there are both: each step uses up a length.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(s for s, c in counts.items() if c > 0)

    def spend(found: tuple[int, ...], times: int) -> None:
        fixed.append((found, times))
        for x in found:
            counts[x] -= times
            if not counts[x]:
                del counts[x]
                sizes.pop(bisect.bisect_left(sizes, x))

    def smallest(n: int, without: int) -> list[int]:
        out: list[int] = []
        for s in sizes[: n + 1]:
            out += [s] * min(n, counts[s] - (s == without))
            if len(out) >= n:
                break
        return out[:n]

    for j in sorted(sizes, reverse=True):
        while counts.get(j, 0) > 0:
            room = capacity - j
            at = bisect.bisect_right(sizes, room) - 1
            if at >= 0 and sizes[at] == j and counts[j] == 1:
                at -= 1
            if at < 0:
                spend((j,), counts[j])
                break
            k = sizes[at]
            most = counts[j] // 2 if k == j else min(counts[j], counts[k])
            if k == room:
                spend((j, k), most)
                continue
            low = smallest(3, j)
            if len(low) < 2 or low[0] + low[1] > room or ((len(low) < 3 or sum(low) > room) and _largest_pair(sizes, counts, j, room) <= k):
                spend((j, k), most)
                continue
            break
    return fixed


def _largest_pair(sizes: list[int], counts: dict[int, int], without: int, room: int) -> int:
    """The largest sum within `room` of two items other than one `without`."""
    best, a, b = 0, 0, len(sizes) - 1
    have = lambda s: counts[s] - (s == without)
    while a <= b:
        x, y = sizes[a], sizes[b]
        if x + y > room or have(y) < 1 + (a == b):
            b -= 1
        elif have(x) < 1:
            a += 1
        else:
            best = max(best, x + y)
            a += 1
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Places for all pieces: per length, runs (first rank, per sequence, first sequence, offset).

    A piece of rank r in the run that starts at r0 goes to sequence s0 + (r - r0) // per, at
    offset + ((r - r0) % per) * length. Also returns the number of sequences.
    """
    counts = {s: c for s, c in counts.items() if c > 0}
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    n = 0

    def place(size: int, per: int, sequences: int, first: int, offset: int) -> None:
        runs[size].append((used[size], per, first, offset))
        used[size] += per * sequences

    for found, times in reduce_dominated(counts, capacity):
        offset = 0
        for size in sorted(set(found), reverse=True):
            place(size, found.count(size), times, n, offset)
            offset += size * found.count(size)
        n += times

    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []

    def add(room: int, first: int, sequences: int) -> None:
        if sequences and room:
            if not open_[room]:
                bisect.insort(rooms, room)
            open_[room].append((first, sequences))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        at = bisect.bisect_left(rooms, size)
        while left and at < len(rooms):
            room = rooms[at]
            first, sequences = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            per = room // size
            full, over = divmod(min(left, per * sequences), per)
            if full:
                place(size, per, full, first, capacity - room)
                add(room - per * size, first, full)
            if over:
                place(size, over, 1, first + full, capacity - room)
                add(room - over * size, first + full, 1)
            left -= full * per + over
            add(room, first + full + bool(over), sequences - full - bool(over))
            at = bisect.bisect_left(rooms, size)
        per = capacity // size
        full, over = divmod(left, per)
        if full:
            place(size, per, full, n, 0)
            add(capacity - per * size, n, full)
        if over:
            place(size, over, 1, n + full, 0)
            add(capacity - over * size, n + full, 1)
        n += full + bool(over)
    return dict(runs), n


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = materialize(tokenize_pieces(docs, tokenizer_path, capacity))
    by_task = rows.filter("rest > 0").groupBy("rest", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = by_task.groupBy("rest").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    runs, _ = plan({r["rest"]: r["n"] for r in histogram}, capacity)
    tables = {size: [np.array(x, dtype=np.int64) for x in zip(*sorted(found), strict=True)] for size, found in runs.items()}
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # runs in proportion to the lengths, `capacity` at most

    before = by_task.select("rest", "task", (F.sum("n").over(W.partitionBy("rest").orderBy("task")) - F.col("n")).alias("before"))
    placed = rows.join(before, ["rest", "task"], "left")

    def place(batches):
        for batch in batches:
            rest = batch.column("rest").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").fill_null(0).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
            for size in np.unique(rest[rest > 0]).tolist():
                first, per, base, start = shared.value[size]
                mine = np.flatnonzero(rest == size)
                run = np.searchsorted(first, rank[mine], side="right") - 1
                k = rank[mine] - first[run]
                sequence[mine] = base[run] + k // per[run]
                offset[mine] = start[run] + k % per[run] * size
            yield pa.record_batch([*(batch.column(x) for x in ("doc_id", "n_tokens", "rest", "own", "crcs")), pa.array(sequence), pa.array(offset)], ["doc_id", "n_tokens", "rest", "own", "crcs", "sequence", "offset"])

    found = placed.mapInArrow(place, "doc_id long, n_tokens long, rest int, own long, crcs array<long>, sequence long, offset long")
    short = (F.col("rest") > 0) & (F.col("piece") == 0)
    cut = F.when(F.col("rest") > 0, 1).otherwise(0)
    return found.select("*", F.posexplode("crcs").alias("piece", "ids_crc32")).select(
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        F.when(F.col("piece") == 0, F.lit(0).cast("long")).otherwise(F.col("rest") + (F.col("piece") - cut).cast("long") * capacity).alias("start"),
        F.when(short, F.col("rest")).otherwise(capacity).cast("long").alias("length"),
        "ids_crc32",
        F.when(short, F.col("sequence")).otherwise(F.col("own") + F.col("piece") - cut).alias("sequence_id"),
        F.when(short, F.col("offset")).otherwise(F.lit(0).cast("long")).alias("offset"),
    )
