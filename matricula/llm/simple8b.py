"""Token ids in Simple-8b words: a compact binary form with whole-array decoding.

A 64-bit word holds a 4-bit selector and 60 bits of equally wide values. Selector 0 is the
escape: the next word is one raw 64-bit value. Values are cut into blocks of 256; each block
starts at a word of its own, whose place is kept beside the words, so that blocks decode
independently and all words of one selector decode in one array operation.

The file format is Parquet: a row is a chunk of whole documents, in ascending doc_id order, with
the words, the block places and the length of each document. Null text counts as empty; equal
doc_ids stay apart, ordered by text; a null doc_id comes first. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import release, slices
from .tokens import default_path, tokenizer

BLOCK = 256
#: Values in a word and bits of each, by selector; 0 is the escape.
_COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
_WIDTH = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_POWERS = np.array([1 << k for k in range(64)], dtype=np.uint64)
_BITS = np.searchsorted(_POWERS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)

CHUNK = "part int, chunk int, first long, doc_ids array<long>, lengths array<long>, n long, words binary, blocks binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    if len(values) and int(values.max()) < len(_BITS):
        return _BITS[values.astype(np.uint16)]
    return np.searchsorted(_POWERS, values, side="right").astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a 1-d array of unsigned integers, and the place of each block's first word."""
    n_blocks = -(-len(values) // BLOCK)
    if not n_blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    most = np.zeros((n_blocks, BLOCK + 128), dtype=np.uint8)  # values after a block's end are zeros
    flat = np.zeros(n_blocks * BLOCK, dtype=np.uint8)
    flat[: len(values)] = _bits(values)
    most[:, :BLOCK] = flat.reshape(n_blocks, BLOCK)
    size = np.full(n_blocks, BLOCK)
    size[-1] = len(values) - (n_blocks - 1) * BLOCK

    # the selector with the most values wins, so those of few values are written first
    selector = np.where(most > 60, 0, 15).astype(np.uint8)
    reach = {1: most}
    for s, count, half in ((14, 2, 1), (13, 3, 2), (12, 4, 2), (11, 5, 4), (10, 6, 3), (9, 7, 4), (8, 8, 4), (7, 10, 5), (6, 12, 6), (5, 15, 8), (4, 20, 10), (3, 30, 15), (2, 60, 30), (1, 120, 60)):
        wide, ahead = reach[half].copy(), count - half
        np.maximum(wide[:, :-ahead], reach[half][:, ahead:], out=wide[:, :-ahead])
        reach[count] = wide
        np.copyto(selector, s, where=wide <= _WIDTH[s])

    at, live, chosen = np.zeros(n_blocks, dtype=np.int64), np.arange(n_blocks), []
    jump, selector, stride = _COUNT.astype(np.int64), selector.reshape(-1), BLOCK + 128
    while len(live):
        here = at[live]
        s = selector[live * stride + here]
        chosen.append((live * BLOCK + here, s))
        at[live] = here = here + jump[s]
        live = live[here < size[live]]
    place, s = (np.concatenate(x) for x in zip(*chosen, strict=True))
    order = np.argsort(place)
    place, s = place[order], s[order]
    takes = 1 + (s == 0)
    to = np.cumsum(takes) - takes
    words = np.zeros(int(takes.sum()), dtype=np.uint64)
    ends = np.minimum(place // BLOCK * BLOCK + BLOCK, len(values))
    for k in np.flatnonzero(np.bincount(s, minlength=16)).tolist():
        mine = np.flatnonzero(s == k)
        first, end = place[mine], ends[mine]
        if k == 0:
            words[to[mine] + 1] = values[first]
            continue
        total = np.full(len(mine), k << 60, dtype=np.uint64)
        if _WIDTH[k]:
            for i in range(int(_COUNT[k])):
                value = values[np.minimum(first + i, len(values) - 1)].astype(np.uint64) << np.uint64(i * _WIDTH[k])
                total |= np.where(first + i < end, value, np.uint64(0))
        words[to[mine]] = total
    starts = np.flatnonzero(np.diff(place // BLOCK, prepend=-1))
    return words, to[starts]


def decode(words: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """The values that `encode` was given."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), dtype=bool)
    raw = -1
    for k in np.flatnonzero(selector == 0).tolist():  # escapes are rare
        if k != raw:
            head[k + 1] = False
            raw = k + 1
    block = np.searchsorted(blocks, np.arange(len(words)), side="right") - 1
    count = np.where(head, _COUNT[selector], 0)
    before = np.cumsum(count) - count
    start = before - before[blocks][block]
    out = np.zeros((len(blocks), BLOCK + 128), dtype=np.uint64)
    for k in np.unique(selector[head]).tolist():
        mine = np.flatnonzero(head & (selector == k))
        if k == 0:
            out[block[mine], start[mine]] = words[mine + 1]
        elif _WIDTH[k]:
            mask = np.uint64((1 << int(_WIDTH[k])) - 1)
            for i in range(int(_COUNT[k])):
                out[block[mine], start[mine] + i] = (words[mine] >> np.uint64(i * _WIDTH[k])) & mask
    return out[:, :BLOCK].reshape(-1)[:n]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, chunk_ids: int = 1 << 19) -> None:
    """Tokenize every text, append the end id 0, and write chunks in ascending doc_id order."""
    tokens = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = tokenizer(tokens).encode
        part, chunk, first = TaskContext.get().partitionId(), 0, 0
        held, doc_ids, lengths = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal chunk, first
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            words, blocks = encode(ids)
            row = [part, chunk, first, doc_ids[:], lengths[:], len(ids), words.astype("<u8").tobytes(), blocks.astype("<u4").tobytes()]
            chunk, first = chunk + 1, first + len(ids)
            for x in (held, doc_ids, lengths):
                x.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["part", "chunk", "first", "doc_ids", "lengths", "n", "words", "blocks"])

        open_ids = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode_texts(batch.column("text")), strict=True):
                    held.append(ids + b"\0\0\0\0")
                    doc_ids.append(doc_id)
                    lengths.append(len(ids) // 4 + 1)
                    open_ids += lengths[-1]
                    if open_ids >= chunk_ids:
                        yield close()
                        open_ids = 0
            release()
        if held:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, CHUNK).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 per document."""
    chunks = spark.read.parquet(path)
    parts = chunks.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row of 12 bytes for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["blocks"], "<u4").astype(np.int64), row["n"]).astype("<u4")
                ends = np.cumsum(np.array(row["lengths"], dtype=np.int64))
                starts = ends - row["lengths"]
                data = memoryview(ids).cast("B")
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"] + row["before"]), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return chunks.join(F.broadcast(before), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
