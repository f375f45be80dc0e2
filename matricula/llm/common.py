"""Helpers shared by the corpus operators: table access, the shared folder, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialize, new_path, scratch, shared_dir

__all__ = ["WORD", "WORD_BREAK", "arrow_rows", "bitmap", "crc_rest", "fresh", "in_bitmap", "materialize", "new_path", "per_batch", "release", "scratch", "shared_dir", "slices", "table"]

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one step of a batch function works on at a time, and bytes of an Arrow batch, which
#: both the executor and its Python worker hold.
SLICE_BYTES, ARROW_BYTES = 4 << 20, 8 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text_column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `limit` bytes of text each (one row at least)."""
    size = batch.column(text_column).nbytes
    if size <= limit or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), text_column, limit)
    yield from slices(batch.slice(half), text_column, limit)


def release() -> None:
    """Give memory that a batch has used back to the system, as executors are sized tightly."""
    gc.collect(1)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def arrow_rows(spark: SparkSession, most: int) -> None:
    """From here on the session's Arrow batches have `most` rows at most. mapInArrow heeds the limit in
    rows alone, and by its default takes 10,000: of texts, all that a task reads."""
    if not 0 < int(spark.conf.get(_ARROW_ROWS)) <= most:
        spark.conf.set(_ARROW_ROWS, most)


def per_batch(df: DataFrame, text_column: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow over bounded slices; `make` builds the batch function once in each task. From here
    on the session's Arrow batches have ARROW_BYTES at most, as executors are sized tightly."""
    now = (df.sparkSession.conf.get(_ARROW_LIMIT, None) or "").rstrip("b")
    if now.isdigit() and int(now) > ARROW_BYTES:
        df.sparkSession.conf.set(_ARROW_LIMIT, ARROW_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text_column):
                if part.num_rows and (out := work(part)) is not None and out.num_rows:
                    yield out
            release()
        work = None  # what the task has held goes before the worker's next one
        release()

    return df.mapInArrow(run, schema)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores after it as tell it from all columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def crc_rest(column: str, modulus: int):
    """crc32 of an id written as text, modulo `modulus`: the fixed split of labelled rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Which of `bits` residues (a power of two) occur among the numbers of a column, as packed
    bits; rows are put into maps by the executors."""
    bit = F.pmod(column, F.lit(bits))
    maps = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((bits >> 3) + 4096, dtype=np.uint8)
    low = np.zeros(1, dtype=np.uint8)
    for row in maps.collect():  # `bits` at most
        if row["bucket"] == 0:
            low[0] |= row["bits"][0] & 1  # bucket 0 holds the number 0 alone
            continue
        start = ((row["bucket"] - 1) * 32768 + 1) >> 3  # bucket b starts at (b - 1) * 32768 + 1
        found = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8), bitorder="little")
        moved = np.packbits(np.concatenate([np.zeros(1, np.uint8), found]), bitorder="little")
        out[start : start + len(moved)] |= moved
    out[0] |= low[0]
    return out


def in_bitmap(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the residue of each number (signed) is in a bitmap."""
    at = keys & ((len(packed) - 4096) * 8 - 1)
    return ((packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
