"""Line dedup by pairwise alignment.

Documents become sequences of line hashes. A line of at least `seed_words` words that several
documents share is a seed, and so is a run of two lines or more that comes to as many words; each
document that has it is paired with the first that has it (the smallest doc_id), so that pairs
stay in proportion to the lines, whatever the size of a group; a line needs not be rare for that, and
common passages are not lost. Each pair is aligned by patience
diff: lines unique in both and in the same order anchor the alignment, gaps are aligned in the same
way, and those without a unique line by a longest common subsequence. Stretches that stay unaligned
are aligned once more, so that repeated and moved blocks are found. Aligned lines of the later
document go where they form a run of at least `block_words` words, counted over all its pairs.

Lines are compared without blanks at either end. Each line keeps its first place: only lines
that an earlier document has go, so no passage is lost altogether.

Defined results: null text stays null and has no lines. Documents without a doc_id take no part
and stay as they are. Rows that repeat a doc_id are one document if their texts are equal; a text
that differs under the same id takes no part. Extra columns are kept. Very long texts, and such with
few lines that come again and again, are aligned as all others; 20,000 lines of three values take
less than a second.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, per_batch, release

SEED_WORDS = 8
BLOCK_WORDS = 40
#: A line, or a first holder, is heavy with more than one in HEAVY of all rows; SALTS parts of it.
HEAVY, SALTS = 1000, 32
#: Bits of a table of common subsequences that are held at once.
TABLE_BITS = 1 << 26

_LINES = "doc_id long, hashes array<long>, words array<int>, runs array<long>"


def line_hashes(docs: DataFrame, seed_words: int = SEED_WORDS) -> DataFrame:
    """doc_id, the hash and number of words of each line of the text, and the hashes of its runs."""

    def make():
        from xxhash import xxh64_intdigest

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, words, runs = [], [], []
            for text in batch.column("text").to_pylist():
                lines = [x.strip() for x in text.encode("utf-8", "surrogatepass").split(b"\n")]
                hashes.append(np.array([xxh64_intdigest(x) for x in lines], dtype=np.uint64).view(np.int64))
                words.append(np.array([x.count(b" ") + 1 if x else 0 for x in lines], dtype=np.int32))
                runs.append([xxh64_intdigest(hashes[-1][i].tobytes()) for i in run_lines(words[-1].tolist(), seed_words)])
            return pa.record_batch([batch.column("doc_id"), pa.array(hashes, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array([np.array(x, dtype=np.uint64).view(np.int64) for x in runs], pa.list_(pa.int64()))], ["doc_id", "hashes", "words", "runs"])

        return work

    source = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return per_batch(source, "text", make, _LINES)


def _unique(x: list[int]) -> dict[int, int]:
    """The values that occur once, with their places, in order."""
    place = {v: i for i, v in enumerate(x)}
    count = Counter(x)
    return {v: i for v, i in place.items() if count[v] == 1}


def run_lines(words: list[int], seed_words: int) -> list[list[int]]:
    """From each line with a word on, the fewest lines with words, two at least, that come to
    `seed_words` words."""
    full = [i for i, n in enumerate(words) if n]
    out, end, total = [], 0, 0
    for k in range(len(full)):
        while end < len(full) and (end < k + 2 or total < seed_words):
            total += words[full[end]]
            end += 1
        if end < k + 2 or total < seed_words:
            break
        out.append(full[k:end])
        total -= words[full[k]]
    return out


def _anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The longest chain of places, in order in both, of values that are unique in both."""
    in_a, in_b = _unique(a), _unique(b)
    pairs = [(i, in_b[v]) for v, i in in_a.items() if v in in_b]  # ordered by i
    tails, ends, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    chain.reverse()
    return chain


def _zeros(row: int, width: int) -> int:
    return (~row & ((1 << width) - 1)).bit_count()


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Rows of the table of longest common subsequences, a bit for each place of `b`, 0 where the
    length grows: whole rows are added and masked at once, so that repeated values cost no more."""
    places: dict[int, int] = {}
    for j, v in enumerate(b):
        places[v] = places.get(v, 0) | 1 << j
    full = row = (1 << len(b)) - 1
    yield row
    for v in a:
        same = row & places.get(v, 0)
        row = (row + same | row - same) & full
        yield row


def _lengths(row: int, width: int) -> np.ndarray:
    """The lengths that a row of bits stands for, at each of 0 to `width` places."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-width // 8), "little"), dtype=np.uint8), count=width, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Plain diff: places (i, j) of a longest common subsequence, in order. Tables of more than
    TABLE_BITS are cut in halves of `a` at the place of `b` where both meet."""
    common = set(a) & set(b)
    in_a, in_b = ([i for i, v in enumerate(x) if v in common] for x in (a, b))
    if len(common) <= 1:
        return list(zip(in_a, in_b, strict=False))
    out: list[tuple[int, int]] = []
    todo = [(0, len(in_a), 0, len(in_b))]
    while todo:
        x, x_end, y, y_end = todo.pop()
        one, two = [a[i] for i in in_a[x:x_end]], [b[j] for j in in_b[y:y_end]]
        if len(one) > 1 and len(one) * len(two) > TABLE_BITS:
            half = len(one) // 2
            *_, low = _rows(one[:half], two)
            *_, high = _rows(one[half:][::-1], two[::-1])
            cut = int((_lengths(low, len(two)) + _lengths(high, len(two))[::-1]).argmax())
            todo += [(x, x + half, y, y + cut), (x + half, x_end, y + cut, y_end)]
            continue
        rows = list(_rows(one, two))
        i, j = len(one), len(two)
        left = _zeros(rows[i], j)
        while left:
            if _zeros(rows[i - 1], j) < left:
                j = (~rows[i] & ((1 << j) - 1)).bit_length() - 1
                out.append((in_a[x + i - 1], in_b[y + j]))
                left -= 1
            i -= 1
    return sorted(out)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of two sequences, in order: patience diff, its gaps aligned again,
    those without a unique value by a longest common subsequence."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        x, x_end, y, y_end = todo.pop()
        while x < x_end and y < y_end and a[x] == b[y]:
            out.append((x, y))
            x, y = x + 1, y + 1
        while x < x_end and y < y_end and a[x_end - 1] == b[y_end - 1]:
            x_end, y_end = x_end - 1, y_end - 1
            out.append((x_end, y_end))
        if x == x_end or y == y_end:
            continue
        chain = _anchors(a[x:x_end], b[y:y_end])
        if not chain:
            out += [(x + i, y + j) for i, j in longest_common(a[x:x_end], b[y:y_end])]
            continue
        low = (x, y)
        for i, j in chain:
            out.append((x + i, y + j))
            todo.append((low[0], x + i, low[1], y + j))
            low = (x + i + 1, y + j + 1)
        todo.append((low[0], x_end, low[1], y_end))
    return sorted(out)


def shared_lines(early: list[int], late: list[int], words: list[int], block_words: int) -> list[int]:
    """The lines of `late` that align with `early`; stretches that are left are aligned again, as
    long as a block of `block_words` words is found in them."""
    same = [j for _, j in patience(early, late)]
    todo = _stretches(same, 0, len(late))
    while todo:
        start, end = todo.pop()
        if sum(words[start:end]) < block_words:
            continue
        found = block([start + j for _, j in patience(early, late[start:end])], words, block_words)
        if found:
            same += found
            todo += _stretches(found, start, end)
    return sorted(same)


def _stretches(taken: list[int], start: int, end: int) -> list[tuple[int, int]]:
    edges = [start - 1, *taken, end]
    return [(i + 1, j) for i, j in zip(edges, edges[1:], strict=False) if j - i > 1]


def overlaps(lines: DataFrame, seed_words: int = SEED_WORDS) -> DataFrame:
    """Pairs of documents (first, later) that share a seed line or run, each pair once.

    Seeds that hold more than one in HEAVY of all rows, HEAVY at most, are looked up in a broadcast
    table, so that no task gets all rows of a common line; the others are joined by shuffle.
    """
    long = F.transform(F.filter(F.arrays_zip("hashes", "words"), lambda x: x["words"] >= seed_words), lambda x: x["hashes"])
    seeds = lines.select("doc_id", F.explode(F.array_distinct(F.concat(long, "runs"))).alias("line"))
    first = seeds.groupBy("line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).filter("first < last")
    first = materialize(first.select("line", "first", "n"))
    total = first.agg(F.sum("n")).first()[0] or 0
    heavy = first.filter(F.col("n") > total / HEAVY).select("line", F.col("first").alias("heavy_first"))  # HEAVY rows at most
    marked = seeds.join(F.broadcast(heavy), "line", "left")
    light = marked.filter("heavy_first is null").join(first.select("line", "first"), "line")
    met = light.select("first", "doc_id").unionByName(marked.filter("heavy_first is not null").select(F.col("heavy_first").alias("first"), "doc_id"))
    return met.filter("first < doc_id").select("first", F.col("doc_id").alias("later")).distinct()


def repeated_lines(docs: DataFrame, seed_words: int = SEED_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_lines, the numbers of the lines to delete (from 0), and their words."""
    lines = materialize(line_hashes(docs, seed_words))
    clear = lines.groupBy("doc_id").agg(F.min(F.xxhash64("hashes")).alias("least"), F.max(F.xxhash64("hashes")).alias("most"))
    twice = materialize(clear.filter("least <> most").select("doc_id"))
    lines = lines.join(twice, "doc_id", "left_anti")
    pairs = materialize(overlaps(lines, seed_words))
    wanted = pairs.select(F.col("later").alias("doc_id")).union(pairs.select(F.col("first").alias("doc_id"))).distinct()
    texts = lines.join(wanted, "doc_id", "left_semi")
    one = materialize(texts.select("doc_id", "hashes", "words").dropDuplicates(["doc_id"]))
    # documents that open more than one in HEAVY of all pairs are copied into SALTS parts
    busy = pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    busy = busy.filter(F.col("n") > pairs.count() / HEAVY).select("first", F.lit(SALTS).alias("parts"))  # HEAVY rows at most
    deal = lambda df: df.join(F.broadcast(busy), "first", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    pairs = deal(pairs).withColumn("part", F.pmod(F.xxhash64("later"), F.col("parts")).cast("int")).drop("parts")
    early = deal(one.select(F.col("doc_id").alias("first"), F.col("hashes").alias("early")))
    early = early.select("first", "early", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    late = one.select(F.col("doc_id").alias("later"), F.col("hashes").alias("late"), "words")

    def align(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sides = (part.column(c).to_pylist() for c in ("early", "late", "words"))
                found = [shared_lines(a, b, n, block_words) for a, b, n in zip(*sides, strict=True)]
                yield pa.record_batch([part.column("later"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "same"])
            release()

    aligned = pairs.join(early, ["first", "part"]).join(late, "later").select("later", "early", "late", "words").mapInArrow(align, "doc_id long, same array<int>")
    merged = aligned.select("doc_id", F.explode("same").alias("line")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("same"))

    def runs(batches):
        for batch in batches:
            ids, gone, count = [], [], []
            for doc_id, same, words in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "same", "words")), strict=True):
                out = block(same, words, block_words)
                if out:
                    ids.append(doc_id)
                    gone.append(out)
                    count.append(sum(words[i] for i in out))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(count, pa.int64())], ["doc_id", "gone", "gone_words"])
            release()

    return merged.join(one.select("doc_id", "words"), "doc_id").mapInArrow(runs, "doc_id long, gone array<int>, gone_words long")


def block(same: list[int], words: list[int], block_words: int) -> list[int]:
    """The aligned lines that lie in runs of at least `block_words` words; lines without a word
    neither end a run nor count."""
    out: list[int] = []
    run: list[int] = []
    last = None
    for i in [*same, None]:
        if run and (i is None or any(words[k] for k in range(last + 1, i))):
            if sum(words[k] for k in run) >= block_words:
                out += run
            run = []
        if i is not None:
            run.append(i)
            last = i
    return out


def dedup(docs: DataFrame, seed_words: int = SEED_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` without the repeated blocks; n_chars follows the text where there is such a column.
    A document of which no word is left goes."""
    id_, lost = fresh(docs.columns, "__id", "__gone")
    gone = materialize(repeated_lines(docs, seed_words, block_words)).select(F.col("doc_id").alias(id_), F.col("gone").alias(lost))
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone[id_], "left")
    whole = F.col(lost).isNull()
    lines = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col(lost), i))
    joined = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(F.array_join(lines, "\n")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    emptied = ~whole & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return joined.filter(~emptied).select(*docs.columns)


def report(docs: DataFrame, seed_words: int = SEED_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document that loses lines: doc_id, n_gone (lines), gone_words, gone (their
    numbers, comma-joined)."""
    found = repeated_lines(docs, seed_words, block_words)
    return found.select("doc_id", F.size("gone").cast("long").alias("n_gone"), "gone_words", F.array_join(F.transform("gone", lambda i: i.cast("string")), ",").alias("gone"))
