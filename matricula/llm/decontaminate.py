"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores.

Texts are read twice where they lie. The first pass counts in how many documents each word n-gram of
an item occurs. In every stretch of `STRETCH` n-grams of an item that occur at all, the rarest half
become its seeds, so that each item that can be found has some, however common its words are and
however often the corpus holds it. The second pass cuts out the passages around seeds, wide enough
for the longest item; they meet the items in a join on the seeds (salted, as a copied item's seeds
may be everywhere). In both passes a bitmap of fixed size keeps n-grams out that no item has.

Each passage is aligned locally, word by word, with the items that it met, so that replaced, inserted
and lost words only lower the score. The score is the alignment's share of the best possible; it
counts from `min_score` on, or where it is worth `EXCERPT` words without an error, as of a long item.
Passages with too few of an item's words for that in any order are not aligned, which loses nothing.

Words are compared in lower case (ASCII), without marks at either end, by 64-bit hashes. Those of all
words of many texts are worked out at once, eight bytes of every word at a time.

Defined results: null or blank texts and items match nothing. Equal items are reported each;
repeated rows give repeated results; a null doc_id is reported as null. Items with fewer words
than a seed are matched as a whole, exactly. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bitmap, in_bitmap, materialize, per_batch, release, slices

SEED, STRETCH = 3, 8
MIN_SCORE, EXCERPT = 0.4, 30
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the bitmap over n-grams, and parts into which rows of one seed or item are dealt.
BITMAP_BITS, SALTS = 1 << 25, 8
#: Bytes of text, about, and words that a step takes at once; words of more bytes than LONG are hashed
#: one by one.
STEP_BYTES, STEP_WORDS, LONG = 1 << 19, 1 << 16, 64

_STRIP = b".,;:!?\"'()[]{}<>*#$%&|-"
_ITEM = "item long, item_id long, words string, n int, grams array<long>"
_PASSAGE = "passage long, row long, doc_id long, first int, words string, grams array<long>"
_HIT = "row long, doc_id long, item long, item_id long, score double, first_word int, last_word int"
_MULTIPLY = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: What a byte is: part of a word, a mark, or a blank.
_KIND = np.zeros(256, np.uint8)
_KIND[list(_STRIP)] = 1
_KIND[list(b" \t\n\r\x0b\x0c")] = 2
#: The bits of a little-endian number of eight bytes that its first bytes fill.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    found = (x.strip(_STRIP) for x in (text or "").encode("utf-8", "surrogatepass").lower().split())
    return [x for x in found if x]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, without their marks; words of marks alone are left out."""
    kind = _KIND[np.frombuffer(data, np.uint8)]
    body = np.zeros(len(kind) + 2, np.int8)
    body[1:-1] = kind == 0
    edges = np.flatnonzero(np.diff(body))  # of runs without marks and blanks
    if not len(edges):
        return edges, edges
    apart = np.maximum.reduceat(kind, edges[:-1])[1::2] == 2  # a blank is between a run and the next
    return edges[::2][np.r_[True, apart]], edges[1::2][np.r_[apart, True]]


def word_codes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each of the words of a text."""
    from xxhash import xxh64_intdigest

    at_once = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))  # eight bytes from each place on
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), STEP_WORDS):
        first, left = starts[k : k + STEP_WORDS], ends[k : k + STEP_WORDS] - starts[k : k + STEP_WORDS]
        codes = left.astype(np.uint64) * _MULTIPLY[1]
        for i in np.flatnonzero(left > LONG).tolist():
            codes[i] = xxh64_intdigest(data[first[i] : first[i] + left[i]])
        rows = np.flatnonzero(left <= LONG)
        first, left = first[rows], left[rows]
        while len(rows):
            h = (codes[rows] ^ (at_once[first] & _FIRST[np.minimum(left, 8)])) * _MULTIPLY[0]
            codes[rows] = h ^ (h >> np.uint64(29))
            more = left > 8
            rows, first, left = rows[more], first[more] + 8, left[more] - 8
        out[k : k + STEP_WORDS] = codes
    return out


def codes_of(data: bytes) -> np.ndarray:
    return word_codes(data, *word_spans(data))


def gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of `n` words, as signed numbers."""
    if len(codes) < n:
        return np.zeros(0, np.int64)
    h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = (h ^ codes[i : len(codes) - n + 1 + i]) * _MULTIPLY[i]
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def prepared(benchmark: DataFrame, n: int = SEED) -> DataFrame:
    """Items with words: a number, item_id, words, how many, and the hash of each n-gram in order."""

    def make():
        task, number = TaskContext.get().partitionId() << 40, 0

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number
            rows = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if words := words_of(text):
                    rows.append((task + number, item_id, b" ".join(words).decode("utf-8", "replace"), len(words), gram_keys(codes_of(b" ".join(words)), min(n, len(words)))))
                    number += 1
            types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64())]
            return pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], ["item", "item_id", "words", "n", "grams"])

        return work

    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    return per_batch(source, "text", make, _ITEM)


class _Found:
    """Where some texts have n-grams that a bitmap holds: `text`, `place` (a word's number in its text)
    and `key` of each such n-gram, by text and place."""

    def __init__(self, texts: pa.Array, bits: np.ndarray, lengths: list[int]) -> None:
        texts = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        self.data = b"\n".join(texts).lower()
        self.starts, self.ends = word_spans(self.data)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        #: Number of the first word of each text, and of all words.
        self.first = np.searchsorted(self.starts, np.r_[0, np.cumsum(sizes)])
        codes, found = word_codes(self.data, self.starts, self.ends), []
        for n in lengths:
            key = gram_keys(codes, n)
            at = np.flatnonzero(in_bitmap(bits, key))
            text = np.searchsorted(self.first, at, "right") - 1
            inside = at + n <= self.first[text + 1]
            found.append((text[inside], at[inside], key[at[inside]]))
        text, at, key = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        self.text, self.key = text[order], key[order]
        self.place = at[order] - self.first[self.text]

    def words(self, text: int, start: int, stop: int) -> str:
        """Some words of a text, without their marks."""
        begin, end = int(self.first[text]), int(self.first[text + 1])
        k = slice(begin + start, min(begin + stop, end))
        told = b" ".join([self.data[a:b] for a, b in zip(self.starts[k].tolist(), self.ends[k].tolist(), strict=True)])
        return told.decode("utf-8", "replace")


def document_counts(docs: DataFrame, bits: np.ndarray, lengths: list[int]) -> DataFrame:
    """gram and n: in how many rows of `docs` each n-gram of the bitmap occurs."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = []
        for part in slices(batch, "text", STEP_BYTES):
            found = _Found(part.column("text"), shared.value, lengths)
            order = np.lexsort((found.key, found.text))
            text, key = found.text[order], found.key[order]
            keys.append(key[np.r_[True, (np.diff(text) != 0) | (np.diff(key) != 0)][: len(key)]])
        keys, n = np.unique(np.concatenate(keys), return_counts=True)
        return pa.record_batch([pa.array(keys), pa.array(n)], ["gram", "n"])

    return per_batch(docs.select("text"), "text", lambda: work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def choose_seeds(items: DataFrame, counts: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """gram and item: of the n-grams of an item that occur, the rarest half in every stretch."""
    grams = items.select("item", F.posexplode("grams").alias("place", "gram"))
    seen = grams.join(counts, "gram").groupBy("item", "gram").agg(F.min("place").alias("place"), F.min("n").alias("n"))
    order = W.partitionBy("item", F.floor(F.col("place") / stretch)).orderBy("n", "place")
    return seen.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, stretch // 2)).select("gram", "item")


def passages(docs: DataFrame, bits: np.ndarray, lengths: list[int], reach: int) -> DataFrame:
    """Stretches of the texts within `reach` words of a seed, with the seeds in them."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        task, row, number = TaskContext.get().partitionId() << 40, 0, 0

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal row, number
            out = []
            for part in slices(batch, "text", STEP_BYTES):
                found, ids = _Found(part.column("text"), shared.value, lengths), part.column("doc_id").to_pylist()
                apart = (np.diff(found.text) != 0) | (np.diff(found.place) > 2 * reach)
                starts = np.flatnonzero(np.r_[True, apart][: len(found.text)])
                for a, b in zip(starts.tolist(), [*starts.tolist(), len(found.text)][1:], strict=True):
                    text, first = int(found.text[a]), max(0, int(found.place[a]) - reach)
                    told = found.words(text, first, int(found.place[b - 1]) + reach + 1)
                    out.append((task + number, task + row + text, ids[text], first, told, np.unique(found.key[a:b])))
                    number += 1
                row += part.num_rows
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())]
            return pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], ["passage", "row", "doc_id", "first", "words", "grams"])

        return work

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", make, _PASSAGE)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: best local score of two word sequences, and the first and last word of
    `text` in it. Rows run over the item; gaps inside the text are a running maximum."""
    width = len(text)
    row = np.zeros(width + 1, dtype=np.int64)
    begin = np.arange(width + 1)
    best, span = 0, (0, 0)
    ramp = np.arange(width + 1) * -GAP
    for code in item.tolist():
        diagonal = row[:-1] + np.where(text == code, MATCH, MISMATCH)
        up = row + GAP
        score, start = up.copy(), begin.copy()
        better = diagonal >= score[1:]
        score[1:][better], start[1:][better] = diagonal[better], begin[:-1][better]
        fresh = score <= 0
        score[fresh], start[fresh] = 0, np.arange(width + 1)[fresh]
        lifted = score + ramp
        source = np.maximum.accumulate(np.where(lifted == np.maximum.accumulate(lifted), np.arange(width + 1), 0))
        moved = lifted[source] - ramp
        row, begin = np.where(moved > 0, moved, 0), np.where(moved > 0, start[source], np.arange(width + 1))
        k = int(row.argmax())
        if row[k] > best:
            best, span = int(row[k]), (int(begin[k]), k - 1)
    return best, span[0], span[1]


def shared_most(item: np.ndarray, text: np.ndarray) -> int:
    """A score that no alignment of an item with a text exceeds: that of their shared words."""
    words, count = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(words, text), len(words) - 1)
    return MATCH * int(np.minimum(np.bincount(at[words[at] == text], minlength=len(words)), count).sum())


def _aligned(min_score: float):
    def run(batches):
        code = lambda text: codes_of(text.encode("utf-8", "surrogatepass")).view(np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part, found = batch.slice(start, 1000).to_pylist(), []
                known: dict[str, np.ndarray] = {}
                for r in part:
                    item = known[r["asked"]] if r["asked"] in known else known.setdefault(r["asked"], code(r["asked"]))
                    text = code(r["words"])
                    least = min(min_score * MATCH * len(item), MATCH * EXCERPT)
                    if shared_most(item, text) < least:
                        continue
                    score, first, last = align(item, text)
                    if score >= least:
                        found.append((r["row"], r["doc_id"], r["item"], r["item_id"], score / (MATCH * len(item)), r["first"] + first, r["first"] + last))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*found, strict=True) if found else [[]] * 7, types, strict=True)], ["row", "doc_id", "item", "item_id", "score", "first_word", "last_word"])
            release()

    return run


def find(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word: the best match of each item in each text.

    `benchmark`: item_id, text.
    """
    items = materialize(prepared(benchmark))
    lengths = sorted(r[0] for r in items.select(F.least("n", F.lit(SEED)).alias("n")).distinct().collect())  # SEED rows at most
    longest = items.agg(F.max("n")).first()[0]
    if longest is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word int, last_word int")
    grams = items.select(F.explode("grams").alias("gram"))
    counts = materialize(document_counts(docs, bitmap(grams, "gram", BITMAP_BITS), lengths))
    seeds = materialize(choose_seeds(items, counts))
    cut = materialize(passages(docs, bitmap(seeds, "gram", BITMAP_BITS), lengths, longest + longest // 2 + 4))
    salt = F.pmod("passage", F.lit(SALTS)).alias("salt")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    asked = cut.select("passage", salt, F.explode("grams").alias("gram"))
    met = materialize(asked.join(seeds.select("gram", "item", every), ["gram", "salt"]).select("passage", "item").distinct())
    pairs = met.join(cut.drop("grams"), "passage").withColumn("salt", salt)
    pairs = pairs.join(items.select("item", "item_id", F.col("words").alias("asked"), every), ["item", "salt"])
    pairs = pairs.select("row", "doc_id", "first", "words", "item", "item_id", "asked")
    hits = pairs.mapInArrow(_aligned(min_score), _HIT)
    best = hits.groupBy("row", "item").agg(F.max_by(F.struct("doc_id", "item_id", "score", "first_word", "last_word"), F.struct("score", -F.col("first_word"))).alias("best"))
    return best.select("best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no test item is found; rows without a doc_id stay."""
    gone = materialize(find(docs, benchmark).select(F.col("doc_id").alias("__id")).filter("__id is not null").distinct())
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__id"], "left_anti")
