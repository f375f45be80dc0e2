"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model: 5-grams of lower-case characters, of any script, counted over trusted text. Counts,
continuation counts, discounts, back-off weights and probabilities are groupings and joins of
DataFrames keyed by the gram, so that the model grows with its text; only the counts of counts
reach the driver. A fifth of the trusted documents (`HELD` of `FOLDS`, by a hash of the id) is held
out of the counts: the limits are quantiles of what the model thinks of those.

The logarithm of an interpolated probability is a sum over the orders: the back-off weight of each
context, and for each gram that was seen what it adds to its own suffix. A text's log-likelihood is
thus the sum of one number for each gram of one to five characters that ends at one of its places,
and scoring is a join of (document, gram, count) with (gram, number), sharded by the gram. The most
frequent grams (`TOP` at most) are looked up while the counts are made, so that they are not
shuffled, and a bitmap of fixed size keeps grams out of the join that the model surely lacks; every
other gram of a document goes through the join.

A document is kept if its smoothed mean negative log-likelihood is within the quantile of held-out
trusted documents of its language (widened by `margin`); smoothing towards the language's median
keeps short texts from failing by chance. A language's median, and how far its quantile lies above
it, are drawn towards those of all documents by `few` of them, so that each language has limits of
its own, and the fewer documents it has the nearer they lie to the common ones.

Grams are told apart by 64-bit hashes. Defined results: null or empty text has perplexity null and
is not kept; a null language is `und`. Repeated rows and null ids are scored row by row. Without
held-out trusted text nothing can be judged, and every document with text is kept. The control
characters 0, 2 and 3 count as one replacement character. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, materialize, release, slices

ORDER = 5
#: Grams that are looked up without a join, at most; bits of the bitmaps over ids and over grams.
TOP, BITMAP_BITS = 1 << 18, 1 << 23
QUANTILE, MARGIN, FEW, PRIOR = 0.995, 1.05, 20, 100
#: Of FOLDS parts of the trusted documents, the one that is held out.
HELD, FOLDS = 0, 5
#: Text bytes and places that are worked on at a time.
BATCH_BYTES, PLACES = 2 << 20, 1 << 20

_START, _END = "\x02", "\x03"
_BASE, _SALT, _MIX = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93, np.uint64(0xFF51AFD7ED558CCD)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, each between ORDER start signs and an end sign, and the number
    of characters of each."""
    clean = [(t or "").lower().replace("\x00", "�").replace(_START, "�").replace(_END, "�") for t in texts]
    joined = "".join(f"{_START * ORDER}{t}{_END}" for t in clean)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4"), np.array([len(t) for t in clean], dtype=np.int64)


def gram_keys(grams: np.ndarray) -> np.ndarray:
    """Hashes of grams of one length, one row of characters each."""
    h = np.zeros(len(grams), dtype=np.uint64)
    for j in range(grams.shape[1]):
        h = h * _BASE + grams[:, j].astype(np.uint64) + np.uint64(1)
    h ^= np.uint64(grams.shape[1] * _SALT & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def distinct_windows(characters: np.ndarray, sizes: np.ndarray, skip: int):
    """In runs of PLACES: the characters of each distinct window of ORDER, which window ends at each
    place, and the text of each place. The first `skip` places of a text are left out."""
    starts = np.cumsum(sizes + ORDER + 1) - (sizes + ORDER + 1)
    wanted = np.ones(len(characters), dtype=bool)
    wanted[(starts[:, None] + np.arange(skip)).reshape(-1)] = False
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + ORDER + 1)
    back = np.arange(1 - ORDER, 1)
    for start in range(0, len(characters), PLACES):
        low, end = max(0, start - ORDER + 1), min(start + PLACES, len(characters))
        part = characters[low:end].astype(np.uint64)
        h = np.zeros(max(0, len(part) - ORDER + 1), dtype=np.uint64)
        for j in range(ORDER):
            h = h * _BASE + part[j : j + len(h)] + np.uint64(1)
        keep = wanted[low + ORDER - 1 : end]
        places = np.flatnonzero(keep) + low + ORDER - 1
        if not len(places):
            continue
        numbered = pa.array(h[keep]).dictionary_encode()
        window = numbered.indices.to_numpy()
        first = np.empty(len(numbered.dictionary), dtype=np.int64)
        first[window[::-1]] = places[::-1]
        yield characters[first[:, None] + back], window, owner[places]


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and text of the documents that are labelled good. Only those that pass a bitmap over
    the ids are shuffled."""
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(good.select(F.xxhash64("doc_id").alias("h")), "h", BITMAP_BITS))

    def may(batches):
        for batch in batches:
            keep = in_bitmap(shared.value, batch.column("h").to_numpy())
            if keep.any():
                yield batch.filter(pa.array(keep)).select(["doc_id", "text"])

    source = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passed = source.withColumn("h", F.xxhash64("doc_id")).mapInArrow(may, "doc_id long, text string")
    return passed.join(good.hint("merge"), "doc_id", "left_semi")


def held_out() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(FOLDS)) == HELD


def count_grams(texts: DataFrame) -> DataFrame:
    """gram (ORDER characters) and c: how often it occurs in the texts."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                texts = [t for t in batch.column("text").to_pylist() if t]
                for grams, window, _ in distinct_windows(*code_points(texts), skip=ORDER) if texts else ():
                    yield pa.record_batch([pa.array(grams.view(f"<U{ORDER}").reshape(-1)), pa.array(np.bincount(window, minlength=len(grams)))], ["gram", "c"])
            release()

    return texts.select("text").mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: list[int]) -> list[float]:
    """Discounts for counts of 1, 2 and more, from the numbers of grams with counts of 1, 2, 3, 4."""
    n1, n2, n3, n4 = counts
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), out, strict=True)]


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, float]:
    """gram, number (what it adds to a log-likelihood wherever a text has it) and f (how often the
    trusted text has it), of all lengths up to ORDER; and the number that every place has.

    `counts`: gram (ORDER characters) and c, written."""
    levels = {ORDER: counts.select("gram", "c", F.col("c").alias("f"))}
    for n in range(ORDER - 1, 0, -1):  # lower orders count the signs that a gram was seen after
        suffix = F.substring("gram", 2, n).alias("gram")
        levels[n] = materialize(levels[n + 1].groupBy(suffix).agg(F.count(F.lit(1)).alias("c"), F.sum("f").alias("f")))
    signs = levels[1].count() + 1
    log_p: DataFrame | None = None
    floor, parts = -math.log(signs), []
    for n in range(1, ORDER + 1):
        level = levels[n]
        seen = level.agg(*(F.count_if(F.col("c") == k) for k in (1, 2, 3, 4))).first()
        d1, d2, d3 = discounts(list(seen))
        take = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = F.substring("gram", 1, n - 1)
        contexts = level.groupBy(context.alias("context")).agg(F.sum("c").alias("total"), F.log(F.sum(take) / F.sum("c")).alias("back"), F.sum("f").alias("f"))
        if n == 1:
            back = contexts.first()
            floor += back["back"] if back else 0.0
            joined = level.withColumns({"total": F.lit(back["total"] if back else 1), "base": F.lit(floor)})
        else:
            contexts = materialize(contexts)
            parts.append(contexts.select(F.col("context").alias("gram"), F.col("back").alias("number"), "f"))
            joined = level.withColumns({"context": context, "suffix": F.substring("gram", 2, n - 1)})
            joined = joined.join(contexts.drop("f"), "context").join(log_p.withColumnRenamed("gram", "suffix"), "suffix")
            joined = joined.withColumn("base", F.col("back") + F.col("log_p"))
        found = joined.select("gram", F.log((F.col("c") - take) / F.col("total") + F.exp("base")).alias("log_p"), "base", "f")
        found = materialize(found)
        parts.append(found.select("gram", (F.col("log_p") - F.col("base")).alias("number"), "f"))
        log_p = found.select("gram", "log_p")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return materialize(every.groupBy("gram").agg(F.sum("number").alias("number"), F.max("f").alias("f"))), floor


def keyed(model: DataFrame) -> DataFrame:
    """key (the gram's hash), number and f."""

    def run(batches):
        for batch in batches:
            grams = batch.column("gram").to_pylist()
            sizes = np.array([len(g) for g in grams], dtype=np.int64)
            keys = np.zeros(len(grams), dtype=np.uint64)
            for k in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == k)
                signs = "".join(grams[i] for i in mine.tolist()).encode("utf-32-le", "surrogatepass")
                keys[mine] = gram_keys(np.frombuffer(signs, "<u4").reshape(-1, k))
            yield pa.record_batch([pa.array(keys.view(np.int64)), batch.column("number"), batch.column("f")], ["key", "number", "f"])

    return model.mapInArrow(run, "key long, number double, f long")


def split_model(model: DataFrame, top: int) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame]:
    """The keys (in order) and numbers of the most frequent grams, `top` at most, and the rest.

    The border is one of a few hundred steps of frequency, so that no ranking of all is needed."""
    step = F.floor(F.log2(F.col("f").cast("double")) * 8).cast("int")
    border, so_far = None, 0
    for r in sorted(model.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # 512 rows at most
        if so_far + r["n"] > top:
            break
        border, so_far = r["step"], so_far + r["n"]
    if border is None:
        return (np.zeros(0, np.uint64), np.zeros(0)), model
    rows = model.filter(step >= border).select("key", "number").toArrow()  # `top` rows at most
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return (keys[order], rows.column("number").to_numpy()[order]), model.filter(step < border)


_SCORED = "row long, doc_id long, lang string, n_signs long, total double, keys array<long>, counts array<int>"


def count_and_score(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], bits: np.ndarray) -> DataFrame:
    """Per row of `docs`: its number of characters, the sum over frequent grams, and the hashes
    and counts of its other grams that the model may have."""
    shared = docs.sparkSession.sparkContext.broadcast((*frequent, bits))

    def run(batches):
        keys, numbers, packed = shared.value
        if not len(keys):
            keys, numbers = np.zeros(1, np.uint64), np.zeros(1)
        task, row = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                n_docs = batch.num_rows
                characters, sizes = code_points(batch.column("text").to_pylist())
                total, found = np.zeros(n_docs), []
                for grams, window, owner in distinct_windows(characters, sizes, skip=ORDER - 1) if n_docs else ():
                    value, missing = np.zeros(len(grams)), []
                    for k in range(1, ORDER + 1):
                        key = gram_keys(grams[:, ORDER - k :])
                        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        hit = keys[at] == key
                        value += np.where(hit, numbers[at], 0.0)
                        missing.append((key, ~hit & in_bitmap(packed, key.view(np.int64))))
                    total += np.bincount(owner, weights=value[window], minlength=n_docs)
                    some = np.logical_or.reduce([m for _, m in missing])[window]
                    if some.any():
                        pair, n = np.unique(owner[some].astype(np.int64) * len(grams) + window[some], return_counts=True)
                        who, which = np.divmod(pair, len(grams))
                        for key, m in missing:
                            mine = m[which]
                            found.append((who[mine], key[which[mine]].view(np.int64), n[mine]))
                who, key, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                order = np.argsort(who, kind="stable")
                ends = pa.array(np.searchsorted(who[order], np.arange(n_docs + 1)), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x[order], t)) for x, t in ((key, pa.int64()), (n, pa.int32())))
                rows = pa.array(np.arange(row, row + n_docs) + (task << 40))
                row += n_docs
                yield pa.record_batch([rows, batch.column("doc_id"), batch.column("lang"), pa.array(sizes), pa.array(total), *lists], ["row", "doc_id", "lang", "n_signs", "total", "keys", "counts"])
            release()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return source.mapInArrow(run, _SCORED)


def likelihoods(docs: DataFrame, counts: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, lang, n_signs and nll (mean negative log-likelihood of a sign, the text's end
    included) per row of `docs`; `counts` as of `count_grams`, written."""
    numbers, floor = kneser_ney(counts)
    model = materialize(keyed(numbers))
    frequent, rest = split_model(model, top)
    scored = materialize(count_and_score(docs, frequent, bitmap(rest, "key", BITMAP_BITS)))
    one = F.explode(F.arrays_zip("keys", "counts"))
    asked = scored.filter(F.size("keys") > 0).select("row", one.alias("one")).select("row", F.col("one.keys").alias("key"), F.col("one.counts").alias("n"))
    added = asked.join(rest.select("key", "number").hint("merge"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("number")).alias("more"))
    places = F.col("n_signs") + 1
    nll = -(F.col("total") + F.coalesce("more", F.lit(0.0))) / places - floor
    joined = scored.drop("keys", "counts").join(added, "row", "left")
    return joined.select("doc_id", "lang", "n_signs", F.when(F.col("n_signs") > 0, nll).alias("nll"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, few: int = FEW, prior: int = PRIOR) -> DataFrame:
    """doc_id, lang, n_signs, perplexity, kept for every row of `docs`.

    `labels`: doc_id and quality; quality 1 marks trusted text.
    """
    counts = materialize(count_grams(trusted_texts(docs, labels).filter(~held_out())))
    scored = materialize(likelihoods(docs, counts))
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().filter(held_out())
    good = materialize(scored.join(trusted, "doc_id", "left_semi").filter("nll is not null"))
    by_lang = good.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("nll", 0.5, 10000).alias("own"))
    all_ = good.agg(F.percentile_approx("nll", 0.5, 10000).alias("all_median"))
    drawn = lambda own, common: (F.col("n") * F.col(own) + few * F.col(common)) / (F.col("n") + few)
    known = materialize(by_lang.crossJoin(F.broadcast(all_)).select("lang", "n", drawn("own", "all_median").alias("median")))  # one row
    smooth = (F.col("nll") * F.col("n_signs") + F.coalesce("median", "all_median") * prior) / (F.col("n_signs") + prior)
    above = lambda df: _small_join(df, known).crossJoin(F.broadcast(all_)).withColumn("above", smooth - F.coalesce("median", "all_median"))  # noqa: E731  one row
    near = above(good)
    all_above = near.agg(F.percentile_approx("above", quantile, 10000).alias("all_above"))
    own = near.groupBy("lang", "n").agg(F.percentile_approx("above", quantile, 10000).alias("own"))
    limits = materialize(own.crossJoin(F.broadcast(all_above)).select("lang", drawn("own", "all_above").alias("most")))  # one row
    judged = _small_join(above(scored), limits).crossJoin(F.broadcast(all_above))  # one row
    smooth = F.coalesce("median", "all_median") + F.col("above")
    limit = F.coalesce("median", "all_median") + F.coalesce("most", "all_above")
    kept = F.col("nll").isNotNull() & F.coalesce(smooth <= limit * margin, F.lit(True))
    return judged.select("doc_id", "lang", "n_signs", F.exp("nll").alias("perplexity"), kept.alias("kept"))


def _small_join(df: DataFrame, by_lang: DataFrame, most: int = 10_000) -> DataFrame:
    """Left join on lang; the other side is broadcast if it has `most` rows at most."""
    return df.join(F.broadcast(by_lang) if by_lang.count() <= most else by_lang, "lang", "left")
