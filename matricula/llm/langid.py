"""Language identification by a byte convolutional network.

Texts are cut into windows of 256 UTF-8 bytes. An embedding of the bytes goes through filters of
several widths, the maximum over the window, and a softmax. It is trained in numpy on windows of
a bounded sample of labelled texts (`sample` documents), and applied to every window of every
text; a text's probabilities are the softmax of its mean window scores, weighted by length.

A softmax always gives some learned language, and often with certainty, so that its score does not
tell what the network never saw. `keep_known` therefore asks how many of a text's letter trigrams
are usual in some learned language, counted over all texts to learn from, and sets its limits by all
labelled texts held out of training.

Defined results: null text, or text without any letter, is `und` with score 0. With no labelled
text at all every text is `und`. Repeated rows and null ids are scored row by row; lang, source
and doc_id are no inputs of a prediction. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, crc_rest, fresh, in_bitmap, materialize, per_batch

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
#: Documents that the network is trained on, at most (so many languages, at most, those with the most
#: texts; each has one text or more), and the windows taken from each.
SAMPLE, WINDOWS_EACH = 3000, 3
_LETTER = r"\pL"
#: The share of a language's letter trigrams, the commonest first, that are usual in it; signs of a
#: text that count as usual before any is seen; the low quantile of held-out texts that, times the
#: margin, is the limit; and the held-out texts that a language needs for a limit of its own.
USUAL, PRIOR, QUANTILE, MARGIN, LEAST = 0.995, 20, 0.005, 0.9, 50


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (n, WINDOW) of the texts, the text each belongs to, and its share of bytes.

    The last window of a text is filled up with blanks.
    """
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    out = np.full((int(counts.sum()), WINDOW), 0x20, dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    flat, at = out.reshape(-1), 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, dtype=np.uint8)
        at += n * WINDOW
    sizes = np.full(len(out), WINDOW)
    last = np.cumsum(counts) - 1
    sizes[last] = [max(1, len(t) - (n - 1) * WINDOW) for t, n in zip(texts, counts.tolist(), strict=True)]
    return out, owner, sizes


class ByteConvNet:
    """Embedding, filters of several widths, max pooling, softmax; float32 throughout."""

    def __init__(self, languages: list[str], seed: int = 7, embedding: int = 8, filters: int = 12) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.embedding = rng.normal(0, 0.5, (256, embedding)).astype(np.float32)
        self.filters = [rng.normal(0, (2 / (w * embedding)) ** 0.5, (w * embedding, filters)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(filters, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (filters * len(WIDTHS), len(languages))).astype(np.float32)
        self.shift = np.zeros(len(languages), np.float32)

    def _patches(self, x: np.ndarray, width: int) -> np.ndarray:
        n, length, dim = x.shape
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, length - width + 1, width * dim), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view).reshape(-1, width * dim)

    def _pooled(self, x: np.ndarray, arg: bool = False):
        found, where = [], []
        for width, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            scores = (self._patches(x, width) @ f).reshape(len(x), -1, f.shape[1])
            if arg:
                where.append(scores.argmax(axis=1))
            found.append(np.maximum(scores.max(axis=1) + b, 0))
        return np.concatenate(found, axis=1), where

    def scores(self, bytes_: np.ndarray, step: int = 256) -> np.ndarray:
        out = np.empty((len(bytes_), len(self.languages)), np.float32)
        for at in range(0, len(bytes_), step):
            pooled, _ = self._pooled(self.embedding[bytes_[at : at + step]])
            out[at : at + step] = pooled @ self.out + self.shift
        return out

    def train(self, bytes_: np.ndarray, labels: np.ndarray, epochs: int = 6, rate: float = 0.004, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        params = [self.embedding, *self.filters, *self.bias, self.out, self.shift]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        weight = 1 / np.maximum(np.bincount(labels, minlength=len(self.languages)), 1)
        weight = weight / weight[labels].mean()
        t, dim, n_filters = 0, self.embedding.shape[1], self.filters[0].shape[1]
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), 64):
                rows = order[at : at + 64]
                x8 = bytes_[rows]
                x = self.embedding[x8]
                pooled, where = self._pooled(x, arg=True)
                z = pooled @ self.out + self.shift
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), labels[rows]] -= 1
                p *= (weight[labels[rows]] / len(rows))[:, None]
                d_pooled = (p @ self.out.T) * (pooled > 0)
                grads = [np.zeros_like(self.embedding), *map(np.zeros_like, self.filters), *map(np.zeros_like, self.bias), pooled.T @ p, p.sum(axis=0)]
                each = np.arange(len(rows))
                for k, width in enumerate(WIDTHS):
                    d = d_pooled[:, k * n_filters : (k + 1) * n_filters]
                    grads[1 + len(WIDTHS) + k] += d.sum(axis=0)
                    for i in range(width):
                        place = where[k] + i
                        picked = x[each[:, None], place]
                        grads[1 + k][i * dim : (i + 1) * dim] += np.einsum("nf,nfd->df", d, picked)
                        back = d[:, :, None] * self.filters[k][i * dim : (i + 1) * dim].T[None]
                        np.add.at(grads[0], x8[each[:, None], place].reshape(-1), back.reshape(-1, dim))
                t += 1
                for q, g, (m, v) in zip(params, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def train(labelled: DataFrame, sample: int = SAMPLE, windows_each: int = WINDOWS_EACH) -> ByteConvNet | None:
    """A network for the languages of `labelled` (text, lang)."""
    languages, picked = _sampled(labelled, sample)
    if not languages:
        return None

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, langs = [], []
        for text, lang, h in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "h")), strict=True):
            data, rng = text.encode("utf-8", "replace"), np.random.default_rng(h & 0xFFFFFFFF)
            starts = rng.integers(0, max(1, len(data) - WINDOW + 1), windows_each)
            for k, s in enumerate(sorted(set(starts.tolist()))):
                piece = data[s : s + WINDOW]
                out.append(piece if k % 2 == 0 else piece[: int(rng.integers(24, WINDOW))])
                langs.append(lang)
        return pa.record_batch([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "bytes"])

    rows = sorted((r["lang"], bytes(r["bytes"])) for r in per_batch(picked, "text", lambda: cut, "lang string, bytes binary").collect())
    net = ByteConvNet(languages)
    x, _, _ = windows([b for _, b in rows])
    net.train(x, np.array([languages.index(lang) for lang, _ in rows]))
    return net


def _sampled(labelled: DataFrame, sample: int) -> tuple[list[str], DataFrame | None]:
    """The languages, and as many texts (text, lang, h) of each, those of the least hash h."""
    from pyspark.sql.window import Window as W

    usable = labelled.filter("text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    keys = usable.select("lang", F.xxhash64("text").alias("h")).distinct()
    sizes = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    languages = sorted(sizes)
    if not languages:
        return [], None
    each = max(1, sample // len(languages))
    # hashes are spread evenly, so twice the wanted share of them leaves few rows to rank
    below = labelled.sparkSession.createDataFrame([(x, min(1.0, 2 * each / sizes[x] + 1e-3)) for x in languages], "lang string, below double")
    few = keys.join(F.broadcast(below), "lang").filter(F.col("h").cast("double") / 2.0**64 + 0.5 <= F.col("below"))  # `sample` rows at most
    chosen = few.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("nth") <= each)
    chosen = F.broadcast(chosen.select("lang", "h"))  # `sample` rows at most

    picked = usable.withColumn("h", F.xxhash64("text")).join(chosen, ["lang", "h"]).dropDuplicates(["lang", "h"])
    return languages, picked.select("text", "lang", "h")


def letter_grams(text: str) -> np.ndarray:
    """Numbers of the trigrams of bytes that are letters, signs beyond ASCII, or blanks."""
    x = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8).astype(np.int32)
    fine = ((x >= 0x61) & (x <= 0x7A)) | (x >= 0x80) | (x == 0x20)
    whole = fine[:-2] & fine[1:-1] & fine[2:]
    return ((x[:-2] << 16) | (x[1:-1] << 8) | x[2:])[whole]


def usual_grams(labelled: DataFrame, languages: list[str] | None = None) -> np.ndarray:
    """The letter trigrams that are usual in some of the languages (all, if not given), as a bitmap.

    They are counted over all texts of `labelled`, a text that repeats in a language once. Trigrams as
    common as the last that is usual are usual too.
    """
    from pyspark.sql.window import Window as W

    usable = labelled.select("lang", "text").filter("text is not null and lang is not null").filter(F.col("text").rlike(_LETTER))
    if languages is not None:
        usable = usable.join(F.broadcast(labelled.sparkSession.createDataFrame([(x,) for x in languages], "lang string")), "lang")  # as many as were learned

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            grams.setdefault(lang, []).append(letter_grams(text))
        out = [np.unique(np.concatenate(g), return_counts=True) for g in grams.values()]
        names = np.repeat(np.array(list(grams), dtype=object), [len(g) for g, _ in out])
        return pa.record_batch([pa.array(names, pa.string()), pa.array(np.concatenate([g for g, _ in out]), pa.int32()), pa.array(np.concatenate([n for _, n in out]), pa.int64())], ["lang", "gram", "n"])

    found = materialize(per_batch(usable.distinct(), "text", lambda: count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # trigrams of one count stay together, so that a language is ordered by its few different counts
    whole = W.partitionBy("lang")
    steps = found.groupBy("lang", "n").agg(F.sum("n").alias("mass"))
    before = F.sum("mass").over(whole.orderBy(F.desc("n"))) - F.col("mass")
    least = steps.withColumns({"before": before, "all": F.sum("mass").over(whole)}).filter(F.col("before") < USUAL * F.col("all")).groupBy("lang").agg(F.min("n").alias("least"))
    return bitmap(found.join(F.broadcast(least), "lang").filter(F.col("n") >= F.col("least")), "gram", 1 << 24)


def predict(docs: DataFrame, net: ByteConvNet | None, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = ("lang_pred", "score"), bits: np.ndarray | None = None) -> DataFrame:
    """`keep` columns, the language and its probability (as `names`) for every row of `docs`; with
    `bits` of usual trigrams also their share in the text (the third name)."""
    shared = None if bits is None else docs.sparkSession.sparkContext.broadcast(bits)
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + f", `{names[0]}` string, `{names[1]}` double" + "".join(f", `{c}` double" for c in names[2:])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = pc.fill_null(batch.column("text"), "")
            lettered = pc.match_substring_regex(texts, _LETTER).to_numpy(zero_copy_only=False)
            lang = np.full(batch.num_rows, UNKNOWN, dtype=object)
            score = np.zeros(batch.num_rows)
            rows = np.flatnonzero(lettered) if net else np.zeros(0, int)
            if len(rows):
                data = texts.cast(pa.binary()).take(pa.array(rows)).to_pylist()
                total, weight = np.zeros((len(rows), len(net.languages))), np.zeros(len(rows))
                x, owner, sizes = windows(data)
                z = net.scores(x) * sizes[:, None]
                np.add.at(total, owner, z)
                np.add.at(weight, owner, sizes)
                total /= weight[:, None]
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                lang[rows] = np.array(net.languages, dtype=object)[best]
                score[rows] = p[np.arange(len(rows)), best]
            more = [] if shared is None else [shares(batch.column("text").to_pylist(), shared.value)]
            return pa.record_batch([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score), *more], [*keep, *names])

        return work

    return per_batch(docs.select(*keep, *([] if "text" in keep else ["text"])), "text", make, schema)


def identify(docs: DataFrame, rest: int = 1, modulus: int = 3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rows whose crc32(doc_id) mod `modulus` is `rest` are
    held out of training."""
    held = crc_rest("doc_id", modulus) == rest
    net = train(docs.filter(~held).select("text", "lang"), sample)
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), net)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def shares(texts: list[str | None], bits: np.ndarray) -> pa.Array:
    """The share of usual letter trigrams in each text."""
    grams = [letter_grams(t or "") for t in texts]
    seen = [int(in_bitmap(bits, g).sum()) for g in grams]
    return pa.array([(n + PRIOR) / (len(g) + PRIOR) for n, g in zip(seen, grams, strict=True)], pa.float64())


def familiar(labelled: DataFrame, bits: np.ndarray, name: str) -> DataFrame:
    """The lang of each row of `labelled` and the share of usual letter trigrams in its text."""
    shared = labelled.sparkSession.sparkContext.broadcast(bits)

    def make():
        return lambda batch: pa.record_batch([batch.column("lang"), shares(batch.column("text").to_pylist(), shared.value)], ["lang", name])

    return per_batch(labelled.select("lang", "text"), "text", make, f"lang string, `{name}` double")


def keep_known(docs: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, least: int = LEAST) -> DataFrame:
    """Rows of `docs` in a known language: not `und`, and with a share of usual letter trigrams that
    held-out texts of that language have. Without held-out texts only `und` goes."""
    columns = docs.columns
    names = tuple(fresh(columns, "__language", "__probability", "__familiar", "__limit"))
    share = names[2]
    trained = docs.filter(crc_rest("doc_id", 3) != 1).select("text", "lang")
    net = train(trained)
    bits = usual_grams(trained, net.languages if net else [])
    held = docs.filter((crc_rest("doc_id", 3) == 1) & F.col("lang").isNotNull() & F.col("text").rlike(_LETTER)).select("lang", "text")
    found = familiar(held, bits, share)
    low = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(share, quantile, 10000).alias("low"))
    known = docs.sparkSession.createDataFrame([(x,) for x in (net.languages if net else [])], "lang string")
    own = low(found.join(F.broadcast(known), "lang").groupBy("lang")).filter(F.col("n") >= least).select(F.col("lang").alias(names[0]), F.col("low").alias(names[3]))  # as many as were learned
    limit_of = F.coalesce(F.col(names[3]), F.lit(low(found).first()["low"] or 0.0))
    judged = predict(docs, net, tuple(columns), names[:3], bits).join(F.broadcast(own), names[0], "left")
    return judged.filter((F.col(names[0]) != UNKNOWN) & (F.col(share) >= limit_of * margin)).select(*columns)
