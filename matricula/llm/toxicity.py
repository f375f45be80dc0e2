"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine that is
trained on labelled sentences.

The kernel compares two strings by the subsequences of three letters that they share; a subsequence
may have gaps, each letter that it spans weighs `DECAY`, and it spans `SPAN` letters at most.
Inserted, doubled or lost letters thus lower the kernel only a little. A unit's start counts as a
letter, and long units are also compared by their first `HEAD` letters, as insults take endings. A
sentence (or `PART` units of a longer one) is compared with a landmark string by its best unit (a
word, or letters spelled out one by one), so that its length does not drown an insult. Kernel values
with the landmarks are mapped by Nystroem to the space where a linear SVM learns; a sentence's margin
is then a weighted sum of kernel values.

The SVM's rows are sentences. Those of clean texts are negative; of a toxic text, which need not be
toxic throughout, the sentence with the best margin is positive, and is chosen anew in each round
(multiple-instance learning). The first choice, and the landmarks, come from the same SVM over exact
units and their beginnings, trained on all sentences with the label of their text: landmarks are
those that carry its weight, and common ones of the other side. Sentences with a letter put into their
longer units are trained on as well, with the same label, as insults are disguised so.

A text's best margins (`MARGINS` of them) and how many of its units are telling by themselves, for all
its units, go through a logistic curve to its score: a syllable that is telling when it comes
back again and again is none when it comes by chance. The curve is fitted on margins of texts that
their machine was not trained on (`FOLDS` machines, each without its part of the sample).

It learns from `sample` labelled texts at most, and from about `most` of their sentences: whole texts,
those with the least hash.

Defined results: null, empty or blank texts score as sentences without any unit. With labels of
only one kind every text scores that kind's share (0 without labels). Repeated rows and null ids are
scored row by row; doc_id, lang, source and labels are no inputs. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, materialize, per_batch

#: Labelled texts and sentences that are learned from, at most.
SAMPLE, SENTENCES = 4000, 100_000
LANDMARKS, PLAIN_LANDMARKS = 80, 8
DECAY, SPAN = 0.7, 6
#: Power of the normalised kernel: higher tells near units from middling ones.
POWER = 2
#: Letters of a unit that are looked at together; longer units are covered by overlapping pieces.
LENGTH = 16
#: Units of a sentence that are looked at together, first letters that long units are also compared
#: by, and lengths of beginnings that may become landmarks.
PART, HEAD, BEGINNINGS = 16, 8, (4, 5, 7)
ROUNDS, FOLDS = 4, 3
#: Sentences of a text that its score looks at, the best ones, and the ridge of the SVM.
MARGINS, RIDGE = 4, 0.3
#: Margins of a unit by itself from which it counts as telling.
TOLD = (0.5, 1.0)
#: Texts that a unit must be in to be a landmark, the share of the best one's standing that it needs,
#: and the ridge of the SVM over exact units.
MIN_TEXTS, STANDING, UNIT_RIDGE = 3, 0.04, 50.0

#: Numbers that a text's score looks at.
SEEN = MARGINS + 2 * len(TOLD)

_MARKS = re.compile(r"[\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+\s")
_PATTERNS = [(a, b) for a in range(1, SPAN) for b in range(a + 1, SPAN)]
#: Numbers of a to z and of a unit's start are exact; subsequences with other letters share the
#: numbers after those.
_START, _LATIN, _NUMBERS = 31, 31, 1 << 16
_WEIGHTS = np.array([DECAY ** (b + 1) if 2 <= b < SPAN else 0.0 for b in range(8)], dtype=np.float32)
_PLAIN = 1 << 15
#: Odd multipliers that mix hashes.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _sign(c: str) -> int:
    """1 to 26 for letters a to z, with accents taken off, and beyond for all others."""
    bare = unicodedata.normalize("NFKD", c)[0]
    return ord(bare) - 96 if "a" <= bare <= "z" else _LATIN + 1 + ord(c) % 9973


@functools.cache
def _alphabet() -> np.ndarray:
    """The number of each character of the basic plane, 0 for what is no letter."""
    return np.array([_sign(c) if (c := chr(k)).isalpha() else 0 for k in range(1 << 16)], dtype=np.int32)


def coded(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers (rows of LENGTH, 0 after the end) of all pieces, the unit's start before its
    first letter, and each piece's unit, in order."""
    units = ["\x00" + u.replace("\x00", "") for u in units]
    characters = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    signs = _alphabet()[np.minimum(characters, 0xFFFF)]
    signs[characters == 0] = _START
    for i in np.flatnonzero(characters > 0xFFFF).tolist():
        signs[i] = _sign(c) if (c := chr(characters[i])).isalpha() else 0
    letters = signs > 0
    owner = np.repeat(np.arange(len(units)), [len(u) for u in units])[letters]
    signs = signs[letters]
    size = np.bincount(owner, minlength=len(units))
    place = np.arange(len(signs)) - (np.cumsum(size) - size)[owner]
    step = LENGTH // 2  # a piece starts at every half length, but for the last one that another covers
    pieces = np.maximum(1, -(-(size - step) // step))
    first = np.cumsum(pieces) - pieces
    rows = np.zeros((int(pieces.sum()), LENGTH), dtype=np.int32)
    for back in (0, 1):  # a letter is in the piece that starts before it and in the one before that
        piece = place // step - back
        mine = (piece >= 0) & (piece < pieces[owner])
        rows[first[owner[mine]] + piece[mine], place[mine] - piece[mine] * step] = signs[mine]
    return rows, np.repeat(np.arange(len(units)), pieces)


def subsequences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and spans less one of every subsequence of three letters, one row per piece; 0 is
    none."""
    found, spans, length = [], [], rows.shape[1]
    other = np.flatnonzero(rows.max(axis=1, initial=0) > _LATIN)
    for a, b in _PATTERNS:
        first, second, third = rows[:, : length - b], rows[:, a : length - b + a], rows[:, b:]
        number = (first * 32 + second) * 32 + third
        if len(other):
            x, y, z = first[other], second[other], third[other]
            mixed = _PLAIN + ((x * 7919 + y) % 65521 * 7919 + z) % (_NUMBERS - _PLAIN)
            number[other] = np.where((x > _LATIN) | (y > _LATIN) | (z > _LATIN), mixed, number[other])
        found.append(np.where(third > 0, number, 0).astype(np.uint16))
        spans.append(np.full(number.shape[1], b, dtype=np.uint8))
    return np.concatenate(found, axis=1), np.concatenate(spans)


def own_kernel(numbers: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The kernel of each piece with itself: the squared sums of equal subsequences' weights.

    Subsequences are put in order with their spans; sums of equal ones are differences of running
    sums."""
    ordered = np.sort(numbers.astype(np.uint32) << 3 | spans, axis=1)
    n, w = ordered >> 3, _WEIGHTS[ordered & 7]
    w[n == 0] = 0
    sums = np.cumsum(w, axis=1)
    last = np.ones(n.shape, dtype=bool)
    np.not_equal(n[:, 1:], n[:, :-1], out=last[:, :-1])
    before = np.maximum.accumulate(np.where(last, sums, 0), axis=1)
    total = np.where(last, sums, 0)
    total[:, 1:] -= np.where(last[:, 1:], before[:, :-1], 0)
    return np.einsum("ij,ij->i", total, total)


class Kernel:
    """Normalised kernel values of units with fixed landmarks."""

    def __init__(self, landmarks: list[str]) -> None:
        rows, owner = coded(landmarks)
        if len(rows) > len(landmarks):
            raise ValueError(f"a landmark has {LENGTH - 1} letters at most")
        numbers, spans = subsequences(rows)
        table = np.zeros((_NUMBERS, len(landmarks)), dtype=np.float32)
        np.add.at(table, (numbers, owner[:, None]), _WEIGHTS[spans])
        table[0] = 0
        self.table = table / np.maximum(np.sqrt((table**2).sum(axis=0)), 1e-9)
        self.known = (table > 0).any(axis=1)

    def values(self, units: list[str]) -> np.ndarray:
        """One row per unit: the largest value over its pieces, and its head if it is long."""
        out = self._values(units)
        long = [i for i, u in enumerate(units) if len(u) > HEAD + 1]
        heads = [(i, b[:HEAD]) for i in long if len(b := bare(units[i])) > HEAD + 1]
        if heads:
            at = np.array([i for i, _ in heads])
            known = {h: k for k, h in enumerate(dict.fromkeys(h for _, h in heads))}
            out[at] = np.maximum(out[at], self._values(list(known))[[known[h] for _, h in heads]])
        return out**POWER

    def _values(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), self.table.shape[1]), dtype=np.float32)
        for at in range(0, len(units), 2000):
            rows, owner = coded(units[at : at + 2000])
            part = np.zeros((len(rows), out.shape[1]), dtype=np.float32)
            short = rows[:, HEAD + 1] == 0  # those need no look at places that they don't have
            part[short], part[~short] = self._of_pieces(rows[short, : HEAD + 1]), self._of_pieces(rows[~short])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[at : at + len(starts)] = part if len(starts) == len(part) else np.maximum.reduceat(part, starts, axis=0)
        return out

    def _of_pieces(self, rows: np.ndarray) -> np.ndarray:
        numbers, spans = subsequences(rows)
        out = np.zeros((len(rows), self.table.shape[1]), dtype=np.float32)
        piece, place = np.nonzero(self.known[numbers])  # most subsequences are in no landmark
        if len(piece):
            terms = self.table[numbers[piece, place]] * _WEIGHTS[spans[place]][:, None]
            starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            told = piece[starts]
            out[told] = np.add.reduceat(terms, starts, axis=0)
            out[told] /= np.sqrt(np.maximum(own_kernel(numbers[told], spans), 1e-9))[:, None].astype(np.float32)
        return out


def bare(unit: str) -> str:
    """The letters of a unit."""
    return _MARKS.sub("", unit)


def units_of(text: str | None) -> list[str]:
    """Lower-case words without commas and full stops, and letters spelled out one by one put
    together."""
    words = (text or "").lower().replace(",", "").replace(".", "").split()
    single = [i for i, w in enumerate(words) if len(w) == 1]
    run: list[str] = []
    for k, i in enumerate(single):
        run.append(words[i])
        if k + 1 == len(single) or single[k + 1] != i + 1:
            if len(run) >= 3:
                words.append("".join(run))
            run = []
    return words


def sentences(text: str | None) -> list[list[str]]:
    """The units of each sentence, PART at most in a row."""
    every = (units_of(x) for x in _SENTENCE.split(text or ""))
    return [x[at : at + PART] for x in every for at in range(0, len(x), PART)]


class Features:
    """Sentences by landmarks: the best kernel value of a sentence's units with each landmark, in
    steps of 1/255. Values of units are kept in a memo of `most` of them, which changes nothing."""

    def __init__(self, kernel: Kernel, model: Model | None = None, most: int = 150_000) -> None:
        self.kernel, self.model, self.most = kernel, model, most
        self.number: dict[str, int] = {}
        self.table = np.zeros((1 << 14, kernel.table.shape[1]), dtype=np.uint8)
        self.told = np.zeros((len(self.table), len(TOLD)), dtype=np.uint8)

    def of(self, sentences: list[list[str]]) -> np.ndarray:
        return self.with_hits(sentences)[0]

    def with_hits(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The values, and how many units of each sentence have a margin of their own, by the model,
        above each of TOLD."""
        hits = np.zeros((len(sentences), len(TOLD)), dtype=np.int64)
        units = [u for s in sentences for u in s]
        known, kept = self.number, len(self.number)
        new = list(set(units).difference(known))
        if new:
            end = kept + len(new)
            if end > len(self.table):
                more = max(end, 2 * len(self.table)) - len(self.table)
                self.table, self.told = (np.concatenate([x, np.zeros((more, x.shape[1]), np.uint8)]) for x in (self.table, self.told))
            self.table[kept:end] = np.rint(self.kernel.values(new) * 255)
            if self.model:
                own = self.table[kept:end] @ (self.model.alpha / 255).astype(np.float32) - self.model.shift
                self.told[kept:end] = own[:, None] > TOLD
            known.update(zip(new, range(kept, end), strict=True))
        out = np.zeros((len(sentences), self.table.shape[1]), dtype=np.uint8)
        at = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
        owner = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
        for k in range(0, len(at), 1 << 15):
            part = owner[k : k + (1 << 15)]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            who = part[starts]
            mine = at[k : k + (1 << 15)]
            out[who] = np.maximum(out[who], np.maximum.reduceat(self.table[mine], starts, axis=0))
            hits[who] += np.add.reduceat(self.told[mine].astype(np.int64), starts, axis=0)
        for unit in new[max(0, self.most - kept) :]:  # what the memo has no room for
            del known[unit]
        if len(self.table) > 2 * self.most:
            self.table, self.told = self.table[: self.most].copy(), self.told[: self.most].copy()
        return out.astype(np.float32) / 255, hits


class Model:
    """A sentence's margin is its values with the landmarks times `alpha`, less `shift`."""

    def __init__(self, kernel: Kernel, alpha: np.ndarray, shift: float, curve: np.ndarray) -> None:
        self.kernel, self.alpha, self.shift, self.curve = kernel, alpha, shift, curve

    def margins(self, sentences: list[list[str]]) -> np.ndarray:
        return Features(self.kernel).of(sentences) @ self.alpha - self.shift


def nystroem(kernel: Kernel, landmarks: list[str]) -> np.ndarray:
    """The inverse root of the landmarks' own kernel matrix."""
    own = kernel.values(landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2 + 1e-6 * np.eye(len(own)))
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Linear SVM with squared hinge loss, by Newton steps over the rows inside the margin; the
    last weight is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    w, inside = np.zeros(x.shape[1]), np.ones(len(x), dtype=bool)
    for _ in range(steps):
        square, pull = ridge * np.eye(len(w)), np.zeros(len(w))
        for at in range(0, len(x), 8192):  # in parts, so that no copy of all rows is made
            mine = at + np.flatnonzero(inside[at : at + 8192])
            part = x[mine].astype(np.float64)
            square += (part * weight[mine][:, None]).T @ part
            pull += part.T @ (weight[mine] * y[mine])
        w = np.linalg.solve(square, pull)
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; the last weight is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(min(steps, 50)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        grad = x.T @ (p - y) + 1e-2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sketch(text: str, n: int = 4) -> list[int]:
    """The least hash of the text's 4-word runs under each of `n` mixings; near copies share one."""
    words = text.lower().split()
    runs = {" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
    hashes = np.array([zlib.crc32(r.encode("utf-8", "surrogatepass")) for r in runs], dtype=np.uint64)
    mixed = ((hashes[:, None] + np.uint64(1)) * np.array(_MIX[:n], dtype=np.uint64)) >> np.uint64(16)
    return [int(x & np.uint64(0x7FFFFFFFFFFF)) for x in mixed.min(axis=0)]


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and toxic of `sample` labelled documents at most, half of them toxic if there are so
    many: those with the least hash of their id. Of near copies one is left, as their chance words
    would look telling."""
    one = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    one = one.withColumn("h", F.xxhash64("doc_id"))
    picked = None
    for kind in (1, 0):
        part = one.filter(F.col("toxic") == kind).orderBy("h", "doc_id").limit(sample // 2).select("doc_id", "toxic")
        picked = part if picked is None else picked.unionByName(part)
    ids = F.broadcast(picked)  # `sample` rows at most
    source = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = materialize(source.join(ids, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = [sketch(t) for t in batch.column("text").to_pylist()]
            return pa.record_batch([batch.column("doc_id"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "keys"])

        return work

    seen: set[tuple[int, int]] = set()
    copies = []
    for r in sorted(per_batch(chosen.select("doc_id", "text"), "text", make, "doc_id long, keys array<long>").collect()):  # `sample` rows
        keys = set(enumerate(r["keys"]))
        if keys & seen:
            copies.append((r["doc_id"],))
        seen |= keys
    gone = docs.sparkSession.createDataFrame(copies, "doc_id long")
    return chosen.join(F.broadcast(gone), "doc_id", "left_anti")


def exact_svm(sentence: np.ndarray, unit: np.ndarray, y: np.ndarray, weight: np.ndarray, n_units: int, ridge: float, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The SVM over exact units: the weight of each, and the margin of each sentence. A row has the
    `unit` numbers that stand beside its `sentence` number; the last unit number is the intercept.
    Newton steps over the rows inside the margin, each by conjugate gradients."""
    times = lambda w: np.bincount(sentence, weights=w[unit], minlength=len(y)) + w[-1]

    def back(z: np.ndarray) -> np.ndarray:
        out = np.bincount(unit, weights=z[sentence], minlength=n_units + 1)
        out[-1] += z.sum()
        return out

    w = np.zeros(n_units + 1)
    for _ in range(steps):
        margin = times(w)
        inside = weight * (y * margin < 1)
        residual = ridge * w + back(inside * (margin - y))
        step, r = np.zeros_like(w), -residual
        d, size = r.copy(), r @ r
        for _ in range(25):
            if size < 1e-9:
                break
            curved = ridge * d + back(inside * times(d))
            a = size / (d @ curved)
            step += a * d
            r -= a * curved
            size, last = r @ r, size
            d = r + size / last * d
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w[:-1], times(w)


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights of rows that let both kinds count the same, one on average."""
    return np.where(y > 0, len(y) / 2 / max(1, (y > 0).sum()), len(y) / 2 / max(1, (y < 0).sum()))


def labelled_sentences(picked: DataFrame, most: int) -> DataFrame:
    """doc_id, nth, toxic, units and their number, of the sentences of the sample, about `most` of
    them, written; whole texts, of the toxic ones half of `most` or more if there are so many."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, places, kinds, units, sizes = [], [], [], [], []
            for doc_id, text, kind in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
                found = [(sorted({b for u in s if (b := bare(u))}), len(s)) for s in sentences(text)]
                found = [x for x in found if x[0]]
                ids += [doc_id] * len(found)
                places += range(len(found))
                kinds += [kind] * len(found)
                units += [x for x, _ in found]
                sizes += [n for _, n in found]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.int32()]
            return pa.record_batch([pa.array(x, t) for x, t in zip((ids, places, kinds, units, sizes), types, strict=True)], ["doc_id", "nth", "toxic", "units", "n"])

        return work

    found = materialize(per_batch(picked.select("doc_id", "text", "toxic"), "text", make, "doc_id long, nth int, toxic int, units array<string>, n int"))
    sizes = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = min(sizes.get(1, 0), max(most // 2, most - sizes.get(0, 0)))
    clean = min(sizes.get(0, 0), most - toxic)
    share = F.when(F.col("toxic") == 1, toxic / max(1, sizes.get(1, 0))).otherwise(clean / max(1, sizes.get(0, 0)))
    return materialize(found.filter(F.crc32(F.concat(F.lit("part "), "doc_id").cast("binary")) < share * 2.0**32))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SENTENCES) -> Model | float:
    """The model, or the share of toxic labels where there is only one kind of them."""
    picked = materialize(_sample(docs, labels, sample))
    sizes = {r["toxic"]: r["n"] for r in picked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return float(sizes.get(1, 0) > 0)
    share = sizes[1] / (sizes[0] + sizes[1])
    table = labelled_sentences(picked, most)
    rows = table.toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("nth", "ascending")])  # `most` sentences
    texts, y = rows.column("doc_id").to_numpy(), np.where(rows.column("toxic").to_numpy() == 1, 1.0, -1.0).astype(np.float32)
    if len(np.unique(y)) < 2:
        return share
    units = rows.column("units").combine_chunks()
    landmarks, margin = _landmarks(units, y, texts)
    if not landmarks:
        return share
    kernel = Kernel(landmarks)
    root = nystroem(kernel, landmarks).astype(np.float32)
    features = _mapped(table, kernel)
    starts = np.flatnonzero(np.r_[True, texts[1:] != texts[:-1]])
    ends = np.r_[starts[1:], len(texts)]
    bent: dict[int, np.ndarray] = {}

    def disguised(found: np.ndarray) -> np.ndarray:
        new = [i for i in found.tolist() if i not in bent]
        values = Features(kernel).of([altered(units[i].as_py(), i) for i in new])
        bent.update(zip(new, values, strict=True))
        return np.array([bent[i] for i in found.tolist()], dtype=np.float32).reshape(len(found), len(landmarks))

    def fit(mine: np.ndarray, margin: np.ndarray) -> Model | None:
        """The machine trained on some of the texts, from a first margin of all sentences."""
        toxic = [(a, b) for a, b in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True) if y[a] > 0]
        clean = np.flatnonzero((y < 0) & np.repeat(mine, ends - starts))
        if not toxic or not len(clean):
            return None
        quiet = clean[:: max(1, len(clean) // len(toxic))]
        for _ in range(ROUNDS):
            telling = np.array([a + int(margin[a:b].argmax()) for a, b in toxic])
            x = np.concatenate([features[telling], disguised(telling), features[clean], disguised(quiet)]) @ root
            kind = np.repeat(np.array([1.0, -1.0], np.float32), [2 * len(telling), len(clean) + len(quiet)])
            w = svm(x, kind, balanced(kind), RIDGE)
            model = Model(kernel, root @ w[:-1], -float(w[-1]), np.zeros(SEEN + 1))
            margin = features @ model.alpha - model.shift
        return model

    every = np.ones(len(starts), dtype=bool)
    model = fit(every, margin)
    part = np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in texts[starts].tolist()])
    others = [fit(part != k, margin) or model for k in range(FOLDS)]
    seen = _out_of_fold(table, others, dict(zip(texts[starts].tolist(), part.tolist(), strict=True)))
    seen = np.array([seen[i] for i in texts[starts].tolist()])
    model.curve = logistic(seen, (y[starts] > 0).astype(float))
    return model


def _landmarks(units: pa.ListArray, y: np.ndarray, texts: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Landmarks by the SVM over exact units and their beginnings, and its margin of each sentence.

    A unit stands for the weight that it has, times the toxic texts that it is in, times how much
    more of those hold it than of the clean ones: rare chance words have weight, but in few texts."""
    sentence, numbered = pc.list_parent_indices(units).to_numpy(), units.flatten().dictionary_encode()
    words, unit = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
    number = {w: i for i, w in enumerate(words)}
    kinds = [unit]
    for k in BEGINNINGS:  # a beginning has the number of the unit that it is, or a new one
        own = np.array([number.setdefault(w[:k], len(number)) if len(w) > k else -1 for w in words], dtype=np.int64)
        kinds.append(own[unit])
    pair = np.concatenate([sentence[x >= 0] * len(number) + x[x >= 0] for x in kinds])
    sentence, unit = np.divmod(np.unique(pair), len(number))
    names = np.array(list(number), dtype=object)
    _, text = np.unique(texts, return_inverse=True)
    toxic = np.zeros(text.max() + 1, dtype=bool)
    toxic[text[y > 0]] = True
    owner, what = np.divmod(np.unique(text[sentence] * len(names) + unit), len(names))
    among = [np.bincount(what[toxic[owner] == kind], minlength=len(names)) for kind in (True, False)]
    usable = (among[0] + among[1] >= MIN_TEXTS) & np.array([2 < len(x) < LENGTH for x in names])
    keep = usable[unit]
    value, margin = exact_svm(sentence[keep], unit[keep], y, balanced(y), len(names), UNIT_RIDGE)
    shares = [n / max(1, (toxic == kind).sum()) for n, kind in zip(among, (True, False), strict=True)]
    value = np.where(usable, value * among[0] * np.maximum(shares[0] - shares[1], 0) / np.maximum(shares[0] + shares[1], 1e-9), 0.0) + np.where(usable & (value < 0), value, 0.0)
    return choose_landmarks(names, value, among[1]), margin


def _mapped(table: DataFrame, kernel: Kernel) -> np.ndarray:
    """Values of the bounded sample's sentences with the landmarks, in order of doc_id and nth."""
    shared = table.sparkSession.sparkContext.broadcast(kernel)

    def run(batches):
        features = Features(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                values = features.of(part.column("units").to_pylist())
                yield pa.record_batch([part.column("doc_id"), part.column("nth"), pa.array([v.tobytes() for v in values], pa.binary())], ["doc_id", "nth", "x"])

    found = table.select("doc_id", "nth", "units").mapInArrow(run, "doc_id long, nth int, x binary").toArrow()
    order = np.lexsort((found.column("nth").to_numpy(), found.column("doc_id").to_numpy()))
    out = np.empty((len(order), kernel.table.shape[1]), dtype=np.float32)
    out[:] = np.array([np.frombuffer(x.as_buffer(), np.float32) for x in found.column("x")]).reshape(out.shape)[order]
    return out


def _out_of_fold(table: DataFrame, models: list[Model], part: dict[int, int]) -> dict[int, list[float]]:
    """What a score looks at, for each text of the bounded sample, by the machine of its part."""
    shared = table.sparkSession.sparkContext.broadcast((models, part))

    def run(batches):
        models, part = shared.value
        features = [Features(m.kernel, m) for m in models]
        for batch in batches:
            fold = np.array([part[i] for i in batch.column("doc_id").to_pylist()])
            margins, hits = np.zeros(len(fold)), np.zeros((len(fold), len(TOLD)), dtype=np.int64)
            units = batch.column("units").to_pylist()
            for k, model in enumerate(models):
                for mine in np.array_split(np.flatnonzero(fold == k), 1 + (fold == k).sum() // 2000):
                    values, hits[mine] = features[k].with_hits([units[i] for i in mine.tolist()])
                    margins[mine] = values @ model.alpha - model.shift
            yield pa.record_batch([batch.column("doc_id"), pa.array(margins), pa.array(hits.tolist(), pa.list_(pa.int64())), batch.column("n")], ["doc_id", "margin", "hits", "n"])

    found = table.select("doc_id", "units", "n").mapInArrow(run, "doc_id long, margin double, hits array<long>, n int").toPandas()
    out = {}
    for i, own in found.groupby("doc_id"):
        out[i] = evidence(own["margin"].to_numpy(), np.sum(own["hits"].tolist(), axis=0), int(own["n"].sum()), -models[part[i]].shift)
    return out


def choose_landmarks(names: np.ndarray, value: np.ndarray, often: np.ndarray, n: int = LANDMARKS) -> list[str]:
    """Landmarks stand for the units that are toxic (`value`, STANDING of the greatest one or more),
    and PLAIN_LANDMARKS are the commonest units that the SVM holds clean (below 0)."""
    order = np.argsort(-value, kind="stable")
    order = order[: 8 * n]
    telling = {names[i]: float(value[i]) for i in order.tolist() if value[i] > 0 and value[i] >= value[order[0]] * STANDING}
    if not telling:
        return []
    out = spread(telling, n - PLAIN_LANDMARKS)
    plain = np.argsort(-np.where(value < 0, often, 0), kind="stable")[:PLAIN_LANDMARKS]
    return out + sorted(names[i] for i in plain.tolist() if value[i] < 0)


def altered(units: list[str], seed: int) -> list[str]:
    """The units, those of five letters or more with a letter put in, as insults are disguised."""
    rng = np.random.default_rng(seed)
    out = []
    for u in units:
        at = int(rng.integers(1, max(2, len(u))))
        out.append(u[:at] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + u[at:] if len(u) >= 5 else u)
    return out


def evidence(margins: np.ndarray, hits: np.ndarray, n_units: int, floor: float) -> list[float]:
    """What a text's score looks at: its sentences' best margins, MARGINS of them (`floor` where it
    has fewer), and its telling units (`hits`, by each of TOLD) for each ten units, and the logarithm
    of that."""
    best = np.partition(margins, len(margins) - MARGINS)[-MARGINS:] if len(margins) > MARGINS else margins
    best = sorted([*(max(m, floor) for m in best.tolist()), *[floor] * (MARGINS - len(best))], reverse=True)
    return [*best, *(10 * hits / (n_units + 20)).tolist(), *np.log((hits + 0.5) / (n_units + 50)).tolist()]


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if isinstance(model, float):
        return source.select("doc_id", F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        features = Features(model.kernel, model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, sizes, units = [], [], []
            for text in batch.column("text").to_pylist():
                own = sentences(text)
                found += own
                sizes.append(len(own))
                units.append(sum(map(len, own)))
            values, hits = features.with_hits(found)
            margins = values @ model.alpha - model.shift
            ends = np.cumsum(sizes)
            seen = np.array([evidence(margins[b - n : b], hits[b - n : b].sum(axis=0), k, -model.shift) for b, n, k in zip(ends.tolist(), sizes, units, strict=True)]).reshape(-1, SEEN)
            z = seen @ model.curve[:-1] + model.curve[-1]
            return pa.record_batch([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "score"])

        return work

    return per_batch(source, "text", make, "doc_id long, score double")


def spread(units: dict[str, float], n: int) -> list[str]:
    """`n` units that stand for all of them: each is the one that raises the weighted kernel value
    between the units and their nearest landmark the most."""
    names, weight = list(units), np.array(list(units.values()))
    like = Kernel(names).values(names)
    nearest, out = np.zeros(len(names), dtype=np.float32), []
    for _ in range(min(n, len(names))):
        k = int((np.maximum(like - nearest[:, None], 0) * weight[:, None]).sum(axis=0).argmax())
        out.append(k)
        nearest = np.maximum(nearest, like[:, k])
    return [names[k] for k in dict.fromkeys(out)]


def classify(docs: DataFrame, labels: DataFrame, rest: int = 0, modulus: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32(doc_id) mod `modulus` is `rest` are
    held out of training."""
    held = crc_rest("doc_id", modulus) == rest
    model = train(docs.filter(~held), labels.filter(~held), sample)
    found = score(docs, model)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
