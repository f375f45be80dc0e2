"""Hard-negative mining by angular triangle filtering.

Vectors become integers, floor(256 * x). Each row stores its angles to a few reference directions
(centres of a bounded sample). For an anchor a, a row x and a reference r, the angles between them
satisfy |(a,r) - (x,r)| <= (a,x) <= min((a,r) + (x,r), 2 pi - (a,r) - (x,r)); the cosines of these
limits times both norms bound the score, widened by more than all rounding. Rows lie in blocks of
one nearest reference in the order of their angle to it, and a block keeps the least and the
greatest angle to each reference: blocks whose bounds miss the scores that an anchor still wants are
passed over, within the others only the window of fitting angles is scored, as integers.

Anchors are a stated query set; they go through all blocks in batches of bounded size, twice: once
for their nearest rows of the same label, once for the rows of other labels whose scores lie in the
windows that those positives open. What a task has found raises the scores that it still wants. Each
task yields the few best rows of each anchor, which are ranked after a shuffle.

Defined results: rows without a vec_id or label, without a vector, or with a null or non-finite
component take no part. Of rows that repeat a vec_id the one with the least label and components
counts. A shorter vector counts as zero in what it lacks. An anchor without other rows of its label
gives no row, nor does a positive whose window (empty below zero) holds no negative. A component
beyond 64 bits is an error. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, new_path, release

#: Anchors are the rows whose vec_id this divides; what each keeps; the window in hundredths.
EVERY, POSITIVES, NEGATIVES, LOW, WHOLE = 100, 5, 5, 80, 100
#: Reference directions, the rows that they are fitted on, rows of a block, anchors of a batch.
REFERENCES, SAMPLE, BLOCK, BATCH = 16, 2048, 2048, 2048
#: Radians and scores by which bounds are widened: angles are stored in single precision.
SLACK, ROUND = 1e-5, 1.0

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_BLOCK = "ids array<long>, labels array<int>, x array<long>, norms array<double>, angles array<float>"
_POSITIVE = "anchor_id long, positive_id long, positive_score long"
_NEGATIVE = "anchor_id long, positive_score long, negative_id long, negative_score long"


def prepared(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and integer components of the rows that take part, one for each vec_id."""
    clean = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: x.cast("double") * 256
    whole = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x))).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    usable = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & clean)
    rows = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(moved.cast("int").alias("label"), whole.alias("x")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def matrix(rows: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    out = np.zeros((len(rows), width), dtype=np.int64)
    sizes = rows.value_lengths().to_numpy()
    out[np.repeat(np.arange(len(rows)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = rows.flatten().to_numpy()
    return out


def norms_of(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x.astype(np.float64)).sum(axis=1))


def angles_to(x: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of rows with unit directions; a zero row counts as at right angles with all."""
    cosine = x.astype(np.float64) @ references.T / np.maximum(norms, 1e-300)[:, None]
    return np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def fit_references(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """`n` unit directions at most: centres of the rows' directions, started far from each other."""
    norms = norms_of(x)
    x = x[norms > 0] / norms[norms > 0][:, None]
    if not len(x):
        return np.eye(1, max(1, x.shape[1]))
    chosen = [x[0]]
    nearest = x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(x[int(nearest.argmin())])
        nearest = np.maximum(nearest, x @ chosen[-1])
    centres = np.array(chosen)
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.array([x[own == k].sum(axis=0) for k in range(len(centres))])
        size = np.sqrt(np.square(sums).sum(axis=1))
        centres[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9][:, None]
    return centres


def blocks(rows: DataFrame, references: np.ndarray, block: int = BLOCK) -> DataFrame:
    """All rows in blocks of one nearest reference, in the order of their angle to it, with their
    norms and their angles to all references."""
    width = references.shape[1]

    def homes(batches):
        for batch in batches:
            x = matrix(batch.column("x"), width)
            angles = angles_to(x, norms_of(x), references)
            home = angles.argmin(axis=1).astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(home), pa.array(angles[np.arange(len(home)), home])], ["vec_id", "label", "x", "home", "angle"])

    def packed(batches):
        for batch in batches:
            home, ids = batch.column("home").to_numpy(), batch.column("vec_id")
            edges = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True]).tolist()
            out = []
            for a, b in zip(edges, edges[1:], strict=False):
                for at in range(a, b, block):
                    part = slice(at, min(at + block, b))
                    x = matrix(batch.column("x").slice(at, part.stop - at), width)
                    norms = norms_of(x)
                    out.append((ids[part.start : part.stop].to_numpy(), batch.column("label").to_numpy()[part], x.ravel(), norms, angles_to(x, norms, references).ravel()))
            types = [pa.list_(t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float32())]
            yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], ["ids", "labels", "x", "norms", "angles"])

    placed = rows.select("vec_id", "label", "x").mapInArrow(homes, "vec_id long, label int, x array<long>, home int, angle float")
    return placed.repartitionByRange("home", "angle", "vec_id").sortWithinPartitions("home", "angle", "vec_id").mapInArrow(packed, _BLOCK)


class Anchors:
    """A batch of anchors: ids, labels, components, norms, angles to the references."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, references: np.ndarray) -> None:
        self.ids, self.labels, self.x, self.references = ids, labels, x, references
        self.norms = norms_of(x)
        self.angles = angles_to(x, self.norms, references).astype(np.float64)
        self.top = max(1, int(np.abs(x).max(initial=0)))

    def bounds(self, low: np.ndarray, high: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores that no row falls below, and that none exceeds, whose angle to each reference is
        from `low` to `high` and whose norm is among `norms`."""
        least = np.maximum(low - self.angles, self.angles - high).max(axis=1)
        most = np.minimum(self.angles + high, 2 * np.pi - self.angles - low).min(axis=1)
        upper, lower = np.cos(np.clip(least - SLACK, 0, np.pi)), np.cos(np.clip(most + SLACK, 0, np.pi))
        small, large = norms.min(), norms.max()
        upper = self.norms * upper * np.where(upper >= 0, large, small)
        lower = self.norms * lower * np.where(lower >= 0, small, large)
        return lower - ROUND - 1e-9 * np.abs(lower), upper + ROUND + 1e-9 * np.abs(upper)

    def windows(self, who: np.ndarray, wanted: np.ndarray, home: int, angles: np.ndarray, norms: np.ndarray) -> tuple[int, int]:
        """The stretch of rows, ordered by their angle to the reference `home`, outside which none
        reaches the score that one of the anchors `who` wants."""
        size = self.norms[who] * np.where(wanted >= 0, norms.max(), norms.min())
        reach = np.arccos(np.clip(np.maximum(wanted - ROUND, -1e300) / np.maximum(size, 1e-300), -1, 1)) + SLACK
        own = self.angles[who, home]
        return int(np.searchsorted(angles, (own - reach).min(), "left")), int(np.searchsorted(angles, (own + reach).max(), "right"))

    def scores(self, who: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Integer inner products: in doubles where those are exact, else in Python's integers."""
        if self.top * max(1, int(np.abs(x).max(initial=0))) * max(1, x.shape[1]) < 1 << 53:
            return np.rint(self.x[who].astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        return np.array((self.x[who].astype(object) @ x.astype(object).T).tolist(), dtype=np.int64).reshape(len(who), len(x))


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The `n` highest scores with their ids; the smaller id first among equals."""
    if len(scores) > 8 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        scores, ids = scores[scores >= least], ids[scores >= least]
    order = np.lexsort((ids, -scores))[:n]
    return scores[order], ids[order]


def _each_block(batches, width: int):
    for batch in batches:
        for i in range(batch.num_rows):
            part = {c: batch.column(c)[i].values.to_numpy() for c in ("ids", "labels", "x", "norms", "angles")}
            n = len(part["ids"])
            yield part["ids"], part["labels"], part["x"].reshape(n, width), part["norms"], part["angles"].reshape(n, -1).astype(np.float64)
        release()


def positives(table: DataFrame, anchors: Anchors, floor: np.ndarray, n: int = POSITIVES) -> DataFrame:
    """The first `n` other rows of each anchor's label, by every task; `floor` is a score that each
    anchor's n-th best reaches surely."""
    shared = table.sparkSession.sparkContext.broadcast((anchors, floor))

    def run(batches):
        anchors, floor = shared.value
        wanted = floor.copy()
        found = {}
        nothing = np.zeros(0, np.int64)
        for ids, labels, x, norms, angles in _each_block(batches, anchors.x.shape[1]):
            _, upper = anchors.bounds(angles.min(axis=0), angles.max(axis=0), norms)
            home = int(angles[0].argmin())
            for label in np.intersect1d(labels, anchors.labels).tolist():
                who = np.flatnonzero((anchors.labels == label) & (upper >= wanted))
                if not len(who):
                    continue
                rows = np.flatnonzero(labels == label)
                a, b = anchors.windows(who, wanted[who], home, angles[rows, home], norms[rows])
                rows = rows[a:b]
                if not len(rows):
                    continue
                own = ids[rows]
                for i, scores in zip(who.tolist(), anchors.scores(who, x[rows]), strict=True):
                    good = (scores >= wanted[i]) & (own != anchors.ids[i])
                    if good.any():
                        old = found.get(i, (nothing, nothing))
                        found[i] = new = _best(np.r_[old[0], scores[good]], np.r_[old[1], own[good]], n)
                        if len(new[0]) == n:
                            wanted[i] = max(wanted[i], new[0][-1])
        who = [i for i, (s, _) in found.items() for _ in s]
        told = [np.concatenate([f[k] for f in found.values()]) if found else nothing for k in (0, 1)]
        yield pa.record_batch([pa.array(anchors.ids[np.array(who, np.int64)]), pa.array(told[1]), pa.array(told[0])], ["anchor_id", "positive_id", "positive_score"])

    return table.mapInArrow(run, _POSITIVE)


def negatives(table: DataFrame, anchors: Anchors, asked: list[np.ndarray], n: int = NEGATIVES) -> DataFrame:
    """For each anchor and each of its `asked` positive scores the first `n` rows of other labels
    with LOW * asked <= WHOLE * score <= WHOLE * asked, by every task."""
    shared = table.sparkSession.sparkContext.broadcast((anchors, asked))

    def run(batches):
        anchors, asked = shared.value
        none = np.iinfo(np.int64).max
        lows = [[-(-LOW * int(p) // WHOLE) for p in each] for each in asked]
        wanted = np.array([min(x, default=none) for x in lows], dtype=np.float64)
        most = np.array([max((int(p) for p in each), default=-none) for each in asked], dtype=np.float64)
        found = {}
        nothing = np.zeros(0, np.int64)
        for ids, labels, x, norms, angles in _each_block(batches, anchors.x.shape[1]):
            lower, upper = anchors.bounds(angles.min(axis=0), angles.max(axis=0), norms)
            who = np.flatnonzero((upper >= wanted) & (lower <= most))
            if not len(who):
                continue
            home = int(angles[0].argmin())
            a, b = anchors.windows(who, wanted[who], home, angles[:, home], norms)
            if a >= b:
                continue
            ids, labels = ids[a:b], labels[a:b]
            for i, scores in zip(who.tolist(), anchors.scores(who, x[a:b]), strict=True):
                good = (scores >= wanted[i]) & (scores <= most[i]) & (labels != anchors.labels[i])
                if not good.any():
                    continue
                scores, own = scores[good], ids[good]
                for k, p in enumerate(asked[i].tolist()):
                    fit = (scores >= lows[i][k]) & (scores <= p)
                    if fit.any():
                        old = found.get((i, p), (nothing, nothing))
                        found[i, p] = new = _best(np.r_[old[0], scores[fit]], np.r_[old[1], own[fit]], n)
                        if len(new[0]) == n:
                            lows[i][k] = max(lows[i][k], int(new[0][-1]))
                wanted[i] = min(lows[i])
        who = [(i, p) for (i, p), (s, _) in found.items() for _ in s]
        told = [np.concatenate([f[k] for f in found.values()]) if found else nothing for k in (0, 1)]
        at, scores = (np.array([x[k] for x in who], np.int64) for k in (0, 1))
        yield pa.record_batch([pa.array(anchors.ids[at]), pa.array(scores), pa.array(told[1]), pa.array(told[0])], ["anchor_id", "positive_score", "negative_id", "negative_score"])

    return table.mapInArrow(run, _NEGATIVE)


def _first(rows: DataFrame, keys: list[str], score: str, id_: str, n: int) -> DataFrame:
    """The first `n` rows of each key, with their rank."""
    order = W.partitionBy(*keys).orderBy(F.col(score).desc(), id_)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(embeddings: DataFrame, every: int = EVERY, references: int = REFERENCES, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = embeddings.sparkSession
    rows = materialize(prepared(embeddings))
    width = rows.agg(F.max(F.size("x"))).first()[0]
    path = new_path(spark, "negatives-")
    spark.createDataFrame([], RESULT).write.parquet(path)
    if width is not None:
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().combine_chunks()
        sampled = matrix(sample.column("x").combine_chunks(), width)
        directions = fit_references(sampled, references)
        table = materialize(blocks(rows, directions, block))
        asking = rows.filter(F.col("vec_id") % every == 0)
        parts = -(-asking.count() // batch)
        asking = materialize(asking.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, parts)))).repartitionByRange("part"))
        sample_ids, sample_labels = sample.column("vec_id").to_numpy(), sample.column("label").to_numpy()
        for part in range(parts):
            some = asking.filter(F.col("part") == part).toArrow().combine_chunks()  # about `batch` rows
            if not some.num_rows:
                continue
            anchors = Anchors(some.column("vec_id").to_numpy(), some.column("label").to_numpy(), matrix(some.column("x").combine_chunks(), width), directions)
            floor = sure_floor(anchors, sample_ids, sample_labels, sampled)
            near = _first(positives(table, anchors, floor), ["anchor_id"], "positive_score", "positive_id", POSITIVES).drop("rank")
            known = near.toArrow()  # POSITIVES for each anchor of the batch at most
            near = spark.createDataFrame(known) if known.num_rows else None
            if near is None:
                continue
            score = known.column("positive_score").to_numpy()
            at = np.argsort(anchors.ids)[np.searchsorted(np.sort(anchors.ids), known.column("anchor_id").to_numpy())]
            asked = [np.unique(score[(at == i) & (score >= 0)]) for i in range(len(anchors.ids))]
            far = _first(negatives(table, anchors, asked), ["anchor_id", "positive_score"], "negative_score", "negative_id", NEGATIVES)
            far.join(F.broadcast(near), ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)


def sure_floor(anchors: Anchors, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, n: int = POSITIVES) -> np.ndarray:
    """The n-th best score of each anchor among the sampled rows of its label, which its n-th best
    among all rows reaches; minus infinity where there are fewer."""
    out = np.full(len(anchors.ids), -np.inf)
    for label in np.unique(anchors.labels).tolist():
        who, rows = np.flatnonzero(anchors.labels == label), np.flatnonzero(labels == label)
        if not len(rows):
            continue
        scores = anchors.scores(who, x[rows]).astype(np.float64)
        scores[ids[rows][None, :] == anchors.ids[who][:, None]] = -np.inf
        if scores.shape[1] >= n:
            out[who] = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
    return out
