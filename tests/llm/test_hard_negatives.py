"""Hard negatives against plain sorting of all scores, with bounds that must hold for each pair."""

import numpy as np

from matricula.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, home string"


def brute(rows):
    usable = {}
    for i, x, label, *_ in rows:
        if i is None or label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        label = int(np.fmod(label + 1, 10)) if i % 7 == 0 else label
        row = (label, [int(np.floor(256 * float(np.float32(v)))) for v in x])
        usable[i] = min(usable.get(i, row), row)
    score = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = set()
    for a, (label, x) in usable.items():
        if a % 100:
            continue
        ranked = sorted((-score(x, y), i, other) for i, (other, y) in usable.items() if i != a)
        for s, p, _ in [r for r in ranked if r[2] == label][:5]:
            found = [(i, -t) for t, i, other in ranked if other != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out |= {(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(found)}
    return out


def mined(spark, rows, **more):
    found = H.mine(spark.createDataFrame(rows, SCHEMA), **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(i, (centres[i % 6] + rng.normal(size=dims) * (0.1 + i % 3)).astype(np.float32).tolist(), int(rng.integers(0, 4)), "p") for i in range(n)]


def test_clusters_in_small_blocks_and_batches(spark):
    rows = clustered(1500, 12, 1)
    want = brute(rows)
    assert want and mined(spark, rows, references=5, block=64, batch=4) == want


def test_copies_and_ties(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, same, i % 2, "p") for i in range(400)] + [(1000 + i, [0.4, -0.2, 0.1], i % 3, "p") for i in range(300)]
    want = brute(rows)
    assert want and mined(spark, rows, block=50) == want


def test_odd_rows(spark):
    rows = clustered(300, 5, 2)
    rows += [(None, [1.0] * 5, 1, "p"), (7000, None, 1, "p"), (7100, [1.0, None, 0.0, 0.0, 0.0], 1, "p"), (7200, [float("nan")] * 5, 1, "p"), (7300, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1, None)]
    rows += [(7400, [1.0, 2.0, 0.5, 0.0, 0.0], None, "p"), (8000, [0.0] * 5, 2, "p"), (8001, [], 2, "p"), (8002, [1.0, 1.0], 2, "p"), (9000, [-1.0] * 5, 77, "p"), (0, rows[0][1], 9, "p"), (100, rows[100][1], rows[100][2], "p")]
    assert mined(spark, rows, block=16) == brute(rows)


def test_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=3) * 3e5).astype(np.float32).tolist(), i % 2, "p") for i in range(260)]
    assert mined(spark, rows) == brute(rows)


def test_empty(spark):
    assert mined(spark, []) == set()
    assert mined(spark, [(1, [1.0], 1, "p"), (2, [1.0], 2, "p")]) == set()


def test_bounds_hold(spark):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(500, 8)) * rng.integers(1, 400, size=(500, 1))).astype(np.int64)
    references = H.fit_references(x, 6)
    norms = H.norms_of(x)
    angles = H.angles_to(x, norms, references).astype(np.float64)
    anchors = H.Anchors(np.arange(40), np.zeros(40, np.int32), x[:40], references)
    scores = anchors.scores(np.arange(40), x)
    for order in np.array_split(np.argsort(angles[:, 0]), 20):
        lower, upper = anchors.bounds(angles[order].min(axis=0), angles[order].max(axis=0), norms[order])
        assert (lower[:, None] <= scores[:, order]).all() and (scores[:, order] <= upper[:, None]).all()
        for i in range(40):
            wanted = np.array([float(np.median(scores[i, order]))])
            a, b = anchors.windows(np.array([i]), wanted, 0, angles[order, 0], norms[order])
            outside = np.r_[scores[i, order[:a]], scores[i, order[b:]]]
            assert (outside < wanted[0]).all()
    assert (np.diff(x[:40] @ x.T - scores) == 0).all()
