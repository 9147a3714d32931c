import hashlib
import math
import random

import numpy as np
import pytest

from palimpsest.llm.clustering import cluster_vectors, nearest


def model(rows, dims, scale, count, rounds):
    kept = []
    for key, x in rows:
        if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x):
            kept.append((key, [math.floor(scale * v) for v in x]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        near = assign()
        for k in range(len(centroids)):
            own = [x for (_, x), (_, c) in zip(kept, near, strict=True) if c == k]
            if own:
                centroids[k] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    near = assign()
    sums = {}
    for d, k in near:
        sums[k] = sums.get(k, 0) + d
    return [
        (key, k, d, sums[k], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest())
        for (key, _), (d, k) in zip(kept, near, strict=True)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_against_every_centroid(spark, seed):
    rng = random.Random(seed)
    # Few distinct values, so that ties and repeated vectors are common.
    spread = [0.02, 0.3, 40.0][seed]
    rows = [(i, [round(rng.gauss(0, spread), 1 + seed) for _ in range(6)]) for i in range(400)]
    rows += [(rng.randrange(400), list(rng.choice(rows)[1])) for _ in range(150)]
    rows += [(None, [0.0] * 6), (7, None), (8, []), (9, [1.0] * 5), (10, [1.0] * 7), (11, [None] + [1.0] * 5)]
    rows += [(12, [float("nan")] * 6), (13, [float("inf")] * 6), (14, [-float("inf")] + [0.0] * 5), (15, [0.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "2 as distance")
    got = cluster_vectors(frame.repartition(5), dims=6, count=16).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, model(rows, 6, 64, 16, 3)))


def test_few_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cluster_vectors(empty).count() == 0
    rows = [(i, [0.5 * i] * 64) for i in range(5)]
    got = cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == sorted(model(rows, 64, 64, 16, 3))


@pytest.mark.parametrize("spread", [1, 3, 1000, 1 << 26])
def test_nearest_with_ties_at_the_bounds(spread):
    rng = np.random.default_rng(spread)
    x, c = rng.integers(-spread, spread + 1, (3000, 4)), rng.integers(-spread, spread + 1, (50, 4))
    c[10:20] = c[:10]
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    number, distance = nearest(x, c)
    assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
