import random

import numpy as np
import pytest

from palimpsest.llm.common import components, cut, shared_dir, unite


def model(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "odd"])
def test_components(spark, shape):
    rng = random.Random(1)
    ids = rng.sample(range(-500, 10_000), 400)
    edges = {
        "chain": list(zip(ids, ids[1:], strict=False)),
        "star": [(ids[0], x) for x in ids[1:]],
        "random": [(rng.choice(ids), rng.choice(ids)) for _ in range(350)],
        "odd": [(1, 1), (None, 2), (2, 3), (3, 2), (2, 3)],
    }[shape]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == model(edges)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unite():
    rng = np.random.default_rng(2)
    root = np.arange(500)
    pairs = rng.integers(0, 500, (2, 300))
    unite(root, pairs[0, :150], pairs[1, :150])
    unite(root, pairs[0, 150:], pairs[1, 150:])
    want = model([tuple(map(int, p)) for p in pairs.T])
    assert [int(x) for x in root] == [want.get(i, i) for i in range(500)]


def test_cut_keeps_rows_and_settings(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    frame = spark.range(100).groupBy("id").count()
    assert cut(frame, "test").count() == 100
    assert spark.conf.get(key, None) == before
    assert shared_dir(spark)
