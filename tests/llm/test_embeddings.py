import numpy as np
import pytest

import palimpsest.llm.embeddings as embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, k1 string"


def brute(rows, similarity):
    """{row: (n_links, component)} by comparing all rows."""
    ok = [
        i
        for i, (key, v, label, _) in enumerate(rows)
        if key is not None
        and label is not None
        and v
        and all(c is not None and np.isfinite(c) for c in v)
        and any(c != 0 for c in v)
    ]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = (np.array(rows[x][1], dtype=np.float32).astype(float) for x in (i, j))
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= similarity:
                    links[i].add(j)
    out = []
    for i, (key, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        out.append((key, len(links[i]), None if key is None else min(rows[j][0] for j in seen)))
    return sorted(out, key=str)


def planted(seed, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 1, 1, 2):
        for _ in range(12):
            centre = rng.standard_normal(dims)
            for _ in range(rng.integers(1, 9)):
                v = centre + rng.standard_normal(dims) * rng.choice([0, 0.05, 0.15, 0.27, 0.4])
                rows.append((len(rows), (v * rng.choice([1, 1, 3])).astype(np.float32).tolist(), label, "x"))
    return rows


@pytest.mark.parametrize("cell", [4096, 16])
def test_links_match_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    rows = planted(cell)
    got = embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("chunk,kind", [(10_000, "float"), (40, "float"), (40, "double")])
def test_vectors_are_sent_once_a_chunk_of_their_label(spark, monkeypatch, chunk, kind):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    monkeypatch.setattr(embeddings, "CELL", 16)
    rows = planted(7)
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", f"cast(embedding as array<{kind}>) as embedding", "label", "k1")
    got = embeddings.near_vectors(vectors).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows, 0.93)
    classes = vectors.selectExpr("vec_id as k1", "label as k2", "vec_id as id", "1L as copies", "cast(label as string) as label", "embedding as v")
    sizes = [sum(r[2] == label for r in rows) for label in (0, 1, 2)]
    assert embeddings._tiles(classes).count() == sum(n * -(-n // chunk) for n in sizes)


def test_magnitudes_do_not_count(spark):
    x = embeddings.unit([[1e-200, 0.0], [2e200, 1e200], [3.0, 4.0]])
    assert np.allclose(x, [[1, 0], [2 / 5**0.5, 1 / 5**0.5], [0.6, 0.8]])
    rows = [(1, [1e-200, 0.0], 1), (2, [2e-200, 0.0], 1), (3, [1e200, 1e-200], 1), (4, [0.0, 1e-310], 1)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_cells_hold_all_near_rows():
    rng = np.random.default_rng(6)
    y = rng.standard_normal((400, 3)) / 4
    planes, reach = np.sort(y, axis=0).T, 0.12
    for depth in (1, 4, 7):
        at = embeddings._cells(planes, depth, y, reach)
        homes = {r: c for r, c, home in at if home}
        held = {}
        for r, c, _ in at:
            held.setdefault(c, set()).add(r)
        assert len(homes) == len(y) and len(at) == len({(r, c) for r, c, _ in at})
        for i in range(len(y)):
            near = np.flatnonzero(((y - y[i]) ** 2).sum(1) <= reach**2)
            assert set(near.tolist()) <= held[homes[i]]


def test_odd_rows(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [
        (1, one, 1, None),
        (1, one, 1, "repeated row"),
        (2, one, None, None),
        (3, one, None, None),
        (4, None, 1, None),
        (5, [0.0, 0.0, 0.0], 1, None),
        (6, [0.0, 0.0, 0.0], 1, None),
        (7, [None, 1.0, 0.0], 1, None),
        (8, [float("nan"), 1.0, 0.0], 1, None),
        (9, [float("inf"), 1.0, 0.0], 1, None),
        (10, [], 1, None),
        (11, [1.0, 0.0], 1, None),
        (12, [2.0, 0.0, 0.0], 1, None),
        (13, two, 1, None),
        (14, one, 2, None),
        (None, one, 1, None),
    ]
    got = embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows, 0.93)
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
