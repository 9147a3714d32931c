"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import components, cut, table, unite

SIMILARITY = 0.93
#: Blocks that the rotated vectors are split into.
BLOCKS = 8
#: Vectors of one label that a task holds for each side of a tile; a label of more is dealt to tiles of pairs of chunks.
CHUNK = 32768
#: Vectors of a tile beyond which the cells of its blocks are halved.
CELL = 1024
#: Added to squared distances against rounding; every link is verified by its cosine.
SLACK = 1e-9
SINGLE = 1e-5


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation of ``dims`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(20240229 + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks_of(dims: int) -> list[tuple[int, int]]:
    """Bounds of the blocks of a rotated vector, of nearly equal widths."""
    n = min(BLOCKS, dims)
    edges = [i * dims // n for i in range(n + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def budgets(dims: int, similarity: float) -> np.ndarray:
    """Each block's share of the squared distance 2 - 2 cos, by its width: a pair within the whole distance is within its
    share in some block."""
    return np.array([(2 - 2 * similarity) * (b - a) / dims for a, b in blocks_of(dims)]) + SLACK


def unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _cells(planes: np.ndarray, depth: int, y: np.ndarray, reach: float) -> np.recarray:
    """(row, cell, home) of the cells of one block that hold a row or lie within ``reach`` of it. Halving i is by
    coordinate i modulo the width, at that coordinate's quantiles. ``gap`` is a row's distance from its cell's box by
    coordinate; a cell is dropped as soon as all coordinates together are beyond the reach."""
    rows, cells, home = np.arange(len(y)), np.zeros(len(y), np.int64), np.ones(len(y), bool)
    width = y.shape[1]
    gap = np.zeros((len(y), width))
    for level in range(depth):
        d = level % width
        ways = 1 << (level // width)
        # Each pass over a coordinate halves its intervals: the plane is the quantile in the middle of the interval.
        so_far = np.zeros(len(rows), np.int64)
        for i in range(level // width):
            so_far = so_far * 2 + ((cells >> (level - 1 - (i * width + d))) & 1)
        q = (2 * so_far + 1) / (2 * ways)
        at = planes[d][np.minimum((q * planes.shape[1]).astype(int), planes.shape[1] - 1)]
        value = y[rows, d]
        own = value >= at
        apart = np.abs(value - at)
        over = np.where(own, apart, gap[:, d]), np.where(own, gap[:, d], apart)  # of the lower and the upper half
        other = (gap * gap).sum(1) - gap[:, d] ** 2
        low, high = (other + o * o <= reach * reach for o in over)
        gaps = gap[low], gap[high]
        gaps[0][:, d], gaps[1][:, d] = over[0][low], over[1][high]
        r = np.r_[rows[low], rows[high]]
        c = np.r_[cells[low] * 2, cells[high] * 2 + 1]
        h = np.r_[home[low] & ~own[low], home[high] & own[high]]
        rows, cells, home, gap = r, c, h, np.concatenate(gaps)
    return np.rec.fromarrays([rows, cells, home], names="row,cell,home")


def _pairs(x: np.ndarray, home: np.ndarray, near: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (of a home row, of a near row) of the pairs of unit vectors ``x`` that reach the cosine, each once: in the
    first block that holds it within its budget. In a block a row's home cell has all rows within the block's reach."""
    dims = x.shape[1]
    turned, limits = x @ rotation(dims), budgets(dims, similarity)
    edges = [a for a, _ in blocks_of(dims)]
    depth = max(0, math.ceil(math.log2(len(x) / CELL)))
    for block, (a, b) in enumerate(blocks_of(dims)):
        part = turned[:, a:b]
        # Planes shape cells only, never the result.
        at = _cells(np.sort(part, axis=0).T, depth, part, math.sqrt(limits[block]) + SLACK)
        at = at[np.argsort(at.cell, kind="stable")]
        # Single precision finds candidates, with slack for its rounding (at most 1e-6 for parts of unit vectors).
        part = part.astype(np.float32)
        squares = (part * part).sum(1)
        limit = np.float32(limits[block] + SINGLE)
        for held in np.split(at, np.flatnonzero(np.diff(at.cell)) + 1):
            nears, homes = held.row[near[held.row]], held.row[held.home & home[held.row]]
            close, most = part[nears], limit - squares[nears]
            for i in range(0, len(homes), 256):
                some = homes[i : i + 256]
                apart = (part[some] * np.float32(-2)) @ close.T
                apart += squares[some, None]
                rows, cols = np.divmod(np.flatnonzero(apart <= most), max(1, len(nears)))
                for j in range(0, len(rows), 20_000):
                    r, c = some[rows[j : j + 20_000]], nears[cols[j : j + 20_000]]
                    # Elementwise, so that both directions and all blocks have the same distances for a pair.
                    within = np.add.reduceat((turned[r] - turned[c]) ** 2, edges, axis=1) <= limits
                    ok = within[:, block] & ~within[:, :block].any(axis=1) & (r != c)
                    r, c = r[ok], c[ok]
                    ok = np.einsum("ij,ij->i", x[r], x[c]) >= similarity
                    yield r[ok], c[ok]


def near_vectors(
    vectors: DataFrame,
    similarity: float = SIMILARITY,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per vector: key, n_links (other vectors of its label with a cosine of at least ``similarity``),
    component_id (smallest key reachable over links) and kept (key = component_id).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a key or label, link with
    nothing; so do vectors of different lengths. A row without a key has a null component and isn't kept. Rows that
    repeat link with each other. Other columns are ignored; an empty table gives an empty result.

    Equal vectors of a label are one class. A label's classes are dealt to chunks, and each pair of chunks is a tile, so a
    class is sent as often as its label has chunks, once up to ``CHUNK`` classes. In a tile vectors are rotated and split
    into blocks; in each block a vector goes to its own cell and to those within the block's reach, and a cell's home rows
    meet all its rows there. A pair is taken in the first block that holds it, so links need no deduplication. Tiles
    return counts and a forest, never pairs.
    """
    v = F.col("v")
    clean = (
        F.col("label").isNotNull()
        & F.col("id").isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists(v, lambda c: c != 0)
    )
    # Floats stay floats until a tile has them: half the bytes of doubles.
    element = vectors.schema[embedding].dataType.elementType
    kind = "array<float>" if isinstance(element, FloatType) else "array<double>"
    told = vectors.select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("string").alias("label"),
        F.col(embedding).cast(kind).alias("v"),
    )
    told = told.withColumn("clean", F.coalesce(clean, F.lit(False)))
    told = told.withColumn("k1", F.when(F.col("clean"), F.xxhash64("label", "v"))).withColumn(
        "k2", F.when(F.col("clean"), F.xxhash64(F.lit(1), "v", "label"))
    )
    rows = cut(told.select("id", "k1", "k2"), "vectors")
    classes = cut(
        told.where("k1 is not null")
        .groupBy("k1", "k2")
        .agg(
            F.min("id").alias("id"),
            F.count("*").alias("copies"),
            F.min("label").alias("label"),
            F.any_value("v").alias("v"),
        ),
        "classes",
    )
    found = cut(_links(classes, similarity), "vector-links")
    counts = found.groupBy("k1", "k2").agg(F.sum("n").alias("n"))
    linked = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    info = (
        classes.select("k1", "k2", "id", "copies")
        .join(counts, ["k1", "k2"], "left")
        .join(linked.select(F.col("node").alias("id"), "component"), "id", "left")
        .select(
            "k1",
            "k2",
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    info = cut(info, "vector-classes")
    return rows.join(info, ["k1", "k2"], "left").select(
        F.col("id").alias(key),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"),
    )


def _tiles(classes: DataFrame) -> DataFrame:
    """Classes by tile: (one, two), one not above two, has the classes of both chunks of a label and width. A class is there
    once for each chunk of its label; labels of one class are left out."""
    group = ["label", "width"]
    classes = classes.withColumn("width", F.size("v"))
    sizes = cut(classes.groupBy(*group).agg(F.count("*").alias("of_label")).where("of_label > 1"), "labels")
    placed = classes.join(sizes, group).withColumn("chunks", F.ceil(F.col("of_label") / CHUNK).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("k1", "k2"), F.col("chunks")).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "k1", "k2", "id", "copies", *group, "v", "own", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two")
    )


def _links(classes: DataFrame, similarity: float) -> DataFrame:
    """(k1, k2, id, root, n): for each class of a tile the vectors it links with there, and the smallest id of its tile
    that it is connected with there."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "k1", "k2"], kind="stable").reset_index(drop=True)
        own, one, two = frame["own"].to_numpy(), int(frame["one"].iloc[0]), int(frame["two"].iloc[0])
        copies = frame["copies"].to_numpy()
        n, root = np.zeros(len(frame), np.int64), np.arange(len(frame))
        for r, c in _pairs(unit(frame["v"].tolist()), own == one, own == two, similarity):
            # A tile of one chunk has each pair in both directions.
            n += np.bincount(r, copies[c], minlength=len(frame)).astype(np.int64)
            if one != two:
                n += np.bincount(c, copies[r], minlength=len(frame)).astype(np.int64)
            unite(root, r, c)
        keep = (n > 0) | (root != np.arange(len(frame)))
        ids = frame["id"].to_numpy()
        return pd.DataFrame({"k1": frame["k1"], "k2": frame["k2"], "id": ids, "root": ids[root], "n": n})[keep]

    tiles = _tiles(classes).groupBy("label", "width", "one", "two")
    return tiles.applyInPandas(compare, "k1 long, k2 long, id long, root long, n long")


def op1_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of embeddings, by :func:`near_vectors`; nulls, ties and empty tables as there."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
