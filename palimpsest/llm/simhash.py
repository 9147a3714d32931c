"""SimHash near-duplicates: fingerprints of word shingles, linked by a pigeonring search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, table, unite

SEED = 42
#: A fingerprint is a ring of SEGMENTS segments of WIDTH bits.
SEGMENTS, WIDTH = 4, 16
#: Rows of one tile of a bucket; a bucket with more rows is dealt to several tiles.
TILE = 1024
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of ``text``: A-Z lower-cased, shingles of ``words`` words split at ASCII white space, repeats included;
    fewer words give one shingle of all; a bit is set if over half the XXH64 values have it. No words, null: 0."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(s, SEED) for s in shingles], dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    """The bits that over half of ``hashes`` have. Eight bits are counted at a time, each in a byte of a word."""
    n = len(hashes)
    starts = np.arange(0, n, 255)
    counts = np.empty((8, 8), dtype=np.int64)  # [bit in byte, byte]
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & _LANES
        sums = np.add.reduceat(lanes, starts).view(np.uint8).reshape(-1, 8)
        counts[bit] = sums.sum(axis=0, dtype=np.int64)
    over = counts * 2 > n
    return sum(1 << (8 * byte + bit) for bit in range(8) for byte in range(8) if over[bit, byte])


def with_fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 3) -> DataFrame:
    """(key, fp): the signed 64-bit SimHash of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(
                (fingerprint(t.as_py(), words) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return (
        docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        .mapInArrow(run, "id long, fp long")
        .withColumnRenamed("id", key)
    )


def _close(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (tile, turn, fp, id), sorted by tile, to (a, b): a forest of the links of each tile.

    ``turn`` is the segment at which the ring starts for this bucket; it is equal in all of the bucket.
    """

    def links(tile: np.ndarray, turn: np.ndarray, fp: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
        n = len(tile)
        start = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1])])
        size = np.diff(np.r_[start, n])
        left = np.repeat(start + size, size) - np.arange(n)  # rows to the tile's end, this one included
        shift = (turn * WIDTH).astype(np.uint64)
        ring = np.where(shift > 0, (fp << shift) | (fp >> ((np.uint64(64) - shift) & np.uint64(63))), fp)
        root = np.arange(n)
        at = np.arange(n)
        for step in range(1, int(size.max(initial=1))):
            at = at[left[at] > step]
            if not len(at):
                break
            at = at[turn[at] == turn[at + step]]
            apart = ring[at] ^ ring[at + step]
            # Chains from the ring's start: i segments may differ in i * most // SEGMENTS bits.
            near, pairs = apart, at
            for i in range(1, SEGMENTS + 1):
                ok = np.bitwise_count(near >> np.uint64(64 - i * WIDTH)) <= i * most // SEGMENTS
                near, pairs = near[ok], pairs[ok]
            unite(root, pairs, pairs + step)
        moved = root != np.arange(n)
        if not moved.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[root[moved]]), pa.array(ids[moved])], names=["a", "b"])

    held: list[list[np.ndarray]] = []

    def flush(upto: bool) -> pa.RecordBatch | None:
        nonlocal held
        rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = len(rows[0]) if upto else int(np.searchsorted(rows[0], rows[0][-1]))
        held = [[x[last:] for x in rows]] if last < len(rows[0]) else []
        tile, turn, fp, ids = (x[:last] for x in rows)
        order = np.lexsort((ids, tile))
        return links(tile[order], turn[order], fp[order], ids[order]) if last else None

    for batch in batches:
        if batch.num_rows:
            held.append(
                [
                    batch.column(0).to_numpy(zero_copy_only=False),
                    batch.column(1).to_numpy(zero_copy_only=False),
                    batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64),
                    batch.column(3).to_numpy(zero_copy_only=False),
                ]
            )
            if sum(len(x[0]) for x in held) >= 20_000 and (out := flush(False)):
                yield out
    if held and (out := flush(True)):
        yield out


def link_fingerprints(prints: DataFrame, most: int = 3) -> DataFrame:
    """(fp, id): links (a, b) that connect ids whose fingerprints differ in at most ``most`` (at most 3) bits.

    Pigeonring: if the ring of four segments differs in 3 bits at most, then some segment starts a chain in which the
    first i segments differ in floor(3 i / 4) bits at most, for each i: none in the first, one in the first two. So
    fingerprints meet under the first segment and one half of the second (one differing bit leaves a half equal), in
    eight buckets of 24 bits; the chains of three and of four segments are tested there. ``fp`` must be distinct.
    A bucket over TILE rows is dealt to pairs of chunks; a tile returns a forest, not its pairs.
    """
    if not 0 <= most < SEGMENTS:
        raise ValueError("most must be from 0 to 3")
    half = WIDTH // 2
    keys = []
    for turn in range(SEGMENTS):
        ring = f"(shiftleft(fp, {turn * WIDTH}) | shiftrightunsigned(fp, {64 - turn * WIDTH}))" if turn else "fp"
        for j in range(2):
            part = f"shiftrightunsigned({ring}, {64 - WIDTH - half * (j + 1)}) & {(1 << half) - 1}"
            keys.append(
                f"cast({2 * turn + j} as bigint) * {1 << (WIDTH + half)}"
                f" + shiftrightunsigned({ring}, {64 - WIDTH}) * {1 << half} + ({part})"
            )
    rows = prints.select("fp", "id", F.explode(F.expr(f"array({', '.join(keys)})")).alias("bucket"))
    met = cut(rows.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1"), "buckets")
    chunks = F.ceil(F.col("rows") / TILE).cast("int")
    dealt = rows.join(met, "bucket").select(
        "fp", "id", "bucket", F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("own"), chunks.alias("chunks")
    )
    dealt = dealt.select(
        "fp", "id", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    ).select(
        # The bucket's number has 27 bits; the pair of chunks is hashed in, and so is the bucket, for even partitions.
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
        F.shiftright("bucket", WIDTH + half + 1).alias("turn"),
        "fp",
        "id",
    )
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(parts, "tile")
        .sortWithinPartitions("tile")
        .mapInArrow(lambda it: _close(it, most), "a long, b long")
    )


def simhash_groups(docs: DataFrame, most: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id (smallest key reachable over links).

    Null and empty texts have fingerprint 0 and link like others. A null key keeps its row; it joins its fingerprint's
    component and never names one unless no other document has it (then component_id is null). Repeated rows stay.
    Other columns are ignored. An empty table gives an empty result.
    """
    prints = cut(with_fingerprint(docs, text, key).withColumnRenamed(key, "id"), "simhash")
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("id")), "classes")
    linked = components(link_fingerprints(classes.where("id is not null"), most))
    where = cut(
        classes.join(linked.select(F.col("node").alias("id"), "component"), "id", "left").select(
            "fp", F.coalesce("component", "id").alias("component_id")
        ),
        "members",
    )
    return prints.join(where, "fp", "left").select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, most: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The row of the smallest key of each component, with docs' own columns; of rows with one key the first by content.
    Rows are told apart by a number of their own, so repeated keys join no groups. A row without a key stays."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    columns = plain.columns
    plain = cut(plain.withColumn("uid", F.monotonically_increasing_id()), "numbered")
    k, t = f"c{names.index(key)}", f"c{names.index(text)}"
    groups = simhash_groups(plain.select("uid", t), most, t, "uid").select("uid", "component_id")
    keyed = cut(groups.join(plain.where(f"{k} is not null").select("uid", k), "uid"), "keyed")
    least = keyed.groupBy("component_id").agg(F.min(k).alias("least"))
    first = cut(keyed.join(least, "component_id").where(F.col(k) == F.col("least")).select("uid", "component_id"), "first")
    counted = first.groupBy("component_id").agg(F.count("*").alias("n"), F.min("uid").alias("uid"))
    counted = cut(counted, "counted")
    chosen = counted.where("n = 1").select("uid")
    tied = counted.where("n > 1").select("component_id")
    if not tied.isEmpty():
        rows = first.join(tied, "component_id", "left_semi").join(plain, "uid")
        best = rows.groupBy("component_id").agg(F.min(F.struct(*columns, "uid")).alias("row"))
        chosen = chosen.unionByName(best.select("row.uid"))
    kept = plain.join(cut(chosen, "chosen"), "uid", "left_semi").unionByName(plain.where(f"{k} is null"))
    return kept.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; nulls, ties and empty tables as :func:`simhash_groups` says."""
    return simhash_groups(table(spark, sf_dir, "documents"))
