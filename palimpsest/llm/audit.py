"""An audit of how filters interact: what each removes in every order they can be applied in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: The filters by letter: too short, too repetitive, too many capitals, holds a symbol, copy of an earlier document.
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
SYMBOLS = (b"#", b"$", b"%", b"&", b"*", b"|")
#: Parts whose counts a task holds at a time; 15 KB each.
PARTS = 1024
_STEPS = len(FILTERS) + 1


def first_failures() -> np.ndarray:
    """By the mask of failed filters and the order: the step, from 0, of the first filter that fails; one beyond the last
    where none does. 32 by 120."""
    out = np.full((1 << len(FILTERS), len(ORDERS)), len(FILTERS), np.int64)
    for mask in range(len(out)):
        for k, order in enumerate(ORDERS):
            failing = [s for s, f in enumerate(order) if mask >> FILTERS.index(f) & 1]
            out[mask, k] = min(failing, default=len(FILTERS))
    return out


def own_failures(text: bytes) -> int:
    """The mask of the filters A to D for one whole text in UTF-8."""
    words = text.split()  # of bytes: at \\x20 and \\x09 to \\x0D alone
    found = int(len(words) < 100) | int(100 * len(set(words)) < 80 * len(words)) << 1
    codes = np.frombuffer(text, np.uint8)
    points = int(((codes & 0xC0) != 0x80).sum())
    capitals = int(((codes >= 65) & (codes <= 90)).sum())
    return found | int(100 * capitals > 10 * points) << 2 | int(any(s in text for s in SYMBOLS)) << 3


def failures(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask) of every row: the filters that its whole text fails, as bits. A null text is empty, a null part
    the empty string. E, a copy of any smaller doc_id's text, compares texts by sha256; it never holds for a null doc_id,
    and a null one is smaller than none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch.column(2):
                body = value.as_py() or b""
                masks.append(own_failures(body))
                digests.append(hashlib.sha256(body).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())],
                names=["doc_id", "part", "mask", "digest"],
            )

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(text).cast("string").cast("binary").alias("body"),
    )
    own = cut(rows.mapInArrow(run, "doc_id long, part string, mask int, digest binary"), "failures")
    # Texts that occur once need no look at their first row; a text of many rows is one row here. Both sides of the join are
    # written tables, so that a hot text's rows can be split.
    first = own.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = cut(first, "first")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    return own.join(first, "digest", "left").select("doc_id", "part", F.col("mask").bitwiseOR(later).alias("mask"))


def removals(failed: DataFrame) -> DataFrame:
    """(part, filter_order, step, removed, good, toxic): how many rows of (part, mask, good, toxic) each step of each order
    removes, and how many of them are good or toxic; step 6 counts those that no filter removes. Rows without any of them
    are left out.

    Every task looks its masks up in the table of first failures and counts (part, order, step) with bincount, once for
    all rows and once for each label; what tasks counted is then summed by key.
    """
    lookup = first_failures()
    offsets = np.arange(len(ORDERS)) * _STEPS
    cells = len(ORDERS) * _STEPS

    def counted(counts: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for name, count in counts.items():
            at = np.flatnonzero(count[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), *(pa.array(c[at]) for c in count)],
                names=["part", "cell", "removed", "good", "toxic"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            part = coded.indices.to_numpy()
            mask = batch.column(1).to_numpy()
            labels = [None, *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))]
            for k, name in enumerate(coded.dictionary.to_pylist()):
                own = part == k
                if name not in counts:
                    if len(counts) == PARTS:
                        yield from counted(counts)
                        counts = {}
                    counts[name] = np.zeros((3, cells), np.int64)
                for i, label in enumerate(labels):
                    steps = lookup[mask[own if label is None else own & label]] + offsets
                    counts[name][i] += np.bincount(steps.ravel(), minlength=cells)
        yield from counted(counts)

    summed = failed.select("part", "mask", "good", "toxic").mapInArrow(
        run, "part string, cell long, removed long, good long, toxic long"
    )
    summed = summed.groupBy("part", "cell").agg(*(F.sum(c).alias(c) for c in ("removed", "good", "toxic")))
    orders = F.array(*map(F.lit, ORDERS))
    return summed.select(
        "part",
        F.element_at(orders, (F.floor(F.col("cell") / _STEPS) + 1).cast("int")).alias("filter_order"),
        (F.col("cell") % _STEPS + 1).cast("int").alias("step"),
        "removed",
        "good",
        "toxic",
    )


def audit_filters(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, zeros included; all columns count rows of the part.

    kept: left after the step; removed: removed by it; redundant: failing its filter but removed before; unique_fails:
    failing its filter alone; good_lost, toxic_lost: removed here with quality = 1, toxic = 1 in any label of their
    doc_id; shapley: removed by its filter, summed over all orders. Null texts are empty, null parts the empty string,
    null labels and labels of no document count nothing, repeated rows count each, and an empty table gives no rows.
    """
    failed = failures(docs, key, text, part)
    said = (
        labels.where(f"`{key}` is not null")
        .groupBy(F.col(key).cast("long").alias("doc_id"))
        .agg(*(F.coalesce(F.max(F.col(of) == 1), F.lit(False)).alias(to) for of, to in (("quality", "good"), ("toxic", "toxic"))))
    )
    failed = failed.join(cut(said, "labels"), "doc_id", "left").select(
        "part", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))
    )
    found = cut(removals(failed), "removals")
    grid = found.select("part").distinct().select("part", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    grid = grid.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(_STEPS))).alias("step"))
    counts = ["removed", "good", "toxic"]
    rows = grid.join(found, ["part", "filter_order", "step"], "left").fillna(0, counts)
    rows = rows.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    in_order = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    # A filter that comes first removes all that fails it, one that comes last what fails it alone.
    by_filter = Window.partitionBy("part", "filter")
    rows = rows.withColumn("kept", F.coalesce(F.sum("removed").over(in_order), F.lit(0)))
    fails = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(by_filter)
    return (
        rows.select(
            "part",
            "filter_order",
            "step",
            "kept",
            "removed",
            (fails - F.col("removed")).alias("redundant"),
            F.max(F.when(F.col("step") == len(FILTERS), F.col("removed"))).over(by_filter).alias("unique_fails"),
            F.col("good").alias("good_lost"),
            F.col("toxic").alias("toxic_lost"),
            F.sum("removed").over(by_filter).alias("shapley"),
        )
        .where(F.col("step") <= len(FILTERS))
    )


def op12_first_failure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents by language; nulls, ties, repeated rows and empty tables as ``audit_filters`` says."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SQL_FILTERS = " UNION ALL ".join(f"SELECT '{f}' AS f, {i} AS bit" for i, f in enumerate(FILTERS))
OP12_SQL = rf"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM documents),
g AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT row_number() OVER () AS r, part, coalesce(g.good, false) AS good, coalesce(g.toxic, false) AS toxic,
 [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
 regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails FROM w LEFT JOIN g ON g.doc_id = w.doc_id),
f AS ({_SQL_FILTERS}),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = {len(FILTERS)}),
s AS (SELECT filter_order, u.step, filter_order[u.step] AS f, bit FROM o, (SELECT unnest(range(1, {_STEPS})) AS step) u JOIN f ON f.f = filter_order[u.step]),
p AS (SELECT part, fails, good, toxic, count(*) AS n FROM d GROUP BY ALL),
q AS (SELECT p.part, s.filter_order, s.step, s.f, p.n, p.good, p.toxic, p.fails[s.bit + 1] AS fails,
 len([x FOR x IN fails IF x]) = 1 AS alone,
 (SELECT min(t.step) FROM s t WHERE t.filter_order = s.filter_order AND p.fails[t.bit + 1]) AS first FROM p, s),
a AS (SELECT part, filter_order, step, f, CAST(sum(n) FILTER (first IS NULL OR first > step) AS BIGINT) AS kept, CAST(sum(n) FILTER (first = step) AS BIGINT) AS removed,
 CAST(sum(n) FILTER (fails AND first < step) AS BIGINT) AS redundant, CAST(sum(n) FILTER (fails AND alone) AS BIGINT) AS unique_fails,
 CAST(sum(n) FILTER (first = step AND good) AS BIGINT) AS good_lost, CAST(sum(n) FILTER (first = step AND toxic) AS BIGINT) AS toxic_lost FROM q GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
 coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM a"""
