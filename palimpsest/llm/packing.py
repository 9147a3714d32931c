"""Packing by lexical retrieval: a BM25 index sharded by content names the unused neighbours that fill a seed's window."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .tokens import encoder, vocabulary

WINDOW = 1024
#: Documents of a shard of the index, from 3/4 to 3/2 of it; a task has at least one shard, whatever the session says.
SHARD = 2048
#: Keys of content that order documents, the first before the second and so on.
KEYS = 3
#: Terms with more than this share of a shard's documents are scored by a matrix product, the others by their postings.
DENSE = 0.03
#: Seeds that are scored at a time.
AHEAD = 64
K1, B = 1.2, 0.75

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
)
_TYPES = (*[pa.int64()] * 7, pa.binary())
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def split_documents(
    docs: DataFrame, path: str, window: int = WINDOW, key: str = "doc_id", text: str = "text", ids: bool = False
) -> DataFrame:
    """(uid, doc_id, tokens, crcs, first, full, tail, terms, times, width): a row for each document. Its ids are cut into
    whole windows, of which the check sums (and with ``ids`` the ids) are kept, and a tail that is shorter than a window.
    Terms are the distinct ids of the whole text, with how often each occurs; first counts the windows before, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        small = enc.whole.get_vocab_size() <= 1 << 16
        before = 0
        for batch in batches:
            tokens, crcs, first, full, tails, terms, times, widths = [], [], [], [], [], [], [], []
            for body in batch.column(1):
                found = enc.document(body.as_py())
                whole = len(found) // (4 * window) * 4 * window
                tokens.append(len(found) // 4)
                crcs.append([zlib.crc32(found[i : i + 4 * window]) for i in range(0, whole, 4 * window)])
                full.append(found[:whole] if ids else None)
                first.append(before)
                before += whole // (4 * window)
                term, n = np.unique(np.frombuffer(found, "<u4"), return_counts=True)
                width = "<u2" if small and n.max() < 1 << 16 else "<u4"
                tails.append(np.frombuffer(found[whole:], "<u4").astype(width).tobytes())
                terms.append(term.astype(width).tobytes())
                times.append(n.astype(width).tobytes())
                widths.append(int(width[-1]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(tokens, pa.int64()),
                    pa.array(crcs, pa.list_(pa.int64())),
                    pa.array(first, pa.int64()),
                    pa.array(full, pa.binary()),
                    pa.array(tails, pa.binary()),
                    pa.array(terms, pa.binary()),
                    pa.array(times, pa.binary()),
                    pa.array(widths, pa.int32()),
                ],
                names=["doc_id", "tokens", "crcs", "first", "full", "tail", "terms", "times", "width"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    split = rows.mapInArrow(
        run,
        "doc_id long, tokens long, crcs array<long>, first long, full binary, tail binary, terms binary, times binary, width int",
    )
    task = F.shiftleft(F.spark_partition_id().cast("long"), 33)
    return cut(split.withColumn("uid", F.monotonically_increasing_id()).withColumn("first", task + F.col("first")), "split")


def term_statistics(split: DataFrame) -> tuple[np.ndarray, int, float]:
    """(documents with each id, documents, mean length) over all documents. One number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        n = length = 0
        for batch in batches:
            for terms, tokens, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.frombuffer(terms, f"<u{width}")
                if found[-1] >= len(counts):
                    counts = np.r_[counts, np.zeros(int(found[-1]) + 1, np.int64)]
                counts[found] += 1
                n, length = n + 1, length + tokens
        terms = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[terms, -1, -2]), pa.array(np.r_[counts[terms], n, length])], names=["term", "n"]
        )

    rows = split.select("terms", "tokens", "width").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in rows.collect()}  # bounded by the vocabulary
    n, length = found.pop(-1, 0), found.pop(-2, 0)
    counts = np.zeros(max(found, default=0) + 1, np.int64)
    counts[list(found)] = list(found.values())
    return counts, n, length / n if n else 0.0


def bag(terms: bytes, times: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(terms, f"<u{width}").astype(np.int64), np.frombuffer(times, f"<u{width}").astype(np.int64)


def weights(times: np.ndarray, idf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """BM25 of terms that occur ``times`` in documents of ``length`` ids."""
    return idf * times * (K1 + 1) / (times + K1 * (1 - B + B * length / (mean or 1.0)))


def content_keys(bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float, shared: np.ndarray) -> np.ndarray:
    """KEYS terms of each document, each drawn in proportion to its BM25 weight among the ``shared`` ones (those of two or
    more documents), by one draw for all documents: two documents have a key in common with the probability that is the
    weighted Jaccard similarity of their terms, equal ones always. -1 without a shared term."""
    term = np.concatenate([b[0] for b in bags])
    times = np.concatenate([b[1] for b in bags])
    size = np.array([len(b[0]) for b in bags])
    doc = np.repeat(np.arange(len(bags)), size)
    length = np.array([b[1].sum() for b in bags])
    weight = np.where(shared[term], weights(times, idf[term], length[doc], mean), 0.0)
    first = np.cumsum(size) - size
    keys = np.full((KEYS, len(bags)), -1, np.int64)
    for k in range(KEYS):
        draw = -np.log(np.random.default_rng(k).random(len(idf)))[term]
        cost = np.divide(draw, weight, out=np.full(len(term), np.inf), where=weight > 0)
        least = np.minimum.reduceat(cost, first)
        best = np.flatnonzero((cost == least[doc]) & (cost < np.inf))[::-1]
        keys[k, doc[best]] = term[best]  # of equal ones the first
    return keys


class Index:
    """A BM25 index over the documents of a shard, by all terms of their whole texts."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float):
        n = self.n = len(bags)
        size = np.array([len(b[0]) for b in bags], np.int64)
        doc = np.repeat(np.arange(n), size)
        found, term = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)
        times = np.concatenate([b[1] for b in bags])
        length = np.array([b[1].sum() for b in bags])
        weight = weights(times, idf[found][term], length[doc], mean).astype(np.float32)
        df = np.bincount(term, minlength=len(found))
        # The dense terms by columns; a term of one document finds no other.
        often = df > max(DENSE * n, 1)
        column = np.cumsum(often) - 1
        self.dense = np.zeros((n, int(often.sum())), np.float32)
        here = often[term]
        self.dense[doc[here], column[term[here]]] = weight[here]
        here = ~here & (df[term] > 1)
        term, doc, weight = term[here], doc[here], weight[here]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        bounds = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.bincount(term, minlength=len(found)), out=bounds[1:])
        self.start, self.end = bounds[:-1][term], bounds[1:][term]  # by document, as the bags were
        self.of = np.searchsorted(doc, np.arange(n + 1))

    def scores(self, seeds: np.ndarray) -> np.ndarray:
        """BM25 of every document of the shard (columns) for all terms of each seed (rows), in 16 bits of mantissa, since
        sums in another order differ below."""
        found = (self.dense[seeds] > 0).astype(np.float32) @ self.dense.T
        for row, seed in zip(found, seeds, strict=True):
            at = slice(self.of[seed], self.of[seed + 1])
            start, many = self.start[at], self.end[at] - self.start[at]
            if len(start):
                where = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
                row += np.bincount(self.doc[where], self.weight[where], minlength=self.n).astype(np.float32)
        return (found.view(np.int32) & ~0x7F).view(np.float32)


def fill(sizes: list[int], index: Index, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold all ids of all documents. A seed opens a sequence; its best unused
    neighbours follow until it is full, and then the next unused ones in order. What is left of the last one is the next
    seed, so only the last sequence is short."""
    n = len(sizes)
    starts = [0] * n
    free = np.array([s > 0 for s in sizes], bool)
    scored: dict[int, np.ndarray] = {}
    sequences = []

    def scores(seed: int) -> np.ndarray:
        if starts[seed]:  # the rest of a neighbour, which no one has foreseen
            return index.scores(np.array([seed]))[0]
        if seed not in scored:
            scored.clear()
            others = np.flatnonzero(free)
            ahead = np.r_[seed, others[others > seed][: AHEAD - 1]]
            scored.update(zip(ahead.tolist(), index.scores(ahead), strict=True))
        return scored[seed]

    at, seed = 0, None
    while True:
        if seed is None:
            while at < n and not free[at]:
                at += 1
            if at == n:
                return sequences
            seed = at
        free[seed] = False
        pieces = [(seed, starts[seed], sizes[seed] - starts[seed])]
        sequences.append(pieces)
        room, rest = window - pieces[0][2], None
        ranked = np.where(free, scores(seed), -1.0) if room else None
        while room and rest is None:
            best = int(ranked.argmax())  # of equal ones, those without a common term too, the first
            if ranked[best] < 0:
                return sequences
            free[best], ranked[best] = False, -1.0
            take = min(sizes[best], room)
            pieces.append((best, 0, take))
            room -= take
            if take < sizes[best]:
                starts[best], rest = take, best
        seed = rest


def place(split: DataFrame, idf: np.ndarray, shared: np.ndarray, n: int, mean: float, window: int, ids: bool) -> DataFrame:
    """Pieces of the tails. Documents are ordered by their content's keys and dealt by ranges of that order, so that
    documents alike stand together; each SHARD of them in order has an index. A short last sequence goes back to the
    documents of the next shard."""
    context = split.sparkSession.sparkContext
    idf, shared = context.broadcast(idf), context.broadcast(shared)
    names = [f"k{k}" for k in range(KEYS)]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bags = [bag(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("terms", "times", "width")), strict=True)]
                keys = content_keys(bags, idf.value, mean, shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, keys)], names=[*batch.schema.names, *names])

    def pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        count, kept = TaskContext.get().partitionId() << 33, []

        def packed(rows: list[dict], last: bool):
            """Pieces; the documents of a short last sequence, unless it is ``last``."""
            nonlocal count
            index = Index([bag(r["terms"], r["times"], r["width"]) for r in rows], idf.value, mean)
            sequences = fill([len(r["tail"]) // r["width"] - r["at"] for r in rows], index, window)
            again = []
            # A shard that doesn't fill one window stays a short sequence.
            if len(sequences) > 1 and not last and sum(p[2] for p in sequences[-1]) < window:
                # A document that the sequence before has a part of goes on from there.
                again = [rows[i] | {"at": rows[i]["at"] + at} for i, at, _ in sequences.pop()]
            out = []
            for pieces in sequences:
                count, offset = count + 1, 0
                for i, at, size in pieces:
                    r = rows[i]
                    at += r["at"]
                    body = np.frombuffer(r["tail"], f"<u{r['width']}")[at : at + size].astype("<u4").tobytes()
                    start = r["tokens"] - len(r["tail"]) // r["width"] + at
                    out.append((r["doc_id"], start, size, zlib.crc32(body), r["tokens"], -count, offset, body if ids else None))
                    offset += size
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(_TYPES)]
            return pa.RecordBatch.from_arrays(columns, names=_NAMES), again

        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                kept += [r | {"at": 0} for r in batch.slice(at, SHARD).to_pylist()]
                while len(kept) >= 2 * SHARD:
                    found, again = packed(kept[:SHARD], False)
                    kept = again + kept[SHARD:]
                    yield found
        while kept:
            size = len(kept) if 2 * len(kept) <= 3 * SHARD else len(kept) // 2
            found, again = packed(kept[:size], size == len(kept))
            kept = again + kept[size:]
            yield found

    columns = "uid long, doc_id long, tokens long, tail binary, terms binary, times binary, width int"
    rows = split.where(F.length("tail") > 0).select(*[c.split()[0] for c in columns.split(", ")])
    rows = rows.mapInArrow(keyed, ", ".join([columns, *[f"{k} long" for k in names]]))
    rows = rows.repartitionByRange(max(1, n // SHARD), *names, "uid").sortWithinPartitions(*names, "uid").drop(*names)
    return rows.mapInArrow(pack_shards, PIECES)


def whole_windows(split: DataFrame, window: int, ids: bool) -> DataFrame:
    """Pieces that are a window each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out = []
                for j, crc in enumerate(r["crcs"]):
                    body = r["full"][4 * window * j : 4 * window * (j + 1)] if ids else None
                    out.append((r["doc_id"], j * window, window, crc, r["tokens"], r["first"] + j, 0, body))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_TYPES)], names=_NAMES)

    if ids:
        rows = split.where(F.size("crcs") > 0).select("doc_id", "tokens", "crcs", "first", "full")
        return rows.mapInArrow(run, PIECES)
    rows = split.select("doc_id", "tokens", "first", F.posexplode("crcs").alias("j", "crc"))
    j, full = F.col("j").cast("long"), F.lit(window).cast("long")
    return rows.select(
        "doc_id", (j * window).alias("start"), full.alias("length"), F.col("crc").alias("ids_crc32"), F.col("tokens").alias("doc_tokens"),
        (F.col("first") + j).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(None).cast("binary").alias("ids"),
    )


def pack(
    docs: DataFrame,
    path: str | None = None,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
    ids: bool = True,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` ids, with their ids if ``ids``.

    Every document is its ids and an end id; a null or empty text is the end id alone. Whole windows of a long document
    are sequences of their own. Tails are packed by BM25 over all terms of whole texts, with df and lengths of all
    documents: a seed's window is filled by its best unused neighbours of its shard. Shards are about SHARD documents, at
    any size of the table and with any settings, that stand together when all are ordered by KEYS content keys
    (:func:`content_keys`); every document is in one shard, and a neighbour of another shard isn't found. README has the
    recall against an index that isn't sharded. One sequence of a task is short, and so is that of a shard whose ids don't
    fill a window. Equal and null keys are separate documents. Rows that repeat are packed as often as they occur. Other
    columns of docs are ignored; an empty table gives an empty result. ``sequence_id`` of a whole window counts within a
    task, with the task's number above 33 bits; that of packed tails is negative.
    """
    split = split_documents(docs, path or vocabulary(), window, key, text, ids)
    df, n, mean = term_statistics(split)
    tails = place(split, np.log1p((n - df + 0.5) / (df + 0.5)), df > 1, n, mean, window, ids)
    packed = whole_windows(split, window, ids).unionByName(tails)
    return packed if ids else packed.drop("ids")


def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents without their ids, by :func:`pack`; nulls, ties and empty tables as there."""
    return pack(table(spark, sf_dir, "documents"), ids=False)
