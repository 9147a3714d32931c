"""Toxicity by a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Lengths of the n-grams, and bits of the hash that each length is counted under.
GRAMS, BITS = (4, 5, 6), 18
#: Labelled documents that the classifier is fitted on, at most; features it keeps, at most.
SAMPLE_ROWS, FEATURES = 12_000, 2048
#: Least |z| of a feature's log-count ratio; strength of the penalty.
LEAST_Z, PENALTY = 4.0, 1e-4
THRESHOLD = 0.7

_LETTERS = np.array([c if chr(c).isalpha() else 32 for c in range(128)], dtype=np.uint32)


def grams(text: str | None) -> np.ndarray:
    """Hashes of the character n-grams of a whole text, one for each place and length. Letters are lower-cased, ASCII
    characters that are no letters count as a space, and runs of spaces as one; the text stands between spaces."""
    codes = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes < 128, _LETTERS[codes & 127], codes)
    space = codes == 32
    codes = codes[~(space & np.r_[False, space[:-1]])]
    out, h = [], codes
    for n in range(2, max(GRAMS) + 1):
        if len(codes) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            out.append((mixed >> np.uint32(32 - BITS)) + np.uint32(GRAMS.index(n) << BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Weights by feature number, the feature of each hash (-1: none), and the constant."""

    of: np.ndarray
    weights: np.ndarray
    constant: float

    def score(self, text: str | None) -> float:
        found = self.of[grams(text)]
        found = np.unique(found[found >= 0])
        return float(1 / (1 + np.exp(-(self.weights[found].sum() + self.constant))))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most ``rows`` labelled documents, by a hash of their numbers; a document with several labels
    takes the greatest. Documents whose crc32(doc_id as text) mod 3 is 1 are never read."""
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    chosen = cut(chosen, "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A document number that repeats is learned from once. The labels are at most ``rows`` rows.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return cut(found.select("text", "toxic"), "labelled")


def fit(sample: DataFrame) -> Model:
    """The classifier for (text, toxic): of the n-grams whose log-count ratio has a |z| of LEAST_Z or more the FEATURES
    with the greatest, ties by number. No rows: every score is 0; rows of one class: the constant alone. Null texts are
    empty, and repeated rows count each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, len(GRAMS) << BITS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                seen[int(toxic)][np.unique(grams(text.as_py()))] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(seen[1][at]), pa.array(seen[0][at])], names=["gram", "p", "q"]
        )

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows, toxic = sum(totals.values()), totals.get(True, 0)
    none = np.full(len(GRAMS) << BITS, -1, np.int32)
    if not rows:
        return Model(none, np.zeros(0), -np.inf)
    constant = float(np.log((toxic + 0.5) / (rows - toxic + 0.5)))
    counts = sample.mapInArrow(count, "gram long, p long, q long").groupBy("gram").agg(
        F.sum("p").alias("p"), F.sum("q").alias("q")
    )
    ratio = F.log((F.col("p") + 1) / (toxic + 1.0)) - F.log((F.col("q") + 1) / (rows - toxic + 1.0))
    z = F.abs(ratio) / F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))
    best = (
        counts.select("gram", ratio.alias("ratio"), z.alias("z"))
        .where(F.col("z") >= LEAST_Z)
        .orderBy(F.desc("z"), "gram")
        .limit(FEATURES)
        .collect()
    )
    if not best or not 0 < toxic < rows:
        return Model(none, np.zeros(0), constant)
    ratios = np.array([r["ratio"] for r in best])
    of = none.copy()
    of[[r["gram"] for r in best]] = np.arange(len(best))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of[grams(t.as_py())] for t in batch.column(0)]
            bits = []
            for f in found:
                row = np.zeros(len(ratios), bool)
                row[f[f >= 0]] = True
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), batch.column(1)], names=["bits", "toxic"])

    # At most SAMPLE_ROWS rows of FEATURES bits.
    found = sample.mapInArrow(features, "bits binary, toxic boolean").orderBy("bits", "toxic").collect()
    x = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=len(ratios)) for r in found])
    x = x.astype(np.float32) * ratios.astype(np.float32)
    y = np.array([r["toxic"] for r in found], dtype=np.float32)
    weights, constant = regress(x, y, constant)
    return Model(of, weights * ratios, constant)


def regress(x: np.ndarray, y: np.ndarray, constant: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by accelerated gradients; classes weigh alike."""
    n, k = x.shape
    each = np.where(y > 0, n / (2 * max(y.sum(), 1)), n / (2 * max(n - y.sum(), 1))).astype(np.float32) / n
    v = np.ones(k, np.float32)
    for _ in range(20):
        v = x.T @ (each * (x @ v))
        size = float(np.linalg.norm(v))
        v /= size
    step = 1 / (0.25 * (size + 1) * 2 + PENALTY)
    w, b = np.zeros(k, np.float32), 0.0
    ww, bb = w, b
    for i in range(rounds):
        error = each * (1 / (1 + np.exp(-(x @ ww + bb))) - y)
        w2, b2 = ww - step * (x.T @ error + PENALTY * ww), bb - step * float(error.sum())
        ww, bb = w2 + i / (i + 3) * (w2 - w), b2 + i / (i + 3) * (b2 - b)
        w, b = w2, b2
    return w.astype(float), b


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every document, from its whole text alone. Null and empty texts get the score
    of a text without features; a row without a key isn't held out; rows that repeat are scored alike. Other columns are
    ignored; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double").select(
        F.col("id").alias(key),
        F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op8_naive_bayes_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; nulls, ties and empty tables as :func:`score_documents` says."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(labelled(docs, table(spark, sf_dir, "labels"))))
