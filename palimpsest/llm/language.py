"""Log-likelihoods of whole documents by a gated recurrent language model that is trained on the corpus itself."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import recurrent
from .common import cut, table
from .recurrent import Network, Shape

#: Words that tasks know by heart, at most; all other words' counts are looked up by a join.
HEAD = 1 << 18
#: Words with an output of their own, at most; how often one occurs at least; classes that they are dealt to.
WORDS, LEAST, CLASSES = 1024, 64, 16
#: Parts of the training documents, each of which is passed over once, with the mean of all tasks' weights in between.
ROUNDS = 4
#: Bytes of a word beyond which its sha256 stands for it.
LONG = 64
#: Distinct words that a task counts before it returns them; tokens that a network works on side by side, about.
FLUSH, TOKENS = 200_000, 1 << 20
#: Weights that are averaged as one row.
CHUNK = 4096

#: Symbols: a text's end, a word that was never counted, then words by how often they were counted, then single words.
END, UNKNOWN, FIRST = 0, 1, 2
#: Marks symbols that are one smaller where the text itself was counted.
EDGE = 1 << 14
_NEW = -1


def word_key(word: bytes) -> bytes:
    """The word itself, or if it is long a space and its sha256, which no word can be."""
    return word if len(word) <= LONG else b" " + hashlib.sha256(word).hexdigest().encode()


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a whole text with A-Z lower-cased; bytes split at \\x20 and \\x09 to \\x0D alone."""
    return (text or b"").lower().split()


def size_class(count):
    """The class of words that occur so often, from 0: 1 to 7 times, 8 to 63, 64 to 511 and so on. Ints or arrays."""
    if isinstance(count, int):
        return (count.bit_length() - 1) // 3
    return (np.frexp(count.astype(np.float64))[1] - 1) // 3


def counts_of(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of (body binary): how often each word key occurs, the empty one standing for ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            found = seen.copy()
            for word in [w for w in seen if len(w) > LONG]:
                found[word_key(word)] += found.pop(word)
            return pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        yield rows()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows of the counts: all tokens, distinct tokens, the frequent words, and for each size class the
    tokens of its words that have no output of their own."""

    tokens: int
    distinct: int
    ends: int
    keys: list[bytes]
    counts: np.ndarray
    own: int
    of_class: np.ndarray
    shape: Shape

    def __post_init__(self):
        # Frequent words are told by their place; the first ``own`` have their own symbols.
        self.symbols = self.symbol(self.counts)
        self.symbols[: self.own] = self.shape.single + np.arange(self.own)
        self.place = {k: i for i, k in enumerate(self.keys)}

    def __reduce__(self):
        return type(self), (self.tokens, self.distinct, self.ends, self.keys, self.counts, self.own, self.of_class, self.shape)

    def symbol(self, counts: np.ndarray) -> np.ndarray:
        """Symbols of words without outputs; marked if they are of a smaller one at one occurrence less."""
        out = np.where(counts > 0, FIRST + size_class(np.maximum(counts, 1)), UNKNOWN)
        edge = (counts > 0) & (size_class(np.maximum(counts - 1, 1)) < size_class(np.maximum(counts, 1)))
        return (out | np.where(edge | (counts == 1), EDGE, 0)).astype(np.int16)

    def within(self, counts: np.ndarray) -> float:
        """The log10 of known words' shares of their size classes, summed."""
        known = counts[counts > 0]
        return float(np.log10(known / self.of_class[size_class(known)]).sum()) if len(known) else 0.0

    def base(self, counts: np.ndarray) -> float:
        """The sum of log10((c + 1) / (N + V + 1))."""
        return float(np.log10((counts + 1) / (self.tokens + self.distinct + 1)).sum())

    def expected(self) -> np.ndarray:
        """How often each symbol occurs where a text's own words are counted without it: a word that occurs once is
        unknown then."""
        out = np.zeros(self.shape.symbols)
        out[END] = self.ends
        out[FIRST : self.shape.single] = self.of_class
        out[self.shape.single :] = self.counts[: self.own]
        return out


def vocabulary(counts: DataFrame, head: int = HEAD, words: int = WORDS, least: int = LEAST, classes: int = CLASSES) -> tuple[Vocabulary, int]:
    """The vocabulary of (word, n), and how many words occur once. Frequent words are all those from some count on, the
    smallest by which they are at most ``head``; no other word can hold more than a 1 / head of all tokens."""
    real = counts.where(F.length("word") > 0)
    # Counts by their six leading bits: at most some two thousand rows.
    lower = "greatest(length(bin(n)) - 6, 0)"
    sizes = (
        real.groupBy(
            F.expr(f"shiftleft(shiftright(n, {lower}), {lower})").alias("least"),
            F.floor((F.length(F.bin("n")) - 1) / 3).alias("size"),
        )
        .agg(F.count("*").alias("k"), F.sum("n").alias("n"))
        .collect()
    )
    sizes.sort(key=lambda r: -r["least"])
    ends = counts.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    taken, floor = 0, None
    for r in sizes:
        taken += r["k"]
        if taken > head:
            break
        floor = r["least"]
    rows = real.where(F.col("n") >= floor).collect() if floor is not None else []
    rows = sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda r: (-r[1], r[0]))
    n = np.array([r[1] for r in rows], dtype=np.int64)
    own = int((n[:words] >= least).sum())
    of_class = np.zeros(max((r["size"] + 1 for r in sizes), default=1), np.int64)
    for r in sizes:
        of_class[r["size"]] += r["n"]
    np.subtract.at(of_class, size_class(n[:own]), n[:own])
    single = FIRST + len(of_class)
    # Classes of about equal sums of roots, so that those of frequent words are small.
    roots = np.sqrt(n[:own]).cumsum()
    dealt = np.minimum((roots - roots[0] / 2) * classes / roots[-1], classes - 1).astype(int) if own else np.zeros(0, int)
    shape = Shape(single, tuple(int(single + (dealt <= c).sum()) for c in np.unique(dealt)))
    tokens = ends + sum(r["n"] for r in sizes)
    distinct = (ends > 0) + sum(r["k"] for r in sizes)
    once = sum(r["k"] for r in sizes if r["least"] == 1)
    return Vocabulary(tokens, distinct, ends, [r[0] for r in rows], n, own, of_class, shape), once


def coded(rows: DataFrame, counts: DataFrame, known: Vocabulary) -> DataFrame:
    """(id, held_out, n_tokens, n_known, base_score, within, symbols) of rows (id, held_out, body): symbols of a whole text
    and its end as int16, and the log10 of its rarer words' shares of their size classes."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        place, counts, symbols = voc.place, voc.counts, voc.symbols
        part, number = None, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            part = batch.column(3)[0].as_py() if part is None and batch.num_rows else part
            for body in batch.column(2):
                words = words_of(body.as_py())
                found = np.fromiter(map(place.get, words, repeat(_NEW)), np.int32, len(words))
                rare: dict[bytes, int] = {}
                at = np.flatnonzero(found == _NEW)
                keys = [words[i] for i in at.tolist()]
                if keys and max(map(len, keys)) > LONG:
                    keys = [word_key(w) for w in keys]
                    found[at] = [place.get(k, _NEW) for k in keys]
                    at, keys = at[found[at] == _NEW], [k for k in keys if k not in place]
                # Below -1: the number of the rare word.
                found[at] = [-2 - rare.setdefault(k, len(rare)) for k in keys]
                heads = found[found >= 0]
                n = counts[heads]
                out[0].append((part << 33) + number)
                out[1].append(found.tobytes())
                out[2].append(list(rare))
                out[3].append(len(heads))
                out[4].append(voc.base(n))
                out[5].append(voc.within(n[heads >= voc.own]))
                number += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()),
                 pa.array(out[2], pa.list_(pa.binary())), pa.array(out[3], pa.int64()), pa.array(out[4], pa.float64()),
                 pa.array(out[5], pa.float64())],
                names=["id", "held_out", "uid", "found", "rare", "heads", "base", "within"],
            )

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        ends = np.array([voc.ends], np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for found, counts, heads, base, within in zip(*(batch.column(i) for i in range(2, 7)), strict=True):
                found = np.frombuffer(found.as_py(), np.int32)
                rare = np.array(counts.as_py() or [], dtype=np.int64)
                symbols = np.full(len(found) + 1, END, np.int16)
                head = found >= 0
                symbols[:-1][head] = voc.symbols[found[head]]
                n = rare[-2 - found[~head]]
                symbols[:-1][~head] = voc.symbol(n)
                out[0].append(len(symbols))
                out[1].append(heads.as_py() + int((n > 0).sum()) + int(voc.ends > 0))
                out[2].append(base.as_py() + voc.base(n) + voc.base(ends))
                out[3].append(within.as_py() + voc.within(n))
                out[4].append(symbols.tobytes())
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(o, t) for o, t in zip(out, kinds, strict=True))],
                names=["id", "held_out", "n_tokens", "n_known", "base_score", "within", "symbols"],
            )

    own = cut(
        rows.select("id", "held_out", "body", F.spark_partition_id().alias("part")).mapInArrow(
            first, "id long, held_out boolean, uid long, found binary, rare array<binary>, heads long, base double, within double"
        ),
        "words",
    )
    asked = own.select("uid", F.posexplode("rare").alias("at", "word"))
    # A word that isn't frequent is asked for once by a text, so no key of this join is hot but for unknown words that
    # many texts share; then adaptive execution splits it.
    told = asked.join(counts.where(F.length("word") > 0), "word", "left").select("uid", "at", F.coalesce("n", F.lit(0)).alias("n"))
    told = told.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("told"))
    told = cut(told.select("uid", F.col("told.n").alias("counts")), "told")
    return cut(
        own.drop("rare")
        .join(told, "uid", "left")
        .select("id", "held_out", "found", "counts", "heads", "base", "within")
        .mapInArrow(
            second,
            "id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, symbols binary",
        ),
        "symbols",
    )


def learned(symbols: np.ndarray) -> np.ndarray:
    """What a counted text is learned from: each word as if it occurred once less, as it would in a text not counted."""
    return (symbols & (EDGE - 1)) - (symbols >> 14)


def batches_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches of about TOKENS symbols, with their texts' symbols."""
    for batch in batches:
        texts = [np.frombuffer(x.as_py(), np.int16) for x in batch.column(column)]
        group = np.cumsum([len(t) for t in texts]) // TOKENS
        at = np.r_[np.flatnonzero(np.diff(group, prepend=-1)), len(texts)]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield batch.slice(a, b - a), texts[a:b]


def fit(texts: DataFrame, net: Network, rounds: int = ROUNDS) -> Network:
    """The network after one pass over all rows of (symbols binary), in ``rounds`` parts by a hash of them. In each part
    every task starts from the same weights and passes over its texts; the mean of all tasks' weights, by tokens, starts
    the next. Tasks return weights as rows of CHUNK, which are added up where Spark deals them to."""
    spark, shape = texts.sparkSession, net.shape
    squares = np.zeros_like(net.flat)
    size = len(net.flat)

    for part in range(rounds):
        shared = spark.sparkContext.broadcast((net.flat, squares))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            flat, sums = shared.value
            own, sums, tokens = Network(shape, flat), sums.copy(), 0
            for _, found in batches_of(batches, 0):
                recurrent.train(own, sums, [learned(t) for t in found])
                tokens += sum(map(len, found))
            if tokens:
                both = np.concatenate([own.flat, sums]).astype(np.float64) * tokens
                rows = [both[i : i + CHUNK].tobytes() for i in range(0, 2 * size, CHUNK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(rows)), pa.int64()), pa.array([tokens] * len(rows), pa.int64()), pa.array(rows, pa.binary())],
                    names=["chunk", "tokens", "sums"],
                )

        kind = "chunk long, tokens long, sums binary"
        share = texts.where(F.pmod(F.xxhash64("symbols"), F.lit(rounds)) == part) if rounds > 1 else texts
        fits = share.select("symbols").mapInArrow(run, kind)
        found = fits.repartition(F.col("chunk")).mapInArrow(_added, kind).collect()  # a row for each chunk
        tokens = sum(r["tokens"] for r in found if r["chunk"] == 0)
        if tokens:
            both = np.zeros(2 * size)
            for r in found:
                at = r["chunk"] * CHUNK
                both[at : at + CHUNK] += np.frombuffer(r["sums"], np.float64)
            net, squares = Network(shape, both[:size] / tokens), (both[size:] / tokens).astype(np.float32)
        shared.unpersist()
    return net


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, tokens, sums) of equal chunks added up, one task holding its chunks' sums alone."""
    tokens: Counter = Counter()
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, n, part in zip(*(batch.column(i) for i in range(3)), strict=True):
            chunk, part = chunk.as_py(), np.frombuffer(part.as_py(), np.float64)
            tokens[chunk] += n.as_py()
            sums[chunk] = sums[chunk] + part if chunk in sums else part
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int64()), pa.array([tokens[c] for c in sums], pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
        names=["chunk", "tokens", "sums"],
    )


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


def score_language(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document, from its whole text.

    Words are counted over all documents that aren't held out, and the network passes once over all of these. A text's
    score is the log10 of the product of its tokens' shares, given all tokens before: of the class by the state; within it
    of the word by the state, or, for words without an output of their own, of the word by its count among those of about
    the same count. A word that was never counted is the one unknown word. All shares of a place add up to 1.

    A null text is empty and has its end alone. A row without a key isn't held out; repeated rows count each and are
    scored alike; other columns are ignored. If nothing is counted, base_score is that of V = N = 0, every word is
    unknown and the network is as it starts. An empty table gives an empty result.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("id"),
        is_held_out(F.col(key).cast("long")).alias("held_out"),
        F.col(text).cast("string").cast("binary").alias("body"),
    )
    counts = cut(counts_of(rows.where("not held_out").select("body")), "counts")
    known, once = vocabulary(counts)
    found = coded(rows, counts, known)
    start = known.expected()
    start[UNKNOWN] = once
    net = fit(found.where("not held_out").select("symbols"), Network.started(known.shape, start), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(net.flat)
    shape, tokens = known.shape, known.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(shape, shared.value)
        for batch, texts in batches_of(batches, 6):
            shares = recurrent.scores(own, [t & (EDGE - 1) for t in texts])
            total = pa.array(shares + batch.column(5).to_numpy())
            names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), total], names=names)

    scored = found.select("id", "held_out", "n_tokens", "n_known", "base_score", "within", "symbols").mapInArrow(
        run, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        F.col("id").alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op11_gated_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; nulls, ties, repeated rows and empty tables as ``score_language`` says."""
    return score_language(table(spark, sf_dir, "documents"))
