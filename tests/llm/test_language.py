import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import recurrent
from palimpsest.llm.language import (
    EDGE,
    FIRST,
    UNKNOWN,
    Vocabulary,
    counts_of,
    learned,
    score_language,
    size_class,
    vocabulary,
    word_key,
    words_of,
)
from palimpsest.llm.recurrent import HIDDEN, Network, Shape

SHAPE = Shape(4, (6, 9, 10, 17))


def network(seed=0):
    net = Network.started(SHAPE, np.arange(SHAPE.symbols) + 1.0)
    net.flat[:] = np.random.default_rng(seed).normal(0, 0.5, len(net.flat))
    return net


def shares(net, state):
    """The share of every symbol, by plain sums."""
    p = {k: v.astype(np.float64) for k, v in net.parts.items()}
    classes = np.exp(p["classes"] @ state + p["class_bias"][:, 0])
    classes /= classes.sum()
    out = classes[net.class_of]
    for a, b in zip((SHAPE.single, *SHAPE.ends), SHAPE.ends, strict=False):
        words = np.exp(p["words"][a:b] @ state + p["word_bias"][a:b, 0])
        out[a:b] *= words / words.sum()
    return out


def step(net, state, symbol):
    p = {k: v.astype(np.float64) for k, v in net.parts.items()}
    x, a, k = p["embed"][symbol], p["recur"] @ state, HIDDEN
    z, r = (1 / (1 + np.exp(-(x + a)[i * k : (i + 1) * k])) for i in (0, 1))
    new = np.tanh(x[2 * k :] + r * a[2 * k :])
    return (1 - z) * new + z * state


def texts(rng, n, longest):
    return [np.array([*rng.integers(1, SHAPE.symbols, rng.integers(0, longest)), 0], np.int16) for _ in range(n)]


@pytest.mark.parametrize("n, longest", [(1, 1), (3, 100), (700, 40)])
def test_whole_texts_against_single_steps(n, longest):
    net, given = network(), texts(np.random.default_rng(n), n, longest)
    want = []
    for text in given:
        state, total, before = np.zeros(HIDDEN), 0.0, 0
        for symbol in text:
            state = step(net, state, before)
            found = shares(net, state)
            assert abs(found.sum() - 1) < 1e-9
            total += math.log10(found[symbol])
            before = symbol
        want.append(total)
    assert np.allclose(recurrent.scores(net, given), want, rtol=1e-4, atol=1e-3)
    # A text's score doesn't depend on the texts beside it.
    assert np.allclose(recurrent.scores(net, given[:1]), want[:1], rtol=1e-4, atol=1e-3)


def test_gradients_against_differences():
    rng = np.random.default_rng(5)
    net = network(1)
    net.flat *= 0.3
    inputs, targets = rng.integers(0, SHAPE.symbols, (6, 5)), rng.integers(-1, SHAPE.symbols, (6, 5))
    state = rng.normal(0, 0.5, (HIDDEN, 5)).astype(np.float32)

    def loss(flat):
        states = Network(SHAPE, flat).states(inputs, state).reshape(HIDDEN, -1)
        return -float(Network(SHAPE, flat).log_shares(states, targets.ravel())[0].sum(dtype=float)) / (targets >= 0).sum()

    grad, total, last = net.gradients(inputs, targets, state)
    assert abs(-total / (targets >= 0).sum() - loss(net.flat)) < 1e-5
    for _ in range(12):  # along random directions, for single weights are lost in rounding
        way = rng.normal(0, 1, len(grad)).astype(np.float32)
        way /= np.linalg.norm(way)
        slope = (loss(net.flat + 0.02 * way) - loss(net.flat - 0.02 * way)) / 0.04
        assert abs(slope - float(grad @ way)) < 2e-3 + 0.02 * abs(slope)
    assert last.shape == (HIDDEN, 5)


def test_training_learns_what_follows():
    rng = np.random.default_rng(2)

    def text():
        out, symbol = [], 4
        for _ in range(60):
            symbol = int(rng.choice([4 + (symbol - 3) % 13, rng.integers(1, 17)], p=[0.9, 0.1]))
            out.append(symbol)
        return np.array([*out, 0], np.int16)

    given, others = [text() for _ in range(600)], [text() for _ in range(50)]
    net = Network.started(SHAPE, np.bincount(np.concatenate(given), minlength=SHAPE.symbols))
    before, squares = recurrent.scores(net, others).sum(), np.zeros_like(net.flat)
    for _ in range(5):
        recurrent.train(net, squares, given)
    assert recurrent.scores(net, others).sum() > 0.7 * before  # log shares are below 0


def test_lanes_hold_each_text_once():
    lengths = np.random.default_rng(3).integers(1, 500, 1000)
    own = recurrent.lanes(lengths)
    assert sorted(np.concatenate(own)) == list(range(1000))
    sizes = [lengths[x].sum() for x in own]
    assert sizes == sorted(sizes, reverse=True) and sizes[0] - sizes[-1] <= 500


def model(rows):
    held = {i: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for i, (d, _) in enumerate(rows)}
    tokens = [[*words_of((t or "").encode()), b""] for _, t in rows]
    counts = Counter(w for i, t in enumerate(tokens) if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    return [
        (rows[i][0], held[i], len(t), sum(w in counts for w in t), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        for i, t in enumerate(tokens)
    ], counts


def corpus(rng, n):
    pool = [f"w{i}" for i in range(300)] + ["É", "a" * 100, "Zwei", "zwei", "x y", "퟿"]
    out = []
    for i in range(n):
        start, words = rng.randrange(40), []
        for _ in range(rng.choice([0, 1, 30, 60])):
            start = (start + 1) % 40 if rng.random() < 0.8 else rng.randrange(len(pool))
            words.append(pool[start])
        words += [f"only{i}"] * (i % 3)
        out.append((i, rng.choice([" ", "\n", "\x0b "]).join(words)))
    return out


def test_counts_and_base_against_brute_force(spark):
    rng = random.Random(4)
    rows = [*corpus(rng, 300), (None, "w1 w2"), (None, None), (5, None), (6, ""), (6, "w1 new new"), (16, "unseen " * 3000)]
    rows += [rows[3]] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as symbols")
    got = score_language(frame.repartition(3)).collect()
    want, _ = model(rows)

    def plain(rows):
        return sorted((repr(tuple(r)[:5]), round(r[5], 6)) for r in rows)

    assert plain(got) == plain(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    same = {r["score"] for r in got if r["doc_id"] == 3}
    assert max(same) - min(same) < 1e-3
    # What it learned from is better told than by counts alone, and so is what it didn't.
    for side in (True, False):
        assert sum(r["score"] - r["base_score"] for r in got if r["held_out"] == side and r["doc_id"] != 16) > 0


def test_rare_words_are_looked_up(spark):
    rows = corpus(random.Random(6), 120)
    _, counts = model(rows)
    held = [t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    found = counts_of(spark.createDataFrame([(t.encode(),) for t in held], "body binary"))
    for head in (1, 10, 10_000):
        known, once = vocabulary(found, head=head, words=8, least=5)
        assert known.tokens == sum(counts.values()) and known.distinct == len(counts)
        assert len(known.keys) <= head and once == sum(n == 1 for n in counts.values())
        assert all(counts[next(w for w in counts if word_key(w) == k)] == n for k, n in zip(known.keys, known.counts, strict=True))
        own = set(known.keys[: known.own])
        for size, total in enumerate(known.of_class):
            assert total == sum(n for w, n in counts.items() if w and word_key(w) not in own and size_class(n) == size)


def test_symbols_by_count():
    known = Vocabulary(10, 3, 1, [], np.zeros(0, np.int64), 0, np.ones(5, np.int64), Shape(7, ()))
    counts = np.array([0, 1, 2, 7, 8, 9, 63, 64, 65, 511, 512])
    symbols = known.symbol(counts)
    assert ((symbols & (EDGE - 1)) == [UNKNOWN, *(FIRST + np.array([0, 0, 0, 1, 1, 1, 2, 2, 2, 3]))]).all()
    less = [UNKNOWN if n <= 1 else FIRST + size_class(int(n) - 1) for n in counts]
    assert (learned(symbols) == less).all()


def test_empty_tables(spark):
    assert score_language(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = score_language(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert [tuple(r)[:5] for r in got] == [(held, True, 3, 0, 0)] and math.isfinite(got[0]["score"])
    assert got[0]["base_score"] == 0
