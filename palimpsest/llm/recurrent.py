"""A gated recurrent language model in numpy: states and their gradients over windows, a softmax factored by classes.

Symbols are numbers below ``Shape.symbols``: first those that are a class of their own, then words by class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Units of the state; steps of a window; texts side by side.
HIDDEN, WINDOW, LANES = 16, 16, 256
#: Step size and what is added to the sums of squares.
RATE, SMALL = 0.1, 1e-8
LOG10 = 1 / np.log(10)

_F = np.float32


@dataclass(frozen=True)
class Shape:
    """``single`` symbols are a class each; ``ends[i]`` is one beyond the last symbol of the i-th class of words."""

    single: int
    ends: tuple[int, ...]

    @property
    def symbols(self) -> int:
        return self.ends[-1] if self.ends else self.single

    @property
    def classes(self) -> int:
        return self.single + len(self.ends)

    def class_of(self) -> np.ndarray:
        out = np.arange(self.symbols)
        for i, (a, b) in enumerate(zip((self.single, *self.ends), self.ends, strict=False)):
            out[a:b] = self.single + i
        return out.astype(np.int16)

    def sizes(self) -> dict[str, tuple[int, ...]]:
        return {
            "embed": (self.symbols, 3 * HIDDEN),
            "recur": (3 * HIDDEN, HIDDEN),
            "classes": (self.classes, HIDDEN),
            "class_bias": (self.classes, 1),
            "words": (self.symbols, HIDDEN),
            "word_bias": (self.symbols, 1),
        }


class Network:
    """Weights by name, all views of one flat array, so that weights of several fits can be averaged."""

    def __init__(self, shape: Shape, flat: np.ndarray | None = None):
        self.shape, self.class_of = shape, shape.class_of()
        sizes = shape.sizes()
        total = sum(int(np.prod(s)) for s in sizes.values())
        self.flat = np.zeros(total, _F) if flat is None else np.array(flat, dtype=_F)
        self.parts = self._views(self.flat)

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, size in self.shape.sizes().items():
            n = int(np.prod(size))
            out[name] = flat[at : at + n].reshape(size)
            at += n
        return out

    @classmethod
    def started(cls, shape: Shape, counts: np.ndarray) -> Network:
        """Small fixed random weights; biases give each symbol the share that ``counts`` says, whatever the state."""
        net, draw = cls(shape), np.random.default_rng(11)
        for name in ("embed", "recur", "classes", "words"):
            net.parts[name][:] = draw.normal(0, 0.1 if name == "embed" else 0.3 if name == "recur" else 0.05, net.parts[name].shape)
        counts = np.maximum(np.asarray(counts, np.float64), 0.5)
        by_class = np.bincount(net.class_of, counts, shape.classes)
        net.parts["class_bias"][:, 0] = np.log(by_class / counts.sum())
        net.parts["word_bias"][:, 0] = np.log(counts / by_class[net.class_of])
        return net

    def states(self, inputs: np.ndarray, state: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """The states (HIDDEN, steps, texts) after each step of ``inputs`` (steps, texts), from ``state`` (HIDDEN, texts);
        the start symbol 0 forgets it first. Units come first in all arrays, so that gates are contiguous."""
        k, recur = HIDDEN, self.parts["recur"]
        steps, n = inputs.shape
        gates = np.ascontiguousarray(self.parts["embed"].take(inputs.ravel(), axis=0).reshape(steps, n, 3 * k).transpose(0, 2, 1))
        sums = np.empty((steps, 3 * k, n), _F)
        before, after = np.empty((k, steps, n), _F), np.empty((k, steps, n), _F)
        starts = inputs == 0
        any_start = starts.any(axis=1)
        h = state
        for t in range(steps):
            if any_start[t]:
                h = h * ~starts[t]
            before[:, t] = h
            np.matmul(recur, h, out=sums[t])
            pair, new = gates[t, : 2 * k], gates[t, 2 * k :]
            pair += sums[t, : 2 * k]
            np.negative(pair, pair)
            np.exp(pair, pair)
            pair += 1
            np.reciprocal(pair, pair)
            new += pair[k:] * sums[t, 2 * k :]
            np.tanh(new, new)
            h = h - new
            h *= pair[:k]
            h += new
            after[:, t] = h
        if trace is not None:
            trace |= {"before": before, "gates": gates, "inner": sums[:, 2 * k :]}
        return after

    def log_shares(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each target's share, given the states (HIDDEN, n); 0 for targets below 0. With ``grads``, adds
        the gradients of the negated sum to them and returns the gradient of the states as well."""
        parts, size = self.parts, len(targets)
        order = np.argsort(np.where(targets < 0, -1, self.class_of.take(targets)), kind="stable")
        order = order[np.count_nonzero(targets < 0) :]
        targets, states = targets.take(order), states.take(order, axis=1)
        of = self.class_of.take(targets)
        n = np.arange(len(targets))
        logits = parts["classes"] @ states
        found, total = _normalise(logits, parts["class_bias"], of, n)
        toward = None
        if grads is not None:
            logits /= total
            logits[of, n] -= 1
            grads["classes"] += logits @ states.T
            grads["class_bias"] += logits.sum(axis=1, keepdims=True)
            toward = parts["classes"].T @ logits
        bounds = np.searchsorted(of, np.arange(self.shape.single, self.shape.classes + 1))
        for i, (a, b) in enumerate(zip((self.shape.single, *self.shape.ends), self.shape.ends, strict=False)):
            own = slice(bounds[i], bounds[i + 1])
            if bounds[i] == bounds[i + 1] or b - a == 1:
                continue
            weights, at = parts["words"][a:b], targets[own] - a
            logits = weights @ states[:, own]
            m = n[: logits.shape[1]]
            shares, total = _normalise(logits, parts["word_bias"][a:b], at, m)
            found[own] += shares
            if grads is not None:
                logits /= total
                logits[at, m] -= 1
                grads["words"][a:b] += logits @ states[:, own].T
                grads["word_bias"][a:b] += logits.sum(axis=1, keepdims=True)
                toward[:, own] += weights.T @ logits
        out = np.zeros(size, _F)
        out[order] = found
        if toward is not None:
            back = np.zeros((HIDDEN, size), _F)
            back[:, order] = toward
            toward = back
        return out, toward

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """(flat gradient of the mean negated log share, sum of log shares, last state) of one window, by backpropagation
        that ends at the window's start."""
        steps, n = inputs.shape
        k, flat = HIDDEN, np.zeros_like(self.flat)
        grads, trace = self._views(flat), {}
        states = self.states(inputs, state, trace)
        found, toward = self.log_shares(states.reshape(k, -1), targets.ravel(), grads)
        toward = toward.reshape(k, steps, n)
        recur_t = np.ascontiguousarray(self.parts["recur"].T)
        starts = inputs == 0
        any_start = starts.any(axis=1)
        # Of what a step adds to its gates, and of what the state adds to them.
        on_sum, on_recur = np.empty((3 * k, steps, n), _F), np.empty((3 * k, steps, n), _F)
        later = np.zeros((k, n), _F)
        for t in range(steps - 1, -1, -1):
            later += toward[:, t]
            z, r, new = trace["gates"][t, :k], trace["gates"][t, k : 2 * k], trace["gates"][t, 2 * k :]
            rest = 1 - z
            dn = later * rest
            dn *= 1 - new * new
            dz = trace["before"][:, t] - new
            dz *= later
            dz *= z
            dz *= rest
            dan = dn * r
            dr = dan * trace["inner"][t]
            dr *= 1 - r
            on_sum[:k, t], on_sum[k : 2 * k, t], on_sum[2 * k :, t] = dz, dr, dn
            da = np.concatenate((dz, dr, dan))
            on_recur[:, t] = da
            later *= z
            later += recur_t @ da
            if any_start[t]:
                later *= ~starts[t]
        grads["recur"] += on_recur.reshape(3 * k, -1) @ trace["before"].reshape(k, -1).T
        symbols = inputs.ravel().astype(np.int64)
        for i, row in enumerate(on_sum.reshape(3 * k, -1)):
            grads["embed"][:, i] = np.bincount(symbols, row, self.shape.symbols)
        flat /= max(1, np.count_nonzero(targets >= 0))
        return flat, float(found.sum(dtype=np.float64)), states[:, -1]


def _normalise(logits: np.ndarray, bias: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log shares of row at[i] of column i, sums of columns) of a softmax over rows; logits become their exponentials."""
    logits += bias
    logits -= logits.max(axis=0)
    found = logits[at, n]
    np.exp(logits, logits)
    total = logits.sum(axis=0)
    found -= np.log(total)
    return found, total


def lanes(lengths: np.ndarray, most: int = LANES) -> list[np.ndarray]:
    """Texts by lane, longest lane first: each text, from the longest, goes whole to the lane that is shortest so far."""
    import heapq

    heap = [(0, i) for i in range(max(1, min(most, len(lengths))))]
    own: list[list[int]] = [[] for _ in heap]
    total = [0] * len(heap)
    for text in np.argsort(-lengths, kind="stable").tolist():
        size, i = heapq.heappop(heap)
        own[i].append(text)
        total[i] = size + int(lengths[text])
        heapq.heappush(heap, (total[i], i))
    return [np.array(own[i]) for i in sorted(range(len(own)), key=lambda i: -total[i])]


def windows(texts: list[np.ndarray], whole: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(inputs, targets, text of each target, lanes that go on) of windows over all texts, which end with symbol 0 each.

    Inputs are the symbols before the targets; that of a text's first is 0. With ``whole`` each text is in one lane, else
    their sequence is cut into even lanes. Lanes end in order, so that a window's lanes are the first of those of the
    window before. Beyond a lane's end targets are -1 and their text is len(texts)."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    if whole:
        order = lanes(lengths)
        size = np.array([lengths[lane].sum() for lane in order])
        order = np.concatenate(order)
    else:
        order, total = np.arange(len(texts)), int(lengths.sum())
        size = np.diff(np.minimum(np.arange(LANES + 1) * -(-total // LANES), total))
    flat = np.concatenate([[0], *(texts[i] for i in order), [-1]]).astype(np.int16)
    owner = np.append(np.repeat(order, lengths[order]), len(texts)).astype(np.int32)
    start = np.cumsum(size) - size
    for at in range(0, int(size[0]), WINDOW):
        active = int((size > at).sum())
        step = np.arange(at, min(at + WINDOW, int(size[0])))[:, None]
        where = np.where(step < size[:active], start[:active] + step, len(flat) - 2)
        yield np.maximum(flat[where], 0), flat[where + 1], owner[where], active


def scores(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    """The log10 share of each whole text; states are carried from window to window and begin anew with each text."""
    out = np.zeros(len(texts))
    state = np.zeros((HIDDEN, LANES), _F)
    for inputs, targets, owner, active in windows(texts) if texts else ():
        states = net.states(inputs, state[:, :active])
        state = states[:, -1]
        found, _ = net.log_shares(states.reshape(HIDDEN, -1), targets.ravel())
        out += np.bincount(owner.ravel(), found, len(texts) + 1)[:-1]
    return out * LOG10


def train(net: Network, squares: np.ndarray, texts: list[np.ndarray], rate: float = RATE) -> float:
    """One pass over the texts, in place: a step for each window, every weight's scaled by the root of its sum of squared
    gradients. A text that two lanes share starts without a state in the second. Returns the summed natural log share of
    what was still to be learned from."""
    total, state = 0.0, np.zeros((HIDDEN, LANES), _F)
    for inputs, targets, _, active in windows(texts, whole=False) if texts else ():
        grad, found, state = net.gradients(inputs, targets, state[:, :active])
        total += found
        squares += grad * grad
        net.flat -= rate * grad / (np.sqrt(squares) + SMALL)
    return total
