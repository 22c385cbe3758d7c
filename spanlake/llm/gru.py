"""A gated recurrent language model with a class-factored output, in NumPy (used inside tasks).

A symbol is one of the vocabulary's words or one of its tail classes. Words come in classes of ``CLASS`` by rank of frequency.
The probability of a symbol is that of its class, given the state, times that of the word within its class; a tail class has
no second factor here. The input is one row of a table per symbol, which takes the place of embedding times input weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Words of a class, width of the state.
CLASS, WIDTH = 64, 16
#: Steps that gradients go back through, streams side by side, step size of Adagrad, largest norm of a gradient.
STEPS, LANES, RATE, CLIP = 16, 256, 0.08, 5.0
#: Sequences scored side by side, and states whose classes are rated at a time, so that the logits fit the cache.
GROUP, ROWS = 512, 2048

NAMES = ("table", "turn", "class_w", "class_b", "word_w", "word_b")


_HALF, _ONE = np.float32(0.5), np.float32(1)


def _softsign(x: np.ndarray) -> np.ndarray:
    out = np.abs(x)
    out += _ONE
    return np.divide(x, out, out=out)


@dataclass
class Shape:
    """Numbers of words and tail classes. Symbols are words, then tail classes; one more row of the input table stands for the
    start of a text."""

    words: int
    tails: int

    @property
    def word_classes(self) -> int:
        return -(-self.words // CLASS)

    @property
    def classes(self) -> int:
        return self.word_classes + self.tails

    @property
    def start(self) -> int:
        return self.words + self.tails

    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {
            "table": (self.start + 1, 3 * WIDTH),
            "turn": (WIDTH, 3 * WIDTH),
            "class_w": (WIDTH, self.classes),
            "class_b": (self.classes,),
            "word_w": (self.word_classes * CLASS, WIDTH),
            "word_b": (self.word_classes * CLASS,),
        }

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.words, symbols // CLASS, symbols - self.words + self.word_classes)


class Model:
    """Parameters and, for each, Adagrad's sum of squares, as views of one flat array, which is what tasks exchange."""

    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, flat
        self.p, self.g2 = {}, {}
        at = 0
        for store in (self.p, self.g2):
            for name, size in shape.shapes().items():
                n = int(np.prod(size))
                store[name] = flat[at : at + n].reshape(size)
                at += n

    @staticmethod
    def start(shape: Shape, counts: np.ndarray, seed: int = 0) -> Model:
        """Before learning, the output is the symbols' share in ``counts`` whatever the state."""
        n = sum(int(np.prod(s)) for s in shape.shapes().values())
        model = Model(shape, np.zeros(2 * n, np.float32))
        rng = np.random.default_rng(seed)
        model.p["table"][:] = rng.normal(0, 0.3, model.p["table"].shape)
        model.p["turn"][:] = rng.normal(0, 1 / np.sqrt(WIDTH), model.p["turn"].shape)
        of_class = np.bincount(shape.class_of(np.arange(len(counts))), counts + 1.0, shape.classes)
        model.p["class_b"][:] = np.log(of_class / of_class.sum())
        model.p["word_b"][:] = -30.0  # places without a word
        words = counts[: shape.words] + 1.0
        model.p["word_b"][: shape.words] = np.log(words / of_class[np.arange(shape.words) // CLASS])
        for g2 in model.g2.values():
            g2[...] = 1e-6
        return model

    def step(self, x: np.ndarray, h: np.ndarray, trace: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The next state from the input rows and the state. ``trace`` gets (z, r, new, h turned) of the step, for the way back."""
        w = WIDTH
        u = h @ self.p["turn"]
        gates = _softsign(x[:, : 2 * w] + u[:, : 2 * w])
        gates *= _HALF
        gates += _HALF
        moved = gates[:, w:] * u[:, 2 * w :]
        moved += x[:, 2 * w :]
        new = _softsign(moved)
        if trace is not None:
            trace[0], trace[1], trace[2], trace[3] = gates[:, :w], gates[:, w:], new, u[:, 2 * w :]
        after = h - new
        after *= gates[:, :w]
        after += new
        return after, trace

    def _class_logits(self, states: np.ndarray) -> np.ndarray:
        logits = states @ self.p["class_w"]
        logits += self.p["class_b"]
        return logits

    def _members(self, symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
        """The rows of the word symbols, class by class, and for each class its words and its part of these rows."""
        words = np.flatnonzero(symbols < self.shape.words)
        of = (symbols[words] // CLASS).astype(np.uint16)  # sorted by radix
        order = words[np.argsort(of, kind="stable")]
        cuts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=self.shape.word_classes))]).tolist()
        parts = [(slice(c * CLASS, (c + 1) * CLASS), slice(a, b)) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        return order, parts

    def log_probability(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural logarithm of each symbol's probability in the state before it."""
        out = np.empty(len(symbols))
        own_class = self.shape.class_of(symbols)
        for at in range(0, len(symbols), ROWS):
            part = slice(at, at + ROWS)
            logits = self._class_logits(states[part])
            own = logits[np.arange(len(logits)), own_class[part]]
            out[part] = own - _log_sum(logits)
        order, parts = self._members(symbols)
        ordered, inside = states.take(order, axis=0), symbols[order] % CLASS
        of_word = np.empty(len(order), np.float32)
        for words, rows in parts:
            inner = ordered[rows] @ self.p["word_w"][words].T
            inner += self.p["word_b"][words]
            own = inner[np.arange(len(inner)), inside[rows]]
            of_word[rows] = own - _log_sum(inner)
        out[order] += of_word
        return out

    def learn(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, counted: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One step of truncated backpropagation over windows of (steps, lanes); returns the state after them.

        ``fresh`` marks texts' first symbols, before which the state is zero; where ``counted`` is false there is no symbol.
        """
        steps, lanes = inputs.shape
        w = WIDTH
        x = self.p["table"].take(inputs, axis=0)
        kept = (~fresh).astype(np.float32)[:, :, None]
        before, after = np.empty((steps, lanes, w), np.float32), np.empty((steps, lanes, w), np.float32)
        trace = np.empty((4, steps, lanes, w), np.float32)
        for t in range(steps):
            before[t] = h * kept[t]
            after[t] = self.step(x[t], before[t], trace[:, t])[0]
            h = after[t]
        states, symbols, weight = after.reshape(-1, w), targets.ravel(), counted.ravel()
        share = np.float32(1 / max(int(weight.sum()), 1))
        grads: dict[str, np.ndarray] = {}
        d_class = _softmax(self._class_logits(states))
        d_class[np.arange(len(symbols)), self.shape.class_of(symbols)] -= _ONE
        d_class *= (weight * share)[:, None]
        grads["class_w"], grads["class_b"] = states.T @ d_class, d_class.sum(0)
        d_states = d_class @ self.p["class_w"].T
        word_w, word_b = np.zeros_like(self.p["word_w"]), np.zeros_like(self.p["word_b"])
        order, parts = self._members(np.where(weight, symbols, self.shape.start))
        ordered, back = states.take(order, axis=0), np.empty((len(order), w), np.float32)
        d_word = np.empty((len(order), CLASS), np.float32)
        for words, rows in parts:
            np.matmul(ordered[rows], self.p["word_w"][words].T, out=d_word[rows])
            d_word[rows] += self.p["word_b"][words]
        _softmax(d_word)
        d_word[np.arange(len(order)), symbols[order] % CLASS] -= _ONE
        d_word *= share
        for words, rows in parts:
            d = d_word[rows]
            np.matmul(d.T, ordered[rows], out=word_w[words])
            d.sum(0, out=word_b[words])
            np.matmul(d, self.p["word_w"][words], out=back[rows])
        d_states[order] += back
        grads["word_w"], grads["word_b"] = word_w, word_b
        d_states = d_states.reshape(steps, lanes, w)
        z, r, new, inner = trace
        # slopes of the gates: that of a softsign is (1 - |value|)^2, that of a moved one half of it in 2 value - 1
        by_new = (_ONE - z) * (_ONE - np.abs(new)) ** 2
        by_z = (before - new) * (_HALF * (_ONE - np.abs(2 * z - _ONE)) ** 2)
        by_r = inner * (_HALF * (_ONE - np.abs(2 * r - _ONE)) ** 2)
        d_x, d_u = np.empty((steps, lanes, 3 * w), np.float32), np.empty((steps, lanes, 3 * w), np.float32)
        back = np.zeros((lanes, w), np.float32)
        turn_t = np.ascontiguousarray(self.p["turn"].T)
        for t in range(steps - 1, -1, -1):
            d_h = d_states[t] + back
            d_new = d_h * by_new[t]
            own = d_u[t]
            own[:, :w] = d_h * by_z[t]
            own[:, w : 2 * w] = d_new * by_r[t]
            own[:, 2 * w :] = d_new * r[t]
            d_x[t, :, 2 * w :] = d_new
            back = (d_h * z[t] + own @ turn_t) * kept[t]
        d_x[:, :, : 2 * w] = d_u[:, :, : 2 * w]
        grads["turn"] = before.reshape(-1, w).T @ d_u.reshape(-1, 3 * w)
        order = np.argsort(inputs.ravel().astype(np.uint16), kind="stable")  # symbols are two bytes; sorted by radix
        ordered = inputs.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        rows, d_table = ordered[first], np.add.reduceat(d_x.reshape(-1, 3 * w).take(order, axis=0), first, axis=0)
        norm = np.sqrt(sum(float((g * g).sum()) for g in [*grads.values(), d_table]))
        shrink = np.float32(min(1.0, CLIP / max(norm, 1e-12)))
        for name, g in grads.items():
            self._move(self.p[name], self.g2[name], slice(None), g * shrink)
        self._move(self.p["table"], self.g2["table"], rows, d_table * shrink)
        return h

    @staticmethod
    def _move(p: np.ndarray, g2: np.ndarray, at, g: np.ndarray) -> None:
        g2[at] += g * g
        p[at] -= np.float32(RATE) * g / np.sqrt(g2[at])

    def learn_texts(self, texts: list[np.ndarray]) -> None:
        """Passes once over symbol sequences, laid end to end and cut into ``LANES`` streams; states go on from window to window."""
        stream = np.concatenate(texts).astype(np.int64)
        fresh = np.zeros(len(stream), bool)
        fresh[np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])] = True
        inputs = np.where(fresh, self.shape.start, np.concatenate([[0], stream[:-1]]))
        length = -(-len(stream) // (LANES * STEPS)) * STEPS
        lay = lambda v, fill: np.pad(v, (0, LANES * length - len(v)), constant_values=fill).reshape(LANES, length).T
        inputs, targets = lay(inputs, self.shape.start), lay(stream, 0)
        fresh, counted = lay(fresh, True), lay(np.ones(len(stream), bool), False)
        h = np.zeros((LANES, WIDTH), np.float32)
        for t in range(0, length, STEPS):
            part = slice(t, t + STEPS)
            if counted[part].any():
                h = self.learn(inputs[part], targets[part], fresh[part], counted[part], h)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of the probability of each whole sequence; the state goes on from window to window to its end."""
        out = np.zeros(len(texts))
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), GROUP):
            own = order[at : at + GROUP]
            lengths = size[own]
            if not lengths[0]:
                break
            flat = np.concatenate([texts[i] for i in own]).astype(np.int64)
            begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            h = np.zeros((len(own), WIDTH), np.float32)
            symbol = np.full(len(own), self.shape.start)
            for t0 in range(0, lengths[0], 4 * STEPS):
                states, symbols, rows = [], [], []
                for t in range(t0, min(t0 + 4 * STEPS, lengths[0])):
                    live = int(np.searchsorted(-lengths, -t, side="left"))
                    h = self.step(self.p["table"].take(symbol[:live], axis=0), h[:live])[0]
                    symbol = flat[begin[:live] + t]
                    states.append(h)
                    symbols.append(symbol)
                    rows.append(own[:live])
                out += np.bincount(np.concatenate(rows), self.log_probability(np.concatenate(states), np.concatenate(symbols)), len(texts))
        return out


def _row_max(x: np.ndarray) -> np.ndarray:
    """The largest value of each row, by its place: quicker than the maximum itself for short rows."""
    return x[np.arange(len(x)), x.argmax(axis=1)]


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place."""
    if not len(logits):
        return logits
    logits -= _row_max(logits)[:, None]
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1)[:, None]
    return logits


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """The logarithm of each row's sum of exponentials; the logits are overwritten."""
    top = _row_max(logits)
    logits -= top[:, None]
    np.exp(logits, out=logits)
    return np.log(logits.sum(axis=1)) + top
