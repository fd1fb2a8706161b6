"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, state carried on.

Arrays of a time step are (units, texts), so that the parts of the gates are whole rows and every operation runs along the texts.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

#: Word 0 stands for all words outside the vocabulary and is the only one in class 0; word 1 is the end of a text.
RARE, END = 0, 1
LOG10 = float(np.log(10))
#: Logits held at once, at a few bytes each.
CELLS = 1 << 18


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """In place."""
    z *= z.dtype.type(0.5)
    np.tanh(z, out=z)
    z *= z.dtype.type(0.5)
    z += z.dtype.type(0.5)
    return z


def class_edges(words: int, classes: int) -> np.ndarray:
    """Where the classes of words in falling frequency begin, and the end: widths grow with the square root of the rank, which
    for words whose frequency falls as their rank rises makes the sum over texts of all widths smallest."""
    return np.unique(np.round(words * (np.arange(classes + 1) / classes) ** 2).astype(np.int64))


class Gru:
    """Words from 1 on are dealt to classes in order (most frequent first).

    x: input terms of the three gates by word; b: their bias; u: recurrent weights; c, d: class logits; w, v: a word's logit
    within its class.
    """

    NAMES = ("x", "b", "u", "c", "d", "w", "v")

    def __init__(self, words: int, hidden: int = 16, classes: int | None = None, seed: int = 1):
        self.words, self.hidden = words, hidden
        inner = max(1, words - 1)
        self.edges = class_edges(inner, classes or max(1, round(0.65 * math.sqrt(inner))))
        self.classes = len(self.edges)
        self.of_word = np.concatenate([[0], np.repeat(np.arange(1, self.classes), np.diff(self.edges))])
        rng = np.random.default_rng(seed)
        shapes = {"x": (words, 3 * hidden), "b": (3 * hidden,), "u": (hidden, 3 * hidden), "c": (self.classes, hidden), "d": (self.classes,), "w": (inner, hidden), "v": (inner,)}
        self.p = {k: (rng.normal(0, 0.1 if len(s) > 1 else 0, s)).astype(np.float32) for k, s in shapes.items()}

    def unigram(self, counts: np.ndarray) -> Gru:
        """Begin where each word has its share of the counts (by number), whatever came before it."""
        counts = counts + 0.5
        of_class = np.bincount(self.of_word, counts, self.classes)
        self.p["d"] = np.log(of_class / counts.sum()).astype(np.float32)
        self.p["v"] = np.log(counts[1:] / of_class[self.of_word[1:]]).astype(np.float32)
        return self

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.NAMES])

    def load(self, vector: np.ndarray) -> Gru:
        at = 0
        for k in self.NAMES:
            n = self.p[k].size
            self.p[k] = np.array(vector[at : at + n], np.float32).reshape(self.p[k].shape)
            at += n
        return self

    def step(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """From the input terms (3 units, texts) and the state: the new state, the gates, the candidate, its recurrent term."""
        n = self.hidden
        r = self.p["u"].T @ h
        gates = _sigmoid(a[: 2 * n] + r[: 2 * n])
        new = gates[:n] * r[2 * n :]
        new += a[2 * n :]
        np.tanh(new, out=new)
        out = h - new
        out *= gates[n:]
        out += new
        return out, gates, new, r[2 * n :]

    def _classes_of(self, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Rows in the order of their classes, without those of class 0; and (class, first, last) of each class that stands there."""
        some = np.argsort(cls, kind="stable")
        some = some[np.searchsorted(cls[some], 1) :]
        found, begin = np.unique(cls[some], return_index=True)
        return some, list(zip(found.tolist(), begin.tolist(), np.append(begin, len(some))[1:].tolist(), strict=True))

    def log_probability(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability after its state, a row of h."""
        cls = self.of_word[words]
        out = np.empty(len(words), h.dtype)
        rows = max(1, CELLS // self.classes)
        for i in range(0, len(words), rows):
            out[i : i + rows] = _log_softmax(self.p["c"], self.p["d"], h[i : i + rows], cls[i : i + rows])
        some, groups = self._classes_of(cls)
        states, place = h[some], words[some] - 1
        for k, a, b in groups:
            lo, hi = self.edges[k - 1], self.edges[k]
            rows = max(1, CELLS // int(hi - lo))
            for i in range(a, b, rows):
                j = min(b, i + rows)
                out[some[i:j]] += _log_softmax(self.p["w"][lo:hi], self.p["v"][lo:hi], states[i:j], place[i:j] - lo)
        return out

    def score(self, texts: np.ndarray, counts: np.ndarray, window: int = 1 << 15) -> np.ndarray:
        """log10 probability of each whole text and its end.  ``texts``: word numbers of all texts in turn, without ends.

        Texts run side by side, the longest first, so that those still going are always the first columns; state is carried
        from step to step through each text to its end, and about ``window`` words of all texts are scored together.
        """
        order = np.argsort(-counts, kind="stable")
        begin = (np.cumsum(counts) - counts)[order]
        steps = counts[order] + 1
        total = np.zeros(len(counts))
        padded = np.append(texts, END)
        terms = self.p["x"] + self.p["b"]
        longest = int(steps[0]) if len(steps) else 0
        lives = np.searchsorted(-steps, -np.arange(longest + 1), side="left")
        h, words = np.zeros((self.hidden, len(counts)), np.float32), np.full(len(counts), END)
        states, targets, held = [], [], 0
        for t in range(longest):
            live, going = int(lives[t]), int(lives[t + 1])
            h = self.step(terms[words[:live]].T, h[:, :live])[0]
            words = padded[begin[:live] + t]
            words[going:] = END
            states.append(h.T)
            targets.append(words)
            held += live
            if held >= window or t == longest - 1:
                found = self.log_probability(np.concatenate(states), np.concatenate(targets))
                total += np.bincount(np.concatenate([np.arange(len(x)) for x in targets]), found, len(total))
                states, targets, held = [], [], 0
        out = np.empty(len(total))
        out[order] = total / LOG10
        return out

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, live: np.ndarray, fresh: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Loss (summed over live targets), its gradient by backpropagation through the window, and the state after it.
        inputs, targets, live, fresh: (time, texts); h: (units, texts); where ``fresh``, a text begins, with a state of zeros."""
        loss, some, h = self.sparse_gradient(inputs, targets, h, live, np.zeros(live.shape, bool) if fresh is None else fresh)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        for k, (rows, values) in some.items():
            g[k][rows] = values
        return loss, g, h

    def sparse_gradient(self, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray, live: np.ndarray, fresh: np.ndarray) -> tuple[float, dict[str, tuple], np.ndarray]:
        """As ``gradient``, with (rows, their gradients) of each parameter: only of words and classes that stand in the window."""
        steps, m, n, kind = *inputs.shape, self.hidden, self.p["x"].dtype
        flat, on = inputs.ravel(), (~fresh).astype(kind)
        a = np.ascontiguousarray((self.p["x"][flat] + self.p["b"]).reshape(steps, m, 3 * n).transpose(0, 2, 1))
        before, after, new, rn = np.empty((4, steps, n, m), kind)
        gates = np.empty((steps, 2 * n, m), kind)
        for t in range(steps):
            np.multiply(h, on[t], out=before[t])
            h, gates[t], new[t], rn[t] = self.step(a[t], before[t])
            after[t] = h
        states, weight = after.transpose(0, 2, 1).reshape(-1, n), live.ravel().astype(kind)
        words = targets.ravel()
        cls = self.of_word[words]
        loss, dh_all = 0.0, np.empty_like(states)
        dc, dd = np.zeros_like(self.p["c"]), np.zeros_like(self.p["d"])
        rows = max(1, CELLS // self.classes)
        for i in range(0, len(words), rows):
            own, on_it = states[i : i + rows], weight[i : i + rows]
            right, dz = _softmax(self.p["c"], self.p["d"], own, cls[i : i + rows])
            loss -= float((np.log(right) * on_it).sum())
            dz *= on_it
            dc += dz @ own
            dd += dz.sum(1)
            np.matmul(dz.T, self.p["c"], out=dh_all[i : i + rows])
        g = {"c": (slice(None), dc), "d": (slice(None), dd)}
        some, groups = self._classes_of(np.where(weight > 0, cls, 0))
        own, place, chance, dh_own = states[some], words[some] - 1, np.empty(len(some), kind), np.empty((len(some), n), kind)
        dw, dv = np.zeros_like(self.p["w"]), np.zeros_like(self.p["v"])
        for k, i, j in groups:
            lo, hi = int(self.edges[k - 1]), int(self.edges[k])
            w = self.p["w"][lo:hi]
            chance[i:j], dz = _softmax(w, self.p["v"][lo:hi], own[i:j], place[i:j] - lo)
            np.matmul(dz, own[i:j], out=dw[lo:hi])
            dz.sum(1, out=dv[lo:hi])
            np.matmul(dz.T, w, out=dh_own[i:j])
        loss -= float(np.log(chance).sum())
        dh_all[some] += dh_own
        g["w"], g["v"] = (slice(None), dw), (slice(None), dv)
        dh_all = np.ascontiguousarray(dh_all.reshape(steps, m, n).transpose(0, 2, 1))
        reset, keep = gates[:, :n], gates[:, n:]
        to_new = (1 - keep) * (1 - new * new)
        to_keep = (before - new) * keep * (1 - keep)
        to_reset = rn * reset * (1 - reset)
        dh = np.zeros_like(h)
        da, dr = np.empty((2, steps, 3 * n, m), kind)
        for t in range(steps - 1, -1, -1):
            dh += dh_all[t]
            d_new = np.multiply(dh, to_new[t], out=da[t, 2 * n :])
            np.multiply(dh, to_keep[t], out=da[t, n : 2 * n])
            np.multiply(d_new, to_reset[t], out=da[t, :n])
            dr[t, : 2 * n] = da[t, : 2 * n]
            np.multiply(d_new, reset[t], out=dr[t, 2 * n :])
            dh *= keep[t]
            dh += self.p["u"] @ dr[t]
            dh *= on[t]
        found = np.flatnonzero(np.bincount(flat, minlength=self.words))
        place = np.empty(self.words, np.int64)
        place[found] = np.arange(len(found))
        place, dx = place[flat], np.empty((len(found), 3 * n), kind)
        for k in range(3 * n):
            dx[:, k] = np.bincount(place, da[:, k].ravel(), len(found))
        g["x"] = (found, dx)
        g["b"], g["u"] = (slice(None), da.sum((0, 2))), (slice(None), np.matmul(before, dr.transpose(0, 2, 1)).sum(0))
        return loss, g, h

    def tables(self) -> list[np.ndarray]:
        """The parameters as tables whose rows are learnt together: a row a word (as input), a row a word (as output), and one of
        all others."""
        one_row = np.concatenate([self.p[k].ravel() for k in ("b", "u", "c", "d")])[None]
        return [self.p["x"], np.concatenate([self.p["w"], self.p["v"][:, None]], 1), one_row]

    def load_tables(self, tables: list[np.ndarray]) -> Gru:
        self.p["x"] = np.asarray(tables[0], np.float32)
        self.p["w"], self.p["v"] = tables[1][:, :-1].astype(np.float32), tables[1][:, -1].astype(np.float32)
        at = 0
        for k in ("b", "u", "c", "d"):
            self.p[k] = tables[2][0, at : at + self.p[k].size].astype(np.float32).reshape(self.p[k].shape)
            at += self.p[k].size
        return self


def _logits(weights: np.ndarray, bias: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(choices, rows), less the largest of each row."""
    z = weights @ h.T
    z += bias[:, None]
    z -= z.max(0)
    return z


def _log_softmax(weights: np.ndarray, bias: np.ndarray, h: np.ndarray, right: np.ndarray) -> np.ndarray:
    z = _logits(weights, bias, h)
    own = z[right, np.arange(len(right))]
    return own - np.log(np.exp(z, out=z).sum(0))


def _softmax(weights: np.ndarray, bias: np.ndarray, h: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chance of the right choice of each row, and the derivatives of the loss by the logits, as (choices, rows)."""
    z, at = _logits(weights, bias, h), np.arange(len(right))
    np.exp(z, out=z)
    z /= z.sum(0)
    chance = z[right, at]
    z[right, at] = chance - 1
    return np.maximum(chance, 1e-30), z


class Adam:
    """Adam; the input terms of words that a window lacks are left alone by it, and each of those rows counts its own steps."""

    def __init__(self, model: Gru, rate: float):
        self.model, self.rate, self.steps = model, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in model.p.items()}
        self.t = np.zeros((model.words, 1), np.float32)

    def update(self, g: dict[str, tuple], n: float) -> None:
        self.steps += 1
        for k, (rows, d) in g.items():
            d *= np.float32(1 / n)
            np.clip(d, -1, 1, out=d)
            some = isinstance(rows, np.ndarray)
            if some:
                self.t[rows] += 1
            t = self.t[rows] if some else np.float32(self.steps)
            m, s = self.m[k][rows], self.s[k][rows]  # copies of some rows, or the whole itself
            m *= np.float32(0.9)
            m += np.float32(0.1) * d
            s *= np.float32(0.999)
            d *= d
            d *= np.float32(0.001)
            s += d
            np.sqrt(s, out=d)
            d += np.float32(1e-8)
            np.divide(m, d, out=d)
            d *= np.float32(self.rate) * np.sqrt(1 - np.float32(0.999) ** t) / (1 - np.float32(0.9) ** t)
            self.model.p[k][rows] -= d
            if some:
                self.m[k][rows], self.s[k][rows] = m, s


def _lanes(pieces: list[np.ndarray], lanes: int) -> list[list[np.ndarray]]:
    """Pieces dealt to lanes of nearly the same number of words, the longest lane last."""
    out: list[list[np.ndarray]] = [[] for _ in range(lanes)]
    heap = [(0, i) for i in range(lanes)]
    for p in sorted(pieces, key=len, reverse=True):
        size, i = heap[0]
        heapq.heapreplace(heap, (size + len(p) - 1, i))
        out[i].append(p)
    return sorted(out, key=lambda lane: sum(map(len, lane)) - len(lane))


def train(model: Gru, pieces: list[np.ndarray], rate: float, epochs: int = 1, batch: int = 64, window: int = 32, adam: Adam | None = None) -> float:
    """Truncated backpropagation over texts or pieces of them (a word before, then words to predict), each to its end.
    ``batch`` lanes run side by side, in which one text follows another; the state begins anew with a text and is carried
    from window to window, the gradient is not.  Returns the last epoch's mean loss."""
    adam, loss, n = adam or Adam(model, rate), 0.0, 1
    pieces = [p for p in pieces if len(p) > 1]
    order = np.random.default_rng(7)
    lanes = _lanes(pieces, min(batch, len(pieces))) if pieces else []
    sizes = np.array([sum(len(p) - 1 for p in lane) for lane in lanes])
    for _ in range(epochs):
        loss, n = 0.0, 0
        texts = [[lane[i] for i in order.permutation(len(lane))] for lane in lanes]
        inputs = [np.concatenate([p[:-1] for p in lane]) for lane in texts]
        targets = [np.concatenate([p[1:] for p in lane]) for lane in texts]
        begins = [starts_of(lane) for lane in texts]
        h = np.zeros((model.hidden, len(lanes)), np.float32)
        for t in range(0, int(sizes[-1]) if len(lanes) else 0, window):
            first = int(np.searchsorted(sizes, t, side="right"))  # lanes before it have ended
            steps = min(window, int(sizes[-1]) - t)
            words, next_words = np.full((2, steps, len(lanes) - first), END, np.int64)
            live, fresh = np.zeros((2, steps, len(lanes) - first), bool)
            for j in range(first, len(lanes)):
                m = min(steps, int(sizes[j]) - t)
                words[:m, j - first], next_words[:m, j - first], live[:m, j - first] = inputs[j][t : t + m], targets[j][t : t + m], True
                fresh[:m, j - first] = begins[j][t : t + m]
            one, g, h = model.sparse_gradient(words, next_words, h[:, h.shape[1] - len(lanes) + first :], live, fresh)
            some = int(live.sum())
            adam.update(g, some)
            loss, n = loss + one, n + some
    return loss / max(1, n)


def starts_of(texts: list[np.ndarray]) -> np.ndarray:
    """Marks the first word of each text in their words in a row."""
    sizes = np.array([len(p) - 1 for p in texts])
    out = np.zeros(int(sizes.sum()), bool)
    out[np.cumsum(sizes) - sizes] = True
    return out
