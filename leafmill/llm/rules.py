"""Quality rules: fixed rules, then gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.llm.common import documents, slices, strings
from leafmill.llm.stats import COUNTS, RATIOS, labelled_stats, text_stats

#: -1: the more of it, the lower the score may be, never higher.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "capital_words": -1, "bangs": -1}


@dataclass
class Trees:
    """All trees flattened into node arrays.  A leaf is its own child, so that every row takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 2.0, least: int = 10, monotone: dict[int, int] | None = None) -> Trees:
    """Second-order boosting of log loss on histograms.  A split on a constrained feature is taken only if its children's
    values are in order, and both sides are then held apart by the middle of the two, so that the whole sum is monotonic."""
    monotone = monotone or {}
    n, m = x.shape
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []
    mean = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)
        width = bins + 1
        flat = binned + np.arange(m) * width
        score = np.full(n, base)

        def add(**values) -> int:
            me = len(nodes["value"])
            for k, v in ({"feature": 0, "threshold": 0.0, "left": me, "right": me} | values).items():
                nodes[k].append(v)
            return me

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            leaf = float(np.clip(-sum_g / (sum_h + l2), low, high))
            if level == depth or len(rows) < 2 * least:
                return add(value=rate * leaf)
            where = flat[rows].ravel()
            hist = [np.bincount(where, np.repeat(w, m), m * width).reshape(m, width).cumsum(1) for w in (g[rows], h[rows], np.ones(len(rows)))]
            gl, hl, nl = (t[:, :-1] for t in hist)
            gr, hr, nr = sum_g - gl, sum_h - hl, len(rows) - nl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2) + (sum_g * leaf + 0.5 * (sum_h + l2) * leaf**2)
            gain[(nl < least) | (nr < least)] = -np.inf
            for j, sign in monotone.items():
                gain[j][sign * (vr[j] - vl[j]) < 0] = -np.inf
            j, b = divmod(int(gain.argmax()), gain.shape[1])
            if not gain[j, b] > 1e-6 or b >= len(cuts[j]):
                return add(value=rate * leaf)
            middle, sign = (vl[j, b] + vr[j, b]) / 2, monotone.get(j, 0)
            me = add(feature=j, threshold=float(cuts[j][b]), value=0.0)
            go = binned[rows, j] <= b
            nodes["left"][me] = grow(rows[go], g, h, level + 1, middle if sign < 0 else low, middle if sign > 0 else high)
            nodes["right"][me] = grow(rows[~go], g, h, level + 1, middle if sign > 0 else low, middle if sign < 0 else high)
            return me

        for _ in range(n_trees):
            p = 1 / (1 + np.exp(-score))
            roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
            last = Trees(*(np.array(v) for v in nodes.values()), np.array(roots[-1:]), depth, 0.0)
            score += last.raw(x)
    return Trees(*(np.array(v, t) for v, t in zip(nodes.values(), (int, float, int, int, float), strict=True)), np.array(roots, int), depth, base)


def base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    """Fixed rules: under 20 words, or over 30 % of them in repeated windows."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def quality_rules(docs: DataFrame, labels: DataFrame, least: float = 0.3, sample: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base rules' counts, and what trees fitted on ``labels.quality`` say of each whole text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability (of label 1),
    kept (not base_failed and probability >= ``least``); a row for each input row.

    * A null or empty text has no words and fails the base rules.  Rows that repeat are each judged; other columns are ignored.
    * Trees are fitted on the driver on at most ``sample`` labelled documents (the bound of the sample; see labelled_stats).
      Without labels, or with labels of one kind, the probability is the labels' mean (0.5 for none).
    * Empty tables give no rows.

    The scores need one pass over the text without a shuffle; a task holds a slice of a few MB, or one longer text.
    """
    d = documents(docs, id_col, text_col)
    x, y = labelled_stats(d, labels, "quality", sample)
    trees = fit_trees(x, y, monotone={RATIOS.index(k): v for k, v in MONOTONE.items()})

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = text_stats(strings(batch.column("text")))
            failed = base_failed(found["n_words"], found["n_repeat_words"])
            p = trees.probability(np.stack([found[k] for k in RATIOS], 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(p), pa.array(~failed & (p >= least))], ["doc_id", *COUNTS, "base_failed", "probability", "kept"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(judge, f"doc_id {kind}, {', '.join(f'{k} long' for k in COUNTS)}, base_failed boolean, probability double, kept boolean")
