"""Quality classifier: regularised quadratic discriminant analysis over document statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bucket, documents, keep_rows, slices, strings
from leafmill.llm.stats import RATIOS, labelled_stats, text_stats


def transformed(x: np.ndarray) -> np.ndarray:
    """Square roots draw in the long tails of ratios, which are never negative."""
    return np.sqrt(np.maximum(x, 0))


@dataclass
class Discriminant:
    """Two Gaussians over scaled features.  The inverse Cholesky factors are kept, so that a score is a product and a sum."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    #: Platt scaling of the difference: Gaussians are too sure of themselves, and scores of exactly 0 or 1 rank nothing.
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        z = np.clip((transformed(x) - self.centre) / self.scale, -12, 12)
        one = [offset - 0.5 * (((z - mean) @ factor.T) ** 2).sum(1) for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True)]
        return one[1] - one[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * np.arcsinh(self.difference(x)) + self.shift)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Discriminant:
        """Newton steps of a logistic regression on the difference, with a small penalty on the slope."""
        a = np.stack([np.arcsinh(self.difference(x)), np.ones(len(x))], 1)
        w = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-a @ w))
            g = a.T @ (p - y) + np.array([0.1, 0.01]) * (w - np.array([1.0, 0.0]))
            h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.1, 0.01])
            w -= np.linalg.solve(h, g)
        self.slope, self.shift = float(max(w[0], 0.1)), float(w[1])
        return self


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.1, pool: float = 0.1, floor: float = 0.05) -> Discriminant | None:
    """Each class covariance is drawn towards the pooled one (``pool``) and towards a scaled identity (``shrink``), with
    ``floor`` added to the diagonal.  None where a class has no rows."""
    if not (y == 0).any() or not (y == 1).any():
        return None
    t = transformed(x)
    centre, scale = t.mean(0), np.maximum(t.std(0), 1e-6)
    z = np.clip((t - centre) / scale, -12, 12)
    m = z.shape[1]
    groups = [z[y == k] for k in (0, 1)]
    means = [g.mean(0) for g in groups]
    each = [(g - mean).T @ (g - mean) / max(1, len(g) - 1) for g, mean in zip(groups, means, strict=True)]
    pooled = sum(len(g) * c for g, c in zip(groups, each, strict=True)) / len(z)
    factors, offsets = [], []
    for g, c in zip(groups, each, strict=True):
        c = (1 - pool) * c + pool * pooled
        c = (1 - shrink) * c + shrink * np.trace(c) / m * np.eye(m) + floor * np.eye(m)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(len(g) / len(z)) - np.log(np.diag(lower)).sum()))
    return Discriminant(centre, scale, means, factors, offsets).calibrate(x, y)


def scorer(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = 20_000) -> Callable[[pa.Array], np.ndarray]:
    """A function from texts to scores, learned from the labels of documents (doc_id, text) outside the held-out fold."""
    x, y = labelled_stats(docs, labels, "quality", sample, keep=lambda c: bucket(c, folds) != held_out)
    model, mean = fit(x, y), float(y.mean()) if len(y) else 0.5

    def score(text: pa.Array) -> np.ndarray:
        found = text_stats(text)
        return model.score(np.stack([found[k] for k in RATIOS], 1)) if model else np.full(len(text), mean)

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.7, sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A quality score between 0 and 1 for each whole text, learned from ``labels.quality``.

    Returns doc_id, held_out (crc32 of the doc_id as text, modulo ``folds``, is ``held_out``), score, predicted (1 from
    ``threshold`` on); a row for each input row.  Labels of held-out rows are never read.  Only the text goes into a score.

    * A null or empty text is scored like any other.  A null doc_id is not held out.  Rows that repeat are each scored, alike.
    * The classifier is fitted on the driver on at most ``sample`` labelled documents (the sample's bound; see
      labelled_stats).  Where labels of either class are lacking, all scores are the mean label, 0.5 without any.
    * Other columns are ignored; empty tables give no rows.

    Scoring is one pass over the text without a shuffle; a task holds a slice of a few MB, or one longer text.
    """
    d = documents(docs, id_col, text_col)
    score = scorer(d, labels, folds, held_out, sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(strings(batch.column("text"))))], ["doc_id", "score"])

    kind = d.schema["doc_id"].dataType.simpleString()
    scores = d.mapInArrow(judge, f"doc_id {kind}, score double")
    return scores.select("doc_id", F.coalesce(bucket(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of docs (doc_id, text, any more) that score ``threshold`` or more; see quality_scores.  A threshold that no
    document can reach, for want of labels of one kind, keeps those that the mean label keeps."""
    score = scorer(documents(docs), labels, **options)
    return keep_rows(docs, lambda text: score(text) >= threshold)
