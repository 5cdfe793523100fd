"""Quality classifier: regularised quadratic discriminant over document statistics.

``statistics`` turns each whole text into transformed statistics (logs of lengths,
smoothed logits of shares), one pass per text.  ``fit`` estimates class means and
covariances on a bounded sample of labelled rows (labelled.MOST_LABELLED), shrinks
each covariance towards the pooled one and its diagonal, and caches inverse Cholesky
factors; the score is a logistic calibration of the Mahalanobis log-density
difference.  The model is a few kilobytes whatever the corpus.

Defined cases: null text is the empty text, and both are scored from the
statistics of no words; repeated rows get equal scores, and of a labelled id's rows one trains; ids of any type; with no labels, or labels of one class,
every score is the share of label 1 (0.5 without any); an empty table gives an
empty result; labels, lang, source and doc_id are no inputs; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.labelled import labelled_texts, logistic, sigmoid
from pagewright.llm.shared import bound_batches, cut, fold, table

NAMES = ("words", "word_length", "long_words", "upper", "digits", "signs", "stops", "bars", "bangs", "distinct",
         "line_length", "repeated_lines", "repeated_chars", "pressed", "lowercase_starts", "bare_words")
_BARE = re.compile(r"[*#$%&|!@]")


def _logit(count: float, n: float, weight: float = 4.0, prior: float = 0.05) -> float:
    """Logit of a share, pulled towards ``prior`` with the weight of a few observations."""
    share = (count + weight * prior) / (n + weight)
    share = min(max(share, 1e-4), 1 - 1e-4)
    return float(np.log(share / (1 - share)))


def statistics(text: str | None) -> tuple[float, ...]:
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode("utf-8", "replace")
    distinct = len(set(words))
    letters = sum(map(len, words))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=128)
    of = lambda s: int(sum(counts[ord(c)] for c in s))
    return (
        float(np.log1p(n)),
        float(np.log((letters + 20) / (n + 4))),
        _logit(sum(1 for w in words if len(w) > 15), n),
        _logit(upper, n),
        _logit(int(counts[48:58].sum()), chars, 50, 0.02),
        _logit(of("*#$%&@^~<>{}[]\\_=+/"), chars, 50, 0.01),
        _logit(of(".,;:"), chars, 50, 0.03),
        _logit(of("|"), chars, 50, 0.01),
        _logit(of("!?"), chars, 50, 0.01),
        float(np.log((distinct + 4) / (n + 4))),
        float(np.log((letters + 40) / (len(lines) + 1))),
        _logit(len(lines) - len(set(lines)), len(lines), 2, 0.05),
        _logit(sum(len(x) for x in lines) - sum(map(len, set(lines))), chars, 100, 0.02),
        float(np.log((len(zlib.compress(raw, 1)) + 20) / (len(raw) + 40))),
        _logit(sum(1 for x in lines if x[0].islower()), len(lines), 2, 0.1),
        _logit(sum(1 for w in words if _BARE.search(w)), n, 4, 0.02),
    )


def statistics_table(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, stats array<double>) for each row of (key, text)."""
    bound_batches(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["key", "stats"])

    return (documents.select(F.col(key).alias("key"), "text").mapInArrow(measure, f"key {kind}, stats array<double>")
            .withColumnRenamed("key", key))


class Model(NamedTuple):
    means: np.ndarray  # class by statistic
    whiten: np.ndarray  # class by inverse Cholesky factor
    log_det: np.ndarray
    calibration: np.ndarray
    constant: float | None = None  # the score where there is nothing to tell apart

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        log_density = [-0.5 * (((x - m) @ w.T) ** 2).sum(1) - 0.5 * d for m, w, d in zip(self.means, self.whiten, self.log_det)]
        return log_density[1] - log_density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return sigmoid(self.calibration[0] + self.calibration[1] * np.arcsinh(self.difference(x)))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = 0.2, diagonal: float = 0.1) -> Model:
    """Shrinkage covariances: a share of the pooled one, then a share of the diagonal."""
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((2, 1)), np.zeros((2, 1, 1)), np.zeros(2), np.zeros(2), float(y.mean()) if len(y) else 0.5)
    means = np.stack([x[y == c].mean(0) for c in (0, 1)])
    centred = x - means[y]
    common = centred.T @ centred / len(x)
    whiten, log_det = [], []
    for c in (0, 1):
        own = centred[y == c]
        covariance = (1 - pooled) * (own.T @ own / len(own)) + pooled * common
        covariance = (1 - diagonal) * covariance + diagonal * np.diag(np.diag(covariance)) + 1e-4 * np.eye(x.shape[1])
        factor = np.linalg.cholesky(covariance)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    model = Model(means, np.stack(whiten), np.array(log_det), np.array([0.0, 1.0]))
    return model._replace(calibration=logistic(np.arcsinh(model.difference(x))[:, None], y))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(statistics_table(table(spark, sf_dir, "documents").select("doc_id", "text")))
    rows = labelled_texts(stats, table(spark, sf_dir, "labels"), "quality", "stats").toPandas()
    model = fit(np.array(rows["stats"].tolist(), float).reshape(len(rows), len(NAMES)), rows["label"].to_numpy(int))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x) if len(x) else [], pa.float64())], ["doc_id", "score"])

    kind = stats.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
