"""Toxicity by maximum-scoring segments of token log-odds.

``fit`` counts in how many toxic and other training texts each token stands
(a bounded sample of labelled rows, labelled.MOST_LABELLED) and takes log-odds with
an informative Dirichlet prior.  Every token of the sample keeps its own log-odds,
shrunk by its standard error; a common drift is taken off, so that the mean score of
non-toxic text is negative, and a token that the sample lacks scores that drift alone.
``maximal`` is the linear-time scan for all maximal segments; each candidate links to
the nearest earlier one that starts lower, so no candidate is looked at twice.  Under
the token distribution of non-toxic texts, segment scores follow an extreme-value law
with the parameter lambda of sum p exp(lambda s) = 1; a text's evidence is its
normalised best and summed segment scores, calibrated on the sample to 0..1.  Texts of
the sample are scored without their own counts, so rare tokens don't vouch for themselves.

The lexicon is as large as the sample's vocabulary; workers get it as one broadcast of
hashes and scores (about 20 bytes a token).

Defined cases: null text is the empty text, and scores as a text without segments;
repeated rows get equal scores, and of the rows of one labelled id one text trains; with
no labels, or labels of one class, scores are the share of label 1 (0 without any); an
empty table gives an empty result; labels, lang, source and doc_id are no inputs; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.labelled import labelled_texts, logistic, sigmoid
from pagewright.llm.shared import bound_batches, cut, fold, table

#: Letters: everything but ASCII non-letters, so Python and the JVM split alike.
TOKEN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_TOKEN = re.compile(TOKEN)
PRIOR = 500.0  # observations that the informative part of the Dirichlet prior weighs
UNIFORM = 0.5  # observations of every token that its uniform part adds
SHRINK = 9.0  # squared z-score at which a token keeps half of its log-odds
DRIFT = 24.0  # the drift, in mean positive scores of non-toxic text
SIGNIFICANT = 0.05


class Lexicon(Mapping):
    """Scores by token, held as arrays in order of the tokens' hashes."""

    def __init__(self, tokens: pa.Array, scores: np.ndarray):
        hashes = np.fromiter(map(_hash, tokens.to_pylist()), np.uint64, len(tokens))
        order = np.argsort(hashes)
        self.tokens, self.hashes, self.scores = tokens.take(pa.array(order)), hashes[order], scores[order]

    def __len__(self) -> int:
        return len(self.hashes)

    def __iter__(self) -> Iterator[str]:
        return iter(self.tokens.to_pylist())

    def __getitem__(self, token: str) -> float:
        at = self.place(token)
        if at < 0:
            raise KeyError(token)
        return float(self.scores[at])

    def place(self, token: str) -> int:
        """The token's place in ``scores``; -1 for one that is not here."""
        code = np.uint64(_hash(token))
        at = int(np.searchsorted(self.hashes, code))
        return at if at < len(self.hashes) and self.hashes[at] == code else -1


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace"))


class _Places(dict):
    """Remembers where tokens stand in a lexicon."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        place = self[token] = self.lexicon.place(token)
        return place


class Model(NamedTuple):
    lexicon: Lexicon
    other: float  # score of any other token
    scale: float  # lambda
    calibration: np.ndarray
    constant: float | None = None


def lower(text: Column) -> Column:
    """A-Z only, as Python's side does."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_LOWER = {c: c + 32 for c in range(65, 91)}


def maximal(left: list[float], right: list[float], first: list[int], last: list[int]) -> list[tuple[float, int, int]]:
    """All maximal segments (score, first, last) from runs of positive scores, given the running sums left of and up to each run."""
    lefts, rights, firsts, lasts, links = [], [], [], [], []
    for low, high, begin, end in zip(left, right, first, last):
        at = len(lefts) - 1
        while True:
            while at >= 0 and lefts[at] >= low:
                at = links[at]
            if at < 0 or rights[at] >= high:
                break
            low, begin, lower = lefts[at], firsts[at], links[at]
            for kept in (lefts, rights, firsts, lasts, links):
                del kept[at:]
            at = lower
        for kept, value in zip((lefts, rights, firsts, lasts, links), (low, high, begin, end, at)):
            kept.append(value)
    return [(b - a, i, j) for a, b, i, j in zip(lefts, rights, firsts, lasts)]


def segments(hits: list[tuple[int, float]], other: float) -> list[tuple[float, int, int]]:
    """All maximal segments of a text, from its (position, positive score) tokens; all others score ``other``."""
    places = np.array([p for p, _ in hits], np.int64)
    scores = np.array([s for _, s in hits])
    right = np.cumsum(scores) + other * (places - np.arange(len(hits)))
    return maximal((right - scores).tolist(), right.tolist(), places.tolist(), places.tolist())


def dense_segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal segments of a text with these token scores."""
    edges = np.diff(np.concatenate(([0], (scores > 0).astype(np.int8), [0])))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(begins):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    return maximal(sums[begins].tolist(), sums[ends].tolist(), begins.tolist(), (ends - 1).tolist())


class Scanner:
    """Finds the passages of texts with one score per place of a lexicon; the last score is that of other tokens."""

    def __init__(self, lexicon: Lexicon, other: float):
        self.places = _Places(lexicon)
        self.scores = np.append(lexicon.scores, other)

    def tokens(self, text: str | None) -> np.ndarray:
        """Places of the text's tokens, -1 for others."""
        text = text or ""
        words = _TOKEN.findall(text.lower() if text.isascii() else text.translate(_LOWER))
        if len(self.places) > 1_000_000:
            self.places.clear()
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))

    def passages(self, text: str | None, scores: np.ndarray | None = None) -> tuple[list[tuple[float, int, int]], int]:
        """Maximal segments and the number of tokens."""
        places = self.tokens(text)
        return dense_segments((self.scores if scores is None else scores)[places]), len(places)


def evidence(found: list[tuple[float, int, int]], n: int, scale: float) -> tuple[float, float, int]:
    """(best normalised segment score, sum of the normalised ones, number of significant passages)."""
    if not found:
        return 0.0, 0.0, 0
    normal = scale * np.array([s for s, _, _ in found]) - np.log(max(n, 2))
    tail = -np.expm1(-np.exp(-np.clip(normal, -30, 50)))  # P(best score of n tokens >= s)
    soft = np.logaddexp(0, normal)
    return float(soft.max()), float(soft.sum()), int((tail < SIGNIFICANT).sum())


def _features(x: np.ndarray) -> np.ndarray:
    return np.log1p(x)


def _scale(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, by bisection."""
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        if float(shares @ np.exp(np.minimum(mid * scores, 600))) > 1:
            high = mid
        else:
            low = mid
    return low


def weights(y1: np.ndarray, y0: np.ndarray, sum1: float, sum0: float) -> np.ndarray:
    """Log-odds of tokens in ``y1`` toxic and ``y0`` other texts, shrunk by their standard errors."""
    prior = PRIOR * (y1 + y0) / max(sum1 + sum0, 1.0) + UNIFORM
    a1, a0 = y1 + prior, y0 + prior
    odds = np.log(a1 / (sum1 + PRIOR - np.minimum(a1, sum1 + PRIOR - UNIFORM))) - np.log(a0 / (sum0 + PRIOR - np.minimum(a0, sum0 + PRIOR - UNIFORM)))
    z2 = odds ** 2 / (1 / a1 + 1 / a0)
    return odds * z2 / (z2 + SHRINK)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model from ``documents`` (doc_id, text) and ``labels`` (doc_id, label)."""
    spark = documents.sparkSession
    bound_batches(spark)
    texts = cut(labelled_texts(documents, labels, label))
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model(Lexicon(pa.array([], pa.string()), np.zeros(0)), -0.05, 1.0, np.zeros(3), float(next(iter(sizes), 0)))
    tokens = texts.select("label", F.explode(F.array_distinct(F.regexp_extract_all(lower(F.col("text")), F.lit(TOKEN), F.lit(0)))).alias("token"))
    counts = tokens.groupBy("token").agg(F.sum("label").cast("double").alias("y1"), F.sum(1 - F.col("label")).cast("double").alias("y0")).toArrow()
    y1, y0 = (counts[c].to_numpy() for c in ("y1", "y0"))
    sums = float(y1.sum()), float(y0.sum())
    odds = weights(y1, y0, *sums)
    # Token frequencies of the non-toxic texts give the drift and lambda.
    shares = (y0 + 0.5) / (sums[1] + 0.5 * len(y0) + 0.5)
    drift = max(0.05, DRIFT * float(shares @ np.maximum(odds, 0)))
    scale = _scale(np.append(odds - drift, -drift), np.append(shares, max(1 - shares.sum(), 1e-6)))
    held = pa.compute.cast(counts["token"].combine_chunks(), pa.string())
    lexicon = Lexicon(held, odds - drift)
    # A text of the sample is scored without its own counts.
    alone = [np.append(Lexicon(held, weights(*w, *sums) - drift).scores, -drift) for w in ((y1, np.maximum(y0 - 1, 0)), (np.maximum(y1 - 1, 0), y0))]
    sent = spark.sparkContext.broadcast((lexicon, alone))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, alone = sent.value
        scanner = Scanner(lexicon, -drift)
        for batch in batches:
            found = np.array([evidence(*scanner.passages(t, alone[y]), scale) for t, y in zip(batch["text"], batch["label"])], float).reshape(-1, 3)
            yield pd.DataFrame({"label": batch["label"], "best": found[:, 0], "total": found[:, 1]})

    rows = texts.mapInPandas(measure, "label int, best double, total double").toPandas()
    sent.unpersist()
    return Model(lexicon, -drift, scale, logistic(_features(rows[["best", "total"]].to_numpy()), rows["label"].to_numpy(), ridge=1e-2))


class Scorer:
    """Scores texts by a broadcast model, on a worker."""

    def __init__(self, sent):
        self.model = sent.value
        self.scanner = Scanner(self.model.lexicon, self.model.other)

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of significant passages."""
        model = self.model
        found = np.array([evidence(*self.scanner.passages(t), model.scale) for t in texts], float).reshape(-1, 3)
        if model.constant is not None:
            return np.full(len(texts), model.constant), found[:, 2]
        return sigmoid(model.calibration[0] + _features(found[:, :2]) @ model.calibration[1:]), found[:, 2]


def send(documents: DataFrame, model: Model):
    bound_batches(documents.sparkSession)
    return documents.sparkSession.sparkContext.broadcast(model)


def score_table(documents: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score, n_passages) for each row of (key, text)."""
    sent = send(documents, model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent)
        for batch in batches:
            scores, passages_found = scorer(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages_found.astype(np.int32))], ["key", "score", "n_passages"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("key"), "text").mapInArrow(score, f"key {kind}, score double, n_passages int").withColumnRenamed("key", key)


def passage_table(documents: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, first_token, last_token, score) of every maximal segment of each row."""
    sent = send(documents, model)
    kind = documents.schema[key].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scorer(sent).scanner
        for batch in batches:
            found = [scanner.passages(t)[0] for t in batch.column(1).to_pylist()]
            rows = [x for f in found for x in f]
            owner = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            columns = [pa.array([x[k] for x in rows], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (0, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *columns], ["key", "first_token", "last_token", "score"])

    schema = f"key {kind}, first_token int, last_token int, score double"
    return documents.select(F.col(key).alias("key"), "text").mapInArrow(find, schema).withColumnRenamed("key", key)


def without_toxic(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``documents``, all columns as they are, whose score is under ``least``."""
    sent = send(documents, model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent)
        for batch in batches:
            scores, _ = scorer(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array(scores < least))

    return documents.mapInArrow(clean, documents.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"))
    scored = score_table(documents, model)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
