"""Toxicity scores against a plain version from definitions, and the scan's cost."""

import math
import re
import time

import numpy as np

from pagewright.llm import toxicity
from pagewright.llm.labelled import logistic
from tests.llm.test_models import brute_segments


def plain_scores(rows, labels, asked):
    """Scores of ``asked`` by counting in dictionaries and looking for segments by brute force."""
    split = lambda t: re.findall(r"[a-z]+", (t or "").lower())
    train = [(split(t), labels[i]) for i, t in rows if i in labels]
    count = {}
    for words, y in train:
        for w in set(words):
            count.setdefault(w, [0, 0])[y] += 1
    n0, n1 = (sum(c[y] for c in count.values()) for y in (0, 1))

    def weight(y0, y1):
        prior = toxicity.PRIOR * (y0 + y1) / (n0 + n1) + toxicity.UNIFORM
        a, b = y1 + prior, y0 + prior
        odds = math.log(a / (n1 + toxicity.PRIOR - a)) - math.log(b / (n0 + toxicity.PRIOR - b))
        z2 = odds ** 2 / (1 / a + 1 / b)
        return odds * z2 / (z2 + toxicity.SHRINK)

    share = {w: (c[0] + 0.5) / (n0 + 0.5 * len(count) + 0.5) for w, c in count.items()}
    drift = max(0.05, toxicity.DRIFT * sum(share[w] * max(weight(*c), 0) for w, c in count.items()))
    terms = [(share[w], weight(*c) - drift) for w, c in count.items()] + [(max(1 - sum(share.values()), 1e-6), -drift)]
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        if sum(p * math.exp(min(mid * s, 600)) for p, s in terms) > 1:
            high = mid
        else:
            low = mid

    def features(words, own=None):
        scores = []
        for w in words:
            c = list(count.get(w, (None, None)))
            if c[0] is None:
                scores.append(-drift)
                continue
            if own is not None:
                c[own] -= 1
            scores.append(weight(*c) - drift)
        normal = [low * s - math.log(max(len(words), 2)) for s, _, _ in brute_segments(scores)]
        soft = [math.log1p(math.exp(x)) for x in normal] or [0.0]
        return math.log1p(max(soft)), math.log1p(sum(soft))

    fitted = logistic(np.array([features(w, y) for w, y in train]), np.array([y for _, y in train]), ridge=1e-2)
    return [1 / (1 + math.exp(-(fitted[0] + float(np.dot(fitted[1:], features(split(t))))))) for t in asked]


def test_scores_against_a_plain_version(spark):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "mnop"]
    rows = [(i, " ".join([*rng.choice(words, 8), *(["vile", "slur"] if i % 4 == 0 else []), *rng.choice(words, 4)])) for i in range(160)]
    labels = {i: int(i % 4 == 0) for i, _ in rows}
    asked = [t for _, t in rows[:20]] + [None, "", "vile", "slur vile am an", "unknown words only", "VILE slur " * 3]
    table = spark.createDataFrame([(i, y) for i, y in labels.items()], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), table)
    from pagewright.llm.labelled import training_ids

    trained = {r["doc_id"] for r in training_ids(table, "toxic").collect()}
    want = plain_scores(rows, {i: y for i, y in labels.items() if i in trained}, asked)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_table(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()}
    assert np.allclose([got[i] for i in range(len(asked))], want, atol=1e-9)


def test_repeated_labelled_ids_train_once(spark):
    rows = [(i, "calm words stand " + ("vile" if i % 2 else "here")) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    twice = toxicity.fit(spark.createDataFrame(rows * 3, "doc_id long, text string"), labels)
    assert dict(once.lexicon) == dict(twice.lexicon) and np.allclose(once.calibration, twice.calibration)


def test_scan_is_linear_in_sparse_hits():
    began = time.time()
    got = toxicity.segments([(3 * i, 1.0 + i % 7 * 0.01) for i in range(200_000)], -0.6)
    assert time.time() - began < 10 and len(got) == 200_000
    scores = np.full(600_000, -0.6)
    scores[::3] = [1.0 + i % 7 * 0.01 for i in range(200_000)]
    assert [(a, b) for _, a, b in toxicity.dense_segments(scores)] == [(a, b) for _, a, b in got]


def test_dense_segments_against_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(300):
        scores = rng.normal(-0.3, 1, 13)
        got = [(round(s, 6), a, b) for s, a, b in toxicity.dense_segments(scores)]
        assert got == [(round(s, 6), a, b) for s, a, b in brute_segments(scores.tolist())]


def test_long_text_full_of_hits_beside_other_columns(spark):
    docs = [(i, "calm words stand here " + ("vile rotten" if i % 3 == 0 else "plain"), 1.0) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string, score double"), labels)
    long = "vile calm plain calm plain calm plain " * 60_000
    got = toxicity.score_table(spark.createDataFrame([("a", long, 2.0), ("a", long, 2.0), (None, None, 0.0)], "doc_id string, text string, score double"), model).collect()
    assert len(got) == 3 and got[0]["score"] == got[1]["score"] and toxicity.score_table(spark.createDataFrame([], "doc_id string, text string"), model).count() == 0
