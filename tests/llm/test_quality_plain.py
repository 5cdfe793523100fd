"""Quality: statistics and densities against plain versions from their definitions."""

import math
import zlib

import numpy as np
import pyarrow.parquet as pq

from pagewright.llm import quality

TEXTS = [r["text"] or "" for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
TEXTS += ["", " \n ", "A", "ÄÖ ü|x!\n\nb\nb\n*&", "word " * 5000, "x" * 30, "12 34\n12 34\nE-mail a@b.c"]


def share(count, n, weight=4.0, prior=0.05):
    p = min(max((count + weight * prior) / (n + weight), 1e-4), 1 - 1e-4)
    return math.log(p) - math.log(1 - p)


def plain_statistics(text):
    words, chars = text.split(), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    kept, again = set(), []
    for x in lines:
        (again.append(x) if x in kept else kept.add(x))
    n, letters = len(words), len("".join(words))
    among = lambda signs: sum(text.count(c) for c in signs)
    raw = text.encode("utf-8", "replace")
    return [
        math.log(1 + n), math.log((letters + 20) / (n + 4)), share(len([w for w in words if len(w) >= 16]), n), share(len([w for w in words if w.isupper() and len(w) >= 2]), n),
        share(among("0123456789"), chars, 50, 0.02), share(among("*#$%&@^~<>{}[]\\_=+/"), chars, 50, 0.01), share(among(".,;:"), chars, 50, 0.03), share(among("|"), chars, 50, 0.01),
        share(among("!?"), chars, 50, 0.01), math.log((len(set(words)) + 4) / (n + 4)), math.log((letters + 40) / (len(lines) + 1)), share(len(again), len(lines), 2, 0.05),
        share(len("".join(again)), chars, 100, 0.02), math.log((len(zlib.compress(raw, 1)) + 20) / (len(raw) + 40)),
        share(len([x for x in lines if x[0].islower()]), len(lines), 2, 0.1), share(len([w for w in words if any(c in "*#$%&|!@" for c in w)]), n, 4, 0.02)]


def test_statistics_of_every_text():
    for text in TEXTS:
        assert np.allclose(quality.statistics(text), plain_statistics(text), atol=1e-9), text[:80]


def test_density_difference_from_its_definition():
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)) * (1 + y[:, None]) + y[:, None]
    model = quality.fit(x, y, 0.2, 0.1)
    common = sum(np.outer(v, v) for c in (0, 1) for v in x[y == c] - x[y == c].mean(0)) / len(x)
    want = 0
    for c, sign in ((1, 1), (0, -1)):
        own = x[y == c]
        within = sum(np.outer(v, v) for v in own - own.mean(0)) / len(own)
        mixed = 0.8 * within + 0.2 * common
        mixed = 0.9 * mixed + 0.1 * np.diag(np.diag(mixed)) + 1e-4 * np.eye(5)
        apart = x - own.mean(0)
        mahalanobis = np.einsum("ij,jk,ik->i", apart, np.linalg.inv(mixed), apart)
        want = want + sign * (-0.5 * mahalanobis - 0.5 * np.linalg.slogdet(mixed)[1])
    assert np.allclose(model.difference(x), want)
    a, b = model.calibration
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(a + b * np.arcsinh(want)))))


def test_query_scores_are_those_of_the_plain_statistics(spark):
    got = {r["doc_id"]: r["score"] for r in quality.op2_quality(spark, "/root/testdata/sf0.001").collect()}
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.001/labels.parquet").to_pylist() if r["quality"] is not None}
    stats = {d["doc_id"]: plain_statistics(d["text"] or "") for d in docs}
    train = [i for i in labels if i in stats and zlib.crc32(str(i).encode()) % 5]
    model = quality.fit(np.array([stats[i] for i in train]), np.array([labels[i] for i in train]))
    for i, s in stats.items():
        assert abs(model.score(np.array([s]))[0] - got[i]) < 1e-6
