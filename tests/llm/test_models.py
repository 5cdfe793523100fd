"""Mixing, quality, toxicity: brute force, held-out accuracy and odd inputs."""

import math
import zlib

import numpy as np
import pytest

from pagewright.llm import labelled, mixing, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def auc(labels, scores):
    ranks = np.argsort(np.argsort(scores)) + 1
    ones = labels == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def targets(sizes):
    """Sources in code point order, null last; what is above three sizes is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, fixed = float(sum(sizes.values())), {}
    while len(fixed) < len(order):
        open_ = [s for s in order if s not in fixed]
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] >= 3 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in open_}
        for s in over:
            fixed[s] = 3.0 * sizes[s]
        left = float(sum(sizes.values())) - sum(fixed.values())
    return fixed


def test_mix_odd_rows(spark):
    rows = [(1, "a b c", "x", 9), (1, "a b c", "x", 9), (None, "a", "x", 9), (2, None, "y", 9), (3, "", None, 9), (4, "w " * 500, None, 9), (5, "u\tv\x0bw", "é", 9),
            *((100 + i, "word " * (i % 7), "big", 9) for i in range(400))]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string, key int")
    got = mixing.mix(given).collect()
    assert len(got) == len(rows)
    sizes, want = {}, None
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for source, target in want.items():
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - target) <= max(r["size"] for r in mine) / 2 + 1e-6
    again = sorted(map(str, mixing.mix(given.repartition(7)).collect()))
    assert again == sorted(map(str, got))


def test_mix_prefers_quality(spark):
    rows = [(i, ("clean word here now " if i % 2 else "*** $$$ ### %%% ") * 5, "a") for i in range(2000)] + [(9000 + i, "x " * 20, f"b{i}") for i in range(40)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 'a' AND copies % 2 = 1 OR source = 'a' AND copies = 2").collect()
    clean = [r["copies"] for r in got if r["doc_id"] % 2]
    assert len(clean) > len(got) / 2 or not got


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize("name, label, least", [("op2_quality", "quality", 0.97), ("op3_toxicity", "toxic", 0.7)])
def test_held_out(spark, name, label, least):
    got = queries.queries()[name](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    joined = got[got["held_out"]].merge(labels, on="doc_id")
    assert auc(joined[label].to_numpy(), joined["score"].to_numpy()) >= least
    if label == "toxic":
        assert not ((joined["predicted"] == 1) & (joined["toxic"] == 0)).any()


def test_quality_odd_texts():
    for text in (None, "", " \n\n ", "x", "é" * 50_000, "|" * 1000, "a\x00b", "word " * 100_000):
        assert all(map(math.isfinite, quality.statistics(text)))


def test_quality_without_labels():
    model = quality.fit(np.zeros((0, 3)), np.zeros(0, int))
    assert model.score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.fit(np.zeros((4, 3)), np.ones(4, int)).score(np.zeros((1, 3))).tolist() == [1.0]


def test_quadratic_boundary():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (500, 2)), rng.normal(0, 5, (500, 2))])
    y = np.repeat([1, 0], 500)
    model = quality.fit(x, y)
    assert model.score(np.array([[0.0, 0.0]]))[0] > 0.8 and model.score(np.array([[15.0, 0.0], [-15.0, 0.0]])).max() < 0.1


def brute_segments(scores):
    """All maximal segments by divide and conquer on the best-scoring one."""
    best, where = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, where = total, (i, j)
    if where is None:
        return []
    i, j = where
    right = [(s, a + j + 1, b + j + 1) for s, a, b in brute_segments(scores[j + 1:])]
    return [*brute_segments(scores[:i]), (best, i, j), *right]


def test_segments_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        other = -float(rng.uniform(0.3, 1.7))
        hits = {int(i): float(rng.uniform(0.2, 3)) for i in rng.choice(14, rng.integers(0, 7), replace=False)}
        scores = [hits.get(i, other) for i in range(14)]
        got = [(round(s, 6), a, b) for s, a, b in toxicity.segments(sorted(hits.items()), other)]
        assert got == [(round(s, 6), a, b) for s, a, b in brute_segments(scores)]


def test_toxicity_learns_and_keeps_columns(spark):
    docs = [(i, "calm words stand here and there " * 5 + ("vile rotten slur " if i % 3 == 0 else "") + f"w{i}", "s", None) for i in range(600)]
    docs += [(None, None, None, None), (7000, "", None, None), (7000, "", None, None), (7001, "vile rotten slur", None, None), (7002, "plain " * 30_000, None, None)]
    given = spark.createDataFrame(docs, "doc_id long, text string, score string, n_passages int")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(600)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(given.select("doc_id", "text"), labels)
    assert {"vile", "rotten", "slur"} <= set(model.lexicon)
    spans = toxicity.passage_table(given.where("doc_id = 7001"), model).collect()
    assert [(r["first_token"], r["last_token"]) for r in spans] == [(0, 2)]
    kept = toxicity.without_toxic(given, model)
    assert kept.schema == given.schema
    ids = [r["doc_id"] for r in kept.collect()]
    assert 7001 not in ids and ids.count(7000) == 2 and None in ids and 7002 in ids and sorted(i for i in ids if i and i < 600) == [i for i in range(600) if i % 3]


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_table(docs, toxicity.fit(docs, labels)).first()["score"] == 0
    assert toxicity.score_table(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_labels_learn_from_training_rows_only(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(2000)], "doc_id long, toxic int")
    ids = [r["doc_id"] for r in labelled.training_ids(labels, "toxic", 300).collect()]
    assert len(ids) == 300 and all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_answers_of_a_language_model_are_not_stored_beside_their_shuffle(spark, monkeypatch):
    """They lay in the shared folder and in the shuffle to their chunks at once, and the disk went beyond its limit."""
    from pagewright.llm import ngram_lm

    stored, keep = [], ngram_lm.cut
    monkeypatch.setattr(ngram_lm, "cut", lambda df: stored.append(df.columns) or keep(df))
    rows = [(i, f"a b{i % 3} c{i} A", i % 4 != 0) for i in range(40)] + [(40, None, True)]
    got = ngram_lm.language_scores(spark.createDataFrame(rows, "doc_id long, text string, train boolean")).collect()
    trained = [w for _, text, train in rows if train for w in [*(text or "").lower().split(), "."]]
    assert [c for c in stored if "payload" in c] == [["chunk", "payload"]]
    total, distinct = len(trained), len(set(trained))
    assert {r["train_tokens"] for r in got} == {total}
    want = np.log10((trained.count(".") + 0.5) / (total + 0.5 * (distinct + 1)))
    assert abs(next(r["base_score"] for r in got if r["doc_id"] == 40) - want) < 1e-9
