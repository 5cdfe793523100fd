"""Matroska and language-model tries: round trips, brute force and odd inputs."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import elias_fano, matroska, ngram_lm, queries

SF = "/root/testdata/sf0.001"


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 3), st.binary(max_size=300), st.integers(0, 70_000))
def test_media_round_trip(seed, head, more):
    samples = (head + np.random.default_rng(seed).integers(0, 256, more, dtype=np.uint8).tobytes()) or b"\0"
    media = matroska.mux(samples)
    found, facts = matroska.packets(media)
    assert b"".join(media[p[3]: p[3] + p[4]] for p in found) == samples
    assert facts["cues"] == facts["cluster_at"] and facts["rate"] == 8000 and facts["depth"] == 8
    assert [p[2] for p in found] == [i * 128 for i in range(len(found))]


def test_all_lacings():
    body = [bytes([i]) * n for i, n in enumerate((300, 300, 17, 900))]
    for index, kind in ((0, 3), (1, 1)):
        found, _ = matroska.packets(matroska.element(matroska.CLUSTER, matroska.unsigned(matroska.TIMESTAMP, 5) + matroska._block(body, 7, index)))
        assert [p[4] for p in found] == [300, 300, 17, 900] and {p[6] for p in found} == {kind} and found[0][2] == 12
    found, _ = matroska.packets(matroska.element(matroska.CLUSTER, matroska._block(body[:2], 0, 0)))
    assert {p[6] for p in found} == {2}


def test_block_groups_unknown_sizes_and_broken_files():
    block = matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, b"\x82\x00\x02\x00data"))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\xff" + matroska.unsigned(matroska.TIMESTAMP, 3) + block
    whole = matroska.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    found, facts = matroska.packets(whole)
    assert [(p[0], p[1], p[2], p[4]) for p in found] == [(0, 2, 5, 4), (1, 2, 5, 4)] and facts["clusters"] == 2
    assert len(matroska.packets(whole[:-2])[0]) == 1
    for broken in (None, b"", b"\x00", b"\x1a", whole[:9], b"\xff" * 40):
        matroska.packets(broken)


def test_packet_table(spark):
    media = matroska.mux(b"x" * 5000)
    df = spark.createDataFrame([(1, bytearray(media), 0), (2, None, 0)], "id long, media binary, track int")
    rows = matroska.packet_table(df, "id", "media").collect()
    assert {r["id"] for r in rows} == {1} and sum(r["byte_size"] for r in rows) == 5000


@pytest.mark.parametrize("text", [None, "", "a" * 64, "a" * 65, "é" * 40_000])
def test_stored_payload(text):
    n, padded, digest, tail, *_ = matroska.stored_features(text)
    raw = (text or "").encode()
    payload = raw + bytes((64 if not raw else -len(raw) % 64))
    import hashlib

    assert (n, padded, digest, tail) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert matroska.stored_features(text) == matroska.stored_features(text)


def test_media_query(spark):
    got = queries.queries()["op8_media_matroska"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(texts) and all(r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) and r["payload_bytes"] % 64 == 0 for r in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.lists(st.integers(0, 2**64 - 1), max_size=20), st.sampled_from([10, 33, 64]))
def test_elias_fano(values, others, width):
    values = np.sort(np.array([v % (1 << width) for v in values], np.uint64))
    coded = elias_fano.EliasFano(values, width)
    assert (coded.at(np.arange(len(values))) == values).all()
    asked = np.array([*(v % (1 << width) for v in others), *values.tolist()], np.uint64)
    assert ((coded.index(asked) >= 0) == np.isin(asked, values)).all()


def brute(texts, train):
    uni, bi, ctx, tokens = collections.Counter(), collections.Counter(), collections.Counter(), []
    for text, t in zip(texts, train):
        words = [*(text or "").encode().lower().split(), None]
        tokens.append(words)
        if t:
            before = ["begin", *words[:-1]]
            uni.update(words)
            bi.update(zip(before, words))
            ctx.update(before)
    n, v, k = sum(uni.values()), len(uni), ngram_lm.SMOOTHING
    p = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    q = lambda c, w: (bi[c, w] + k * p(w)) / (ctx[c] + k)
    whole = lambda w: sum(math.log10(q(*x)) for x in zip(["begin", *w], w))
    return [(len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p(x)) for x in w), whole(w)) for w in tokens]


@pytest.mark.parametrize("size", [ngram_lm.CHUNK_BYTES, 300])
def test_scores_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(ngram_lm, "CHUNK_BYTES", size)
    rng = np.random.default_rng(2)
    texts = [None, "", "The the THE", "é É x\x1cy", "w " * 4000, *(" ".join(rng.choice(["a", "b", "c", "dd", "e\t", "F\n"], int(rng.integers(0, 40)))) for _ in range(60))]
    ids = [None, *range(1, len(texts) - 1), (1 << 60) + 1]
    train = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1 for i in ids]
    df = spark.createDataFrame(list(zip(ids, texts, train)), "doc_id long, text string, train boolean").repartition(3)
    got = {r["doc_id"]: r for r in ngram_lm.language_scores(df).collect()}
    for i, t, want in zip(ids, train, brute(texts, train)):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3] and r["held_out"] == (not t)
        assert math.isclose(r["base_score"], want[3], rel_tol=1e-9) and math.isclose(r["score"], want[4], rel_tol=0.001)


def test_scores_without_training_or_rows(spark):
    df = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")
    row = ngram_lm.language_scores(df).first()
    assert (row["train_tokens"], row["base_score"], row["score"]) == (0, 0.0, 0.0)
    assert ngram_lm.language_scores(df.limit(0)).count() == 0


def test_log_codes_stay_close():
    values = 10.0 ** -np.concatenate(([0.0, 1e-6, 0.002], np.random.default_rng(0).uniform(0, 12.9, 5000)))
    codes = elias_fano.log_codes(values)
    back = elias_fano.log_values(codes, 7.0)
    assert codes.min() >= 1 and np.abs(np.log10(back) - np.log10(values)).max() < 0.001 and np.abs(np.log10(back[:3]) - np.log10(values[:3])).max() < 1e-6
    assert elias_fano.log_values(np.zeros(2, np.uint16), 7.0).tolist() == [7.0, 7.0]


def test_trie_searches_between_its_pointers():
    rng = np.random.default_rng(6)
    context, word = rng.integers(0, 40, 900), rng.integers(0, 5000, 900)
    keys = np.unique((context.astype(np.int64) << 13) | word)
    level = elias_fano.Level(keys >> 13, keys & 8191, 41, 13)
    asked_context, many = rng.integers(-1, 41, 500), rng.integers(0, 9, 500)
    asked = rng.integers(0, 5000, int(many.sum()))
    places = {int(k): i for i, k in enumerate(keys)}
    hits = np.repeat(asked_context, many)
    for i in range(0, len(asked), 2):  # every other one is there
        own = keys[keys >> 13 == hits[i]]
        asked[i] = rng.choice(own) & 8191 if len(own) else asked[i]
    want = [places.get(int(c) << 13 | int(w), -1) if c >= 0 else -1 for c, w in zip(hits, asked)]
    assert level.find(asked_context, many, asked).tolist() == want and sum(w >= 0 for w in want) > 500
    broken = elias_fano.Level(keys >> 13, keys & 8191, 41, 13)
    broken.pointers = elias_fano.EliasFano(np.zeros(42, np.uint64), 10)
    assert (broken.find(asked_context, many, asked) == -1).all()
    assert elias_fano.Level(np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 3).find(np.array([-1, -1]), np.array([1, 1]), np.array([1, 2])).tolist() == [-1, -1]


def test_broken_media_never_fail(spark):
    rnd = random.Random(8)
    whole = matroska.mux(bytes(range(256)) * 40)
    broken = []
    for _ in range(1500):
        data = bytearray(whole)
        for _ in range(rnd.randint(1, 4)):
            data[rnd.randrange(len(data)) if rnd.random() < 0.5 else rnd.randrange(300)] = rnd.randrange(256)
        broken.append(bytes(data[:rnd.randrange(len(data))] if rnd.random() < 0.2 else data))
    for data in broken:
        found, _ = matroska.packets(data)
        assert all(0 <= p[3] and 0 <= p[4] and p[3] + p[4] <= len(data) for p in found)
    table = matroska.packet_table(spark.createDataFrame(list(enumerate(broken[:200])), "k long, media binary"), "k", "media")
    assert table.count() == sum(len(matroska.packets(x)[0]) for x in broken[:200])


@pytest.mark.parametrize("size, want", [(0, 0.0), (4, 8000.0), (8, 8000.0), (3, 0.0)])
def test_floats_of_any_size(size, want):
    import struct

    value = {4: struct.pack(">f", 8000.0), 8: struct.pack(">d", 8000.0)}.get(size, bytes(size))
    assert matroska.packets(matroska.element(matroska.RATE, value))[1]["rate"] == want
