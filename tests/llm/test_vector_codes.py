"""Vector codes: rounds with bounds against plain rounds, and tables with odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from pagewright.llm import vector_codes as codes


def plain_rounds(rows: list[tuple], parts: int = 16) -> tuple[list[tuple[str, int]], list]:
    """Codes and errors by scanning every entry in every round, in Python's whole numbers; rows are (id, components)."""
    vectors = [[math.floor(256 * x) for x in v] for _, v in rows]
    size = len(vectors[0]) // parts
    cut = [[v[p * size:(p + 1) * size] for p in range(parts)] for v in vectors]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, vectors[i]))
    books = [[list(cut[i][p]) for i in order[:64]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(parts):
            members: dict[int, list] = {}
            for v in cut:
                members.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for k, own in members.items():
                books[p][k] = [sum(column) // len(own) for column in zip(*own)]
    best = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    return [("".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b)) for b in best], books


def test_bounds_never_change_an_assignment():
    rng = np.random.default_rng(3)
    for spread, size in ((3, 2), (40, 4), (2, 1), (100_000, 4)):
        vectors = rng.integers(-spread, spread + 1, (400, 3, size))
        entries = vectors[:64].transpose(1, 0, 2).copy()
        books = codes.Codebooks(entries, codes.cluster_entries(entries), np.zeros((3, 64)))
        entry, upper, lower = codes.assign(vectors, books)
        for _ in range(6):
            total, n = np.zeros_like(books.entries), np.zeros((3, 64), int)
            for p in range(3):
                np.add.at(total[p], entry[:, p], vectors[:, p])
                n[p] = np.bincount(entry[:, p], minlength=64)
            books = codes.moved(books, total, n)
            entry, upper, lower, _ = codes.reassign(vectors, entry, upper, lower, books)
            for p in range(3):
                d = ((vectors[:, p, None] - books.entries[p][None]) ** 2).sum(-1)
                assert (entry[:, p] == d.argmin(1)).all()
                assert (upper[:, p].astype(float) >= np.sqrt(d.min(1))).all()
                others = d.astype(float)
                others[np.arange(400), entry[:, p]] = np.inf
                for g in range(codes.GROUPS):
                    if (books.groups[p] == g).any():
                        assert (lower[:, p, g].astype(float) <= np.sqrt(others[:, books.groups[p] == g].min(1)) + 1e-9).all()


def test_groups_that_stay_far_are_not_scanned():
    rng = np.random.default_rng(4)
    centres = rng.integers(-3000, 3000, (64, 4))
    vectors = (centres[np.arange(2000) % 64] + rng.integers(-20, 21, (2000, 4)))[:, None]
    entries = vectors[:64].transpose(1, 0, 2).copy()
    books = codes.Codebooks(entries, codes.cluster_entries(entries), np.zeros((1, 64)))
    entry, upper, lower = codes.assign(vectors, books)
    total, n = np.zeros_like(entries), np.bincount(entry[:, 0], minlength=64)[None]
    np.add.at(total[0], entry[:, 0], vectors[:, 0])
    computed = codes.reassign(vectors, entry, upper, lower, codes.moved(books, total, n))[3]
    assert computed < 2000 * 64 / 10


def test_exact_distances_of_large_numbers():
    big = 1 << 25
    vectors, entries = np.array([[big, -big], [big - 1, 3]]), np.array([[-big, big], [0, 0]])
    assert codes.squared(vectors, entries).tolist() == [[sum((a - b) ** 2 for a, b in zip(v, e)) for e in entries.tolist()] for v in vectors.tolist()]


def written(spark, path, rows, schema="vec_id long, embedding array<float>, label int, code string"):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(path / "embeddings.parquet"))
    return str(path)


@pytest.mark.parametrize("kept", [7, 64, 300])
def test_query_against_plain_rounds(spark, tmp_path, kept):
    rnd = random.Random(kept)
    grid = [k / 256 + 1 / 1024 for k in range(-6, 7)]
    sound = [(i, [rnd.choice(grid) for _ in range(32)]) for i in range(kept - 3)]
    sound += [(0, sound[0][1]), (None, sound[1][1]), (None, [0.5] * 32)]
    odd = [(5, None), (6, [None] + [0.0] * 31), (7, [float("nan")] * 32), (8, [float("inf")] + [0.0] * 31), (9, []), (10, [0.0] * 16), (11, [0.0] * 31), (12, [1e30] * 32)]
    labels = [None, 1, 2]
    rows = [(i, v, labels[n % 3], "x") for n, (i, v) in enumerate(sound)] + [(i, v, 1, "x") for i, v in odd]
    got = codes.op12_vector_codes(spark, written(spark, tmp_path, rows)).collect()
    want, books = plain_rounds(sound)
    by_label = {}
    for n, (_, error) in enumerate(want):
        by_label[labels[n % 3]] = by_label.get(labels[n % 3], 0) + error
    expected = [(sound[n][0], code, error, by_label[labels[n % 3]]) for n, (code, error) in enumerate(want)]
    assert sorted(map(str, ((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got))) == sorted(map(str, expected))
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_tables_without_vectors(spark, tmp_path):
    for name, rows in (("none", []), ("odd", [(1, None, 1, "x"), (2, [0.5] * 3, 1, "x")])):
        (tmp_path / name).mkdir()
        assert codes.op12_vector_codes(spark, written(spark, tmp_path / name, rows)).collect() == []


def test_codes_stand_for_near_vectors(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    state, books = codes.encode(given)
    rows = {int(r["vec_id"]): r for r in codes.codes(state, books).collect()}
    for r in given.limit(20).collect():
        apart = codes.decoded(rows[r["vec_id"]]["code"], books) - np.array(r["embedding"])
        assert abs((apart ** 2).sum() * 256 ** 2 - rows[r["vec_id"]]["error"]) < 256 and (apart ** 2).sum() < (np.array(r["embedding"]) ** 2).sum()
