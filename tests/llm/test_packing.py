"""Packing: the plan against exhaustive search, pieces against a plain encoder, and the layout of whole tables."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pagewright.llm import packing

SF = "/root/testdata/sf0.001"


def optimum(items: list[int], capacity: int) -> int:
    """The fewest sequences, by trying every place for every piece."""
    items, best = sorted(items, reverse=True), len(items)

    def go(i: int, rooms: tuple[int, ...]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= items[i]}:
            k = rooms.index(r)
            go(i + 1, rooms[:k] + (r - items[i],) + rooms[k + 1:])
        go(i + 1, rooms + (capacity - items[i],))

    go(0, ())
    return best


def one_by_one(items: list[int], capacity: int) -> int:
    """Best-fit of single pieces, longest first."""
    rooms: list[int] = []
    for s in sorted(items, reverse=True):
        k = bisect.bisect_left(rooms, s)
        bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else capacity) - s)
    return len(rooms)


def random_items(seed: int) -> tuple[list[int], int]:
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 20, 30, 50])
    least = max(1, rnd.choice([0, capacity // 5, capacity // 4]))
    return [rnd.randint(least, capacity) for _ in range(rnd.randint(1, 10))], capacity


def test_reduction_keeps_an_optimal_packing_within_reach():
    for seed in range(400):
        items, capacity = random_items(seed)
        fixed, left = packing.reduced(dict(Counter(items)), capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(b.count for b in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity), (items, capacity)


def test_plan_is_valid_and_close_to_the_optimum():
    over = 0
    for seed in range(400):
        items, capacity = random_items(seed)
        bins, placed = packing.plan(dict(Counter(items)), capacity), Counter()
        for b in bins:
            assert b.count > 0 and sum(s * each for s, each in b.layout) <= capacity
            for s, each in b.layout:
                placed[s] += each * b.count
        assert placed == Counter(items)
        over += sum(b.count for b in bins) - optimum(items, capacity)
    assert over <= 4


def test_best_fit_with_multiplicities_is_best_fit_of_single_pieces():
    rnd = random.Random(5)
    for _ in range(150):
        capacity = rnd.choice([50, 100, 2048])
        items = [rnd.randint(1, rnd.choice([capacity // 8, capacity // 3, capacity])) for _ in range(rnd.randint(1, 300))]
        assert sum(b.count for b in packing.best_fit(dict(Counter(items)), capacity)) == one_by_one(items, capacity)


def test_huge_counts_take_no_longer():
    bins = packing.plan({s: 10**12 for s in range(1, 2049)})
    assert sum(b.count * sum(s * e for s, e in b.layout) for b in bins) == 10**12 * 2048 * 2049 // 2
    assert len(packing.slots(bins)["key"]) < 20_000


@pytest.mark.parametrize("text", ["", "plain words, and more", "a <|endoftext|> b", " " * 5000 + "x", "é 　 x​ y\x00z\x1c q 👩‍👩‍👧 it's IT'S", "ab" * 5000, "\n \t" * 2000 + "end"])
def test_ids_are_those_of_the_defining_library(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    plain.encode_special_tokens = True
    assert packing.encoder()(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert packing.encoder(public_tokenizers.path(packing.VOCABULARY))(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_where_no_token_reaches_across(monkeypatch):
    text = "It's 12 odd   words,\n\n'tis  so. x y z " * 200
    whole = packing.encoder()(text).tolist()
    monkeypatch.setattr(packing, "CHUNK", 37)
    assert packing.encoder()(text).tolist() == whole


def layout_holds(rows, capacity: int) -> None:
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity


def test_odd_rows(spark):
    rows = [(1, "one two three", "x"), (1, "one two three", "x"), (None, None, None), (None, "", "y"), (2, "word " * 30_000, "x"), (3, "no", "x")] + [(9, "same text of many rows", "x")] * 300
    given = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(7)
    packed = packing.pack(given, keep_ids=True)
    got = packed.collect()
    encode = packing.encoder()
    want = Counter()
    for doc_id, text, _ in rows:
        n, start = len(encode(text or "")) + 1, 0
        ids = np.append(encode(text or ""), np.uint32(0)).astype("<u4")
        for piece, length in enumerate(packing.cut_lengths(n, 2048)):
            want[doc_id, piece, start, length, zlib.crc32(ids[start:start + length].tobytes())] += 1
            start += length
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    layout_holds(got, 2048)
    assert len({r["sequence_id"] for r in got}) == -(-sum(r["length"] for r in got) // 2048)
    texts = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert all(zlib.crc32(np.array(texts[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in got)
    assert packing.pack(given.limit(0)).count() == 0


def test_query_packs_the_whole_table(spark):
    got = packing.op13_packing(spark, SF).collect()
    docs = {r["doc_id"]: len(packing.encoder()(r["text"] or "")) + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["length"]
    assert total == Counter(docs) and all(r["piece"] == 0 or r["length"] == 2048 for r in got)
    layout_holds(got, 2048)
    assert len({r["sequence_id"] for r in got}) <= -(-sum(docs.values()) // 2048) + 1
