"""Needles in texts against plain counting, in one group and in many."""

import random

import pytest

from pagewright.operators import matching


def overlapping(text: str, needle: str) -> int:
    return sum(text.startswith(needle, i) for i in range(len(text)))


@pytest.mark.parametrize("most", [1 << 20, 12, 1])
def test_matches_against_plain_counting(spark, most):
    rnd = random.Random(most)
    texts = [(i, "".join(rnd.choice("aAbB ßSẞİς") for _ in range(rnd.randrange(40))), "x") for i in range(60)] + [(98, None, "x"), (99, "", "x"), (1, "aaaa", "x"), (1, "aaaa", "x")]
    needles = ["a", "AA", "ab", "aa", "SS", "ß", "Σ", "i̇", "b b", "", None, "nowhere at all"]
    given = spark.createDataFrame(texts, "id long, text string, needle_ string")
    asked = spark.createDataFrame([(n,) for n in needles], "title string")
    got = sorted((r["id"], r["needle"], r["n"]) for r in matching.matches(given, "text", asked, "title", most).collect())
    folded = {n.casefold() for n in needles if n}
    want = sorted((i, n, c) for i, t, _ in texts for n in folded if (c := overlapping((t or "").casefold(), n)))
    assert got == want


def test_nothing_to_find(spark):
    given = spark.createDataFrame([(1, "text")], "id long, text string")
    none = spark.createDataFrame([("",), (None,)], "title string")
    assert matching.matches(given, "text", none, "title").collect() == []
    assert matching.matches(given.limit(0), "text", spark.createDataFrame([("t",)], "title string"), "title").collect() == []
