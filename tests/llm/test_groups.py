"""Benchmarks larger than one group, near-duplicate recall over a whole table, and tables without rows."""

import random

import numpy as np

from pagewright.llm import decontamination, html_text, matroska, minhash, quality
from tests.llm.test_text import brute_hits, shingles

SF = "/root/testdata/sf0.01"


def test_items_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "GROUP_CHARS", 300)
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(rng.choice(["aa", "bb", "Cc", "é1", "dd-ee"], n))
    items = [(i, text(12)) for i in range(30)] + [(None, "nameless words"), (50, ""), (51, None), (3, "again here"), (3, "again here")]
    docs = [None, "", "again HERE, nameless words", *(f"{text(8)} {items[k][1]} {items[k + 3][1]}" for k in range(20))]
    given = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in decontamination.find_contamination(given, bench).collect():
        hits = sum(b - a for a, b in zip(r["span_words"][::2], r["span_words"][1::2]))
        assert (r["n_words"], hits, r["items"]) == brute_hits(docs[r["doc_id"]], items), r["doc_id"]
    clean = decontamination.decontaminate(given, bench)
    assert clean.columns == given.columns
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert left[0] is None and left[1] == "" and all(brute_hits(t, items)[1] == 0 for t in left.values())
    assert decontamination.find_contamination(given.limit(0), bench).count() == 0 and decontamination.decontaminate(given.limit(0), bench).count() == 0


def test_near_duplicates_of_a_whole_table_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(rows).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    sets = sorted(((i, shingles(t)) for i, t in texts.items()), key=lambda x: len(x[1]))
    links = []
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            if len(b) * 0.8 > len(a):
                break
            if a and len(a & b) >= 0.8 * len(a | b) or texts[i] == texts[j]:
                links.append((i, j))
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert len(links) > 20 and got == {i: root(i) for i in texts}


def test_many_copies_beside_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    base = " ".join(words)
    near = [" ".join([*words[:k], "x", *words[k + 1:]]) for k in range(60)]
    rows = [(i, base) for i in range(2000)] + [(5000 + k, t) for k, t in enumerate(near)] + [(9000, "apart from all of these"), (9001, None)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = shingles(base)
    close = {k for k, t in enumerate(near) if len(whole & shingles(t)) >= 0.8 * len(whole | shingles(t))}
    assert close and len(got) == len(rows) and all(got[i] == 0 for i in range(2000)) and all(got[5000 + k] == 0 for k in close) and got[9000] == 9000


def test_tables_without_rows_and_clashing_names(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    pages = spark.createDataFrame([(1, "u", "<p>One, two.</p>", "mine", 5)] * 2 + [(2, None, None, None, None), (3, "v", "<p>" + "Long text, on and on. " * 20_000 + "</p>", "m", 1)],
                                  "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(pages).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 9), (1, 9), (2, 0), (3, 22 * 20_000 - 1)]
    docs = spark.createDataFrame([("a", None, 1), ("a", "", 2), (None, "x y " * 50_000, 3), ("b", "Some text.", 4), ("b", "Some text.", 4)], "doc_id string, text string, stats int")
    measured = quality.statistics_table(docs).collect()
    assert len(measured) == 5 and all(np.isfinite(r["stats"]).all() for r in measured) and measured[0]["stats"] == measured[1]["stats"] and measured[3]["stats"] == measured[4]["stats"]
    assert quality.statistics_table(docs.limit(0)).count() == 0


def test_stored_media_against_a_second_reading(spark):
    """media_bytes, media_sha256 and the feature from a reader of our file that knows only ids, sizes and lengths."""
    import hashlib

    def length(data, at):
        width = 9 - data[at].bit_length()
        return int.from_bytes(data[at: at + width], "big") - (1 << 7 * width), at + width

    def walk(data, at, end):
        while at < end:
            width = 9 - data[at].bit_length()
            ident, at = data[at: at + width].hex(), at + width
            size, at = length(data, at)
            yield ident, at, size
            if ident in ("18538067", "1f43b675", "1c53bb6b", "bb", "b7"):
                yield from walk(data, at, at + size)
            at += size

    for text in (None, "", "short", "é" * 5000, "long text " * 9000):
        n_bytes, n_payload, digest, _, media_bytes, media_sha, feature = matroska.stored_features(text)
        payload, _ = matroska.payload_of(text)
        media = matroska.mux(payload)
        assert (media_bytes, media_sha) == (len(media), hashlib.sha256(media).hexdigest()) and media_bytes > n_payload
        found = list(walk(media, 0, len(media)))
        clusters = sum(i == "1f43b675" for i, _, _ in found)
        facts = dict(x.split("=") for x in feature.split(";"))
        values = np.frombuffer(payload, np.uint8).astype(float)
        assert (int(facts["clusters"]), int(facts["cues"])) == (clusters, sum(i == "bb" for i, _, _ in found))
        assert int(facts["packets"]) == -(-len(payload) // matroska.FRAME) and int(facts["ms"]) == len(payload) * 1000 // matroska.SAMPLE_RATE
        assert float(facts["mean"]) == round(values.mean(), 6) and abs(float(facts["rms"]) - np.sqrt(((values - 128) ** 2).mean())) < 1e-5 and int(facts["levels"]) == len(set(payload))


def test_hundreds_of_items_in_groups_and_a_very_long_document(spark, monkeypatch):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 16)))) for i in range(200)] + [(None, "w1 w2"), (900, None), (7, "again the same id with other words in it for once more")]
    long = [rnd.choice(words) for _ in range(60_000)]
    docs = [(1, " ".join([*long[:30_000], *items[3][1].split(), *long[30_000:]])), (2, items[7][1] + " and " + items[9][1]), (3, "nothing"), (4, None), (4, None), (None, items[11][1])]
    docs += [(100 + i, " ".join(rnd.choice(words) for _ in range(40))) for i in range(50)]
    given = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    read = lambda: sorted(map(str, decontamination.find_contamination(given, asked).collect()))
    once = read()
    for size in (1000, 150):
        monkeypatch.setattr(decontamination, "GROUP_CHARS", size)
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", 100)
        assert read() == once
    assert len(once) == len(docs)


def test_members_of_a_large_bucket_meet_few_central_texts(spark):
    rows = [(f"t{i:03}", 40, band, 200) for i in range(200) for band in (5, 10)]
    large = spark.createDataFrame(rows, "node string, n int, band long, size long")
    met = minhash.central_pairs(large)
    assert met.count() <= 400 * 2


def test_the_exact_way_gives_forests_not_all_pairs(spark):
    """300 near copies of one text that no pivot met gave their 44,850 pairs."""
    import pandas as pd

    rng = np.random.default_rng(8)
    shared_ = rng.integers(0, 1 << 63, 200, np.int64)
    sets = [np.sort(np.concatenate([shared_, rng.integers(0, 1 << 63, 6, np.int64)])).astype(np.uint64) for _ in range(300)]
    rows = [(f"t{i:03}", f"t{i:03}", 206, minhash.bitmap(s)) for i, s in enumerate(sets)]
    block = pd.DataFrame([(*r, q) for q in (True, False) for r in rows], columns=["node", "label", "n", "bits", "query"])
    for forests in (1, 4):
        got = minhash.likely_links(block, 0.8, forests)
        assert got["a"].isna().sum() == 1 and 299 <= len(got.dropna()) <= 300 * forests
    whole = minhash.likely_links(block, 0.8, 400)
    assert not whole["a"].isna().any() and len(whole.drop_duplicates()) == 300 * 299 // 2


def test_pairs_that_fail_hide_no_link(spark, monkeypatch):
    """Bitmaps that bound nothing: nearly all that the forests rely on fails, and still each link counts."""
    monkeypatch.setattr(minhash, "bitmap", lambda shingles: bytes(512))
    rng = np.random.default_rng(9)
    core, sets = rng.integers(0, 1 << 62, 60, np.int64), []
    for i in range(60):
        own = rng.permutation(core)[: rng.integers(48, 61)]
        sets.append(np.sort(np.concatenate([own, rng.integers(0, 1 << 62, rng.integers(0, 12), np.int64)])))
    names = [f"t{i:02}" for i in range(60)]
    large = spark.createDataFrame([(t, len(s), band, 60) for t, s in zip(names, sets) for band in (1, 2)], "node string, n int, band long, size long")
    made = spark.createDataFrame([(t, s.tolist(), bytes(512)) for t, s in zip(names, sets)], "node string, shingles array<long>, bits binary")
    none = spark.createDataFrame([], "node string, label string")
    got = {r["node"]: r["label"] for r in minhash.links_left(large, none, made, 0.8).collect()}
    want = {t: t for t in names}
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(a, sets[j]))
            if common >= 0.8 * (len(a) + len(sets[j]) - common):
                old, new = sorted((want[names[i]], want[names[j]]), reverse=True)
                want = {t: new if x == old else x for t, x in want.items()}
    assert 3 < len(set(want.values())) < 57 and {t: got.get(t, t) for t in names} == want
