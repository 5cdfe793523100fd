"""Secrets, near-duplicates, extraction, chat and decontamination against brute force and on odd inputs."""

import hashlib
import html
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import chat, decontamination, fm_index, html_text, minhash, queries, secrets

SF = "/root/testdata/sf0.001"
PATTERNS = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]+", 0, 32)}


def brute_spans(text):
    out = []
    for rank, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


SECRET_TEXTS = [
    None, "", "token=abcdefgh", "TOKEN = 'abcdefghij' and api-key: no", "api_key:\"Zz9/+=._-\" apikey=12345678", "secret=token= abcdefghijk", "secret=token=abcdefghijk token:short",
    "😀😀 password=b7db7aa4a5fcc78305 é AKIAABCDEFGHIJKL", "AKIA" * 5, "AKIAAKIA", "0" * 31 + " " + "a" * 32 + "g" + "f" * 40, "token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\"",
    "passwd='" + "x" * 50_000, "token=aaaaaaaa " * 2000, "SECRET\n=abcdefgh", "ſecret=abcdefgh toKen=abcdefgh",
]


def secret_rows(spark, texts):
    return spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, findings string")


def test_spans_against_brute_force(spark):
    versions = secrets.with_blob(secret_rows(spark, SECRET_TEXTS).drop("findings"))
    found = secrets.findings_of(versions.select("doc_id", "blob"), secrets.scan(versions.select("blob", "text"))).collect()
    for r in found:
        base = ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in r["findings"] if f["rank"] < secrets.BASE)
        assert base == brute_spans(SECRET_TEXTS[r["doc_id"]]), r["doc_id"]
    assert len(found) == len(SECRET_TEXTS)


def test_ledger_scans_only_what_it_lacks(spark):
    first = secrets.with_blob(secret_rows(spark, ["token=abcdefgh", "token=abcdefgh", "nothing"]))
    ledger = secrets.scan(first.select("blob", "text"), rules=secrets.RULES[:2])
    assert ledger.count() == 2
    second = secrets.with_blob(secret_rows(spark, ["token=abcdefgh", "AKIAABCDEFGHIJKL"]))
    assert secrets.scan(second.select("blob", "text"), ledger, secrets.RULES[:2]).count() == 1
    more = secrets.scan(second.select("blob", "text"), ledger, secrets.RULES[:3]).collect()
    assert sorted(len(r["rules"]) for r in more) == [1, 3]
    whole = secrets.scan(second.select("blob", "text"), ledger.unionByName(secrets.scan(second.select("blob", "text"), ledger)))
    assert whole.count() == 0
    assert secrets.scan(second.select("blob", "text").limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "x token=abcdefgh y AKIAABCDEFGHIJKL", 9, "a"), (2, None, None, "b"), (3, "plain", 5, "c"), (3, "plain", 5, "c")],
                                 "doc_id long, text string, n_chars long, blob string")
    docs = docs.selectExpr("*", "7 AS findings", "'r' AS row")
    got = {tuple(r) for r in secrets.redacted(docs).collect()}
    assert got == {(1, "x [SECRET] y [SECRET]", 21, "a", 7, "r"), (2, None, None, "b", 7, "r"), (3, "plain", 5, "c", 7, "r")} and secrets.redacted(docs).count() == 4


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i: i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_classes(texts):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    return {i: min(j for j in range(len(texts)) if root(j) == root(i)) for i in range(len(texts))}


def near_texts():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    base = [" ".join(word() for _ in range(120)) for _ in range(12)]
    texts = [None, "", "", " ", "one", "One", "one two three", "x " * 30_000, "x " * 29_999]
    for b in base:
        w = b.split()
        texts.append(b)
        for _ in range(6):
            v = list(w)
            for i in rng.choice(len(v), int(rng.integers(1, 4)), replace=False):
                v[i] = word()
            texts.append(" ".join(v))
    hub = base[0].split()
    for k in range(40):  # one close group larger than SMALL
        v = list(hub)
        v[k] = word()
        texts.append(" ".join(v))
    return [*texts, *texts[:3], *texts[20:23]]


def test_near_duplicates_against_brute_force(spark):
    texts = near_texts()
    given_ = spark.createDataFrame([(i, t, 1, "b") for i, t in enumerate(texts)], "doc_id long, text string, n int, bands string").selectExpr("*", "doc_id AS key", "'x' AS node", "0 AS row")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(given_).collect()}
    assert got == brute_classes(texts)
    one = minhash.one_of_each(given_)
    assert one.columns == given_.columns and {r["node"] for r in one.collect()} == {"x"} and sorted(r["doc_id"] for r in one.collect()) == sorted(set(got.values()))


def test_near_duplicates_odd_keys(spark):
    rows = [(None, "same text"), (None, "same text"), (5, "same text"), (6, "other"), (6, "other"), (None, "alone")]
    given_ = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in minhash.near_duplicates(given_).collect()) == [
        ("5", "5"), ("6", "6"), ("6", "6"), ("None", "5"), ("None", "5"), ("None", "None")]
    assert sorted(map(str, (tuple(r) for r in minhash.one_of_each(given_).collect()))) == ["(5, 'same text')", "(6, 'other')", "(None, 'alone')"]
    assert minhash.near_duplicates(given_.limit(0)).count() == 0


def test_signatures_estimate_weighted_overlap():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = np.sort(pool[:3000]), np.sort(pool[1000:])
    sign = minhash.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    both = minhash.weights(np.intersect1d(a, b)).sum() / minhash.weights(np.union1d(a, b)).sum()
    assert abs((sign[0] == sign[1]).mean() - both) < 0.2 and (sign != np.uint64(2**64 - 1)).mean() > 0.95


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">Blog</a></ul></nav><div class="ad-box">Buy now, today.</div>
%s<form><label>Mail</label><input value="x"><button>Go</button></form><aside>Side notes, here.</aside>
<div id="comments"><p>First comment, long enough to look like an article, really.</p></div><footer>&copy; 2024, all rights.</footer></body></html>"""
BODY = "<h2>Head &amp; line</h2><p>One <b>bold</b>\n  text,&nbsp;with <a href='x>y'>a link</a>.<p>Two<br>lines. &lt;tag&gt;</p><ul><li>Item one.<li>Item two.</ul>"
TEXT = "Head & line\nOne bold text, with a link.\nTwo\nlines. <tag>\nItem one.\nItem two."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><div>%s</div></main>"])
def test_main_text(wrap):
    assert html_text.main_text(PAGE % (wrap % BODY)) == TEXT


def test_main_text_without_marks():
    long = "".join(f"<p>Sentence number {i}, with words, and more words, and an end. It goes on, as they do.</p>" for i in range(8))
    got = html_text.main_text(PAGE % f"<div><div>{long}</div></div>")
    assert got.count("\n") == 7 and got.startswith("Sentence number 0,") and "Home" not in got and "comment" not in got


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "text only", "</p></p>", "<article></article>", "<p a='x>" * 200, "<div>" * 3000 + "deep text"])
def test_main_text_odd_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_main_text_on_generated_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.queries()["op6_html_extraction"](spark, SF).collect():
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        lines = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article))
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "<|im_sep|>"]),
                          st.one_of(st.text(max_size=30), st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\\\\", "<", "|", "im_end", "x", "\n"]), max_size=8).map("".join))), max_size=5))
def test_chat_round_trip(turns):
    formatted, spans = chat.format_conversation(turns)
    assert chat.parse_conversation(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [x for r, x in turns if r == "assistant"]
    assert not any(c in chat.escape(x) for _, x in turns for c in chat.CONTROLS)


def test_reply_tree_takes_the_best_branch(spark):
    #      1 -> 2 -> 4 (score 9); 1 -> 3 -> 5 -> 6; 7 is a second root, 8's parent is missing
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 1.0), ("t", 4, 2, 9.0), ("t", 3, 1, 2.0), ("t", 5, 3, 2.0), ("t", 6, 5, None), ("t", 7, None, 0.0), ("t", 8, 99, 0.0)]
    nodes = spark.createDataFrame(rows, "tree string, node long, parent long, score double")
    paths = {}
    for r in chat.reply_paths(nodes, best=2).collect():
        paths.setdefault((r["root"], r["branch"]), []).append((r["depth"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {(1, 1): [1, 2, 4], (1, 2): [1, 3, 5, 6], (7, 1): [7], (8, 1): [8]}
    with pytest.raises(ValueError, match="cycle"):
        chat.reply_paths(spark.createDataFrame([("t", 1, 2, 0.0), ("t", 2, 1, 0.0)], "tree string, node long, parent long, score double"))


def test_conversations_odd_rows(spark):
    rows = [(None, 0, "user", "a", 1), (None, 1, "assistant", "b", 1), (3, None, None, None, 1), (3, 0, "user", "", 1), (3, 0, "user", "", 1)] + [(4, i, "user" if i % 2 == 0 else "assistant", f"</s>{i}", 1) for i in range(70)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    got = {r["conv_id"]: r for r in chat.format_conversations(chat.chain_nodes(convs)).collect()}
    sha = lambda t: hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
    assert got[None]["turns_sha256"] == sha([("user", "a"), ("assistant", "b")]) and got[3]["turns_sha256"] == sha([("user", ""), ("user", ""), ("", "")])
    assert got[4]["n_turns"] == 70 and got[4]["loss_chars"] == sum(len(f"</s>{i}") for i in range(1, 70, 2))
    assert chat.format_conversations(chat.chain_nodes(convs.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=120), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_fm_index_against_scanning(text, pattern):
    index = fm_index.FMIndex(np.array(text, np.int64), 5, sample=4)
    which, low, high = index.find(np.array([pattern], np.int64))
    rows = np.arange(low[0], high[0]) if len(which) else np.zeros(0, np.int64)
    assert sorted(index.locate(rows).tolist()) == [i for i in range(len(text) - len(pattern) + 1) if text[i: i + len(pattern)] == pattern]


def test_fm_index_on_copies():
    text = np.tile(np.random.default_rng(0).integers(2, 900, 500), 40)
    index = fm_index.FMIndex(text, 900)
    which, low, high = index.find(text[None, 100:110])
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == [100 + 500 * k for k in range(40)]


def brute_hits(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, named = low(text), set(), set()
    for item, t in items:
        own = low(t)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            w = own[i: i + window]
            for j in range(len(words) - len(w) + 1):
                if words[j: j + len(w)] == w:
                    hit |= set(range(j, j + len(w)))
                    named |= {item} - {None}
    return len(words), len(hit), sorted(map(str, named))


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(rng.choice(["aa", "bb", "Cc", "é1", "dd-ee"], n))
    items = [(i, text(int(rng.integers(11, 16)))) for i in range(12)] + [(50, "Short one"), (51, ""), (52, None), (None, "nameless words"), (1, "again"), (9, "aa bb")]
    docs = [None, "", "short ONE. short one", "x nameless, words y", *(text(int(rng.integers(1, 200))) for _ in range(40)), *(f"{text(30)} {items[k][1]} {text(5)}" for k in range(12)),
            " ".join(t or "" for _, t in items), "zz " * 20_000 + items[3][1]]
    given_ = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontamination.BLOCK_CHARS, 40):
        decontamination.BLOCK_CHARS, before = size, decontamination.BLOCK_CHARS
        try:
            decontamination.blocks.__defaults__ = (size,)
            for r in decontamination.find_contamination(given_.drop("n_words"), bench).collect():
                hits = sum(b - a for a, b in zip(r["span_words"][::2], r["span_words"][1::2]))
                assert (r["n_words"], hits, r["items"]) == brute_hits(docs[r["doc_id"]], items), r["doc_id"]
        finally:
            decontamination.BLOCK_CHARS = before
            decontamination.blocks.__defaults__ = (before,)
    none = decontamination.find_contamination(given_.drop("n_words"), bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["span_words"] for r in none)


def test_decontaminate_cuts_spans_only(spark):
    phrase = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Keep this, {phrase.upper()}; and this.", 0, [1]), (2, phrase, 0, None), (3, None, None, None), (4, "clean", 5, [2, 3]), (5, "", 0, None)],
                                 "doc_id long, text string, n_chars long, items array<int>")
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["items"]) for r in decontamination.decontaminate(docs, spark.createDataFrame([(1, phrase)], "item_id long, text string")).collect()}
    assert got == {1: ("Keep this, ; and this.", 22, [1]), 3: (None, None, None), 4: ("clean", 5, [2, 3]), 5: ("", 0, None)}


def test_near_duplicates_exact_way_for_open_buckets(spark, monkeypatch):
    monkeypatch.setattr(minhash, "central_pairs", lambda large: large.limit(0).selectExpr("node AS a", "n", "node AS b", "n AS n2"))
    texts = near_texts()[:75]
    given_ = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(given_).collect()} == brute_classes(texts)


def test_deep_and_broken_pages_stay_linear():
    import time

    began = time.time()
    for page in ("<div>" * 40_000 + "x" + "</p>" * 10_000, "<b>" * 30_000 + "<p>a" * 5_000, "</div>" * 50_000):
        html_text.main_text(page)
    assert time.time() - began < 20


def test_large_ids_beside_nulls(spark):
    big = (1 << 60) + 1
    for name, rows, schema, run in (
        ("page_id", [(big, "u", "<p>x, y.</p>"), (None, None, None)], "page_id long, url string, html string", html_text.extract),
        ("conv_id", [(big, 0, "user", "a"), (None, 0, "user", "b")], "conv_id long, turn long, role string, text string", lambda d: chat.format_conversations(chat.chain_nodes(d))),
    ):
        assert {r[name] for r in run(spark.createDataFrame(rows, schema)).collect()} == {big, None}
