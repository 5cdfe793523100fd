"""Secret findings at length, copies of one text, and redaction against a plain version."""

import random
import re
import time

from pagewright.llm import secrets, shared
from tests.llm.test_text import brute_spans

SCHEMA = "doc_id long, text string, n_chars long"


def plain_redaction(text, findings):
    out, at = "", 0
    for f in findings:
        if f["start"] >= at:
            out += text[at: f["start"]] + "[SECRET]"
        at = max(at, f["end"])
    return out + text[at:]


def found(spark, texts, rules=secrets.RULES):
    versions = secrets.with_blob(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return {r["doc_id"]: r["findings"] for r in secrets.findings_of(versions.select("doc_id", "blob"), secrets.scan(versions.select("blob", "text"), rules=rules)).collect()}


def test_many_findings_in_one_text(spark):
    began = time.time()
    text = "é token=abcdefgh " * 100_000
    docs = spark.createDataFrame([(1, text, len(text))], SCHEMA)
    findings = found(spark, [text])[0]
    assert len(findings) == 100_000 and (findings[99_999]["start"], findings[99_999]["end"]) == (17 * 99_999 + 2, 17 * 99_999 + 16)
    r = secrets.redacted(docs).first()
    assert r["text"] == "é [SECRET] " * 100_000 and r["n_chars"] == len(r["text"])
    assert time.time() - began < 120


def test_redaction_against_a_plain_version(spark):
    rng = random.Random(7)
    parts = ["token=abcdefgh", "secret: token=abcdefghijk", "AKIAABCDEFGHIJKLMN", "api_key=" + "0123456789abcdef" * 3, "password=ghp_" + "Z" * 40, "😀é", "x" * 700, " ", "\n", "plain words", "a" * 40]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    findings = found(spark, texts)
    for i, text in enumerate(texts):
        assert ",".join(f"{f['kind']}:{f['start']}:{f['end']}" for f in findings[i] if f["rank"] < secrets.BASE) == brute_spans(text)
    got = {r["doc_id"]: r["text"] for r in secrets.redacted(spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got == {i: plain_redaction(t, findings[i]) for i, t in enumerate(texts)}


def test_copies_of_one_text_are_dealt_to_parts(spark):
    texts = ["token=abcdefgh here"] * 3000 + [f"password = hunter2hunter{i % 5}" for i in range(50)] + [None, "clean"]
    got = found(spark, texts)
    assert len(got) == len(texts) and all(len(got[i]) == 1 for i in range(3050)) and got[3050] == got[3051] == []
    versions = secrets.with_blob(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "blob")
    facts = versions.groupBy("blob").count()
    dealt = shared.spread_join(versions, facts, "blob")
    assert dealt.count() == len(texts) and dealt.where("count = 3000").count() == 3000 and dealt.columns == ["blob", "doc_id", "count"]
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(blob#\d+, _salt#\d+", plan)


def test_findings_of_several_ledgers(spark):
    versions = secrets.with_blob(spark.createDataFrame([(1, "token=abcdefgh AKIAABCDEFGHIJKL"), (2, "token=abcdefgh AKIAABCDEFGHIJKL")], "doc_id long, text string"))
    first = secrets.scan(versions.select("blob", "text"), rules=secrets.RULES[:1])
    both = first.unionByName(secrets.scan(versions.select("blob", "text"), first, secrets.RULES))
    got = secrets.findings_of(versions.select("doc_id", "blob"), both).collect()
    assert [[f["kind"] for f in r["findings"]] for r in got] == [["assign", "access"]] * 2
    assert secrets.redacted(spark.createDataFrame([], SCHEMA)).count() == 0
