"""Each stage of the pipeline, on what its predecessor kept, against a plain version; tables without rows."""

import corpus_pipeline

from pagewright.llm import mixing, secrets, toxicity
from tests.llm.test_findings import found, plain_redaction
from tests.llm.test_text import brute_classes, brute_hits

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    stages = dict(corpus_pipeline.STAGES)

    def after(name, given):
        stages[name](spark, given, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    calm = after("toxicity", docs)
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_table(docs.select("doc_id", "text"), model).collect()}
    assert texts(calm) == {i: t for i, t in texts(docs).items() if scores[i] < 0.5}

    single = after("near_duplicates", calm)
    given = sorted(texts(calm).items())
    classes = brute_classes([t for _, t in given])
    assert texts(single) == {given[k][0]: given[k][1] for k in set(classes.values())}

    clean = after("decontamination", single)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, now = texts(single), texts(clean)
    hits = {i: brute_hits(t, items[:10])[1] for i, t in sorted(before.items())[:40]}
    assert set(now) <= set(before) and all(i not in now or now[i] != before[i] for i, n in hits.items() if n)
    assert all(now[i] in before[i] or len(now[i]) < len(before[i]) for i in now if now[i])

    hidden = after("secrets", clean)
    listed = sorted(now.items())
    findings = found(spark, [t for _, t in listed], secrets.RULES)
    assert texts(hidden) == {i: plain_redaction(t, findings[k]) if findings[k] else t for k, (i, t) in enumerate(listed)}

    mixed = stages["mixing"](spark, hidden, SF).collect()
    whole = mixing.mix(hidden.select("doc_id", "text", "source")).collect()
    assert sorted(r["doc_id"] for r in mixed) == sorted(r["doc_id"] for r in whole if r["copies"] > 0)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
