"""The pipeline's stages against brute force on planted documents, and the shape of the whole."""

import corpus_pipeline

from pagewright.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.schema == docs.schema, name
        rows = after.collect()
        assert {r["doc_id"] for r in rows} <= ids and len(rows) == len({r["doc_id"] for r in rows}) and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_planted_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    base = " ".join(f"planted{i}" for i in range(200))
    planted = [(90001, base), (90002, base), (90003, base + " tail"), (90004, "before this. " + passage + " and after it."), (90005, "my password=hunter2hunter2 stays"), (90006, None)]
    more = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in planted], docs.schema)
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"s{number}"))
        now = spark.read.parquet(str(tmp_path / f"s{number}"))
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    assert 90001 in texts and 90002 not in texts and 90003 not in texts
    assert "before this." in texts[90004] and "and after it." in texts[90004] and passage[20:80] not in texts[90004]
    assert texts[90005] == "my [SECRET] stays" and 90006 in texts
    mixed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert mixed and all(r["taken"] == r["size"] * r["copies"] and 1 <= r["copies"] <= 3 for r in mixed) and {r["doc_id"] for r in mixed} <= set(texts)


def test_pipeline_is_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and len([q for q in queries.queries() if q.startswith("op")]) == 13
