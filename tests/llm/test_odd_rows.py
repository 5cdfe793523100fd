"""Odd rows through whole operators: long texts, ties without ids, clashing names, tables without rows."""

import zlib

from pagewright.llm import labelled, matroska, mixing, ngram_lm, quality, queries

SF = "/root/testdata/sf0.001"


def test_mix_of_long_texts_and_ties_without_ids(spark):
    rows = [(None, "same words here", "a")] * 300 + [(1, "long " * 300_000, "a"), (2, "b", "b"), (2, "b", "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and {r["size"] for r in got} == {3, 300_000, 1} and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).groupBy("source").sum("taken").collect()


def test_quality_and_media_queries_on_odd_tables(spark, tmp_path):
    rows = [(i, f"Plain words of text {i}, which go on. " * 9 if i % 2 else "*** bad *** ||| " * 9, "x") for i in range(80)]
    rows += [(None, None, None), (900, "", "x"), (900, "", "x"), (901, "word " * 100_000, "x"), (3, "Plain words again", "x")]
    rows = [(*r, r[2]) for r in rows]
    schema = "doc_id long, text string, score string, source string"
    labels = [(i, i % 2, 0) for i in range(80)] + [(None, 1, 1), (4, None, None)]
    for name, given in (("full", rows), ("none", [])):
        spark.createDataFrame(given, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
    for query in ("op2_quality", "op3_toxicity", "op8_media_matroska", "op9_lm_scoring", "op1_mixing", "op4_secret_scans"):
        got = queries.queries()[query](spark, str(tmp_path / "full")).collect()
        assert len(got) == len(rows), query
        assert queries.queries()[query](spark, str(tmp_path / "none")).count() == 0, query
    scores = {r["doc_id"]: r for r in queries.queries()["op2_quality"](spark, str(tmp_path / "full")).collect()}
    held = [i for i in range(80) if zlib.crc32(str(i).encode()) % 5 == 0 and i != 3]
    assert all(scores[i]["held_out"] and (scores[i]["score"] > 0.5) == (i % 2 == 1) for i in held)


def test_language_scores_of_shuffled_rows_with_clashing_names(spark):
    rows = [(i, f"a b c d{i % 7} " * (i % 5), i % 5 != 1, 1, 2, "k") for i in range(300)]
    given = spark.createDataFrame(rows, "doc_id long, text string, train boolean, chunk int, shard int, key string")
    once = {r["doc_id"]: r["score"] for r in ngram_lm.language_scores(given).collect()}
    again = {r["doc_id"]: r["score"] for r in ngram_lm.language_scores(given.repartition(11, "text")).collect()}
    assert len(once) == 300 and all(abs(once[i] - again[i]) < 1e-9 for i in once)


def test_sample_of_labelled_texts_is_one_row_an_id(spark):
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(50) for k in range(3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] * 2, "doc_id long, toxic int")
    got = [r["text"].split()[1] for r in labelled.labelled_texts(docs, labels, "toxic").collect()]
    assert len(got) == len(set(got)) > 30


def test_statistics_of_equal_texts(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["A b, c. " * 50] * 2 + [None, ""])], "doc_id long, text string")
    got = {r["doc_id"]: r["stats"] for r in quality.statistics_table(docs).collect()}
    assert got[0] == got[1] and got[2] == got[3] and matroska.stored_features(None) == matroska.stored_features("")


def test_documents_without_words_have_no_copies(spark):
    rows = [(1, "", "a"), (2, None, "a"), (3, " ", "small"), (4, "", None), (5, "three words here", "small"), *((10 + i, "many words " * 50, "b") for i in range(20))]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["copies"] == got[i]["taken"] == 0 for i in (1, 2, 3, 4)) and got[5]["copies"] == 3
