"""The stream forms give what the batch forms give."""

import json

from pagewright.plans import fixtures as X
from pagewright.streaming import pages as S


def run(query_frame, name, mode="append"):
    query = query_frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return query_frame.sparkSession.table(name).collect()


def test_page_files_arrive(spark, tmp_path):
    (tmp_path / "b_0001.ocr.json").write_text(json.dumps({"sections": [{"type": "page_number", "text": "03."}, {"type": "title", "text": "T"}, {"text": "a\nb"}]}))
    rows = run(S.prepared_pages(S.read_pages(spark, str(tmp_path))), "arrived")
    assert [(s["type"], s["text"]) for s in rows[0]["prepared"]] == [("section_title", "03. T"), ("body", "ab")]


def test_ends_of_books(spark, tmp_path):
    spark.sql(X.CAPTURES).repartition(1).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("book string, page_num int, digest string").parquet(str(tmp_path / "c"))
    assert sorted(map(tuple, run(S.ends_of_books(stream), "ends"))) == [("aaa", 1), ("aabbb", 3), ("late", 5)]
