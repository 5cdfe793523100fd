"""Files in, files out: page files, state, comments in JSON, adapters, sinks."""

import json
import zlib

import pytest

from pagewright.sources import adapters, sinks
from pagewright.sources import pages as P


@pytest.fixture
def folder(tmp_path):
    tmp = tmp_path / "My Book" / "tmp"
    tmp.mkdir(parents=True)
    for name, text in {
        "My Book_0002.ocr.json": json.dumps({"page": 9, "sections": [{"type": " Title", "text": " x "}, "bad", {"text": None}, {"type": "new", "text": "y"}]}),
        "My Book_0001.ocr.json": "[1]", "My Book_12345.ocr.json": "{broken", "My Book_x.ocr.json": "{}", "other.json": "{}",
        "My Book_0001.txt": "one", "My Book_0002.txt": "two",
    }.items():
        (tmp / name).write_text(text, encoding="utf-8")
    return tmp


def test_page_files(spark, folder):
    rows = {r["page_num"]: [(s["type"], s["text"]) for s in r["sections"]] for r in P.load_ocr_pages(spark, str(folder)).collect()}
    assert rows == {2: [("title", "x"), ("new", "y")], 1: [], 12345: []}
    assert P.load_ocr_pages(spark, str(folder)).first()["book"] == "My Book"


def test_no_page_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        P.load_ocr_pages(spark, str(tmp_path))


def test_combined_text_sink(spark, folder, tmp_path):
    books = P.combined_text(P.whole_files(spark, str(folder)))
    sinks.write_texts(books, "combined", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first()["value"] == "=== page 1 ===\none\n\n=== page 2 ===\ntwo\n"


def test_state_and_log(spark, tmp_path):
    files = spark.createDataFrame([("b", '{"phases": {"ocr": {"3": {"status": "done"}, "4": {"status": "failed", "error": "e"}}}}'), ("c", "{no"), ("d", "[]")], "book string, value string")
    assert sorted(map(tuple, P.job_state(files).collect())) == [("b", "ocr", 3, "done"), ("b", "ocr", 4, "failed")]
    path = str(tmp_path / "log")
    for seq, status in enumerate(["failed", "done"]):
        sinks.append_state(spark.createDataFrame([("b", "ocr", 1, status, seq)], "book string, phase string, page_num int, status string, seq long"), path)
    from pagewright.operators.planning import last_status

    assert last_status(spark.read.parquet(path)).first()["status"] == "done"


def test_languages(spark, tmp_path):
    (tmp_path / "l.csv").write_text("﻿lang,code\nKorean,ko\n", encoding="utf-8")
    assert P.languages(spark, str(tmp_path / "l.csv")).collect() == [("Korean", "ko")]


def test_comments_outside_strings_only():
    assert P.load_jsonc('{"a": "// no /* */ \\" x", // yes\n "b": /* gone */ 2}') == {"a": '// no /* */ " x', "b": 2}


def test_atomic_json(tmp_path):
    sinks.atomic_json(str(tmp_path / "d" / "x.json"), {"가": 1})
    assert (tmp_path / "d" / "x.json").read_text(encoding="utf-8") == '{\n  "가": 1\n}'
    assert [p.name for p in (tmp_path / "d").iterdir()] == ["x.json"]


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise RuntimeError("429 too many")

    with pytest.raises(RuntimeError):
        adapters.with_retry(call, waits.append)
    assert waits == [2, 4, 8, 16] and len(calls) == 5
    with pytest.raises(KeyError):
        adapters.with_retry(lambda: {}["x"], waits.append)


def test_ocr_adapter_and_empty_retry(spark):
    from pagewright.operators.sanitize import with_empty_retry

    pages = spark.createDataFrame([("b", 1, bytearray(b"img"), "p")], "book string, page_num int, image binary, prompt string")
    replies = adapters.ocr(pages, lambda image, prompt: '{"text": "%s %s"}' % (image.decode(), prompt))
    assert replies.first()["reply"] == '{"text": "img p"}'
    given = spark.createDataFrame([("b", 1, '{"text": ""}'), ("b", 2, '{"text": "t"}')], "book string, page_num int, reply string")
    again = with_empty_retry(given, lambda empty: empty.selectExpr("book", "page_num", "'{\"text\": \"second\"}' AS reply"))
    assert {r["page_num"]: r["text"] for r in again.collect()} == {1: "second", 2: "t"}


def test_unknown_mode_raises(spark):
    from pyspark.sql import functions as F

    from pagewright.operators.settings import OUTPUT_MODES, normalized

    with pytest.raises(Exception, match="not one of"):
        spark.range(1).select(normalized(F.lit("video"), OUTPUT_MODES)).collect()
