"""Page files: what filters leave unread, and files that are whole or not there."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagewright.plans.catalog import document_pages
from pagewright.sources import page_files
from pagewright.sources.pages import parsed_pages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("books")
    page_files.write_whole_files(page_files.page_file_rows(document_pages(spark, SF)), str(base))
    return base


def test_pages_of_documents_come_back(spark, library):
    got = parsed_pages(page_files.read_page_files(spark, str(library), run=7)).select("book", "page_num", "sections")
    want = document_pages(spark, SF)
    assert {str(r) for r in got.collect()} == {str(r) for r in want.collect()}
    assert not [p for p in library.rglob("*.part")]


@pytest.mark.parametrize("condition, keeps", [
    ("book = '{b}' AND page_num BETWEEN 3 AND 9", lambda book, n, b: book == b and 3 <= n <= 9),
    ("page_num IN (2, 4)", lambda book, n, b: n in (2, 4)),
    ("book <> '{b}' AND page_num < 3", lambda book, n, b: book != b and n < 3),
    ("startswith(book, '{c}') AND page_num = 1", lambda book, n, b: book.startswith(b[:3]) and n == 1),
])
def test_filters_reach_the_source_and_other_files_stay_unread(spark, library, tmp_path, condition, keeps):
    pages = [(r["book"], r["page_num"]) for r in document_pages(spark, SF).select("book", "page_num").collect()]
    book = max(pages)[0]
    # Files of other pages are folders: opening one would fail.
    for name, number in pages:
        title = name.rsplit("/", 1)[-1]
        file = tmp_path / name / "tmp" / f"{title}_{number:04d}.ocr.json"
        file.parent.mkdir(parents=True, exist_ok=True)
        if keeps(name, number, book):
            file.write_bytes((library / name / "tmp" / file.name).read_bytes())
        else:
            os.mkfifo(file) if number % 2 else file.mkdir()
    read = page_files.read_page_files(spark, str(tmp_path)).where(condition.format(b=book, c=book[:3]))
    assert sorted((r["book"], r["page_num"]) for r in read.collect()) == sorted(p for p in pages if keeps(*p, book))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan page_files" in plan and ") Filter " not in plan and "- Filter " not in plan


def test_a_filter_on_values_stays_with_spark(spark, library):
    read = page_files.read_page_files(spark, str(library))
    assert read.where("page_num = 1 AND length(value) > 10").count() == read.where("page_num = 1").collect().__len__()


def test_odd_files_and_empty_folders(spark, tmp_path):
    folder = tmp_path / "b" / "tmp"
    folder.mkdir(parents=True)
    for name, text in (("b_1.ocr.json", "[1]"), ("b_0001.ocr.json", "{}"), ("c_0001.ocr.json", "no"), ("b_x.ocr.json", "no"), ("b_0002.txt", "no"), ("b_99999999999.ocr.json", "no")):
        (folder / name).write_text(text)
    got = page_files.read_page_files(spark, str(tmp_path)).collect()
    assert sorted((r["page_num"], r["file_name"], r["value"]) for r in got) == [(1, "b_0001.ocr.json", "{}"), (1, "b_1.ocr.json", "[1]")]
    (tmp_path / "none").mkdir()
    assert page_files.read_page_files(spark, str(tmp_path / "none")).count() == 0
    assert page_files.read_page_files(spark, str(tmp_path / "gone")).count() == 0


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    page_files.write_whole_files(spark.createDataFrame([("a.md", "old"), ("b.md", "old")], "file string, value string"), str(tmp_path))
    rows = spark.range(40).repartition(4).select(F.concat("id", F.lit(".md")).alias("file"), F.expr("CASE WHEN id = 33 THEN raise_error('no') ELSE 'new' END").alias("value"))
    with pytest.raises(Exception):
        page_files.write_whole_files(rows, str(tmp_path))
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a.md": "old", "b.md": "old"}


def test_a_task_that_fails_once_leaves_no_half_file_and_no_double(spark, tmp_path):
    writer = page_files.FileWriter(str(tmp_path), True)

    def failing():
        yield ("x.md", "first attempt")
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(failing())
    assert not list(tmp_path.iterdir())
    lost = writer.write(iter([("x.md", "never committed"), ("sub/y.md", "never committed")]))  # an attempt whose answer was lost
    done = writer.write(iter([("x.md", "second"), ("sub/y.md", None)]))
    assert len(lost.files) == 2 and all(p.name.endswith(".part") for p in tmp_path.rglob("*") if p.is_file())
    writer.commit([done, None])
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {"x.md": "second", "sub/y.md": ""}


def test_overwrite_removes_other_files_and_append_keeps_them(spark, tmp_path):
    one = lambda name: spark.createDataFrame([(name, name)], "file string, value string")
    page_files.write_whole_files(one("a.md"), str(tmp_path))
    page_files.write_whole_files(one("b.md"), str(tmp_path), mode="append")
    assert sorted(p.name for p in Path(tmp_path).iterdir()) == ["a.md", "b.md"]
    page_files.write_whole_files(one("c.md"), str(tmp_path))
    assert sorted(p.name for p in Path(tmp_path).iterdir()) == ["c.md"]
