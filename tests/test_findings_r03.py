"""Rules that the third round's findings led to."""

import random
import sys
import time
import unicodedata

from pyspark.sql import functions as F

from pagewright.functions import unicode as U
from pagewright.operators import sections
from pagewright.plans import catalog
from pagewright.sources import page_files, pdf_read
from tests.test_pdf import FILES, stream, table_of


def test_normal_form_of_long_lines_takes_time_in_proportion(spark):
    """Letters beyond ASCII in a line of a whole document: its pieces are normalised apart."""
    rnd = random.Random(5)
    odd = [c for c in map(chr, range(0x80, 0xD7A4)) if unicodedata.normalize("NFKC", c) != c or unicodedata.combining(c)]
    texts = ["naïve größer œuvre " * 4000, "각ᆨ가" * 9000, "e" + "̣́" * 6000, "".join(rnd.choice([rnd.choice(odd), "é", "a", "́"]) for _ in range(9000)), ""]
    texts += ["".join(rnd.choice([chr(rnd.choice([rnd.randrange(0x20, 0x2000), rnd.randrange(0xA000, sys.maxunicode)])), rnd.choice(odd)]) for _ in range(9)) for _ in range(2000)]
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 or unicodedata.category(c) == "Cn" for c in t)]
    frame = spark.createDataFrame([(x, unicodedata.normalize("NFKC", x)) for x in texts], "x string, f string")
    begin = time.monotonic()
    assert frame.select("f", F.expr(U.nfkc("x")).alias("g")).where("f <> g").collect() == []
    assert time.monotonic() - begin < 60


def test_sections_are_made_once_for_all_places_that_read_them(spark):
    """The optimizer may put the expression of a page's sections wherever prepare reads them; it did so 23 times."""
    query = catalog.queries()["prepare_sections_chaptered"](spark, "/root/testdata/sf0.001")
    assert query._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 3
    rows = spark.createDataFrame([(0, []), (1, [("page_number", "3."), ("title", "On"), ("header", "x")])], f"i int, sections {sections.SECTIONS}")
    got = rows.select("i", F.explode_outer(F.expr(sections.prepare("sections"))).alias("s")).orderBy("i").select("i", "s.*").collect()
    assert [tuple(r) for r in got] == [(0, None, None), (1, "section_title", "3. On")]


def test_small_books_share_a_partition(spark, tmp_path):
    """One task for each small book made 2,060 tasks of 51,282 files."""
    pages = [(f"s/b{b}", p, [("body", f"{b} {p}")]) for b in range(40) for p in range(1, 6)] + [("long", p, []) for p in range(1, 30)]
    rows = page_files.page_file_rows(spark.createDataFrame(pages, f"book string, page_num int, sections {sections.SECTIONS}"))
    page_files.write_whole_files(rows, str(tmp_path))
    for run in (1, 10, 256):
        reader = page_files.PageReader({"path": str(tmp_path), "run": str(run)})
        parts = reader.partitions()
        assert len(parts) <= 2 * len(pages) / run + 1
        read = [(book, number) for part in parts for book, number, _, _ in reader.read(part)]
        assert len(read) == len(pages) and set(read) == {(b, p) for b, p, _ in pages}
        assert all(sum(1 for _ in reader.read(part)) <= run for part in parts)
    twice = spark.createDataFrame([(f"x/{i % 3}.txt", "same") for i in range(30)], "file string, value string").repartition(5)
    page_files.write_whole_files(twice, f"{tmp_path}/twice")
    assert sorted(f.name for f in (tmp_path / "twice").rglob("*") if f.is_file()) == ["0.txt", "1.txt", "2.txt"]


def pdf_of(count: int) -> bytes:
    """A sound file of many pages, all with a content of their own and one font."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count %d/Kids[" % count + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(count)) + b"]/Resources 3 0 R>>", 3: b"<</Font<</F(a)>>>>"}
    for i in range(count):
        objects |= {4 + 2 * i: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 9 %d]/Contents %d 0 R>>" % (i + 1, 5 + 2 * i), 5 + 2 * i: stream("", b"page %d" % i)}
    return table_of(objects)


def test_a_file_is_parsed_once_for_all_its_pages(spark, monkeypatch):
    """Every run of 64 pages parsed the file's table anew and all pages before it, and the count did so once more."""
    whole, opened, found = pdf_of(400), [], []
    slices = [pdf_read.page_slice(whole, i) for i in (0, 63, 64, 399)]
    files = spark.createDataFrame([("a", bytearray(whole), [1, None], None), ("none", None, None, 1.5), ("cut", bytearray(FILES["cut"][0]), [], 2.5)], "name string, pdf binary, list array<int>, x double")
    rows = {(r["name"], r["page_index"]): r for r in pdf_read.sliced(files).collect()}
    assert len(rows) == 401 and [bytes(rows["a", i]["pdf"]) for i in (0, 63, 64, 399)] == slices
    assert rows["a", 399]["list"] == [1, None] and rows["a", 399]["x"] is None and rows["cut", 0]["x"] == 2.5 and rows["cut", 0]["list"] == []
    begin, get = pdf_read.Pdf.__init__, pdf_read.Pdf.object_at
    monkeypatch.setattr(pdf_read.Pdf, "__init__", lambda self, data: (opened.append(self), begin(self, data))[1])
    monkeypatch.setattr(pdf_read.Pdf, "object_at", lambda self, at: (found.append(at), get(self, at))[1])
    runs = []
    for low, made in pdf_read.page_runs(whole):
        runs.append((low, len(made)))
        assert len(opened[0].seen) <= 402 + 2 * pdf_read.RUN  # no file lies in memory twice
    assert runs == [(low, min(64, 400 - low)) for low in range(0, 400, 64)] and len(opened) == 1 and len(found) <= 402 + 400 + len(runs)


def test_a_page_is_opened_once_for_its_image(monkeypatch):
    """Each number that might be the image's opened the page anew."""
    opened, begin = [], pdf_read.Pdf.__init__
    page = table_of({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]>>", 3: b"<</Type/Page/Resources<</XObject<</I 5 0 R>>>>>>", 4: stream("", b"/I Do"), 5: stream("/Subtype/Image", b"dots")})
    monkeypatch.setattr(pdf_read.Pdf, "__init__", lambda self, data: (opened.append(self), begin(self, data))[1])
    assert pdf_read.first_image(page).body == b"dots" and len(opened) == 1
    assert pdf_read.first_image(FILES["plain"][0]) is None
