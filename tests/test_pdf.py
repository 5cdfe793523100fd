"""PDFs: pieces that make whole files, and counts and slices of files of every kind, sound or broken."""

import zlib

import pytest
from pyspark.sql import functions as F

from pagewright.sources import pdf_read, pdf_write
from pagewright.sources.adapters import pdf_page_count, pdf_page_slice


def table_of(objects: dict[int, bytes], start: bytes = b"%PDF-1.5\n", trailer: str = "", base: int = 0) -> bytes:
    """Objects with a cross-reference table over them; ``base`` is where the bytes will stand."""
    out, offsets = bytearray(start), {}
    for n, body in objects.items():
        offsets[n] = base + len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    at = base + len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in offsets.items())
    return bytes(out) + f"trailer<</Root 1 0 R/Size 99{trailer}>>\nstartxref\n{at}\n%%EOF\n".encode()


def stream(head: str, body: bytes) -> bytes:
    return f"<<{head}/Length {len(body)}>>stream\n".encode() + body + b"\nendstream"


PLAIN = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Count 3/Kids[3 0 R 4 0 R]/MediaBox[0 0 7 8]/Resources 9 0 R>>", 3: b"<</Type/Page/Parent 2 0 R/Contents 6 0 R>>",
         4: b"<</Type/Pages/Parent 2 0 R/Count 2/Kids[5 0 R 7 0 R]/Rotate 90>>", 5: b"<</Type/Page/Parent 4 0 R/Title(a \\) b (c))/MediaBox[0 0 1.5 2]>>",
         6: stream("", b"BT (one) Tj ET"), 7: b"<</Type /Page /Parent 4 0 R % note\n/Contents [6 0 R]>>", 8: b"<</Type/Page/Parent 2 0 R>>", 9: b"<</Font<</F 10 0 R>>>>", 10: b"<</Type/Font/Loop 9 0 R>>"}


def packed(predictor: bool) -> bytes:
    """The same pages in an object stream, with a cross-reference stream."""
    inner = {n: b for n, b in PLAIN.items() if n not in (6, 8)}
    bodies, directory = bytearray(), []
    for n, b in inner.items():
        directory += [n, len(bodies)]
        bodies += b + b" "
    head = " ".join(map(str, directory)).encode() + b" "
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for n, body in ((6, PLAIN[6]), (11, stream(f"/Type/ObjStm/N {len(inner)}/First {len(head)}/Filter/FlateDecode", zlib.compress(head + bytes(bodies))))):
        places[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    at = len(out)
    rows = []
    for n in range(13):
        if n in places or n == 12:
            rows.append(bytes([1]) + places.get(n, at).to_bytes(2, "big") + b"\0")
        elif n in inner:
            rows.append(bytes([2]) + (11).to_bytes(2, "big") + bytes([list(inner).index(n)]))
        else:
            rows.append(bytes(4))
    data, parms = b"".join(rows), ""
    if predictor:
        above, lines = bytes(4), []
        for r in rows:
            lines.append(b"\2" + bytes((x - y) & 255 for x, y in zip(r, above)))
            above = r
        data, parms = b"".join(lines), "/DecodeParms<</Predictor 12/Columns 4>>"
    body = stream(f"/Type/XRef/Size 13/W[1 2 1]/Root 1 0 R/Filter/FlateDecode{parms}", zlib.compress(data))
    return bytes(out) + b"12 0 obj\n" + body + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at


def updated() -> bytes:
    """An incremental update takes page 5 out and changes page 3; the old objects stay in the file."""
    old = table_of(PLAIN)
    prev = int(old.rsplit(b"startxref\n", 1)[1].split()[0])
    return old + table_of({4: b"<</Type/Pages/Parent 2 0 R/Count 1/Kids[7 0 R]>>", 3: b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 50 60]>>"}, b"", f"/Prev {prev}", len(old))


FILES = {
    "plain": (table_of(PLAIN), 3), "packed": (packed(False), 3), "predicted": (packed(True), 3), "updated": (updated(), 2),
    "no startxref": (table_of(PLAIN).split(b"startxref")[0], 3), "bad offsets": (table_of(PLAIN).replace(b"%PDF-1.5\n", b"%PDF-1.5\n%junk in front\n"), 3),
    "packed, no startxref": (packed(False).split(b"startxref")[0], 3), "cut": (table_of(PLAIN)[:300], 1), "empty": (b"", None), "null": (None, None), "text": (b"no pdf", None),
    "circle": (table_of({1: PLAIN[1], 2: b"<</Type/Pages/Kids[3 0 R 2 0 R]>>", 3: b"<</Type/Pages/Kids[2 0 R 4 0 R]>>", 4: b"<</Type/Page>>"}), 1),
    "encrypted": (table_of(PLAIN, trailer="/Encrypt<</V 1>>"), None), "no page": (table_of({1: PLAIN[1], 2: b"<</Type/Pages/Count 0/Kids[]>>"}), None), "nested": (b"[" * 5000 + table_of(PLAIN), 3),
}


@pytest.mark.parametrize("name", FILES)
def test_counts_and_slices(name):
    data, count = FILES[name]
    assert pdf_read.page_count(data) == count
    slices = [pdf_read.page_slice(data, i) for i in range(-1, (count or 0) + 1)]
    assert slices[0] is None and slices[-1] is None and all(pdf_read.page_count(x) == 1 for x in slices[1:-1])


def test_slices_keep_what_pages_inherit():
    for name in ("plain", "packed", "predicted"):
        first, second, third = (next(pdf_read.Pdf(pdf_read.page_slice(FILES[name][0], i)).pages()) for i in range(3))
        assert first["MediaBox"] == [0, 0, 7, 8] and second["MediaBox"] == [0, 0, 1.5, 2] and second["Rotate"] == 90 and "Rotate" not in first and second["Title"] == b"(a \\) b (c))"
        pdf = pdf_read.Pdf(pdf_read.page_slice(FILES[name][0], 2))
        assert pdf.resolved(next(pdf.pages())["Contents"][0]).body == b"BT (one) Tj ET"
    changed = pdf_read.page_slice(FILES["updated"][0], 0)
    assert next(pdf_read.Pdf(changed).pages())["MediaBox"] == [0, 0, 50, 60]


def test_errors_of_single_files():
    assert pdf_page_count(FILES["plain"][0]) == 3 and pdf_read.page_count(pdf_page_slice(FILES["plain"][0], 2)) == 1
    with pytest.raises(ValueError):
        pdf_page_count(b"%PDF-1.4")
    with pytest.raises(IndexError):
        pdf_page_slice(FILES["plain"][0], 3)


def test_cut_and_changed_files_never_fail():
    import random

    rnd = random.Random(3)
    for whole in (FILES["plain"][0], FILES["predicted"][0], FILES["updated"][0]):
        for _ in range(300):
            data = bytearray(whole[:rnd.randrange(len(whole))] if rnd.random() < 0.3 else whole)
            for _ in range(rnd.randrange(4)):
                if data:
                    data[rnd.randrange(len(data))] = rnd.randrange(256)
            count = pdf_read.page_count(bytes(data))
            assert (pdf_read.page_slice(bytes(data), 0) is None) == (count is None)


def test_files_as_a_column(spark):
    rows = [(name, None if data is None else bytearray(data)) for name, (data, _) in FILES.items()]
    files = spark.createDataFrame(rows, "name string, pdf binary")
    assert {r["name"]: r["n"] for r in files.select("name", pdf_read.pdf_pages("pdf").alias("n")).collect()} == {n: c for n, (_, c) in FILES.items()}
    got = pdf_read.sliced(files).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in got} == {n: c for n, (_, c) in FILES.items() if c}


@pytest.mark.parametrize("count", [1, 128, 129, 300])
def test_pieces_make_a_sound_file(spark, tmp_path, monkeypatch, count):
    pages = spark.range(count).repartition(3).select(
        F.lit("shelf/a").alias("book"), (F.lit(count) - F.col("id")).cast("int").alias("page_num"), F.lit(bytearray(zlib.compress(bytes(12)))).alias("image"),
        F.lit(2).alias("across"), F.lit(2).alias("down"), (F.col("id") + 1.0).alias("width_pt"), F.lit(5.0).alias("height_pt"))
    pages = pages.unionByName(pages.where("id = 0") if "id" in pages.columns else pages.limit(1).withColumn("book", F.lit("b")))
    pdf_write.write_pieces(pdf_write.pdf_pieces(pages), str(tmp_path))
    data = (tmp_path / "shelf" / "a.pdf").read_bytes()
    monkeypatch.setattr(pdf_read.Pdf, "rebuild", lambda self: (_ for _ in ()).throw(AssertionError("cross-references are wrong")))
    pdf = pdf_read.Pdf(data)
    assert [p["MediaBox"][2] for p in pdf.pages()] == [float(count - i) for i in range(count)]
    assert all(f"{n} 0 obj".encode() == data[at:at + len(f"{n} 0 obj")] for n, at in pdf.places.items() if at)
    assert pdf_read.page_count((tmp_path / "b.pdf").read_bytes()) == 1 and not list(tmp_path.rglob("*.part"))


def test_no_task_holds_a_book(spark):
    pages = spark.range(10).select(F.lit("a").alias("book"), F.col("id").cast("int").alias("page_num"), F.lit(bytearray(b"x")).alias("image"), F.lit(1).alias("across"), F.lit(1).alias("down"),
                                   F.lit(1.0).alias("width_pt"), F.lit(1.0).alias("height_pt"))
    plan = pdf_write.pdf_pieces(pages)._jdf.queryExecution().executedPlan().toString()
    plain = [x for x in plan.split("\n") if "image#" in x or "collect_list" in x]
    assert "FlatMapGroupsInPandas" not in plan and not [x for x in plain if "Window" in x or "collect_list(piece" in x or "collect_list(image" in x]
