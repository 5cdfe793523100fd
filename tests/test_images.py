"""PNG and PDF round trips, validity, and captures as digests."""

import zlib

import numpy as np
import pytest

from pagewright.operators.planning import truncate_repeats
from pagewright.operators.settings import trim_geometry
from pagewright.sources import images as I
from pagewright.sources.adapters import pdf_page_count
from pagewright.sources.pdf_write import pdf_pieces


def shot(seed, height=40, width=33):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), dtype=np.uint8)


def filtered(pixels, kind):
    """A PNG whose lines all use one filter, written the slow way."""
    import struct

    height, width, step = pixels.shape
    flat, lines = pixels.reshape(height, -1).astype(int), []
    for y in range(height):
        line = []
        for i in range(width * step):
            left = flat[y, i - step] if i >= step else 0
            up = flat[y - 1, i] if y else 0
            corner = flat[y - 1, i - step] if y and i >= step else 0
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            line.append((flat[y, i] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        lines.append(bytes([kind, *line]))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return I.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    assert (I.png_pixels(filtered(shot(kind), kind)) == shot(kind)).all()


def test_png_round_trip_and_broken_files():
    data = I.png_bytes(shot(1))
    assert (I.png_pixels(data) == shot(1)).all()
    for broken in (b"", data[:-1], data[:50] + b"x" + data[51:], b"\x89PNG"):
        with pytest.raises(ValueError):
            I.png_pixels(broken)


def test_captures(spark):
    shots = [1, 2, 2, 2, 3]
    rows = [("b", i + 1, bytearray(I.png_bytes(shot(s)))) for i, s in enumerate(shots)] + [("c", 1, bytearray(b"no")), ("c", 2, None)]
    frame = spark.createDataFrame(rows, "book string, page_num int, image binary")
    facts = I.capture_facts(frame)
    assert truncate_repeats(facts).collect() == [("b", 2)]
    assert [r["ok"] for r in frame.select("book", "page_num", I.png_valid("image").alias("ok")).orderBy("book", "page_num").collect()] == [True] * 5 + [False] * 2
    assert facts.where("book = 'c' AND digest IS NULL AND width IS NULL").count() == 2


def test_black_and_differences():
    assert I.mostly_black(np.zeros((64, 64, 3), np.uint8)) and not I.mostly_black(shot(0))
    assert I.mean_difference(shot(0), shot(0)) == 0 and I.mean_difference(shot(0), shot(0, 2, 2)) == 255


def test_book_pdf(spark):
    rows = [("b", i, bytearray(I.png_bytes(shot(i))), 33, 40, 144.0, 0.1, 0.0, 0.25, 0.0, 0.1, 0.0) for i in (2, 1)]
    frame = spark.createDataFrame(rows, "book string, page_num int, image binary, width int, height int, dpi double, trim_left double, trim_right double, trim_top double, "
                                        "trim_bottom double, trim_fill_top double, trim_fill_bottom double")
    pieces = pdf_pieces(I.pdf_images(trim_geometry(frame))).orderBy("part", "place").collect()
    pdf = b"".join(bytes(r["piece"]) for r in pieces)
    assert pdf_page_count(pdf) == 2 and pdf.count(b"/MediaBox[0 0 15.0000 15.0000]") == 2
    first = zlib.decompress(pdf.split(b"/FlateDecode/Length ")[1].split(b"stream\n", 1)[1].split(b"\nendstream")[0])
    pixels = np.frombuffer(first, np.uint8).reshape(30, 30, 3)
    assert (pixels[:4] == 255).all() and (pixels[4:] == shot(1)[14:, 3:]).all()
