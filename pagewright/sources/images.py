"""Page images on workers: PNG pixels, validity, digests and differences, and plain image PDFs. numpy and zlib only."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        size, = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4: at + 8], data[at + 8: at + 8 + size]
        if len(body) != size or data[at + 8 + size: at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("broken PNG chunk")
        yield kind, body
        at += 12 + size


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, 3) pixels of an 8-bit PNG that is not interlaced; ValueError for anything else."""
    head, palette, packed, ended = None, None, [], False
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
    if head is None or not ended or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("unsupported PNG")
    width, height, channels = head[0], head[1], CHANNELS[head[3]]
    stride = width * channels
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if raw.size != height * (stride + 1):
        raise ValueError("PNG of the wrong size")
    rows, before = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y, line in enumerate(raw.reshape(height, stride + 1)):
        before = rows[y] = _unfilter(int(line[0]), line[1:], before, channels)
    pixels = rows.reshape(height, width, channels)
    if head[3] == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise ValueError("unknown PNG filter")
    out, up = bytearray(line.tobytes()), above.tolist()
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) >> 1
        else:
            base = left + up[i] - corner
            guess = min((abs(base - left), 0, left), (abs(base - up[i]), 1, up[i]), (abs(base - corner), 2, corner))[2]
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def png_bytes(pixels: np.ndarray) -> bytes:
    """An RGB PNG of (height, width, 3) pixels."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width, _ = pixels.shape
    lines = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)), axis=1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def mean_difference(a: np.ndarray, b: np.ndarray) -> float:
    """Mean absolute difference of the channels; images of different sizes differ fully."""
    return float(np.abs(a.astype(int) - b.astype(int)).mean()) if a.shape == b.shape else 255.0


def mostly_black(pixels: np.ndarray, limit: float = 14.0) -> bool:
    """Mean of the image at a sixteenth of its scale under the limit."""
    return float(pixels[::16, ::16].mean()) < limit


@F.pandas_udf(BooleanType())
def png_valid(data: pd.Series) -> pd.Series:
    def whole(x) -> bool:
        try:
            return x is not None and any(kind == b"IEND" for kind, _ in _chunks(x))
        except (ValueError, struct.error):
            return False

    return data.map(whole)


def capture_facts(captures: DataFrame) -> DataFrame:
    """(book, page_num, digest, black, width, height) of (book, page_num, image): SHA-1 of the pixels; null for broken images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            facts = []
            for image in batch["image"]:
                try:
                    pixels = png_pixels(image or b"")
                    facts.append((hashlib.sha1(pixels.tobytes()).hexdigest(), mostly_black(pixels), pixels.shape[1], pixels.shape[0]))
                except (ValueError, zlib.error, struct.error):
                    facts.append((None, None, None, None))
            made = pd.DataFrame(facts, columns=["digest", "black", "width", "height"]).astype({"width": "Int32", "height": "Int32"})
            yield pd.concat([batch[["book", "page_num"]].reset_index(drop=True), made], axis=1)

    return captures.select("book", "page_num", "image").mapInPandas(run, "book string, page_num int, digest string, black boolean, width int, height int")


def trimmed(pixels: np.ndarray, left: int, top: int, right: int, bottom: int, band_end: int, band_start: int) -> np.ndarray:
    """The crop box of the pixels, with the bands at its top and bottom painted white."""
    out = pixels.copy()
    out[top:band_end, left:right] = 255
    out[band_start:bottom, left:right] = 255
    return out[top:bottom, left:right]


PDF_PAGE = "book string, page_num int, image binary, across int, down int, width_pt double, height_pt double"


def pdf_images(pages: DataFrame) -> DataFrame:
    """(book, page_num, image, across, down, width_pt, height_pt) of pages with ``image`` and the columns of ``settings.trim_geometry``, for pdf_write.pdf_pieces."""
    box = ["crop_left", "crop_top", "crop_right", "crop_bottom", "top_band_end", "bottom_band_start"]

    def cropped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [trimmed(png_pixels(r.image), *(getattr(r, c) for c in box)) for r in batch.itertuples()]
            yield batch[["book", "page_num", "width_pt", "height_pt"]].assign(
                image=[zlib.compress(np.ascontiguousarray(x).tobytes()) for x in made], across=[x.shape[1] for x in made], down=[x.shape[0] for x in made])

    return pages.select("book", "page_num", "image", *box, "width_pt", "height_pt").mapInPandas(cropped, PDF_PAGE)
