"""Matroska media columns: write and read EBML containers, and packet tables.

``mux`` stores 8-bit PCM samples as a Matroska file: EBML header, Info, Tracks,
clusters of SimpleBlocks (fixed, EBML or Xiph lacing, or none) and Cues.
``packets`` parses any Matroska bytes (variable-length element ids and sizes,
unknown sizes, SimpleBlock and BlockGroup, the four lacings) into packets with
track, timestamp, and byte range.  ``packet_table`` does so for a binary column.

Defined cases: null text is the empty text, stored as 64 zero bytes; equal texts
give equal bytes (no clock or random field is written); null media give no
packets; truncated or broken media give the packets before the break, floats of odd sizes are ignored; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.shared import bound_batches, table

# Element ids of the public Matroska specification.
EBML, EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, ENTRY, NUMBER, UID, KIND, LACES, CODEC, LASTS = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

SAMPLE_RATE = 8000
FRAME = 1024  # samples of a packet: 128 ms
LACED = 8  # packets of a block
BLOCKS = 4  # blocks of a cluster: 4,096 ms, well inside the 16-bit relative timestamps


def size_vint(n: int, width: int = 0) -> bytes:
    """An EBML size; all ones in a width is reserved for an unknown size."""
    if not width:
        width = 1
        while n >= (1 << 7 * width) - 1:
            width += 1
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def unsigned(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(frames: list[bytes], relative_ms: int, index: int) -> bytes:
    """A SimpleBlock; unequal sizes are laced by EBML in even blocks and by Xiph in odd ones."""
    lacing, head = 0, b""
    sizes = [len(f) for f in frames]
    if len(frames) > 1:
        if len(set(sizes)) == 1:
            lacing = 2
        elif index % 2 == 0:
            lacing, head = 3, size_vint(sizes[0])
            for before, now in zip(sizes, sizes[1:-1]):
                difference, width = now - before, 1
                while abs(difference) > (1 << 7 * width - 1) - 2:
                    width += 1
                head += size_vint(difference + (1 << 7 * width - 1) - 1, width)
        else:
            lacing, head = 1, b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        head = bytes([len(frames) - 1]) + head
    return element(SIMPLE, b"\x81" + struct.pack(">hB", relative_ms, 0x80 | lacing << 1) + head + b"".join(frames))


_HEADER = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ, 1) + unsigned(MAX_ID, 4) + unsigned(MAX_SIZE, 8)
                  + element(DOC_TYPE, b"matroska") + unsigned(DOC_VERSION, 4) + unsigned(DOC_READ, 2))
_TRACKS = element(TRACKS, element(ENTRY, unsigned(NUMBER, 1) + unsigned(UID, 1) + unsigned(KIND, 2) + unsigned(LACES, 1)
                  + unsigned(LASTS, FRAME * 1_000_000_000 // SAMPLE_RATE) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE))
                  + unsigned(CHANNELS, 1) + unsigned(DEPTH, 8))))


def mux(samples: bytes) -> bytes:
    """Samples as one mono 8-bit PCM track."""
    info = element(INFO, unsigned(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(samples) * 1000 / SAMPLE_RATE))
                   + element(MUXER, b"pagewright") + element(WRITER, b"pagewright"))
    body = [info, _TRACKS]
    at, cues = len(info) + len(_TRACKS), []
    step = FRAME * LACED
    for number, begin in enumerate(range(0, len(samples), step * BLOCKS)):
        start_ms = begin * 1000 // SAMPLE_RATE
        blocks = [unsigned(TIMESTAMP, start_ms)]
        for k in range(BLOCKS):
            piece = samples[begin + k * step: begin + (k + 1) * step]
            if piece:
                frames = [piece[i: i + FRAME] for i in range(0, len(piece), FRAME)]
                blocks.append(_block(frames, (k * step) * 1000 // SAMPLE_RATE, number * BLOCKS + k))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(POINT, unsigned(CUE_TIME, start_ms) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(body))


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, next offset); -1 for an unknown size; IndexError at the end of the data."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise IndexError(at)
    value = int.from_bytes(data[at: at + width], "big")
    if not keep:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, at + width


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not lacing:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        each = (end - at) // count
        return [(at + i * each, each) for i in range(count)]
    sizes = []
    if lacing == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif count > 1:
        n, at = _vint(data, at)
        sizes.append(n)
        for _ in range(count - 2):
            value, after = _vint(data, at)
            if value < 0:
                value = (1 << 7 * (after - at)) - 1
            n += value - ((1 << 7 * (after - at) - 1) - 1)
            sizes.append(n)
            at = after
    sizes.append(end - at - sum(sizes))
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


#: Formats of floats by their size; other sizes are none. Nanoseconds beyond these are no timestamps.
_FLOATS = {0: "", 4: ">f", 8: ">d"}
_FAR = 1 << 62
_MASTERS = {SEGMENT, CLUSTER, GROUP, TRACKS, ENTRY, INFO, CUES, POINT, CUE_TRACK_POSITIONS, AUDIO}


def packets(data: bytes | None) -> tuple[list[tuple], dict]:
    """Packets (cluster, track, timestamp ms, byte start, size, keyframe, lacing) and container facts."""
    found: list[tuple] = []
    facts = {"clusters": 0, "cues": [], "rate": 0.0, "depth": 0, "codec": "", "segment": 0, "cluster_at": []}
    lasts: dict[int, int] = {}
    number = 0
    data = data or b""
    at, base, end_all, scale = 0, 0, len(data), 1_000_000
    while at < end_all:
        begin = at
        try:
            ident, at = _vint(data, at, keep=True)
            size, at = _vint(data, at)
        except IndexError:
            break
        if ident in _MASTERS:
            if ident == SEGMENT:
                facts["segment"] = at
            elif ident == CLUSTER:
                facts["clusters"] += 1
                facts["cluster_at"].append(begin - facts["segment"])
            continue
        if size < 0 or at + size > end_all:
            break
        if ident in (SIMPLE, BLOCK):
            try:
                track, p = _vint(data, at)
                relative, flags = struct.unpack_from(">hB", data, p)
                lacing = flags >> 1 & 3
                frames = _frames(data, p + 3, at + size, lacing)
            except (IndexError, struct.error):
                break
            time = base + relative
            if min(n for _, n in frames) < 0 or time * scale + len(frames) * lasts.get(track, 0) >= _FAR:
                break
            for i, (offset, n) in enumerate(frames):
                found.append((facts["clusters"] - 1, track, (time * scale + i * lasts.get(track, 0)) // 1_000_000, offset, n, bool(flags & 0x80), lacing))
        elif ident == TIMESTAMP:
            base = int.from_bytes(data[at: at + size], "big")
        elif ident == SCALE:
            scale = int.from_bytes(data[at: at + size], "big")
        elif ident == NUMBER:
            number = int.from_bytes(data[at: at + size], "big")
        elif ident == LASTS:
            lasts[number] = int.from_bytes(data[at: at + size], "big")
        elif ident == CUE_CLUSTER:
            facts["cues"].append(int.from_bytes(data[at: at + size], "big"))
        elif ident == RATE:
            if size in _FLOATS:
                facts["rate"] = struct.unpack(_FLOATS[size], data[at: at + size])[0] if size else 0.0
        elif ident == DEPTH:
            facts["depth"] = int.from_bytes(data[at: at + size], "big")
        elif ident == CODEC:
            facts["codec"] = data[at: at + size].decode("ascii", "replace")
        at += size
    return found, facts


PACKETS = "cluster int, track int, timestamp_ms long, byte_start long, byte_size long, keyframe boolean, lacing int"


def packet_table(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per packet of the binary column ``media``, with the row's ``key``."""
    bound_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", *(c.split()[0] for c in PACKETS.split(", "))]
        for batch in batches:
            for k, data in zip(batch["key"], batch["media"]):
                if rows := packets(data)[0]:
                    yield pd.DataFrame([(k, *r) for r in rows], columns=names)

    # Keys cross as text, so large integers beside nulls stay exact.
    rows = df.selectExpr(f"cast(`{key}` AS string) AS key", f"`{media}` AS media").mapInPandas(parse, f"key string, {PACKETS}")
    return rows.withColumn("key", rows["key"].cast(kind)).withColumnRenamed("key", key)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8")
    return raw + bytes(64 if not raw else -len(raw) % 64), len(raw)


def stored_features(text: str | None) -> tuple:
    payload, n_bytes = payload_of(text)
    media = mux(payload)
    found, facts = packets(media)
    back = b"".join([media[p[3]: p[3] + p[4]] for p in found])
    samples = np.frombuffer(back, np.uint8)
    counts = np.bincount(samples, minlength=256)
    levels = np.arange(256)
    mean = float(counts @ levels) / samples.size
    power = float(counts @ (levels - 128) ** 2) / samples.size
    whole = all(a == b for a, b in zip(facts["cues"], facts["cluster_at"])) and len(facts["cues"]) == facts["clusters"]
    feature = (f"packets={len(found)};clusters={facts['clusters']};cues={len(facts['cues'])}{'' if whole else '?'};"
               f"last_ms={found[-1][2]};ms={samples.size * 1000 // SAMPLE_RATE};rate={facts['rate']:.0f};bits={facts['depth']};"
               f"codec={facts['codec']};mean={mean:.6f};rms={power ** 0.5:.6f};levels={int((counts > 0).sum())}")
    return n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_and_read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in STORED.split(", ")]
    kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in STORED.split(", ")]
    for batch in batches:
        columns = zip(*map(stored_features, batch.column(1).to_pylist())) if batch.num_rows else ([] for _ in names)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", *names])


def op8_media_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.mapInArrow(store_and_read, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {STORED}")
