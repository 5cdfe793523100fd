"""Page counts and single pages of PDF files, as column operators and without a PDF library.

A file's newest cross-reference section says where each object lies; older ones fill in
what it lacks (incremental updates), entries may be tables or streams, and objects may
be packed in object streams.  Pages are found by descending the page tree, so stale
objects never count.  A page's slice copies the objects that the page reaches, renumbered,
with what it inherits from the tree.

Defined cases: null, empty and broken files, and files without a page, have a null count
and no slice, as have encrypted ones; where the cross-references are broken, the last
object of each number found in the file counts; an index out of range has no slice.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
#: A token behind white space and comments; none, where no token may stand.
_TOKEN = re.compile(rb"(?>(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*)(/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R(?![A-Za-z])|[+-]?(?:\d+\.?\d*|\.\d+)"
                    rb"|<<|>>|\[|\]|\(|<[^>]*>|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)?")
_REF = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R")
_NUMBER = re.compile(rb"[+-]?(?:\d|\.\d)")
_OBJECT = re.compile(rb"(?<!\d)(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj\b")
_STREAM, _STREAM_END = re.compile(rb"\s*stream(\r\n|\n|\r)"), re.compile(rb"\s*endstream")
_START = re.compile(rb"startxref[\s\x00]+(\d+)")
_SECTION, _ENTRY, _TRAILER = re.compile(rb"\s*(\d+)\s+(\d+)\s*?[\r\n]\s*"), re.compile(rb"\s*(\d{10}) (\d{5}) ([nf])"), re.compile(rb"\s*trailer")
#: Trees and chains of a sound file are far flatter.
MOST_NESTED, MOST_SECTIONS = 100, 10_000


class Name(str):
    """A PDF name without its slash."""


class Ref(NamedTuple):
    number: int
    generation: int


class Raw(bytes):
    """A string or other token, kept as it was written."""


class Stream(NamedTuple):
    head: dict
    body: bytes


class BrokenPdf(ValueError):
    pass


#: What reading a damaged file may raise.
DAMAGE = (BrokenPdf, LookupError, TypeError, ValueError, AttributeError, ArithmeticError, zlib.error)


@functools.lru_cache(4096)
def word_of(token: bytes):
    """The object of a token that is one by itself."""
    if token[0] == 0x2F:  # /
        return Name(token[1:].decode("latin-1"))
    if ref := _REF.match(token):
        return Ref(int(ref[1]), int(ref[2]))
    if _NUMBER.match(token):
        return (float if b"." in token else int)(token)
    return {b"true": True, b"false": False, b"null": None}.get(token, Raw(token))


def parse(data: bytes, at: int):
    """(object, next place) at a place of the data; one match a token, and no call a nested object."""
    outer, holder, key = [], None, None  # what is open around the holder; the holder's key that waits for its value
    while True:
        for found in _TOKEN.finditer(data, at):  # the pattern matches everywhere, so no sign is passed over
            token = found[1]
            if token == b"<<" or token == b"[":
                outer.append((holder, key))
                holder, key = {} if token == b"<<" else [], None
                if len(outer) > MOST_NESTED and _TOKEN.match(data, found.end())[1] not in (b">>", b"]"):
                    raise BrokenPdf("too many levels")
                continue
            if token == b">>" or token == b"]":
                if type(holder) is not (dict if token == b">>" else list) or key is not None:
                    raise BrokenPdf("an end without a beginning")
                item = holder
                holder, key = outer.pop()
            elif token == b"(":
                at = text_end(data, found.start(1))
                item = Raw(data[found.start(1):at])
            elif token is None:
                raise BrokenPdf(f"nothing or an unknown sign at {found.end()}")
            else:
                item = word_of(token) if len(token) < 64 else word_of.__wrapped__(token)
            if holder is None:
                return item, at if token == b"(" else found.end()
            if type(holder) is list:
                holder.append(item)
            elif key is None:
                key = item if isinstance(item, Name) else Name()
            else:
                holder[key] = item
                key = None
            if token == b"(":
                break  # its end is no token's


def text_end(data: bytes, at: int) -> int:
    """The place behind the string in brackets that begins at a place."""
    level = 0
    while at < len(data):
        c = data[at]
        level += (c == 0x28) - (c == 0x29)
        at += 2 if c == 0x5C else 1
        if not level:
            return at
    raise BrokenPdf("a string without an end")


def unpredicted(rows: bytes, head: dict) -> bytes:
    """The bytes that PNG predictors were applied to."""
    if (head.get("Predictor") or 1) < 10:
        return rows
    size = max((head.get("Colors") or 1) * (head.get("BitsPerComponent") or 8) // 8, 1)
    width = ((head.get("Columns") or 1) * (head.get("Colors") or 1) * (head.get("BitsPerComponent") or 8) + 7) // 8
    if not 0 < width <= len(rows):
        raise BrokenPdf("rows longer than the data")
    out, above = bytearray(), bytes(width)
    for at in range(0, len(rows) - width, width + 1):
        line = bytearray(rows[at + 1:at + 1 + width])
        for i in range(width):
            left, up, corner = line[i - size] if i >= size else 0, above[i], above[i - size] if i >= size else 0
            paeth = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            line[i] = (line[i] + (0, left, up, (left + up) // 2, paeth)[min(rows[at], 4)]) & 255
        out += line
        above = bytes(line)
    return bytes(out)


class Pdf:
    """The objects of a file by number."""

    def __init__(self, data: bytes) -> None:
        self.data, self.places, self.packed, self.trailer, self.seen = data, {}, {}, {}, {}
        try:
            self.sections()
            self.root = self.resolved(self.trailer["Root"])["Pages"]
        except DAMAGE:
            self.rebuild()
        if "Encrypt" in self.trailer:
            raise BrokenPdf("encrypted")

    def sections(self) -> None:
        """Cross-reference sections from the newest to the oldest; the newest entry of a number counts."""
        marks = list(_START.finditer(self.data))
        if not marks:
            raise BrokenPdf("no startxref")
        waiting, done = [int(marks[-1][1])], set()
        while waiting and len(done) < MOST_SECTIONS:
            at = waiting.pop(0)
            if at in done:
                continue
            done.add(at)
            begin = _SKIP.match(self.data, at).end()
            trailer = self.table(begin) if self.data.startswith(b"xref", begin) else self.stream_table(at)
            if not isinstance(trailer, dict):
                raise BrokenPdf("no trailer")
            for key, value in trailer.items():
                self.trailer.setdefault(key, value)
            waiting = [x for x in (trailer.get("XRefStm"), trailer.get("Prev")) if isinstance(x, int)] + waiting

    def table(self, at: int) -> dict:
        at += 4
        while head := _SECTION.match(self.data, at):
            first, at = int(head[1]), head.end()
            for number in range(first, first + int(head[2])):
                entry = _ENTRY.match(self.data, at)
                if not entry:
                    raise BrokenPdf("a broken table")
                at = entry.end()
                self.places.setdefault(number, int(entry[1]) if entry[3] == b"n" else None)
        trailer = _TRAILER.match(self.data, at)
        if not trailer:
            raise BrokenPdf("no trailer")
        return parse(self.data, trailer.end())[0]

    def stream_table(self, at: int) -> dict:
        found = self.object_at(at)
        if not isinstance(found, Stream):
            raise BrokenPdf("no cross-references")
        head, rows = found.head, self.content(found)
        widths = head["W"]
        index = head.get("Index") or [0, head["Size"]]
        step = sum(widths)
        numbers = itertools.chain.from_iterable(range(a, a + c) for a, c in zip(index[::2], index[1::2]))
        for k, number in enumerate(itertools.islice(numbers, len(rows) // step)):
            fields, p = [], k * step
            for w in widths:
                fields.append(int.from_bytes(rows[p:p + w], "big") if w else None)
                p += w
            kind = 1 if fields[0] is None else fields[0]
            self.places.setdefault(number, fields[1] if kind == 1 else (fields[1], fields[2] or 0) if kind == 2 else None)
        return head

    def rebuild(self) -> None:
        """Objects as they are found in the file, the last of each number; packed ones, too."""
        self.places, self.seen = {int(m[1]): m.start() for m in _OBJECT.finditer(self.data)}, {}
        for number in list(self.places):
            found = self.get(number)
            if isinstance(found, Stream) and found.head.get("Type") == "ObjStm":
                try:
                    directory = self.content(found).split()
                    for k in range(self.resolved(found.head["N"])):
                        self.places.setdefault(int(directory[2 * k]), (number, k))
                except DAMAGE:
                    continue
        for m in re.finditer(rb"trailer", self.data):
            try:
                self.trailer |= parse(self.data, m.end())[0]
            except (BrokenPdf, TypeError):
                continue
        roots = [x for n in self.places if isinstance(x := self.get(n), dict) and x.get("Type") == "Catalog" and "Pages" in x]
        if not roots:
            raise BrokenPdf("no catalog")
        self.root = roots[-1]["Pages"]

    def object_at(self, at: int):
        head = _OBJECT.match(self.data, _SKIP.match(self.data, at).end())
        if not head:
            raise BrokenPdf("no object there")
        found, end = parse(self.data, head.end())
        begin = _STREAM.match(self.data, end) if isinstance(found, dict) else None
        if not begin:
            return found
        length = self.resolved(found.get("Length"))
        if not isinstance(length, int) or not _STREAM_END.match(self.data, begin.end() + length):
            length = self.data.find(b"endstream", begin.end()) - begin.end()
            if length < 0:
                raise BrokenPdf("a stream without an end")
        return Stream(found, self.data[begin.end():begin.end() + length])

    def get(self, number: int):
        """The object of a number; null where there is none."""
        if number not in self.seen:
            self.seen[number] = None  # while it is looked up
            place = self.places.get(number)
            try:
                self.seen[number] = None if place is None else self.object_at(place) if isinstance(place, int) else self.unpacked(*place)
            except DAMAGE:
                pass
        return self.seen[number]

    def unpacked(self, number: int, index: int):
        holder = self.get(number)
        if number not in self.packed:
            body = self.content(holder)
            self.packed[number] = body, [int(x) for x in body[:self.resolved(holder.head["First"])].split()]
        body, directory = self.packed[number]
        return parse(body, self.resolved(holder.head["First"]) + directory[2 * index + 1])[0]

    def resolved(self, x):
        for _ in range(MOST_NESTED):
            if not isinstance(x, Ref):
                return x
            x = self.get(x.number)
        raise BrokenPdf("a circle of references")

    def content(self, stream: Stream) -> bytes:
        filters, parameters = self.resolved(stream.head.get("Filter")), self.resolved(stream.head.get("DecodeParms"))
        if filters in (None, []):
            return stream.body
        if filters not in ("FlateDecode", ["FlateDecode"]):
            raise BrokenPdf("an unknown filter")
        parameters = self.resolved(parameters[0]) if isinstance(parameters, list) else parameters
        return unpredicted(zlib.decompressobj().decompress(stream.body), parameters or {})

    def pages(self) -> Iterator[dict]:
        """Page objects in order, with what they inherit."""
        waiting, met = [(self.root, {})], set()
        while waiting:
            ref, inherited = waiting.pop()
            node = self.resolved(ref)
            if not isinstance(node, dict) or ref in met and isinstance(ref, Ref):
                continue
            met.add(ref if isinstance(ref, Ref) else None)
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in node}
            kids = self.resolved(node.get("Kids"))
            if node.get("Type") == "Page" or not isinstance(kids, list):
                yield own | node
            else:
                waiting += [(kid, own) for kid in reversed(kids)]


def written(x, numbers: dict[int, int]) -> bytes:
    """An object as PDF text, references renumbered (null where they lead nowhere)."""
    kind = type(x)
    if kind is Name:
        return b"/" + x.encode("latin-1")
    if kind is Ref:
        return b"%d 0 R" % numbers[x.number] if x.number in numbers else b"null"
    if kind is int:
        return b"%d" % x
    if kind is dict:
        return b"<<" + b"".join([b"/" + k.encode("latin-1") + b" " + written(v, numbers) for k, v in x.items()]) + b">>"
    if kind is list:
        return b"[" + b" ".join([written(v, numbers) for v in x]) + b"]"
    if kind is Stream:
        return written(x.head | {Name("Length"): len(x.body)}, numbers) + b"stream\n" + x.body + b"\nendstream"
    if kind is Raw:
        return bytes(x)
    return {None: b"null", True: b"true", False: b"false"}[x] if x is None or kind is bool else f"{x:.6f}".encode()


def references(x) -> list[int]:
    """Numbers of the objects that an object names, in order."""
    found, waiting = [], [x]
    while waiting:
        x = waiting.pop()
        kind = type(x)
        if kind is Ref:
            found.append(x.number)
        elif kind is dict:
            waiting += reversed(x.values())
        elif kind is Stream:
            waiting.append(x.head)
        elif kind is list:
            waiting += reversed(x)
    return found


def page_count(data: bytes | None) -> int | None:
    try:
        return sum(1 for _ in Pdf(data or b"").pages()) or None
    except DAMAGE:
        return None


def page_slices(data: bytes | None, low: int, high: int) -> list[bytes]:
    """A PDF of its own for each page from ``low`` (0 is the first) below ``high``; the file is read once."""
    try:
        pdf = Pdf(data or b"")
        return [one_page(pdf, p) for p in itertools.islice(pdf.pages(), low, high)] if low >= 0 else []
    except DAMAGE:
        return []


def page_slice(data: bytes | None, index: int) -> bytes | None:
    """A PDF of the one page at ``index`` (from 0)."""
    return next(iter(page_slices(data, index, index + 1)), None)


def one_page(pdf: Pdf, page: dict) -> bytes:
    page = {k: v for k, v in page.items() if k not in ("Parent", "Annots", "B", "StructParents")} | {Name("Type"): Name("Page"), Name("Parent"): Ref(-2, 0)}
    found, waiting = {}, references(page)
    while waiting:
        number = waiting.pop()
        if number not in found and number >= 0 and (x := pdf.get(number)) is not None:
            found[number] = x
            waiting += references(x)
    numbers = {-2: 2, **{n: 4 + i for i, n in enumerate(sorted(found))}}
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count 1/Kids[3 0 R]>>", written(page, numbers), *(written(found[n], numbers) for n in sorted(found))]
    out, offsets = bytearray(b"%PDF-1.7\n"), []
    for n, body in enumerate(objects, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    table = b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out) + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + table + b"trailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


@F.pandas_udf(IntegerType())
def pdf_pages(data: pd.Series) -> pd.Series:
    """Page counts of a binary column; null for files without a page."""
    return data.map(page_count, na_action=None).astype("Int32")


def first_image(data: bytes) -> Stream | None:
    """The image of the lowest number, as it is stored; the file is read once for all numbers."""
    pdf = Pdf(data)
    return next((x for n in sorted(pdf.places) if isinstance(x := pdf.get(n), Stream) and x.head.get("Subtype") == "Image"), None)


#: Pages cut out of a file before they leave the worker.
RUN = 64
#: Bytes of slices that leave the worker at once, or a run.
PART = 8 << 20


def page_runs(data: bytes | None) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, slices) of each run of a file's pages; the file is parsed once, and a run's objects are dropped behind it."""
    try:
        pdf = Pdf(data or b"")
        pages = list(pdf.pages())
    except DAMAGE:
        return
    kept = len(pdf.seen)
    for low in range(0, len(pages), RUN):
        try:
            yield low, [one_page(pdf, page) for page in pages[low:low + RUN]]
        except DAMAGE:
            pass
        while len(pdf.seen) > kept:
            pdf.seen.popitem()  # the last one found


def sliced(files: DataFrame, data: str = "pdf") -> DataFrame:
    """One row a page of each file: its other columns, ``page_index``, and the page as a PDF of its own."""
    rest = [f for f in files.schema.fields if f.name != data]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(data).type
            for part in parts(batch.column(data)):
                rows, places, slices = zip(*part)
                others = [batch.column(f.name).take(pa.array(rows)) for f in rest]
                yield pa.RecordBatch.from_arrays([*others, pa.array(places, pa.int32()), pa.array(slices, kind)], names=[*(f.name for f in rest), "page_index", data])

    def parts(wholes: pa.Array) -> Iterator[list[tuple[int, int, bytes]]]:
        """(row, page, slice) of a batch's pages, in lists of some PART bytes."""
        part, size = [], 0
        for row, whole in enumerate(wholes):
            for low, slices in page_runs(whole.as_py()):
                part += [(row, low + i, x) for i, x in enumerate(slices)]
                size += sum(map(len, slices))
                if size >= PART:
                    yield part
                    part, size = [], 0
        if part:
            yield part

    return files.mapInArrow(cut, StructType([*rest, StructField("page_index", IntegerType()), StructField(data, BinaryType())]))
