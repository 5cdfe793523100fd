"""PDF files of books from page images, assembled in pieces: no task and no row holds a book.

Every page is one piece of three objects (page, content, image) whose numbers follow from its
place in the book.  Pieces' sizes, summed along a book, give the byte offsets that the
cross-reference table needs, so all parts of a file are known without any other's bytes:
header, a page tree of two levels, pages, table, trailer.  ``write_pieces`` streams each
file's pieces in order, one at a time.

Defined cases: pages of equal number stay in the order of their ids; a book without pages has
no file; a file ends at 10 GB, where offsets no longer fit the table (ValueError by Spark's
raise_error).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from pagewright.scratch import cut
from pagewright.sources.page_files import Attempt, FileWriter, Written

#: Pages of a node of the page tree.
FAN = 128
LARGEST = 9_999_999_999
PIECE = "book string, page int, piece binary, sizes array<long>"


def stream_object(number: int, head: str, body: bytes) -> bytes:
    return f"{number} 0 obj\n<<{head}/Length {len(body)}>>stream\n".encode() + body + b"\nendstream\nendobj\n"


def page_objects(number: int, parent: int, image: bytes, across: int, down: int, wide: float, high: float) -> list[bytes]:
    """Page, content and image objects from ``number`` on; ``image`` is the deflated RGB of across x down pixels."""
    page = f"{number} 0 obj\n<</Type/Page/Parent {parent} 0 R/MediaBox[0 0 {wide:.4f} {high:.4f}]/Contents {number + 1} 0 R/Resources<</XObject<</I {number + 2} 0 R>>>>>>\nendobj\n"
    return [page.encode(), stream_object(number + 1, "", f"q {wide:.4f} 0 0 {high:.4f} 0 0 cm /I Do Q".encode()),
            stream_object(number + 2, f"/Type/XObject/Subtype/Image/Width {across}/Height {down}/ColorSpace/DeviceRGB/BitsPerComponent 8/Filter/FlateDecode", image)]


def pdf_pieces(pages: DataFrame) -> DataFrame:
    """(book, part, place, piece): the bytes of each book's PDF, in order of part and place.

    ``pages`` are (book, page_num, image, across, down, width_pt, height_pt), image being deflated RGB.
    """
    base = cut(pages.select("book", "page_num", "image", "across", "down", "width_pt", "height_pt").withColumn("id", F.monotonically_increasing_id()))
    order = Window.partitionBy("book").orderBy("page_num", "id")
    placed = base.select("book", "id", (F.row_number().over(order) - 1).alias("page"), F.count(F.lit(1)).over(Window.partitionBy("book")).alias("n"))  # narrow rows
    nodes = F.ceil(F.col("n") / FAN).cast("int")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [page_objects(3 + r.nodes + 3 * r.page, 3 + r.page // FAN, r.image, r.across, r.down, r.width_pt, r.height_pt) for r in batch.itertuples()]
            yield batch[["book", "page"]].assign(piece=[b"".join(m) for m in made], sizes=[np.array([len(x) for x in m]) for m in made])

    # Written once: its sizes are read first, its bytes at last.
    bodies = cut(base.join(placed.withColumn("nodes", nodes), ["book", "id"]).drop("id", "n", "page_num").mapInPandas(build, PIECE))
    books = placed.groupBy("book").agg(F.count(F.lit(1)).alias("n")).withColumn("nodes", nodes)
    ref = lambda n: F.concat(n.cast("string"), F.lit(" 0 R"))
    kids = lambda first, count, step: F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda k: ref(first + k * step)), " ")
    header = F.concat(F.lit("%PDF-1.4\n"))
    catalog = F.lit("1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n")
    root = F.concat(F.lit("2 0 obj\n<</Type/Pages/Count "), F.col("n").cast("string"), F.lit("/Kids["), kids(F.lit(3), F.col("nodes"), 1), F.lit("]>>\nendobj\n"))
    heads = books.select("book", "n", "nodes", F.array(header, catalog, root).alias("texts"), F.lit(-1).alias("block"))
    within = F.least(F.lit(FAN), F.col("n") - F.col("block") * FAN).cast("int")
    node = F.concat(F.col("block") + 3, F.lit(" 0 obj\n<</Type/Pages/Parent 2 0 R/Count "), within.cast("string"), F.lit("/Kids["),
                    kids(F.col("nodes") + 3 + F.col("block") * 3 * FAN, within, 3), F.lit("]>>\nendobj\n"))
    inner = books.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("nodes") - 1))).select("book", "n", "nodes", F.array(node).alias("texts"), "block")
    front = heads.unionByName(inner)
    # Sizes of objects in the order of their numbers; the file's header has no number.
    front_sizes = front.select("book", F.lit(0).alias("part"), F.col("block").alias("place"), F.transform("texts", lambda t: F.length(t).cast("long")).alias("sizes"))
    sizes = front_sizes.unionByName(bodies.select("book", F.lit(1).alias("part"), F.col("page").alias("place"), "sizes"))
    along = Window.partitionBy("book").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    offsets = sizes.withColumn("size", size).withColumn("at", F.coalesce(F.sum("size").over(along), F.lit(0)))  # narrow rows again
    starts = F.transform("sizes", lambda x, i: F.col("at") + F.aggregate(F.slice("sizes", 1, i), F.lit(0).cast("long"), lambda a, y: a + y))
    entries = F.transform(F.when((F.col("part") == 0) & (F.col("place") < 0), F.slice(starts, 2, 2)).otherwise(starts),
                          lambda o: F.when(o > LARGEST, F.raise_error(F.lit("a PDF of more than 10 GB"))).otherwise(F.format_string("%010d 00000 n \n", o)))
    rows = offsets.select("book", "part", "place", F.array_join(entries, "").alias("text"))
    table = rows.groupBy("book", "part", F.floor(F.col("place") / FAN).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda r: r["text"]), "").alias("text"))
    table = table.select("book", (F.col("part") + 3).alias("part"), F.col("block").cast("long").alias("place"), "text")
    objects = (3 + F.col("nodes") + 3 * F.col("n")).cast("string")
    ends = offsets.groupBy("book").agg(F.sum("size").alias("whole")).join(books, "book")
    begin = ends.select("book", F.lit(2).alias("part"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("xref\n0 "), objects, F.lit("\n0000000000 65535 f \n")).alias("text"))
    end = ends.select("book", F.lit(5).alias("part"), F.lit(0).cast("long").alias("place"),
                      F.concat(F.lit("trailer<</Size "), objects, F.lit("/Root 1 0 R>>\nstartxref\n"), F.col("whole").cast("string"), F.lit("\n%%EOF\n")).alias("text"))
    front_texts = front.select("book", F.lit(0).alias("part"), F.col("block").cast("long").alias("place"), F.array_join("texts", "").alias("text"))
    texts = front_texts.unionByName(begin).unionByName(table).unionByName(end).select("book", "part", "place", F.col("text").cast("binary").alias("piece"))
    return texts.unionByName(bodies.select("book", F.lit(1).alias("part"), F.col("page").cast("long").alias("place"), "piece"))


class FilePieces(D.DataSource):
    """Rows (file, piece): consecutive rows of a file are appended; committed as whole files."""

    @classmethod
    def name(cls) -> str:
        return "file_pieces"

    def schema(self) -> str:
        return "file string, piece binary"

    def writer(self, schema, overwrite: bool) -> "PieceWriter":
        return PieceWriter(self.options["path"], overwrite)


class PieceWriter(FileWriter):
    def write(self, rows: Iterator) -> Written:
        attempt = Attempt(self.path, self.job)
        last = stream = None
        try:
            for file, piece in rows:
                if stream is None or file != last:
                    if stream is not None:
                        stream.close()
                    last, stream = file, attempt.opened(file)
                stream.write(bytes(piece))
            if stream is not None:
                stream.close()
        except BaseException:
            attempt.undone()
            raise
        return attempt.written()


def write_pieces(pieces: DataFrame, base: str, suffix: str = ".pdf") -> None:
    """One file a book under ``base``; a task writes its books one after the other, piece by piece."""
    spark = pieces.sparkSession
    spark.dataSource.register(FilePieces)
    ordered = pieces.repartition("book").sortWithinPartitions("book", "part", "place")
    ordered.select(F.concat("book", F.lit(suffix)).alias("file"), "piece").write.format("file_pieces").mode("overwrite").save(base)
