"""Chapters and back matter: segments of a book by running sums over its ordered pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.functions import text as T
from pagewright.functions.text import bound
from pagewright.functions.unicode import nfkc
from pagewright.operators.sections import prepare

HEADINGS = "('title', 'section_title')"


def leading(sections: str) -> str:
    """The titles that a page begins with."""
    first_other = f"array_position(transform({sections}, s -> coalesce(s.type, '') <> 'title'), true)"
    return f"slice({sections}, 1, CASE WHEN {first_other} = 0 THEN size({sections}) ELSE cast({first_other} - 1 AS int) END)"


def after_leading(sections: str) -> str:
    return f"slice({sections}, size({leading(sections)}) + 1, size({sections}))"


def chapter_start(sections: str) -> str:
    return f"exists({leading(sections)}, s -> {T.chapter_marker('s.text')})"


def back_matter_start(sections: str) -> str:
    return f"exists({sections}, s -> s.type IN {HEADINGS} AND {T.back_matter_heading('s.text')})"


def chapter_heading(sections: str) -> str:
    """Titles of a chapter page as one heading: a marker with the title after it, or all of them."""
    parts = f"filter(transform({leading(sections)}, s -> {T.flat('s.text')}), t -> t <> '')"
    return f"""CASE WHEN size({parts}) = 0 THEN 'Untitled' WHEN size({parts}) = 1 THEN {parts}[0]
        WHEN {parts}[0] RLIKE {T.raw(r'(?U)^\d+\s*장$')} THEN {T.strip(f"concat({parts}[0], ' ', {parts}[1])")}
        ELSE array_join({parts}, ' ') END"""


def back_matter_title(sections: str) -> str:
    found = f"filter({sections}, s -> s.type IN {HEADINGS} AND {T.back_matter_heading('s.text')})"
    return f"coalesce({T.first_line(f'get({found}, 0).text')}, 'Back matter')"


def slugify(text: str) -> str:
    """SQL for a slug: lower case, NFKC, word characters with dashes between."""
    return bound(nfkc(f"lower({T.strip(text)})"), "normal", T.slug_tail("normal"))


def segments(pages: DataFrame) -> DataFrame:
    """(book, seg, kind, heading, start_page, end_page, blocks) of each book of pages, in order of seg.

    A chapter page starts a segment, and so does a page with a back-matter heading.
    Boundaries are found on the sections as they came, content on the prepared ones;
    pages without any of these are dropped.
    """
    tie = [c for c in ("file_name", "id") if c in pages.columns]
    pos = F.struct("page_num", *tie)
    whole = Window.partitionBy("book").orderBy("pos")
    rows = pages.select("book", "page_num", "sections", pos.alias("pos"), F.expr(prepare("sections")).alias("prepared"))
    rows = rows.withColumn("kind", F.expr(
        f"CASE WHEN {chapter_start('sections')} THEN 'chapter' WHEN {back_matter_start('sections')} THEN 'back_matter' END"))
    rows = rows.withColumn("first_page", F.first("page_num").over(whole)).where(F.size("prepared") > 0)
    rows = rows.withColumn("heading", F.expr(
        f"CASE kind WHEN 'chapter' THEN {chapter_heading('sections')} WHEN 'back_matter' THEN {back_matter_title('sections')} END"))
    first = "get(prepared, 0)"
    rows = rows.withColumn("blocks", F.expr(f"""CASE
        WHEN kind = 'chapter' THEN {after_leading('prepared')}
        WHEN kind = 'back_matter' AND {first}.type IN {HEADINGS} AND {T.back_matter_heading(first + '.text')} THEN slice(prepared, 2, size(prepared))
        ELSE prepared END"""))
    rows = rows.withColumn("seg", F.sum(F.when(F.col("kind").isNotNull(), 1).otherwise(0)).over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    placed = F.expr("transform(blocks, (b, i) -> named_struct('pos', pos, 'idx', i, 'section_type', b.type, 'text', b.text, 'page_num', page_num))")
    grouped = (rows.withColumn("placed", placed).groupBy("book", "seg").agg(
        F.first("kind", ignorenulls=True).alias("kind"), F.first("heading", ignorenulls=True).alias("heading"),
        F.min("first_page").alias("first_page"), F.min_by("page_num", "pos").alias("low"), F.max_by("page_num", "pos").alias("high"),
        F.array_sort(F.flatten(F.collect_list("placed"))).alias("blocks")))
    after = F.lead("low").over(Window.partitionBy("book").orderBy("seg"))
    return grouped.withColumn("next_start", after).where((F.col("seg") > 0) | (F.size("blocks") > 0)).select(
        "book", "seg", F.coalesce("kind", F.lit("front_matter")).alias("kind"), F.coalesce("heading", F.lit("Front matter")).alias("heading"),
        F.when(F.col("seg") == 0, F.col("first_page")).otherwise(F.col("low")).alias("start_page"),
        F.coalesce(F.col("next_start") - 1, F.col("high")).alias("end_page"), "blocks")


def with_slugs(parts: DataFrame) -> DataFrame:
    return parts.withColumn("slug", F.expr(f"CASE WHEN kind = 'front_matter' THEN 'front-matter' ELSE {slugify('heading')} END"))


def page_range(parts: DataFrame) -> DataFrame:
    """(book, first_page, last_page): start of the first segment and end of the last."""
    return parts.groupBy("book").agg(F.min_by("start_page", "seg").alias("first_page"), F.max_by("end_page", "seg").alias("last_page"))


def block_counts(parts: DataFrame) -> DataFrame:
    return parts.select("book", "seg", "kind", F.size("blocks").alias("block_count"))


def assembly_counts(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """(book, n_loaded, n_chapters, first_page, last_page): pages that came in, segments of any kind, and their range."""
    loaded = pages.groupBy("book").agg(F.count(F.lit(1)).alias("n_loaded"))
    made = parts.groupBy("book").agg(F.count(F.lit(1)).alias("n_chapters"), F.min_by("start_page", "seg").alias("first_page"), F.max_by("end_page", "seg").alias("last_page"))
    return loaded.join(made, "book", "left").withColumn("n_chapters", F.coalesce("n_chapters", F.lit(0)))


def summary_json(parts: DataFrame) -> DataFrame:
    """(book, structure): title, page range and chapters as JSON."""
    chapter = F.struct("seg", "heading", "slug", "kind", "start_page", "end_page", F.size("blocks").alias("block_count"))
    chapters = F.transform(F.array_sort(F.collect_list(chapter)), lambda c: F.struct(
        *(c[n].alias(n) for n in ("heading", "slug", "kind", "start_page", "end_page", "block_count"))))
    grouped = with_slugs(parts).groupBy("book").agg(
        F.array(F.min_by("start_page", "seg"), F.max_by("end_page", "seg")).alias("page_range"), chapters.alias("chapters"))
    return grouped.select("book", F.to_json(F.struct(F.col("book").alias("title"), "page_range", "chapters")).alias("structure"))
