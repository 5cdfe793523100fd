"""Markdown from segments: lines per block, per chapter, per book, joined in order."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.sections import normalize
from pagewright.operators.structure import segments, with_slugs


class Style(NamedTuple):
    fix_text: bool
    body_only: bool
    page_comments: bool


# The three presets.
STYLES = {"full": Style(True, False, True), "prose": Style(True, True, False), "raw": Style(False, False, True)}


def block_lines(section: str = "b", body_only: bool = False) -> str:
    text = T.strip(f"{section}.text")
    line = f"replace({text}, chr(10), ' ')"
    only = f"WHEN {section}.section_type <> 'body' THEN cast(array() AS array<string>)" if body_only else ""
    return f"""CASE WHEN {text} = '' THEN cast(array() AS array<string>) {only}
        WHEN {section}.section_type IN ('section_title', 'title') THEN array(concat('### ', {line}), '')
        WHEN {section}.section_type = 'subtitle' THEN array(concat('#### ', {line}), '')
        WHEN {section}.section_type = 'toc' THEN array('### 목차 (원본)', '', {text}, '')
        WHEN {section}.section_type = 'figure' THEN array('> **Figure**', '>', replace({text}, chr(10), concat(chr(10), '> ')), '')
        WHEN {section}.section_type = 'caption' THEN array(concat('*', {line}, '*'), '')
        WHEN {section}.section_type = 'footnote' THEN array(concat('> **Footnote** ', {text}), '')
        ELSE array({text}, '') END"""


def render(parts: DataFrame, style: Style) -> DataFrame:
    """(book, markdown) of segments."""
    comment = "array(concat('<!-- pages: ', start_page, '-', end_page, ' -->'), '')" if style.page_comments else "cast(array() AS array<string>)"
    chapter = F.expr(f"""concat(
        array(CASE WHEN kind = 'front_matter' THEN '## Front matter' ELSE concat('## ', heading) END, ''), {comment},
        flatten(transform(blocks, b -> {block_lines('b', style.body_only)})), array('---', ''))""")
    entry = F.expr("CASE WHEN kind <> 'front_matter' THEN concat('- [', heading, '](#', slug, ') *(p.', start_page, ')*') END")
    lined = with_slugs(parts).withColumn("lines", chapter).withColumn("entry", entry)
    books = lined.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("seg", "lines", "entry"))).alias("segs"))
    toc = "filter(transform(segs, s -> s.entry), e -> e IS NOT NULL)"
    whole = f"""concat(
        array('---', concat('title: "', book, '"'), 'assembled_from: tmp/*.ocr.json', '---', '', concat('# ', book), ''),
        CASE WHEN size({toc}) > 0 THEN concat(array('## 목차', ''), {toc}, array('', '---', '')) ELSE cast(array() AS array<string>) END,
        flatten(transform(segs, s -> s.lines)))"""
    return books.select("book", F.expr(f"concat({T.rstrip(f'array_join({whole}, chr(10))')}, chr(10))").alias("markdown"))


def assemble(pages: DataFrame, style: str = "full", page_comments: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, markdown) of pages; ``page_comments`` overrides the style's."""
    chosen = STYLES[style]
    if page_comments is not None:
        chosen = chosen._replace(page_comments=page_comments)
    parts = segments(normalize(pages) if chosen.fix_text else pages)
    return parts, render(parts, chosen)
