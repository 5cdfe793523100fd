"""Sources of page files: OCR JSON, page text, language lists, job state, configs with comments, prompts.

Files lie as ``{base}/{title}/tmp/{title}_{page:04d}{suffix}``; book and page come from the
file's name, never from what it says.  One scan reads many books.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.sanitize import NONE, loaded_sections

# Suffixes of a page's files, and the prompt used where no other is given.
SUFFIXES = (".png", ".txt", ".ocr.json", ".page.pdf")
FALLBACK_PROMPT = "Return one JSON object with page, text and typed sections. Language: {lang_hint}. Page: {page_num}."


def page_name(title: str = "title", page: str = "page_num", suffix: str = ".ocr.json") -> str:
    """SQL for a page's file name; four digits at least."""
    return f"format_string('%s_%04d%s', {title}, {page}, '{suffix}')"


def named_pages(files: DataFrame, suffix: str) -> DataFrame:
    """(book, page_num, file_name, value) of whole files; names of another form are skipped."""
    pattern = r"^(.*)_(\d+)" + re.escape(suffix) + "$"
    return (files.withColumn("book", F.regexp_extract("file_name", pattern, 1))
            .withColumn("page_num", F.expr(f"try_cast(regexp_extract(file_name, {T.raw(pattern)}, 2) AS int)"))
            .where((F.col("book") != "") & F.col("page_num").isNotNull()))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(decoded_name().alias("file_name"), "value")


def decoded_name():
    """The file's name; Spark gives it percent-encoded."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def ocr_pages(files: DataFrame) -> DataFrame:
    """(book, page_num, file_name, sections) of (file_name, value) rows; a file that is no object is an empty page."""
    return parsed_pages(named_pages(files, ".ocr.json"))


def parsed_pages(files: DataFrame) -> DataFrame:
    """(book, page_num, file_name, sections) of (book, page_num, file_name, value) rows."""
    sections = f"CASE WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN {loaded_sections('v')} ELSE {NONE} END"
    return files.withColumn("v", F.expr("try_parse_json(value)")).select("book", "page_num", "file_name", F.coalesce(F.expr(sections), F.expr(NONE)).alias("sections"))


def load_ocr_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages under ``path`` (a folder or glob); raises if there is none."""
    pages = ocr_pages(whole_files(spark, path))
    if pages.isEmpty():
        raise FileNotFoundError(f"no page files *_NNNN.ocr.json under {path}")
    return pages


def combined_text(files: DataFrame) -> DataFrame:
    """(book, combined): every page's text under its number, in order."""
    pages = named_pages(files, ".txt")
    part = F.struct("page_num", "file_name", F.concat(F.lit("=== page "), F.col("page_num").cast("string"), F.lit(" ===\n"), "value").alias("part"))
    return pages.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["part"]), "\n\n").alias("combined"))


def languages(spark: SparkSession, path: str) -> DataFrame:
    """(lang, code) of a CSV with a header; a byte order mark is dropped."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8")
    return rows.toDF(*(c.lstrip("\ufeff").strip() for c in rows.columns))


def language_code(names: DataFrame, known: DataFrame) -> DataFrame:
    """(.., code) by language name; the first of equal names."""
    first = known.groupBy("lang").agg(F.min_by("code", "ord").alias("code"))
    return names.join(first, "lang", "left")


def strip_comments(text: str) -> str:
    """JSON with ``//`` and ``/* */`` comments, without them; strings are left alone. Line breaks stay."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
    return token.sub(lambda m: m[0] if m[0][0] == '"' else "\n" * m[0].count("\n") or " ", text)


def parsed_jsonc(column: str) -> str:
    """SQL for the variant of a column of JSON with comments; null where it is none."""
    return f"try_parse_json({T.strip_comments(column)})"


def load_jsonc(text: str):
    return json.loads(strip_comments(text))


def job_state(files: DataFrame) -> DataFrame:
    """(book, phase, page_num, status) rows of state files (book, value); a broken file is an empty state."""
    return page_marks(files).select("book", "phase", "page_num", "status")


def page_marks(files: DataFrame) -> DataFrame:
    """(book, phase, page_num, status, path, error) of every page that a state file (book, value) marks."""
    phases = "try_variant_get(try_parse_json(value), '$.phases', 'map<string,map<string,struct<status:string,path:string,error:string>>>')"
    rows = files.select("book", F.explode(F.expr(phases)).alias("phase", "pages")).select("book", "phase", F.explode("pages").alias("page", "mark"))
    return rows.select("book", "phase", F.expr("try_cast(page AS int)").alias("page_num"), "mark.status", "mark.path", "mark.error")


def job_facts(files: DataFrame) -> DataFrame:
    """(book, start_page, n_pages, last_page, final_pdf, combined_txt, n_errors) of state files; nulls and 0 for a broken one."""
    get = lambda path, kind: f"try_variant_get(try_parse_json(value), '$.{path}', '{kind}')"
    return files.selectExpr("book", f"{get('start_page', 'int')} AS start_page", f"{get('n_pages', 'int')} AS n_pages", f"{get('end_of_book_last_page', 'int')} AS last_page",
                            f"{get('outputs.final_pdf', 'string')} AS final_pdf", f"{get('outputs.combined_txt', 'string')} AS combined_txt",
                            f"coalesce(size({get('errors', 'array<variant>')}), 0) AS n_errors")


def job_errors(files: DataFrame) -> DataFrame:
    """(book, ord, phase, page_num, error): the error list of each state file, in its order."""
    listed = F.expr("try_variant_get(try_parse_json(value), '$.errors', 'array<struct<phase:string,page:int,error:string>>')")
    return files.select("book", F.posexplode(listed).alias("ord", "e")).select("book", "ord", "e.phase", F.col("e.page").alias("page_num"), "e.error")


def prompt(inline: str = "inline", named: str = "prompt_file", file_text: str = "file_text", bundled: str = "bundled") -> str:
    """SQL for the prompt: inline, else that of the named file, else the bundled one; marks filled in.

    A missing file, named or bundled, gives the fallback.
    """
    file = f"CASE WHEN coalesce({T.strip(named)}, '') <> '' THEN {file_text} ELSE {bundled} END"
    template = f"coalesce(nullif({T.strip(inline)}, ''), {file}, {T.literal(FALLBACK_PROMPT)})"
    return f"replace(replace({template}, '{{lang_hint}}', lang_hint), '{{page_num}}', cast(page_num AS string))"


def pages_of_documents(documents: DataFrame, per_book: int = 500, kept: tuple[str, ...] = (), single: bool = False) -> DataFrame:
    """Documents as pages: books of a source's documents with near ids, a section per non-blank line.

    Lines with a bar are figures, others bodies.  Books stay small however large a source is.
    The columns ``kept`` stay beside the sections.  With ``single`` they are one book, numbered by their ids.
    """
    from pyspark.sql.window import Window

    book = F.concat_ws("/", "source", (F.floor(F.col("doc_id") / per_book)).cast("string"))
    lines = f"filter(transform(split(text, chr(10), -1), t -> {T.strip('t')}), t -> t <> '')"
    sections = F.expr(f"transform({lines}, t -> named_struct('type', CASE WHEN contains(t, '|') THEN 'figure' ELSE 'body' END, 'text', t))")
    if single:
        return documents.select("doc_id", F.lit("all").alias("book"), sections.alias("sections"), *kept, F.col("doc_id").cast("int").alias("page_num"))
    number = F.row_number().over(Window.partitionBy("book").orderBy("doc_id"))
    return documents.select("doc_id", book.alias("book"), sections.alias("sections"), *kept).withColumn("page_num", number)


#: A first line of at most so many characters that ends no sentence heads its page; another short line is of no known kind.
HEADING, SHORT = 60, 25


def chaptered_pages(documents: DataFrame, per_book: int = 500) -> DataFrame:
    """Documents as the pages of books with running heads, page numbers, headings and chapters, all taken from the table.

    Where the language changes from page to page, a chapter begins, numbered by its page.  Every
    second page then has its source as running head, two of three have their number; a
    short first line is a title; the last page of a book ends with its appendix, and every
    fifth page with its running head.
    """
    from pyspark.sql.window import Window

    book = F.concat_ws("/", "source", (F.floor(F.col("doc_id") / per_book)).cast("string"))
    order = Window.partitionBy("book").orderBy("doc_id")
    rows = documents.select("doc_id", book.alias("book"), "source", "lang", "text").select(
        "*", F.row_number().over(order).alias("page_num"), F.lag("lang").over(order).alias("before"), F.lead("doc_id").over(order).isNull().alias("last"))
    lines = f"filter(transform(split(coalesce(text, ''), chr(10), -1), t -> {T.strip('t')}), t -> t <> '')"
    kind = f"""CASE WHEN contains(t, '|') THEN 'figure' WHEN i = 0 AND length(t) <= {HEADING} AND NOT t RLIKE '[.!?]$' THEN 'title'
        WHEN length(t) <= {SHORT} THEN 'other' ELSE 'body' END"""
    made = lambda kind, text, when="true": f"CASE WHEN {when} THEN array(named_struct('type', '{kind}', 'text', {text})) ELSE array() END"
    sections = f"""concat({made('title', "concat(page_num, '장')", 'lang <> before')}, {made('header', 'source', 'source IS NOT NULL AND page_num % 2 = 0')},
        {made('page_number', 'cast(page_num AS string)', 'page_num % 3 > 0')}, transform({lines}, (t, i) -> named_struct('type', {kind}, 'text', t)),
        {made('section_title', "'Appendix'", 'last')}, {made('header', 'source', 'source IS NOT NULL AND page_num % 5 = 0')})"""
    return rows.select("book", "page_num", F.expr(sections).alias("sections"))


__all__ = ["chaptered_pages", "combined_text", "job_errors", "job_facts", "job_state", "language_code", "languages", "load_jsonc", "load_ocr_pages", "named_pages",
           "ocr_pages", "page_marks", "page_name", "pages_of_documents", "parsed_pages", "prompt", "strip_comments", "whole_files"]
