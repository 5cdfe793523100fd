"""The queries of this engine's own operators, each with independent DuckDB SQL.

Queries run over whole driver tables where those carry the operator's input, and over
the fixture rows of ``fixtures`` where ordinary documents never reach a rule.
"""

from __future__ import annotations

import datetime
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import matching, planning, render, sanitize, sections, settings, structure
from pagewright.plans import fixtures as X
from pagewright.plans import oracle as O
from pagewright.scratch import scratch_folder
from pagewright.session import table
from pagewright.sources import images, page_files, pdf_read, pdf_write
from pagewright.sources import pages as P
from pagewright.streaming import marks

Query = Callable[[SparkSession, str], DataFrame]


def fixture_pages(spark: SparkSession) -> DataFrame:
    """Fixture books as (book, page_num, sections), pages without sections included."""
    secs = spark.sql(X.SECTIONS).groupBy("book", "page_num").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sec_idx", "type", "text"))), lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"))).alias("sections"))
    none = F.expr(f"cast(array() AS {sections.SECTIONS})")
    return spark.sql(X.PAGES).join(secs, ["book", "page_num"], "left").withColumn("sections", F.coalesce("sections", none))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pages_of_documents(table(spark, sf_dir, "documents")).select("book", "page_num", "sections")


def section_rows(pages: DataFrame, column: str = "sections") -> DataFrame:
    return pages.select("book", "page_num", F.posexplode(column).alias("idx", "s")).select(
        "book", "page_num", F.col("idx").cast("long").alias("idx"), F.col("s.type").alias("type"), F.col("s.text").alias("text"))


def digest(rows: DataFrame) -> DataFrame:
    """Rows with their text as length and md5, for whole tables."""
    return rows.select(*(c for c in rows.columns if c != "text"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def reflow_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph reflow of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = docs.withColumn("flowed", F.expr(T.reflow("text")))
    return made.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.size(F.split("flowed", "\n\n", -1)).cast("long").alias("n_paragraphs"),
                       F.length("flowed").cast("long").alias("chars"), F.md5("flowed").alias("digest"))


def repeat_runs_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, n_pages, last_page): every book of documents, and where repeats of a whole text end it, if they do."""
    docs = table(spark, sf_dir, "documents").withColumn("digest", F.sha1(F.coalesce("text", F.lit("")).cast("binary")))
    captures = P.pages_of_documents(docs, kept=("digest",)).select("book", "page_num", "digest")
    counts = captures.groupBy("book").agg(F.count(F.lit(1)).alias("n_pages"))
    return counts.join(planning.truncate_repeats(captures), "book", "left")


def single_book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the pages of one book, numbered by their ids."""
    return P.pages_of_documents(table(spark, sf_dir, "documents"), single=True).select("book", "page_num", "sections")


def page_files_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents written as page files and read back: (book, page_num, n_sections, chars)."""
    base = scratch_folder(spark, "pages")
    page_files.write_whole_files(page_files.page_file_rows(document_pages(spark, sf_dir)), base)
    back = P.parsed_pages(page_files.read_page_files(spark, base))
    chars = F.aggregate("sections", F.lit(0), lambda a, s: a + F.length(s["text"]))
    return back.select("book", "page_num", F.size("sections").cast("long").alias("n_sections"), chars.cast("long").alias("chars"))


def markdown_files_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of each book of documents as one file, read back by Spark: (book, chars, digest)."""
    base = scratch_folder(spark, "markdown")
    books = render.assemble(document_pages(spark, sf_dir), "full")[1]
    page_files.write_whole_files(books.select(F.concat("book", F.lit(".md")).alias("file"), F.col("markdown").alias("value")), base)
    back = spark.read.text(base, wholetext=True, recursiveFileLookup=True).select("value", F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)[.]md$", 1).alias("book"))
    return back.select("book", F.length("value").cast("long").alias("chars"), F.md5("value").alias("digest"))


def event_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as marks: a user's, their type being the status."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))


def settled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each user's events, 6 hours apart at most, found by a stream that gets them in two parts."""
    given = event_marks(spark, sf_dir)
    low, high = given.agg(F.min("ts"), F.max("ts")).first()
    middle, end = low + (high - low) / 2, spark.createDataFrame([("", -1, high + datetime.timedelta(days=9), "end")], given.schema)
    chunks = [given.where(F.col("ts") < F.lit(middle)), given.where(F.col("ts") >= F.lit(middle))]
    found = marks.fed(spark, chunks, end, lambda s: marks.settled(s, "6 hours"), scratch_folder(spark, "marks")).where("key <> ''")
    return found.select("key", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "status", "n_marks")


def language_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents whose digest is their language, so that books do end."""
    return P.pages_of_documents(table(spark, sf_dir, "documents"), kept=("lang",)).select("book", "page_num", F.col("lang").alias("digest"))


def repeat_runs_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.truncate_repeats(language_captures(spark, sf_dir))


def repeat_runs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that gets the pages in three parts, chosen by a hash, each in no order."""
    arrived = F.expr("timestamp_seconds(1700000000 + pmod(xxhash64(book, page_num), 3600))")
    given = language_captures(spark, sf_dir).withColumn("ts", arrived)
    end = spark.createDataFrame([("", 1, None, datetime.datetime(2024, 1, 1))], "book string, page_num int, digest string, ts timestamp")
    chunks = [given.where(F.pmod(F.xxhash64("page_num", "book"), F.lit(3)) == k) for k in range(3)]
    return marks.fed(spark, chunks, end, lambda s: marks.ends_of_books(s, patience="1 day", delay="2 hours"), scratch_folder(spark, "captures"))


def chaptered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.chaptered_pages(table(spark, sf_dir, "documents"))


def chaptered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.segments(sections.normalize(chaptered(spark, sf_dir)))


def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, needle): part names and the longer words of benchmark items in whole documents, case folded."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.expr("regexp_extract_all(text, '[A-Za-z]{5,}', 0)")).alias("needle"))
    needles = words.unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("needle")))
    return matching.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", needles, "needle").select("doc_id", "needle")


def pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, page_index, pixels): books of documents as PDFs, a page an image of the text's digest, written in pieces, cut into pages and read back."""
    base = scratch_folder(spark, "pdf")
    shots = P.pages_of_documents(table(spark, sf_dir, "documents").withColumn("pixels", F.concat(F.md5(F.coalesce("text", F.lit(""))), F.lit("0" * 16))), kept=("pixels",))

    def deflated(batches):
        for batch in batches:
            yield batch[["book", "page_num"]].assign(image=[zlib.compress(x.encode()) for x in batch["pixels"]], across=4, down=4, width_pt=72.0, height_pt=96.0)

    pdf_write.write_pieces(pdf_write.pdf_pieces(shots.select("book", "page_num", "pixels").mapInPandas(deflated, images.PDF_PAGE)), base)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(F.regexp_extract("path", "([^/]+/[^/]+)[.]pdf$", 1).alias("book"), F.col("content").alias("pdf"))

    @F.pandas_udf("string")
    def pixels(pages):
        return pages.map(lambda page: zlib.decompress(pdf_read.first_image(bytes(page)).body).decode())

    return pdf_read.sliced(files).select("book", "page_index", pixels("pdf").alias("pixels"))


def document_jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Books of documents as jobs, and their artifacts: a page's image has as many bytes as its text full stops, its OCR as many as it has commas."""
    signs = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    docs = table(spark, sf_dir, "documents").withColumns({"png": F.coalesce(signs("."), F.lit(0)), "ocr": F.coalesce(signs(","), F.lit(0))})
    pages = P.pages_of_documents(docs, kept=("png", "ocr"))
    artifacts = pages.select("book", "page_num", F.explode(F.array(F.struct(F.lit(".png").alias("suffix"), F.col("png").alias("size")), F.struct(F.lit(".ocr.json").alias("suffix"), F.col("ocr").alias("size")))).alias("a")).select("book", "page_num", "a.*")
    jobs = pages.groupBy("book").agg(F.lit(1).alias("start_page"), F.max("page_num").alias("n_pages")).withColumns({"has_pdf": F.lit(False), "has_markdown": F.lit(True)})
    return jobs, artifacts


def status_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = planning.artifact_status(*document_jobs(spark, sf_dir))
    return found.select("book", "png", "png_complete", F.col("png_missing").cast("long").alias("png_missing"), "png_prefix", "ocr", "ocr_complete", F.col("ocr_missing").cast("long").alias("ocr_missing"))


def resume_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages a job over documents skips: those with OCR are valid, and the last event of the user of the page's number is its status."""
    jobs, artifacts = document_jobs(spark, sf_dir)
    state = table(spark, sf_dir, "events").select(F.lit("src0/0").alias("book"), F.lit("ocr").alias("phase"), F.col("user_id").cast("int").alias("page_num"),
                                                  F.when(F.col("event_type") == "click", "done").otherwise(F.col("event_type")).alias("status"), F.struct("ts", "event_id").alias("seq"))
    expected = planning.expected_pages(jobs).select("book", F.lit("ocr").alias("phase"), "page_num", F.lit(True).alias("resume"), F.lit("").alias("force_phase"))
    valid = planning.present(artifacts, ".ocr.json").select("book", F.lit("ocr").alias("phase"), "page_num")
    return planning.resume(expected, valid, state)


def assembly_counts_of(pages: Callable[[SparkSession, str], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = pages(spark, sf_dir)
        return structure.assembly_counts(given, structure.segments(sections.normalize(given)))

    return run


def config_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    arguments = spark.sql(X.ARGUMENTS)
    found = settings.resolve(spark.sql(X.CONFIG_FILES), arguments, settings.builtin_profiles(spark))
    return found.select("config", "reader_profile", "n_pages", "next_key", "delay_sec", "capture_mode", "rect_left", "rect_height", "trim_top", "trim_bottom")


def lines_with(columns: Callable[[str], dict[str, str]]) -> Query:
    """A query of flags over the fixture lines and all lines of all documents."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_id"), F.posexplode(F.split("text", "\n", -1)).alias("part", "line"))
        rows = docs.select("line_id", F.col("part").cast("long").alias("part"), "line").unionByName(
            spark.sql(X.LINES).select((-F.col("line_id") - 1).cast("long").alias("line_id"), F.lit(0).cast("long").alias("part"), "line"))
        return rows.select("line_id", "part", *(F.expr(sql).alias(name) for name, sql in columns("line").items()))

    return run


def lines_oracle(columns: dict[str, str]) -> str:
    named = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"""WITH given AS (SELECT -line_id - 1 AS line_id, 0 AS part, line FROM ({X.LINES})
        UNION ALL SELECT doc_id, i - 1, l[i] FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
        SELECT line_id::BIGINT AS line_id, part::BIGINT AS part, {named} FROM given"""


def _sql(rows: str) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: spark.sql(rows)


def full_parts(spark: SparkSession) -> DataFrame:
    return structure.segments(sections.normalize(fixture_pages(spark)))


def _fixture(given: str = "given") -> str:
    return f"fixture_pages AS ({X.PAGES}), {given} AS ({X.SECTIONS})"


def _structure_oracle(tail: str, style: str = "full") -> str:
    if style == "raw":
        return f"WITH RECURSIVE {_fixture()}, merged AS (SELECT book, page_num, sec_idx AS idx, type, text FROM given), listed AS (SELECT * FROM fixture_pages), {O.prepared('merged')}, {O.structure('merged')}{tail}"
    return f"WITH RECURSIVE {_fixture()}, {O.within()}, {O.across()}, listed AS (SELECT DISTINCT book, page_num FROM merged), {O.prepared('merged')}, {O.structure('merged')}{tail}"


def _documents_oracle(tail: str) -> str:
    return f"WITH RECURSIVE {O.DOCUMENT_SECTIONS}, {O.within()}, {O.across()}, listed AS (SELECT DISTINCT book, page_num FROM merged), {O.prepared('merged')}, {O.structure('merged')}{tail}"


_SUMMARY = """SELECT book, '{"title":' || to_json(book)::VARCHAR || ',"page_range":[' || min_by(start_page, seg) || ',' || max_by(end_page, seg) || '],"chapters":[' ||
              string_agg('{"heading":' || to_json(heading)::VARCHAR || ',"slug":' || to_json(slug)::VARCHAR || ',"kind":"' || kind || '","start_page":' || start_page || ',"end_page":' || end_page || ',"block_count":' || block_count || '}', ',' ORDER BY seg) || ']}' AS structure
            FROM slugged GROUP BY book"""


def queries() -> dict[str, Query]:
    expr = F.expr
    found: dict[str, Query] = {
        "reflow_documents": reflow_documents,
        "paragraph_ends_flags": lines_with(lambda x: {"ends": T.paragraph_ends(x)}),
        "new_paragraph_flags": lines_with(lambda x: {"starts_new": T.new_paragraph(x)}),
        "continuation_flags": lines_with(lambda x: {"continues": T.continuation(x)}),
        "heading_flags": lines_with(lambda x: {"first": T.first_line(x), "chapter": T.chapter_marker(x), "back_matter": T.back_matter_heading(x), "numbered": T.section_number(x)}),
        "join_wrapped_pairs": lambda spark, d: spark.sql(X.PAIRS).select("pair_id", expr(T.join_lines("a", "b")).alias("joined"), expr(T.space_joiner("a")).alias("spaced")),
        "sections_exploded": lambda spark, d: digest(section_rows(document_pages(spark, d)).where("type NOT IN ('header', 'page_number')")),
        "prepare_sections": lambda spark, d: section_rows(fixture_pages(spark).withColumn("sections", expr(sections.prepare("sections")))),
        "page_has_text": lambda spark, d: fixture_pages(spark).select("book", "page_num", expr(sections.has_text("sections")).alias("has_text"), expr(f"size({sections.content('sections')})").cast("long").alias("n_content")),
        "prepare_sections_documents": lambda spark, d: digest(section_rows(document_pages(spark, d).withColumn("sections", expr(sections.prepare("sections"))))),
        "page_has_text_documents": lambda spark, d: document_pages(spark, d).select("book", "page_num", expr(sections.has_text("sections")).alias("has_text"), expr(f"size({sections.content('sections')})").cast("long").alias("n_content")),
        "structure_summary_documents": lambda spark, d: structure.summary_json(structure.segments(sections.normalize(document_pages(spark, d)))),
        "markdown_render_full_documents": lambda spark, d: render.assemble(document_pages(spark, d), "full")[1].select("book", F.length("markdown").cast("long").alias("chars"), F.md5("markdown").alias("digest")),
        "merge_within_page": lambda spark, d: section_rows(fixture_pages(spark).withColumn("sections", expr(sections.merge_within(sections.reflow_sections("sections"))))),
        "merge_within_page_documents": lambda spark, d: digest(section_rows(document_pages(spark, d).withColumn("sections", expr(sections.reflow_sections("sections"))).withColumn("sections", expr(sections.merge_within("sections"))))),
        "merge_cross_page": lambda spark, d: section_rows(sections.normalize(fixture_pages(spark))),
        "merge_cross_page_documents": lambda spark, d: digest(section_rows(sections.normalize(document_pages(spark, d)))),
        "merge_cross_page_single_book": lambda spark, d: digest(section_rows(sections.normalize(single_book_pages(spark, d)))),
        "page_files_documents": page_files_documents,
        "markdown_files_documents": markdown_files_documents,
        "settled_events": settled_events,
        "repeat_runs_languages": repeat_runs_languages,
        "repeat_runs_stream": repeat_runs_stream,
        "title_matches_documents": title_matches,
        "slugs_documents": lambda spark, d: table(spark, d, "documents").select("doc_id", expr(structure.slugify(T.first_line("coalesce(text, '')"))).alias("slug")),
        "prepare_sections_chaptered": lambda spark, d: digest(section_rows(chaptered(spark, d).withColumn("sections", expr(sections.prepare("sections"))))),
        "chapter_segments_chaptered": lambda spark, d: structure.with_slugs(chaptered_parts(spark, d)).select("book", "seg", "kind", "heading", "slug", "start_page", "end_page"),
        "block_counts_chaptered": lambda spark, d: structure.block_counts(chaptered_parts(spark, d)).withColumn("block_count", F.col("block_count").cast("long")),
        "page_range_chaptered": lambda spark, d: structure.page_range(chaptered_parts(spark, d)),
        "structure_summary_chaptered": lambda spark, d: structure.summary_json(chaptered_parts(spark, d)),
        "assembly_counts_chaptered": assembly_counts_of(chaptered),
        **{f"markdown_{style}_chaptered": (lambda spark, d, style=style: render.assemble(chaptered(spark, d), style)[1].select("book", F.length("markdown").cast("long").alias("chars"), F.md5("markdown").alias("digest")))
           for style in render.STYLES},
        "pdf_documents": pdf_documents,
        "comments_stripped_pages": lambda spark, d: table(spark, d, "pages").select("page_id", expr(f"md5({T.strip_comments('html')})").alias("digest"), expr(f"length({T.strip_comments('html')})").cast("long").alias("chars")),
        "missing_pages_documents": lambda spark, d: planning.missing_pages(*document_jobs(spark, d), ".png"),
        "contiguous_prefix_documents": lambda spark, d: planning.contiguous_prefix(*document_jobs(spark, d), ".png"),
        "artifact_status_documents": status_documents,
        "resume_documents": resume_documents,
        "last_status_events": lambda spark, d: planning.last_status(table(spark, d, "events").select(F.col("user_id").alias("book"), F.lit("capture").alias("phase"), (F.col("event_id") % 10).alias("page_num"), F.col("event_type").alias("status"), F.struct("ts", "event_id").alias("seq"))),
        "chapter_segments": lambda spark, d: structure.with_slugs(full_parts(spark)).select("book", "seg", "kind", "heading", "slug", "start_page", "end_page"),
        "block_counts": lambda spark, d: structure.block_counts(full_parts(spark)).withColumn("block_count", F.col("block_count").cast("long")),
        "page_range": lambda spark, d: structure.page_range(full_parts(spark)),
        "structure_summary": lambda spark, d: structure.summary_json(full_parts(spark)),
        "document_structure": lambda spark, d: structure.segments(sections.normalize(document_pages(spark, d))).select("book", "kind", "start_page", "end_page", F.size("blocks").cast("long").alias("block_count")),
        **{f"markdown_render_{style}": (lambda spark, d, style=style: render.assemble(fixture_pages(spark), style)[1]) for style in render.STYLES},
        "markdown_without_comments": lambda spark, d: render.assemble(fixture_pages(spark), "full", page_comments=False)[1],
        "combined_text": lambda spark, d: P.combined_text(spark.sql(X.TEXT_FILES)),
        "sanitize_pages": lambda spark, d: sanitize.sanitize(spark.sql(X.REPLIES)).select("reply_id", "page", "text", F.size("sections").alias("n_sections"), expr("array_join(transform(sections, s -> concat(s.type, '=', s.text)), '|')").alias("sections"), "ok"),
        "load_sections": lambda spark, d: spark.sql(X.REPLIES).withColumn("v", expr("try_parse_json(reply)")).where(expr("schema_of_variant(v) LIKE 'OBJECT%'")).select("reply_id", expr(f"array_join(transform({sanitize.loaded_sections('v')}, s -> concat(s.type, '=', s.text)), '|')").alias("sections")),
        "fenced_json": lambda spark, d: spark.sql(X.REPLIES).select("reply_id", expr(f"({sanitize.json_object('reply')}) IS NOT NULL").alias("ok")),
        "missing_pages_anti": lambda spark, d: planning.missing_pages(spark.sql(X.JOBS), spark.sql(X.ARTIFACTS), ".png"),
        "contiguous_prefix": lambda spark, d: planning.contiguous_prefix(spark.sql(X.JOBS), spark.sql(X.ARTIFACTS), ".png"),
        "artifact_status": lambda spark, d: planning.artifact_status(spark.sql(X.JOBS), spark.sql(X.ARTIFACTS)).select("book", "png", "png_complete", F.col("png_missing").cast("long").alias("png_missing"), "ocr", "ocr_complete", F.col("ocr_missing").cast("long").alias("ocr_missing"), "has_pdf", "has_markdown"),
        "plan_steps": lambda spark, d: planning.plan_steps(spark.sql(X.JOBS), spark.sql(X.ARTIFACTS)),
        "plan_phases": lambda spark, d: planning.phases(planning.plan_steps(spark.sql(X.JOBS), spark.sql(X.ARTIFACTS))),
        "resume_skip": lambda spark, d: planning.resume(spark.sql(X.RESUME), spark.sql(X.VALID), spark.sql(X.STATE)),
        "valid_files": lambda spark, d: planning.valid_files(spark.sql(X.FILES)).select("file_id", "valid"),
        "last_status": lambda spark, d: planning.last_status(spark.sql(X.STATE)),
        "repeat_runs_truncate": lambda spark, d: planning.truncate_repeats(spark.sql(X.CAPTURES)),
        "repeat_runs_documents": repeat_runs_documents,
        "assembly_counts": assembly_counts_of(lambda spark, d: fixture_pages(spark)),
        "assembly_counts_documents": assembly_counts_of(document_pages),
        "can_screen_capture": lambda spark, d: spark.sql(X.RULES).select("config", settings.can_screen_capture(title="window_title").alias("can_capture")),
        "pdf_source": lambda spark, d: planning.pdf_source(spark.sql(X.PDF_JOBS), spark.sql(X.PDF_FILES)),
        "config_resolved": config_resolved,
        "job_facts": lambda spark, d: P.job_facts(spark.sql(X.STATE_FILES)),
        "job_errors": lambda spark, d: P.job_errors(spark.sql(X.STATE_FILES)),
        "page_marks": lambda spark, d: P.page_marks(spark.sql(X.STATE_FILES)),
        "pages_to_run_debug": lambda spark, d: planning.pages_to_run(spark.sql(X.JOBS), spark.sql("SELECT 'img_new' AS book, 2 AS last_page"), debug_most=4),
        "kept_captures": lambda spark, d: planning.kept_captures(spark.sql(X.CAPTURES)),
        "pages_to_run": lambda spark, d: planning.pages_to_run(spark.sql(X.JOBS), spark.sql("SELECT 'img_new' AS book, 2 AS last_page")),
        "job_progress": lambda spark, d: planning.progress(spark.sql(X.EVENTS)),
        "profile_overlay": lambda spark, d: settings.overlay(spark.sql(X.CONFIGS), spark.sql(X.PROFILES)),
        "profile_catalogue": lambda spark, d: settings.catalogue(spark.sql(X.BUILTIN), spark.sql(X.FROM_FILE)),
        "config_fields": lambda spark, d: settings.configs(spark.sql(X.CONFIG_FILES)).select("config", "n_pages", "next_key", "delay_sec", "resume", "output_mode", "stop_repeat_pages", "rect_left", "rect_width", "trim_top", "trim_bottom"),
        "builtin_profile_overlay": lambda spark, d: settings.overlay(settings.configs(spark.sql(X.CONFIG_FILES)).withColumn("reader_profile", F.when(F.col("config") == "flat", "kindle_app").otherwise("none")), settings.builtin_profiles(spark)).select("config", "reader_profile", "delay_sec", "next_key", "reader_focus_clicks", "trim_top", "trim_bottom", "target_window_title"),
        "config_precedence": lambda spark, d: spark.sql(X.LAYERS).select("layer_id", settings.precedence(F.col("cli"), F.col("profile"), F.col("file"), F.lit("default")).alias("value")),
        "config_violations": lambda spark, d: settings.violations(spark.sql(X.RULES)).select("config", F.array_join("violations", ",").alias("violations")),
        "enum_normalized": lambda spark, d: spark.sql(X.MODES).select("mode_id", settings.normalized(F.col("mode"), settings.OUTPUT_MODES, "pdf").alias("mode")),
        "rect_thirds": lambda spark, d: spark.sql(X.RECTS).select("rect_id", *(c.alias(n) for n, c in settings.capture_rect().items())),
        "trim_geometry": lambda spark, d: settings.trim_geometry(spark.sql(X.IMAGES)).select("image", "crop_left", "crop_top", "crop_right", "crop_bottom", "enough", "top_band_end", "bottom_band_start", F.round("width_pt", 6).alias("width_pt"), F.round("height_pt", 6).alias("height_pt")),
        "histogram_means": lambda spark, d: settings.histogram_means(spark.sql(X.LEVELS)),
        "mostly_black": lambda spark, d: settings.mostly_black(spark.sql(X.SHADES)),
        "pick_window": lambda spark, d: settings.pick_window(spark.sql(X.WINDOWS)),
        "window_titles": lambda spark, d: settings.distinct_titles(settings.titles_like(spark.sql(X.WINDOWS), "WEB")),
        "largest_child": lambda spark, d: settings.largest_child(spark.sql(X.CHILDREN)),
        "language_lookup": lambda spark, d: P.language_code(spark.sql(X.NAMES), spark.sql(X.LANGUAGES)),
        "prompt_resolved": lambda spark, d: spark.sql(X.PROMPTS).join(spark.sql(X.PROMPT_FILES), "prompt_id").select("prompt_id", expr(P.prompt()).alias("prompt")),
        "page_names": lambda spark, d: planning.expected_pages(spark.sql(X.JOBS)).select("book", "page_num", expr(P.page_name("book")).alias("file_name")),
    }
    return found


def oracle_sql() -> dict[str, str]:
    expected = f"jobs AS ({X.JOBS}), artifacts AS ({X.ARTIFACTS}), expected AS (SELECT book, unnest(range(start_page, start_page + n_pages)) AS page_num FROM jobs)"
    gone = lambda suffix, pages="expected": f"SELECT e.book, e.page_num FROM {pages} e WHERE NOT EXISTS (SELECT 1 FROM artifacts a WHERE a.book = e.book AND a.page_num = e.page_num AND a.suffix = '{suffix}' AND a.size > 0)"
    renumbered = "SELECT book, page_num::INT AS page_num, (row_number() OVER (PARTITION BY book, page_num ORDER BY idx) - 1)::BIGINT AS idx, type, {} FROM {}"
    hashed = "length(text)::BIGINT AS chars, md5(text) AS digest"
    found = {
        "reflow_documents": f"""WITH given AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), flowed AS (SELECT *, {O.reflow('text')} AS f FROM given)
            SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, len(string_split(f, chr(10) || chr(10)))::BIGINT AS n_paragraphs, length(f)::BIGINT AS chars, md5(f) AS digest FROM flowed""",
        "paragraph_ends_flags": lines_oracle({"ends": O.paragraph_ends("line")}),
        "new_paragraph_flags": lines_oracle({"starts_new": O.new_paragraph("line")}),
        "continuation_flags": lines_oracle({"continues": O.continuation("line")}),
        "heading_flags": lines_oracle({"first": O.first_line("line"), "chapter": O.marker("line"), "back_matter": O.back_matter("line"), "numbered": O.number("line")}),
        "join_wrapped_pairs": f"SELECT pair_id, {O.join_lines('a', 'b')} AS joined, {O.space_joiner('a')} AS spaced FROM ({X.PAIRS})",
        "sections_exploded": f"WITH {O.DOCUMENT_SECTIONS} SELECT book, page_num::INT AS page_num, sec_idx::BIGINT AS idx, type, {hashed} FROM given",
        "prepare_sections": f"WITH {_fixture()}, rows AS (SELECT book, page_num, sec_idx AS idx, type, text FROM given), {O.prepared('rows')} {renumbered.format('text', 'ready')}",
        "page_has_text": f"""WITH {_fixture()} SELECT p.book, p.page_num, count(g.text) FILTER (g.type NOT IN ('header', 'page_number') AND trim(g.text) <> '') > 0 AS has_text,
            count(g.text) FILTER (g.type NOT IN ('header', 'page_number'))::BIGINT AS n_content FROM fixture_pages p LEFT JOIN given g USING (book, page_num) GROUP BY p.book, p.page_num""",
        "prepare_sections_documents": f"WITH {O.DOCUMENT_SECTIONS}, rows AS (SELECT book, page_num, sec_idx AS idx, type, text FROM given), {O.prepared('rows')} {renumbered.format(hashed, 'ready')}",
        "page_has_text_documents": f"""WITH {O.DOCUMENT_SECTIONS} SELECT p.book, p.page_num::INT AS page_num, count(g.text) FILTER (g.type NOT IN ('header', 'page_number') AND trim(g.text) <> '') > 0 AS has_text,
            count(g.text) FILTER (g.type NOT IN ('header', 'page_number'))::BIGINT AS n_content FROM numbered p LEFT JOIN given g USING (book, page_num) GROUP BY p.book, p.page_num""",
        "structure_summary_documents": _documents_oracle(f" {_SUMMARY}"),
        "markdown_render_full_documents": f"SELECT book, length(markdown)::BIGINT AS chars, md5(markdown) AS digest FROM ({_documents_oracle(', ' + O.markdown(False, True))})",
        "merge_within_page": f"WITH {_fixture()}, {O.within()} {renumbered.format('text', 'inside')}",
        "merge_within_page_documents": f"WITH {O.DOCUMENT_SECTIONS}, {O.within()} {renumbered.format(hashed, 'inside')}",
        "merge_cross_page": f"WITH RECURSIVE {_fixture()}, {O.within()}, {O.across()} {renumbered.format('text', 'merged')}",
        "merge_cross_page_documents": f"WITH RECURSIVE {O.DOCUMENT_SECTIONS}, {O.within()}, {O.across()} {renumbered.format(hashed, 'merged')}",
        "merge_cross_page_single_book": f"WITH RECURSIVE {O.SINGLE_BOOK_SECTIONS}, {O.within()}, {O.across()} {renumbered.format(hashed, 'merged')}",
        "chapter_segments": _structure_oracle(" SELECT book, seg::BIGINT AS seg, kind, heading, slug, start_page::INT AS start_page, end_page::INT AS end_page FROM slugged"),
        "block_counts": _structure_oracle(" SELECT book, seg::BIGINT AS seg, kind, block_count::BIGINT AS block_count FROM parts"),
        "page_range": _structure_oracle(" SELECT book, min_by(start_page, seg)::INT AS first_page, max_by(end_page, seg)::INT AS last_page FROM parts GROUP BY book"),
        "structure_summary": _structure_oracle("""
            SELECT book, '{"title":' || to_json(book)::VARCHAR || ',"page_range":[' || min_by(start_page, seg) || ',' || max_by(end_page, seg) || '],"chapters":[' ||
              string_agg('{"heading":' || to_json(heading)::VARCHAR || ',"slug":' || to_json(slug)::VARCHAR || ',"kind":"' || kind || '","start_page":' || start_page || ',"end_page":' || end_page || ',"block_count":' || block_count || '}', ',' ORDER BY seg) || ']}' AS structure
            FROM slugged GROUP BY book"""),
        "document_structure": f"WITH RECURSIVE {O.DOCUMENT_SECTIONS}, {O.within()}, {O.across()} SELECT book, 'front_matter' AS kind, min(page_num)::INT AS start_page, max(page_num)::INT AS end_page, count(*)::BIGINT AS block_count FROM merged GROUP BY book",
        "markdown_render_full": _structure_oracle(", " + O.markdown(False, True)),
        "markdown_render_prose": _structure_oracle(", " + O.markdown(True, False)),
        "markdown_render_raw": _structure_oracle(", " + O.markdown(False, True), "raw"),
        "markdown_without_comments": _structure_oracle(", " + O.markdown(False, False)),
        "combined_text": f"""WITH f AS (SELECT regexp_extract(file_name, '^(.*)_([0-9]+)[.]txt$', 1) AS book, try_cast(regexp_extract(file_name, '^(.*)_([0-9]+)[.]txt$', 2) AS INT) AS n, value FROM ({X.TEXT_FILES}))
            SELECT book, string_agg('=== page ' || n || ' ===' || chr(10) || value, chr(10) || chr(10) ORDER BY n) AS combined FROM f WHERE n IS NOT NULL GROUP BY book""",
        "missing_pages_anti": f"WITH {expected} SELECT book, page_num::INT AS page_num FROM ({gone('.png')})",
        "contiguous_prefix": f"WITH {expected}, g AS (SELECT book, min(page_num) AS gap FROM ({gone('.png')}) GROUP BY book) SELECT j.book, coalesce(gap - start_page, n_pages)::INT AS prefix FROM jobs j LEFT JOIN g USING (book)",
        "artifact_status": f"""WITH {expected}, p AS (SELECT book, count(*) AS n FROM ({gone('.png')}) GROUP BY book), o AS (SELECT book, count(*) AS n FROM ({gone('.ocr.json')}) GROUP BY book)
            SELECT j.book, EXISTS (SELECT 1 FROM artifacts a WHERE a.book = j.book AND suffix = '.png') AS png, p.n IS NULL AS png_complete, coalesce(p.n, 0) AS png_missing,
              EXISTS (SELECT 1 FROM artifacts a WHERE a.book = j.book AND suffix = '.ocr.json') AS ocr, o.n IS NULL AS ocr_complete, coalesce(o.n, 0) AS ocr_missing, has_pdf, has_markdown
            FROM jobs j LEFT JOIN p ON p.book = j.book LEFT JOIN o ON o.book = j.book""",
        "plan_steps": X.values([
            ("img_new", 0, "capture", "Capture page images (PNG)", 3), ("img_part", 0, "capture", "Resume capture (2 missing PNG of 5 pages)", 5), ("img_force", 0, "capture", "Capture page images (PNG)", 3),
            ("img_stuck", 0, "error", "No PNG files and no capture", 3), ("pdf_new", 0, "capture", "Capture page images (PNG) for PDF", 2), ("pdf_new", 1, "build_pdf", "Build PDF → pdf_new.pdf", 2),
            ("pdf_force", 0, "build_pdf", "Build PDF → pdf_force.pdf", 2), ("pdf_stuck", 0, "error", "No PNG files and no capture", 2),
            ("txt_nomd", 0, "assemble", "Assemble Markdown (raw) → txt_nomd.md", 2),
            ("txt_prefix", 0, "ocr_from_png", "Resume OCR (1 missing JSON of 2 pages) from PNG", 2), ("txt_prefix", 1, "assemble", "Assemble Markdown (full) → txt_prefix.md", 2),
            ("txt_pdf", 0, "ocr_from_pdf", "Resume OCR (3 missing JSON of 4 pages) from PDF", 4), ("txt_pdf", 1, "assemble", "Assemble Markdown (full) → txt_pdf.md", 4),
            ("txt_resume", 0, "capture", "Resume capture (2 missing PNG of 3 pages)", 3), ("txt_resume", 1, "ocr_from_png", "OCR from PNG → tmp/*.ocr.json", 3), ("txt_resume", 2, "assemble", "Assemble Markdown (full) → txt_resume.md", 3),
            ("txt_part", 0, "ocr_from_png", "Resume OCR (3 missing JSON of 3 pages) from PNG", 3), ("txt_part", 1, "assemble", "Assemble Markdown (full) → txt_part.md", 3),
            ("txt_new", 0, "capture", "Capture page images (PNG)", 3), ("txt_new", 1, "ocr_from_png", "OCR from PNG → tmp/*.ocr.json", 3), ("txt_new", 2, "assemble", "Assemble Markdown (full) → txt_new.md", 3),
            ("txt_stuck", 0, "error", "No PNG or PDF source for text output", 3),
            ("txt_force", 0, "ocr_from_png", "OCR from existing PNG → tmp/*.ocr.json", 2), ("txt_force", 1, "assemble", "Assemble Markdown (full) → txt_force.md", 2),
        ], "book, step_no, kind, label, n_used"),
        "resume_skip": f"""WITH s AS (SELECT book, phase, page_num, arg_max(status, seq) AS status FROM ({X.STATE}) GROUP BY ALL), v AS (SELECT DISTINCT * FROM ({X.VALID})),
            j AS (SELECT e.*, v.book IS NOT NULL AS valid, s.status FROM ({X.RESUME}) e LEFT JOIN v USING (book, phase, page_num) LEFT JOIN s USING (book, phase, page_num)),
            k AS (SELECT *, resume AND valid AND force_phase <> 'all' AND force_phase <> phase AS skip FROM j)
            SELECT book, phase, page_num, skip, skip AND coalesce(status, '') <> 'done' AS adopted FROM k""",
        "valid_files": f"""SELECT file_id, CASE WHEN suffix = '.ocr.json' THEN CASE WHEN json_valid(content) THEN coalesce(json_type(content) = 'OBJECT' AND json_type(content, '$.sections') = 'ARRAY', false) ELSE false END
            WHEN suffix = '.txt' THEN true ELSE size > 0 END AS valid FROM ({X.FILES})""",
        "last_status": f"SELECT book, phase, page_num, arg_max(status, seq) AS status FROM ({X.STATE}) GROUP BY ALL",
        "repeat_runs_truncate": f"""WITH c AS ({X.CAPTURES}) SELECT book, min(page_num)::INT AS last_page FROM c WHERE EXISTS (SELECT 1 FROM c d WHERE d.book = c.book AND d.page_num = c.page_num + 1 AND d.digest = c.digest)
            AND EXISTS (SELECT 1 FROM c d WHERE d.book = c.book AND d.page_num = c.page_num + 2 AND d.digest = c.digest) GROUP BY book""",
        "repeat_runs_documents": """WITH c AS (SELECT source || '/' || (doc_id // 500) AS book, row_number() OVER (PARTITION BY source || '/' || (doc_id // 500) ORDER BY doc_id) AS page_num, coalesce(text, '') AS x FROM documents),
            e AS (SELECT c.book, min(c.page_num)::INT AS last_page FROM c JOIN c d ON d.book = c.book AND d.page_num = c.page_num + 1 AND d.x = c.x JOIN c e ON e.book = c.book AND e.page_num = c.page_num + 2 AND e.x = c.x GROUP BY c.book)
            SELECT book, count(*)::BIGINT AS n_pages, any_value(last_page)::INT AS last_page FROM c LEFT JOIN e USING (book) GROUP BY book""",
        "assembly_counts": _structure_oracle(""", loaded AS (SELECT book, count(*) AS n FROM fixture_pages GROUP BY book)
            SELECT l.book, any_value(n)::BIGINT AS n_loaded, count(p.seg)::BIGINT AS n_chapters, min_by(start_page, seg)::INT AS first_page, max_by(end_page, seg)::INT AS last_page FROM loaded l LEFT JOIN parts p USING (book) GROUP BY l.book"""),
        "assembly_counts_documents": _documents_oracle(""", loaded AS (SELECT book, count(*) AS n FROM numbered GROUP BY book)
            SELECT l.book, any_value(n)::BIGINT AS n_loaded, count(p.seg)::BIGINT AS n_chapters, min_by(start_page, seg)::INT AS first_page, max_by(end_page, seg)::INT AS last_page FROM loaded l LEFT JOIN parts p USING (book) GROUP BY l.book"""),
        "can_screen_capture": f"SELECT config, CASE capture_mode WHEN 'manual' THEN least(rect_width, rect_height) >= 1 ELSE length(trim(window_title)) > 0 END AS can_capture FROM ({X.RULES})",
        "pdf_source": f"""WITH j AS ({X.PDF_JOBS}), f AS ({X.PDF_FILES}) SELECT book, CASE WHEN trim(coalesce(input_pdf, '')) <> '' AND trim(input_pdf) IN (SELECT path FROM f) THEN trim(input_pdf)
            WHEN book_pdf IN (SELECT path FROM f) THEN book_pdf END AS pdf FROM j""",
        "config_resolved": X.values([("empty", "kindle_app", 3, "right", 2.0, "screen_left_third", 0, 0, 0.035, 0.0), ("flat", "", 7, "space", 1.0, "manual", 1, 4, 0.1, 0.0),
            ("nested", "", 1, "pagedown", 0.25, "manual", 0, 0, 0.0, 0.2)], "config, reader_profile, n_pages, next_key, delay_sec, capture_mode, rect_left, rect_height, trim_top, trim_bottom"),
        "job_facts": f"""WITH s AS (SELECT book, CASE WHEN json_valid(value) THEN value END::JSON AS j FROM ({X.STATE_FILES}))
            SELECT book, (j->>'$.start_page')::INT AS start_page, (j->>'$.n_pages')::INT AS n_pages, (j->>'$.end_of_book_last_page')::INT AS last_page, j->>'$.outputs.final_pdf' AS final_pdf,
              j->>'$.outputs.combined_txt' AS combined_txt, coalesce(json_array_length(j, '$.errors'), 0)::INT AS n_errors FROM s""",
        "job_errors": X.values([("kept", 0, "ocr", 4, "no reply"), ("kept", 1, "ocr", 5, "again")], "book, ord, phase, page_num, error"),
        "page_marks": X.values([("kept", "capture", 3, "done", "/t/3.png", None), ("kept", "capture", None, "done", None, None), ("kept", "ocr", 4, "failed", None, "no reply")], "book, phase, page_num, status, path, error"),
        "pages_to_run_debug": f"SELECT book, least(4, CASE WHEN book = 'img_new' THEN 2 ELSE n_pages END)::INT AS n_run FROM ({X.JOBS})",
        "kept_captures": f"""WITH c AS ({X.CAPTURES}), ends AS (SELECT 'aaa' AS book, 1 AS last_page UNION ALL SELECT 'aabbb', 3 UNION ALL SELECT 'late', 5)
            SELECT c.* FROM c LEFT JOIN ends USING (book) WHERE last_page IS NULL OR page_num <= last_page""",
        "pages_to_run": f"SELECT book, CASE WHEN book = 'img_new' THEN 2 ELSE n_pages END::INT AS n_run FROM ({X.JOBS})",
        "job_progress": f"SELECT book, least(99, count(*) FILTER (starts_with(message, 'IMAGE_OK')))::INT AS percent FROM ({X.EVENTS}) GROUP BY book",
        "profile_overlay": f"""SELECT reader_profile, config, coalesce(p.capture_mode, c.capture_mode) AS capture_mode, coalesce(p.delay_sec, c.delay_sec) AS delay_sec,
            CASE WHEN p.reader_focus_clicks IS NULL THEN c.reader_focus_clicks ELSE least(greatest(p.reader_focus_clicks, 0), 5) END::INT AS reader_focus_clicks,
            CASE WHEN p.reader_focus_x_ratio IS NULL THEN c.reader_focus_x_ratio ELSE least(greatest(p.reader_focus_x_ratio, 0), 1) END AS reader_focus_x_ratio, coalesce(p.next_key, c.next_key) AS next_key
            FROM ({X.CONFIGS}) c LEFT JOIN ({X.PROFILES}) p ON c.reader_profile = p.name""",
        "profile_catalogue": f"""WITH b AS ({X.BUILTIN}), f AS ({X.FROM_FILE}), a AS (SELECT 0 AS pr, * FROM b UNION ALL SELECT 1, * FROM f),
            n AS (SELECT name, min(pr * 1000 + ord) AS place, arg_max({{'k': next_key, 'd': delay_sec}}, pr * 1000 + ord) AS v FROM a GROUP BY name)
            SELECT name, v.k AS next_key, v.d AS delay_sec, row_number() OVER (ORDER BY place)::INT AS position FROM n""",
        "config_fields": f"""WITH c AS (SELECT config, value::JSON AS j FROM ({X.CONFIG_FILES}))
            SELECT config, coalesce((j->>'n_pages')::INT, 1) AS n_pages, coalesce(j->>'next_key', 'pagedown') AS next_key, coalesce((j->>'delay_sec')::DOUBLE, 1) AS delay_sec, coalesce((j->>'resume')::BOOLEAN, true) AS resume,
              coalesce(j->>'output_mode', 'pdf') AS output_mode, 2 AS stop_repeat_pages, coalesce((j->'rect'->>'left')::INT, 0) AS rect_left, coalesce((j->'rect'->>'width')::INT, 0) AS rect_width,
              CASE WHEN json_exists(j, '$.pdf_trim') THEN coalesce((j->'pdf_trim'->>'top')::DOUBLE, 0) ELSE coalesce((j->>'pdf_trim_top')::DOUBLE, 0) END AS trim_top,
              CASE WHEN json_exists(j, '$.pdf_trim') THEN coalesce((j->'pdf_trim'->>'bottom')::DOUBLE, 0) ELSE coalesce((j->>'pdf_trim_bottom')::DOUBLE, 0) END AS trim_bottom FROM c""",
        "builtin_profile_overlay": X.values([("empty", "none", 1.0, "pagedown", 2, 0.0, 0.0, ""), ("flat", "kindle_app", 2.0, "right", 0, 0.035, 0.0, "Kindle"), ("nested", "none", 2.5, "pagedown", 2, 0.0, 0.2, "")],
            "config, reader_profile, delay_sec, next_key, reader_focus_clicks, trim_top, trim_bottom, target_window_title"),
        "config_precedence": f"SELECT layer_id, coalesce(cli, profile, file, 'default') AS value FROM ({X.LAYERS})",
        "config_violations": X.values([
            ("ok", ""), ("skip", ""),
            ("bad", "capture_mode,n_pages,start_page,assemble_style,window_title,window_capture_backend,base_dir,force_phase,reader_focus_clicks,start_focus_clicks,start_focus_x_ratio,start_focus_y_ratio,settle_sec,trim_left,key_delivery"),
            ("pdf", "pages beyond pdf,trim height"), ("past", "start_page beyond pdf,pages beyond pdf"), ("rect", "rect"), ("title", "n_pages,window_title")], "config, violations"),
        "enum_normalized": f"SELECT mode_id, coalesce(nullif(lower(trim(mode)), ''), 'pdf') AS mode FROM ({X.MODES})",
        "rect_thirds": f"""SELECT rect_id, CASE WHEN capture_mode = 'window_right_third' THEN x + 2 * greatest(1, width // 3) ELSE x END::INT AS rect_left, y AS rect_top,
            CASE capture_mode WHEN 'window_left_third' THEN greatest(1, width // 3) WHEN 'window_right_third' THEN greatest(1, width - 2 * greatest(1, width // 3)) ELSE width END::INT AS rect_width, height AS rect_height FROM ({X.RECTS})""",
        "trim_geometry": f"""WITH i AS ({X.IMAGES}), b AS (SELECT *, round_even(width * trim_left, 0)::INT AS l, round_even(height * trim_top, 0)::INT AS t, (width - round_even(width * trim_right, 0))::INT AS r, (height - round_even(height * trim_bottom, 0))::INT AS m,
              CASE WHEN coalesce(dpi, 0) <= 1 THEN 72.0::DOUBLE ELSE dpi END AS q FROM i)
            SELECT image, l AS crop_left, t AS crop_top, r AS crop_right, m AS crop_bottom, r - l >= 2 AND m - t >= 2 AS enough, least(m, t + round_even(height * trim_fill_top, 0)::INT)::INT AS top_band_end,
              greatest(t, m - round_even(height * trim_fill_bottom, 0)::INT)::INT AS bottom_band_start, round((r - l) * 72.0::DOUBLE / q, 6) AS width_pt, round((m - t) * 72.0::DOUBLE / q, 6) AS height_pt FROM b""",
        "histogram_means": f"SELECT image, sum(level * count)::DOUBLE / sum(count) AS mean_diff FROM ({X.LEVELS}) GROUP BY image",
        "mostly_black": f"SELECT image, (r + g + b) / 3 < 14 AS black FROM ({X.SHADES})",
        "pick_window": f"SELECT query, arg_min(hwnd, CASE WHEN foreground THEN 0 WHEN title = query THEN 100 ELSE 200 END + ord)::INT AS hwnd FROM ({X.WINDOWS}) WHERE contains(lower(title), lower(query)) GROUP BY query",
        "window_titles": f"SELECT DISTINCT title FROM ({X.WINDOWS}) WHERE lower(title) LIKE '%web%'",
        "largest_child": f"SELECT parent, arg_max(hwnd, width * height * 1000 - ord)::INT AS hwnd FROM ({X.CHILDREN}) GROUP BY parent",
        "language_lookup": f"SELECT n.lang, (SELECT arg_min(code, ord) FROM ({X.LANGUAGES}) l WHERE l.lang = n.lang) AS code FROM ({X.NAMES}) n",
        "prompt_resolved": f"""SELECT prompt_id, replace(replace(CASE WHEN trim(coalesce(inline, '')) <> '' THEN trim(inline) WHEN trim(prompt_file) = '' THEN coalesce(bundled, {T.literal(P.FALLBACK_PROMPT)})
            ELSE coalesce(file_text, {T.literal(P.FALLBACK_PROMPT)}) END, '{{lang_hint}}', lang_hint), '{{page_num}}', page_num::VARCHAR) AS prompt FROM ({X.PROMPTS}) JOIN ({X.PROMPT_FILES}) USING (prompt_id)""",
        "page_names": f"WITH {expected} SELECT book, page_num::INT AS page_num, book || '_' || lpad(page_num::VARCHAR, 4, '0') || '.ocr.json' AS file_name FROM expected",
    }
    found["markdown_files_documents"] = found["markdown_render_full_documents"]
    found["page_files_documents"] = f"""WITH {O.DOCUMENT_SECTIONS} SELECT n.book, n.page_num::INT AS page_num, count(g.text)::BIGINT AS n_sections, coalesce(sum(length(g.text)), 0)::BIGINT AS chars
        FROM numbered n LEFT JOIN given g USING (book, page_num) GROUP BY n.book, n.page_num"""
    found["settled_events"] = """WITH e AS (SELECT DISTINCT ON (event_id, user_id) user_id::VARCHAR AS key, event_id, ts, event_type FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL),
        g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
        r AS (SELECT *, sum(begins) OVER (PARTITION BY key ORDER BY ts, event_id) AS run FROM g)
        SELECT key, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, arg_max(event_type, (ts, event_id)) AS status, count(*)::BIGINT AS n_marks FROM r GROUP BY key, run"""
    found["repeat_runs_languages"] = """WITH c AS (SELECT source || '/' || (doc_id // 500) AS book, row_number() OVER (PARTITION BY source || '/' || (doc_id // 500) ORDER BY doc_id) AS page_num, lang FROM documents)
        SELECT c.book, min(c.page_num)::INT AS last_page FROM c JOIN c d ON d.book = c.book AND d.page_num = c.page_num + 1 AND d.lang = c.lang JOIN c e ON e.book = c.book AND e.page_num = c.page_num + 2 AND e.lang = c.lang GROUP BY c.book"""
    found["repeat_runs_stream"] = found["repeat_runs_languages"]
    found["title_matches_documents"] = """WITH n AS (SELECT DISTINCT lower(w) AS needle FROM (SELECT p_name AS w FROM part UNION ALL SELECT unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) FROM benchmark) WHERE w <> ''),
        d AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS x FROM documents) SELECT doc_id, needle FROM d JOIN n ON contains(x, needle)"""
    slug = "coalesce(nullif(trim(regexp_replace(regexp_replace(nfc_normalize(lower({})), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-'), ''), 'section')"
    found["slugs_documents"] = "SELECT doc_id, " + slug.format(O.first_line("coalesce(text, '')")) + " AS slug FROM documents"
    chaptered_rows = f"WITH RECURSIVE {O.CHAPTERED_SECTIONS}, {O.within()}, {O.across()}, listed AS (SELECT DISTINCT book, page_num FROM merged), {O.prepared('merged')}, {O.structure('merged')}"
    raw_rows = f"WITH RECURSIVE {O.CHAPTERED_SECTIONS}, merged AS (SELECT book, page_num, sec_idx AS idx, type, text FROM given), listed AS (SELECT book, page_num FROM numbered), {O.prepared('merged')}, {O.structure('merged')}"
    found["prepare_sections_chaptered"] = f"WITH {O.CHAPTERED_SECTIONS}, rows AS (SELECT book, page_num, sec_idx AS idx, type, text FROM given), {O.prepared('rows')} {renumbered.format(hashed, 'ready')}"
    found["chapter_segments_chaptered"] = chaptered_rows + " SELECT book, seg::BIGINT AS seg, kind, heading, slug, start_page::INT AS start_page, end_page::INT AS end_page FROM slugged"
    found["block_counts_chaptered"] = chaptered_rows + " SELECT book, seg::BIGINT AS seg, kind, block_count::BIGINT AS block_count FROM parts"
    found["page_range_chaptered"] = chaptered_rows + " SELECT book, min_by(start_page, seg)::INT AS first_page, max_by(end_page, seg)::INT AS last_page FROM parts GROUP BY book"
    found["structure_summary_chaptered"] = f"{chaptered_rows} {_SUMMARY}"
    found["assembly_counts_chaptered"] = chaptered_rows + """, loaded AS (SELECT book, count(*) AS n FROM numbered GROUP BY book)
        SELECT l.book, any_value(n)::BIGINT AS n_loaded, count(p.seg)::BIGINT AS n_chapters, min_by(start_page, seg)::INT AS first_page, max_by(end_page, seg)::INT AS last_page FROM loaded l LEFT JOIN parts p USING (book) GROUP BY l.book"""
    for style, rows, body_only, comments in (("full", chaptered_rows, False, True), ("prose", chaptered_rows, True, False), ("raw", raw_rows, False, True)):
        found[f"markdown_{style}_chaptered"] = f"SELECT book, length(markdown)::BIGINT AS chars, md5(markdown) AS digest FROM ({rows}, {O.markdown(body_only, comments)})"
    found["pdf_documents"] = """SELECT source || '/' || (doc_id // 500) AS book, (row_number() OVER (PARTITION BY source || '/' || (doc_id // 500) ORDER BY doc_id) - 1)::INT AS page_index,
        md5(coalesce(text, '')) || repeat('0', 16) AS pixels FROM documents"""
    found["comments_stripped_pages"] = r"""WITH t AS (SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '"(?:[^"\\]|\\(?s:.))*(?:"|\\?\z)|//[^\n]*|/\*(?s:.*?)(?:\*/|\z)|[^"/]+|/'), lambda t:
        CASE WHEN starts_with(t, '//') OR starts_with(t, '/*') THEN coalesce(nullif(repeat(chr(10), length(t) - length(replace(t, chr(10), ''))), ''), ' ') ELSE t END), '') AS x FROM pages)
        SELECT page_id, md5(x) AS digest, length(x)::BIGINT AS chars FROM t"""
    of_documents = """p AS (SELECT source || '/' || (doc_id // 500) AS book, row_number() OVER (PARTITION BY source || '/' || (doc_id // 500) ORDER BY doc_id)::INT AS page_num,
        coalesce(length(text) - length(replace(text, '.', '')), 0) AS png, coalesce(length(text) - length(replace(text, ',', '')), 0) AS ocr FROM documents)"""
    found["missing_pages_documents"] = f"WITH {of_documents} SELECT book, page_num FROM p WHERE png = 0"
    found["contiguous_prefix_documents"] = f"WITH {of_documents} SELECT book, coalesce(min(page_num) FILTER (png = 0) - 1, max(page_num))::INT AS prefix FROM p GROUP BY book"
    found["artifact_status_documents"] = f"""WITH {of_documents} SELECT book, true AS png, count(*) FILTER (png = 0) = 0 AS png_complete, count(*) FILTER (png = 0)::BIGINT AS png_missing,
        coalesce(min(page_num) FILTER (png = 0) - 1, max(page_num))::INT AS png_prefix, true AS ocr, count(*) FILTER (ocr = 0) = 0 AS ocr_complete, count(*) FILTER (ocr = 0)::BIGINT AS ocr_missing FROM p GROUP BY book"""
    found["resume_documents"] = f"""WITH {of_documents}, s AS (SELECT user_id AS page_num, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id)
        SELECT p.book, 'ocr' AS phase, p.page_num, ocr > 0 AS skip, ocr > 0 AND NOT coalesce(p.book = 'src0/0' AND s.last = 'click', false) AS adopted FROM p LEFT JOIN s ON s.page_num = p.page_num"""
    found["last_status_events"] = "SELECT user_id AS book, 'capture' AS phase, event_id % 10 AS page_num, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY ALL"
    steps = found["plan_steps"]
    found["plan_phases"] = f"SELECT book, bool_or(kind = 'capture') AS run_capture, bool_or(kind LIKE 'ocr%') AS run_ocr, bool_or(kind = 'build_pdf') AS run_pdf, bool_or(kind = 'assemble') AS run_assemble FROM ({steps}) GROUP BY book"
    array = "coalesce(json_extract(j, '$.{}[*]'), []::JSON[])"
    clean = lambda v: f"trim(coalesce(CASE WHEN json_type({v}) = 'NULL' THEN NULL ELSE json_extract_string({v}, '$') END, ''), chr(32) || chr(10) || chr(9))"
    field = lambda v, name: clean(f"json_extract({v}, '$.{name}')")
    kind = lambda v: f"coalesce(nullif(lower({field(v, 'type')}), ''), 'body')"
    known = lambda v: f"CASE WHEN {kind(v)} IN {sanitize.SECTION_TYPES} THEN {kind(v)} ELSE 'other' END"
    taken = lambda type_of: f"list_filter(list_transform(list_filter({array.format('sections')}, lambda v: json_type(v) = 'OBJECT'), lambda v: {{'t': {type_of('v')}, 'x': {field('v', 'text')}}}), lambda s: s.x <> '')"
    parsed = rf"""WITH r AS ({X.REPLIES}), c AS (SELECT *, regexp_replace(regexp_replace(trim(reply), '(?i)^```(json)?\s*', ''), '\s*```$', '') AS b FROM r),
        o AS (SELECT *, coalesce(CASE WHEN json_valid(b) THEN b END, CASE WHEN json_valid(regexp_extract(b, '(?s)\{{.*\}}')) THEN regexp_extract(b, '(?s)\{{.*\}}') END)::JSON AS j0 FROM c),
        p AS (SELECT *, CASE WHEN json_type(j0) = 'OBJECT' THEN j0 END AS j FROM o)"""
    found["fenced_json"] = f"{parsed} SELECT reply_id, j IS NOT NULL AS ok FROM p"
    found["load_sections"] = f"""WITH r AS ({X.REPLIES}), p AS (SELECT reply_id, reply::JSON AS j FROM (SELECT * FROM r WHERE json_valid(reply))),
        s AS (SELECT reply_id, {taken(kind)} AS s FROM p WHERE json_type(j) = 'OBJECT')
        SELECT reply_id, coalesce(array_to_string(list_transform(s, lambda e: e.t || '=' || e.x), '|'), '') AS sections FROM s"""
    spare = lambda name: f"list_filter(list_transform(list_filter({array.format(name)}, lambda v: json_type(v) IN ('OBJECT', 'VARCHAR')), lambda v: CASE WHEN json_type(v) = 'VARCHAR' THEN {{'t': 'body', 'x': {clean('v')}}} ELSE {{'t': {known('v')}, 'x': coalesce(nullif({field('v', 'text')}, ''), {field('v', 'content')})}} END), lambda s: s.x <> '')"
    found["sanitize_pages"] = f"""{parsed}, s AS (SELECT *, {field('j', 'text')} AS whole, {taken(known)} AS own, list_concat(list_concat({spare('blocks')}, {spare('content')}), {spare('paragraphs')}) AS rest, json_type(j, '$.page') AS kind, json_extract_string(j, '$.page') AS label FROM p),
        f AS (SELECT *, CASE WHEN j IS NULL THEN own[1:0] WHEN len(own) > 0 THEN own WHEN whole <> '' THEN [{{'t': 'body', 'x': whole}}] ELSE rest END AS secs FROM s)
        SELECT reply_id, coalesce(CASE WHEN kind IN ('BIGINT', 'UBIGINT', 'VARCHAR') THEN CASE WHEN try_cast(label AS INT) > 0 THEN try_cast(label AS INT) END WHEN kind = 'DOUBLE' THEN CASE WHEN label::DOUBLE > 0 THEN floor(label::DOUBLE) END END, page_num)::INT AS page,
          CASE WHEN whole <> '' THEN whole ELSE coalesce(array_to_string(list_transform(secs, lambda e: '[' || upper(e.t) || ']' || chr(10) || e.x), chr(10) || chr(10)), '') END AS text,
          len(secs)::INT AS n_sections, coalesce(array_to_string(list_transform(secs, lambda e: e.t || '=' || e.x), '|'), '') AS sections, j IS NOT NULL AS ok FROM f"""
    return found
