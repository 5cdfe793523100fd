"""Job planning and resume state as tables: expected and present pages, steps, repeats, last status.

jobs (book, start_page, n_pages, output_mode, force_phase, style, can_capture, manual, pdf_pages, has_pdf, has_markdown)
artifacts (book, page_num, suffix, size), state (book, phase, page_num, status, seq), captures (book, page_num, digest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagewright.operators.settings import can_screen_capture


def expected_pages(jobs: DataFrame) -> DataFrame:
    """(book, page_num) of start_page .. start_page + n_pages - 1."""
    return jobs.where("n_pages >= 1").select("book", F.explode(F.expr("sequence(start_page, start_page + n_pages - 1)")).alias("page_num"))


def present(artifacts: DataFrame, suffix: str) -> DataFrame:
    """Pages with a non-empty file; emptiness is the only thing looked at when planning."""
    return artifacts.where((F.col("suffix") == suffix) & (F.col("size") > 0)).select("book", "page_num").distinct()


def missing_pages(jobs: DataFrame, artifacts: DataFrame, suffix: str) -> DataFrame:
    return expected_pages(jobs).join(present(artifacts, suffix), ["book", "page_num"], "left_anti")


def contiguous_prefix(jobs: DataFrame, artifacts: DataFrame, suffix: str) -> DataFrame:
    """(book, prefix): pages from the first one on without a gap."""
    gap = missing_pages(jobs, artifacts, suffix).groupBy("book").agg(F.min("page_num").alias("gap"))
    return jobs.join(gap, "book", "left").select("book", F.coalesce(F.col("gap") - F.col("start_page"), "n_pages").cast("int").alias("prefix"))


def artifact_status(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row a job: any and complete for images and OCR, missing counts, prefix, and the finished files."""
    status = jobs
    for suffix, name in ((".png", "png"), (".ocr.json", "ocr")):
        some = artifacts.where(F.col("suffix") == suffix).groupBy("book").agg(F.lit(True).alias(name))
        gone = missing_pages(jobs, artifacts, suffix).groupBy("book").agg(F.count(F.lit(1)).alias(f"{name}_missing"), F.min("page_num").alias(f"{name}_gap"))
        status = status.join(some, "book", "left").join(gone, "book", "left").withColumn(name, F.coalesce(name, F.lit(False)))
        status = status.withColumn(f"{name}_missing", F.coalesce(f"{name}_missing", F.lit(0)))
        status = status.withColumn(f"{name}_complete", F.col(f"{name}_missing") == 0)
    return status.withColumn("png_prefix", F.coalesce(F.col("png_gap") - F.col("start_page"), "n_pages").cast("int")).drop("png_gap", "ocr_gap")


def forced(phase: str):
    return F.col("force_phase").isin("all", phase)


def text_range(status: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Source and page count of text jobs: whole images, a gapless prefix of them, the PDF, or more captures.

    The chosen count clamps the job before missing OCR is counted.
    """
    capturable = F.col("can_capture") | ~F.col("manual")
    pdf_left = F.greatest(F.lit(0), F.col("pdf_pages") - F.col("start_page") + 1)
    clamp = lambda n: F.when((n < 1) | (n >= F.col("n_pages")), F.col("n_pages")).otherwise(n)
    source = (F.when(F.col("png_complete") | (F.col("png_prefix") >= 1), "png").when(F.col("has_pdf"), "pdf")
              .when(F.col("png") & capturable, "png_resume").when(F.col("png"), "png"))
    ranged = status.withColumn("source", source).withColumn("n_used", F.when(F.col("png_complete"), F.col("n_pages"))
                                                            .when(F.col("png_prefix") >= 1, clamp(F.col("png_prefix")))
                                                            .when(F.col("has_pdf"), clamp(pdf_left)).otherwise(F.col("n_pages")))
    narrowed = ranged.select("book", "start_page", F.col("n_used").alias("n_pages"))
    gone = missing_pages(narrowed, artifacts, ".ocr.json").groupBy("book").agg(F.count(F.lit(1)).alias("left"))
    return ranged.join(gone, "book", "left").withColumn("ocr_left", F.coalesce("left", F.lit(0))).drop("left")


def plan_steps(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(book, step_no, kind, label, n_used); kind 'error' where a job has no source."""
    status = text_range(artifact_status(jobs, artifacts), artifacts)
    capturable = F.col("can_capture") | ~F.col("manual")
    need_images = ~F.col("png_complete") | forced("capture")
    resume = F.format_string("Resume capture (%d missing PNG of %d pages)", F.col("png_missing"), F.col("n_pages"))
    partial = F.col("png") & (F.col("png_missing") > 0) & ~forced("capture")
    step = lambda when, kind, label: F.when(when, F.struct(F.lit(kind).alias("kind"), label.alias("label")))
    mode = F.col("output_mode")
    capture = lambda m, tail: step((mode == m) & need_images & capturable, "capture",
                                   F.when(partial, F.concat(resume, F.lit(tail))).otherwise(F.lit("Capture page images (PNG)" + tail)))
    stuck = lambda m: step((mode == m) & need_images & ~capturable & ~F.col("png"), "error", F.lit("No PNG files and no capture"))
    build = step((mode == "pdf") & (~F.col("has_pdf") | forced("pdf") | need_images) & (capturable | F.col("png") | ~need_images), "build_pdf",
                 F.concat(F.lit("Build PDF → "), "book", F.lit(".pdf")))
    need_ocr = (F.col("ocr_left") > 0) | forced("ocr")
    more = F.col("ocr") & (F.col("ocr_left") > 0) & ~forced("ocr")
    left = lambda of: F.format_string("Resume OCR (%d missing JSON of %d pages) from " + of, F.col("ocr_left"), F.col("n_used"))
    text = (mode == "text") & need_ocr
    steps = F.array_compact(F.array(
        capture("images", ""), stuck("images"), capture("pdf", " for PDF"), stuck("pdf"), build,
        step(text & (F.col("source") == "png_resume"), "capture", resume),
        step(text & F.col("source").isNull() & capturable, "capture", F.lit("Capture page images (PNG)")),
        step(text & ((F.col("source") == "png_resume") | (F.col("source").isNull() & capturable)), "ocr_from_png", F.lit("OCR from PNG → tmp/*.ocr.json")),
        step(text & (F.col("source") == "png"), "ocr_from_png", F.when(more, left("PNG")).otherwise(F.lit("OCR from existing PNG → tmp/*.ocr.json"))),
        step(text & (F.col("source") == "pdf"), "ocr_from_pdf", F.when(more, left("PDF")).otherwise(F.lit("OCR from PDF → tmp/*.ocr.json"))),
        step(text & F.col("source").isNull() & ~capturable, "error", F.lit("No PNG or PDF source for text output")),
        step((mode == "text") & (need_ocr | ~F.col("has_markdown")) & ~(need_ocr & F.col("source").isNull() & ~capturable), "assemble",
             F.concat(F.lit("Assemble Markdown ("), "style", F.lit(") → "), "book", F.lit(".md")))))
    used = F.when(mode == "text", F.col("n_used")).otherwise(F.col("n_pages"))
    return status.select("book", used.cast("int").alias("n_used"), F.posexplode(steps).alias("step_no", "s")).select(
        "book", F.col("step_no").cast("int").alias("step_no"), "s.kind", "s.label", "n_used")


def planned_jobs(configs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs for plan_steps from settled configs (with book, book_pdf and book_markdown) and the files (path, pages) that exist.

    What can be captured follows from the config; a text job's PDF is its input or the
    book's own, with its pages as counted (``pages``, null for what is no PDF).
    """
    there = files.groupBy("path").agg(F.max("pages").alias("pages"))
    own = lambda column, name: there.select(F.col("path").alias(column), F.lit(True).alias(name))
    source = pdf_source(configs, files).withColumnRenamed("pdf", "path").join(there, "path", "left").select("book", F.col("path").alias("source_pdf"), "pages")
    found = configs.join(source, "book", "left").join(own("book_pdf", "own_pdf"), "book_pdf", "left").join(own("book_markdown", "own_markdown"), "book_markdown", "left")
    text = F.col("output_mode") == "text"
    return found.select(
        "book", "start_page", "n_pages", "output_mode", "force_phase", F.col("assemble_style").alias("style"), F.coalesce(can_screen_capture(), F.lit(False)).alias("can_capture"),
        (F.col("capture_mode") == "manual").alias("manual"), F.coalesce(F.when(text, F.col("pages")), F.lit(0)).alias("pdf_pages"),
        F.when(text, F.col("source_pdf").isNotNull()).otherwise(F.coalesce("own_pdf", F.lit(False))).alias("has_pdf"), F.coalesce("own_markdown", F.lit(False)).alias("has_markdown"))


def phases(steps: DataFrame) -> DataFrame:
    """(book, run_capture, run_ocr, run_pdf, run_assemble) from the kinds of its steps."""
    kinds = steps.groupBy("book").agg(F.collect_set("kind").alias("kinds"))
    some = lambda *k: F.arrays_overlap("kinds", F.array(*map(F.lit, k)))
    return kinds.select("book", some("capture").alias("run_capture"), some("ocr_from_png", "ocr_from_pdf").alias("run_ocr"),
                        some("build_pdf").alias("run_pdf"), some("assemble").alias("run_assemble"))


def last_status(state: DataFrame) -> DataFrame:
    """(book, phase, page_num, status) of the latest event; state is an append-only table."""
    return state.groupBy("book", "phase", "page_num").agg(F.max_by("status", "seq").alias("status"))


def resume(expected: DataFrame, valid: DataFrame, state: DataFrame) -> DataFrame:
    """(book, phase, page_num, skip, adopted): a valid artifact is skipped unless its phase is forced.

    ``expected`` (book, phase, page_num, resume, force_phase), ``valid`` (book, phase, page_num).
    State alone never lets a page be skipped; a valid artifact without it is adopted as done.
    """
    found = valid.select("book", "phase", "page_num", F.lit(True).alias("valid")).distinct()
    joined = expected.join(found, ["book", "phase", "page_num"], "left").join(last_status(state), ["book", "phase", "page_num"], "left")
    skip = F.col("resume") & F.coalesce("valid", F.lit(False)) & ~F.col("force_phase").isin("all") & (F.col("force_phase") != F.col("phase"))
    return joined.select("book", "phase", "page_num", skip.alias("skip"), (skip & (F.coalesce("status", F.lit("")) != "done")).alias("adopted"))


def truncate_repeats(captures: DataFrame, stop: int = 2) -> DataFrame:
    """(book, last_page) where a digest repeats ``stop`` times in a row; the first of the run is the last page.

    A null digest (a skipped page) ends a run; 0 turns it off.
    """
    order = Window.partitionBy("book").orderBy("page_num")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.when(F.col("digest").isNotNull() & (F.col("digest") == F.lag("digest").over(order)), 0).otherwise(1)
    runs = (captures.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(upto)).groupBy("book", "run")
            .agg(F.min("page_num").alias("run_start"), F.count(F.lit(1)).alias("length")))
    return runs.where((F.lit(stop) > 0) & (F.col("length") > stop)).groupBy("book").agg(F.min("run_start").alias("last_page"))


def kept_captures(captures: DataFrame, stop: int = 2) -> DataFrame:
    """Captures up to the last page of their book."""
    ends = truncate_repeats(captures, stop)
    return captures.join(ends, "book", "left").where(F.col("last_page").isNull() | (F.col("page_num") <= F.col("last_page"))).drop("last_page")


def pages_to_run(jobs: DataFrame, ends: DataFrame, debug_most: int | None = None) -> DataFrame:
    """(book, n_run): the job's pages, at most those to a stored last page, and few when debugging."""
    found = jobs.join(ends.select("book", "last_page"), "book", "left")
    n = F.least("n_pages", F.coalesce(F.col("last_page") - F.col("start_page") + 1, "n_pages"))
    return found.select("book", (n if debug_most is None else F.least(n, F.lit(max(1, debug_most)))).cast("int").alias("n_run"))


def valid_files(files: DataFrame) -> DataFrame:
    """(.., valid) of (suffix, size, content) rows for all but images, which ``images.png_valid`` decodes.

    OCR JSON must be an object with a list of sections; page text need only be there;
    a PDF must have bytes.
    """
    page = "try_parse_json(content)"
    listed = f"coalesce(schema_of_variant({page}) LIKE 'OBJECT%', false) AND coalesce(schema_of_variant(try_variant_get({page}, '$.sections', 'variant')) LIKE 'ARRAY%', false)"
    return files.withColumn("valid", F.expr(f"""CASE WHEN suffix = '.ocr.json' THEN {listed}
        WHEN suffix = '.txt' THEN size >= 0 ELSE size > 0 END"""))


def progress(events: DataFrame) -> DataFrame:
    """(book, percent): one for each page that is done, 99 at most until the job ends."""
    return events.groupBy("book").agg(F.least(F.lit(99), F.sum(F.col("message").startswith("IMAGE_OK").cast("int"))).cast("int").alias("percent"))


def pdf_source(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(book, pdf): the job's input PDF (input_pdf, blank or null for none) if that file exists, else the book's own (book_pdf), else null.

    ``files`` (path) lists the files that exist.
    """
    there = lambda column: files.select(F.col("path").alias(column), F.lit(True).alias(f"{column}_there")).distinct()
    asked = jobs.withColumn("input_pdf", F.nullif(F.trim("input_pdf"), F.lit("")))
    found = asked.join(there("input_pdf"), "input_pdf", "left").join(there("book_pdf"), "book_pdf", "left")
    return found.select("book", F.coalesce(F.when(F.col("input_pdf_there"), F.col("input_pdf")), F.when(F.col("book_pdf_there"), F.col("book_pdf"))).alias("pdf"))
