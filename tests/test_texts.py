"""Comments, foldings and normal forms against Python, and configs that become jobs."""

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import unicode as U
from pagewright.operators import planning, settings
from pagewright.sources.pages import parsed_jsonc


def lexed(text: str) -> str:
    """Without comments, character by character."""
    out, i, state, breaks = [], 0, "", 0
    while i < len(text):
        c, two = text[i], text[i:i + 2]
        if state == "string":
            out.append(two if c == "\\" else c)
            i += 2 if c == "\\" else 1
            state = "" if c == '"' else state
        elif state:
            ended = two == "*/" if state == "/*" else c == "\n"
            if ended or i == len(text):
                out.append("\n" * breaks or " ")
                i, state = (i + 2, "") if state == "/*" else (i, "")
            else:
                breaks += c == "\n"
                i += 1
        elif two in ("//", "/*"):
            state, breaks, i = two, 0, i + 2
        else:
            out.append(c)
            state = "string" if c == '"' else ""
            i += 1
    return "".join(out) + (("\n" * breaks or " ") if state in ("//", "/*") else "")


def test_comments_against_a_plain_lexer(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(['"', "\\", "/", "*", "//", "/*", "*/", "\n", "a", " ", "{", "é"]) for _ in range(rnd.randrange(30))) for _ in range(3000)]
    texts += ["", '"' + "a" * 200_000 + '"', "/*" + "x\n" * 50_000, "a" * 300_000 + "// end", '{"u": "http://x/*y*/" /* c\nd */, "v": 1 // z\n}']
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = {r["i"]: r["y"] for r in frame.select("i", F.expr(T.strip_comments("x")).alias("y")).collect()}
    assert [t for i, t in enumerate(texts) if got[i] != lexed(t)] == []
    assert frame.where("i = " + str(len(texts) - 1)).select(F.expr(f"variant_get({parsed_jsonc('x')}, '$.v', 'int')")).first()[0] == 1


def known(c: int) -> bool:
    return not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"


def test_case_folding_of_every_letter(spark):
    rows = [(chr(c), chr(c).casefold()) for c in range(1, sys.maxunicode + 1) if known(c)] + [(x, x.casefold()) for x in ("ΟΔΟΣ", "ὈΔΥΣΣΕΎΣ", "STRASSE Straße", "ﬃ İI ıi", "")]
    wrong = spark.createDataFrame(rows, "x string, f string").select("x", "f", F.expr(U.casefold("x")).alias("g")).where("f <> g").collect()
    # The JVM may know capitals of a newer Unicode than Python does.
    assert all(unicodedata.category(r["g"][0]) == "Cn" for r in wrong)


def test_normal_form_of_every_letter_and_of_piled_marks(spark):
    rnd = random.Random(1)
    marks = [chr(c) for c in range(0x300, 0x370)] + ["\u0323", "\u0307", "\u0f71", "\u3099", "\u05b0"]
    bases = [chr(c) for c in (*range(0x20, 0x250), *range(0x1100, 0x1200), *range(0xAC00, 0xAC80), *range(0xFB00, 0xFB50), *range(0x1D15E, 0x1D165))]
    texts = [chr(c) for c in range(1, 0x30000, 3) if known(c)] + ["".join(rnd.choice(bases + marks * 8) for _ in range(rnd.randrange(1, 9))) for _ in range(4000)]
    frame = spark.createDataFrame([(x, unicodedata.normalize("NFKC", x)) for x in texts], "x string, f string")
    assert frame.select("f", F.expr(U.nfkc("x")).alias("g")).where("f <> g").collect() == []


def test_lines_of_documents_in_normal_form(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(F.split("text", "\n", -1)).alias("x")).distinct()
    for r in lines.select("x", F.expr(U.nfkc("x")).alias("g"), F.expr(U.casefold("x")).alias("f")).collect():
        assert r["g"] == unicodedata.normalize("NFKC", r["x"]) and r["f"] == r["x"].casefold()


def test_configs_become_jobs(spark):
    files = spark.createDataFrame([
        ("pics", '{"output_mode": " Images ", "target_window_title": " Reader ", "capture_mode": "window_full", "n_pages": 3}'), ("bare", '{"output_mode": "text", "n_pages": 4}'),
        ("rect", '{"output_mode": "pdf", "rect": {"left": 0, "top": 0, "width": 5, "height": 5}, "assemble_style": " RAW "}'), ("given", '{"output_mode": "text", "n_pages": 9, "input_pdf": "/in/x.pdf"}'),
    ], "config string, value string")
    arguments = spark.createDataFrame([("pics", None, 0), ("bare", None, 7), ("rect", 2, None), ("given", None, None)], "config string, n_pages int, debug_capture_max_pages int")
    resolved = settings.settled(settings.resolve(files, arguments, settings.builtin_profiles(spark)))
    rows = {r["config"]: r for r in resolved.collect()}
    assert rows["pics"]["output_mode"] == "images" and rows["pics"]["target_window_title"] == "Reader" and rows["rect"]["assemble_style"] == "raw"
    assert rows["pics"]["debug_capture_max_pages"] == 1 and rows["bare"]["debug_capture_max_pages"] == 7 and rows["given"]["debug_capture_max_pages"] == 5
    found = settings.checked(resolved.withColumns({"base_dir": F.lit("/books"), "pdf_pages": F.lit(0)}))
    assert {r["config"]: r["violations"] for r in found.collect()} == {"pics": [], "bare": ["rect"], "rect": [], "given": ["rect"]}
    books = resolved.withColumn("book", F.col("config")).withColumns({"book_pdf": F.concat(F.lit("/b/"), "book", F.lit(".pdf")), "book_markdown": F.concat(F.lit("/b/"), "book", F.lit(".md"))})
    there = spark.createDataFrame([("/in/x.pdf", 6), ("/b/rect.pdf", 1), ("/b/given.md", None)], "path string, pages int")
    jobs = planning.planned_jobs(books, there)
    assert {r["book"]: (r["can_capture"], r["manual"], r["has_pdf"], r["pdf_pages"], r["has_markdown"]) for r in jobs.collect()} == {
        "pics": (True, False, False, 0, False), "bare": (False, True, False, 0, False), "rect": (True, True, True, 0, False), "given": (False, True, True, 6, True)}
    none = spark.createDataFrame([], "book string, page_num int, suffix string, size long")
    steps = {(r["book"], r["step_no"]): (r["kind"], r["n_used"]) for r in planning.plan_steps(jobs, none).collect()}
    assert steps == {("pics", 0): ("capture", 3), ("bare", 0): ("error", 4), ("rect", 0): ("capture", 2), ("rect", 1): ("build_pdf", 2), ("given", 0): ("ocr_from_pdf", 6), ("given", 1): ("assemble", 6)}


def test_an_unknown_output_mode_raises(spark):
    with pytest.raises(Exception, match="known values"):
        settings.settled(settings.configs(spark.createDataFrame([("x", '{"output_mode": "film"}')], "config string, value string"))).collect()
