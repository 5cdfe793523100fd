"""Rows that exercise what ordinary documents never do, as VALUES that Spark and the oracle both read."""

from __future__ import annotations

from pagewright.functions.text import literal


def values(rows: list[tuple], names: str) -> str:
    """``SELECT * FROM (VALUES ...) AS t(names)`` in both dialects."""

    def sql(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return f"cast({v!r} AS double)"
        return str(v) if isinstance(v, int) else literal(v)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql, r)) + ')' for r in rows)}) AS t({names})"


BOOKS: dict[str, list[tuple[int, list[tuple[str, str]]]]] = {
    "harbor": [
        (2, [("header", "항구 일지"), ("body", "배는 새벽에 들어온다.")]),
        (5, [("title", "2장"), ("title", "등대지기"), ("body", "불빛은 밤마다 바다를 훑")]),
        (6, [("body", "었다고 노인이 말했다."), ("page_number", "6")]),
        (7, []),
        (11, [("header", "4"), ("title", "물때\n읽는 법"), ("other", "밀물과 썰물"), ("figure", "달\n바다"), ("body", "달이 차면 물이 높아진다.")]),
        (14, [("section_title", "부록"), ("body", "낱말 풀이")]),
        (15, [("title", "7장"), ("body", "마지막 배가 떠났다.")]),
    ],
    "coast": [
        (3, [("figure", "map\nof the coast"), ("body", "\n".join((  # a figure keeps its lines
            "Low tide, at noon,",  # a sign: a space follows
            "two gulls sat",  # a letter before a small one: glued
            "on the pier",
            "Nobody saw them leave.",  # before a capital: a space
            "STORM WARNING",  # a label after a sentence's end: a new paragraph
            "- ropes and an-",  # a dash after a label, which ends no sentence: goes on
            "chors",  # the hyphen goes before a letter
            "7 of them",  # a digit: a space
            " \t ",  # a line of space between others splits the text
            "3. Lights out.",
            "4) Doors shut! ",  # numbers begin anew only after an end
            "∙ Keys",
            "12 in all",
        )))]),
        (8, [("body", "\n".join((
            "언덕의",  # a particle: a space
            "바람은 차고 하늘",  # neither particle nor ending: glued
            "빛은 흐렸습니다",  # an ending: a space
            "그래서 모두",
            "돌아갔다…",  # an ellipsis ends the paragraph
            "◦ 끝",
        ))), ("body", "뒤에 남은 사람"), ("caption", "A gull\nin flight")]),
        (9, [("body", "'Wait.'\nhe called. \n\n\n\"Why?\"\nX9\nFOG\nA-\n1")]),  # quotes after a stop, empty lines, labels, a hyphen before a digit
    ],
    "runs": [
        (1, [("body", "left part"), ("page_number", "7")]),
        (2, [("body", "right part.")]),
        (3, [("body", "alpha beta")]),
        (4, [("body", "gamma one."), ("body", "left over"), ("page_number", "9")]),
        (5, [("body", "joins now.")]),
        (6, [("body", "chain start")]),
        (7, [("body", "And more")]),
        (8, [("header", "Running head"), ("body", "the end.")]),
        (9, [("body", "text goes")]),
        (10, [("body", "on here."), ("page_number", "03."), ("title", "Lost number")]),
        (11, [("header", "only a head")]),
        (12, [("body", "open end")]),
        (13, [("body", "AB"), ("body", "two of"), ("body", "one page"), ("caption", "A caption\nin two lines")]),
    ],
    "heads": [
        (1, [("header", "1"), ("title", "Preface"), ("body", "Before all.")]),
        (2, [("header", "head"), ("title", "1장"), ("body", "no start here.")]),
        (3, [("title", "１２장"), ("title", "넓은 숫자"), ("title", "셋째"), ("toc", "a\nb"), ("weird", "kept as is")]),
        (4, [("page_number", "4"), ("page_number", "5."), ("subtitle", "a sub\ntitle"), ("footnote", "a note"), ("other", "x" * 61)]),
        (5, [("body", "text."), ("section_title", "부록"), ("body", "more.")]),
        (6, [("title", "Appendix\nA"), ("other", "before title"), ("section_title", "Named")]),
        (7, [("title", "2 장"), ("figure", "f1\nf2"), ("other", "last one")]),
        (8, [("title", "EPILOGUE"), ("body", "bye.")]),
    ],
    "plain": [(3, [("page_number", "3")]), (4, [("body", "no marks at all")]), (6, [("body", "Just text.")])],
}

SECTIONS = values([(b, p, i, t, x) for b, pages in BOOKS.items() for p, secs in pages for i, (t, x) in enumerate(secs)],
                  "book, page_num, sec_idx, type, text")
PAGES = values([(b, p) for b, pages in BOOKS.items() for p, _ in pages], "book, page_num")

LINES = values([(i, x) for i, x in enumerate([
    "", "  ", "Ends.", "Ends!", "Ends? ", "Ends…", 'Ends."', "Ends.'", "no end", "끝났다.", "1) item", "2. item", "3.item", "• x", "- x", "-x",
    "AB", "A1 ", "ABCDE F", "ABC", "ABCdE", "lower start", ")close", '"quote', "로는 것", "은행", "이것", "12) no", "가나, 다", "가나다, 라", "Upper", "1장", "12 장",
    "１２장", "1장 끝", "결론", "Appendix", "appendix \nmore", "03.", "3", "123", "  7. ", "니다. ", "(it)", "]x",
])], "line_id, line")

# Every kind of ending that the joining of two lines tells apart, before every kind of beginning.
ENDINGS = {
    "hyphen": "sun-", "hyphen after Hangul": "바람-", "small letter": "the river", "capital": "NORTH", "accented letter": "café", "digit": "page 12", "full stop": "It rained.",
    "closing bracket": "(so)", "Hangul": "하늘", "Hangul particle": "나무와", "Hangul ending": "구름처럼", "Hangul comma": "저녁,", "spaces": "leaf  ", "nothing": "", "only spaces": "  ",
}
BEGINNINGS = {
    "small letter": "light", "capital": "Light", "accented letter": "été", "Hangul": "아래", "digit": "7th", "bracket": "(note)", "hyphen": "-like", "spaces": "  moss", "nothing": "",
}
PAIRS = values([(i, a, b) for i, (a, b) in enumerate((a, b) for a in ENDINGS.values() for b in BEGINNINGS.values())], "pair_id, a, b")

REPLIES = values([(i, x, 4) for i, x in enumerate([
    '{"page": 7, "text": " whole ", "sections": [{"type": "Title ", "text": " A "}, "bare", 5, {"type": "odd", "text": "B"}, {"text": "C"}, {"type": "", "text": "D"}]}',
    '```json\n{"page": "12", "sections": [{"type": "body", "text": null}, {"type": "toc", "text": "x\ny"}]}\n```'.replace("\ny", "\\ny"),
    'Here it is: {"page": "vii", "sections": [], "text": "only text"} and more',
    '{"page": -1, "blocks": ["one ", {"type": "caption", "text": "two"}], "content": [{"content": "three"}, "  "], "paragraphs": ["four"]}',
    '{"page": true, "sections": [{"type": "footnote", "text": "n"}]}', '{"page": 0.5, "text": ""}', '{"page": 2.9}', "no object at all", '[1, 2]',
    '{"page": null, "sections": {"a": 1}, "text": "t"}', '{"page": 0, "sections": [{"type": "body", "text": "  "}]}',
])], "reply_id, reply, page_num")

JOBS = values([
    ("img_new", 1, 3, "images", "", "full", True, False, 0, False, False), ("img_part", 1, 5, "images", "", "full", True, False, 0, False, False),
    ("img_done", 1, 3, "images", "", "full", True, False, 0, False, False), ("img_force", 1, 3, "images", "all", "full", True, False, 0, False, False),
    ("img_stuck", 1, 3, "images", "", "full", False, True, 0, False, False), ("pdf_new", 1, 2, "pdf", "", "full", True, False, 0, False, False),
    ("pdf_done", 1, 2, "pdf", "", "full", True, False, 2, True, False), ("pdf_force", 1, 2, "pdf", "pdf", "full", True, False, 2, True, False),
    ("pdf_stuck", 1, 2, "pdf", "", "full", False, True, 0, False, False), ("txt_done", 1, 2, "text", "", "prose", True, False, 0, False, True),
    ("txt_nomd", 1, 2, "text", "", "raw", True, False, 0, False, False), ("txt_prefix", 1, 5, "text", "", "full", True, False, 9, True, False),
    ("txt_pdf", 3, 9, "text", "", "full", False, True, 6, True, False), ("txt_resume", 1, 3, "text", "", "full", True, False, 0, False, False),
    ("txt_part", 1, 3, "text", "", "full", False, True, 0, False, False), ("txt_new", 1, 3, "text", "", "full", True, False, 0, False, False),
    ("txt_stuck", 1, 3, "text", "", "full", False, True, 0, False, False), ("txt_force", 1, 2, "text", "ocr", "full", True, False, 0, False, True),
], "book, start_page, n_pages, output_mode, force_phase, style, can_capture, manual, pdf_pages, has_pdf, has_markdown")

ARTIFACTS = values([
    *(("img_part", p, ".png", s) for p, s in ((1, 9), (2, 9), (3, 0), (4, 9))), *((b, p, ".png", 5) for b in ("img_done", "img_force") for p in (1, 2, 3)),
    *((b, p, ".png", 5) for b in ("pdf_done", "pdf_force", "txt_done", "txt_nomd", "txt_force") for p in (1, 2)),
    *((b, p, ".ocr.json", 5) for b in ("txt_done", "txt_nomd", "txt_force") for p in (1, 2)),
    *(("txt_prefix", p, ".png", 5) for p in (1, 2, 4)), ("txt_prefix", 1, ".ocr.json", 5), ("txt_pdf", 4, ".ocr.json", 7),
    ("txt_resume", 2, ".png", 5), ("txt_part", 3, ".png", 5), ("txt_part", 3, ".ocr.json", 0),
], "book, page_num, suffix, size")

CAPTURES = values([(b, i + 1, d) for b, ds in {
    "aaa": "AAA", "aabbb": "AABBBC", "abab": "ABABAB", "gap": ["A", "A", None, "A", "A"], "late": "ABCCDDDEEEE", "nulls": [None, None, None, None],
}.items() for i, d in enumerate(ds)], "book, page_num, digest")

STATE = values([
    ("b", "capture", 1, "failed", 1), ("b", "capture", 1, "done", 2), ("b", "capture", 2, "done", 3), ("b", "capture", 2, "failed", 4), ("b", "ocr", 1, "done", 5),
    ("b", "ocr", 2, "done", 6),
], "book, phase, page_num, status, seq")
RESUME = values([(b, ph, p, r, f) for b, r, f in (("b", True, ""),) for ph in ("capture", "ocr") for p in (1, 2, 3)] + [
    ("c", "capture", 1, True, "all"), ("d", "capture", 1, True, "capture"), ("d", "ocr", 1, True, "capture"), ("e", "ocr", 1, False, "")],
    "book, phase, page_num, resume, force_phase")
VALID = values([("b", "capture", 1), ("b", "capture", 3), ("b", "ocr", 1), ("c", "capture", 1), ("d", "capture", 1), ("d", "ocr", 1), ("e", "ocr", 1)],
               "book, phase, page_num")

CONFIGS = values([
    ("c1", "reader", "manual", 1.0, 2, 0.5, "right"), ("c2", "none", "window_full", 1.5, 1, 0.25, "left"), ("c3", "wild", "manual", 0.5, 0, 0.5, None),
], "config, reader_profile, capture_mode, delay_sec, reader_focus_clicks, reader_focus_x_ratio, next_key")
PROFILES = values([
    ("reader", "window_left_third", 2.0, None, 0.75, "pagedown"), ("wild", None, None, 9, -0.5, "space"),
], "name, capture_mode, delay_sec, reader_focus_clicks, reader_focus_x_ratio, next_key")
BUILTIN = values([(0, "app", "right", 2.0), (1, "cloud", "right", 2.0), (2, "web", "pagedown", 2.0)], "ord, name, next_key, delay_sec")
FROM_FILE = values([(0, "own", "down", 1.0), (1, "cloud", None, 3.0), (2, "own", "up", None)], "ord, name, next_key, delay_sec")

IMAGES = values([
    ("a", 1001, 1799, 96.0, 0.0, 0.0, 0.035, 0.0, 0.0, 0.0), ("b", 1001, 1761, 0.5, 0.01, 0.02, 0.01, 0.045, 0.026, 0.1),
    ("half", 10, 10, None, 0.05, 0.15, 0.25, 0.35, 0.45, 0.05), ("thin", 10, 10, 72.0, 0.45, 0.45, 0.0, 0.0, 0.0, 0.0),
], "image, width, height, dpi, trim_left, trim_right, trim_top, trim_bottom, trim_fill_top, trim_fill_bottom")

RECTS = values([(i, m, 10, 20, w, 99) for i, (m, w) in enumerate((m, w) for m in (
    "manual", "window_full", "window_left_third", "window_right_third", "screen_left_third") for w in (1, 2, 100, 101))],
    "rect_id, capture_mode, x, y, width, height")

RULES = values([
    ("ok", "manual", 10, 1, "full", "", 0, 5, 5, "", 2, 0, 0.5, 0.5, 0.5, 0.5, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, "printwindow", "/books", "auto"),
    ("bad", "odd", 0, 0, "x", "y", 0, 5, 5, " ", 6, -1, 1.5, -0.5, 0.5, 0.5, 11.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, False, "gdi", "books", "morse"),
    ("pdf", "manual", 9, 3, "raw", "all", 5, 0, 0, "", 0, 0, 0.0, 1.0, 0.0, 1.0, 10.0, 0.45, 0.45, 0.4, 0.3, 0.2, 0.1, False, "gdi", "C:\\books", ""),
    ("past", "window_full", 1, 8, "prose", "ocr", 5, 0, 0, "", 0, 0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, "screen", "/b", "sendinput"),
    ("rect", "manual", 1, 1, "prose", "pdf", 0, 0, 3, "", 0, 0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, "screen", "/b", "auto"),
    ("title", "window_full", 10001, 1, "full", "", 0, 0, 0, "  ", 0, 0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, "screen", "/b", "auto"),
    ("skip", "window_full", 1, 1, "full", "", 0, 0, 0, "", 0, 0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, True, "gdi", "/b", " AUTO "),
], "config, capture_mode, n_pages, start_page, assemble_style, force_phase, pdf_pages, rect_width, rect_height, window_title, reader_focus_clicks, "
   "start_focus_clicks, start_focus_x_ratio, start_focus_y_ratio, reader_focus_x_ratio, reader_focus_y_ratio, settle_sec, "
   "trim_left, trim_right, trim_top, trim_bottom, trim_fill_top, trim_fill_bottom, skip_capture, window_capture_backend, base_dir, key_delivery")

WINDOWS = values([
    ("kin", 11, "My Kindle", False, 1), ("kin", 12, "kindle", False, 2), ("kin", 13, "Other", True, 0), ("Book", 21, "Notebook", False, 1), ("Book", 22, "Book", False, 2),
    ("web", 31, "Web A", False, 1), ("web", 32, "web b", True, 2), ("web", 33, "web", False, 0), ("zip", 41, "none", False, 0),
], "query, hwnd, title, foreground, ord")
CHILDREN = values([("p", 1, 10, 10, 0), ("p", 2, 20, 10, 1), ("p", 3, 10, 20, 2), ("q", 4, 1, 1, 0)], "parent, hwnd, width, height, ord")
LEVELS = values([("x", 0, 10), ("x", 5, 10), ("x", 255, 1), ("y", 3, 4)], "image, level, count")
SHADES = values([("dark", 10.0, 12.0, 19.9), ("edge", 14.0, 14.0, 14.0), ("light", 200.0, 10.0, 10.0)], "image, r, g, b")
EVENTS = values([("b", "IMAGE_OK 1/3", 3), ("b", "IMAGE_SKIP", 3), ("b", "IMAGE_OK 2/3", 3), ("c", "IMAGE_OK 1/1", 1), ("d", "CAPTURE", 5)], "book, message, total")
PROMPTS = values([(1, " own {lang_hint} ", None, None, "en", 3), (2, "", "file {page_num}", "bundle", "de", 4), (3, " ", None, "bundled {lang_hint}/{page_num}", "fr", 5),
                  (4, "", None, None, "es", 6), (5, None, None, "not this one", "it", 7)], "prompt_id, inline, file_text, bundled, lang_hint, page_num")
PROMPT_FILES = values([(1, "/p/a.txt"), (2, "/p/b.txt"), (3, " "), (4, ""), (5, "/p/gone.txt")], "prompt_id, prompt_file")
TEXT_FILES = values([("b_0002.txt", "two"), ("b_0001.txt", "one"), ("b_10.txt", "ten"), ("c_0001.txt", "x"), ("c_1.txt.bak", "no"), ("odd.txt", "no")], "file_name, value")
LAYERS = values([(1, "cli", "profile", "file"), (2, None, "profile", "file"), (3, None, None, "file"), (4, None, None, None)], "layer_id, cli, profile, file")
LANGUAGES = values([(0, "Korean", "ko"), (1, "English", "en"), (2, "Korean", "kr")], "ord, lang, code")
NAMES = values([("Korean",), ("English",), ("Klingon",)], "lang")
MODES = values([(1, " Images "), (2, "PDF"), (3, "text"), (4, ""), (5, None)], "mode_id, mode")
FILES = values([(i, s, n, c) for i, (s, n, c) in enumerate([
    (".ocr.json", 9, '{"sections": []}'), (".ocr.json", 9, '{"sections": {}}'), (".ocr.json", 9, "[]"), (".ocr.json", 9, "{no"),
    (".ocr.json", 9, '{"text": "x"}'), (".ocr.json", 9, '{"sections": [1, "a"]}'), (".txt", 0, ""), (".txt", 3, "abc"),
    (".page.pdf", 0, None), (".page.pdf", 9, None)])], "file_id, suffix, size, content")
CONFIG_FILES = values([("empty", "{}"), ("flat", '{"n_pages": 7, "next_key": "right", "pdf_trim_top": 0.1, "rect": {"left": 1, "width": 9}, "resume": false}'),
                       ("nested", '{"delay_sec": 2.5, "pdf_trim": {"bottom": 0.2}, "pdf_trim_top": 0.3, "output_mode": "text"}')], "config, value")

ARGUMENTS = values([("empty", "kindle_app", 3, None, None, 1, 2, 3, None), ("flat", None, None, "space", None, 1, 2, 3, 4), ("nested", "", None, None, 0.25, None, None, None, None)],
                   "config, reader_profile, n_pages, next_key, delay_sec, rect_left, rect_top, rect_width, rect_height")
PDF_JOBS = values([("own", "", "/b/own.pdf"), ("given", "/in/x.pdf", "/b/given.pdf"), ("gone", "/in/gone.pdf", "/b/gone.pdf"), ("none", None, "/b/none.pdf"), ("blank", "  ", "/b/blank.pdf"),
                   ("lost", "/in/lost.pdf", "/b/lost.pdf")], "book, input_pdf, book_pdf")
PDF_FILES = values([("/b/own.pdf",), ("/in/x.pdf",), ("/b/given.pdf",), ("/b/gone.pdf",), ("/b/blank.pdf",), ("/b/blank.pdf",)], "path")
STATE_FILES = values([
    ("kept", '{"title": "kept", "start_page": 3, "n_pages": 9, "phases": {"capture": {"3": {"status": "done", "path": "/t/3.png"}, "x": {"status": "done"}}, "ocr": {"4": {"status": "failed", "error": "no reply"}}}, '
             '"errors": [{"phase": "ocr", "page": 4, "error": "no reply"}, {"phase": "ocr", "page": 5, "error": "again"}], "outputs": {"final_pdf": "/b/kept.pdf", "combined_txt": "/b/kept.txt"}, "end_of_book_last_page": 7}'),
    ("bare", '{"start_page": 1, "n_pages": 2, "phases": {}}'), ("broken", "{"), ("list", "[1, 2]")], "book, value")
