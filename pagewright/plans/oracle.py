"""Oracle SQL for DuckDB, written from the semantics and not from the Spark expressions."""

from __future__ import annotations

from pagewright.functions import text as T
from pagewright.functions.text import literal


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '\s+$', '')"


def lstrip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+', '')"


def first_line(x: str) -> str:
    return strip(f"string_split({strip(x)}, chr(10))[1]")


def flat(x: str) -> str:
    return strip(f"replace({x}, chr(10), ' ')")


def _ends(x: str, endings) -> str:
    return "(" + " OR ".join(f"ends_with({x}, {literal(e)})" for e in endings) + ")"


def paragraph_ends(x: str) -> str:
    e = rstrip(x)
    return f"""({e} = '' OR {_ends(e, ['.', '!', '?', '…', '."', ".'"])})"""


def new_paragraph(x: str) -> str:
    s = strip(x)
    tests = [r"^[0-9]+[).]\s", r"^[•·∙●○◦-]\s", r"^[A-Z0-9][A-Z0-9]+\s*$", r"^[A-Z][A-Z0-9\s-][A-Z0-9\s-][A-Z0-9\s-][A-Z0-9\s-]+$"]
    return f"({s} = '' OR " + " OR ".join(f"regexp_matches({s}, '{t}')" for t in tests) + ")"


def continuation(x: str) -> str:
    s = strip(x)
    return f"""CASE WHEN {s} = '' THEN false WHEN contains({literal(T.CONTINUATION_PUNCTUATION)}, left({s}, 1)) THEN true
        WHEN regexp_matches({s}, '^[a-z]') OR regexp_matches({s}, '{T.CONTINUATION_START}') THEN true
        WHEN {' OR '.join(f"starts_with({s}, '{p}')" for p in T.CONTINUATION_PREFIXES)} THEN true
        WHEN regexp_matches({s}, '^[0-9]+[).]') THEN false ELSE regexp_matches({s}, '^[가-힣][가-힣]?[,.]') END"""


def space_joiner(x: str) -> str:
    e = rstrip(x)
    return f"({e} = '' OR contains({literal(T.SPACE_JOIN_PUNCTUATION + T.SPACE_JOIN_PARTICLES)}, right({e}, 1)) OR {_ends(e, T.SPACE_JOIN_SUFFIXES)})"


def join_lines(a: str, b: str) -> str:
    left, right = rstrip(a), lstrip(b)
    hangul = lambda x: f"({x} BETWEEN '가' AND '힣')"
    return f"""CASE WHEN {left} = '' THEN {right} WHEN {right} = '' THEN {left}
        WHEN right({left}, 1) = '-' AND regexp_matches(left({right}, 1), '\\p{{L}}') THEN left({left}, length({left}) - 1) || {right}
        WHEN {hangul(f'right({left}, 1)')} AND {hangul(f'left({right}, 1)')} THEN {left} || CASE WHEN {space_joiner(a)} THEN ' ' ELSE '' END || {right}
        WHEN regexp_matches(right({left}, 1), '[A-Za-z]') AND regexp_matches(left({right}, 1), '[a-z]') THEN {left} || {right}
        ELSE {left} || ' ' || {right} END"""


def paragraphs(chunk: str) -> str:
    lines = f"list_filter(list_transform(string_split({chunk}, chr(10)), lambda u: {strip('u')}), lambda u: u <> '')"
    return f"""CASE WHEN len({lines}) = 0 THEN []::VARCHAR[] ELSE list_reduce(list_transform({lines}, lambda u: [u]), lambda m, v:
        CASE WHEN {paragraph_ends('m[len(m)]')} AND {new_paragraph('v[1]')} THEN list_concat(m, v)
             ELSE list_concat(m[1:len(m) - 1], [{join_lines('m[len(m)]', 'v[1]')}]) END) END"""


def reflow(x: str) -> str:
    return rf"""CASE WHEN instr({x}, chr(10)) = 0 THEN {x} ELSE array_to_string(flatten(list_transform(
        string_split_regex({strip(x)}, '\n\s*\n+'), lambda c: {paragraphs('c')})), chr(10) || chr(10)) END"""


def marker(x: str) -> str:
    return rf"regexp_matches({first_line(x)}, '^[0-9０-９]+\s*장$')"


def back_matter(x: str) -> str:
    return f"(lower({first_line(x)}) IN ({', '.join(map(literal, T.BACK_MATTER))}))"


def number(x: str) -> str:
    return rf"regexp_matches({strip(x)}, '^[0-9][0-9]?[.]?$')"


def may_merge(ta: str, a: str, tb: str, b: str) -> str:
    return f"({ta} = 'body' AND {tb} = 'body' AND NOT {paragraph_ends(a)} AND NOT {new_paragraph(b)})"


def fold(column: str, order: str) -> str:
    return f"list_reduce(list({column} ORDER BY {order}), lambda m, v: {join_lines('m', 'v')})"


def within(given: str = "given") -> str:
    """CTEs: reflowed, and merged within pages as ``inside`` (book, page_num, idx, type, text)."""
    return f"""
    reflowed AS (SELECT book, page_num, sec_idx, type, CASE WHEN type = 'body' THEN {reflow('text')} ELSE text END AS text FROM {given}),
    near AS (SELECT *, lag(type) OVER w AS pt, lag(text) OVER w AS px FROM reflowed WINDOW w AS (PARTITION BY book, page_num ORDER BY sec_idx)),
    islands AS (SELECT *, sum(CASE WHEN pt IS NOT NULL AND {may_merge('pt', 'px', 'type', 'text')} THEN 0 ELSE 1 END)
        OVER (PARTITION BY book, page_num ORDER BY sec_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM near),
    inside AS (SELECT book, page_num, isl AS idx, min_by(type, sec_idx) AS type, {fold('text', 'sec_idx')} AS text FROM islands GROUP BY book, page_num, isl)"""


def across() -> str:
    """CTEs from ``inside`` to ``merged`` (book, page_num, idx, type, text): one bit of state a page, walked in order."""
    content = "type NOT IN ('header', 'page_number')"
    return f"""
    facts AS (SELECT book, page_num, count(*) FILTER ({content}) AS n, min_by(type, idx) FILTER ({content}) AS ft, min_by(text, idx) FILTER ({content}) AS fx,
        max_by(type, idx) FILTER ({content}) AS ct, max_by(text, idx) FILTER ({content}) AS cx, max_by(type, idx) AS lt, max_by(text, idx) AS lx
        FROM inside GROUP BY book, page_num),
    steps AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_num) AS rn FROM facts WHERE n > 0),
    walk AS (
      SELECT book, page_num, rn, false AS pulled, lt AS tt, lx AS tx FROM steps WHERE rn = 1
      UNION ALL
      SELECT book, page_num, rn, pulled, CASE WHEN pulled THEN ct ELSE lt END, CASE WHEN pulled THEN cx ELSE lx END
      FROM (SELECT s.*, {may_merge('w.tt', 'w.tx', 's.ft', 's.fx')} AS pulled FROM walk w JOIN steps s ON s.book = w.book AND s.rn = w.rn + 1)),
    stays AS (SELECT i.*, w.pulled, row_number() OVER (PARTITION BY i.book, i.page_num ORDER BY i.idx) AS place
      FROM inside i JOIN walk w USING (book, page_num) WHERE NOT w.pulled OR i.{content}),
    chains AS (SELECT *, sum(CASE WHEN pulled AND place = 1 THEN 0 ELSE 1 END)
      OVER (PARTITION BY book ORDER BY page_num, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chain FROM stays),
    merged AS (SELECT book, min(page_num) AS page_num, chain AS idx, arg_min(type, (page_num, idx)) AS type, {fold('text', 'page_num, idx')} AS text
      FROM chains GROUP BY book, chain)"""


def prepared(given: str) -> str:
    """CTE ``ready`` (book, page_num, idx, type, text) from the sections ``given``, which keep their order in idx."""
    is_number = lambda t, x: f"coalesce({t} IN ('header', 'page_number') AND {number(x)}, false)"
    s = strip("text")
    return f"""
    around AS (SELECT *, lag(type) OVER w AS pt, lag(text) OVER w AS px, lead(type) OVER w AS nt, lead(text) OVER w AS nx FROM {given}
      WINDOW w AS (PARTITION BY book, page_num ORDER BY idx)),
    changed AS (SELECT book, page_num, idx, CASE
        WHEN {is_number('type', 'text')} THEN CASE WHEN nt = 'title' THEN {{'type': 'section_title', 'text': rtrim({s}, '.') || '. ' || {flat('nx')}}} END
        WHEN type = 'title' AND {is_number('pt', 'px')} THEN NULL
        WHEN type = 'title' AND NOT {marker('text')} THEN {{'type': 'section_title', 'text': {flat('text')}}}
        WHEN type IN ('header', 'page_number') THEN NULL
        WHEN type = 'other' AND {s} <> '' AND length({s}) <= 60 AND len(string_split({s}, chr(10))) <= 2 AND (nt IS NULL OR nt IN ('body', 'figure'))
          THEN {{'type': 'subtitle', 'text': {s}}}
        ELSE {{'type': type, 'text': text}} END AS x FROM around),
    ready AS (SELECT book, page_num, idx, x.type AS type, x.text AS text FROM changed WHERE x IS NOT NULL)"""


def structure(given: str) -> str:
    """CTEs ``parts`` (segments) and ``blocks`` from the sections ``given`` and their prepared form ``ready``."""
    heads = "type IN ('title', 'section_title')"
    return f"""
    filled AS (SELECT DISTINCT book, page_num FROM ready),
    first_pages AS (SELECT book, min(page_num) AS first_page FROM listed GROUP BY book),
    led AS (SELECT *, sum(CASE WHEN type <> 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY book, page_num ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 0 AS lead_title
      FROM {given}),
    pages AS (SELECT l.book, l.page_num, bool_or(lead_title AND {marker('text')}) AS chapter, bool_or({heads} AND {back_matter('text')}) AS back,
        list({flat('text')} ORDER BY idx) FILTER (lead_title AND {flat('text')} <> '') AS titles, min_by({first_line('text')}, idx) FILTER ({heads} AND {back_matter('text')}) AS back_title
      FROM led l JOIN filled USING (book, page_num) GROUP BY l.book, l.page_num),
    kinds AS (SELECT *, CASE WHEN chapter THEN 'chapter' WHEN back THEN 'back_matter' END AS kind,
        CASE WHEN chapter THEN CASE WHEN titles IS NULL THEN 'Untitled' WHEN len(titles) = 1 THEN titles[1]
            WHEN regexp_matches(titles[1], '^[0-9０-９]+\\s*장$') THEN titles[1] || ' ' || titles[2] ELSE array_to_string(titles, ' ') END
          WHEN back THEN back_title END AS heading FROM pages),
    segs AS (SELECT *, sum(CASE WHEN kind IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM kinds),
    rled AS (SELECT r.*, s.seg, s.kind, sum(CASE WHEN type <> 'title' THEN 1 ELSE 0 END) OVER w = 0 AS lead_title, row_number() OVER w AS place
      FROM ready r JOIN segs s USING (book, page_num) WINDOW w AS (PARTITION BY r.book, r.page_num ORDER BY r.idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    blocks AS (SELECT * FROM rled WHERE NOT coalesce(kind = 'chapter' AND lead_title, false)
      AND NOT coalesce(kind = 'back_matter' AND place = 1 AND {heads} AND {back_matter('text')}, false)),
    counts AS (SELECT book, seg, count(*) AS block_count FROM blocks GROUP BY book, seg),
    bounds AS (SELECT book, seg, max(kind) AS kind, max(heading) AS heading, min(page_num) AS low, max(page_num) AS high FROM segs GROUP BY book, seg),
    parts AS (SELECT b.book, b.seg, coalesce(kind, 'front_matter') AS kind, coalesce(heading, 'Front matter') AS heading,
        CASE WHEN b.seg = 0 THEN first_page ELSE low END AS start_page, coalesce(lead(low) OVER (PARTITION BY b.book ORDER BY b.seg) - 1, high) AS end_page,
        coalesce(block_count, 0) AS block_count
      FROM bounds b JOIN first_pages USING (book) LEFT JOIN counts c ON c.book = b.book AND c.seg = b.seg),
    slugged AS (SELECT *, CASE WHEN kind = 'front_matter' THEN 'front-matter' ELSE coalesce(nullif(trim(regexp_replace(regexp_replace(
        {wide_digits('lower(heading)')}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-'), ''), 'section') END AS slug FROM parts)"""


def wide_digits(x: str) -> str:
    """The part of NFKC that the fixtures need: full-width digits."""
    return f"translate({x}, '０１２３４５６７８９', '0123456789')"


def markdown(body_only: bool, comments: bool) -> str:
    line = f"replace({strip('text')}, chr(10), ' ')"
    s = strip("text")
    nl = "chr(10)"
    only = "WHEN type <> 'body' THEN ''" if body_only else ""
    comment = f"'<!-- pages: ' || start_page || '-' || end_page || ' -->' || {nl} || {nl}" if comments else "''"
    return f"""
    shown AS (SELECT *, CASE WHEN {s} = '' THEN '' {only}
        WHEN type IN ('title', 'section_title') THEN '### ' || {line} || {nl} || {nl} WHEN type = 'subtitle' THEN '#### ' || {line} || {nl} || {nl}
        WHEN type = 'toc' THEN '### 목차 (원본)' || {nl} || {nl} || {s} || {nl} || {nl}
        WHEN type = 'figure' THEN '> **Figure**' || {nl} || '>' || {nl} || replace({s}, {nl}, {nl} || '> ') || {nl} || {nl}
        WHEN type = 'caption' THEN '*' || {line} || '*' || {nl} || {nl} WHEN type = 'footnote' THEN '> **Footnote** ' || {s} || {nl} || {nl}
        ELSE {s} || {nl} || {nl} END AS md FROM blocks),
    bodies AS (SELECT book, seg, string_agg(md, '' ORDER BY page_num, idx) AS md FROM shown GROUP BY book, seg),
    chapters AS (SELECT p.*, '## ' || CASE WHEN kind = 'front_matter' THEN 'Front matter' ELSE heading END || {nl} || {nl} || {comment} || coalesce(md, '') || '---' || {nl} || {nl} AS md
      FROM slugged p LEFT JOIN bodies b ON p.book = b.book AND p.seg = b.seg),
    tocs AS (SELECT book, string_agg('- [' || heading || '](#' || slug || ') *(p.' || start_page || ')*', {nl} ORDER BY seg) AS toc FROM slugged WHERE kind <> 'front_matter' GROUP BY book)
    SELECT c.book, {rstrip(f"'---' || {nl} || 'title: ' || chr(34) || c.book || chr(34) || {nl} || 'assembled_from: tmp/*.ocr.json' || {nl} || '---' || {nl} || {nl} || '# ' || c.book || {nl} || {nl} || coalesce('## 목차' || {nl} || {nl} || max(toc) || {nl} || {nl} || '---' || {nl} || {nl}, '') || string_agg(md, '' ORDER BY seg)")} || {nl} AS markdown
    FROM chapters c LEFT JOIN tocs t ON t.book = c.book GROUP BY c.book"""


DOCUMENT_SECTIONS = f"""
    lines AS (SELECT doc_id, source || '/' || (doc_id // 500) AS book, list_filter(list_transform(string_split(text, chr(10)), lambda u: {strip('u')}), lambda u: u <> '') AS l FROM documents),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY doc_id) AS page_num FROM lines),
    given AS (SELECT book, page_num, i - 1 AS sec_idx, CASE WHEN contains(l[i], '|') THEN 'figure' ELSE 'body' END AS type, l[i] AS text
      FROM (SELECT book, page_num, l, unnest(range(1, len(l) + 1)) AS i FROM numbered))"""


#: Documents with running heads, numbers, headings and chapters.
CHAPTERED_SECTIONS = f"""
    lines AS (SELECT doc_id, source, lang, source || '/' || (doc_id // 500) AS book, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda u: {strip('u')}), lambda u: u <> '') AS l FROM documents),
    numbered AS (SELECT *, row_number() OVER w AS page_num, lag(lang) OVER w AS before, lead(doc_id) OVER w IS NULL AS last FROM lines WINDOW w AS (PARTITION BY book ORDER BY doc_id)),
    pieces AS (
      SELECT book, page_num, 0 AS a, 0 AS i, 'title' AS type, page_num || '장' AS text FROM numbered WHERE lang <> before
      UNION ALL SELECT book, page_num, 1, 0, 'header', source FROM numbered WHERE source IS NOT NULL AND page_num % 2 = 0
      UNION ALL SELECT book, page_num, 5, 0, 'header', source FROM numbered WHERE source IS NOT NULL AND page_num % 5 = 0
      UNION ALL SELECT book, page_num, 2, 0, 'page_number', page_num::VARCHAR FROM numbered WHERE page_num % 3 > 0
      UNION ALL SELECT book, page_num, 3, i, CASE WHEN contains(l[i], '|') THEN 'figure' WHEN i = 1 AND length(l[i]) <= 60 AND right(l[i], 1) NOT IN ('.', '!', '?') THEN 'title'
          WHEN length(l[i]) <= 25 THEN 'other' ELSE 'body' END, l[i] FROM (SELECT book, page_num, l, unnest(range(1, len(l) + 1)) AS i FROM numbered)
      UNION ALL SELECT book, page_num, 4, 0, 'section_title', 'Appendix' FROM numbered WHERE last),
    given AS (SELECT book, page_num, row_number() OVER (PARTITION BY book, page_num ORDER BY a, i) - 1 AS sec_idx, type, text FROM pieces)"""

#: All documents as one book, a page an id.
SINGLE_BOOK_SECTIONS = DOCUMENT_SECTIONS.replace("source || '/' || (doc_id // 500) AS book", "'all' AS book").replace(
    "row_number() OVER (PARTITION BY book ORDER BY doc_id) AS page_num", "doc_id AS page_num")
