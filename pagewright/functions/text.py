"""Text predicates and functions as Spark SQL fragments.

Each takes SQL for a string and gives SQL, so it can stand in ``F.expr``, in
``spark.sql`` and inside the lambda of a higher-order function, and stays in the JVM.
White space, digits and letters are Unicode's.
"""

from __future__ import annotations

# Word lists, endings and patterns that results depend on.
SPACE_JOIN_SUFFIXES = (
    "에서", "으로", "까지", "부터", "이나", "거나", "라는", "라고", "이며", "이고", "인데", "이지만", "하기", "하는",
    "하다", "이다", "습니다", "였다", "것이", "것을", "것은", "밖에", "위해", "통해", "에게", "처럼", "보다", "만큼",
)
SPACE_JOIN_PARTICLES = "의와과을를에도만은는이가로"
SPACE_JOIN_PUNCTUATION = """,.;:!?…)]}"'"""
CONTINUATION_PREFIXES = (
    "로는 ", "로 ", "는 ", "은 ", "이 ", "가 ", "을 ", "를 ", "에 ", "의 ", "와 ", "과 ", "도 ", "만 ",
    "에서 ", "으로 ", "까지 ", "부터 ", "하여 ", "하면 ",
)
CONTINUATION_START = "^(로[는은]?|[은는이가을를에의와과도만])"
CONTINUATION_PUNCTUATION = """)]}"'”’"""
BACK_MATTER = ("결론", "부록", "참고문헌", "에필로그", "appendix", "references", "epilogue")
BULLETS = "•·∙●○◦-"


def raw(text: str) -> str:
    """A raw SQL string literal; quotes as regex escapes."""
    return "r'" + text.replace("'", r"\x27") + "'"


def literal(text: str | None) -> str:
    """SQL for any text, the same in Spark and in the oracle's dialect."""
    if text is None:
        return "cast(NULL AS string)"
    special = {"\n": "chr(10)", "\t": "chr(9)", "'": "chr(39)", "\\": "chr(92)", "\r": "chr(13)"}
    parts, plain = [], ""
    for c in text:
        if c in special:
            parts += [f"'{plain}'", special[c]]
            plain = ""
        else:
            plain += c
    parts.append(f"'{plain}'")
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


#: White space as Unicode and the separators 0x1C-0x1F have it; trimming by a set of characters beats a regex on long texts.
SPACE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Longer than any suffix that a rule looks at.
TAIL = 8


def strip(x: str) -> str:
    return f"trim(BOTH '{SPACE}' FROM {x})"


def rstrip(x: str) -> str:
    return f"rtrim('{SPACE}', {x})"


def lstrip(x: str) -> str:
    return f"ltrim('{SPACE}', {x})"


def tail(x: str) -> str:
    """The last characters without trailing space: all that a rule about a text's end needs."""
    return f"right({rstrip(x)}, {TAIL})"


def first_line(x: str) -> str:
    return strip(f"substring_index({strip(x)}, chr(10), 1)")


def flat(x: str) -> str:
    """One line: newlines to spaces, stripped."""
    return strip(f"replace({x}, chr(10), ' ')")


def paragraph_ends(x: str) -> str:
    """Nothing but white space, or a sentence end, perhaps with a closing quote after a full stop."""
    end = tail(x)
    return f"""({end} = '' OR {end} RLIKE {raw('([.!?…]|[.]["' + chr(39) + '])$')})"""


def new_paragraph(x: str) -> str:
    """Blank, a numbered or bulleted item, or a label in capitals."""
    text = strip(x)
    pattern = r"(?U)^\d+[).][\s\x1C-\x1F]|^[" + BULLETS + r"][\s\x1C-\x1F]|^[A-Z0-9]{2,}$|^[A-Z][A-Z0-9\s\x1C-\x1F-]{4,}$"
    return f"({text} = '' OR {text} RLIKE {raw(pattern)})"


def continuation(x: str) -> str:
    """Looks like the middle of a sentence. Offered for filters; merging does not use it."""
    text = strip(x)
    closing = "^[" + CONTINUATION_PUNCTUATION.replace("]", r"\]") + "]"
    return f"""CASE WHEN {text} = '' THEN false
        WHEN {text} RLIKE {raw(closing)} OR {text} RLIKE '^[a-z]' OR {text} RLIKE {raw(CONTINUATION_START)}
          OR {text} RLIKE {raw('^(' + '|'.join(CONTINUATION_PREFIXES) + ')')} THEN true
        WHEN {text} RLIKE {raw(r'(?U)^[0-9]+[).]')} THEN false
        ELSE {text} RLIKE {raw('^[가-힣]{1,2}[,.]')} END"""


def space_joiner(x: str) -> str:
    """Ends with something after which a wrapped line goes on with a space."""
    end = tail(x)
    suffix = "([" + SPACE_JOIN_PUNCTUATION.replace("]", r"\]") + SPACE_JOIN_PARTICLES + "]|" + "|".join(SPACE_JOIN_SUFFIXES) + ")$"
    return f"({end} = '' OR {end} RLIKE {raw(suffix)})"


def join_lines(a: str, b: str) -> str:
    """Two wrapped lines as one. An ASCII letter before an ASCII lower-case letter is glued without a space."""
    left, right, end, start = rstrip(a), lstrip(b), tail(a), f"left({lstrip(b)}, 1)"
    return f"""CASE WHEN {end} = '' THEN {right} WHEN {start} = '' THEN {left}
        WHEN {end} LIKE '%-' AND {start} RLIKE {raw(r'^\p{L}')} THEN concat(left({left}, length({left}) - 1), {right})
        WHEN {end} RLIKE '[가-힣]$' AND {start} RLIKE '^[가-힣]'
          THEN concat({left}, CASE WHEN {space_joiner(a)} THEN ' ' ELSE '' END, {right})
        WHEN {end} RLIKE '[A-Za-z]$' AND {start} RLIKE '^[a-z]' THEN concat({left}, {right})
        ELSE concat({left}, ' ', {right}) END"""


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Pieces that a fold appends to one list; a list is copied whenever it grows, so long runs are folded chunk by chunk.
CHUNK = 256


def folded(pieces: str, breaks: bool) -> str:
    """Stripped, non-empty pieces joined as wrapped lines are; with ``breaks``, paragraphs between them stay apart.

    The fold keeps the end of what it has joined, the last piece, and what came before,
    so it looks at each piece once, and copies none more than a few hundred times however many there are.
    """
    step = lambda end, piece: f"named_struct('end', right({end}, {TAIL}), 'line', t, 'out', concat(a.out, array({piece})))"
    hangul = "a.end RLIKE '[가-힣]$' AND t RLIKE '^[가-힣]'"
    apart = f"""WHEN {paragraph_ends('a.end')} AND {new_paragraph('t')} THEN {step('t', "concat(a.line, chr(10), chr(10))")}""" if breaks else ""
    none = "cast(array() AS array<string>)"
    chunk = f"""aggregate(chunk, named_struct('end', b.end, 'line', b.line, 'out', {none}), (a, t) -> CASE
        WHEN a.line IS NULL THEN named_struct('end', right(t, {TAIL}), 'line', t, 'out', a.out) {apart}
        WHEN a.end LIKE '%-' AND t RLIKE {raw(r'^\p{L}')} THEN {step("concat(left(a.end, length(a.end) - 1), t)", "left(a.line, length(a.line) - 1)")}
        WHEN {hangul} AND NOT {space_joiner('a.end')} OR a.end RLIKE '[A-Za-z]$' AND t RLIKE '^[a-z]' THEN {step("concat(a.end, t)", "a.line")}
        ELSE {step("concat(a.end, ' ', t)", "concat(a.line, ' ')")} END)"""
    after = bound(chunk, "a", "named_struct('end', a.end, 'line', a.line, 'out', concat(b.out, array(array_join(a.out, ''))))")
    chunks = f"transform(sequence(0, size(xs) div {CHUNK}), k -> slice(xs, cast(k * {CHUNK} + 1 AS int), {CHUNK}))"
    begin = f"named_struct('end', '', 'line', cast(NULL AS string), 'out', {none})"
    return bound(pieces, "xs", f"aggregate({chunks}, {begin}, (b, chunk) -> {after}, b -> array_join(concat(b.out, array(b.line)), ''))")


def reflow(x: str) -> str:
    """Wrapped lines joined into paragraphs, one fold per chunk between blank lines; no explode, no shuffle."""
    lines = f"filter(transform(split(part, chr(10), -1), t -> {strip('t')}), t -> t <> '')"
    parts = f"split({strip(x)}, {raw(r'(?U)\n[\s\x1C-\x1F]*\n+')}, -1)"
    return f"""CASE WHEN instr({x}, chr(10)) = 0 THEN {x}
        ELSE array_join(filter(transform({parts}, part -> {folded(lines, True)}), p -> p <> ''), concat(chr(10), chr(10))) END"""


def join_all(pieces: str) -> str:
    """The pieces of one paragraph, none of them blank, as one line; the first keeps its space in front, the last its space behind."""
    inner = f"transform(ps, (t, i) -> CASE WHEN i = 0 THEN {rstrip('t')} WHEN i = size(ps) - 1 THEN {lstrip('t')} ELSE {strip('t')} END)"
    return bound(pieces, "ps", folded(inner, False))


def strip_comments(x: str) -> str:
    """JSON with ``//`` and ``/* */`` comments, without them: their line breaks stay, else a space does; strings are left alone.

    The text is cut into strings, comments and what lies between, each read once; a string
    or comment without an end goes on to the end.
    """
    string = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\\?\z)'
    piece = raw(string + r"|//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)|[^\"/]++|/")
    breaks = "repeat(chr(10), length(t) - length(replace(t, chr(10), '')))"
    return f"array_join(transform(regexp_extract_all({x}, {piece}, 0), t -> CASE WHEN startswith(t, '//') OR startswith(t, '/*') THEN coalesce(nullif({breaks}, ''), ' ') ELSE t END), '')"


def chapter_marker(x: str) -> str:
    return f"({first_line(x)} RLIKE {raw(r'(?U)^\d+\s*장$')})"


def back_matter_heading(x: str) -> str:
    return f"(lower({first_line(x)}) IN ({', '.join(map(literal, BACK_MATTER))}))"


def section_number(x: str) -> str:
    return f"({strip(x)} RLIKE {raw(r'(?U)^\d{1,2}[.]?$')})"


def slug_tail(x: str) -> str:
    """A slug from text that is lower-cased and NFKC-normalised."""
    kept = f"regexp_replace({x}, {raw(r'(?U)[^\w\s-]')}, '')"
    dashed = f"regexp_replace({kept}, {raw(r'(?U)[\s_]+')}, '-')"
    return f"coalesce(nullif(trim(BOTH '-' FROM {dashed}), ''), 'section')"
