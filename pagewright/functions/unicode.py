"""Unicode foldings that Spark has no function for, as SQL on arrays of code points; tables come from Python's Unicode data by rule."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pagewright.functions.text import CHUNK, bound, literal

#: Code points of a table's page: a lookup is two array accesses.
PAGE = 64


def characters(x: str) -> str:
    """SQL for the code points of a text, as strings."""
    return f"regexp_extract_all({x}, '(?s).', 0)"


def entry(entries: dict[int, str], c: str) -> str:
    """SQL for the entry of code point ``c`` (a number), or null.

    The table is two constant arrays, folded once by the optimizer: where each page
    begins, and the entries of the pages that have any.
    """
    used = sorted({k // PAGE for k in entries})
    begins = literal(",".join(str(used.index(page) * PAGE) if page in set(used) else "-999" for page in range(used[-1] + 1)))
    held = literal("\x02".join(entries.get(page * PAGE + i, "") for page in used for i in range(PAGE)))
    at = f"cast(get(split({begins}, ',', -1), cast({c} div {PAGE} AS int)) AS int)"
    return f"nullif(get(split({held}, '\x02', -1), {at} + cast({c} % {PAGE} AS int)), '')"


@functools.cache
def folding_table() -> dict[int, str]:
    """What case folding makes of the letters that lower case leaves as they are."""
    return {c: f for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (f := chr(c).casefold()) != chr(c) and chr(c).lower() == chr(c)}


def casefold(x: str) -> str:
    """SQL for full case folding: lower case, then the letters that differ from it."""
    table = folding_table()
    odd = "[" + "".join(f"\\\\x{{{c:x}}}" for c in sorted(table)) + "]"
    mapped = f"array_join(transform({characters('low')}, c -> coalesce({entry(table, 'ascii(c)')}, c)), '')"
    return bound(f"lower({x})", "low", f"CASE WHEN low RLIKE '{odd}' THEN {mapped} ELSE low END")


# The arithmetic of Hangul syllables.
S, L, V, T_, N_V, N_T, N_S = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28, 11172


def char_of(code: str) -> str:
    """SQL for the character of a code point."""
    return f"decode(unhex(lpad(hex(cast({code} AS bigint)), 8, '0')), 'UTF-32')"


@functools.cache
def decompositions() -> dict[int, str]:
    """Full compatibility decompositions, but for Hangul syllables, which are computed."""
    return {c: d for c in range(sys.maxunicode + 1) if not (0xD800 <= c < 0xE000 or S <= c < S + N_S) and (d := unicodedata.normalize("NFKD", chr(c))) != chr(c)}


@functools.cache
def classes() -> dict[int, str]:
    """Canonical combining classes that are not 0."""
    return {c: str(k) for c in range(sys.maxunicode + 1) if (k := unicodedata.combining(chr(c)))}


@functools.cache
def compositions() -> dict[int, str]:
    """For each first code point of a primary composite, its seconds and what they make: pairs of second and composite."""
    found: dict[int, str] = {}
    for c in range(sys.maxunicode + 1):
        d = unicodedata.decomposition(chr(c))
        if d and not d.startswith("<") and len(d.split()) == 2 and unicodedata.normalize("NFC", chr(c)) == chr(c):
            first, second = (int(x, 16) for x in d.split())
            found[first] = found.get(first, "") + chr(second) + chr(c)
    return found


#: Code points that normalisation leaves alone are looked for at once in the widest ranges, and in all below NEAR (Latin to Cyrillic); others take the longer way.
WIDE, NEAR = 64, 0x588


def chunkwise(items: str, begin: str, step: str, end: str) -> str:
    """SQL for a fold of an array chunk by chunk: ``step`` makes the next ``b`` of ``b`` and ``chunk``, ``end`` the result of the last."""
    chunks = f"transform(sequence(0, size(xs) div {CHUNK}), k -> slice(xs, cast(k * {CHUNK} + 1 AS int), {CHUNK}))"
    return bound(items, "xs", f"aggregate({chunks}, {begin}, (b, chunk) -> {step}, b -> {end})")


def ranges(points: set[int]) -> str:
    """The inside of a regex class of these code points."""
    found: list[list[int]] = []
    for c in sorted(points):
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"\\\\x{{{a:x}}}-\\\\x{{{b:x}}}" for a, b in found)


@functools.cache
def pieces() -> tuple[str, str]:
    """Regexes of the pieces of a text that are normalised apart, and of pieces that stay as they are.

    A code point that begins with a mark, or that may be composed with what stands before it,
    belongs to the piece before; everywhere else a text may be cut.  Most code points stay as
    they are: the widest ranges of these make pieces of any length.
    """
    seconds = {ord(x) for made in compositions().values() for x in made[::2]} | set(range(V, V + N_V)) | set(range(T_ + 1, T_ + N_T))
    first = lambda c: ord(decompositions().get(c, chr(c))[0])
    bound_ = {c for c in {*decompositions(), *classes(), *seconds} if first(c) in seconds or first(c) in classes()}
    # Unassigned code points have no entry, and surrogates no place in a text.
    changed = {c for c in decompositions() if unicodedata.normalize("NFKC", chr(c)) != chr(c)} | bound_
    edges = [-1, *sorted(changed | set(range(0xD800, 0xE000))), sys.maxunicode + 1]
    stays = [(a + 1, b - 1) for a, b in zip(edges, edges[1:]) if b - a > 1]
    wide = sorted(sorted(stays, key=lambda r: r[0] - r[1])[:WIDE])
    near, far = ([r for r in of if (r[0] < NEAR) == close and r[1] > 0x7F] for of, close in ((stays, True), (wide, False)))
    inside = lambda of: "".join(f"\\\\x{{{max(a, 0x80):x}}}-\\\\x{{{b:x}}}" for a, b in of)
    plain = f"[\\\\x00-\\\\x7f[{inside(near)}][{inside(far)}]]"
    return f"{plain}+(?![{ranges(bound_)}])|(?s).[{ranges(bound_)}]*", f"^{plain}*$"


def nfkc(x: str) -> str:
    """SQL for NFKC, piece by piece: what stays as it is in one step, other pieces decomposed, their marks ordered, and composed.

    A piece is one code point with what may be composed with it, so work grows with the text; the marks of a piece are folded in chunks.
    """
    syllable = f"ascii(c) - {S}"
    jamo = (f"concat({char_of(f'{L} + i div {N_V * N_T}')}, {char_of(f'{V} + (i % {N_V * N_T}) div {N_T}')}, "
            f"CASE WHEN i % {N_T} > 0 THEN {char_of(f'{T_} + i % {N_T}')} ELSE '' END)")
    decomposed = f"CASE WHEN ascii(c) BETWEEN {S} AND {S + N_S - 1} THEN {bound(syllable, 'i', jamo)} ELSE coalesce({entry(decompositions(), 'ascii(c)')}, c) END"
    spread = characters(f"array_join(transform({characters('p')}, c -> {decomposed}), '')")
    # Marks move within their run: a run begins at each code point of class 0.
    ranked = f"transform(cs, (c, i) -> named_struct('c', c, 'k', coalesce(cast({entry(classes(), 'ascii(c)')} AS int), 0), 'i', i))"
    run = "named_struct('run', CASE WHEN r.k = 0 THEN a.run + 1 ELSE a.run END, 'out', concat(a.out, array(named_struct('run', CASE WHEN r.k = 0 THEN a.run + 1 ELSE a.run END, 'k', r.k, 'i', r.i, 'c', r.c))))"
    none = "cast(array() AS array<struct<run:int,k:int,i:int,c:string>>)"
    begin = f"named_struct('run', 0, 'out', array({none}))"
    runs = bound(f"aggregate(chunk, named_struct('run', b.run, 'out', {none}), (a, r) -> {run})", "a", "named_struct('run', a.run, 'out', concat(b.out, array(a.out)))")
    ordered = f"array_sort(flatten({chunkwise(ranked, begin, runs, 'b.out')}))"
    # Composing looks at the last starter, what stands since, and the class before.
    pair = bound(f"instr(coalesce({entry(compositions(), 'ascii(a.starter)')}, ''), r.c)", "at", "CASE WHEN at % 2 = 1 THEN substring(" + entry(compositions(), "ascii(a.starter)") + ", at + 1, 1) END")
    pair_made = char_of(f"{S} + ((ascii(a.starter) - {L}) * {N_V} + ascii(r.c) - {V}) * {N_T}")
    hangul = f"""CASE WHEN ascii(a.starter) BETWEEN {L} AND {L + 18} AND ascii(r.c) BETWEEN {V} AND {V + 20} THEN {pair_made}
        WHEN ascii(a.starter) BETWEEN {S} AND {S + N_S - 1} AND (ascii(a.starter) - {S}) % {N_T} = 0 AND ascii(r.c) BETWEEN {T_ + 1} AND {T_ + 27} THEN {char_of(f'ascii(a.starter) + ascii(r.c) - {T_}')} ELSE {pair} END"""
    joined = f"CASE WHEN a.starter = '' OR NOT (a.bare OR a.last < r.k AND a.last > 0) THEN NULL ELSE {hangul} END"
    grown = "named_struct('done', {}, 'starter', {}, 'since', {}, 'bare', {}, 'last', {})"
    step = bound(joined, "made", f"""CASE WHEN made IS NOT NULL THEN {grown.format('a.done', 'made', 'a.since', 'a.bare', 'a.last')}
        WHEN r.k = 0 THEN {grown.format("concat(a.done, array(a.starter), a.since)", 'r.c', "cast(array() AS array<string>)", 'true', '0')}
        ELSE {grown.format('a.done', 'a.starter', 'concat(a.since, array(r.c))', 'false', 'r.k')} END""")
    start = "named_struct('done', cast(array() AS array<string>), 'starter', '', 'since', cast(array() AS array<string>), 'bare', true, 'last', 0)"
    # The starter may still be composed, so what is done and what stands since are kept apart, each joined into one text a chunk.
    shut = "named_struct('done', array(array_join(a.done, '')), 'starter', a.starter, 'since', array(array_join(a.since, '')), 'bare', a.bare, 'last', a.last)"
    composed = chunkwise(ordered, start, bound(f"aggregate(chunk, b, (a, r) -> {step})", "a", shut), "array_join(concat(b.done, array(b.starter), b.since), '')")
    whole = bound(spread, "cs", composed)
    piece, plain = pieces()
    return bound(x, "x", f"CASE WHEN x RLIKE '{plain}' THEN x ELSE array_join(transform(regexp_extract_all(x, '{piece}', 0), p -> CASE WHEN p RLIKE '{plain}' THEN p ELSE {whole} END), '') END")
