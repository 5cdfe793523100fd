"""Page sections: preparing headings, merging paragraphs within a page and across pages.

Pages are rows (book, page_num, sections array<struct<type,text>>).  What concerns one
page is a fold over its own array and needs no shuffle.  What depends on the pages before
is scanned in parallel over blocks of a book's pages: each block is summed up, the blocks
of a book are scanned, and each block is finished from where it starts.  So no row and
no task holds a book, however long it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions.text import bound
from pagewright.scratch import cut

SECTION = "struct<type:string,text:string>"
SECTIONS = f"array<{SECTION}>"
SKIPPED = "('header', 'page_number')"


def content(sections: str) -> str:
    """Sections other than running heads and page numbers."""
    return f"filter({sections}, s -> s.type NOT IN {SKIPPED})"


def has_text(sections: str) -> str:
    return f"exists({content(sections)}, s -> {T.strip('s.text')} <> '')"


def merges(a: str, b: str) -> str:
    """Two neighbouring sections are one paragraph."""
    return f"({a}.type = 'body' AND {b}.type = 'body' AND NOT {T.paragraph_ends(a + '.text')} AND NOT {T.new_paragraph(b + '.text')})"


def runs(items: str, begins: Callable[[str], str], build: Callable[[str], str], kind: str) -> str:
    """SQL for the runs of an array, each turned into one value: a run starts where ``begins`` holds of ``xs`` and place ``i``.

    Every item is looked at once, so work is linear; each array is bound to a name, so none is computed twice.
    """
    run = bound("slice(xs, b + 1, coalesce(get(st, k + 1), size(xs)) - b)", "x", build("x"))
    starts = f"filter(sequence(0, size(xs) - 1), i -> i = 0 OR {begins('i')})"
    return bound(items, "xs", f"CASE WHEN size(xs) < 1 THEN cast(array() AS array<{kind}>) ELSE {bound(starts, 'st', f'transform(st, (b, k) -> {run})')} END")


def one_section(run: str) -> str:
    """A run of sections as one: a paragraph joined of its bodies, or the only section as it is."""
    return f"""CASE WHEN size({run}) = 1 THEN named_struct('type', {run}[0].type, 'text', {run}[0].text)
        ELSE named_struct('type', 'body', 'text', {T.join_all(f'transform({run}, s -> s.text)')}) END"""


def reflow_sections(sections: str) -> str:
    return f"transform({sections}, s -> named_struct('type', s.type, 'text', CASE WHEN s.type = 'body' THEN {T.reflow('s.text')} ELSE s.text END))"


def merge_within(sections: str) -> str:
    """Runs of body sections that one paragraph was split into, joined.

    A joined text ends as its last piece does, so each break is decided from two neighbours.
    """
    return runs(sections, lambda i: f"NOT coalesce({merges(f'get(xs, {i} - 1)', f'get(xs, {i})')}, false)", one_section, SECTION)


def prepare(sections: str) -> str:
    """Numbers attached to titles, titles that start no chapter made section titles, running heads dropped.

    Only titles are consumed and only numbers consume, so each place is decided from its neighbours.
    The array is bound to a name: the optimizer may put its expression wherever it is read, and it is read at every place.
    """
    at = lambda k: f"get(xs, i + {k})" if k else "get(xs, i)"
    number = lambda s: f"({s}.type IN {SKIPPED} AND {T.section_number(s + '.text')})"
    here, before, after = at(0), at(-1), at(1)
    made = lambda kind, text: f"named_struct('type', {kind}, 'text', {text})"
    number_text = f"regexp_replace({T.strip(here + '.text')}, '[.]+$', '')"
    numbered = f"concat({number_text}, '. ', {T.flat(after + '.text')})"
    stripped = T.strip(here + ".text")
    subtitle = (f"({stripped} <> '' AND length({stripped}) <= 60 AND length({stripped}) - length(replace({stripped}, chr(10), '')) <= 1 "
                f"AND coalesce({after}.type IN ('body', 'figure'), true))")
    made_of = f"""filter(transform(CASE WHEN size(xs) = 0 THEN cast(array() AS array<int>) ELSE sequence(0, size(xs) - 1) END, i -> CASE
        WHEN {number(here)} THEN CASE WHEN {after}.type = 'title' THEN {made("'section_title'", numbered)} END
        WHEN {here}.type = 'title' AND i > 0 AND {number(before)} THEN NULL
        WHEN {here}.type = 'title' AND NOT {T.chapter_marker(here + '.text')} THEN {made("'section_title'", T.flat(here + '.text'))}
        WHEN {here}.type IN {SKIPPED} THEN NULL
        WHEN {here}.type = 'other' AND {subtitle} THEN {made("'subtitle'", stripped)}
        ELSE {here} END), s -> s IS NOT NULL)"""
    return bound(sections, "xs", made_of)


#: Page numbers of a block.
BLOCK = 1024


def bits(first: str) -> str:
    """SQL for the bits of a block's pages ``xs``, that of its first page being ``first``."""
    step = "CASE WHEN NOT x.joins OR NOT a.tail.open_body THEN false WHEN a.tail.open_all THEN true ELSE a.bit END"
    grown = bound(step, "m", "named_struct('tail', named_struct('open_all', x.open_all, 'open_body', x.open_body), 'bit', m, 'out', concat(a.out, array(m)))")
    begin = f"named_struct('tail', named_struct('open_all', xs[0].open_all, 'open_body', xs[0].open_body), 'bit', {first}, 'out', array({first}))"
    return f"aggregate(slice(xs, 2, size(xs)), {begin}, (a, x) -> {grown}, a -> a.out)"


def owners(start: str, pulled: str) -> str:
    """SQL for the page that owns what each page of ``xs`` pulls back, and at last what the page after it would."""
    own = f"(CASE WHEN {pulled}[i] THEN xs[i].n_body - 1 ELSE xs[i].n_all END)"
    return f"aggregate(sequence(0, size(xs) - 1), array({start}), (a, i) -> concat(a, array(CASE WHEN {own} > 0 THEN xs[i].id ELSE element_at(a, -1) END)))"


def pulled_pages(pages: DataFrame) -> DataFrame:
    """(id, pulled, owner) of pages with content: is the first content section pulled back, and onto which page.

    ``pages`` carry joins (the first content section may go on with a paragraph), open_all and
    open_body (the last section, or content section, is an open paragraph), n_all and n_body.
    A page's bit depends on the page before by one bit, its own: it says which tail counts.  So a
    block of pages is a function of the bit of its first page, given by its results for both; a book
    composes its blocks' functions, one narrow entry a block, and each block then takes its own case.
    A page that keeps a section of its own owns what is pulled back from the pages after it.
    """
    tie = [c for c in ("file_name",) if c in pages.columns]
    page = F.struct("page_num", *tie, "id", "joins", "open_all", "open_body", "n_all", "n_body")
    blocks = pages.groupBy("book", "block").agg(F.array_sort(F.collect_list(page)).alias("xs"))
    blocks = blocks.withColumn("off", F.expr(bits("false"))).withColumn("on", F.expr(bits("true")))
    for case in ("off", "on"):
        blocks = blocks.withColumn(f"owners_{case}", F.expr(owners("cast(NULL AS bigint)", case)))
    outcome = lambda case: f"named_struct('bit', element_at({case}, -1), 'owner', element_at(owners_{case}, -1))"
    facts = blocks.select("book", F.expr(f"""named_struct('block', block, 'joins', xs[0].joins, 'tail', named_struct('open_all', element_at(xs, -1).open_all, 'open_body', element_at(xs, -1).open_body),
        'off', {outcome('off')}, 'on', {outcome('on')})""").alias("fact"))
    # The state between blocks: tail of the block before, its last bit, and the owner so far.
    begin = "cast(named_struct('tail', NULL, 'bit', false, 'owner', NULL, 'out', array()) AS struct<tail:struct<open_all:boolean,open_body:boolean>,bit:boolean,owner:bigint,out:array<struct<block:bigint,bit:boolean,owner:bigint>>>)"
    first = "coalesce(CASE WHEN NOT b.joins OR NOT a.tail.open_body THEN false WHEN a.tail.open_all THEN true ELSE a.bit END, false)"
    moved = bound("CASE WHEN m THEN b.on ELSE b.off END", "c", "named_struct('tail', b.tail, 'bit', c.bit, 'owner', coalesce(c.owner, a.owner), 'out', concat(a.out, array(named_struct('block', b.block, 'bit', m, 'owner', a.owner))))")
    starts = facts.groupBy("book").agg(F.array_sort(F.collect_list("fact")).alias("facts")).select(
        "book", F.expr(f"inline(aggregate(facts, {begin}, (a, b) -> {bound(first, 'm', moved)}, a -> a.out))"))
    placed = blocks.join(starts, ["book", "block"]).withColumn("pulled", F.expr("CASE WHEN bit THEN on ELSE off END"))
    listed = F.expr("""inline(transform(xs, (x, i) -> named_struct('id', x.id, 'pulled', pulled[i],
        'own', CASE WHEN pulled[i] THEN x.n_body - 1 ELSE x.n_all END, 'owner', coalesce(CASE WHEN bit THEN owners_on[i] ELSE owners_off[i] END, owner))))""")
    return placed.select(listed)


def merge_across(pages: DataFrame) -> DataFrame:
    """Pages (book, page_num, file_name if given, id, sections) with paragraphs that a page break split joined onto the earlier page.

    A page whose first content section is pulled back keeps only its content; a page
    without content goes; any other page stays as it is, running heads included, and a
    running head at its end keeps the next page's text from being pulled back.
    """
    open_ = lambda s: f"coalesce({s}.type = 'body' AND NOT {T.paragraph_ends(s + '.text')}, false)"
    tie = [c for c in ("file_name",) if c in pages.columns]
    kept = pages.select("book", "page_num", *tie, "sections", F.expr(content("sections")).alias("body")).where("size(body) > 0")
    facts = kept.select(
        "book", "page_num", *tie, "sections", "body", F.expr(f"cast(floor(page_num / {BLOCK}) AS bigint)").alias("block"),
        F.expr(f"body[0].type = 'body' AND NOT {T.new_paragraph('body[0].text')}").alias("joins"),
        F.expr(open_("element_at(sections, -1)")).alias("open_all"), F.expr(open_("element_at(body, -1)")).alias("open_body"),
        F.expr("size(sections)").alias("n_all"), F.expr("size(body)").alias("n_body"), F.monotonically_increasing_id().alias("id"))
    # Written once: what follows reads the texts once and the facts a few times, with ids that stay.
    facts = cut(facts)
    rows = facts.select("id", "book", "page_num", *tie, "sections", "body").join(pulled_pages(facts), "id")
    # A page's row goes to itself, a piece that is pulled back to the page that owns it.
    order = F.struct("page_num", *tie, "id")
    itself = F.when(F.col("own") > 0, F.struct(F.col("id").alias("to"), F.lit(None).cast("string").alias("piece"), F.expr("CASE WHEN pulled THEN slice(body, 2, size(body)) ELSE sections END").alias("rest")))
    sent = F.when(F.col("pulled"), F.struct(F.col("owner").alias("to"), F.expr("body[0].text").alias("piece"), F.lit(None).cast(SECTIONS).alias("rest")))
    parts = rows.select("book", order.alias("place"), F.explode(F.filter(F.array(itself, sent), lambda x: x.isNotNull())).alias("p")).select("book", "place", "p.*")
    merged = parts.groupBy("book", "to").agg(
        F.min("place").alias("place"), F.max("rest").alias("sections"), F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("place", "piece")))).alias("pieces"))
    last = "element_at(sections, -1)"
    joined = f"named_struct('type', 'body', 'text', {T.join_all(f'concat(array({last}.text), transform(pieces, x -> x.piece))')})"
    grown = f"CASE WHEN size(pieces) = 0 THEN sections ELSE concat(slice(sections, 1, size(sections) - 1), array({joined})) END"
    return merged.select("book", *(F.col(f"place.{c}").alias(c) for c in ("page_num", *tie, "id")), F.expr(grown).alias("sections"))


def normalize(pages: DataFrame) -> DataFrame:
    """Pages with bodies reflowed, then merged within and across pages."""
    reflowed = pages.withColumn("sections", F.expr(reflow_sections("sections"))).withColumn("sections", F.expr(merge_within("sections")))
    return merge_across(reflowed)
