"""Main text of HTML pages by tag-path ratios.

A page is cut into text nodes, each with its root-to-leaf tag path.  Inline tags count to
their block's path, and the blocks of a list or table to the path of the list: a run of
short items is judged as one.  Per path, text length and punctuation are summed and
divided by the number of its blocks, the two ratios are smoothed over neighbouring
blocks and fused by their geometric mean, and a path is content where the mean over its
blocks reaches a share of the page's length-weighted mean.  All blocks of a content path
stay, and so do the others of a container whose text is mostly content, unless they are
links or furniture.

Tags, class names and link texts are bounded factors of a path's score (``FACTORS``,
``LINK``), none decides alone: a menu, footer or advert is told apart by its ratios, with
a factor just above the threshold; what reads like prose and is not the article's
(comments, side columns, related matter), as no ratio tells it apart, has one below.
Only script, style, head, template and the like are never text.  A heading takes the
ratios of the text after it.

Defined cases: null html is the empty page; a page without content gives the empty
text; unclosed tags, implied paragraph ends, stray end tags and comments follow the
usual recovery; a tag that never ends hides what follows; a quote without an end is an
ordinary sign; elements nested deeper than 512 count to their parent; repeated rows give
equal rows; an empty table gives an empty result; other columns are ignored.  Work is
linear in the page.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm.shared import bound_batches, table

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"""[>"']""")
_HINTS = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?。，、…]")

# Element classes of the HTML standard, and common names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NO_TEXT = frozenset("head script style noscript template title iframe object svg canvas datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table menu select".split())
CONTAINERS = frozenset("body div section article main aside nav header footer form fieldset dialog html".split())
#: Their names are never looked at.
TEXTUAL = frozenset("html body article main p pre blockquote dt dd figcaption caption address".split()) | HEADINGS | INLINE
#: Told apart by ratios, and what reads like prose.
SHORT_TAGS = frozenset("nav header footer form button select menu fieldset option dialog".split())
PROSE_TAGS = frozenset(("aside",))
SHORT_NAMES = frozenset("ad ads advert advertisement adverts banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer cookie cookies consent notice popup modal newsletter subscribe share social widget pagination toolbar form search login".split())
PROSE_NAMES = frozenset("sponsor sponsored promo sidebar aside comment comments disqus respond related".split())
#: An open paragraph or item ends where one of these begins.
ENDS_P = frozenset("p div ul ol li dl table section article h1 h2 h3 h4 h5 h6 blockquote pre form hr main nav header footer aside figure".split())
BOUNDARY = frozenset("body div section article main td th table ul ol blockquote aside nav header footer form figure html".split())
MOST_NESTED = 512

#: Factors of a path's score: of a link's text, of furniture that is short, of furniture that is prose, of a name that merely contains one.
LINK, SHORT, PROSE, HINTED = 0.2, 0.8, 0.3, 0.9
SHARE = 0.7
#: Characters of a page under which factors weigh more than once and again.
LITTLE = 1200


class Node:
    __slots__ = ("path", "text", "block", "unit", "container", "factor", "link", "heading")

    def __init__(self, path: int, text: str, block: int, unit: int, container: int, factor: float, link: bool, heading: bool):
        self.path, self.text, self.block, self.unit, self.container, self.factor, self.link, self.heading = path, text, block, unit, container, factor, link, heading


def tags(html: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, name, attributes) of each tag in order, end tags with a slash; a comment has no name."""
    at, last = 0, {q: html.rfind(q) for q in "\"'"}
    while (start := html.find("<", at)) >= 0:
        name = _NAME.match(html, start + 1)
        if name is None:
            if html.startswith("<!--", start):
                close = html.find("-->", start + 4)
                at = len(html) if close < 0 else close + 3
            elif html.startswith(("<!", "<?"), start):
                close = html.find(">", start)
                at = len(html) if close < 0 else close + 1
            else:
                at = start + 1
                continue
            yield start, at, "", ""
            continue
        stop = _STOP.search(html, name.end())
        while stop and stop[0] != ">":
            if stop.start() == last[stop[0]]:  # no end: an ordinary sign
                stop = re.compile(">").search(html, name.end())
                break
            stop = _STOP.search(html, html.find(stop[0], stop.end()) + 1)
        at = stop.end() if stop else len(html)
        yield start, at, name[0].lower(), html[name.end():stop.start()] if stop else ""


def factor_of(tag: str, attributes: str) -> tuple[float, str]:
    """An element's factor, and the name that it is known by in paths."""
    factor = PROSE if tag in PROSE_TAGS else SHORT if tag in SHORT_TAGS else 1.0
    known = tag
    if tag not in TEXTUAL and "=" in attributes:
        for a, b, c in _HINTS.findall(attributes):
            value = (a or b or c).lower()
            whole = set(value.split())
            for names, its in ((PROSE_NAMES, PROSE), (SHORT_NAMES, SHORT)):
                if not names.isdisjoint(whole):
                    factor, known = min(factor, its), f"{known}.{min(names & whole)}"
            if factor == 1 and not (SHORT_NAMES | PROSE_NAMES).isdisjoint(_WORD.findall(value)):
                factor, known = HINTED, f"{known}.hinted"
    return factor, known


def text_nodes(html: str) -> tuple[list[Node], dict[int, int]]:
    """The page's text nodes in order, and the parents of containers below the body.

    Nodes of one block share a block number, and those of one list or table a unit.
    """
    nodes: list[Node] = []
    parents: dict[int, int] = {}
    # Open elements: (tag, path, path that its texts count to, unit or 0, container, factor, in a link, never text); a path is numbered by its parent's and the element.
    stack: list[tuple] = [("", 0, 0, 0, 0, 1.0, False, False)]
    paths: dict[tuple[int, str], int] = {}
    opened: Counter[str] = Counter()

    def close_from(k: int) -> None:
        for name, *_ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    def add(start: int, stop: int) -> None:
        _, _, path, unit, container, factor, link, hidden = stack[-1]
        if stop > start and not hidden:
            nodes.append(Node(path, html[start:stop], block, unit or block, container, factor, link, any(opened[h] for h in HEADINGS)))

    block, done, places = 0, 0, itertools.count(1)
    for start, end, tag, attributes in tags(html):
        if start < done:
            continue
        add(done, start)
        done = end
        if not tag:
            continue
        closing = tag[0] == "/"
        tag = tag.lstrip("/")
        if tag not in INLINE:
            block = next(places)
        if closing:
            if opened[tag]:
                close_from(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in ENDS_P and (opened["p"] or opened["li"]):
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k][0]
                if open_tag == "p" or (open_tag == "li" and tag == "li"):
                    close_from(k)
                    break
                if open_tag in BOUNDARY:
                    break
        if tag in VOID or attributes.endswith("/") or len(stack) > MOST_NESTED:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, done)
            done = close.end() if close else len(html)
            continue
        _, path, counted, unit, container, factor, link, hidden = stack[-1]
        if tag not in INLINE:
            its, known = factor_of(tag, attributes)
            factor = min(factor, its)
            path = paths.setdefault((path, known), len(paths) + 1)
            if tag in CONTAINERS:
                if tag not in ("body", "html"):
                    parents[block] = container
                container, unit = block, 0
            if not unit:
                counted = path
                if tag in LISTS:
                    unit = block
        opened[tag] += 1
        stack.append((tag, path, counted, unit, container, factor, link or tag == "a", hidden or tag in NO_TEXT))
    add(done, len(html))
    return nodes, parents


def path_ratios(nodes: list[Node]) -> dict[int, tuple[float, float, float]]:
    """Text length and one plus punctuation of each path, per block (or list), and its whole text length."""
    sums: dict[int, list[float]] = {}
    last: dict[int, int] = {}
    for n in nodes:
        s = sums.setdefault(n.path, [0, 0, 0])
        s[0] += last.get(n.path) != n.unit
        s[1] += len(n.text)
        s[2] += len(_PUNCTUATION.findall(n.text))
        last[n.path] = n.unit
    return {p: (chars / count, 1 + signs / count, chars) for p, (count, chars, signs) in sums.items()}


def smoothed(values: list[float]) -> list[float]:
    return [(a + 4 * b + c) / 6 for a, b, c in zip([values[0], *values[:-1]], values, [*values[1:], values[-1]])]


def content_units(nodes: list[Node], parents: dict[int, int], ratios: dict[int, tuple[float, float, float]]) -> set[int]:
    """Units (blocks and lists) of the content, from the ratios of the paths of non-blank nodes."""
    runs = [list(run) for _, run in itertools.groupby(nodes, key=lambda n: n.unit)]
    sizes = [sum(len(n.text) for n in run) for run in runs]
    linked = [sum(len(n.text) for n in run if n.link) for run in runs]
    features = []
    for k in range(3):
        raw = [sum(len(n.text) * ratios[n.path][k] for n in run) / z for run, z in zip(runs, sizes)]
        headed = 0.0
        for i in range(len(runs) - 1, -1, -1):
            if runs[i][0].heading:
                raw[i] = max(raw[i], headed)
            else:
                headed = raw[i]
        features.append(smoothed(raw))
    # Ratios of little text say little, so factors weigh more there.
    weight = 1 + (LITTLE / sum(sizes)) ** 2
    fused = [a * b * c * run[0].factor ** weight * (1 - (1 - LINK) * x / z) for a, b, c, run, x, z in zip(*features, runs, linked, sizes)]
    least = SHARE * sum(s * z for s, z in zip(fused, sizes)) / sum(sizes)
    mass: dict[int, list[float]] = {}
    for run, s, z in zip(runs, fused, sizes):
        m = mass.setdefault(run[0].path, [0, 0])
        m[0] += s * z
        m[1] += z
    chosen = {p for p, (m, z) in mass.items() if m / z >= least}
    # In a container that is mostly content, itself or with what is nested in it, the rest stays, too.
    own: dict[int, list[int]] = {}
    for run, z in zip(runs, sizes):
        h = own.setdefault(run[0].container, [0, 0])
        h[0] += z * (run[0].path in chosen)
        h[1] += z
    nested = {c: list(own.get(c, (0, 0))) for c in {*own, *parents}}
    for c in sorted(parents, reverse=True):  # inner containers have larger numbers
        for k in range(2):
            nested.setdefault(parents[c], [0, 0])[k] += nested[c][k]
    mostly = {c for c in own if 2 * own[c][0] >= own[c][1] or c in parents and 2 * nested[c][0] >= nested[c][1]}
    return {run[0].unit for run, x, z in zip(runs, linked, sizes) if run[0].path in chosen or run[0].factor == 1 and 2 * x < z and run[0].container in mostly}


def main_text(html: str | None) -> str:
    nodes, parents = text_nodes(html or "")
    for n in nodes:
        if "&" in n.text:
            n.text = unescape(n.text)
    filled = [n for n in nodes if n.text.strip()]
    if not filled:
        return ""
    kept = content_units(filled, parents, path_ratios(filled))
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if n.unit in kept:
            blocks.setdefault(n.block, []).append(n.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, key: str = "page_id", kept: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, kept..., text, n_chars) for each row."""
    bound_batches(pages.sparkSession)
    fields = [pages.schema[c] for c in (key, *kept)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             [*batch.schema.names[:-1], "text", "n_chars"])

    return pages.select(key, *kept, "html").mapInArrow(run, f"{schema}, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
