"""Tag-path ratios: against a plain version, and alone, on pages whose tags and names say nothing."""

import html
import math
import random
import re

import pyarrow.parquet as pq
import pytest

from pagewright.llm import html_text

PAGES = [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    lines = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner))
    return "\n".join(x for x in lines if x)


def bare(page):
    """All sectioning tags as div, no class, id or role."""
    page = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section|form)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def plain_ratios(nodes):
    """Ratios by path from dictionaries of blocks."""
    out = {}
    for path in {n.path for n in nodes}:
        own = [n for n in nodes if n.path == path]
        blocks = len({n.unit for n in own})
        text = "".join(n.text for n in own)
        out[path] = (len(text) / blocks, 1 + sum(c in ".,;:!?。，、…" for c in text) / blocks, len(text))
    return out


def plain_selection(nodes, parents, ratios):
    """Blocks and lists of the content, one rule after the other, from the docstring."""
    units = []
    for n in nodes:
        if not units or units[-1] != n.unit:
            units.append(n.unit)
    of = {u: [n for n in nodes if n.unit == u] for u in units}
    size = {u: sum(len(n.text) for n in of[u]) for u in units}
    link = {u: sum(len(n.text) for n in of[u] if n.link) for u in units}
    score = dict.fromkeys(units, 1.0)
    for k in range(3):
        value = {u: sum(len(n.text) * ratios[n.path][k] for n in of[u]) / size[u] for u in units}
        for i, u in enumerate(units):
            if of[u][0].heading:
                after = [w for w in units[i + 1:] if not of[w][0].heading]
                value[u] = max(value[u], sum(len(n.text) * ratios[n.path][k] for n in of[after[0]]) / size[after[0]] if after else 0)
        for i, u in enumerate(units):
            score[u] *= (value[units[max(i - 1, 0)]] + 4 * value[u] + value[units[min(i + 1, len(units) - 1)]]) / 6
    total = sum(size.values())
    for u in units:
        score[u] *= of[u][0].factor ** (1 + (html_text.LITTLE / total) ** 2) * (1 - (1 - html_text.LINK) * link[u] / size[u])
    least = html_text.SHARE * sum(score[u] * size[u] for u in units) / total
    chosen = set()
    for path in {of[u][0].path for u in units}:
        own = [u for u in units if of[u][0].path == path]
        if sum(score[u] * size[u] for u in own) / sum(size[u] for u in own) >= least:
            chosen |= set(own)

    def within(u, container):
        c = of[u][0].container
        while c != container and c in parents:
            c = parents[c]
        return c == container

    def mostly(container):
        for own in ([u for u in units if of[u][0].container == container], [u for u in units if container in parents and within(u, container)]):
            if own and 2 * sum(size[u] for u in own if u in chosen) >= sum(size[u] for u in own):
                return True
        return False

    return chosen | {u for u in units if of[u][0].factor == 1 and 2 * link[u] < size[u] and mostly(of[u][0].container)}


def test_ratios_and_selection_of_every_page_against_a_plain_version():
    for page in [*PAGES, *map(bare, PAGES[:100])]:
        nodes, parents = html_text.text_nodes(page)
        nodes = [n for n in nodes if n.text.strip()]
        got, want = html_text.path_ratios(nodes), plain_ratios(nodes)
        assert got.keys() == want.keys() and all(math.isclose(a, b) for p in want for a, b in zip(got[p], want[p]))
        assert html_text.content_units(nodes, parents, got) == plain_selection(nodes, parents, want)


def lines_right(got, want):
    a, b = got.split("\n"), want.split("\n")
    return 2 * sum(min(a.count(x), b.count(x)) for x in set(a)) / (len(a) + len(b))


def constant(nodes, ratios):
    return dict.fromkeys(ratios, (1.0, 1.0, 1.0))


def drawn(nodes, ratios):
    rnd = random.Random(len(nodes))
    return {p: (rnd.random(), rnd.random(), rnd.random()) for p in ratios}


def test_ratios_alone_find_nearly_all_articles():
    pairs = [(html_text.main_text(bare(p)), article(p)) for p in PAGES]
    assert sum(a == b for a, b in pairs) >= 0.97 * len(PAGES)
    assert sum(lines_right(a, b) for a, b in pairs) / len(pairs) >= 0.985


@pytest.mark.parametrize("scores", [constant, drawn])
def test_other_scores_change_most_pages(scores, monkeypatch):
    right = [html_text.main_text(p) for p in PAGES]
    of_bare = [html_text.main_text(bare(p)) for p in PAGES]
    whole = html_text.path_ratios
    monkeypatch.setattr(html_text, "path_ratios", lambda nodes: scores(nodes, whole(nodes)))
    assert sum(html_text.main_text(p) != x for p, x in zip(PAGES, right)) > len(PAGES) / 2
    assert sum(html_text.main_text(bare(p)) != x for p, x in zip(PAGES, of_bare)) > len(PAGES) / 2


def test_pages_keep_their_article_with_and_without_its_tag():
    for page in PAGES:
        assert html_text.main_text(page) == article(page)
        assert html_text.main_text(page.replace("<article>", "<div>").replace("</article>", "</div>")) == article(page)
