"""Main text where elements and names mislead."""

import time

import pytest

from pagewright.llm import html_text

BODY = [f"Paragraph {i} goes on, and on. " + "It says one thing, then another, and ends. " * 9 for i in range(10)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in BODY)
WANTED = [" ".join(x.split()) for x in BODY]


def lines(page):
    return html_text.main_text(f"<html><body>{page}</body></html>").split("\n")


def test_articles_that_are_only_teasers():
    cards = "".join(f"<article><a href='/{i}'><h3>Teaser number {i} with a headline of about eighty characters that links away</h3></a></article>" for i in range(5))
    # Smoothing may keep the one card that touches the body.
    after, before = lines(f"<div>{PARAGRAPHS}</div>{cards}"), lines(f"{cards}<div>{PARAGRAPHS}</div>")
    assert after[:10] == WANTED and len(after) <= 11
    assert before[-10:] == WANTED and len(before) <= 11
    plain = "".join(f"<article><p>Teaser {i} of eighty characters, unlinked, which stands in a small card of its own</p></article>" for i in range(5))
    assert [x for x in lines(f"<div>{PARAGRAPHS}</div>{plain}") if not x.startswith("Teaser")] == WANTED


def test_scores_decide_inside_and_outside_of_an_article():
    links = "".join(f"<div><a href='/{i}'>tag{i}</a></div>" for i in range(9))
    got = lines(f"<article>{PARAGRAPHS}{links}</article><div>Small print</div><div>More of it</div>")
    assert got[:10] == WANTED and not {f"tag{i}" for i in range(1, 9)} & set(got) and "Small print" not in got and "More of it" not in got
    assert [x for x in lines(f"<article>{PARAGRAPHS}</article><div><p>{BODY[0]}{BODY[1]}</p></div>")[:10]] == WANTED
    assert lines(f"<article>{PARAGRAPHS}</article><div><p>{BODY[0]}{BODY[1]}</p></div>")[10:] == [f"{WANTED[0]} {WANTED[1]}"]


@pytest.mark.parametrize("count", [1, 2, 3, 4, 6, 10, 50])
def test_short_blocks_lists_and_tables_inside_an_article(count):
    items = [f"Item {i}." for i in range(count)]
    cells = [f"c{i}" for i in range(count)]
    end = f"<p>So.</p><p>Short <b>one</b>.</p><ul>{''.join(f'<li>{x}' for x in items)}</ul><table>{''.join(f'<tr><td>{x}</td></tr>' for x in cells)}</table>"
    for page in (f"<article><h1>Head</h1>{PARAGRAPHS}{end}</article>", f"<div><h1>Head</h1>{PARAGRAPHS}{end}</div><div>Small print</div>"):
        assert lines(page) == ["Head", *WANTED, "So.", "Short one.", *items, *cells]
    between = f"<article><h1>Head</h1>{PARAGRAPHS}<div class='box'>{end}</div>{PARAGRAPHS}</article>"
    assert lines(between)[:11] == ["Head", *WANTED] and lines(between)[-10:] == WANTED


def test_lists_of_links_are_no_content():
    links = "".join(f"<li><a href='/{i}'>A page with number {i}, and more</a>" for i in range(12))
    assert lines(f"<ul>{links}</ul><article>{PARAGRAPHS}<ul>{links}</ul></article>") == WANTED


def test_tables_as_layout_of_the_page():
    page = f"<table><tr><td><a href='/'>Home</a></td><td><a href='/b'>News</a></td></tr><tr><td colspan=2>{PARAGRAPHS}</td></tr></table>"
    assert [x for x in lines(page) if x not in ("Home", "News")] == WANTED


@pytest.mark.parametrize("unit", ['<a b="', '<a b=">', "<a '\"", "<p><b>", "<!--", "</p>", "<script>", "<ul><li>", "<h1><b></h1>", "<", "&amp;<", "<div class='ad'>x"])
def test_work_is_linear_in_broken_pages(unit):
    took = []
    for size in (100_000, 1_000_000):
        page = unit * (size // len(unit))
        began = time.process_time()
        html_text.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.5
    if '"' in unit:
        assert took[1] < 1


def test_quotes_without_an_end_hide_nothing():
    assert lines(f"<div title=\"it's><p>{BODY[0]}</p></div>{PARAGRAPHS}")[-10:] == WANTED
    assert lines(f"<p title='a > b'>{BODY[1]}</p>{PARAGRAPHS}") == [WANTED[1], *WANTED]
    assert html_text.main_text(f"<p>{BODY[0]}</p><a href='x") == WANTED[0]


def test_names_that_mark_real_text():
    inside = ("<div class='article-header'><h1>Headline</h1></div><h2 id='related-work'>Related work</h2>"
              f"<section id='search-methods'>{PARAGRAPHS}</section><pre><code>x = 1 <span class='comment'># set x</span></code></pre><p class='notice'>Read this, too.</p>")
    want = ["Headline", "Related work", *WANTED, "x = 1 # set x", "Read this, too."]
    assert lines(f"<article>{inside}</article>") == want
    assert lines(f"<div><section id='search-methods'>{PARAGRAPHS}</section><h2 id='related-work'>Related work</h2>{PARAGRAPHS}</div>") == [*WANTED, "Related work", *WANTED]


def test_names_that_mark_furniture():
    furniture = ("<div class='big ad'>Buy now, today, here.</div><ul class='menu'><li>Home</ul><div role='search'>Find it, now.</div>"
                 "<div class='ad-box'>Cheap, and good.</div><div id='comments'><p>A comment, long enough to look like text, really.</p></div>")
    assert lines(f"{furniture}<article>{PARAGRAPHS}</article>") == WANTED
    assert lines(f"<article>{PARAGRAPHS}<div class='related'><p>See this, and that, and more.</p></div></article>") == WANTED
