"""Extraction against pages whose main text is known, and on broken html."""

import random
import time

from helpers import prose

from fieldmark.llm import html_extraction as H

PAGES = "page_id long, url string, html string, host string, text int, winners string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", 1, "w") for i, u, h in rows], PAGES)


def article(seed, paragraphs):
    blocks = [f"Title {seed} & {prose(4, seed)}"] + [prose(12 + (seed + i) % 20, 31 * seed + i) for i in range(paragraphs)]
    marked = [f"<h1>{blocks[0].replace('&', '&amp;')}</h1>"]
    for i, b in enumerate(blocks[1:]):
        words = b.split(" ")
        words[1], words[3] = f"<em>{words[1]}</em>", f'<a href="/{i}">{words[3]}</a>'
        marked.append(f"<p>{chr(10).join(words[:5])}  {' '.join(words[5:])}</p>")
    return blocks, marked


NAV = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us and more</a></li></ul></nav>'
MENU = '<div class="top-menu"><a href="/x">X</a> | <a href="/y">Y</a></div>'
AD = '<div class="ad-box"><p>Buy our thing now, it is a very good thing to buy.</p></div>'
NOTICE = '<div id="cookieNotice"><p>We use cookies, please accept them all before you read.</p><button>OK</button></div>'
FORM = '<form action="/s"><label>Search</label><input name="q"><p>Type what you look for here.</p></form>'
SIDE = f'<aside><h3>More</h3><p>{prose(60, 8)}</p></aside>'
COMMENTS = f'<section class="comments"><h2>2 comments</h2><article class="comment"><p>{prose(90, 5)}</p></article></section>'
FOOTER = '<footer><p>&copy; 2020 Somebody, all rights reserved everywhere and forever.</p></footer>'
SCRIPT = '<script>var a = "<p>no</p>"; if (1 < 2) x();</script><style>p > a { color: red }</style><!-- <p>no</p> -->'


def page(kind, marked, rng):
    """Pages of three sites; adverts and forms stand between the paragraphs."""
    body = list(marked)
    for extra in (AD, FORM, SCRIPT):
        body.insert(rng.randrange(1, len(body) + 1), extra)
    inner = "".join(body)
    if kind == 0:
        return f"<!DOCTYPE html><html><head><title>t</title></head><body>{NAV}{NOTICE}<article>{inner}</article>{SIDE}{COMMENTS}{FOOTER}"
    if kind == 1:
        return (f'<html><body class="no-sidebar"><div id="page"><header><p>The daily something</p></header>{MENU}'
                f'<div class="post-{rng.randrange(999)} entry-content">{inner}{COMMENTS}</div>'
                f'<div class="sidebar">{SIDE}<p>{prose(50, 3)}</p></div>{FOOTER}</div></body></html>')
    return (f"<html><body><table><tr><td>{NAV}<td><div class=x{rng.randrange(99)}>{inner}</div></table>{NOTICE}{FOOTER}"
            f"</body></html>").replace("</p>", "")


def test_known_articles(spark):
    rng, rows, want = random.Random(1), [], {}
    for i in range(90):
        blocks, marked = article(i, 1 + i % 7)
        rows.append((i, f"http://Host{i % 3}.org/p/{i}", page(i % 3, marked, rng)))
        want[i] = "\n".join(blocks)
    rows += [(500, None, rows[0][2]), (501, "", rows[1][2]), (502, "http://host0.org/", None), (503, "http://host0.org/", ""),
             (504, "http://host1.org/", NAV + FOOTER), (3, rows[3][1], rows[3][2]), (None, rows[4][1], rows[4][2])]
    got = H.extract_main_text(frame(spark, rows)).collect()
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"} and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert {i: by[i].text for i in range(90)} == want
    assert by[500].text == want[0] and by[501].text == want[1] and by[None].text == want[4]
    assert by[502].text == by[503].text == by[504].text == ""
    assert sum(r.page_id == 3 for r in got) == 2 and by[500].url is None


def test_consensus_beats_the_page(spark):
    """On some pages an unmarked box holds more text than the article; the host's other pages tell which it is."""
    def made(i):
        box = prose(400 if i % 5 == 0 else 5, 1000 + i)
        return f'<html><body><div class=a><p>{prose(40, i)}</p></div><div class=b><p>{box}</p></div></body></html>'

    rows = [(i, "https://one.org/" + str(i), made(i)) for i in range(40)]
    paths = H.winning_paths(frame(spark, rows).selectExpr("'one.org' AS host", "html")).collect()
    assert paths[0].winners[0] == "html>body>div.a"
    assert H.vote(rows[5][2]) == "html>body>div.b"
    got = {r.page_id: r.text for r in H.extract_main_text(frame(spark, rows)).collect()}
    assert got == {i: prose(40, i) for i in range(40)}


def test_broken_html():
    cases = {
        "": "", "<": "<", "plain": "plain", "a<b": "a", "1 < 2": "1 < 2", "<p>a<p>b": "a\nb", "<p>x<br>y<br/>z": "x y z",
        "<div>a<div>b</div>c</div>": "a\nb\nc", "<p>a &amp b &eacute;&#x41;&nbsp; c</p>": "a & b éA c", "&lt;p&gt;": "<p>",
        "<p>a<!-- b -->c<!-- d": "ac", "<p>a<script>b": "a", "<P>A</P><STYLE>x</STYLE>b": "A\nb", "<p>a</div></b></p>b": "a\nb",
        "<ul><li>a<li>b <ul><li>c</ul>d</ul>": "a\nb\nc\nd", "<p title='>'>a</p>": "a", "<p title=it's>a</p> it's": "a\nit's",
        "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc", "<nav>m<article><p>text</article>": "text",
        "<form><article><p>a</p><input></article></form>": "a", "<p hidden>a</p><p style='display: none'>b</p><p>c</p>": "c",
        "<article><header><h1>T</h1><p>by</p></header><p>b</p><footer>f</footer></article>": "T\nb",
        "<pre>a\n  b</pre>": "a b", "<p>fo<b>o</b>ba<span class=ad>AD</span>r</p>": "fo ba\nr".replace("fo ba", "fooba"),
        "<p>a</p><ul><li><a href=1>x</a></li><li><a href=2>y</a></li></ul>": "a", "　a b\t": "a b",
    }
    for html, want in cases.items():
        assert H.extract(html, []) == want, html


def test_long_and_hostile_pages_end():
    t0 = time.time()
    for html in ("<div>a" * 50_000, '<a b="' * 100_000, "<" * 300_000, "<a " * 100_000, "</div>" * 50_000, "<p>x" * 50_000,
                 '<a b="' * 100_001 + ">", "&" * 300_000, "<!--" * 50_000, "<div a='\"'" * 50_000 + ">", "<script>" * 10_000):
        H.extract(html, ["html>body"])
        H.vote(html)
    assert time.time() - t0 < 60
    assert H.extract("<div>a" * 50_000, ["html>body"]).count("a") == 50_000


def test_empty_table(spark):
    assert H.extract_main_text(frame(spark, [])).collect() == []
