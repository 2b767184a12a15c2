"""Main text of web pages by consensus: containers scored per page, paths voted per host, pages re-extracted.

Each page is read into blocks (runs of text between block tags), each with its path of open containers.  What belongs
to menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts or styles, by tag, role or words of
class and id, is no content.  A container's score is the share of the page's content in it, less for each container
between, times the share of content in all its text, raised for containers that say that they hold the article; the
page votes for its best one, of equals the innermost.  A vote is a generalised path: tags with the words of their classes (digits as 0), from the body down.

Spark counts the votes of every host.  A path that holds at least ``SHARE`` of its host's votes, and more than one
page's, wins; there are at most 1 / ``SHARE`` winners.  Every page is then read again: the first of its host's winners
that the page holds gives the text (all elements of that path, without what is no content), else the page's own best.

Text: character references are decoded, white space inside a block is one space (a ``br`` too), blocks without text go,
the others are joined in page order by ``\\n``.  Headings, lists, tables and captions inside the article are content; a
list of links only is a menu.

Scale: the first pass sends one vote a page, counted before the shuffle, and pages meet their host's few winners in a
join whose small side the planner sizes; a hot host is split by adaptive execution.

Edge cases: null and empty html, and html without content, give an empty text; html cut anywhere is read as if all
were closed there, and what cannot be read as a tag is text; pages without a host use their own best container;
repeated rows and null ids give a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import _Cache as Cache, table, written
from fieldmark.llm.url_rules import host_and_path

#: Least share of a host's votes that a winning path holds.
SHARE = 0.05
#: A container that says it holds the article counts this much more.
PRIOR = 1.5
#: What content counts one container further out.
DECAY = 0.8
#: Longer paths stand as their digest.
PATH_CHARS = 256

# Tags between which text is one block.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option
p pre search section select summary table tbody td tfoot th thead tr ul""".split())
# Tags without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Tags whose content is no markup, and of these those whose text may count nowhere.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
# Tags that are never content.
OUT = frozenset("""nav footer aside form button select option optgroup input label noscript template svg canvas object
audio video dialog menu head""".split())
# Words of class, id and role of what is never content.
OUT_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner
sidebar sidebars aside rail menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead
topbar footer colophon comment comments disqus reply replies respond reader cookie cookies consent gdpr notice notices
alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended
recommendations teaser teasers widget widgets form search skip complementary contentinfo toolbar toc""".split())
# Words that say that a container holds the article.
IN_WORDS = frozenset("article articlebody post entry content story main body text".split())
# Words before an OUT word that only tell of a page's layout.
LAYOUT = frozenset("has with without no is".split())
# What an opening tag closes: a tag inside a p, and items of the same kind.
CLOSES_P = BLOCK - frozenset("body html button option optgroup select legend caption td th tr tbody thead tfoot".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
          "tfoot": {"tbody", "tr", "td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
         "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

HEADINGS, LISTS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("ul ol dl".split())
CONTAINERS = frozenset("div section article main td th center".split())
HEADER_TAGS = HEADINGS | {"div", "hgroup"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_COMMENT_END = re.compile(r"--!?>")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")


class Element:
    """An element: its place in the tree, what it is taken for, and the characters in it."""

    __slots__ = ("tag", "path", "parent", "depth", "out", "prior", "list", "article", "header", "heading", "good", "near", "all", "inside")

    def __init__(self, tag: str, step: str, parent: Element | None, out: bool, prior: float, header: bool = False):
        self.tag, self.parent, self.out, self.prior = tag, parent, out, prior
        path = f"{parent.path}>{step}" if parent else step
        self.path = path if len(path) <= PATH_CHARS else "#" + hashlib.md5(path.encode("utf-8", "replace")).hexdigest()
        self.depth = parent.depth + 1 if parent else 0
        self.list = self if tag in LISTS else parent and parent.list
        self.article = not out and (tag in ("article", "main") or bool(parent and parent.article))
        self.header = header  # in an article's own header
        self.heading = tag in HEADINGS or bool(parent and parent.heading)
        self.good = self.near = self.all = 0
        self.inside = False


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), _html.unescape(a or b or c))
    return out


def _words(value: str) -> list[list[str]]:
    """The words of each name of a class or id attribute."""
    return [[w.lower() for w in _WORD.findall(name)] for name in value.split()]


def _says(names: list[list[str]], words: frozenset) -> bool:
    return any(w in words and not (k and name[k - 1] in LAYOUT) for name in names for k, w in enumerate(name))


_NATURES = Cache()


def _nature(tag: str, raw: str) -> tuple[str, bool, bool]:
    """Step of the path, whether the element is no content, and whether it says that it holds the article."""
    have = _NATURES.get((tag, raw))
    if have:
        return have
    a = _attributes(raw) if raw.strip() else {}
    classes = a.get("class", "")
    step = ".".join([tag, *sorted({_DIGITS.sub("0", c) for c in classes.split()})])
    names = _words(classes) + _words(a.get("id", "")) + _words(a.get("role", ""))
    out = (tag in OUT or _says(names, OUT_WORDS - {"header"} if tag == "header" else OUT_WORDS) or "hidden" in a
           or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower())
    says_in = tag in ("article", "main") or "articlebody" in a.get("itemprop", "").lower() or _says(names, IN_WORDS)
    if len(raw) < 200 and len(_NATURES) < 10_000:
        _NATURES[tag, raw] = step, out, says_in
    return step, out, says_in


def _opened(tag: str, raw: str, parent: Element) -> Element:
    """The element that a start tag opens."""
    step, out, says_in = _nature(tag, raw)
    # the page's header is no content, an article's own keeps its headings
    header = not out and (tag == "header" and parent.article or parent.header and tag in HEADER_TAGS)
    # an article begins anew what an unclosed menu or a form around it holds
    out = out or tag == "header" or parent.out and tag not in ("article", "main")
    return Element(tag, step, parent, out, PRIOR if says_in and not out else 1.0, header)


def read(html: str) -> tuple[list[Block], list[Element]]:
    """Blocks of a page in order, and its elements."""
    root = Element("html", "html", None, False, 1.0)
    body = Element("body", "body", root, False, 1.0)
    stack, elements, blocks = [root, body], [root, body], []
    pieces: list[tuple[str, bool]] = []
    is_open: Counter = Counter()
    links = 0  # 0 outside a link, else the number of elements open where it began
    end, last, at, tag_at = len(html), html.rfind(">"), 0, _TAG

    def flush():
        nonlocal pieces
        if pieces:
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                linked = sum(len(t.strip()) for t, inside in pieces if inside)
                blocks.append(Block(text, stack[-1], min(linked, len(text))))
            pieces = []

    def close(tags, holds=frozenset()):
        """Close the innermost open element of these tags, unless one of ``holds`` lies between."""
        nonlocal links
        if tags.isdisjoint(t for t, n in is_open.items() if n):
            return
        for k in range(len(stack) - 1, 1, -1):
            if stack[k].tag in tags:
                flush()
                is_open.subtract(e.tag for e in stack[k:])
                del stack[k:]
                links = links if links <= k else 0
                return
            if stack[k].tag in holds:
                return

    while at < end:
        lt = html.find("<", at)
        if lt < 0 or lt > last:
            rest = html[at:] if lt < 0 else html[at:lt]
            if lt >= 0 and not (lt + 1 < end and (html[lt + 1].isalpha() and html[lt + 1].isascii() or html[lt + 1] in "/!?")):
                rest = html[at:]
            pieces.append((_html.unescape(rest), links > 0))
            break
        if lt > at:
            pieces.append((_html.unescape(html[at:lt]), links > 0))
        if html.startswith("<!--", lt):
            found = _COMMENT_END.search(html, lt + 4)
            if html.startswith((">", "->"), lt + 4):
                at = html.index(">", lt) + 1
            else:
                at = found.end() if found else end
            continue
        m = tag_at.match(html, lt)
        if not m:
            follows = html[lt + 1:lt + 2]
            if follows.isascii() and follows.isalpha() and tag_at is _TAG:
                tag_at = _LOOSE  # a quote that never ends: read on by > alone
            elif follows and follows in "/!?":
                at = html.find(">", lt) + 1 or end
            else:
                pieces.append(("<", links > 0))
                at = lt + 1
            continue
        at = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "a":
                links = 0
            elif tag in HEADINGS:
                close(HEADINGS)
            elif tag not in ("html", "body"):
                close({tag}, {"table", "td", "th"} if tag in ("div", "p", "section") else frozenset())
            if tag in BLOCK:
                flush()
            continue
        if tag in ("html", "body"):
            continue
        if tag == "br" or tag == "wbr":
            pieces.append((" " if tag == "br" else "", links > 0))
            continue
        if tag == "hr":
            flush()
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            found = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            at = found.start() if found else end
            if found:
                closing = html.find(">", at)
                at = closing + 1 if closing >= 0 else end
            continue
        if tag == "a":
            links = len(stack)
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "button"})
        if tag in CLOSES:
            close(CLOSES[tag], HOLDS[tag])
        element = None
        if tag not in BLOCK and tag not in OUT:
            if m.group(3).strip(" /") and not stack[-1].out:
                element = _opened(tag, m.group(3), stack[-1])
            if element is None or not element.out:
                continue  # its text belongs to the block around it
        if m.group(3).endswith("/") and tag not in BLOCK:
            continue
        flush()
        if tag in ("article", "main"):
            links = 0
        element = element or _opened(tag, m.group(3), stack[-1])
        stack.append(element)
        elements.append(element)
        is_open[tag] += 1
    flush()
    return blocks, elements


def content(blocks: list[Block]) -> list[Block]:
    """The blocks that may be content."""
    menus: dict[int, list[int]] = {}
    for b in blocks:
        if b.element.list:
            have = menus.setdefault(id(b.element.list), [0, 0, 0])
            have[0], have[1], have[2] = have[0] + len(b.text), have[1] + b.linked, have[2] + 1

    def menu(e):
        chars, linked, n = menus[id(e)] if e else (0, 0, 0)
        return n > 1 and linked >= 0.9 * chars

    return [b for b in blocks if (not b.element.out or b.element.header and b.element.heading) and not menu(b.element.list)]


def best(blocks: list[Block], elements: list[Element], good: list[Block]) -> Element | None:
    """The container of highest score, the innermost of equals."""
    for b in blocks:
        b.element.all += len(b.text)
    for b in good:
        b.element.good += len(b.text) - b.linked
        b.element.near += len(b.text) - b.linked
    for e in reversed(elements[1:]):  # parents stand before their children
        e.parent.good += e.good
        e.parent.near += e.near * (DECAY if e.tag in CONTAINERS else 1)
        e.parent.all += e.all
    total = elements[0].good
    scored = [(e.near / total * min(1.0, e.good / e.all) * e.prior, e.depth, -k, e) for k, e in enumerate(elements)
              if e.good and not e.out and e.tag != "p" and e.tag != "pre" and e.tag not in HEADINGS]
    return max(scored, key=lambda s: s[:3])[3] if scored else None


def vote(html: str | None) -> str | None:
    """Path of the page's best container."""
    blocks, elements = read(html or "")
    found = best(blocks, elements, content(blocks))
    return found.path if found else None


def extract(html: str | None, winners: list[str]) -> str:
    """Main text of a page: from the first of the winning paths that it holds, else from its own best container."""
    blocks, elements = read(html or "")
    good, chosen = content(blocks), []
    if winners:
        held: dict[str, list[Element]] = {}
        for e in elements:
            if not e.out:
                held.setdefault(e.path, []).append(e)
        chosen = next((held[path] for path in winners if path in held), [])
    if not chosen:
        own = best(blocks, elements, good)
        chosen = [own] if own else []
    for e in chosen:
        e.inside = True
    for e in elements[1:]:
        e.inside = e.inside or e.parent.inside
    return "\n".join(b.text for b in good if b.element.inside)


def _vote_rows(batches):
    import pyarrow as pa

    for batch in batches:
        host, htmls = batch.column(0), batch.column(1)
        paths = [vote(h.as_py()) for h in htmls]
        yield pa.record_batch([host, pa.array(paths, pa.string())], names=["host", "path"])


def _text_rows(html_at: int, batches):
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = [extract(h.as_py(), w.as_py() or []) for h, w in zip(part.column(html_at), part.column(html_at + 1))]
            yield pa.record_batch([*part.columns[:html_at], pa.array(texts, pa.string()),
                                   pa.array([len(t) for t in texts], pa.int64())],
                                  names=[*part.schema.names[:html_at], "text", "n_chars"])


def winning_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, winners): the winning paths of each host, most votes first; ``pages`` are rows (host, html)."""
    votes = pages.where("host <> ''").select("host", "html").mapInArrow(_vote_rows, "host string, path string")
    counts = votes.where("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("total", F.sum("n").over(Window.partitionBy("host")))
    winners = ranked.where((F.col("n") > 1) & (F.col("n") >= F.lit(share) * F.col("total")))
    return winners.groupBy("host").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))), lambda w: w["path"]).alias("winners"))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                      share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    kind = pages.schema[page_id].dataType.simpleString()
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(html).cast("string").alias("html"))
    rows = rows.withColumn("host", host_and_path(F.col("url"))[0])
    winners = written(winning_paths(rows, share), "paths")
    return rows.join(winners, "host", "left").select("page_id", "url", "html", "winners").mapInArrow(
        partial(_text_rows, 2), f"page_id {kind}, url string, text string, n_chars long")


def op12(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
