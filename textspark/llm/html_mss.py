"""Main text of HTML pages by the maximum-scoring subsequence.

A page is read as a stream of words and tags. Words score by the chance that
their block is main text, tags score negative by how seldom they are part of
it; one linear scan finds the contiguous region of the highest sum.

The weights are a logistic regression on features of blocks, learnt from
``labelled_pages()``: pages composed of typical parts, each part marked as main
text or not. Names of classes, semantic elements and roles are features among
others (link density, length, element, place in an article, and whether the
element with the name holds most of the page), so none of them decides alone.
An element that such features mark, and whose words sum to less than nothing,
is no part of the stream: it is left out of a region round it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .linear import fit_dense

#: Elements inside a block; any other tag ends the block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source svg path map area br".split())
#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style template noscript iframe object svg math canvas audio video head title select textarea button option datalist".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements and roles that hold no main text.
APART = frozenset("nav header footer aside form menu dialog fieldset search".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id attributes that mark such elements.
APART_NAMES = frozenset("""
    ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion promoted banner banners
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination paging toc skip
    sidebar sidebars aside rail header masthead topbar footer foot bottom copyright colophon
    cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay lightbox toast disclaimer paywall
    comment comments commentlist discussion disqus respond replies reply reactions feedback
    related recommended recommendations recommend more-links trending popular share sharing shares social follow newsletter subscribe subscription signup login register search
    widget widgets toolbar tools tags tagcloud byline meta metadata author-bio print
""".split())
#: First words of names that only tell of such elements, and last words of names of the page's layout.
NEGATING = frozenset("no has with without not hide show after before".split())
LAYOUT = frozenset("wrap wrapper container layout page content main article body story post".split())
#: First words of names that tell the subject or the kind of a post, and names of a post itself.
TAXONOMY = frozenset("tag category cat type format status topic section label".split())
CONTENT = frozenset("article content entry hentry main post story text body".split())
#: Elements that hold the page or its article, whatever their class.
WHOLE = frozenset(("html", "body", "main", "article"))
#: Score of a tag that only parts boilerplate; a word that is surely main text scores 1.
TAG_COST = 0.3
#: What may be in a head; anything else ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Share of the page's words outside links with which an element holds the page: if it has the page's heading, and otherwise if it has so many words.
MOST, ALL, MANY = 0.5, 0.9, 30
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Start tags that end an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TAG = re.compile(r"</?([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[a-z]+")
SPREAD = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@lru_cache(maxsize=20_000)
def apart_name(name: str) -> bool:
    """Whether a class or id tells of boilerplate: by its last word, or its first if its last is no part of the layout."""
    words = PARTS.findall(SPREAD.sub(" ", name).lower())
    if not words or words[0] in NEGATING or len(words) > 1 and words[0] in TAXONOMY:
        return False
    return words[-1] in APART_NAMES or words[0] in APART_NAMES and words[-1] not in LAYOUT


def marks_of(attributes: str) -> tuple[bool, bool, bool]:
    """Whether class, id or role tell of boilerplate, whether they tell of content, and whether the element is hidden."""
    apart = content = hidden = False
    for k, a, b, c in NAMES.findall(attributes):
        k, v = k.lower(), a or b or c
        if k in ("class", "id"):
            names = v.split()
            apart = apart or any(map(apart_name, names))
            content = content or not CONTENT.isdisjoint(x.lower() for x in names)
        elif k == "role":
            apart = apart or v.strip().lower() in APART_ROLES
            content = content or v.strip().lower() in ("main", "article")
        elif k == "hidden" or k == "aria-hidden" and v.lower() == "true":
            hidden = True
        elif k == "style" and re.search(r"display\s*:\s*none", v, re.I):
            hidden = True
    return apart, content, hidden


class Element:
    """An element that is marked in some way: its marks, its blocks and tags, its words outside links, and whether it holds the page's heading."""

    __slots__ = ("first", "first_tag", "holds", "last", "last_tag", "marks", "plain")

    def __init__(self, marks: tuple[str, ...], first: int, first_tag: int):
        self.marks, self.first, self.last, self.first_tag, self.last_tag, self.plain, self.holds = marks, first, first, first_tag, first_tag, 0, False


class Block:
    __slots__ = ("article", "inside", "linked", "path", "tags", "text", "words")

    def __init__(self, text: str, words: int, linked: int, path: tuple[str, ...], tags: int, inside: tuple[Element, ...], article: bool):
        self.text, self.words, self.linked, self.path, self.tags, self.inside, self.article = text, words, linked, path, tags, inside, article


def blocks_of(page: str) -> tuple[list[Block], list[Element], list[str]]:
    """In page order: blocks of text, each with the count of tags before it; the marked elements; the tags between blocks."""
    out: list[Block] = []
    elements: list[Element] = []
    stack: list[tuple[str, Element | None, bool]] = []  # name, marks, silent
    parts: list[str] = []
    tags: list[str] = []
    linked = silent = links = article = 0
    pos, end, find = 0, len(page), page.find

    def flush() -> None:
        nonlocal linked
        if parts:
            words = entities.unescape("".join(parts)).split()
            if words:
                inside = tuple(x[1] for x in stack if x[1] is not None)
                b = Block(" ".join(words), len(words), min(linked, len(words)), tuple(x[0] for x in stack if x[0] not in INLINE), len(tags), inside, article > 0)
                for e in inside:
                    e.plain += b.words - b.linked
                out.append(b)
            parts.clear()
            linked = 0

    def pop(to: int, new: int = 0) -> None:
        nonlocal silent, links, article
        while len(stack) > to:
            name, e, s = stack.pop()
            if e is not None:
                e.last, e.last_tag = len(out), len(tags) - new
            silent -= s
            links -= name == "a"
            article -= name in ("article", "main")

    while pos < end:
        at = find("<", pos)
        if at < 0:
            at = end
        if at > pos and silent and stack[-1][0] == "head" and not page[pos:at].isspace():
            pop(len(stack) - 1)
        if at > pos and not silent:
            parts.append(page[pos:at])
            if links:
                linked += len(page[pos:at].split())
        if at == end:
            break
        if page.startswith("<!--", at):
            stop = find("-->", at + 4)
            pos = end if stop < 0 else stop + 3
            continue
        m = TAG.match(page, at)
        if m is None:
            after = page[at + 1 : at + 2]
            if after in ("!", "?", "/") or after.isascii() and after.isalpha():
                stop = find(">", at)
                pos = end if stop < 0 else stop + 1  # a cut or broken tag
            else:
                if not silent:
                    parts.append("<")
                pos = at + 1
            continue
        pos, name = m.end(), m[1].lower()
        if name not in INLINE and name not in SILENT:
            flush()
            tags.append(name)
        elif name == "br":
            parts.append(" ")
        if page[at + 1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
            continue
        if silent and name not in IN_HEAD and any(x[0] == "head" for x in stack):
            pop(next(i for i, x in enumerate(stack) if x[0] == "head"))
        if name in ENDS_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i, 1)
                    break
                if stack[i][0] in ("td", "th", "li", "article", "div", "section", "button"):
                    break
        elif name in CLOSES:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES[name]:
                    pop(i, 1)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "div"):
                    break
        if name in VOID or m[2].endswith("/") and name in INLINE:
            continue
        apart, content, hidden = marks_of(m[2]) if m[2] else (False, False, False)
        marks = [f"element {name}"] if name in APART and not (name == "header" and article) else []
        if name not in WHOLE and name not in HEADINGS and name not in INLINE:
            marks += ["name apart"] * apart + ["name content"] * content
        e = None
        if marks:
            e = Element(tuple(marks), len(out), len(tags) - (name not in SILENT))
            elements.append(e)
        if name in ("h1", "main") and not silent:
            for x in stack:
                if x[1] is not None:
                    x[1].holds = True
        s = name in SILENT or hidden
        stack.append((name, e, s))
        silent += s
        links += name == "a"
        article += name in ("article", "main")
        if name in RAW:
            close = re.compile(rf"</{name}\b", re.I).search(page, pos)
            pos = end if close is None else close.start()
    flush()
    pop(0)
    return out, elements, tags


def features(found: list[Block]) -> list[set[str]]:
    """The features of each block of a page."""
    plain = sum(b.words - b.linked for b in found) or 1
    out = []
    free = free_in_article = 0  # words outside links, and outside elements that are marked and do not hold the page
    for b in found:
        density = b.linked / b.words
        inner = b.path[-1] if b.path else ""
        marks = {
            "links" if density > 0.5 else "some links" if density > 0.2 else "no links",
            f"in {inner}" if inner in HEADINGS or inner in ("p", "li", "td", "div", "blockquote", "pre", "dd", "figcaption") else "in other",
            "long" if b.words >= 12 else "middle" if b.words >= 4 else "short",
        }
        apart = False
        for e in b.inside:
            share = e.plain / plain
            holds = share >= ALL and e.plain >= MANY or share >= MOST and e.holds
            marks.update(f"{x}, holds the page" if holds else x for x in e.marks)
            apart = apart or not holds and e.marks != ("name content",)
        if not apart:
            free += b.words - b.linked
            free_in_article += (b.words - b.linked) * b.article
        out.append(marks)
    has = free_in_article >= MOST * free > 0
    for b, marks in zip(found, out, strict=True):
        marks.add(("in article" if b.article else "outside") if has else "in teaser" if b.article else "no article")
    return out


def _part(kind: str, k: int) -> str:
    """Parts of composed pages that are no main text; ``k`` varies names and sizes."""
    prose = lambda n, seed: " ".join(f"word{(seed * 31 + i * 7) % 97}" for i in range(n))
    links = lambda n: "".join(f'<li><a href="/{i}">item{i}</a></li>' for i in range(n))
    size = (6, 15, 30, 60)[k % 4]
    mark = ("class", "id")[k % 2]
    if kind == "named":
        name = ("advert", "sidebar", "cookie-notice", "comments", "related-posts", "newsletter", "social-share", "promo-banner", "breadcrumbs", "disclaimer")[k % 10]
        inner = f"<p>{prose(size, k)}</p><p>{prose(4, k + 1)}</p>" if k % 3 else prose(size, k)
        return f'<div {mark}="{name}">{inner}</div>'
    if kind == "element":
        name = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "search", "fieldset")[k % 9]
        inner = f"<ul>{links(3 + k % 6)}</ul>" if name in ("nav", "menu") and k % 2 else prose(1 + k % 3, k) if k % 5 == 0 else f"<p>{prose(size, k)}</p>" if k % 2 else prose(size, k)
        return f"<{name}>{inner}</{name}>"
    if kind == "role":
        return f'<div role="{("navigation", "banner", "contentinfo", "complementary")[k % 4]}">{prose(size, k)}</div>'
    if kind == "links":
        return (f"<ul>{links(4 + k % 5)}</ul>", f'<p><a href="/x">{prose(3, k)}</a> <a href="/y">{prose(3, k + 1)}</a></p>', f'<div><a href="/a">{prose(5, k)}</a></div>')[k % 3]
    return (f'<p>Home <a href="/n">News</a></p>', f"<p>{prose(3, k)}</p>", f"<div>{prose(2, k)}</div>", f"<h3>{prose(2, k)}</h3>")[k % 4]  # plain


def labelled_pages() -> list[list[tuple[str, bool]]]:
    """Pages as parts (html, is main text), composed in many layouts: articles, plain pages, forms and named wrappers round a whole page, teasers."""
    def prose(n: int, seed: int) -> str:
        return " ".join(f"word{(seed * 31 + i * 7) % 97}" for i in range(n))

    pages = []
    for k in range(240):
        wrap = ("article", "main", 'div class="content"', "div", "section", 'div class="post tag-menu"', 'div id="print"', "form")[k % 8]
        whole = wrap == "form"  # a form counts as the page's only where it holds most of it
        parts = [("<body>", False)]
        for kind, every in (("element", 1), ("named", 2), ("role", 7), ("links", 3), ("plain", 4)):
            if (k // 2) % every == 0:
                parts.append((_part(kind, k), False))
        if k % 6 == 5 and wrap not in ("article", "main"):
            parts.append((f"<article><h3>{prose(3, k)}</h3><p>{prose(8, k)}</p></article>", False))
        parts.append((f"<{wrap}>", False))
        if k % 5 != 4 or whole:
            parts.append((f"<h1>{prose(4 + k % 7, k)}</h1>", True))
        for i in range(1 + k % 6 + 3 * whole):
            element = ("p", "p", "p", "div", "td")[(k // 3) % 5]  # some pages lay text out in plain elements
            parts.append((f"<{element}>{prose(75 if whole else (3, 18, 40, 75, 1, 9)[(k + i) % 6], k + i)}</{element}>" if k % 7 else prose(30, i) + "<hr>", True))
            if (k + i) % 4 == 0:
                parts += [(f"<h{2 + k % 3}>{prose(3, i)}</h{2 + k % 3}>", True), (f"<ul><li>{prose(7, i)}</li><li>{prose(5, i + 1)}</li></ul>", True), (f"<blockquote>{prose(20, i)}</blockquote>", True)]
                parts += [(f"<table><tr><td>{prose(2, i)}</td><td>{prose(3, i)}</td></tr></table>", True), (f"<pre>{prose(9, i)}</pre>", True), ("<div><figure><img></figure></div>" * 3, False)]
            if (k + i) % 6 == 2:
                parts.append((f'<p>{prose(9, i)} <a href="/z">{prose(3, i)}</a> {prose(8, i)}</p>', True))
            if (k + i) % 5 == 4:
                parts.append((_part(("named", "element")[i % 2], k + 3 * i), False))
        parts.append((f"</{wrap.split()[0]}>", False))
        for kind, every in (("plain", 5), ("links", 2), ("named", 3), ("element", 2)):
            if (k // 3) % every == 0:
                parts.append((_part(kind, k + 1), False))
        pages.append(parts + [("</body>", False)])
    return pages


@lru_cache(maxsize=1)
def weights() -> tuple[dict[str, float], float, dict[str, float], float]:
    """Log odds of each feature, those of a block with none, score of each tag, score of other tags; learnt from the labelled pages."""
    rows, truth = [], []
    tags = {True: Counter(), False: Counter()}
    for parts in labelled_pages():
        found, _, names = blocks_of("".join(x for x, _ in parts))
        labels = [main for x, main in parts for _ in blocks_of(x)[0]]
        rows += features(found)
        truth += labels
        for before, b, main in zip([0, *(b.tags for b in found)], found, labels, strict=False):
            tags[main].update(names[before : b.tags])
    names = sorted(set().union(*rows))
    x = np.array([[f in r for f in names] for r in rows], float)
    mean, scale, w, bias = fit_dense(x, np.array(truth, float), l2=1e-2)
    odds = dict(zip(names, (w / scale).tolist(), strict=True))
    cost = {t: -TAG_COST * (tags[False][t] + 1) / (tags[True][t] + tags[False][t] + 2) for t in tags[True] | tags[False]}
    return odds, bias - float((w * mean / scale).sum()), cost, -TAG_COST / 2


def best_region(words: list[float], tags: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run of blocks with the highest sum, by one scan; the empty run if none is positive.

    ``tags[i]`` (not positive) lies between block i - 1 and block i and counts
    where both are in the run. Ties take the run that ends last and starts first.
    """
    best = total = 0.0
    found, start = (0, 0), 0
    for i, score in enumerate(words):
        total += tags[i] if i > start else 0.0
        if total < 0:
            total, start = 0.0, i
        total += score
        if total < 0:
            total, start = 0.0, i + 1
        elif total >= best and total > 0:
            best, found = total, (start, i + 1)
    return found


def scored(page: str) -> tuple[list[Block], list[float], list[float]]:
    """The stream of a page: its blocks but those of marked elements with a negative sum, their scores, and those of the tags before each."""
    found, elements, names = blocks_of(page)
    odds, bias, cost, other = weights()
    scores = [b.words * math.tanh((bias + sum(odds.get(f, 0.0) for f in fs)) / 2) for b, fs in zip(found, features(found), strict=True)]
    sums = np.r_[0.0, np.cumsum(scores)]
    out = np.zeros(len(found), bool)
    costs = np.array([cost.get(t, other) for t in names])
    for e in elements:
        if sums[e.last] < sums[e.first] and any(x != "name content" for x in e.marks):
            out[e.first : e.last] = True
            costs[e.first_tag : e.last_tag] = 0.0
    kept = [i for i in range(len(found)) if not out[i]]
    to = np.r_[0.0, np.cumsum(costs)][[found[i].tags for i in kept]] if kept else np.empty(0)
    return [found[i] for i in kept], [scores[i] for i in kept], np.diff(to, prepend=0.0).tolist()


def main_blocks(page: str) -> list[str]:
    """Blocks of the region of the highest sum."""
    found, words, tags = scored(page)
    lo, hi = best_region(words, tags)
    return [b.text for b in found[lo:hi]]


def _texts(batches):
    for b in batches:
        out = ["\n".join(main_blocks(h)) if h else "" for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Null, empty and text-less pages give an empty text, and so do pages without
    a stretch that scores above nothing. Character references are decoded, white
    space in a block is one space, blocks are joined by one newline. Rows may
    repeat; other columns are not read; an empty table gives an empty result.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")
