"""Main text of HTML pages by boosted trees over DOM nodes, decoded over the tree (operator 1).

Nodes are block elements, and runs of text that lie beside block elements.
Two boosted models give every node the chances that its subtree holds *no*, *only* or
*some* main text, from subtree density, attribute tokens, depth and sibling statistics.
The labelling of the whole tree with the greatest sum of logs is found from the leaves up, such that below
a node of no main text all have none, and below one of only main text all have
only that: an ancestor and a descendant never contradict each other.

The models are trained here, on ``TRAIN_PAGES`` pages (the documented bound) that
``training_page`` writes from a seed, whose main blocks are known.  A page is read in one pass, in time proportional to its length.

Defined results: null or empty html gives an empty text, and so does a page without main
text; unclosed elements end with their parents; a tag that the page ends in is left out; pages are read one by one, so repeated rows
agree; other columns are ignored.  White space and ``br`` inside a block are one space.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, boosting, words

TRAIN_PAGES, SEED = 600, 11
#: Elements by their role in HTML: fixed values.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul button".split())
RAW = frozenset("script style noscript template iframe title textarea svg math".split())
SILENT = frozenset("script style noscript template iframe title svg math head".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
CLOSES_P = BLOCK - frozenset("body head html option td th tr tbody thead tfoot button select legend summary title template".split())
#: Start tags that end an open element: of which names, and within which containers they do not look out.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "option": (("option",), ("select",)), "tr": (("tr",), ("table",))}
_ENDS |= {x: (("dd", "dt"), ("dl",)) for x in ("dd", "dt")} | {x: (("td", "th"), ("table",)) for x in ("td", "th")}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "nav", "header", "footer", "aside", "form", "figure", "blockquote", "pre", "body", "html", "#text", "button", "label", "figcaption", "dl", "dd")
GOOD_TOKENS = frozenset("article body content entry main post story text hentry page prose blog news copy".split())
BAD_TOKENS = frozenset("ad ads advert advertisement adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer discussion disqus dropdown footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted recommended related replies reply respond search share sharing shoutbox sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget alert".split())
#: Comments (``<!-->`` and ``<!--->`` are whole), declarations, end tags without a name, and the names of tags.
_tag = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: Attributes up to the end of the tag, without backtracking; a quote counts only after =, and one that is not closed reaches to the end of the page.
_attributes = re.compile(r"""(?:[^>=]+|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+""")
_named = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_token = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_long_number = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")


class Page:
    """Nodes in page order: parent, tag, own attribute tokens, text runs."""

    __slots__ = ("attrs", "depth", "parent", "runs", "tag")

    def __init__(self) -> None:
        self.parent, self.tag, self.attrs, self.depth = [-1], ["html"], [""], [0]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters inside links

    def add(self, parent: int, tag: str, attrs: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1


def plain(text: str) -> str:
    """Character references decoded (numbers beyond Unicode: U+FFFD), white space as single spaces, trimmed."""

    def short(m: re.Match) -> str:
        body = m[0].rstrip(";")[2:]
        digits = body.lstrip("xX").lstrip("0")
        return "\ufffd" if len(digits) > 7 else f"&#{'x' if body[0] in 'xX' else ''}{digits or '0'};"

    return " ".join(entities.unescape(_long_number.sub(short, text)).split())


def parse(source: str) -> Page:
    """The page's nodes in one pass: every character is read once, and open elements are found by name."""
    page, stack, pieces = Page(), [0], []
    links, linked, at, silent, end = 0, 0, 0, 0, len(source)
    tag_of = page.tag
    places: dict[str, list[int]] = {}  # of every open name its places in the stack

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = plain("".join(pieces))
            if text:
                page.runs.append((stack[-1], text, linked))
            pieces, linked = [], 0

    def close(to: int) -> None:
        """Leave the stack's elements from place ``to`` on."""
        nonlocal silent
        flush()
        for node in stack[to:]:
            silent -= tag_of[node] in SILENT
            if node:
                places[tag_of[node]].pop()
        del stack[to:]

    def open_place(names: tuple[str, ...], stop: tuple[str, ...] = ()) -> int:
        """The place of the innermost open element of these names; 0 if there is none, or one of ``stop`` lies within."""
        inner = max([places[x][-1] for x in names if places.get(x)], default=0)
        return inner if inner and all(not places.get(x) or places[x][-1] < inner for x in stop) else 0

    while at < end:
        m = _tag.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text and not silent:
            pieces.append(text)
            linked += len(text) if links else 0
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        rest = _attributes.match(source, at)
        attrs, at = rest[0], rest.end() + 1
        if at > end:  # the page ends within the tag
            break
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK and (i := open_place((name,))):
                close(i)
            elif name == "p":
                flush()
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            if name not in SILENT and not silent:  # a textarea's text
                flush()
                node = page.add(stack[-1], name, attrs)
                text = plain(source[at : stop.start() if stop else end])
                if text:
                    page.runs.append((node, text, 0))
            at = stop.end() if stop else end
            continue
        if name == "a":
            links += 1
            continue
        if name not in BLOCK:
            continue
        if name in CLOSES_P and (i := open_place(("p",), ("button", "td", "th"))):
            close(i)
        if name in _ENDS and (i := open_place(*_ENDS[name])):
            close(i)
        flush()
        if name == "html" or name == "hr":
            continue
        if name == "body" and (i := open_place(("head",))):
            close(i)
        places.setdefault(name, []).append(len(stack))
        stack.append(page.add(stack[-1], name, attrs))
        silent += name in SILENT
    close(0) if len(stack) > 1 else flush()
    return page


def split_runs(page: Page) -> list[int]:
    """Nodes of the text runs: runs beside block elements get nodes of their own. Parents come before children."""
    has_children = set(page.parent)
    return [page.add(node, "#text", "") if node in has_children else node for node, _, _ in page.runs]


_TAG_IDS = {t: i for i, t in enumerate(TAGS)}
N_FEATURES = 33


def _hints(attrs: str) -> tuple[int, int]:
    good = bad = 0
    if attrs:
        for m in _named.finditer(attrs):
            for t in _token.findall(m[1] or m[2] or m[3] or ""):
                t = t.lower()
                good += t in GOOD_TOKENS
                bad += t in BAD_TOKENS
    return good, bad


def features(page: Page, nodes: list[int]) -> np.ndarray:
    """A row a node."""
    n = len(page.parent)
    parent, tag, depth = page.parent, page.tag, page.depth
    chars, linked, stops, n_words, tags, runs = ([0] * n for _ in range(6))
    first, children, place = [-1] * n, [0] * n, [0] * n
    total = 0
    for (_, text, link), node in zip(page.runs, nodes, strict=True):
        chars[node] += len(text)
        linked[node] += min(link, len(text))
        stops[node] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        n_words[node] += text.count(" ") + 1
        runs[node] += 1
        if first[node] < 0:
            first[node] = total
        total += len(text)
    paragraphs = [int(t == "p") for t in tag]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        stops[p] += stops[i]
        n_words[p] += n_words[i]
        tags[p] += tags[i] + 1
        runs[p] += runs[i]
        paragraphs[p] += paragraphs[i]
        if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
            first[p] = first[i]
    good, bad, up_good, up_bad, up_tag = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    same: dict[tuple[int, str], int] = {}
    before = [0] * n
    last_child: dict[int, int] = {}
    for i in range(n):
        p = parent[i]
        good[i], bad[i] = _hints(page.attrs[i])
        if p >= 0:
            place[i] = children[p]
            children[p] += 1
            same[p, tag[i]] = same.get((p, tag[i]), 0) + 1
            up_good[i], up_bad[i] = up_good[p] + good[p], up_bad[p] + bad[p]
            t = tag[p]
            up_tag[i] = up_tag[p] | (t in ("article", "main")) | (t in ("nav", "menu", "footer", "aside", "form", "dialog", "button", "select", "search")) * 2 | (t == "header") * 4
            before[i] = chars[last_child[p]] if p in last_child else -1
            last_child[p] = i
    out = np.zeros((n, N_FEATURES), np.float32)
    whole = max(1, total)
    log = math.log1p
    for i in range(n):
        p, c = parent[i], chars[i]
        near = tag[i] if tag[i] != "#text" else tag[p]
        out[i] = (
            _TAG_IDS.get(tag[i], len(TAGS)), near in ("article", "main"), near in ("nav", "menu"), near == "footer", near == "header", near in ("aside", "form", "button", "select", "textarea", "dialog", "search"),
            near in ("p", "pre", "blockquote"), near in ("h1", "h2", "h3", "h4"), near in ("li", "ul", "ol", "td", "table"),
            good[i], bad[i], up_good[i], up_bad[i], up_tag[i] & 1, (up_tag[i] >> 1) & 1, (up_tag[i] >> 2) & 1,
            log(c), linked[i] / c if c else 0, stops[i] / max(1, n_words[i]), log(n_words[i]), log(tags[i]), c / (1 + tags[i]), c / max(1, runs[i]), log(paragraphs[i]),
            depth[i], place[i], children[p] if p >= 0 else 1, same[p, tag[i]] / children[p] if p >= 0 else 1, log(before[i]) if before[i] >= 0 else -1,
            c / whole, c / max(1, chars[p]) if p >= 0 else 1, max(first[i], 0) / whole, children[i],
        )
    return out


def decode(page: Page, some: np.ndarray, only: np.ndarray) -> list[bool]:
    """For every node whether all of its text is main text, by the best consistent labelling."""
    n = len(page.parent)
    tiny = 1e-6
    none, every, mixed = np.log(1 - some + tiny), np.log(some * only + tiny), np.log(some * (1 - only) + tiny)
    s_none, s_every, s_mixed = none.tolist(), every.tolist(), mixed.tolist()
    inner = [False] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        inner[p] = True
        if not inner[i]:
            s_mixed[i] = -math.inf  # no children to differ
        s_none[p] += s_none[i]
        s_every[p] += s_every[i]
        s_mixed[p] += max(s_none[i], s_every[i], s_mixed[i])
    if not inner[0]:
        s_mixed[0] = -math.inf
    label = [0] * n
    for i in range(n):
        up = label[page.parent[i]] if i else 2
        if up != 2:
            label[i] = up
        else:
            label[i] = max((s_none[i], 0), (s_every[i], 1), (s_mixed[i], 2))[1]
    return [x == 1 for x in label]


_MAIN = "the of and to in is that for with as on by from are was which this be it at or an have not their more one".split()


def training_page(rng: random.Random) -> tuple[str, list[str]]:
    """A page and its main blocks."""
    syllables = [a + b for a in "b c d f g l m n p r s t v th st an er in on es".split() for b in "a e i o u".split()]
    word = lambda: rng.choice(_MAIN) if rng.random() < 0.4 else "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    style = rng.choice(("plain",) * 7 + ("capitals", "symbols", "bare"))

    def sentence(least: int = 3, most: int = 18) -> str:
        own = [word() for _ in range(rng.randint(least, most))]
        if style == "symbols":
            own = [x + rng.choice(("%%%", "***", "###", "")) for x in own]
        said = (own[0].capitalize() + " " + " ".join(x + ("," if rng.random() < 0.08 else "") for x in own[1:])).strip(" ,")
        return said.upper() + "!!" if style == "capitals" else said if style == "bare" else said + rng.choice("....!?")

    def heading(least: int, most: int) -> str:
        said = sentence(least, most)
        return said if rng.random() < 0.3 else said[: rng.randint(len(said) // 2, len(said))].rstrip(".!? ") or said

    text = lambda least, most: " ".join(sentence() for _ in range(rng.randint(least, most)))
    menu = lambda: "<ul>" + "".join(f'<li><a href="/{word()}">{" ".join(word() for _ in range(rng.randint(1, 3)))}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"
    named = lambda *xs: f' {rng.choice(("class", "id"))}="{rng.choice(xs)}"'
    maybe = lambda *xs: named(*xs) if rng.random() < 0.5 else ""
    main: list[str] = []

    def block(tag: str, content: str) -> str:
        main.append(" ".join(content.split()))
        loose = rng.random()
        if tag == "p" and loose < 0.15:
            return f"<p><b>{content}<br>"
        if loose < 0.3:
            a, _, b = content.partition(" ")
            content = f"<{(t := rng.choice(('b', 'i', 'em', 'a href="/x"', 'span')))}>{a}</{t.split()[0]}> {b}"
        return f"<{tag}>{content}</{tag}>" if tag != "p" or rng.random() < 0.9 else f"<p>{content}"

    boiler = [
        lambda: f"<nav{maybe('nav', 'menu', 'main-nav')}>{menu()}</nav>",
        lambda: f"<div{named('menu', 'navbar', 'breadcrumbs', 'nav-main')}>{menu()}</div>",
        lambda: f"<header{maybe('site-header', 'top', 'header')}><h1>{sentence(1, 4)}</h1>{menu() if rng.random() < 0.6 else f'<p>{sentence()}</p>'}</header>",
        lambda: f"<div{named('header', 'masthead', 'top-banner')}><h2>{sentence(1, 5)}</h2><p>{sentence()}</p></div>",
        lambda: f"<aside{maybe('side', 'left', 'sidebar')}>{rng.choice((menu(), f'<h3>{sentence(1, 3)}</h3><p>{text(1, 3)}</p>'))}</aside>",
        lambda: f"<div{named('sidebar', 'widget', 'related-posts', 'sidebar-right')}><h3>{sentence(1, 3)}</h3>{rng.choice((menu(), f'<p>{text(1, 4)}</p>'))}</div>",
        lambda: f"<div{named('ad', 'ads', 'advert', 'sponsored', 'ad banner', 'promo')}>{rng.choice((sentence(), text(1, 3), f'<p>{text(1, 2)}</p>'))}</div>",
        lambda: f"<div{named('cookie-notice', 'notice', 'gdpr', 'consent', 'alert')}>{rng.choice((text(1, 2), f'<p>{text(1, 2)}</p>'))}<button>{word()}</button></div>",
        lambda: f'<form action="/s"{named("search", "login", "newsletter-signup")}><label>{sentence(1, 4)}</label><input name="q"><button>{word()}</button></form>',
        lambda: f"<{(t := rng.choice(('div', 'section')))}{named('comments', 'comment-list', 'discussion', 'replies')}><h3>{sentence(1, 3)}</h3>" + "".join(f'<{(u := rng.choice(("div", "li", "p")))}{named("comment", "reply")}>{text(1, 4)}</{u}>' for _ in range(rng.randint(1, 6))) + f"</{t}>",
        lambda: f"<script>var a='<p>{word()}</p>';</script><style>p{{margin:0}}</style><!-- {sentence()} -->",
        lambda: f"<ul{named('share', 'social', 'tags')}>" + "".join(f"<li><a href='#'>{word()}</a></li>" for _ in range(3)) + "</ul>",
    ]
    foot = lambda: f"<footer{maybe('footer', 'site-footer')}>{rng.choice((f'&copy; {word()} &middot; {text(1, 2)}', f'<p>{sentence()}</p>' + menu()))}</footer>" if rng.random() < 0.8 else f"<div{named('footer', 'site-footer')}><p>&copy; {sentence()}</p></div>"
    inside = []
    if rng.random() < 0.8:
        inside.append(block(rng.choice(("h1", "h1", "h2")), heading(1, 14)))
    for _ in range(rng.choice((1, 2, 3, 5, 8, 14))):
        kind = rng.random()
        if kind < 0.8:
            inside.append(block("p", text(1, rng.choice((1, 2, 4, 9))) if rng.random() < 0.9 else sentence(1, 2)))
        elif kind < 0.86:
            inside.append(block(rng.choice(("h2", "h3")), heading(1, 6)))
        elif kind < 0.91:
            inside.append("<ul>" + "".join(block("li", sentence(2, 12)) for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.95:
            inside.append(block(rng.choice(("blockquote", "pre")), text(1, 3)))
        else:
            inside.append(boiler[rng.choice((5, 6, 7, 11))]())
    if not main:
        inside.append(block("p", text(1, 3)))
    kind = rng.random()
    if kind < 0.45:
        article = f"<article{maybe('post', 'entry', 'story', 'a1')}>{''.join(inside)}</article>"
    elif kind < 0.6:
        article = f"<main{maybe('content', 'm1')}>{''.join(inside)}</main>"
    elif kind < 0.7:
        article = f"<main><article{named('post', 'entry')}>{''.join(inside)}</article>{rng.choice(boiler)()}</main>"
    else:
        article = f"<div{named('content', 'article', 'post-body', 'entry-content', 'story', 'main-content', 'c1')}>{''.join(inside)}</div>"
    top = [rng.choice(boiler[:4])() for _ in range(rng.randint(0, 2))] + [rng.choice(boiler[4:])() for _ in range(rng.randint(0, 3))]
    rest = [rng.choice(boiler[4:])() for _ in range(rng.randint(0, 3))] + [foot()] * (rng.random() < 0.85)
    wrap = rng.random() < 0.3
    body = ("<div id='page'>" if wrap else "") + "".join(top) + article + "".join(rest) + ("</div>" if wrap else "")
    tail = "</body></html>" if rng.random() < 0.9 else ""
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{sentence(2, 8)}</title></head><body>{body}{tail}', main


_models: dict[tuple[int, int], tuple[boosting.Trees, boosting.Trees]] = {}


def models(pages: int = TRAIN_PAGES, seed: int = SEED) -> tuple[boosting.Trees, boosting.Trees]:
    """Chance of some main text below a node; chance that it is all, if some is."""
    if (pages, seed) not in _models:
        rng, xs, some, only = random.Random(seed), [], [], []
        for _ in range(pages):
            source, main = training_page(rng)
            page, left = parse(source), list(main)
            nodes = split_runs(page)
            n = len(page.parent)
            good, bad = [0] * n, [0] * n
            for (_, text, _), node in zip(page.runs, nodes, strict=True):
                if left and text == left[0]:
                    left.pop(0)
                    good[node] += len(text)
                else:
                    bad[node] += len(text)
            for i in range(n - 1, 0, -1):
                good[page.parent[i]] += good[i]
                bad[page.parent[i]] += bad[i]
            xs.append(features(page, nodes))
            some += [g > 0 for g in good]
            only += [g > 0 and not b for g, b in zip(good, bad, strict=True)]
        x, some_, only_ = np.concatenate(xs).astype(np.float64), np.array(some), np.array(only)
        _models[pages, seed] = boosting.train(x, some_.astype(float)), boosting.train(x[some_], only_[some_].astype(float))
    return _models[pages, seed]


def main_text(pages: list[str], trees: tuple[boosting.Trees, boosting.Trees]) -> list[str]:
    parsed = [parse(x) for x in pages]
    nodes = [split_runs(p) for p in parsed]
    if not parsed:
        return []
    x = np.concatenate([features(p, k) for p, k in zip(parsed, nodes, strict=True)])
    some, only = (t.probability(x) for t in trees)
    out, at = [], 0
    for page, own in zip(parsed, nodes, strict=True):
        n = len(page.parent)
        keep = decode(page, some[at : at + n], only[at : at + n])
        out.append("\n".join(text for (_, text, _), node in zip(page.runs, own, strict=True) if keep[node]))
        at += n
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page. No shuffle."""
    trees = models()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, _, _ in words.parts(b.column("html"), 1 << 20):
                own = b.slice(at, to - at)
                texts = main_text([x or "" for x in own.column("html").to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([own.column("page_id"), own.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(common.tidy(run), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")


def digests(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
