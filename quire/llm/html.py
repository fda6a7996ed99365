"""Main text of web pages, by gradient-boosted trees over DOM nodes with hierarchical decoding.

A page is parsed into its block elements.  The trees score each of them from its tag, attribute tokens, depth, siblings
and subtree (text, links, tags); they are trained here, on pages made up from a seed, whose parts are known.  Decoding
picks the cheapest choice for the whole tree under one rule: what stands in a dropped element is dropped as well.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .gbt import Forest, fit

#: Elements by their role in HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "textarea", "title", "select", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
#: An element closes an open one of these, up to the nearest of the fences.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
AWAY = ("nav", "menu", "navbar", "breadcrumb", "breadcrumbs", "header", "masthead", "banner", "footer", "foot", "colophon", "copyright", "sidebar", "aside", "side", "widget", "rail", "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "comment", "comments", "respond", "reply", "replies", "disqus", "discussion", "share", "social", "follow", "related", "recommended", "subscribe", "newsletter", "signup", "login", "search", "form", "tags", "pagination", "toolbar", "skip", "legal", "rights", "disclaimer", "terms", "privacy", "imprint", "thread", "responses", "reviews", "feedback")
HOME = ("article", "content", "main", "post", "entry", "story", "body", "text", "page", "prose", "hentry")
TAGS = (("nav", "menu"), ("header",), ("footer",), ("aside",), ("form", "fieldset", "button", "input", "select", "dialog"), ("article", "main"), ("p", "pre", "blockquote"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "tbody", "thead", "tr", "td", "th"), ("div", "section"), ("body", "html"), ("figure", "figcaption"))

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|![^>]*+>|\?[^>]*+>|(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)>)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_SPACE = re.compile(r"\s+")
#: What stands at the head of reader comments, and in legal notices, in some languages.
_COMMENTS = re.compile(r"\b(?:comments?|responses?|repl(?:y|ies)|reader (?:opinions|letters)|kommentare?|leserbriefe|commentaires?|réactions?|comentarios?|respuestas?)\b", re.I)
_LEGAL = re.compile(r"©|\(c\) ?(?:19|20)\d\d|\bcopyright\b|\ball rights reserved\b|\balle rechte vorbehalten\b|\btous droits réservés\b|\btodos los derechos reservados\b", re.I)
HEAD_CHARS, LEGAL_CHARS = 60, 300
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")
_AWAY, _HOME = frozenset(AWAY), frozenset(HOME)
_ROLE = {t: i for i, g in enumerate(TAGS) for t in g}


class Page:
    """Block elements of a page: parent, tag, attribute tokens; and its text blocks in order, with the element of each."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.attrs = ["#page"], [-1], [0], [""]
        self.chars, self.linked, self.tags, self.breaks = [0], [0], [1], [0]
        self.blocks: list[tuple[int, str]] = []
        stack = [0]
        text: list[str] = []
        links = 0
        at = 0
        lower = None

        def add(raw: str) -> None:
            if raw:
                text.append(raw)
                n = len(raw)
                self.chars[stack[-1]] += n
                if links:
                    self.linked[stack[-1]] += n

        def end_block() -> None:
            if text:
                t = _SPACE.sub(" ", html.unescape("".join(text))).strip()
                text.clear()
                if t:
                    self.blocks.append((stack[-1], t))

        while True:
            m = _TAG.search(source, at)
            if m is None:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            name = name.lower()
            if m[1] or m[4]:
                if name == "a":
                    links = max(0, links - 1)
                elif name == "p" and all(self.tag[i] != "p" for i in stack):
                    end_block()
                elif name not in INLINE and name not in VOID:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] == name:
                            end_block()
                            del stack[k:]
                            links = 0
                            break
                continue
            self.tags[stack[-1]] += 1
            if name == "br":
                text.append(" ")
                self.breaks[stack[-1]] += 1
                continue
            if name == "a":
                links = 1
                continue
            if name in INLINE:
                continue
            if name in VOID:
                if name == "hr":
                    end_block()
                continue
            if name in RAW:
                if not (m[3] or m[6] or "").endswith("/"):
                    if lower is None:
                        lower = source.lower()
                    end = lower.find(f"</{name}", at)
                    at = len(source) if end < 0 else (source.find(">", end) + 1 or len(source))
                continue
            end_block()
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == "p":
                        del stack[k:]
                        break
                    if self.tag[stack[k]] not in ("p", "b"):
                        break
            if name in CLOSES:
                closed, fence = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] in fence:
                        break
                    if self.tag[stack[k]] in closed:
                        del stack[k:]
            links = 0
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            raw = m[3] or m[6] or ""
            self.attrs.append(" ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(raw)) if "=" in raw else "")
            for x in (self.chars, self.linked, self.breaks):
                x.append(0)
            self.tags.append(1)
            stack.append(len(self.tag) - 1)
        end_block()


@functools.lru_cache(1 << 16)
def attribute_hits(attrs: str) -> tuple[int, int]:
    tokens = [t.lower() for t in _CAMEL.split(attrs) if t]
    return sum(t in _AWAY for t in tokens), sum(t in _HOME for t in tokens)


FEATURES = (*(f"tag_{g[0]}" for g in TAGS), "away", "home", "parent_away", "parent_home", "depth", "siblings", "place", "chars", "chars_share", "link_share", "density", "size", "child_away", "under_home", "under_away", "comment_head", "under_comment_head", "legal", "twins")


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    chars, linked, tags, size = page.chars[:], page.linked[:], page.tags[:], [1] * n
    kids = [0] * n
    place = [0] * n
    away = [0] * n
    hits = [attribute_hits(a) if a else (0, 0) for a in page.attrs]
    under = [(0, 0)] * n
    for i in range(1, n):
        p = page.parent[i]
        role = page.tag[p]
        under[i] = (under[p][0] + (role in ("article", "main") or hits[p][1] > 0), under[p][1] + (role in ("nav", "menu", "header", "footer", "aside", "form") or hits[p][0] > 0))
        place[i] = kids[page.parent[i]]
        kids[page.parent[i]] += 1
    # an element begins a thread of comments if its first text is a short one that says so
    first: list[str | None] = [None] * n
    legal = [0] * n
    for i, t in page.blocks:
        legal[i] |= len(t) <= LEGAL_CHARS and _LEGAL.search(t) is not None
        while first[i] is None:
            first[i] = t
            if not i:
                break
            i = page.parent[i]
    said = [t is not None and len(t) <= HEAD_CHARS and _COMMENTS.search(t) is not None and page.tag[i] not in ("#page", "html", "body") for i, t in enumerate(first)]
    below = [False] * n
    alike: dict[tuple[int, str, str], int] = {}
    for i in range(1, n):
        p = page.parent[i]
        below[i] = below[p] or said[p]
        key = (p, page.tag[i], page.attrs[i])
        alike[key] = alike.get(key, 0) + 1
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        tags[p] += tags[i]
        size[p] += size[i]
        away[p] += hits[i][0] > 0
    whole = max(1, chars[0])
    out = np.zeros((n, len(FEATURES)))
    k = len(TAGS)
    for i in range(n):
        role = _ROLE.get(page.tag[i])
        if role is not None:
            out[i, role] = 1
        p = max(0, page.parent[i])
        out[i, k:] = (*hits[i], *hits[p], page.depth[i], kids[p], place[i] / max(1, kids[p]), math.log1p(chars[i]), chars[i] / whole, linked[i] / max(1, chars[i]), chars[i] / tags[i], math.log1p(size[i]), away[i], *under[i], said[i], below[i], legal[i], alike.get((page.parent[i], page.tag[i], page.attrs[i]), 1) / max(1, kids[p]))
    return out


# ---------------------------------------------------------------- training pages


def made_up(rng: random.Random) -> tuple[str, list[int]]:
    """A page and, for each of its block elements in order, whether main text stands in it."""
    truth: list[int] = [1]
    alphabet = ["ka", "re", "tion", "mo", "sel", "in", "dor", "a", "the", "qui", "lan", "o", "fer", "un"]
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    def el(tag: str, main: int, inner: str = "", cls: str = "") -> tuple[str, str]:
        truth.append(main)
        kind = rng.choice(["class", "class", "id"])
        extra = rng.choice(["", "", f"{word()} "]) if cls else ""
        return f"<{tag}{f' {kind}=\"{extra}{cls}\"' if cls else ''}>{inner}", f"</{tag}>"

    def links(n: int) -> str:
        out = el("ul", 0)
        body = ""
        for _ in range(n):
            a, b = el("li", 0, f'<a href="/{word()}">{words(1, 3)}</a>')
            body += a + b
        return out[0] + body + out[1]

    def away() -> str:
        kind = rng.randrange(10)
        tag = rng.choice(["div", "div", "section"])
        if kind == 0:
            a = el("nav", 0, cls=rng.choice(["", "", "menu", "main nav"])) if rng.random() < 0.6 else el(tag, 0, cls=rng.choice(["nav", "menu", "navbar", "breadcrumb", "main menu"]))
            return a[0] + links(rng.randint(2, 9)) + a[1]
        if kind == 1:
            a = el("header", 0, cls=rng.choice(["", "site header", "masthead"])) if rng.random() < 0.6 else el("div", 0, cls=rng.choice(["header", "masthead", "page header", "banner"]))
            b = el(rng.choice(["h1", "h2", "p", "div"]), 0, words(1, 5))
            return a[0] + b[0] + b[1] + (links(rng.randint(1, 5)) if rng.random() < 0.5 else "") + a[1]
        if kind == 2:
            a = el("footer", 0, f"&copy; {words(2, 20)}") if rng.random() < 0.6 else el(rng.choice(["div", "p"]), 0, rng.choice(["&copy; 2021 ", "All rights reserved. ", "Copyright 2019 ", "Alle Rechte vorbehalten. "]) + words(1, 20), rng.choice(["", "legal", "bottom"])) if rng.random() < 0.4 else el("div", 0, words(3, 20), rng.choice(["footer", "copyright", "site footer", "legal", "disclaimer", "terms"]))
            return a[0] + (links(rng.randint(1, 4)) if rng.random() < 0.4 else "") + a[1]
        if kind == 3:
            a = el("aside", 0, cls=rng.choice(["", "sidebar"])) if rng.random() < 0.5 else el("div", 0, cls=rng.choice(["sidebar", "widget", "right rail", "side", "related", "recommended posts"]))
            b = el(rng.choice(["h3", "h2", "p"]), 0, words(1, 6))
            c = el("p", 0, words(5, 40))
            return a[0] + b[0] + b[1] + c[0] + c[1] + (links(rng.randint(1, 6)) if rng.random() < 0.6 else "") + a[1]
        if kind == 4:
            a = el(tag, 0, words(3, 30) if rng.random() < 0.7 else "", rng.choice(["cookie notice", "consent", "notice", "alert", "popup", "cookie banner", "gdpr"]))
            b = el("p", 0, words(3, 40))
            return a[0] + b[0] + b[1] + a[1]
        if kind in (5, 6):
            a = el(rng.choice(["div", "div", "aside"]), 0, words(3, 40), rng.choice(["ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad slot"]))
            return a[0] + a[1]
        if kind == 7:
            a = el("form", 0, f'<label>{words(1, 4)}</label><input name="q">', rng.choice(["", "search", "newsletter", "subscribe", "login"]))
            b = el("p", 0, words(2, 20))
            return a[0] + b[0] + b[1] + a[1]
        if kind == 8:
            plain = rng.random() < 0.3
            a = el(rng.choice(["section", "div"]) if plain else rng.choice(["section", "div", "ol"]), 0, cls=rng.choice(["", "", "bottom"]) if plain else rng.choice(["comments", "comment list", "discussion", "replies", "reader comments", "disqus", "thread", "responses"]))
            out = a[0]
            if plain or rng.random() < 0.3:
                b = el(rng.choice(["h2", "h3", "h4", "p"]), 0, rng.choice(["Comments", f"{rng.randint(1, 40)} comments", f"Comments ({rng.randint(1, 9)})", "Responses", "Leave a reply", "Kommentare", f"{rng.randint(2, 30)} commentaires", "Comentarios", "Replies"]))
                out += b[0] + b[1]
            shell, name = rng.choice(["div", "article"]), rng.choice(["", "", "item", "user"])
            for _ in range(rng.randint(1, 5)):
                b = el(shell, 0, cls=name) if plain else el(rng.choice(["div", "li", "article"]), 0, cls=rng.choice(["comment", "reply", "comment body"]))
                c = el("p", 0, words(3, 60))
                out += b[0] + c[0] + c[1] + b[1]
            return out + a[1]
        a = el("div", 0, f'<a href="#">{word()}</a> <a href="#">{word()}</a>', rng.choice(["share", "social", "tags", "pagination", "follow"]))
        return a[0] + a[1]

    def home() -> str:
        style = rng.randrange(7)
        shells = {0: [("article", "")], 1: [("main", ""), ("article", "")], 2: [("div", rng.choice(["content", "post", "entry content", "article body", "story", "main"]))], 3: [("main", rng.choice(["", "content"]))], 4: [("div", ""), ("section", rng.choice(["", "post", "text"]))], 5: [], 6: [("article", rng.choice(["post", "hentry", "story"]))]}[style]
        open_, close = "", ""
        for t, c in shells:
            a = el(t, 1, cls=c)
            open_, close = open_ + a[0], a[1] + close
        out = ""
        if rng.random() < 0.8:
            inside = bool(shells) and shells[-1][0] in ("article", "main") and rng.random() < 0.45
            b = el("header", 1, cls=rng.choice(["", "", "entry header", "post header"])) if inside else ("", "")
            a = el("h1", 1, words(2, 10))
            out += b[0] + a[0] + a[1]
            if inside and rng.random() < 0.6:
                c = el("p", 1, words(2, 25))
                out += c[0] + c[1]
            out += b[1]
        for _ in range(rng.choice([1, 1, 2, 3, 5, 9])):
            kind = rng.random()
            if kind < 0.7:
                a = el("p", 1, (f"<b>{words(1, 4)}</b> " if rng.random() < 0.2 else "") + words(1, 120) + (f' <a href="/x">{words(1, 3)}</a> {words(1, 9)}' if rng.random() < 0.2 else ""))
                out += a[0] + a[1]
            elif kind < 0.78:
                a = el(rng.choice(["h2", "h3"]), 1, words(1, 7))
                out += a[0] + a[1]
            elif kind < 0.86:
                a = el(rng.choice(["ul", "ol"]), 1)
                out += a[0]
                for _ in range(rng.randint(1, 5)):
                    b = el("li", 1, words(2, 20))
                    out += b[0] + b[1]
                out += a[1]
            elif kind < 0.9:
                a, b, c = el("table", 1), el("tr", 1), el("td", 1, words(1, 8))
                out += a[0] + b[0] + c[0] + c[1] + b[1] + a[1]
            elif kind < 0.94:
                a = el(rng.choice(["blockquote", "pre", "figure"]), 1, words(3, 40))
                out += a[0] + a[1]
            else:
                out += away()
        if rng.random() < 0.25:
            # an article may end on such words of its own, and speak of comments
            a = el("p", 1, rng.choice(["All rights reserved.", "<b>All rights reserved.</b>", f"&copy; 2020 {words(1, 4)}", f"{words(1, 4)} comments {words(1, 9)}", "Responses", "Alle Rechte vorbehalten."]))
            out += a[0] + a[1]
        return open_ + out + close

    truth.append(1)
    truth.append(0)
    truth.append(1)
    head = f"<html><head><title>{words(2, 8)}</title></head><body>"
    return head + "".join(away() for _ in range(rng.randint(0, 4))) + home() + "".join(away() for _ in range(rng.randint(0, 4))) + "</body></html>", truth


@functools.cache
def forest(pages: int = 500, seed: int = 11) -> Forest:
    """Trees from made-up pages."""
    rng = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        source, truth = made_up(rng)
        page = Page(source)
        if len(page.tag) != len(truth):
            raise AssertionError("a made-up page was not parsed as it was made")
        x.append(features(page))
        y.append(truth)
    return fit(np.concatenate(x), np.concatenate(y).astype(float), trees=40, depth=4, rate=0.3, least=10)


# ---------------------------------------------------------------- decoding


def decode(parent: list[int], keep: np.ndarray) -> list[bool]:
    """The cheapest choice over a tree in page order, where nothing below a dropped element is kept."""
    p = np.clip(keep, 1e-6, 1 - 1e-6)
    with_, without = (-np.log(p)).tolist(), (-np.log(1 - p)).tolist()
    for i in range(len(parent) - 1, 0, -1):
        with_[parent[i]] += min(with_[i], without[i])
        without[parent[i]] += without[i]
    out = [True] * len(parent)
    for i in range(1, len(parent)):
        out[i] = out[parent[i]] and with_[i] <= without[i]
    return out


def main_text(sources: list[str], trees: Forest) -> list[str]:
    pages = [Page(s) for s in sources]
    x = [features(p) for p in pages]
    score = trees.score(np.concatenate(x)) if x else np.zeros(0)
    out, at = [], 0
    for p in pages:
        n = len(p.tag)
        kept = decode(p.parent, score[at : at + n])
        # a head holds no text of the page's body
        kept = [k and t != "head" for k, t in zip(kept, p.tag)]
        out.append("\n".join(t for i, t in p.blocks if kept[i]))
        at += n
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty html has an empty text; repeated rows are read alike; an empty table gives no rows.  Other columns
    are not looked at.
    """
    trees = forest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in B.pieces(batches, 1 << 20, "html"):
            own = data.tobytes()
            texts = main_text([own[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], trees)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(B.tidy(run), "page_id long, url string, text string, n_chars long")
