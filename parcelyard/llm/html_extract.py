"""Main text of web pages by a tree-structured graphical model.

A page is parsed into a tree of block elements and text blocks (inline tags only add to their block). Every node is 1 or 0: holds main
text, or not. A node's potential comes from what it is (tag, words of its class and id, length, share of link text, punctuation), an
edge's from the child's kind and both labels. Sum-product messages, up to the root and down again, give each node's exact marginal; text
blocks of at least ``threshold`` make the page's text. Messages are passed for a batch of pages at once, depth by depth.

The weights are those that make labelled pages likeliest: the gradient is what is observed less what the marginals expect. No table holds
labelled pages, so ``labelled_pages`` writes them: layouts of articles with menus, headers, footers, sidebars, notices, adverts, forms and
reader comments, whose words mean nothing. Any other labelled pages may be given to ``fit``.

Text: character references are decoded, white space within a block (line breaks too) becomes one space, ends are trimmed, blocks are
joined in page order by a line feed. Scripts, styles, templates, comments and other markup hold no text.

Defined results: null and empty pages give an empty text; unclosed and stray tags are repaired as browsers mostly do; a page without
markup is one block; other columns stay, and equal rows give equal texts.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

OPENING = re.compile(r"(/?)([A-Za-z][^\s/<>]*)")
SPECIAL = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")
PIECE = re.compile(r"[a-z]+")

# Kinds of elements in HTML, and words that usual layouts put into classes and ids.
RAW = {"script", "style", "template", "svg", "title", "textarea", "iframe", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"html", "body", "main", "article", "section", "nav", "header", "footer", "aside", "form", "fieldset", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address", "details", "summary", "dialog", "menu", "center", "hgroup", "search", "head"}
BREAKS_P = BLOCKS - {"li", "dt", "dd", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "html", "body", "head", "summary", "figcaption"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
HOLDS = {"ul", "ol", "dl", "table", "menu"}  # what is closed implicitly doesn't reach beyond these
HINTS = {
    "ad": "ad ads adv advert adverts advertisement advertising adsense adslot dfp banner sponsor sponsored sponsors promo promoted promotion outbrain taboola".split(),
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager paging tabs toc skip links".split(),
    "comment": "comment comments commentlist reply replies respond disqus discussion reader readers responses".split(),
    "notice": "cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe subscription signup paywall warning disclaimer message".split(),
    "side": "sidebar side aside widget widgets related recommended recommendations trending popular rail share sharing social teaser more".split(),
    "foot": "footer foot copyright legal imprint colophon bottom".split(),
    "head": "header masthead topbar top logo brand site".split(),
    "form": "form search login register contact".split(),
    "content": "content article post entry story body main text prose page".split(),
}
HINT_OF = {w: h for h, ws in HINTS.items() for w in ws}


def hints(attributes: str) -> tuple[str, ...]:
    """What classes, ids and roles hint at. Only short attributes, which recur, are remembered, so the memory has a bound in bytes."""
    return remembered_hints(attributes) if len(attributes) <= 256 else found_hints(attributes)


def found_hints(attributes: str) -> tuple[str, ...]:
    words = {w for m in ATTRIBUTE.finditer(attributes) for w in PIECE.findall((m[1] or m[2] or m[3] or "").lower())}
    return tuple(sorted({"h:" + HINT_OF[w] for w in words if w in HINT_OF}))


remembered_hints = lru_cache(20_000)(found_hints)


@dataclass
class Page:
    """Nodes in page order: parent (-1: none), depth, feature names, whether a text block; and the texts of the blocks."""

    parent: list[int]
    depth: list[int]
    names: list[tuple[str, ...]]
    block: list[bool]
    texts: list[str]


class Scanner:
    """Markup of a page, one piece after another. Every character is looked at a bounded number of times, whatever the quotes."""

    def __init__(self, page: str):
        self.page, self.open_ended = page, set()
        self.last = page.rfind(">")
        self.unclosed: set[str] = set()  # raw tags of which no end follows any more

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the next closing tag of an element that holds no markup; the page's end if there is none."""
        page = self.page
        if tag in self.unclosed:
            return len(page)
        for m in re.compile(rf"</{tag}(?=[\s>])", re.I).finditer(page, at):
            end = page.find(">", m.end())
            if end >= 0:
                return end + 1
            break  # no bracket follows, so none follows later ones either
        self.unclosed.add(tag)
        return len(page)

    def tag_end(self, at: int) -> int:
        """Behind the tag's closing bracket, which doesn't stand in quotes; if a quote is left open, behind the first bracket; -1 if there is none."""
        page, chain, begin = self.page, [], at
        while (m := SPECIAL.search(page, at)) is not None and m.start() not in self.open_ended:
            s = m.start()
            if page[s] == ">":
                return s + 1
            chain.append(s)
            at = page.find(page[s], s + 1) + 1
            if not at:
                break
        self.open_ended.update(chain)  # whoever comes to one of these finds no end either
        return page.find(">", begin) + 1 or -1

    def pieces(self) -> Iterator[tuple[int, int, str, str, bool]]:
        """(start, end, tag, attributes, closing) of each tag; tag is empty for comments and declarations. The caller may send where to go on."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            m = OPENING.match(page, at)
            if m is not None:
                end = self.tag_end(m.end()) if m.end() <= self.last else -1
                if end < 0:
                    continue
                # A name that goes on with "<" is no known tag.
                tag = m[2].lower() + ("<" if page[m.end()] == "<" else "")
                at = (yield start, end, tag, page[m.end() : end - 1], bool(m[1])) or end
            elif page.startswith("!--", at):
                end = page.find("-->", at + 3)
                at = len(page) if end < 0 else end + 3
                yield start, at, "", "", False
            elif page[at : at + 1] in ("!", "?", "/"):
                end = page.find(">", at)
                at = len(page) if end < 0 else end + 1
                yield start, at, "", "", False


def parse(page: str | None) -> Page:
    page = page or ""
    out = Page([-1], [0], [("t:root",)], [False], [])
    stack: list[tuple[str, int]] = [("root", 0)]
    places: dict[str, list[int]] = {}  # of each tag, where it stands in the stack
    pieces: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = "".join(pieces)
            if "&" in text:
                text = entities.unescape(text)
            text = SPACE.sub(" ", text).strip()
            if text:
                tag, node = stack[-1]
                n = len(text)
                share = linked / n
                out.parent.append(node)
                out.depth.append(out.depth[node] + 1)
                out.block.append(True)
                out.names.append((f"b:{tag}", f"n:{min(n.bit_length(), 9)}", "l:0" if share < 0.1 else "l:1" if share < 0.6 else "l:2", "p:1" if text[-1] in ".!?:;\"”»" else "p:0"))
                out.texts.append(text)
            pieces = []
        linked = 0

    def close(upto: int) -> None:
        while len(stack) > upto:
            places[stack.pop()[0]].pop()

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    scanner = Scanner(page)
    found, jump = scanner.pieces(), None
    while True:
        try:
            start, end, tag, attributes, closing = found.send(jump)
        except StopIteration:
            pieces.append(page[at:])
            break
        jump = None
        if start > at:
            pieces.append(page[at:start])
            if in_link:
                linked += start - at
        at = end
        if not tag:
            continue
        if closing:
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS and (k := nearest((tag,))):
                flush()
                close(k)
            continue
        if tag in RAW:
            if attributes.endswith("/") and tag == "svg":
                continue
            at = jump = scanner.raw_end(tag, at)
            continue
        if tag == "a":
            in_link = 1
        elif tag == "br" or tag == "hr":
            pieces.append(" ")
            if tag == "hr":
                flush()
        elif tag in BLOCKS:
            flush()
            if tag in BREAKS_P and stack[-1][0] == "p":
                close(len(stack) - 1)
            if (ends := CLOSES.get(tag)) is not None and (k := nearest(ends)) > nearest(HOLDS):
                while stack[k - 1][0] in ends:
                    k -= 1
                close(k)
            parent = stack[-1][1]
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, len(out.parent)))
            out.parent.append(parent)
            out.depth.append(out.depth[parent] + 1)
            out.block.append(False)
            out.names.append((f"t:{tag}", *hints(attributes)))
    flush()
    return out


class TreeModel:
    """Weights of node features and of edges, and exact marginals over any number of trees at once."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.unary = np.zeros(0)
        self.edge = np.zeros((2, 2, 2))  # child a text block or not, parent's label, child's label

    def arrays(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parent, depth, block, node, feature, base = [], [], [], [], [], 0
        for p in pages:
            parent += [x + base if x >= 0 else -1 for x in p.parent]
            depth += p.depth
            block += p.block
            for k, names in enumerate(p.names):
                for name in names:
                    if (f := self.index.get(name)) is not None:
                        node.append(base + k)
                        feature.append(f)
            base += len(p.parent)
        return np.array(parent, np.int64), np.array(depth, np.int64), np.array(block, np.int64), np.array(node, np.int64), np.array(feature, np.int64)

    def marginals(self, parent, depth, block, node, feature) -> tuple[np.ndarray, np.ndarray]:
        """P(node is 1), and P(parent's label, node's label) of each edge."""
        n = len(parent)
        up = np.zeros((n, 2))
        up[:, 1] = np.bincount(node, self.unary[feature], n)
        own_edge = self.edge[block]
        sent = np.zeros((n, 2))
        levels = [np.nonzero(depth == d)[0] for d in range(int(depth.max(initial=0)) + 1)] if n else []
        if len(levels) > 400:  # rarely so deep: sorted once instead
            order = np.argsort(depth, kind="stable")
            levels = np.split(order, np.searchsorted(depth[order], np.arange(1, len(levels))))
        for level in levels[:0:-1]:
            z = own_edge[level] + up[level][:, None, :]
            sent[level] = np.logaddexp(z[..., 0], z[..., 1])
            np.add.at(up, parent[level], sent[level])
        down = np.zeros((n, 2))
        pair = np.zeros((n, 2, 2))
        for level in levels[1:]:
            above = (up + down)[parent[level]] - sent[level]
            z = above[:, :, None] + own_edge[level]
            down[level] = np.logaddexp(z[:, 0], z[:, 1])
            z = z + up[level][:, None, :]
            pair[level] = np.exp(z - np.logaddexp.reduce(z.reshape(-1, 4), axis=1)[:, None, None])
        both = up + down
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700))), pair

    def fit(self, pages: list[Page], main: list[list[bool]], steps: int = 150, rate: float = 0.15, ridge: float = 2e-3) -> TreeModel:
        """``main``: for each page, which of its text blocks are main text."""
        seen = sorted({name for p in pages for names in p.names for name in names})
        self.index = {name: k for k, name in enumerate(seen)}
        self.unary, self.edge = np.zeros(len(seen)), np.zeros((2, 2, 2))
        trees = self.arrays(pages)
        parent, depth, block, node, feature = trees
        label = np.zeros(len(parent), np.int64)
        base = 0
        for p, flags in zip(pages, main, strict=True):
            texts = iter(flags)
            for k, is_text in enumerate(p.block):
                if is_text and next(texts):
                    at = base + k
                    while at >= 0 and not label[at]:
                        label[at] = 1
                        at = parent[at]
            base += len(p.parent)
        child = np.nonzero(parent >= 0)[0]
        observed_edge = np.zeros((2, 2, 2))
        np.add.at(observed_edge, (block[child], label[parent[child]], label[child]), 1)
        observed = np.bincount(feature, label[node], len(seen))
        theta = np.zeros(len(seen) + 8)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            self.unary, self.edge = theta[:-8], theta[-8:].reshape(2, 2, 2)
            one, pair = self.marginals(*trees)
            expected_edge = np.zeros((2, 2, 2))
            np.add.at(expected_edge, block[child], pair[child])
            slope = np.concatenate([observed - np.bincount(feature, one[node], len(seen)), (observed_edge - expected_edge).ravel()]) / len(pages) - ridge * theta
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.unary, self.edge = theta[:-8], theta[-8:].reshape(2, 2, 2)
        return self

    def texts(self, pages: list[str | None], threshold: float = 0.5) -> list[str]:
        parsed = [parse(p) for p in pages]
        one, _ = self.marginals(*self.arrays(parsed))
        out, base = [], 0
        for p in parsed:
            own = one[base : base + len(p.parent)]
            base += len(p.parent)
            blocks = [k for k, b in enumerate(p.block) if b]
            out.append("\n".join(t for k, t in zip(blocks, p.texts, strict=True) if own[k] >= threshold))
        return out


MARK = "\ue001"


def labelled_pages(count: int = 320, seed: int = 5) -> tuple[list[Page], list[list[bool]]]:
    """Pages of usual layouts; main text carries a mark, which is taken off after parsing."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(1, 9)))
    words = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))
    sentence = lambda: words(3, 18).capitalize() + r.choice(".....!?")
    prose = lambda: " ".join(sentence() for _ in range(r.randint(1, 7))) if r.random() < 0.8 else words(1, 8)
    some = lambda *x: r.choice(x)

    def links(tag: str = "ul", cls: str = "") -> str:
        return f"<{tag}{cls}>" + "".join(f'<li><a href="/{word()}">{words(1, 3)}</a></li>' for _ in range(r.randint(2, 7))) + f"</{tag}>"

    def main_blocks() -> str:
        out = [f"<h1>{MARK}{words(2, 9)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.randint(1, 9)):
            x = r.random()
            if x < 0.68:
                text = MARK + some("", "<b>", "<i>") + prose() + (f' <a href="/{word()}">{words(1, 3)}</a> {words(1, 6)}.' if r.random() < 0.2 else "") + some("", "", "<br>")
                out.append(f"<p>{text}" + some("</p>", "</p>", ""))
            elif x < 0.76:
                out.append(f"<h{(n := r.randint(2, 4))}>{MARK}{words(1, 6)}</h{n}>")
            elif x < 0.84:
                t = some("ul", "ol")
                out.append(f"<{t}>" + "".join(f"<li>{MARK}{some(words(1, 6), sentence())}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>")
            elif x < 0.88:
                out.append(f"<blockquote><p>{MARK}{prose()}</p></blockquote>")
            elif x < 0.92:
                out.append(f"<figure><img src='a.png'><figcaption>{MARK}{sentence()}</figcaption></figure>")
            elif x < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{words(1, 3)}</td><td>{MARK}{words(1, 3)}</td></tr>" for _ in range(2)) + "</table>")
            elif x < 0.98:
                out.append(f"<pre>{MARK}{words(3, 12)}</pre>")
            else:
                out.append(f'<div class="{some("ad", "advert", "share", "related")}">{some(sentence(), links())}</div>')
        return "".join(out)

    def bare_blocks() -> str:
        """An article of plain boxes."""
        return (f"<div>{MARK}{words(2, 9)}</div>" if r.random() < 0.3 else "") + "".join(f"<div>{MARK}{prose()}</div>" for _ in range(r.randint(1, 6)))

    def bare_around() -> str:
        """What stands around it there: links in plain boxes or lists, and single words."""
        box = "<div>" + " ".join(f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(r.randint(1, 7))) + "</div>"
        return some(box, box, links(), f"<div>{links()}</div>", f"<div>{words(1, 2)}</div>")

    def around(cls_hint: str) -> str:
        cls = some("class", "id") + f'="{some("", "page-", "site-")}{some(*HINTS[cls_hint])}"'
        return f"<div {cls}>{some(sentence(), '<p>' + prose() + '</p>', links(), '<h3>' + words(1, 3) + '</h3><p>' + sentence() + '</p>')}</div>"

    def comments() -> str:
        one = lambda: some(f"<p>{prose()}</p>", f'<div class="comment"><h4>{words(1, 2)}</h4><p>{prose()}</p></div>', f'<article class="comment"><p>{prose()}</p></article>')
        return f'<{(t := some("section", "div"))} {some("id", "class")}="{some(*HINTS["comment"])}"><h3>{words(1, 2)}</h3>{"".join(one() for _ in range(r.randint(1, 5)))}</{t}>'

    pages, main = [], []
    for _ in range(count):
        before, after = [], []
        maybe = lambda p, to, x: to.append(x) if r.random() < p else None
        maybe(0.6, before, f"<header>{some('', f'<h1>{words(1, 3)}</h1>', f'<p>{words(1, 5)}</p>')}{some('', links())}</header>")
        maybe(0.7, before, f"<nav>{links()}</nav>")
        for kind in ("ad", "menu", "notice", "head", "side"):
            maybe(0.25, before, around(kind))
        maybe(0.2, before, f"<form action='/'><label>{words(1, 3)}</label><input name=q><p>{words(2, 6)}</p></form>")
        maybe(0.4, after, f"<aside>{some(links(), '<h3>' + words(1, 3) + '</h3><p>' + prose() + '</p>', '<p>' + prose() + '</p>')}</aside>")
        for kind in ("ad", "side", "notice", "foot", "form"):
            maybe(0.25, after, around(kind))
        inside = comments() if r.random() < 0.25 else ""
        maybe(0.3, after, comments())
        maybe(0.8, after, f"<footer>{some(words(2, 8), '<p>' + prose() + '</p>', links(), prose())}</footer>")
        holder = r.random()
        if r.random() < 0.15:  # no element and no class says what is what
            before, after = ([bare_around() for _ in range(r.randint(0, 2))] for _ in range(2))
            inner = some(bare_blocks(), bare_blocks(), "".join(f"<p>{MARK}{prose()}</p>" for _ in range(r.randint(1, 6))))
            body = some(inner, f"<div>{inner}</div>", f"<div><div>{inner}</div></div>")
        elif holder < 0.6:
            body = f"<article>{main_blocks()}{inside}</article>"
        elif holder < 0.75:
            body = f"<main>{some('<article>', '<section>')}{main_blocks()}{inside}</main>"
        elif holder < 0.95:
            body = f'<div {some("class", "id")}="{some(*HINTS["content"])}">{main_blocks()}{inside}</div>'
        else:
            body = f"<div>{main_blocks()}</div>"
        if r.random() < 0.3:
            body = f'<div class="{some("container", "wrapper", "row", "page")}">{"".join(before)}{body}{"".join(after)}</div>'
        else:
            body = "".join(before) + body + "".join(after)
        page = parse(f"<!DOCTYPE html><html><head><title>{words(1, 4)}</title></head><body>{body}" + some("</body></html>", ""))
        main.append([t.startswith(MARK) for t in page.texts])
        pages.append(page)
    return pages, main


def fit() -> TreeModel:
    return TreeModel().fit(*labelled_pages())


def extracted(pages: DataFrame, model: TreeModel | None = None, html: str = "html", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``pages`` with the main text in place of the html."""
    sent = pages.sparkSession.sparkContext.broadcast(model or fit())  # some hundred weights

    @F.pandas_udf(T.StringType())
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in batches:
            out: list[str] = []
            for at in range(0, len(some), 256):
                out += sent.value.texts(some.iloc[at : at + 256].tolist(), threshold)
            yield pd.Series(out, index=some.index)

    name = free_name(pages.drop(html), text)
    return pages.withColumn(name if name != html else "_text", read(F.col(html))).drop(html)
