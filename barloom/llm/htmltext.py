"""The main text of web pages, by a graphical model on the tree of their elements.

Every block element is a node with an unknown label, content or not. A node's own features (tag, words of class, id and
role, amounts of text and of linked text) give it a potential; parent and child share another one by the kind of the
child. Both are learned from labelled pages. Messages run from the leaves to the root and back (sum-product), level by
level for all pages of a batch at once, and give every node's exact marginal; blocks of text whose element is likelier
content than not make up the text.

Labelled pages are a bounded sample of the given ones that mark their article as such, and composed pages whose parts
carry a label (``data-main``), which bring in parts that the sample may lack.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import table, uniform
from barloom.llm.wordtable import flat

#: Bounds of the training sample: given pages, expected, and composed ones.
GIVEN_PAGES, COMPOSED_PAGES = 150, 250
BUCKETS, STEPS, RATE = 1 << 13, 300, 0.5
#: Share of composed pages whose text lies in the body itself.
BARE = 0.15

# Element names of the HTML standard.
SILENT = set("script style noscript template head title iframe svg object canvas audio video select datalist option button textarea".split())
HEAD_PARTS = set("title base basefont link meta script style noscript template".split())
#: Silent elements that a part of the page ends where their own end is missing; others may well hold such parts.
UNENDED = set("head title iframe object canvas audio video select datalist option button textarea".split())
PAGE_PARTS = set("article main section aside nav header footer body h1 h2 h3 h4 h5 h6 p div ul ol table blockquote".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = set("body article aside blockquote details div dl fieldset figure footer form header main menu nav ol section table tbody ul".split())


@dataclass
class Page:
    """Elements in page order with their parents and features, and blocks of text with the element that holds them."""

    tags: list[str] = field(default_factory=lambda: ["body"])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[list[str]] = field(default_factory=lambda: [[]])
    marks: list[int | None] = field(default_factory=lambda: [None])
    blocks: list[tuple[int, str]] = field(default_factory=list)
    text: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page, self.open, self.silent, self.links, self.parts = Page(), [0], [], 0, []
        #: elements begun within silent ones, and how deep in formulas the text is
        self.inner, self.formulas = [], 0

    def cut(self) -> None:
        """End the block of text that is being read."""
        words = " ".join("".join(self.parts).split())
        self.parts = []
        if words:
            self.page.blocks.append((self.open[-1], words))

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.silent and not self.reopened(tag):
            if tag in SILENT:
                self.silent.append(tag)
            elif tag not in VOID:
                self.inner.append(tag)
            return
        if tag == "math":
            self.formulas += 1
        if self.formulas and tag in PAGE_PARTS:
            self.formulas = 0  # its end is missing
        if self.formulas:
            return  # a formula stands in its line
        if tag == "body":
            self.page.attributes[0] += _named(attrs)
            self.page.marks[0] = _marked(attrs)
            return
        if tag in SILENT:
            # what is not shown doesn't end the line it stands in
            if tag in ("head", "title", "noscript", "template"):
                self.cut()
            self.silent.append(tag)
        elif tag in VOID:
            if tag in ("br", "hr"):
                self.cut()
        elif tag in INLINE:
            self.links += tag == "a"
        elif tag != "html":
            self.cut()
            tags = self.page.tags
            closes = {"p"} if tag in CLOSES_P else SAME.get(tag, set())
            while closes and len(self.open) > 1 and tags[self.open[-1]] in closes:
                self.open.pop()
            self.page.parents.append(self.open[-1])
            tags.append(tag)
            self.page.marks.append(_marked(attrs))
            self.page.attributes.append(_named(attrs))
            self.page.text.append(0)
            self.page.linked.append(0)
            self.open.append(len(tags) - 1)
            self.links = 0 if tag in HOLDERS else self.links

    def reopened(self, tag: str) -> bool:
        """Whether a start tag shows that the silent elements around it lack their end tags."""
        last = self.silent[-1]
        if last == "option" and tag in ("option", "optgroup"):
            self.silent.pop()
            return False
        unended = all(x in UNENDED for x in self.silent)
        if unended and (tag == "body" or (self.silent == ["head"] and tag not in HEAD_PARTS) or (tag in PAGE_PARTS and not self.ended_later())):
            self.silent, self.inner = [], []
            return True
        return False

    def ended_later(self) -> bool:
        """Whether the outermost silent element ends before another of its kind begins."""
        name, rest = self.silent[0], self.rawdata[self.at_hand() :].lower()
        end, again = rest.find(f"</{name}"), rest.find(f"<{name}")
        return end >= 0 and (again < 0 or end < again)

    def at_hand(self) -> int:
        """Where in ``rawdata`` the parser stands."""
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def feed(self, data: str) -> None:
        self.starts = [0, *[i + 1 for i, c in enumerate(data) if c == "\n"]]
        super().feed(data)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
                self.inner = self.inner if self.silent else []
                return
            if tag in self.inner:
                while self.inner.pop() != tag:
                    pass
                return
            # the end of what holds the silent elements ends them as well
            if tag not in ("html", "body") and tag not in (self.page.tags[i] for i in self.open[1:]):
                return
            self.silent, self.inner = [], []
        if self.formulas:
            self.formulas -= tag == "math"
            return
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        if tag in VOID or tag in ("html", "body"):
            return
        self.cut()
        for k in range(len(self.open) - 1, 0, -1):
            if self.page.tags[self.open[k]] == tag:
                del self.open[k:]
                break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            n = len(data)
            self.page.text[self.open[-1]] += n
            if self.links:
                self.page.linked[self.open[-1]] += n


def _named(attrs) -> list[str]:
    out = []
    for key, value in attrs:
        if key in ("class", "id", "role", "itemprop") and value:
            out += [f"{key if key == 'role' else 'name'}={w}" for w in re.split(r"[^a-z]+", value.lower()) if w]
    return out


def _marked(attrs) -> int | None:
    """The label that a composed page carries."""
    mark = dict(attrs).get("data-main")
    return int(mark) if mark in ("0", "1") else None


def read_page(html: str | None) -> Page:
    reader = _Reader()
    if html:
        reader.feed(html)
        # an unended tag at the end is text to the parser only when closed
        reader.close()
    reader.cut()
    return reader.page


def _bucket(n: float) -> int:
    return int(np.log2(n + 1))


def _features(page: Page) -> list[list[int]]:
    n = len(page.tags)
    text, linked, children, paragraphs = list(page.text), list(page.linked), [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        text[page.parents[i]] += text[i]
        linked[page.parents[i]] += linked[i]
        children[page.parents[i]] += 1
        paragraphs[page.parents[i]] += page.tags[i] == "p"
    out = []
    for i, tag in enumerate(page.tags):
        parent = page.tags[page.parents[i]] if i else ""
        names = [f"tag={tag}", f"in={parent}>{tag}", f"text={_bucket(text[i])}", f"links={round(4 * linked[i] / max(1, text[i]))}", f"own={_bucket(page.text[i])}", *page.attributes[i]]
        names.append(f"{tag} p={min(3, paragraphs[i])}")
        names.append(f"{tag} links={round(4 * linked[i] / max(1, text[i]))}")
        out.append([crc32(x.encode()) % BUCKETS for x in names])
    return out


_TIED = {t: k for k, t in enumerate("article main div section aside nav header footer form p li ul".split(), 1)}
KINDS = len(_TIED) + 1


def _kind(tag: str) -> int:
    """The kind of a child that its tie to the parent depends on."""
    return _TIED.get(tag, 0)


@dataclass
class PageModel:
    weights: np.ndarray
    bias: float
    #: log P(child label | parent label) by kind, and log P(label) of the nodes
    ties: np.ndarray
    prior: np.ndarray


def train_pages(pages: list[tuple[Page, list[int]]]) -> PageModel:
    """Fit on pages and the label of every element."""
    features = [f for page, _ in pages for f in _features(page)]
    y = np.array([x for _, labels in pages for x in labels], np.float64)
    numbers, starts = flat(features)
    sizes = np.diff(np.append(starts, len(numbers)))
    owner = np.repeat(np.arange(len(features)), sizes)
    w, b, square = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-3)
    balance = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    for _ in range(STEPS):
        q = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[numbers], len(y)) + b, -30, 30)))
        error = balance * (q - y)
        g = np.bincount(numbers, error[owner], BUCKETS) + 1e-5 * w
        square += g * g
        w -= RATE * g / np.sqrt(square)
        b -= RATE * error.sum()
    ties = np.full((KINDS, 2, 2), 0.5)
    for page, labels in pages:
        for i in range(1, len(labels)):
            ties[_kind(page.tags[i]), labels[page.parents[i]], labels[i]] += 1
    # the balanced classifier has an even prior, so its odds are a likelihood
    return PageModel(w, b, np.log(ties / ties.sum(axis=2, keepdims=True)), np.log(np.array([0.95, 0.05])))


def marginals(model: PageModel, pages: list[Page]) -> list[np.ndarray]:
    """P(content) of every element of every page: one upward and one downward sweep over all pages at once."""
    sizes = [len(p.tags) for p in pages]
    first = np.concatenate(([0], np.cumsum(sizes)))
    numbers, starts = flat([f for p in pages for f in _features(p)])
    logit = np.add.reduceat(model.weights[numbers], starts) + model.bias
    own = np.stack([-np.logaddexp(0, logit), -np.logaddexp(0, -logit)], axis=1)
    parent = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + s) for p, s in zip(pages, first[:-1], strict=True)])
    tie = model.ties[np.array([_kind(t) for p in pages for t in p.tags])]
    depth = np.zeros(len(parent), np.int64)
    for i, at in enumerate(parent):
        depth[i] = depth[at] + 1 if at >= 0 else 0
    own[parent < 0] += model.prior
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
    up, sent = np.zeros_like(own), np.zeros_like(own)
    for level in levels[:0:-1]:
        sent[level] = np.logaddexp.reduce(tie[level] + (own[level] + up[level])[:, None, :], axis=2)
        np.add.at(up, parent[level], sent[level])
    down = np.zeros_like(own)
    for level in levels[1:]:
        rest = own[parent[level]] + up[parent[level]] + down[parent[level]] - sent[level]
        down[level] = np.logaddexp.reduce(tie[level] + rest[:, :, None], axis=1)
    belief = own + up + down
    content = np.exp(belief[:, 1] - np.logaddexp(belief[:, 0], belief[:, 1]))
    return np.split(content, first[1:-1])


def main_text(page: Page, content: np.ndarray) -> str:
    return "\n".join(words for at, words in page.blocks if content[at] >= 0.5)


# Labelled pages

_OUT = set("nav aside footer form".split())
_OUT_NAMES = set("ad ads advert advertisement sponsored promo comment comments reply menu sidebar cookie notice related share social newsletter".split())


def given_labels(page: Page) -> list[int] | None:
    """Labels of a page that marks one article: what is in it but for parts that say they are something else."""
    roots = [i for i, t in enumerate(page.tags) if t == "article"]
    if len(roots) != 1:
        return None
    labels: list[int] = []
    for i, tag in enumerate(page.tags):
        out = tag in _OUT or any(a.partition("=")[2] in _OUT_NAMES for a in page.attributes[i])
        labels.append(int(i == roots[0] or (i > 0 and labels[page.parents[i]] == 1 and not out)))
    return labels


def marked_labels(page: Page) -> list[int]:
    """Labels of a page whose parts carry ``data-main``; others follow their parent."""
    labels: list[int] = []
    for i, mark in enumerate(page.marks):
        labels.append(mark if mark is not None else (labels[page.parents[i]] if i else 0))
    return labels


def composed_page(rng: np.random.Generator) -> str:
    """A page of random parts with their labels."""

    def say(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(list("aeioulnrst"), int(rng.integers(2, 9)))) for _ in range(int(rng.integers(low, high)))) + "."

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{say(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def one(*options: str) -> str:
        return options[int(rng.integers(len(options)))]

    def aside() -> str:
        return one(
            f'<aside data-main="0" class="{one("sidebar", "related", "widget", "")}"><h3>{say(1, 4)}</h3>{links(3)}<p>{say(3, 20)}</p></aside>',
            f'<div data-main="0" class="{one("ad", "ads", "advert", "sponsored", "promo", "banner")}"><p>{say(3, 25)}</p></div>',
            f'<div data-main="0" class="ad">{say(3, 25)}</div>',
            f'<div data-main="0" class="{one("share", "social", "newsletter", "breadcrumb", "pagination", "tags")}">{links(3)}</div>',
            f'<form data-main="0" action="/s"><p>{say(2, 12)}</p><label>{say(1, 4)}</label><input name="q"></form>',
            f'<div data-main="0" class="{one("cookie notice", "notice", "cookie consent", "alert", "popup")}"><p>{say(4, 30)}</p></div>',
        )

    def body() -> str:
        parts = [f"<h1>{say(3, 10)}</h1>"] if rng.random() < 0.8 else []
        if rng.random() < 0.3:
            parts = [f"<header>{''.join(parts)}<p>{say(2, 8)}</p></header>"]
        for _ in range(int(rng.integers(1, 14))):
            parts.append(
                one(*[f"<p>{say(1, 90)}</p>"] * 6, f"<p>{say(5, 30)} <a href='/y'>{say(1, 4)}</a> {say(2, 20)}</p>", f"<h2>{say(2, 7)}</h2>", f"<blockquote><p>{say(5, 40)}</p></blockquote>",
                    f"<ul><li>{say(2, 20)}</li><li>{say(2, 20)}</li></ul>", f"<pre>{say(4, 20)}</pre>", f"<table><tr><td>{say(1, 6)}</td><td>{say(1, 6)}</td></tr></table>", f"<div>{say(5, 60)}</div>", f"<section><h3>{say(2, 5)}</h3><p>{say(8, 60)}</p></section>", f"<figure><img src='a'><figcaption>{say(2, 12)}</figcaption></figure>")
            )
            if rng.random() < 0.04:  # a paragraph of hundreds or thousands of words
                parts.append(f"<p>{say(20, 60) * int(rng.integers(5, 60))}</p>")
            if rng.random() < 0.12:
                parts.append(aside())
        return "".join(parts)

    top = [one(f'<nav data-main="0">{links(6)}</nav>', f'<div data-main="0" class="{one("menu", "nav", "navbar", "topbar")}">{links(5)}</div>', ""), one(f'<header data-main="0" class="{one("site header", "masthead", "")}"><p>{say(1, 6)}</p>{one("", f"<nav>{links(4)}</nav>")}</header>', "")]
    holder = one('<article data-main="1"{}>', '<main data-main="1"{}>', '<div data-main="1"{}>', '<section data-main="1"{}>')
    tag = holder[1:].split()[0]
    names = one("", ' class="article body"', ' class="post"', ' class="entry content"', ' id="content"', ' class="story text"') if tag in ("article", "main") else one(' class="article body"', ' class="post"', ' class="entry content"', ' id="content"', ' class="story text"')
    core = holder.format(names) + body() + f"</{tag}>"
    bare = rng.random() < BARE
    if bare:  # paragraphs that nothing holds but the page
        core = "".join(f'<{one("p", "p", "p", "h2", "blockquote")}>{say(5, 60)}' for _ in range(int(rng.integers(1, 8))))
    if not bare and rng.random() < 0.4:
        core = f'<div class="{one("wrapper", "container", "page", "row")}">{core}{aside() if rng.random() < 0.6 else ""}</div>'
    comments = one("", "", *[f'<{t} data-main="0" class="{c}"><h3>{say(1, 3)}</h3>' + "".join(f'<{u} class="{one("comment", "comment body", "reply")}"><p>{say(2, 40)}</p></{u}>' for _ in range(int(rng.integers(1, 5)))) + f"</{t}>" for t, c, u in (("section", "comments", "div"), ("div", "comments", "article"), ("div", "comment list", "div"))])
    end = [comments, one("", aside()), one(f'<footer data-main="0"><p>{say(3, 15)}</p>{one("", links(4))}</footer>', f'<footer data-main="0">{say(3, 25)}</footer>', f'<div data-main="0" class="footer">{say(3, 25)}</div>', "")]
    return ('<html><body data-main="1">' if bare else "<html><body>") + "".join(top) + (aside() if rng.random() < 0.4 else "") + core + "".join(end) + "</body></html>"


def fit_pages(pages: DataFrame, given: int = GIVEN_PAGES, composed: int = COMPOSED_PAGES, seed: int = 0) -> PageModel:
    """Train on about ``given`` of ``pages``, chosen by hash, that mark one article, and ``composed`` others."""
    known = pages.where("html is not null")
    total = known.count()
    rows = known.where(uniform(F.lit("page"), F.col("page_id"), F.col("url")) < given / max(total, 1)).select("html").collect()
    read = [read_page(h) for h in sorted(r["html"] for r in rows)]
    labelled = [(p, labels) for p in read if (labels := given_labels(p)) is not None]
    rng = np.random.default_rng(seed)
    labelled += [(p, marked_labels(p)) for p in (read_page(composed_page(rng)) for _ in range(composed))]
    return train_pages(labelled)


def extract_text(pages: DataFrame, model: PageModel) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty html, and a page without content, has the empty text. Elements that are not shown and lack their end
    tags end at the next part of the page; formulas stand in their line. Other broken markup is read as far as it goes.
    Null and repeated ids and urls stay, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts: list[str] = []
            html = list(rows["html"])
            for start in range(0, len(html), 64):
                read = [read_page(h if isinstance(h, str) else None) for h in html[start : start + 64]]
                texts += [main_text(p, c) for p, c in zip(read, marginals(model, read), strict=True)]
            yield rows.drop(columns="html").assign(text=texts, n_chars=[len(t) for t in texts])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op5_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit_pages(pages))
