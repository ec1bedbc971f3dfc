"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every block-level element is a node that is content (or holds some) or not.
Unary potentials come from the element's tag, names, text and links; pair
potentials tie each node to its parent. One message pass up and one down the
tree (sum-product) give exact marginals. The weights are trained by the exact
gradient of the likelihood of labelled pages, which are made here from
templates in which the part of every block is known.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryweb.html import Element, parse
from quarryweb.llm.common import bounded_batches, table

#: Labelled pages that the model is trained on, and passes over them.
TRAINING_PAGES, ROUNDS = 500, 250
#: Elements that are part of the block around them.
_FORMULA = "maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml"
_DRAWING = "svg g text tspan textpath desc defs symbol switch circle ellipse line path polygon polyline rect use"
INLINE = frozenset(f"{_FORMULA} {_DRAWING} a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements without text of the page.
SILENT = frozenset("script style noscript template head title meta link iframe object embed canvas audio video source track select option textarea noembed noframes datalist input".split())
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

_TAGS = ("p", "li", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "button", "fieldset", "dl", "dt", "dd", "body", "html", "heading", "dialog", "address", "other")
_TAG = {t: i for i, t in enumerate(_TAGS)} | dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), _TAGS.index("heading"))
#: Words in class and id names, by what they speak for.
_NAMED = {
    word: k
    for k, words in enumerate(
        (
            "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc",
            "footer header masthead banner copyright topbar",
            "sidebar aside rail widget related recommended popular trending",
            "ad ads advert advertisement sponsor sponsored promo promotion",
            "cookie cookies consent gdpr notice alert popup modal overlay",
            "comment comments reply replies respond disqus discussion",
            "share sharing social follow newsletter subscribe signup login search form tags meta byline",
            "article content post entry story main body text prose page",
        )
    )
    for word in words.split()
}
_ROLES = {"navigation": 0, "banner": 1, "contentinfo": 1, "complementary": 2, "search": 6, "alert": 4, "dialog": 4, "alertdialog": 4, "main": 7, "article": 7}
N_FEATURES = len(_TAGS) + 8 + 12


class Block:
    """A node of the model: own text runs, the place of its parent, and counts for features."""

    __slots__ = ("chars", "element", "features", "linked", "parent", "runs")

    def __init__(self, element: Element, parent: int):
        self.element, self.parent = element, parent
        self.runs: list[int] = []
        self.chars = self.linked = 0


def blocks(root: Element) -> tuple[list[Block], list[tuple[int, str]]]:
    """Nodes in document order, and text runs as (node, text) in page order; a run ends where a block begins or ends."""
    nodes, runs, parts = [Block(root, -1)], [], []
    stack: list[tuple[object, int, bool]] = [(c, 0, False) for c in reversed(root.children)]
    owner = 0

    def end(at: int) -> None:
        nonlocal parts
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                runs.append((at, text))
                nodes[at].chars += len(text)
            parts = []

    while stack:
        e, at, linked = stack.pop()
        if at != owner:
            end(owner)
            owner = at
        if type(e) is str:
            parts.append(e)
            if linked:
                nodes[at].linked += len(e)
            continue
        if e is None:  # a block has ended
            end(owner)
            continue
        tag = e.tag
        if tag in SILENT:
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                if tag == "br":
                    parts.append(" ")
                continue
            linked = linked or tag == "a"
            stack += [(c, at, linked) for c in reversed(e.children)]
            continue
        end(owner)
        nodes.append(Block(e, at))
        at = owner = len(nodes) - 1
        stack.append((None, at, False))
        stack += [(c, at, linked) for c in reversed(e.children)]
    end(owner)
    return nodes, runs


def features(nodes: list[Block], runs: list[tuple[int, str]]) -> np.ndarray:
    n = len(nodes)
    out = np.zeros((n, N_FEATURES))
    own = [""] * n
    for at, text in runs:
        own[at] = own[at] or text
    chars, linked, depth = [b.chars for b in nodes], [b.linked for b in nodes], [0] * n
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        linked[p] += linked[i]
    total = max(1, chars[0])
    named = len(_TAGS)
    for i, b in enumerate(nodes):
        e, row = b.element, out[i]
        if i:
            depth[i] = depth[b.parent] + 1
        row[_TAG.get(e.tag, len(_TAGS) - 1)] = 1.0
        if e.attrs:
            names = f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}"
            if len(names) > 1:
                for word in _NAME.findall(names):
                    k = _NAMED.get(word.lower())
                    if k is not None:
                        row[named + k] = 1.0
            k = _ROLES.get(e.attrs.get("role", ""))
            if k is not None:
                row[named + k] = 1.0
        text, length = own[i], b.chars
        row[named + 8 :] = (
            1.0,
            math.log1p(length) / 8,
            min(1.0, b.linked / length) if length else 0.0,
            min(1.0, linked[i] / chars[i]) if chars[i] else 0.0,
            math.log1p(chars[i]) / 10,
            chars[i] / total,
            float(text[-1:] in ".!?:;…\"”" and text != ""),
            float(0 < length < 25),
            float(length >= 80),
            float(length == 0),
            min(1.0, depth[i] / 10),
            float(chars[i] == 0),
        )
    return out


def marginals(score: list[float], parent: list[int], pair: list[list[float]]) -> tuple[list[float], np.ndarray]:
    """P(content) of each node, and the expected number of each (parent, child) pair of labels.

    Nodes come after their parents. Upward messages are products over the
    children, downward ones the parent's belief without the child's message;
    both are scaled, so pages of any size are safe.
    """
    (e00, e01), (e10, e11) = ((math.exp(x) for x in row) for row in pair)
    n = len(score)
    up0, up1 = [0.0] * n, [0.0] * n
    for i, s in enumerate(score):  # own potentials, as logs
        up1[i] = s
    m0, m1 = [0.0] * n, [0.0] * n
    log, exp = math.log, math.exp
    for i in range(n - 1, 0, -1):
        a, b = up0[i], up1[i]
        m = a if a > b else b
        a, b = exp(a - m), exp(b - m)
        x, y = log(e00 * a + e01 * b), log(e10 * a + e11 * b)
        m = x if x > y else y
        m0[i], m1[i] = x - m, y - m
        p = parent[i]
        up0[p] += m0[i]
        up1[p] += m1[i]
    belief, pairs = [0.0] * n, np.zeros((2, 2))
    d0, d1 = [0.0] * n, [0.0] * n
    c00 = c01 = c10 = c11 = 0.0
    for i in range(n):
        if i:
            p = parent[i]
            # The parent's belief without this child.
            q0, q1 = up0[p] + d0[p] - m0[i], up1[p] + d1[p] - m1[i]
            m = q0 if q0 > q1 else q1
            q0, q1 = exp(q0 - m), exp(q1 - m)
            x, y = log(q0 * e00 + q1 * e10), log(q0 * e01 + q1 * e11)
            m = x if x > y else y
            d0[i], d1[i] = x - m, y - m
            a, b = up0[i], up1[i]
            m = a if a > b else b
            a, b = exp(a - m), exp(b - m)
            w00, w01, w10, w11 = q0 * e00 * a, q0 * e01 * b, q1 * e10 * a, q1 * e11 * b
            z = w00 + w01 + w10 + w11
            c00, c01, c10, c11 = c00 + w00 / z, c01 + w01 / z, c10 + w10 / z, c11 + w11 / z
        x = up1[i] + d1[i] - up0[i] - d0[i]
        belief[i] = 1 / (1 + exp(-x)) if x > -700 else 0.0
    pairs[:] = ((c00, c01), (c10, c11))
    return belief, pairs


def forest_marginals(score: np.ndarray, parent: np.ndarray, levels: list[np.ndarray], pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same as marginals over many trees at once: levels are the places of the nodes by depth, roots first."""
    n, e = len(score), np.exp(pair)
    up, message, down, pairs = np.zeros((2, n)), np.zeros((2, n)), np.zeros((2, n)), np.zeros((2, 2))
    up[1] = score
    scaled = lambda x: np.exp(x - x.max(axis=0))
    for at in reversed(levels[1:]):
        x = np.log(e @ scaled(up[:, at]))
        message[:, at] = x - x.max(axis=0)
        for label in (0, 1):
            up[label] += np.bincount(parent[at], message[label, at], n)
    for at in levels[1:]:
        q = scaled(up[:, parent[at]] + down[:, parent[at]] - message[:, at])
        x = np.log(e.T @ q)
        down[:, at] = x - x.max(axis=0)
        w = q[:, None, :] * e[:, :, None] * scaled(up[:, at])[None, :, :]
        pairs += (w / w.sum(axis=(0, 1))).sum(axis=2)
    return 1 / (1 + np.exp(-np.clip(up[1] + down[1] - up[0] - down[0], -700, 700))), pairs


class Model:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair.tolist()

    def extract(self, html: str | None) -> str:
        """Runs of text of the nodes that are content, in page order, one line each."""
        if not html:
            return ""
        nodes, runs = blocks(parse(html))
        if not runs:
            return ""
        belief, _ = marginals((features(nodes, runs) @ self.weights).tolist(), [b.parent for b in nodes], self.pair)
        return "\n".join(text for at, text in runs if belief[at] >= 0.5)


# --- Labelled pages ---------------------------------------------------------

MARK = "data-part"


class _Writer:
    """Random pages; every element that is content has the attribute MARK."""

    def __init__(self, rnd: random.Random):
        self.r = rnd
        self.syllables = ["".join(rnd.choices("bcdfghklmnprstvz", k=1) + rnd.choices("aeiouéóü", k=1) + rnd.choices(["", "n", "r", "s"], k=1)) for _ in range(60)]

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choices(self.syllables, k=self.r.choice((1, 1, 2, 3)))) for _ in range(n))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        ends = self.r.choices([".", "!", "?", "", "***", " |"], [30, 2, 2, 3, 2, 1])[0]
        return self.words(self.r.randint(low, high)).capitalize() + ends

    def prose(self) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.choices((1, 1, 2, 3, 6, 12), (4, 2, 4, 4, 3, 2))[0]))
        if self.r.random() < 0.25:
            text = f'{text} <a href="/x">{self.words(self.r.randint(1, 4))}</a> {self.sentence()}'
        if self.r.random() < 0.2:
            text = f"<b>{self.words(3)}</b> {text}"
        return text if self.r.random() < 0.85 else self.words(self.r.randint(1, 3)) + "."

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{self.words(1)}">{self.words(self.r.randint(1, 3))}</a></{tag}>' for _ in range(self.r.randint(2, 9)))

    def name(self, *options: str) -> str:
        which = self.r.choice(options)
        extra = self.r.choice(("", f" {self.words(1)}", " col-2"))
        return f' {self.r.choice(("class", "class", "id"))}="{which}{extra}"' if self.r.random() < 0.85 else ""

    def boilerplate(self) -> list[str]:
        s, r = self, self.r
        made = {
            "nav": lambda: f"<nav{s.name('nav', 'menu', 'main-nav')}><ul>{s.links()}</ul></nav>",
            "menu": lambda: f"<div{' class=' + r.choice(('menu', 'navbar', 'breadcrumb', 'pagination'))}><ul>{s.links()}</ul></div>",
            "header": lambda: f"<header{s.name('header', 'masthead', 'top')}><div>{s.words(2)}</div>{r.choice(('', '<p>' + s.sentence() + '</p>', '<h2>' + s.words(3) + '</h2>'))}</header>",
            "ad": lambda: f'<div class="{r.choice(("ad", "ads", "advert", "sponsored", "promo", "ad-box"))}">{r.choice((s.sentence(), "<p>" + s.prose() + "</p>", s.prose()))}</div>',
            "aside": lambda: f"<aside{s.name('sidebar', 'related', 'rail')}><h3>{s.words(2)}</h3>{r.choice(('<p>' + s.prose() + '</p>', '<ul>' + s.links() + '</ul>'))}</aside>",
            "side": lambda: f'<div class="{r.choice(("sidebar", "widget", "related", "popular"))}"><h4>{s.words(2)}</h4>{r.choice(("<p>" + s.prose() + "</p>", "<ul>" + s.links() + "</ul>", s.sentence()))}</div>',
            "notice": lambda: f'<div {r.choice(("class", "id"))}="{r.choice(("cookie-notice", "cookie", "consent", "alert", "notice", "popup", "gdpr banner"))}"><p>{s.prose()}</p><button>{s.words(1)}</button></div>',
            "form": lambda: f"<form{s.name('search', 'newsletter', 'subscribe', 'login')}><label>{s.words(2)}</label><input><p>{s.sentence()}</p><select><option>{s.words(1)}<option>{s.words(1)}</select><button>{s.words(1)}</button></form>",
            "comments": lambda: f'<{(t := r.choice(("div", "section")))} {r.choice(("class", "id"))}="{r.choice(("comments", "comment-list", "discussion", "replies"))}"><h3>{s.words(2)}</h3>' + "".join(f'<div class="comment"><span>{s.words(2)}</span><p>{s.prose()}</p></div>' if r.random() < 0.6 else f"<ul><li>{s.prose()}</li></ul>" for _ in range(r.randint(1, 4))) + f"</{t}>",
            "share": lambda: f'<div class="{r.choice(("share", "social", "tags", "byline"))}">{s.links("span")}</div>',
            "footer": lambda: f"<footer{s.name('footer', 'site-footer')}>{r.choice(('&copy; ', ''))}{s.sentence()} {r.choice(('', '<p>' + s.prose() + '</p>', '<ul>' + s.links() + '</ul>', s.sentence() + ' ' + s.sentence()))}</footer>",
        }
        self.made = made
        return list(made)

    def article(self) -> str:
        r, m = self.r, f" {MARK}"
        parts = [f"<h1{m}>{self.sentence(2, 9)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choices((1, 2, 4, 8, 14), (2, 3, 4, 4, 2))[0]):
            parts.append(
                r.choices(
                    (
                        lambda: f"<p{m}>{self.prose()}</p>",
                        lambda: f"<p{m}><b>{self.sentence()}<br><p{m}>{self.prose()}",
                        lambda: f"<h{(k := r.choice((2, 3, 4)))}{m}>{self.words(r.randint(1, 6))}</h{k}>",
                        lambda: f"<ul{m}>" + "".join(f"<li{m}>{self.sentence()}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
                        lambda: f"<blockquote{m}><p{m}>{self.prose()}</p></blockquote>",
                        lambda: f"<pre{m}>{self.words(6)}\n{self.words(5)}</pre>",
                        lambda: f"<table{m}><tr{m}><td{m}>{self.words(2)}</td><td{m}>{self.words(2)}</td></tr></table>",
                        lambda: f"<figure{m}><img src=x><figcaption{m}>{self.sentence()}</figcaption></figure>",
                        lambda: f"<div{m}>{self.prose()}</div>",
                        lambda: f"<p{m}>{self.words(r.randint(1, 2))}.</p>",
                        self.made[r.choice(("ad", "share", "notice", "aside"))],
                    ),
                    (40, 8, 6, 4, 3, 2, 2, 2, 6, 4, 3),
                )[0]()
            )
        inside = "".join(parts)
        return r.choices(
            (
                f"<article{m}{self.name('article', 'post', 'entry')}>{inside}</article>",
                f"<main{m}><article{m}>{inside}</article></main>",
                f'<div{m} class="{r.choice(("content", "post", "entry-content", "article-body", "story", "main text"))}">{inside}</div>',
                f"<main{m}{self.name('main', 'page')}>{inside}</main>",
                f"<div{m}><div{m}>{inside}</div></div>",
                f"<section{m} id=content>{inside}</section>",
            ),
            (10, 3, 5, 3, 2, 2),
        )[0]

    def page(self) -> str:
        r, kinds = self.r, self.boilerplate()
        before = [self.made[k]() for k in r.sample([k for k in kinds if k not in ("footer", "comments")], r.randint(0, 4))]
        after = [self.made[k]() for k in r.sample([k for k in kinds if k not in ("header", "nav", "footer")], r.randint(0, 4))]
        if r.random() < 0.8:
            after.append(self.made["footer"]())
        inner = "".join([*before, self.article(), *after])
        if r.random() < 0.3:
            inner = f'<div {MARK} class="{r.choice(("wrapper", "container", "page"))}">{inner}</div>'
        page = f"<!DOCTYPE html><html {MARK}><head><meta charset=utf-8><title>{self.words(3)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body {MARK}>{inner}</body></html>"
        return page[: r.randint(len(page) - 60, len(page))] if r.random() < 0.1 else page


def labelled_pages(n: int, seed: int) -> list[str]:
    """Made pages; MARK tells the elements that are content or hold some."""
    return [_Writer(random.Random(f"{seed}-{i}")).page() for i in range(n)]


def train(pages: list[str], rounds: int = ROUNDS, decay: float = 1e-4) -> Model:
    """Weights that make the labels likely: gradient steps with running scales on the exact likelihood."""
    stacked, labels, parents, depths, seen = [], [], [], [], np.zeros((2, 2))
    for html in pages:
        nodes, runs = blocks(parse(html))
        at, own = sum(map(len, labels)), [MARK in b.element.attrs for b in nodes]
        depth = [0] * len(nodes)
        for i in range(1, len(nodes)):
            depth[i] = depth[nodes[i].parent] + 1
            seen[int(own[nodes[i].parent]), int(own[i])] += 1
        stacked.append(features(nodes, runs))
        labels.append(np.array(own, float))
        parents.append(np.array([max(0, b.parent) for b in nodes]) + at)
        depths.append(np.array(depth))
    x, y, parent, depth = np.vstack(stacked), np.concatenate(labels), np.concatenate(parents), np.concatenate(depths)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
    w, pair = np.zeros(N_FEATURES), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)]
    for k in range(1, rounds + 1):
        belief, pairs = forest_marginals(x @ w, parent, levels, pair)
        residual, g_pair = y - belief, seen - pairs
        for i, (g, v) in enumerate(((residual @ x / len(x) - decay * w, w), (g_pair / len(x) - decay * pair, pair))):
            m, s = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v += 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return Model(w, pair)


@lru_cache(maxsize=1)
def trained() -> Model:
    return train(labelled_pages(TRAINING_PAGES, seed=1))


def extract_main_text(df: DataFrame, html_col: str = "html", out_col: str = "text", model: Model | None = None) -> DataFrame:
    """df with the main text of every whole page in out_col.

    Null and empty pages, and pages without content, have an empty text. All
    rows and other columns stay (out_col is replaced); no shuffle. White space
    inside a block becomes one space; blocks are joined by line feeds.
    """
    bounded_batches(df.sparkSession, 500)
    model = model or trained()

    @F.arrow_udf("string")
    def text(pages: pa.Array) -> pa.Array:
        return pa.array([model.extract(x.as_py()) for x in pages], pa.string())

    return df.withColumn(out_col, text(F.col(html_col)))


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: The same for pages whose main text is one article element with headings and paragraphs.
OP7_SQL = r"""
WITH a AS (SELECT page_id, url, string_split_regex(replace(regexp_extract(coalesce(html, ''), '<article>(.*?)(?:</article>|$)', 1, 's'), '<br>', ' '), '</?(?:h1|p)>') AS parts FROM pages),
t AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM a)
SELECT page_id, url, array_to_string(lines, chr(10)) AS text, length(array_to_string(lines, chr(10)))::BIGINT AS n_chars FROM t
"""
