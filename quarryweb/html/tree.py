"""An error-tolerant HTML parser: a tokenizer that jumps from tag to tag and a tree builder with implied tags.

It follows the HTML standard in what decides text and structure: raw-text
elements, comments, character references, duplicate attributes, void elements,
implied html, head and body, and implied end tags. It does not rebuild
misnested formatting elements or move stray table content, which do not change
the order of texts. All walks are iterative, so nesting may be of any depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
#: Text with character references but without tags.
ESCAPABLE = frozenset(("title", "textarea"))
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
ENDS_P = HEADINGS | frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr main menu nav ol p pre search section summary table ul dd dt li listing plaintext xmp".split())
SPECIAL = ENDS_P | HEAD | frozenset("applet area body br button caption col colgroup embed frame frameset head html iframe img input keygen marquee object param select source tbody td textarea tfoot th thead tr track wbr".split())
#: What an implied end tag does not look past.
SCOPE = frozenset("applet caption html table td th marquee object template body".split())

_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\t\n\f\r />]*)|([!?/]))")
_ATTRIBUTE = re.compile(r"""[\t\n\f\r /]*(?:(>)|([^\t\n\f\r />][^\t\n\f\r />=]*)(?:[\t\n\f\r ]*=[\t\n\f\r ]*(?:"([^"]*)"|'([^']*)'|([^\t\n\f\r >]*)))?)""")
_COMMENT_END = re.compile(r"--!?>|\Z")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*(?:;|(?![a-zA-Z0-9=])))")
_CLOSERS: dict[str, re.Pattern] = {}


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """Itself and all elements below, in document order."""
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if type(c) is not str]

    def texts(self) -> Iterator[str]:
        """All text nodes below, in document order."""
        stack: list[Element | str] = [self]
        while stack:
            e = stack.pop()
            if type(e) is str:
                yield e
            else:
                stack += reversed(e.children)

    def text(self) -> str:
        return "".join(self.texts())

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from `at` on (the first of equal names counts) and the place after the tag, or past the end if it is not closed."""
    out: dict[str, str] = {}
    match = _ATTRIBUTE.match
    while m := match(html, at):
        at = m.end()
        if m[1]:
            return out, at
        name = m[2].lower()
        if name not in out:
            value = m[3] or m[4] or m[5] or ""
            out[name] = _REFERENCE.sub(lambda r: unescape(r[0]), value) if "&" in value else value
    return out, len(html) + 1


class _Builder:
    def __init__(self):
        self.root = Element("html")
        self.head: Element | None = None
        self.body: Element | None = None
        self.open = [self.root]

    def add(self, tag: str, attrs: dict[str, str] | None = None, stay: bool = True) -> Element:
        e = Element(tag, attrs, self.open[-1])
        self.open[-1].children.append(e)
        if stay:
            self.open.append(e)
        return e

    def close(self, tags: frozenset[str] | tuple[str, ...], stop: frozenset[str]) -> bool:
        """Pops up to and with the nearest open element of tags, unless one of stop is nearer."""
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in tags:
                del self.open[i:]
                return True
            if tag in stop:
                return False
        return False

    def in_head(self) -> bool:
        return self.body is None

    def to_head(self) -> None:
        if self.head is None:
            self.open = [self.root]
            self.head = self.add("head")

    def to_body(self, attrs: dict[str, str] | None = None) -> None:
        if self.body is None:
            self.to_head()
            self.open = [self.root]
            self.body = self.add("body", attrs)

    def text(self, data: str) -> None:
        if self.body is None and self.open[-1].tag in ("html", "head"):
            if not data.strip("\t\n\f\r "):
                return
            self.to_body()
        children = self.open[-1].children
        if children and type(children[-1]) is str:
            children[-1] += data
        else:
            children.append(data)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None:
                self.to_head()
                self.head.attrs.update(attrs)
            return
        if tag == "body":
            if self.body is None:
                self.to_body(attrs)
            else:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
            return
        if self.body is None:
            if tag in HEAD:
                if self.head is None:
                    self.to_head()
                elif self.open[-1] is self.root:
                    self.open.append(self.head)
            else:
                self.to_body()
        elif tag in ENDS_P:
            self.close(("p",), SCOPE | {"button"})
            if tag == "li":
                self.close(("li",), (SPECIAL - {"address", "div", "p"}) - {"li"})
            elif tag in ("dd", "dt"):
                self.close(("dd", "dt"), (SPECIAL - {"address", "div", "p"}) - {"dd", "dt"})
            elif tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.open.pop()
        elif tag in ("option", "optgroup"):
            if self.open[-1].tag == "option":
                self.open.pop()
            if tag == "optgroup" and self.open[-1].tag == "optgroup":
                self.open.pop()
        elif tag == "tr":
            self.close(("tr",), frozenset(("table", "html", "template")))
        elif tag in ("td", "th"):
            self.close(("td", "th"), frozenset(("tr", "table", "html", "template")))
        elif tag in ("tbody", "thead", "tfoot", "caption", "colgroup"):
            self.close(("tbody", "thead", "tfoot", "caption", "colgroup"), frozenset(("table", "html", "template")))
        elif tag == "a":
            self.close(("a",), SPECIAL)
        elif tag in ("button", "nobr"):
            self.close((tag,), SCOPE)
        self.add("img" if tag == "image" else tag, attrs, tag not in VOID)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            if self.body is None:
                self.to_body()
            return  # what follows still belongs to the body
        if tag == "head":
            if self.body is None and self.head is not None:
                self.open = [self.root]
            return
        if tag == "br":
            self.start("br", {})
        elif tag == "p":
            if not self.close(("p",), SCOPE | {"button"}) and self.body is not None:
                self.add("p", None, False)
        elif tag in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif tag == "li":
            self.close(("li",), SCOPE | {"ol", "ul"})
        elif tag in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            self.close((tag,), frozenset(("html",)) if tag == "table" else frozenset(("html", "table")))
        elif tag in SPECIAL:
            self.close((tag,), SCOPE)
        else:
            self.close((tag,), SPECIAL)


def parse(html: str) -> Element:
    """The html element of a document; its children are head and body."""
    b = _Builder()
    at, size, tag_at = 0, len(html), _TAG.search
    while at < size:
        m = tag_at(html, at)
        if m is None:
            break
        begin = m.start()
        if begin > at:
            data = html[at:begin]
            b.text(unescape(data) if "&" in data else data)
        comment, slash, name, odd = m.groups()
        at = m.end()
        if comment:
            if html.startswith(">", at):
                at += 1
            elif html.startswith("->", at):
                at += 2
            else:
                at = _COMMENT_END.search(html, at).end()
            continue
        if odd:
            if odd == "/" and html.startswith(">", at):
                at += 1
                continue
            end = html.find(">", at)
            if odd == "/" and at >= size:
                b.text("</")
            at = size if end < 0 else end + 1
            continue
        tag = name.lower()
        if html.startswith(">", at):
            attrs, at = {}, at + 1
        else:
            attrs, at = _attributes(html, at)
            if at > size:
                break  # a tag that the document's end cuts off
        if slash:
            b.end(tag)
            continue
        b.start(tag, attrs)
        if tag in RAW or tag in ESCAPABLE:
            closer = _CLOSERS.get(tag)
            if closer is None:
                closer = _CLOSERS[tag] = re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I)
            end = closer.search(html, at)
            data = html[at : end.start() if end else size]
            if tag == "textarea" and data.startswith("\n"):
                data = data[1:]
            if data:
                b.open[-1].children.append(unescape(data) if tag in ESCAPABLE and "&" in data else data)
            b.open.pop()
            at = _attributes(html, end.end())[1] if end else size
        elif tag == "plaintext":
            b.open[-1].children.append(html[at:])
            at = size
    else:
        at = size
    if at < size:
        m = tag_at(html, at)
        if m is None:
            data = html[at:]
            b.text(unescape(data) if "&" in data else data)
    b.to_body()
    return b.root
