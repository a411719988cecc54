"""A small HTML tree on the standard library's parser, with the look-ups that article
extraction needs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}
}
_LINKS = {
    "a": "href", "link": "href", "area": "href", "img": "src", "iframe": "src", "video": "src", "source": "src",
    "script": "src", "form": "action"
}


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs or {}, parent
        self.children: list[Node | str] = []

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def walk(self, without: frozenset[str] = frozenset()) -> Iterator[Node]:
        """This node and all below it in document order."""
        yield self
        for c in self.children:
            if isinstance(c, Node) and c.tag not in without:
                yield from c.walk(without)

    def below(self, *tags: str, where: Callable[[Node], bool] | None = None, without: frozenset[str] = frozenset()) -> list[Node]:
        return [n for n in self.walk(without) if n is not self and (not tags or n.tag in tags) and (where is None or where(n))]

    def texts(self, without: frozenset[str] = frozenset()) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in without:
                yield from c.texts(without)

    def text(self, without: frozenset[str] = frozenset()) -> str:
        return "".join(self.texts(without))

    def own_texts(self) -> list[str]:
        return [c for c in self.children if isinstance(c, str)]

    def before(self) -> list[Node]:
        """Earlier siblings in document order."""
        out: list[Node] = []
        for c in self.parent.children if self.parent else []:
            if c is self:
                break
            if isinstance(c, Node):
                out.append(c)
        return out

    def release(self) -> None:
        """Take the tree apart, so that its memory goes at once and not when cycles are
        next looked for."""
        nodes = [self]
        while nodes:
            n = nodes.pop()
            nodes += [c for c in n.children if isinstance(c, Node)]
            n.parent, n.children = None, []

    def first(self, *tags: str) -> Node | None:
        return next(iter(self.below(*tags)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            self.root.attrs.update({k: v or "" for k, v in attrs})
            return
        if tag in _BLOCKS:
            self._close_within({"p"}, stop=_BLOCKS - {"p"})
        elif tag in _CLOSES:
            self._close_within(_CLOSES[tag], stop=frozenset("ul ol dl table tbody select".split()))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag != "html":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def _close_within(self, tags: set[str], stop: frozenset[str]) -> None:
        n = self.at
        while n is not self.root and n.tag not in stop:
            if n.tag in tags:
                self.at = n.parent
                return
            n = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | bytes, base: str | None = None) -> Node:
    """The tree of a page; with ``base``, links are absolute."""
    if isinstance(html, bytes):
        html = html.decode("utf-8", "replace")
    html = re.sub(r"^\s*<\?xml[^>]*\?>", "", html.lstrip("﻿"), count=1, flags=re.I)
    builder = _Builder()
    builder.feed(html)
    builder.close()
    if base:
        for n in builder.root.walk():
            name = _LINKS.get(n.tag)
            if name and n.attrs.get(name):
                n.attrs[name] = absolute(n.attrs[name].strip(), base) or ""
    return builder.root


def absolute(url: str | None, base: str | None) -> str | None:
    if not url or url.startswith("http") or not base:
        return url
    try:
        return urljoin(base, url)
    except ValueError:
        return url


def links(html: str, base: str) -> list[str]:
    """Absolute targets of all anchors, without fragments-only and non-page schemes."""
    out = []
    for a in parse(html).below("a"):
        href = a.get("href").strip()
        scheme = href.split(":", 1)[0].lower() if ":" in href else ""
        if href and not href.startswith("#") and scheme not in ("mailto", "tel", "javascript", "ftp"):
            out.append(absolute(href, base))
    return [x for x in out if x]
