"""A small HTML tree on the standard library's parser, enough to find nodes by tag and class."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Start tags that end an open element of these kinds.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}, "option": {"option"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}


class Node:
    """An element with its children, which are nodes or strings."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.classes = set(attrs.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        """All elements below, in order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def all(self, tag: str | None = None, cls: str | None = None) -> list[Node]:
        """Elements below with a tag and a class."""
        return [n for n in self.walk() if (tag is None or n.tag == tag) and (cls is None or cls in n.classes)]

    def first(self, tag: str | None = None, cls: str | None = None) -> Node | None:
        """The first of all()."""
        return next((n for n in self.walk() if (tag is None or n.tag == tag) and (cls is None or cls in n.classes)), None)

    def text(self) -> str:
        """The text below with white space collapsed."""
        parts: list[str] = []

        def gather(n: Node) -> None:
            for c in n.children:
                if isinstance(c, str):
                    parts.append(c)
                elif c.tag not in ("script", "style"):
                    gather(c)

        gather(self)
        return re.sub(r"\s+", " ", " ".join(parts)).strip()

    def next_sibling(self, tag: str) -> Node | None:
        """The next element beside this one with a tag."""
        if self.parent is None:
            return None
        beside = self.parent.children
        return next((n for n in beside[beside.index(self) + 1 :] if isinstance(n, Node) and n.tag == tag), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.at.tag in _ENDS.get(tag, ()) and self.at.parent is not None:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    """The root of a page; broken markup never raises."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root
