"""A small HTML tree for the extraction tasks: parse, search, read text.

Only structure is handled here.  Everything that can be said about the found
strings (numbers, addresses, links) is left to Spark expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without content, and elements that a sibling closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSED_BY_SIBLING = {"li", "p", "option", "tr", "td", "th", "dt", "dd"}
NOT_TEXT = {"script", "style", "template"}


class Node:
    """An element.  It doesn't know its parent, so a tree is freed at once and not by a later search for cycles."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def strings(self) -> Iterator[str]:
        if self.tag in NOT_TEXT:
            return
        for child in self.children:
            if isinstance(child, Node):
                yield from child.strings()
            else:
                yield child

    def text(self) -> str:
        """All text pieces, each trimmed, joined without a separator."""
        return "".join(s.strip() for s in self.strings())

    def only_string(self) -> str | None:
        if len(self.children) != 1:
            return None
        child = self.children[0]
        return child if isinstance(child, str) else child.only_string()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.path = [self.root]  # open elements, outermost first

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY_SIBLING and self.path[-1].tag == tag:
            self.path.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.path[-1].children.append(node)
        if tag not in VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.path[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.path) - 1, 0, -1) if self.path[i].tag == tag), None)
        if at is not None:
            del self.path[at:]

    def handle_data(self, data):
        self.path[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def select(node: Node, tags: str, attr: str | None = None, pattern: str | None = None) -> Iterator[Node]:
    """Descendants with one of the ``tags`` whose attribute matches; no pattern: it exists."""
    wanted = tags.split("|")
    test = re.compile(pattern) if pattern is not None else None
    for found in node.walk():
        if found.tag not in wanted:
            continue
        if attr is not None:
            value = found.attrs.get(attr)
            if value is None or (test is not None and not test.search(value)):
                continue
        yield found


def first(node: Node, *rules: tuple) -> Node | None:
    """First node of the first rule that finds one."""
    for rule in rules:
        found = next(select(node, *rule), None)
        if found is not None:
            return found
    return None


def read(node: Node | None, what: str = "text") -> str | None:
    """Text or attribute of a node; an empty attribute is NULL."""
    if node is None:
        return None
    return node.text() if what == "text" else (node.attrs.get(what) or None)


def find_string(node: Node, pattern: str) -> str | None:
    test = re.compile(pattern)
    return next((s for s in node.strings() if test.search(s)), None)
