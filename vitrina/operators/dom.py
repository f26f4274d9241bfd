"""A small tolerant document tree and selectors, for product cards.

Selectors: steps separated by spaces (each looks below the match of the one before), alternatives
separated by " | " (the first that matches anything counts). A step is tag, .class, [attr], [attr=text]
(the whole value), [attr*=text] (a part of it), or a combination; "*" is any tag; :last takes a step's
last match instead of its first.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class Page:
    """A page's elements in document order, and their places by tag and by class: what is below an element is a range."""

    __slots__ = ("by_class", "by_tag", "order")

    def __init__(self) -> None:
        self.order: list[Node] = []
        self.by_tag: dict[str, list[int]] = {}
        self.by_class: dict[str, list[int]] = {}


class Node:
    __slots__ = ("at", "attrs", "children", "classes", "end", "page", "parent", "tag")

    def __init__(self, page: Page, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.page, self.tag, self.attrs, self.parent = page, tag, attrs, parent
        self.children: list[Node | str] = []
        self.classes = attrs["class"].split() if "class" in attrs else []
        self.at = len(page.order)
        #: One behind the last element inside; set as the element closes.
        self.end = self.at + 1
        page.order.append(self)
        page.by_tag.setdefault(tag, []).append(self.at)
        for c in dict.fromkeys(self.classes):
            page.by_class.setdefault(c, []).append(self.at)

    def below(self) -> Iterator[Node]:
        """Elements inside, in document order."""
        return iter(self.page.order[self.at + 1 : self.end])

    def text(self, without: list[Node] = ()) -> str:
        """Every piece of text, stripped, put together without a separator."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node.strip())
            elif not any(node is w for w in without) and (node is self or node.tag not in SILENT):
                stack += reversed(node.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.root = self.now = Node(self.page, "", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(self.page, tag, {k: v or "" for k, v in reversed(attrs)}, self.now)
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave(self.now)

    def handle_endtag(self, tag):
        node = self.now
        while node.parent is not None:
            if node.tag == tag:
                return self._leave(node)
            node = node.parent

    def _leave(self, node: Node) -> None:
        """An element ends, and all that are open inside it."""
        end, inner = len(self.page.order), self.now
        while inner is not node.parent:
            inner.end = end
            inner = inner.parent
        self.now = node.parent

    def handle_data(self, data):
        self.now.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder._leave(builder.root)
    return builder.root


STEP = re.compile(r"([\w*-]*)((?:\.[^.\[\]:\s]+)*)((?:\[[^\]]+\])*)(:last)?$")


@lru_cache(maxsize=4096)
def _compiled(selector: str):
    out = []
    for alternative in selector.split(" | "):
        steps = []
        for part in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", alternative):
            m = STEP.match(part)
            if not m:
                raise ValueError(f"bad selector {selector!r}")
            tests = [re.match(r"([^*=]+)(?:(\*?=)(.*))?$", a).groups() for a in re.findall(r"\[([^\]]+)\]", m[3])]
            steps.append((m[1] if m[1] not in ("", "*") else None, [c for c in m[2].split(".") if c], tests, bool(m[4])))
        out.append(steps)
    return out


def _fits(node: Node, step) -> bool:
    tag, classes, tests, _ = step
    if tag and node.tag != tag:
        return False
    if any(c not in node.classes for c in classes):
        return False
    for name, how, value in tests:
        has = node.attrs.get(name)
        if has is None or how == "=" and has != value or how == "*=" and value not in has:
            return False
    return True


def _matches(node: Node, step) -> Iterator[Node]:
    """Elements below a node that fit a step, in document order; only those of its first class or its tag are looked at."""
    tag, classes, _, last = step
    page = node.page
    places = page.by_class.get(classes[0], []) if classes else page.by_tag.get(tag, []) if tag else range(len(page.order))
    places = places[bisect_right(places, node.at) : bisect_left(places, node.end)]
    for at in reversed(places) if last else places:
        if _fits(found := page.order[at], step):
            yield found


def _first(node: Node | None, steps) -> Node | None:
    for step in steps:
        node = next(_matches(node, step), None)
        if node is None:
            return None
    return node


def find_all(node: Node, selector: str) -> list[Node]:
    """All matches of the first alternative that has any."""
    for steps in _compiled(selector):
        above = _first(node, steps[:-1])
        found = list(_matches(above, steps[-1])) if above is not None else []
        if found:
            return found[:1] if steps[-1][3] else found
    return []


def find(node: Node | None, selector: str | None) -> Node | None:
    if node is None or not selector:
        return None
    return next((found for steps in _compiled(selector) if (found := _first(node, steps)) is not None), None)
