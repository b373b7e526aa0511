"""A page as a small tree of nodes, with selectors, text, removal and replacement; rendering is that of parsers.Markdown.

Rules are (name, attribute, how, value); how is = for equal, ~ for one of its words, ^ for a start, * for a part, ? for being there. An empty name, or attribute, is any.
All walks keep their own stack, so a page may be nested to any depth. An end tag without a start is passed over; an element left open ends with the page.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

from convolake.operators.parsers import Markdown

#: Elements without an end. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Raw(str):
    """Markdown that stands where a node was; rendering takes it as it is."""


class Node:
    __slots__ = ("tag", "at", "up", "below")

    def __init__(self, tag: str, at: dict[str, str], up: Node | None):
        self.tag, self.at, self.up, self.below = tag, at, up, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.now)
        self.now.below.append(node)
        if tag not in VOID:
            self.now = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if tag in VOID or not self.open.get(tag):
            return
        while True:
            name, self.now = self.now.tag, self.now.up
            self.open[name] -= 1
            if name == tag:
                return

    def handle_data(self, data):
        below = self.now.below
        if below and isinstance(below[-1], str):  # an end tag that was passed over parted them
            data = below.pop() + data
        below.append(data)


def parse(html: str | None) -> Node:
    page = _Builder()
    page.feed(html or "")
    page.close()
    return page.root


def walk(node: Node) -> Iterator[Node | str]:
    """All below a node, each before what it holds."""
    todo = list(reversed(node.below))
    while todo:
        x = todo.pop()
        yield x
        if isinstance(x, Node):
            todo.extend(reversed(x.below))


def nodes(node: Node) -> Iterator[Node]:
    return (x for x in walk(node) if isinstance(x, Node))


def fits(node: Node, rule: tuple[str, str, str, str]) -> bool:
    name, key, how, value = rule
    if name and name != node.tag:
        return False
    if not key:
        return node.tag != ""
    own = node.at.get(key)
    return own is not None and (how == "?" or how == "=" and own == value or how == "~" and value in own.split() or how == "^" and own.startswith(value) or how == "*" and value in own)


def any_fits(node: Node, rules: Iterable[tuple]) -> bool:
    return any(fits(node, r) for r in rules)


def select(node: Node, *rules: tuple) -> list[Node]:
    """Nodes below that fit any rule, in order."""
    return [x for x in nodes(node) if any_fits(x, rules)]


def first(node: Node, *rules: tuple) -> Node | None:
    """Of the first rule that any node below fits, its first node."""
    return next((x for r in rules for x in nodes(node) if fits(x, r)), None)


def closest(node: Node | None, *rules: tuple) -> Node | None:
    """The node itself, or the nearest around it, that fits any rule."""
    while node is not None and not any_fits(node, rules):
        node = node.up
    return node


def within(node: Node, *rules: tuple) -> bool:
    """Whether a node around this one fits."""
    return closest(node.up, *rules) is not None


def text(node: Node | None) -> str:
    """The words of a node, with one space between them."""
    return " ".join(w for x in walk(node) if isinstance(x, str) for w in x.split()) if node else ""


def plain(node: Node) -> str:
    """The text of a node as it stands."""
    return "".join(x for x in walk(node) if isinstance(x, str))


def place(node: Node) -> int:
    return next(k for k, x in enumerate(node.up.below) if x is node)


def replace(node: Node, by: str | None) -> None:
    """Puts Markdown, or nothing, where a node is; a node that is out of the tree already stays so."""
    if node.up is not None:
        k = place(node)
        node.up.below[k : k + 1] = [] if by is None else [Raw(by)]
        node.up = None


def remove(*gone: Node) -> None:
    for node in gone:
        replace(node, None)


def next_node(node: Node) -> Node | None:
    """The next node beside this one."""
    return next((x for x in node.up.below[place(node) + 1 :] if isinstance(x, Node)), None)


def markdown(node: Node | None) -> str:
    """A node's content as Markdown."""
    out = Markdown()
    todo: list = list(reversed(node.below)) if node else []
    while todo:
        x = todo.pop()
        if isinstance(x, Raw):
            out.raw(x)
        elif isinstance(x, str):
            out.handle_data(x)
        elif isinstance(x, Node):
            out.handle_starttag(x.tag, list(x.at.items()))
            if x.tag not in VOID:
                todo.append(_End(x.tag))
                todo.extend(reversed(x.below))
        else:
            out.handle_endtag(x.tag)
    return out.said()


class _End:
    __slots__ = ("tag",)

    def __init__(self, tag: str):
        self.tag = tag
