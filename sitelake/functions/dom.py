"""A small HTML tree on the standard library's tokenizer, and what extraction asks of it.

A documented subset of HTML tree building: void elements, raw text (script, style), end tags that a
start tag implies (p, li, dt, dd, tr, td, th, option, table sections), inline formatting that is reopened in the next
paragraph, and end tags without a start being ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

from sitelake.functions import fixed

VOID = set(fixed.KEEP_EMPTY) | {"param"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "s", "small", "strike", "strong", "u"}
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def append(self, child: Node | str) -> None:
        if isinstance(child, Node):
            child.parent = self
        self.children.append(child)

    def elements(self) -> Iterator[Node]:
        """All below in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            if n.tag != "#comment":
                yield n
                stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag != "#comment":
                stack += reversed(c.children)
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


def drop(root: Node, gone: set[int]) -> None:
    """Takes the nodes of those ids out, in one walk."""
    if gone:
        for n in [root, *root.elements()]:
            n.children = [c for c in n.children if id(c) not in gone]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]
        self.within: Counter = Counter()  # of the open tags
        self.once: set[str] = set()

    def _push(self, node: Node) -> None:
        self.open.append(node)
        self.within[node.tag] += 1

    def _pop_to(self, k: int) -> list[Node]:
        gone = self.open[k:]
        del self.open[k:]
        self.within.subtract(n.tag for n in gone)
        return gone

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        again: list[Node] = []
        if tag in BLOCK and self.within["p"]:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == "p":
                    again = [n for n in self._pop_to(k) if n.tag in FORMATTING]
                    break
                if self.open[k].tag not in FORMATTING:
                    break
        if tag in _CLOSES:
            closes, stops = _CLOSES[tag]
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in stops:
                    break
                if self.open[k].tag in closes:
                    self._pop_to(k)
        if tag in ("html", "body", "head"):
            if tag in self.once:
                return
            self.once.add(tag)
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].append(node)
        if tag not in VOID:
            self._push(node)
            for n in again:
                copy = Node(n.tag, n.attrs)
                self.open[-1].append(copy)
                self._push(copy)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.within[tag]:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._pop_to(k)
                return
            if self.open[k].tag in ("table", "td", "th") and tag in FORMATTING | {"p", "li"}:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].append(data)

    def handle_comment(self, data: str) -> None:
        node = Node("#comment")
        node.append(data)
        self.open[-1].append(node)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def fits(n: Node, kind: str, value: str) -> bool:
    if kind == "tag":
        return n.tag == value
    if kind == "class":
        return value in n.classes()
    if kind == "class*":
        return value in n.attrs.get("class", "")
    if kind == "id*":
        return value in n.attrs.get("id", "")
    return n.attrs.get(kind) == value


def first(root: Node, kind: str, value: str) -> Node | None:
    return next((n for n in root.elements() if fits(n, kind, value)), None)


def is_clutter(n: Node) -> bool:
    a, classes = n.attrs, n.classes()
    return (
        n.tag in fixed.REMOVE_TAGS
        or a.get("role") in fixed.REMOVE_ROLES
        or any(c in fixed.REMOVE_CLASSES for c in classes)
        or any(p in a.get("class", "") for p in fixed.REMOVE_CLASS_PARTS)
        or a.get("id") in fixed.REMOVE_IDS
        or any(p in a.get("id", "") for p in fixed.REMOVE_ID_PARTS)
        or a.get("aria-hidden") == "true"
        or "hidden" in a
        or (n.tag == "form" and a.get("role") != "search")
    )


def clean(root: Node) -> None:
    """Clutter goes, then elements without children and text (looked at before any of them goes), then attributes."""
    drop(root, {id(n) for n in root.elements() if is_clutter(n)})
    empty = lambda n: not any(isinstance(c, Node) and c.tag != "#comment" for c in n.children) and not n.text().strip()
    drop(root, {id(n) for n in root.elements() if n.tag not in fixed.KEEP_EMPTY and empty(n)})
    for n in root.elements():
        n.attrs = {k: v for k, v in n.attrs.items() if not (k.startswith("data-") and k not in fixed.KEEP_DATA) and not k.startswith("on") and k != "style"}


def preserve_code(root: Node) -> None:
    """Code is made plain before anything is removed: inline code merged, pre blocks one code element each."""
    drop(root, {id(n) for n in root.elements() if n.tag == "code" and n.attrs.get("data-md") == "skip"})
    gone: set[int] = set()
    for n in [root, *root.elements()]:
        if n.tag == "pre" or id(n) in gone:
            continue
        into = None  # the code element that those right after it are merged into
        for c in n.children:
            if isinstance(c, Node) and c.tag != "#comment":
                if c.tag != "code":
                    into = None
                elif into is None:
                    into = c
                else:
                    into.append(c.text())
                    gone.add(id(c))
    drop(root, gone)
    for n in list(root.elements()):
        if n.tag != "pre":
            continue
        lines = [x.text() for x in n.elements() if "line" in x.attrs.get("class", "")]
        code = first(n, "tag", "code")
        named = re.search(r"language-([A-Za-z0-9_]+)", code.attrs.get("class", "")) if code is not None else None
        lang = n.attrs.get("data-lang") or n.attrs.get("data-language") or n.attrs.get("data-md-lang") or (named and named[1]) or (code.attrs.get("data-lang") if code is not None else "") or ""
        made = Node("code", {"class": f"language-{lang}"} if lang else {})
        made.append("\n".join(lines) if lines else n.text())
        n.children = []
        n.append(made)
        n.attrs.pop("data-highlighted", None)


class Layout:
    """Elements in document order with the range of those below each, and the text with each one's range."""

    def __init__(self, root: Node) -> None:
        self.nodes: list[Node] = []
        begin, below, parts, at = [], {}, [], 0
        stack: list[Node | str | tuple[int, int]] = list(reversed(root.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                parts.append(c)
                at += len(c)
            elif isinstance(c, tuple):
                below[c[0]] = (len(self.nodes), at)
            elif c.tag != "#comment":
                begin.append(at)
                stack.append((len(self.nodes), 0))
                self.nodes.append(c)
                stack += reversed(c.children)
        self.text = "".join(parts)
        self.start = begin
        self.after = [below[k][0] for k in range(len(begin))]
        self.stop = [below[k][1] for k in range(len(begin))]


def main_content(root: Node) -> Node | None:
    for kind, value in fixed.MAIN_CONTENT:
        n = first(root, kind, value)
        if n is not None and len(n.text().strip()) > 200:
            return n
    return None


def densest(root: Node) -> Node | None:
    """The container whose own paragraphs hold most text outside links; None if its text is no longer than 100."""
    score: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    at_ = Layout(root)
    linked = [0]
    for k, n in enumerate(at_.nodes):
        linked.append(linked[-1] + (at_.stop[k] - at_.start[k] if n.tag == "a" else 0))
    for k, n in enumerate(at_.nodes):
        if n.tag in ("p", "pre", "blockquote", "td", "li", "h2", "h3") or (n.tag == "div" and not any(isinstance(c, Node) and c.tag in BLOCK for c in n.children)):
            gain, at = len(at_.text[at_.start[k] : at_.stop[k]].strip()) - 2.0 * (linked[at_.after[k]] - linked[k + 1]), n.parent
            for share in (1.0, 0.5):
                if at is None or at.tag == "#document":
                    break
                score[id(at)] = score.get(id(at), 0.0) + share * gain
                nodes[id(at)] = at
                at = at.parent
    if not score:
        return None
    best = nodes[max(score, key=lambda k: score[k])]
    return best if len(best.text()) > 100 else None


def references(root: Node) -> Node | None:
    for kind, value in fixed.REFERENCES:
        n = first(root, kind, value)
        if n is not None and len(n.text().strip()) > 50:
            return n
    return None
