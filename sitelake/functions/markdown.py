"""HTML tree to GitHub-flavoured markdown: ATX headings, - bullets, fences with a language, pipe tables."""

from __future__ import annotations

import json
import re
import sys

from sitelake.functions import fixed
from sitelake.functions.dom import BLOCK, Node, parse

_SKIP = {"script", "style", "noscript", "template", "head", "title", "#comment"}


def strict_json(text: str) -> bool:
    def refuse(_: str) -> None:
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse)
    except ValueError:
        return False
    return True


def infer_language(code: str) -> str:
    for language, all_of, any_of in fixed.CODE_MARKS:
        if all(any(x in code for x in xs) for xs in (*all_of, any_of)) and (language != "json" or (code.strip()[:1] in ("{", "[") and strict_json(code))):
            return language
    return fixed.CODE_DEFAULT


def _squeeze(x: str) -> str:
    return re.sub(r"[ \t\n\r\f\v]+", " ", x)


def _fence(x: str, least: int) -> str:
    return "`" * max([least, *(len(m) + 1 for m in re.findall("`+", x) if len(m) >= least)])


def inline(n: Node | str) -> str:
    if isinstance(n, str):
        return _squeeze(n)
    if n.tag in _SKIP:
        return ""
    if n.tag == "br":
        return "\\\n"
    if n.tag == "img":
        return f"![{n.attrs.get('alt', '')}]({n.attrs.get('src', '')})"
    if n.tag == "input":
        return "" if n.attrs.get("type") != "checkbox" else "[x] " if "checked" in n.attrs else "[ ] "
    if n.tag in ("code", "kbd", "samp", "tt"):
        text = _squeeze(n.text())
        ticks = _fence(text, 1)
        return f"{ticks}{text}{ticks}" if text.strip() else ""
    inner = "".join([inline(c) for c in n.children])
    mark = {"em": "*", "i": "*", "strong": "**", "b": "**", "del": "~~", "s": "~~", "strike": "~~"}.get(n.tag)
    if mark and inner.strip():
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        return f"{lead}{mark}{inner.strip()}{mark}{tail}"
    if n.tag == "a" and n.attrs.get("href"):
        return f"[{inner.strip()}]({n.attrs['href']})"
    return inner


def _tidy(x: str) -> str:
    x = re.sub(r" *\\\n *", "\\\\\n", re.sub(r" +", " ", x).strip())
    return re.sub(r"(\\\n)+$", "", x).strip()


def _rows(table: Node) -> list[Node]:
    return [r for r in table.elements() if r.tag == "tr"]


def _table(n: Node) -> str:
    rows = [[_tidy("".join([inline(x) for x in c.children])).replace("|", "\\|").replace("\\\n", " ") for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in _rows(n)]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([line(rows[0]), line(["-" * max(3, len(c)) for c in rows[0]]), *map(line, rows[1:])])


def _item(n: Node, marker: str, holding: set[int]) -> str:
    body = "\n".join(blocks(n, holding)) if not any(isinstance(c, Node) and c.tag == "p" for c in n.children) else "\n\n".join(blocks(n, holding))
    pad = " " * len(marker)
    return marker + body.replace("\n", "\n" + pad).replace("\n" + pad + "\n", "\n\n")


def with_blocks(n: Node) -> set[int]:
    """Ids of the elements below n that hold a block."""
    out: set[int] = set()
    for e in reversed(list(n.elements())):
        if (e.tag in BLOCK or id(e) in out) and e.parent is not None:
            out.add(id(e.parent))
    return out


def blocks(n: Node, holding: set[int]) -> list[str]:
    """The blocks of a node's children. holding: with_blocks of a node above."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := _tidy("".join(run)):
            out.append(text)
        run.clear()

    for c in n.children:
        if isinstance(c, str) or (c.tag not in BLOCK and id(c) not in holding):
            run.append(inline(c))
            continue
        flush()
        if c.tag in _SKIP:
            continue
        if len(c.tag) == 2 and c.tag[0] == "h" and c.tag[1] in "123456":
            if text := _tidy("".join([inline(x) for x in c.children])).replace("\\\n", " "):
                out.append("#" * int(c.tag[1]) + " " + text)
        elif c.tag == "hr":
            out.append("***")
        elif c.tag == "pre":
            code = next((e for e in c.elements() if e.tag == "code"), c)
            text = c.text().removesuffix("\n").removeprefix("\n")
            named = re.search(r"language-([A-Za-z0-9_]+)", code.attrs.get("class", ""))
            ticks = _fence(text, 3)
            out.append(f"{ticks}{named[1] if named else infer_language(text) if text else ''}\n{text}\n{ticks}")
        elif c.tag == "blockquote":
            if inner := "\n\n".join(blocks(c, holding)):
                out.append(re.sub(r"(?m)^> $", ">", re.sub(r"(?m)^", "> ", inner)))
        elif c.tag in ("ul", "ol", "menu"):
            start = c.attrs.get("start", "1")
            marker = f"{start if start.isdigit() else 1}. " if c.tag == "ol" else "- "
            items = [_item(i, marker, holding) for i in c.children if isinstance(i, Node) and i.tag == "li"]
            if items:
                out.append("\n".join(items))
        elif c.tag == "table":
            if text := _table(c):
                out.append(text)
        else:
            out += blocks(c, holding)
    flush()
    return out


#: Levels of the walk. Its calls are plain Python ones, which take no C stack.
DEEPEST = 200_000


def node_to_markdown(n: Node) -> str:
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, DEEPEST))
    try:
        text = "\n\n".join(blocks(n, with_blocks(n)))
    finally:
        sys.setrecursionlimit(before)
    return text + "\n" if text else ""


def html_to_markdown(html: str | None) -> str:
    if not html or not html.strip():
        return ""
    return node_to_markdown(parse(html))
