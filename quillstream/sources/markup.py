"""Readers of HTML and Markdown: text -> metadata and blocks, as plain functions.

The tree has no implied end tags: an element stays open until its own end tag or an ancestor's,
so unclosed paragraphs nest and an outer one's text holds the inner one's.
"""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

from quillstream.model import make

VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
HEADS = frozenset(f"h{k}" for k in range(1, 7))
SILENT = frozenset(("script", "style", "template"))


class Node:
    __slots__ = ("tag", "attrs", "inside")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.inside = tag, attrs, []

    def walk(self):
        """Descendant elements in document order."""
        stack = [iter(self.inside)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, Node):
                    yield x
                    stack.append(iter(x.inside))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        out, stack = [], [iter(self.inside)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    out.append(x)
                elif x.tag not in SILENT:
                    stack.append(iter(x.inside))
                    break
            else:
                stack.pop()
        return "".join(out)

    def find(self, *tags: str) -> "Node | None":
        return next((x for x in self.walk() if x.tag in tags), None)

    def all(self, *tags: str) -> list["Node"]:
        return [x for x in self.walk() if x.tag in tags]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def updatepos(self, i, j):
        return j  # lines and columns aren't asked for

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.open[-1].inside.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].inside.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def title_of(root: Node, first_heading: bool) -> dict[str, str]:
    found = root.find("title")
    if found is not None and found.text().strip():
        return {"title": found.text().strip()}
    found = root.find("h1") if first_heading and found is None else None
    return {"title": found.text().strip()} if found is not None else {}


def basic_blocks(root: Node, empty_headings: bool = True) -> list[dict]:
    out = []
    for x in root.walk():
        if x.tag in HEADS:
            text = x.text().strip()
            if text or empty_headings:
                out.append(make("heading", data=text, level=int(x.tag[1])))
        elif x.tag == "p" and (text := x.text().strip()):
            out.append(make("paragraph", data=text))
    return out


def rich_blocks(root: Node) -> list[dict]:
    """Basic blocks and, in document order, tables and lists."""
    out = []
    for x in root.walk():
        if x.tag in HEADS:
            out.append(make("heading", data=x.text().strip(), level=int(x.tag[1])))
        elif x.tag == "p" and (text := x.text().strip()):
            out.append(make("paragraph", data=text))
        elif x.tag == "table":
            head = x.find("thead")
            first = head.find("tr") if head else None
            body = x.find("tbody") or x
            rows = [[c.text().strip() for c in r.all("td", "th")] for r in body.all("tr")]
            out.append(make("table", headers=[c.text().strip() for c in first.all("th", "td")] if first else None, rows=[r for r in rows if r]))
        elif x.tag in ("ul", "ol"):
            out.append(make("list", items=[i.text().strip() for i in x.all("li")], ordered=x.tag == "ol"))
    return out


def read_html(text: str, *, rich: bool = False, first_heading: bool = True, empty_headings: bool = True) -> dict:
    root = parse(text)
    return {"metadata": title_of(root, first_heading), "content": rich_blocks(root) if rich else basic_blocks(root, empty_headings)}


_INLINE = ((r"`+([^`]+?)`+", r"\1"), (r"!\[([^\]]*)\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"<(https?://[^>]+)>", r"\1"), (r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"\2"), (r"(?<![\w*])(\*|_)(?=\S)(.+?)(?<=\S)\1(?![\w*])", r"\2"), (r"\\([\\`*_{}\[\]()#+.!-])", r"\1"))


def inline(text: str) -> str:
    """Text of a run of Markdown, without its marks."""
    for pattern, to in _INLINE:
        text = re.sub(pattern, to, text, flags=re.S)
    return text


def read_markdown(text: str) -> dict:
    """Headings (ATX and underlined) and paragraphs; code, tables and tight list items have none."""
    out: list[dict] = []
    for part in re.split(r"\n[ \t]*\n+", text.replace("\r\n", "\n").replace("\r", "\n").strip("\n")):
        lines = part.split("\n")
        if all(x.startswith(("    ", "\t")) or not x.strip() for x in lines):
            continue
        held: list[str] = []

        def drop() -> None:
            if held and not re.match(r"\s{0,3}([*+-]|\d+\.)\s", held[0]) and not re.fullmatch(r"\s{0,3}([-*_]\s*){3,}", held[0]):
                out.append(make("paragraph", data=inline("\n".join(x.strip() for x in held))))
            held.clear()

        for line in lines:
            m = re.match(r"(#{1,6})[ \t]*(.*?)[ \t]*#*$", line)
            under = re.fullmatch(r"(=+|-+)[ \t]*", line) if len(held) == 1 else None
            if m and m[2]:
                drop()
                out.append(make("heading", data=inline(m[2]), level=len(m[1])))
            elif under:
                out.append(make("heading", data=inline(held[0].strip()), level=1 if line[0] == "=" else 2))
                held.clear()
            else:
                held.append(re.sub(r"^\s{0,3}>\s?", "", line))
        drop()
    return {"metadata": {}, "content": out}


def html_of(blocks: list[dict]) -> str:
    """Paragraphs and headings as markup."""
    tags = [(f"h{b['level']}" if b["type"] == "heading" else "p", b["data"] or "") for b in blocks if b["type"] in ("paragraph", "heading")]
    return "".join(f"<{t}>{escape(d)}</{t}>" for t, d in tags)
