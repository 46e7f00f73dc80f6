"""Units of HTML, CSS, YAML and JSON: elements, rules, keys, each with what is nested in it.

HTML is read by a stack of open tags with offsets, CSS by its braces, JSON by its tokens, YAML by its indentation.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

from . import lexer

LANGUAGES = ("html", "css", "yaml", "json")


class Unit(NamedTuple):
    """Lines first to last, from 1, both included; parent is the symbol of the unit that was too large to stand whole."""

    kind: str
    symbol: str
    parent: str
    first: int
    last: int


class Node:
    """A piece of markup from character start to end, with those inside it in order."""

    def __init__(self, kind: str, symbol: str, start: int, end: int = -1):
        self.kind, self.symbol, self.start, self.end, self.children = kind, symbol, start, end, []


# ---- HTML

# Elements of HTML without content, those that end where the next of their kind starts, and what bounds that.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
ENDS_AT_NEXT = ("p", "li", "dt", "dd", "tr", "td", "th", "option")
BOUNDS = ("html", "head", "body", "main", "article", "section", "nav", "aside", "header", "footer", "div", "form", "blockquote", "ul", "ol", "dl", "table", "tr", "td", "th", "select")
TAG = (
    r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"""|</?[a-z][a-z0-9:-]*(?:"[^"]*"|'[^']*'|[^'"<>])*>"""
)
_TAG = re.compile(TAG.replace(r"\z", r"\Z"))
_TAG_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")


class Element(NamedTuple):
    """An element, tags included: characters start to end, from 0, end excluded; depth is how many are open around it."""

    tag: str
    depth: int
    start: int
    end: int


def elements(html: str) -> list[Element]:
    """The elements of a page in order of their start.

    A closing tag ends what is open inside its element, and is passed over if its element is not open. Elements of
    ENDS_AT_NEXT end where the next of their kind starts, if no other of BOUNDS is open between them. What is open at
    the end of the page ends there. Scripts and styles are elements without others in them; comments are none.
    """
    found: list[list] = []
    open_: list[int] = []
    held: dict[str, int] = {}

    def shut(count: int, end: int) -> None:
        for _ in range(count):
            at = open_.pop()
            found[at][3] = end
            held[found[at][0]] -= 1

    for m in _TAG.finditer(html):
        said = m.group()
        if said.startswith("<!--"):
            continue
        tag = _TAG_NAME.match(said)[1].lower()
        if said.startswith("</"):
            if held.get(tag):
                above = next(n for n, at in enumerate(reversed(open_)) if found[at][0] == tag)
                shut(above, m.start())
                shut(1, m.end())
            continue
        if tag in ENDS_AT_NEXT and held.get(tag):
            for n, at in enumerate(reversed(open_), start=1):
                if found[at][0] == tag:
                    shut(n, m.start())
                    break
                if found[at][0] in BOUNDS:
                    break
        found.append([tag, len(open_), m.start(), m.end()])
        if tag not in VOID and tag not in ("script", "style") and not said.endswith("/>"):
            open_.append(len(found) - 1)
            held[tag] = held.get(tag, 0) + 1
    shut(len(open_), len(html))
    return [Element(*x) for x in found]


def _html(text: str) -> list[Node]:
    roots: list[Node] = []
    path: list[Node] = []
    for e in elements(text):
        if e.tag in ("script", "style"):  # of another kind than elements
            continue
        del path[e.depth :]
        node = Node("element", e.tag, e.start, e.end)
        (path[-1].children if path else roots).append(node)
        path.append(node)
    return roots


# ---- CSS


def _css(text: str) -> list[Node]:
    code = lexer.code("css", text)
    close = lexer.pairs(code)

    def rules(lo: int, hi: int, levels: int = 50) -> list[Node]:
        out, start, at = [], lo, lo
        while m := re.compile(r"[{;}]").search(code, at, hi):
            at = m.end()
            if m.group() == "{":
                said = " ".join(text[start : m.start()].split()) if code[start : m.start()].strip() else ""
                said = re.sub(r"/\*.*?\*/ ?", "", said)
                end = close.get(m.start(), hi - 1) + 1
                inner = rules(m.end(), end - 1, levels - 1) if levels else []
                if not said.startswith("@") or said.startswith("@media"):
                    first = start + len(code[start : m.start()]) - len(code[start : m.start()].lstrip())
                    out.append(Node("media_statement" if said.startswith("@") else "rule_set", said[:60], first, end))
                    out[-1].children = inner
                else:
                    out += inner
                at = end
            start = at
        return out

    return rules(0, len(code))


# ---- JSON

_JSON = re.compile(r'"(?:\\.|[^"\\])*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)


def _json(text: str) -> list[Node]:
    roots: list[Node] = []
    inside: list[list] = []  # open braces and brackets, each with the pair that it is reading
    last, key, around = None, None, []
    for m in _JSON.finditer(text):
        said = m.group()
        if said in "{[":
            inside.append([said, None])
        elif said == ":" and inside and inside[-1][0] == "{" and inside[-1][1] is None and key is not None:
            node = Node("pair", key.group()[1:-1], key.start())
            (around[-1].children if around else roots).append(node)
            around.append(node)
            inside[-1][1] = node
        elif said in ",}]" and inside:
            if inside[-1][1] is not None:
                inside[-1][1].end = last.end()
                around.pop()
                inside[-1][1] = None
            if said != ",":
                inside.pop()
        key = m if said.startswith('"') else None
        last = m
    for node in around:  # the text ends early
        node.end = len(text)
    return roots


# ---- YAML

_KEY = re.compile(r"""^(?P<lead>[ ]*(?:-[ ]+)*)(?P<key>"[^"\n]*"|'[^'\n]*'|[^\s#&*!|>'"%@`{}\[\],-][^#\n]*?|-[^\s#][^#\n]*?)[ ]*:(?P<value>[ \t].*)?$""")
_BLOCK_TEXT = re.compile(r"[ \t]*(?:[&!]\S+[ \t]+)*[|>][-+0-9]*[ \t]*(?:#.*)?$")


def _yaml(lines: list[str]) -> list[Node]:
    """Nodes by line (start and end are line numbers from 1, both included)."""
    roots: list[Node] = []
    open_: list[tuple[int, Node]] = []
    document, text_in, last = None, None, 0

    def shut(level: int, at: int) -> None:
        while open_ and open_[-1][0] >= level:
            open_.pop()[1].end = at

    for n, line in enumerate(lines, start=1):
        bare = line.strip()
        indent = len(line) - len(line.lstrip(" "))
        if text_in is not None and (not bare or indent > text_in):
            last = n if bare else last
            continue
        text_in = None
        if not bare or bare.startswith("#"):
            continue
        if re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
            shut(0, last)
            if document is not None:
                document.end = last
            document, last = None, n
            continue
        if document is None:
            document = Node("document", "", n)
            roots.append(document)
        dash = bare.startswith("- ") or bare == "-"
        shut(indent + 1 if dash else indent, last)
        m = _KEY.match(line)
        if m:
            node = Node("block_mapping_pair", m["key"].strip("\"'"), n)
            (open_[-1][1] if open_ else document).children.append(node)
            open_.append((len(m["lead"]), node))
        if _BLOCK_TEXT.match((m["value"] or "") if m else bare.lstrip("- ")):
            text_in = indent
        last = n
    shut(0, last)
    if document is not None:
        document.end = last
    return roots


def nodes(language: str, text: str) -> list[Node]:
    """The outermost nodes, with line numbers from 1 as their start and end."""
    lines = text.split("\n")
    if language == "yaml":
        return _yaml(lines)
    roots = {"html": _html, "css": _css, "json": _json}[language](text)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    todo = list(roots)
    while todo:
        node = todo.pop()
        node.start, node.end = bisect_right(starts, node.start), bisect_right(starts, max(node.start, node.end - 1))
        todo += node.children
    return roots
