"""Units of source files: functions, types and their members, by line.

Python is read by its own parser. Languages with braces are blanked to bare code (lexer), their brackets are matched,
and declarations are found at the starts of lines; each ends where its block, its statement or its line does. A unit
over the budget gives its nearest inner units in its place, with a header of its first lines, and those that are over
it theirs, level by level. HTML, CSS, YAML and JSON are cut by markup.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

from ..config import NOT_SYMBOLS
from . import lexer, markup
from .markup import Unit

# Kinds are named as the public grammars of these languages name their nodes.
_CLASSIC = {"function": "function_declaration", "class": "class_declaration", "const": "lexical_declaration", "let": "lexical_declaration", "var": "variable_declaration"}
_TYPED = {"interface": "interface_declaration", "type": "type_alias_declaration", "enum": "enum_declaration"}
KEYWORDS = {
    "javascript": _CLASSIC,
    "typescript": _CLASSIC | _TYPED,
    "tsx": _CLASSIC | _TYPED,
    "java": {"class": "class_declaration", "record": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration"},
    "kotlin": {"fun": "function_declaration", "class": "class_declaration", "interface": "class_declaration", "object": "object_declaration", "val": "property_declaration", "var": "property_declaration", "constructor": "secondary_constructor"},
    "swift": {"func": "function_declaration", "class": "class_declaration", "struct": "class_declaration", "enum": "class_declaration", "extension": "class_declaration", "protocol": "protocol_declaration", "let": "property_declaration", "var": "property_declaration"},
    "go": {"func": "function_declaration", "type": "type_declaration"},
    "rust": {"fn": "function_item", "struct": "struct_item", "impl": "impl_item", "trait": "trait_item", "enum": "enum_item"},
    "dart": {"class": "class_definition", "enum": "enum_declaration", "extension": "extension_declaration", "mixin": "mixin_declaration"},
    "c": {"struct": "struct_specifier"},
    "cpp": {"struct": "struct_specifier", "class": "class_specifier"},
}
CALLABLE = {"java": "method_declaration", "dart": "function_signature", "c": "function_definition", "cpp": "function_definition", "javascript": "method_definition", "typescript": "method_definition", "tsx": "method_definition"}
MODIFIERS = (
    "export default declare public private protected internal fileprivate abstract final open sealed static async suspend inline override external "
    "operator data inner const readonly unsafe extern tailrec infix lateinit companion annotation value enum mutating indirect convenience base typedef"
).split()
PARSEABLE = ("python", *KEYWORDS, *markup.LANGUAGES)

_LINE_ENDS = ("javascript", "typescript", "tsx", "kotlin", "swift", "go")  # a statement may end with its line there
_STATEMENTS = ("lexical_declaration", "variable_declaration", "property_declaration", "type_alias_declaration", "declaration")  # braces do not end them
_NEEDS_BLOCK = ("struct_specifier", "class_specifier", "function_item", "constructor_declaration", "function_definition", "method_definition")
_NAMED_BEFORE_CALL = ("fun", "func", "fn", "function")
_STOP = re.compile(r"[(\[{};)\]\n]")
_CALL = re.compile(r"^[ \t]*(?P<head>[A-Za-z_$~#*][\w$<>\[\],.?&*:~# \t]*?(?:\boperator[ \t]*[^\s\w(]{1,3})?)[ \t]*\(", re.M)
_C_STATEMENT = re.compile(r"^[ \t]*(?P<words>[A-Za-z_]\w*(?:[ \t*&]+[A-Za-z_]\w*)+)[ \t]*(?=[;=,\[(])", re.M)
_TYPE_LINE = re.compile(r"[A-Za-z_][\w \t*:<>,&]*$")
_ANGLE = re.compile(r"[<>(\[{;]")
_SPACES = re.compile(r"[ \t*]*")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_NOT_CALLED = (*NOT_SYMBOLS, "throw", "await", "assert", "yield", "super", "goto", "typeof", "delete", "sizeof")
_INNER_DEPTH = 6
_LEVELS = 50


def _heads(language: str) -> re.Pattern:
    modifier = rf"(?:(?:{'|'.join(MODIFIERS)}|pub(?:\([^)\n]*\))?)[ \t]+)*"
    return re.compile(rf"^[ \t]*(?P<modifiers>{modifier})(?P<kind>{'|'.join(KEYWORDS[language])})\b", re.M)


_HEADS = {language: _heads(language) for language in KEYWORDS}


class _Scan:
    """One file as bare code, with its brackets matched."""

    def __init__(self, language: str, text: str):
        self.language = language
        self.text = lexer.code(language, text)
        self.close = lexer.pairs(self.text)
        edges = sorted([(a, 1) for a in self.close] + [(b, -1) for b in self.close.values()])
        self.edges, self.depths, depth = [a for a, _ in edges], [], 0
        for _, step in edges:
            depth += step
            self.depths.append(depth)
        self.runs = {True: (0, 0, 0), False: (0, 0, 0)}  # the last declaration without a block: start, end, depth, by block_ends

    def depth(self, at: int) -> int:
        """How many brackets are open before the character at `at`."""
        n = bisect_right(self.edges, at - 1)
        return self.depths[n - 1] if n else 0

    def _goes_on(self, at: int) -> bool:
        """Whether a statement runs over the line end at `at`."""
        before, after = self.text[max(0, at - 200) : at].rstrip()[-1:], self.text[at : at + 200].lstrip()
        if self.language == "kotlin" and re.match(r"(?:get|set)\b[ \t]*\(|by\b|where\b", after):
            return True
        return bool(before) and before in "=(,{:+-*/&|<>.?" or bool(after) and after[0] in "{.?:=&|+-*/<,)"

    def _angles(self, at: int) -> int:
        """Behind the type parameters that start at `at`, if any do; brackets inside them are skipped."""
        start, depth, at = at, 0, _SPACES.match(self.text, at).end()
        if self.text[at : at + 1] != "<":
            return start
        while m := _ANGLE.search(self.text, at):
            c, here = m.group(), m.start()
            at = here + 1
            if c in "([{":
                at = self.close.get(here, here) + 1
            elif c == ";":
                break
            elif c == "<":
                depth += 1
            elif self.text[here - 1] not in "=-":  # not an arrow
                depth -= 1
                if depth == 0:
                    return at
        return start

    def end(self, at: int, block_ends: bool = True) -> tuple[int, int]:
        """(end, start of the first block or -1) of the declaration that goes on at `at`.

        Declarations with block_ends end with their block; others are statements, in which braces are values.
        """
        start, end, depth = self.runs[block_ends]
        if start <= at < end and self.depth(at) == depth:
            return end, -1  # it ends where the one around it does
        out = self._end(at, block_ends)
        if out[1] < 0:
            self.runs[block_ends] = (at, out[0], self.depth(at))
        return out

    def _end(self, at: int, block_ends: bool) -> tuple[int, int]:
        size, block = len(self.text), -1
        while m := _STOP.search(self.text, at):
            c, here = m.group(), m.start()
            if c in "([":
                at = self.close.get(here, size) + 1
            elif c == "{":
                at = self.close.get(here, size - 1) + 1
                line_end = self.text.find("\n", at)
                following = self.text[at : size if line_end < 0 else line_end].lstrip()[:2]
                if not block_ends:
                    block = here if block < 0 else block
                elif following[:1] not in ("{", ",", "|", "&", "[", "=") and following != "->":  # else a type or an initialiser comes before the block
                    return at, here
            elif c == "\n":
                if self.language in _LINE_ENDS and not self._goes_on(here):
                    return here, block
                at = m.end()
            else:  # the statement ends, or what is around it does
                return here + (c == ";"), block
        return size, block

    def found(self, lo: int, hi: int, deepest: int | None = None) -> Iterator[tuple[str, str, int, int, int]]:
        """(kind, symbol, start, end, start of the block) of the outermost units that start within lo and hi."""
        rank = {"kind": 0, "head": 1, "words": 2}
        matches = [(m.start(), rank["kind"], m, self._head) for m in _HEADS[self.language].finditer(self.text, lo, hi)]
        if self.language in CALLABLE:
            matches += [(m.start(), rank["head"], m, self._call) for m in _CALL.finditer(self.text, lo, hi)]
        if self.language == "c":
            matches += [(m.start(), rank["words"], m, self._declared) for m in _C_STATEMENT.finditer(self.text, lo, hi)]
        done = lo
        for start, _, m, read in sorted(matches, key=lambda x: x[:2]):
            if start < done or deepest is not None and self.depth(start) > deepest:
                continue
            unit = read(m, done)
            if unit and unit[3] > start:
                done = unit[3]
                yield unit

    def _head(self, m: re.Match, floor: int):
        word, language = m["kind"], self.language
        kind, at = KEYWORDS[language][word], m.end()
        if self.text[at : at + 1] == "(" and word not in ("func", "constructor", "function"):
            return None
        if kind == "class_declaration" and language in ("typescript", "tsx") and "abstract" in m["modifiers"]:
            kind = "abstract_class_declaration"
        if word in _NAMED_BEFORE_CALL:
            kind, name, at = self._named_function(kind, at)
        else:
            at = self._angles(_SPACES.match(self.text, at).end()) if language == "rust" else at
            n = re.compile(r"[ \t\n]*([A-Za-z_$][\w$.]*)").match(self.text, at)
            name = n[1].split(".")[-1] if n else ""
            at = self._angles(n.end()) if n and kind not in _STATEMENTS else n.end() if n else at
        statement = kind in _STATEMENTS
        end, block = self.end(at, not statement)
        if kind in ("struct_specifier", "class_specifier"):
            name = self._record(m.end("kind"), block, end)
            if name is None:
                return None
        if block < 0 and kind in _NEEDS_BLOCK:
            return None
        return kind, name, m.start(), end, block

    def _named_function(self, kind: str, at: int) -> tuple[str, str, int]:
        """(kind, name, place before its parameters): receivers and type parameters come before the name or after it."""
        space = _SPACES.match(self.text, at).end()
        if self.language == "go" and self.text[space : space + 1] == "(":
            kind, space = "method_declaration", self.close.get(space, space) + 1
        at = self._angles(space) if self.text[space : space + 1] == "<" else space
        line = self.text.find("\n", at)
        stop = self.text.find("(", at, len(self.text) if line < 0 else line)
        if stop < 0:
            n = _NAME.match(self.text, at)
            return kind, n.group() if n else "", at
        said = self.text[at:stop]
        if self.language != "kotlin":  # name, then type parameters
            n = re.match(r"\s*([A-Za-z_$][\w$]*)", said)
            return kind, n[1] if n else "", self._angles(at + n.end()) if n and self.language != "go" else stop
        bare = re.sub(r"<[^()]*>|`", " ", said)  # the receiver's type may have parameters
        names = _NAME.findall(bare)
        return kind, names[-1] if names else "", stop

    def _record(self, at: int, block: int, end: int) -> str | None:
        """The name of a struct or class with a body, or that of the type that it is defined as; None if it is none."""
        if block < 0:
            return None
        between = re.sub(r"\b(?:alignas|__attribute__|__declspec)[ \t]*\([^{;]*?\)+", " ", self.text[at:block])
        if re.search(r"[()=;]", between):
            return None  # a function that returns one, or a variable
        names = [x for x in _NAME.findall(re.split(r"(?<!:):(?!:)|<", between)[0]) if x != "final"]
        if names:
            return names[-1]
        after = re.compile(r"[\s*]*([A-Za-z_]\w*)[ \t]*;").match(self.text, end)
        return after[1] if after else ""

    def _call(self, m: re.Match, floor: int):
        head, start, language = m["head"], m.start(), self.language
        words = re.findall(r"~?[#\w$]+", head)
        plain = [w for w in words if w not in MODIFIERS]
        if not plain and not re.search(r"\boperator\b", head) or any(w in _NOT_CALLED for w in words) or plain and plain[0] in KEYWORDS[language]:
            if not (language in ("c", "cpp") and plain and plain[0] in ("struct", "class") and len(plain) > 2):
                return None
        if language in ("c", "cpp") and len(words) < 2:
            start = self._type_before(m.start(), floor)
            if start is None:
                return None
        end, block = self.end(m.end() - 1)
        kind = CALLABLE[language]
        if language == "java" and len(plain) == 1:
            kind = "constructor_declaration"
        elif language == "dart" and m["head"][:1] != m.group()[:1]:  # members are indented
            kind = "method_signature"
        if block < 0:
            short = language == "dart" and "=>" in self.text[m.end() : end]
            bodiless = kind == "method_declaration" and len(plain) > 1 and self.text[end - 1 : end] == ";"
            if not short and not bodiless:
                return None
        name = "operator" + head.split("operator")[-1].strip() if re.search(r"\boperator\b[^\w]*$", head) else plain[-1]
        return kind, name, start, end, block

    def _type_before(self, at: int, floor: int) -> int | None:
        """Where the line before begins, if it is a type whose function is named on the next line."""
        line = self.text.rfind("\n", 0, max(0, at - 1)) + 1
        if at == 0 or line < floor or self.text[at : at + 1] in " \t":
            return None
        said = self.text[line : at - 1].strip()
        fine = _TYPE_LINE.match(said) and said.split()[0] not in _NOT_CALLED and not said.endswith(":")
        return line if fine else None

    def _declared(self, m: re.Match, floor: int):
        """A declaration of C: words of which the first are its type; typedefs are of another kind."""
        words = _NAME.findall(m["words"])
        if words[0] in ("typedef", "else", "return", "goto", "case", "default", "sizeof", "do", "union", "enum") or words[0] in _NOT_CALLED:
            return None
        end, block = self.end(m.end(), False)
        if self.text[end - 1 : end] != ";" or words[0] == "struct" and len(words) < 3 and block >= 0:
            return None
        return "declaration", words[-1], m.start(), end, -1


def _python(body: list[ast.stmt], depth: int = _INNER_DEPTH):
    """Nearest functions and classes: the statement and its type, not past a match."""
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            yield ("decorated_definition" if node.decorator_list else kind), node
        elif depth:
            yield from _python([x for x in ast.iter_child_nodes(node) if isinstance(x, (ast.stmt, ast.excepthandler))], depth - 1)


def divided(unit: Unit, of, inner_of: Callable, too_large: Callable[[int, int], bool], levels: int = _LEVELS) -> list[Unit]:
    """A unit, or if it is too large what is inside it, level by level, each with a header of its first lines, if they are two or more.

    inner_of(of) gives the nearest inner units, with what they in turn are looked up by; a unit on the lines of the one
    around it divides nothing by itself.
    """
    inner = inner_of(of) if levels and too_large(unit.first, unit.last) else []
    if not inner:
        return [unit]
    out = [Unit(f"{unit.kind}_header", unit.symbol, unit.parent, unit.first, inner[0][0].first - 1)] if inner[0][0].first - unit.first >= 2 else []
    for x, its in inner:
        out += divided(x._replace(parent=unit.symbol or unit.parent), its, inner_of, too_large, levels - 1)
    return [unit] if len(out) == 1 and (out[0].first, out[0].last) == (unit.first, unit.last) else out


def _python_units(text: str, too_large) -> list[Unit]:
    def inner_of(node) -> list[tuple[Unit, ast.AST]]:
        return [(Unit(k, n.name, "", min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno), n) for k, n in _python(node.body)]

    return [x for u, n in inner_of(ast.parse(text)) for x in divided(u, n, inner_of, too_large)]


def _brace_units(language: str, text: str, lines: list[str], too_large) -> list[Unit]:
    scan, starts = _Scan(language, text), [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def placed(found, floor: int) -> list[tuple[Unit, tuple[int, int]]]:
        out = []
        for kind, symbol, start, end, block in found:
            first, last = bisect_right(starts, start), bisect_right(starts, max(start, end - 1))
            while first - 1 > floor and lines[first - 2].lstrip().startswith("@"):  # annotations belong to what follows
                first -= 1
            out.append((Unit(kind, symbol, "", first, last), (block, end)))
            floor = last
        return out

    def inner_of(of: tuple[int, int]):
        block, end = of
        return placed(scan.found(block + 1, end, scan.depth(block + 1) + _INNER_DEPTH), bisect_right(starts, block)) if block >= 0 else []

    return [x for u, of in placed(scan.found(0, len(scan.text)), 0) for x in divided(u, of, inner_of, too_large)]


def _markup_units(language: str, text: str, too_large) -> list[Unit]:
    def inner_of(nodes: list[markup.Node]) -> list[tuple[Unit, list]]:
        out, floor = [], 0
        for x in nodes:
            first = max(x.start, floor + 1)  # a line is in one unit
            if first <= x.end:
                out.append((Unit(x.kind, x.symbol, "", first, x.end), x.children))
                floor = x.end
        return out

    return [x for u, of in inner_of(markup.nodes(language, text)) for x in divided(u, of, inner_of, too_large)]


def units(language: str, text: str, budget_chars: int) -> list[Unit]:
    """Units in line order, none overlapping; none if the language has no scanner or the text does not parse.

    A unit of more than budget_chars gives its nearest inner units in its place, if it has any, and so do those.
    """
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    sizes = [0]
    for line in lines:
        sizes.append(sizes[-1] + len(line) + 1)
    too_large = lambda a, b: sizes[b] - sizes[a - 1] - 1 > budget_chars
    if language == "python":
        try:
            return _python_units(text, too_large)
        except (SyntaxError, ValueError, RecursionError):
            return []
    if language in KEYWORDS:
        return _brace_units(language, text, lines, too_large)
    return _markup_units(language, text, too_large) if language in markup.LANGUAGES else []
