"""Source text with everything that is not code blanked, so that brackets and words mean what they say.

A pass over the text with a stack of modes: code, strings, and code inside strings where a language interpolates.
Comments (nested where the language nests them), strings of all kinds, regular expression literals and preprocessor
lines become blanks of the same length; line ends stay. Of preprocessor branches that would open or close brackets
differently, one is kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple


class String(NamedTuple):
    """A kind of string: what opens and closes it, whether it may run over lines, what opens code inside it."""

    opens: str
    closes: str
    lines: bool = False
    escapes: bool = True
    code: str = ""


_PLAIN, _SINGLE = String('"', '"'), String("'", "'")
_JS = (_PLAIN, _SINGLE, String("`", "`", True, True, "${"))
STRINGS: dict[str, tuple[String, ...]] = {
    "javascript": _JS, "typescript": _JS, "tsx": _JS,
    "java": (String('"""', '"""', True), _PLAIN),
    "kotlin": (String('"""', '"""', True, False, "${"), _PLAIN._replace(code="${")),
    "swift": (String('"""', '"""', True, True, "\\("), _PLAIN._replace(code="\\(")),
    "dart": (String('r"', '"', False, False), String("r'", "'", False, False), String('"""', '"""', True, True, "${"), String("'''", "'''", True, True, "${"), _PLAIN._replace(code="${"), _SINGLE._replace(code="${")),
    "go": (String("`", "`", True, False), _PLAIN),
    "rust": (String('"', '"', True),),
    "c": (_PLAIN,), "cpp": (_PLAIN,), "css": (_PLAIN, _SINGLE), "json": (_PLAIN,),
}
NESTED_COMMENTS = ("kotlin", "swift", "rust", "dart")
CHARACTERS = ("c", "cpp", "java", "go", "rust", "kotlin")
DIRECTIVES = ("c", "cpp", "swift")
PATTERNS = ("javascript", "typescript", "tsx")  # have regular expression literals

_CHARACTER = re.compile(r"'(?:\\[^'\n]+|[^'\\\n])'")
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_BEFORE_PATTERN = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "default")
_RAW = {"rust": re.compile(r'\bb?r(#*)"'), "cpp": re.compile(r'\b(?:u8|[uUL])?R"([^()\\\s]{0,16})\(')}
_OPEN, _CLOSE = "([{", ")]}"
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)((?:[^\n\\]|\\[^\n]|\\\n)*)", re.M)


def _tokens(language: str) -> re.Pattern:
    kinds = [r"/\*"] if language == "css" else [] if language == "json" else [r"//", r"/\*"]
    kinds += [re.escape(s.opens) for s in STRINGS[language]]
    kinds += ["'"] if language in CHARACTERS else []
    kinds += ["/"] if language in PATTERNS else []
    raw = [_RAW[language].pattern.replace("(#*)", "#*").replace(r"([^()\\\s]{0,16})", r"[^()\\\s]{0,16}")] if language in _RAW else []
    return re.compile("|".join([*raw, *kinds, r"[()\[\]{}]"]))


def _end_of(s: String) -> re.Pattern:
    parts = [re.escape(s.closes)] + ([re.escape(s.code)] if s.code else []) + ([r"\\[\s\S]"] if s.escapes else []) + ([] if s.lines else ["\n"])
    parts.sort(key=lambda p: p == r"\\[\s\S]")  # \( of an interpolation comes before an escape
    return re.compile("|".join(parts))


_TOKENS = {language: _tokens(language) for language in STRINGS}
_ENDS = {s: _end_of(s) for kinds in STRINGS.values() for s in kinds}
_NOTES = re.compile(r"/\*|\*/")


def _comment_end(text: str, at: int, nested: bool) -> int:
    if not nested:
        end = text.find("*/", at + 2)
        return len(text) if end < 0 else end + 2
    depth = 0
    for m in _NOTES.finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _pattern_end(text: str, at: int) -> int:
    """Where the regular expression literal at `at` ends; -1 if the slash divides or closes a tag."""
    before = text[max(0, at - 200) : at]
    bare = before.rstrip()
    last = bare[-1:]
    if last and (last.isalnum() or last in "_$"):
        word = re.search(r"[\w$]+$", bare).group()
        if word not in _BEFORE_PATTERN or bare[: -len(word)].endswith("."):
            return -1
    elif last in (")", "]", "<", '"', "'", "`") or last == "}" and "\n" not in before[len(bare) :]:
        return -1
    m = _PATTERN.match(text, at)
    return m.end() if m else -1


class _Blanks:
    """Spans of a text that are to be blanked, in order."""

    def __init__(self, text: str):
        self.text, self.out, self.last = text, [], 0

    def hide(self, a: int, b: int) -> None:
        self.out += [self.text[self.last : a], re.sub(r"[^\n]", " ", self.text[a:b])]
        self.last = b

    def done(self) -> str:
        return "".join([*self.out, self.text[self.last :]])


def code(language: str, text: str) -> str:
    """The text with comments, literals and preprocessor lines blanked; as long as the text, line by line."""
    tokens, nested, blanks, at = _TOKENS[language], language in NESTED_COMMENTS, _Blanks(text), 0
    kinds = {s.opens: s for s in STRINGS[language]}
    inside: list[list] = []  # strings whose interpolated code is being read, each with its open brackets

    def string(s: String, start: int, body: int) -> int:
        """Blank the string from `start` on, its text from `body` on, to its end or to code inside it; where to go on."""
        at = body
        while m := _ENDS[s].search(text, at):
            found = m.group()
            if found == s.closes:
                blanks.hide(start, m.end())
                return m.end()
            if found == "\n":  # a quote alone, as an apostrophe in text between tags
                return start + 1 if not inside or inside[-1][0] is not s else m.start()
            if found == s.code:
                blanks.hide(start, m.end())
                inside.append([s, 0])
                return m.end()
            at = m.end()
        if not s.lines:
            return start + 1
        blanks.hide(start, len(text))
        return len(text)

    while m := tokens.search(text, at):
        found, here = m.group(), m.start()
        if found in _OPEN or found in _CLOSE:
            at = m.end()
            if inside:
                inside[-1][1] += 1 if found in _OPEN else -1
                if inside[-1][1] < 0:  # the interpolated code ends, and the string goes on
                    at = string(inside.pop()[0], here, m.end())
        elif found == "//":
            end = text.find("\n", here)
            at = len(text) if end < 0 else end
            blanks.hide(here, at)
        elif found == "/*":
            at = _comment_end(text, here, nested)
            blanks.hide(here, at)
        elif found in kinds:
            at = string(kinds[found], here, m.end())
        elif found == "'":
            c = _CHARACTER.match(text, here)
            at = c.end() if c else here + 1
            if c:
                blanks.hide(here, at)
        elif found == "/":
            at = max(_pattern_end(text, here), here + 1)
            if at > here + 1:
                blanks.hide(here, at)
        else:  # a raw string
            mark = _RAW[language].match(text, here)
            closes = f'"{mark[1]}' if language == "rust" else f'){mark[1]}"'
            end = text.find(closes, m.end())
            at = len(text) if end < 0 else end + len(closes)
            blanks.hide(here, at)
    out = blanks.done()
    return _without_directives(out) if language in DIRECTIVES else out


def _without_directives(text: str) -> str:
    """Directives blanked, and all but one of the branches that do not leave brackets as they found them."""
    rows, dropped, open_ = [], [], []
    at, depth = [], [(0, 0, 0)]  # of round, square and curly brackets
    for m in re.finditer(r"[()\[\]{}]", text):
        step = 1 if m.group() in _OPEN else -1
        kind = (_OPEN if step > 0 else _CLOSE).index(m.group())
        at.append(m.start())
        depth.append(tuple(d + step * (k == kind) for k, d in enumerate(depth[-1])))
    changes = lambda a, b: depth[bisect_left(at, a)] != depth[bisect_left(at, b)]
    for m in _DIRECTIVE.finditer(text):
        rows.append((m.start(), m.end()))
        name = m[1]
        if name in ("if", "ifdef", "ifndef"):
            open_.append([m[2].strip() == "0", [[m.end(), -1]]])
        elif name in ("elif", "else", "elseif") and open_:
            open_[-1][1][-1][1] = m.start()
            open_[-1][1].append([m.end(), -1])
        elif name == "endif" and open_:
            never, branches = open_.pop()
            branches[-1][1] = m.start()
            if any(changes(a, b) for a, b in branches):
                keep = 1 if never and len(branches) > 1 else 0
                dropped += [tuple(x) for k, x in enumerate(branches) if k != keep]
    blanks = _Blanks(text)
    for a, b in sorted([*rows, *dropped], key=lambda s: (s[0], -s[1])):
        if b > blanks.last:
            blanks.hide(max(a, blanks.last), b)
    return blanks.done()


def pairs(text: str) -> dict[int, int]:
    """Places of opening brackets with those of the brackets that close them. One left open does not hide those around it."""
    close: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    held = dict.fromkeys(_OPEN, 0)
    for m in re.finditer(r"[()\[\]{}]", text):
        c = m.group()
        if c in _OPEN:
            open_.append((c, m.start()))
            held[c] += 1
            continue
        kind = _OPEN[_CLOSE.index(c)]
        while held[kind]:
            was, at = open_.pop()
            held[was] -= 1
            if was == kind:
                close[at] = m.start()
                break
    return close
