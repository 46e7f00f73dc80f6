"""Units of source files: literals that hold brackets, heads of many shapes, oversize units, markup."""

import textwrap

import pytest
from hypothesis import given
from hypothesis import strategies as st

from siftwell.operators import lexer, markup
from siftwell.operators.structure import PARSEABLE, units


def of(language, text, budget=10**6, parent=False):
    text = textwrap.dedent(text).lstrip("\n")
    return [(u.kind, u.symbol, *([u.parent] if parent else []), u.first, u.last) for u in units(language, text, budget)]


F = "function_declaration"
CASES = {
    "a regular expression with brackets": ("javascript", "const re = /[{(]/;\nfunction a() {\n  return 1;\n}\n", [("lexical_declaration", "re", 1, 1), (F, "a", 2, 4)]),
    "a bracket closed in a regular expression": ("javascript", "function a(s) {\n  s.replace(/\\}/g, '');\n  return s;\n}\nfunction b() {}\n", [(F, "a", 1, 4), (F, "b", 5, 5)]),
    "division": ("javascript", "function a(x) {\n  return x / 2 + (x) / { y: 1 }.y;\n}\nlet b = a / 2, c = '{';\n", [(F, "a", 1, 3), ("lexical_declaration", "b", 4, 4)]),
    "templates with code inside": ("typescript", "const t = `a ${b({c: `}${'{'}`})} {`;\nfunction n() {\n  return `}`;\n}\n", [("lexical_declaration", "t", 1, 1), (F, "n", 2, 4)]),
    "tags": ("tsx", "export function App() {\n  return <p>Don't {x} </p>;\n}\nconst B = () => <a/>;\n", [(F, "App", 1, 3), ("lexical_declaration", "B", 4, 4)]),
    "braces in type parameters": ("typescript", "class Foo<T extends {a: number}> {\n  m(): T {\n    return 1;\n  }\n}\nfunction g<T extends {b: 1}>(x: T): {a: number} | null {\n  return x;\n}\n", [("class_declaration", "Foo", 1, 5), (F, "g", 6, 8)]),
    "an abstract class and types": ("typescript", "export abstract class A {\n}\ntype U = {\n  a: 1;\n} | {\n  b: 2;\n};\nexport const enum E { X }\n", [("abstract_class_declaration", "A", 1, 2), ("type_alias_declaration", "U", 3, 7), ("enum_declaration", "E", 8, 8)]),
    "a chain on a value in braces": ("javascript", "const a = {\n  x: 1,\n}.b(function () {\n  return 2;\n});\nconst {p, q} = require('z');\n", [("lexical_declaration", "a", 1, 5), ("lexical_declaration", "", 6, 6)]),
    "a type on its own line": ("c", "static long\nfoo(int a)\n{\n  return a;\n}\n", [("function_definition", "foo", 1, 5)]),
    "preprocessor branches": ("c", "#ifdef A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n  return 1;\n}\nint g(void) {\n  return 2;\n}\n", [("function_definition", "f", 2, 7), ("function_definition", "g", 8, 10)]),
    "whole functions in branches": ("c", "#if X\nint f(int a) {\n  return '{';\n}\n#else\nint h(long a) {\n  return 2;\n}\n#endif\n", [("function_definition", "f", 2, 4), ("function_definition", "h", 6, 8)]),
    "a branch never taken": ("c", "#if 0\nint f(int a) {\n#else\nint f(long a) {\n#endif\n  return 1;\n}\n", [("function_definition", "f", 4, 7)]),
    "records of C": ("c", "typedef struct {\n  int a;\n} Point;\nstruct node {\n  int b;\n};\nstruct node *make(int a) {\n  return 0;\n}\n#define M(x) { x\nint n = 3;\nint g(int a);\n", [("struct_specifier", "Point", 1, 3), ("struct_specifier", "node", 4, 6), ("function_definition", "make", 7, 9), ("declaration", "n", 11, 11), ("declaration", "g", 12, 12)]),
    "C++": ("cpp", "class API Foo final : public Bar {\n public:\n  Foo(int a) : x(a), y{a} {\n  }\n};\nbool operator==(const A& a, const A& b) {\n  return R\"x(})x\" == a;\n}\nvoid Foo::go() const {\n}\n", [("class_specifier", "Foo", 1, 5), ("function_definition", "operator==", 6, 8), ("function_definition", "go", 9, 10)]),
    "receivers": ("kotlin", "fun <T> List<T>.second(): T {\n  return this[1]\n}\nfun String.a() = \"${b(\"}\")} {\"\nval x: Int\n  get() = 1\n", [(F, "second", 1, 3), (F, "a", 4, 4), ("property_declaration", "x", 5, 6)]),
    "Go": ("go", "func (s *Server[T]) Serve(w io.Writer) (n int, err error) {\n\tx := `}`\n\treturn '{'\n}\nfunc Map[T any](x T) struct{ a int } {\n\treturn x\n}\n", [("method_declaration", "Serve", 1, 4), (F, "Map", 5, 7)]),
    "Rust": ("rust", "pub(crate) async fn go<'a>(x: &'a str) -> char {\n    let r = r#\"}\"#; /* } /* } */ */\n    '{'\n}\nimpl<T: Into<u8>> Walk for Tree<T> {\n    fn a(&self);\n}\ntrait W {\n    fn a(&self);\n}\n", [("function_item", "go", 1, 4), ("impl_item", "Walk", 5, 7), ("trait_item", "W", 8, 10)]),
    "Swift": ("swift", "func a(_ x: Int) -> String {\n  return \"\\(b(\"}\")) {\"\n}\nvar y: Int {\n  return 1\n}\nprotocol P {\n  func z()\n}\n", [(F, "a", 1, 3), ("property_declaration", "y", 4, 6), ("protocol_declaration", "P", 7, 9)]),
    "Java": ("java", "@A\npublic record P(int x) {\n}\ninterface I {\n  int area();\n  <T extends C> T g(T t) throws E;\n}\n", [("class_declaration", "P", 1, 3), ("interface_declaration", "I", 4, 7)]),
    "Dart": ("dart", "class A {\n  var s = '${m['}']} {';\n}\nint twice(int a) =>\n    2 * a;\n", [("class_definition", "A", 1, 3), ("function_signature", "twice", 4, 5)]),
    "an open bracket hides no other": ("javascript", "function a() {\n  b(;\n}\nfunction c() {\n}\n", [(F, "a", 1, 3), (F, "c", 4, 5)]),
}


@pytest.mark.parametrize("name", CASES)
def test_units(name):
    language, text, want = CASES[name]
    assert of(language, text) == want


def test_oversize_units_are_divided_level_by_level():
    java = """
        class A {
          int x;
          int y;
          class B {
            int z;
            int w;
            void f() {
              g();
            }
            abstract int h();
          }
          void k() {
          }
        }
        """
    assert of("java", java, 20, True) == [
        ("class_declaration_header", "A", "", 1, 3), ("class_declaration_header", "B", "A", 4, 6), ("method_declaration", "f", "B", 7, 9), ("method_declaration", "h", "B", 10, 10), ("method_declaration", "k", "A", 12, 13)
    ]
    script = """
        const P = () => {
          const [a, b] = use(0);

          function inner() {
            return {
              a,
            };
          }
          return wrap({
            go: () => {
              function deep() {
                return 1;
              }
            },
          });
        };
        """
    assert of("javascript", script, 60, True) == [("lexical_declaration", "", "P", 2, 2), (F, "inner", "P", 4, 8), (F, "deep", "P", 11, 13)]
    python = "class A:\n    x = 1\n    y = 2\n\n    class B:\n        def f(self):\n            pass\n\n        def g(self):\n            pass\n"
    assert of("python", python, 20, True) == [("class_definition_header", "A", "", 1, 4), ("function_definition", "f", "B", 6, 7), ("function_definition", "g", "B", 9, 10)]
    nested = "function f() {\n" * 8 + "if (a) {\n" * 8 + "function g() {\n}\n" + "}\n" * 16
    assert of("javascript", nested, 5)[-1][:2] == (F, "f")  # g lies more brackets deep than are looked into


HTML = "<!DOCTYPE html>\n<html>\n<head>\n<title>a</title>\n</head>\n<body>\n<div id='>'>\n<p>one\n<p>two <b>bold\n</div>\n<ul><li>x<li>y\n<br></ul>\n<script>var t = '</div>';</script>\n</body>\n</html>\n"


def test_markup():
    assert of("html", HTML) == [("element", "html", 2, 15)]
    assert of("html", HTML, 60, True) == [("element", "head", "html", 3, 5), ("element", "div", "body", 7, 10), ("element", "ul", "body", 11, 12)]
    css = "/* a { */\n.a, .b > p {\n  color: red;\n}\n@media (max-width: 9px) {\n  p {\n    margin: 0;\n  }\n  q { x: url('}'); }\n}\n@supports (x) {\n  u {\n  }\n}\n"
    assert of("css", css) == [("rule_set", ".a, .b > p", 2, 4), ("media_statement", "@media (max-width: 9px)", 5, 10), ("rule_set", "u", 12, 13)]
    assert of("css", css, 50, True)[1:3] == [("rule_set", "p", "@media (max-width: 9px)", 6, 8), ("rule_set", "q", "@media (max-width: 9px)", 9, 9)]
    json = '{\n  "a": 1,\n  "b": {\n    "c": [1, {"}": 2}],\n    "d": "x: {"\n  },\n  "e": []\n}\n'
    assert of("json", json) == [("pair", "a", 2, 2), ("pair", "b", 3, 6), ("pair", "e", 7, 7)]
    assert of("json", json, 30, True)[1:3] == [("pair", "c", "b", 4, 4), ("pair", "d", "b", 5, 5)]
    yaml = "# top\na: 1\nb:\n  c: |\n    x: y\n\n    z\n  d:\n  - e: 1\n    f: 2\n  - e: 3\n---\n'g h': [1]\n"
    assert of("yaml", yaml) == [("document", "", 2, 11), ("document", "", 13, 13)]
    assert of("yaml", yaml, 40, True) == [("block_mapping_pair", "a", "", 2, 2), ("block_mapping_pair", "c", "b", 4, 7), ("block_mapping_pair", "d", "b", 8, 11), ("document", "", "", 13, 13)]


def test_elements():
    page = "<div><p>a<p>b<br/><span>c</div></i><B>d"
    got = [(e.tag, e.depth, page[e.start : e.end]) for e in markup.elements(page)]
    assert got == [("div", 0, "<div><p>a<p>b<br/><span>c</div>"), ("p", 1, "<p>a"), ("p", 1, "<p>b<br/><span>c"), ("br", 2, "<br/>"), ("span", 2, "<span>c"), ("b", 0, "<B>d")]
    table = "<table><tr><td><table><tr><td>x</table><td>y</table>"
    assert [e.depth for e in markup.elements(table)] == [0, 1, 2, 3, 4, 5, 2]
    assert markup.elements("") == [] == markup.elements("a < b") and len(markup.elements("<b>" * 50_000)) == 50_000


@pytest.mark.parametrize("language", PARSEABLE)
@given(st.lists(st.sampled_from("{}()[]<>;:,'\"`/*\\\n#-=|@$ a1") | st.sampled_from(["class A", "fun f", "const x = ", "/*", "*/", "${", '"""', "#if 1\n", "#endif\n", "<p>", "</p>", "key: "]), max_size=60).map("".join))
def test_any_text(language, text):
    found = units(language, text, 20)
    n = len(text.replace("\r", "\n").split("\n"))
    assert all(1 <= u.first <= u.last <= n for u in found)
    assert all(a.last < b.first for a, b in zip(found, found[1:]))
    if language in lexer.STRINGS:
        assert len(lexer.code(language, text)) == len(text) and lexer.code(language, text).count("\n") == text.count("\n")


def test_time_is_in_proportion():
    import time

    texts = {
        "c": ["int a,\n" * 60_000, "static long\n" * 60_000, "#if A\n" * 5000 + "{\n#endif\n" * 5000, "struct s a,\n" * 30_000],
        "javascript": ["a(b),\n" * 60_000, "`${" * 30_000, "x = a / b / c;\n" * 30_000, "const a = {\n" * 20_000, "/" * 50_000],
        "rust": ["impl<T> A for B {\n}\n" * 20_000, "fn a<" * 20_000, "/*" * 50_000],
        "kotlin": ['"${' * 20_000, "fun a\n" * 30_000],
        "html": ["<a " * 50_000, "<p><b>" * 30_000, "</p>" * 50_000],
        "json": ['{"a":' * 30_000, '"a" : ' * 50_000],
        "yaml": ["".join(" " * (n % 40) + f"k{n}:\n" for n in range(40_000)), "- " * 20_000],
        "css": ["a {" * 20_000, "a;" * 50_000],
    }
    for language, cases in texts.items():
        for text in cases:
            start = time.monotonic()
            units(language, text, 50)
            assert time.monotonic() - start < 10, (language, text[:20])
