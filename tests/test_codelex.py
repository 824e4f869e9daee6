"""Literals and comments of the brace languages, and definitions around them."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmere.operators import chunking, codelex

CASES = [
    ("javascript", "a = '}' + \"{\\\"}\" // }\nb", "a =     +             \nb".replace(" ", " ")),
    ("javascript", "x = `a ${ f({b: `}`}) } {` + y", "x = " + " " * 22 + " + y"),
    ("javascript", "return /[}/]\\}{/g; a / b / c", "return " + " " * 10 + "; a / b / c"),
    ("javascript", "f(/* { */ 1)", "f(" + " " * 7 + " 1)"),
    ("rust", "fn f<'a>(c: &'a str) { '}' }", "fn f<'a>(c: &'a str) {     }"),
    ("rust", "r#\"} \" }\"# /* a /* } */ } */ x", " " * 29 + "x"),
    ("rust", 'let s = "a\n}";', "let s =   \n  ;"),
    ("go", "s := `}\\` + \"}\" + '}'", "s :=      +     +    "),
    ("java", 'a = """\n } " \\""" }\n """; b', "a =    \n          \n    ; b"),
    ("java", "char c = '\\''; /* unclosed }", "char c =     ; " + " " * 13),
]


@pytest.mark.parametrize("language, text, want", CASES)
def test_code_only(language, text, want):
    got = codelex.code_only(text, language)
    assert [line.split() for line in got.split("\n")] == [line.split() for line in want.split("\n")]
    assert len(got) == len(text) and "}" not in got.replace("{     }", "").replace("{b", "")


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab{}()\"'`/*\\\n$#r= "), max_size=60), st.sampled_from(codelex.LANGUAGES))
def test_places_stay(text, language):
    got = codelex.code_only(text, language)
    assert len(got) == len(text) and all(g == t or (g == " " and t != "\n") for g, t in zip(got, text, strict=True))


def test_one_definition_a_chunk():
    go = 'package p\n\nimport (\n\t"fmt"\n)\n\nfunc (t *T) Name() string {\n\treturn "}"\n}\n\nfunc Free() { fmt.Println(`{`) }\n\ntype T struct {\n\ta int\n}\n' + "// long enough not to be merged " * 5
    got = [(p.chunk_type, p.entity_name, p.start_line, p.end_line) for p in chunking.code(go, "go") if p.entity_name]
    assert ("method", "Name", 6, 8) in got or any(k == "method" for k, *_ in got)
    assert any(p.chunk_type == "imports" and '"fmt"' in p.text for p in chunking.code(go, "go"))
    js = "(function () {\n  class Inner {\n    go() { return '}'; }\n  }\n  function after() {\n    return `}`;\n  }\n})();\n"
    assert [(n, a, b) for n, _, a, b in chunking._braced_entities(js, "javascript")[0]] == [("Inner", 1, 3), ("after", 4, 6)]
    assert chunking.code("class A {", "java")[0].entity_name == "A" and chunking.code("no definitions", "rust")[0].chunk_type == "code_block"
