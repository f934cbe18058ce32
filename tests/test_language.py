"""Lexer, parser and binding."""

import pytest

from fathom.errors import SyntaxProblem, ValidationError
from fathom.lang import ast, bind
from fathom.lang.parser import parse, parse_expression


def first(text):
    return parse(text).operations[0].selections[0]


def test_values():
    f = first('{ c(a: 1, b: -2.5, c: "x\\n\\u00e9", d: [1, [true, null]], e: {k: $v, "q r": DESC}, f: """two\nlines""") { x } }')
    assert f.args == {"a": 1, "b": -2.5, "c": "x\né", "d": [1, [True, None]], "e": {"k": ast.Var("v"), "q r": "DESC"}, "f": "two\nlines"}


@pytest.mark.parametrize(
    "text, want",
    [
        ("a + b * c", ast.Binary("+", ast.Path(("a",)), ast.Binary("*", ast.Path(("b",)), ast.Path(("c",))))),
        ("f(a, -b)", ast.Call("f", (ast.Path(("a",)), ast.Unary("-", ast.Path(("b",)))))),
        ("x | f | g(1)", ast.Call("g", (ast.Call("f", (ast.Path(("x",)),)), ast.Lit(1)))),
        ("a.b ? 1 : c || d", ast.Ternary(ast.Path(("a", "b")), ast.Lit(1), ast.Binary("||", ast.Path(("c",)), ast.Path(("d",))))),
        ('"${a} b"', ast.Template("${a} b")),
        ('expr("x + 1")', ast.Sql("x + 1")),
    ],
)
def test_expressions(text, want):
    assert parse_expression(text) == want


def test_alias_or_expression():
    fields = first("{ c { a: b  c: d e: f(g)  h: lookup(collection: \"x\") { y }  i: now()  j: k.l } }").selections
    assert [(f.name, f.alias, f.expr is not None) for f in fields] == [("b", "a", False), ("d", "c", False), ("e", "e", True), ("lookup", "h", False), ("i", "i", True), ("j", "j", True)]


@pytest.mark.parametrize("text, line, column", [("query {\n  users( {\n", 2, 10), ("query { a { b } ", 1, 17), ("nonsense", 1, 1), ('{ a(x: "open\n") }', 1, 8), ("{ a(x: 1, x: 2) { b } }", 1, 14)])
def test_errors_tell_the_place(text, line, column):
    with pytest.raises(SyntaxProblem) as e:
        parse(text)
    assert e.value.line == line and abs(e.value.column - column) <= 1


def test_variables():
    defs = parse("query q($a: Int!, $b: String = \"d\", $c: [Int]) { x { y } }").operations[0].variables
    assert bind.variables(defs, {"a": 1}) == {"a": 1, "b": "d", "c": None}
    for bad in ({}, {"a": None}, {"a": "x"}, {"a": True}, {"a": 1, "c": ["x"]}):
        with pytest.raises(ValidationError):
            bind.variables(defs, bad)
    assert bind.resolve({"k": [ast.Var("a")]}, {"a": 3}) == {"k": [3]}
    with pytest.raises(ValidationError):
        bind.resolve(ast.Var("zz"), {})


def test_fragments():
    d = parse("fragment A on c { x ...B } fragment B on c { y } { c { ...A ... on other { z } } }")
    known = {"c", "other"}.__contains__
    bind.check_fragments(d, known)
    assert [f.name for f in bind.flatten(d.operations[0].selections[0].selections, d.fragments, {}, "c", known)] == ["x", "y"]
    for bad in ("fragment A on c { ...B } fragment B on c { ...A } { c { x } }", "fragment A on nowhere { x } { c { x } }"):
        with pytest.raises(ValidationError):
            bind.check_fragments(parse(bad), known)
    with pytest.raises(ValidationError):
        bind.flatten(parse("{ c { ...Z } }").operations[0].selections[0].selections, {}, {}, "c", known)
