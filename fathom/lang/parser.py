"""Recursive descent from tokens to the syntax tree."""

from __future__ import annotations

from typing import Any

from ..errors import SyntaxProblem
from . import ast
from .lexer import Token, tokens

#: Selections with a meaning of their own: never the start of an expression.
SPECIAL = {"lookup", "groupBy", "windowFunc", "downsample", "aggregate", "edges", "pageInfo"}
_LEVELS = (("||",), ("&&",), ("==", "!="), (">=", "<=", ">", "<"), ("+", "-"), ("*", "/", "%"))
_GOES_ON = {"+", "-", "*", "/", "%", "?", "|", "||", "&&", "==", "!=", ">=", "<=", ">", "<", "."}


class Parser:
    def __init__(self, text: str):
        self.tokens = tokens(text)
        self.at = 0

    # ------------------------------------------------------------ tokens

    def peek(self, ahead: int = 0) -> Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def fail(self, wanted: str) -> SyntaxProblem:
        t = self.peek()
        return SyntaxProblem(f"expected {wanted}, found {t.text!r}" if t.kind != "end" else f"expected {wanted}, found the end", t.line, t.column)

    def is_(self, *texts: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind in ("name", "sign") and t.text in texts

    def take(self, text: str) -> bool:
        if self.is_(text):
            self.at += 1
            return True
        return False

    def operator(self, *texts: str) -> str | None:
        """Takes one of the operators, if it comes next and no comma before it."""
        if self.is_(*texts) and not self.peek().comma:
            self.at += 1
            return self.tokens[self.at - 1].text
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise self.fail(repr(text))

    def name(self, what: str = "a name") -> str:
        if self.peek().kind != "name":
            raise self.fail(what)
        self.at += 1
        return self.tokens[self.at - 1].text

    def string(self) -> str:
        if self.peek().kind not in ("string", "block"):
            raise self.fail("a string")
        self.at += 1
        return self.tokens[self.at - 1].value

    # ------------------------------------------------------------ document

    def document(self) -> ast.Document:
        operations, fragments = [], {}
        while self.peek().kind != "end":
            if self.take("fragment"):
                name = self.name()
                self.need("on")
                if name in fragments:
                    raise self.fail(f"no second fragment {name!r}")
                fragments[name] = ast.Fragment(name, self.name(), self.selections())
            else:
                operations.append(self.operation())
        if not operations:
            raise self.fail("an operation")
        return ast.Document(operations, fragments)

    def operation(self) -> Any:
        if self.is_("{"):
            return ast.Operation("query", None, [], [], self.selections())
        word = self.peek().text
        if word in ("query", "mutation", "subscription"):
            self.at += 1
            name = self.name() if self.peek().kind == "name" else None
            variables = self.variable_definitions()
            return ast.Operation(word, name, variables, self.directives(), self.selections())
        if self.take("schema"):
            return ast.Schema(self.block(self.definition))
        if self.take("migrate"):
            return ast.Migration(self.block(self.step))
        if self.take("__schema"):
            if self.is_("("):
                self.arguments()
            return ast.Introspection(self.block(self.name))
        if self.is_("define") and self.is_("handler", ahead=1):
            self.at += 2
            name = self.string()
            self.need("{")
            self.need("on")
            self.need(":")
            on = self.string()
            self.need("action")
            self.need(":")
            action = self.selections()
            self.need("}")
            if len(action) != 1:
                raise self.fail("one action")
            return ast.Handler(name, on, action[0])
        raise self.fail("an operation")

    def block(self, one) -> list:
        self.need("{")
        out = []
        while not self.take("}"):
            out.append(one())
        return out

    def variable_definitions(self) -> list[ast.VarDef]:
        out = []
        if self.take("("):
            while not self.take(")"):
                self.need("$")
                name = self.name()
                self.need(":")
                kind, required = self.type()
                given = self.take("=")
                out.append(ast.VarDef(name, kind, required, self.value() if given else None, given))
        return out

    def type(self) -> tuple[str, bool]:
        if self.take("["):
            inner, _ = self.type()
            self.need("]")
            kind = f"[{inner}]"
        else:
            kind = self.name("a type")
        return kind, self.take("!")

    # ------------------------------------------------------------ selections

    def selections(self) -> list:
        return self.block(self.selection)

    def selection(self) -> Any:
        t = self.peek()
        if self.take("..."):
            if self.take("on"):
                on = self.name()
                directives = self.directives()
                return ast.Inline(on, self.selections(), directives)
            return ast.Spread(self.name(), self.directives())
        alias = None
        if t.kind == "name" and self.is_(":", ahead=1):
            alias = self.name()
            self.at += 1
            if self.starts_expression():
                return ast.Field(alias, alias, expr=self.expression(), directives=self.directives(), place=(t.line, t.column))
        name = self.name("a field")
        args = self.arguments() if self.is_("(") else {}
        directives = self.directives()
        selections = self.selections() if self.is_("{") else None
        return ast.Field(name, alias, args, directives, selections, place=(t.line, t.column))

    def starts_expression(self) -> bool:
        t = self.peek()
        if t.kind != "name":
            return True
        if t.text in ("true", "false", "null"):
            return True
        if t.text in SPECIAL:
            return False
        if self.is_("(", ahead=1):
            return not (self.peek(2).kind == "name" and self.is_(":", ahead=3))
        return self.is_(*_GOES_ON, ahead=1) and not self.peek(1).comma

    def arguments(self) -> dict[str, Any]:
        self.need("(")
        out: dict[str, Any] = {}
        while not self.take(")"):
            name = self.name("an argument")
            self.need(":")
            if name in out:
                raise self.fail(f"no second {name!r}")
            out[name] = self.value()
        return out

    def directives(self) -> list[ast.Directive]:
        out = []
        while self.take("@"):
            name = self.name("a directive")
            out.append(ast.Directive(name, self.arguments() if self.is_("(") else {}))
        return out

    def value(self) -> Any:
        t = self.peek()
        if self.take("$"):
            return ast.Var(self.name())
        if self.take("-"):
            if self.peek().kind != "number":
                raise self.fail("a number")
            return -self.value()
        if t.kind in ("string", "block", "number"):
            self.at += 1
            return t.value
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.value())
            return out
        if self.take("{"):
            obj: dict[str, Any] = {}
            while not self.take("}"):
                key = self.string() if self.peek().kind in ("string", "block") else self.name("a key")
                self.need(":")
                if key in obj:
                    raise self.fail(f"no second {key!r}")
                obj[key] = self.value()
            return obj
        word = self.name("a value")
        return {"true": True, "false": False, "null": None}.get(word, ast.Enum(word))

    # ------------------------------------------------------------ expressions

    def expression(self) -> Any:
        """A ternary, then any pipes: x | f | g(a) is g(f(x), a)."""
        x = self.ternary()
        while self.operator("|"):
            name = self.name("a function")
            x = ast.Call(name, (x, *(self.call_args() if self.is_("(") else ())))
        return x

    def ternary(self) -> Any:
        x = self.binary(0)
        if self.operator("?"):
            yes = self.ternary()
            self.need(":")
            return ast.Ternary(x, yes, self.ternary())
        return x

    def binary(self, level: int) -> Any:
        if level == len(_LEVELS):
            return self.unary()
        x = self.binary(level + 1)
        while op := self.operator(*_LEVELS[level]):
            x = ast.Binary(op, x, self.binary(level + 1))
        return x

    def unary(self) -> Any:
        for op in "!-":
            if self.take(op):
                return ast.Unary(op, self.unary())
        t = self.peek()
        if self.take("("):
            x = self.expression()
            self.need(")")
            return x
        if self.take("$"):
            return ast.Var(self.name())
        if t.kind in ("string", "block"):
            self.at += 1
            return ast.Template(t.value) if "$" in t.value else ast.Lit(t.value)
        if t.kind == "number":
            self.at += 1
            return ast.Lit(t.value)
        word = self.name("an expression")
        if word in ("true", "false", "null"):
            return ast.Lit({"true": True, "false": False}.get(word))
        if self.is_("("):
            if word == "expr":
                self.need("(")
                text = self.string()
                self.need(")")
                return ast.Sql(text)
            return ast.Call(word, self.call_args())
        parts = [word]
        while self.take("."):
            parts.append("*" if self.take("*") else self.name("a field"))
        return ast.Path(tuple(parts))

    def call_args(self) -> tuple:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
        return tuple(out)

    # ------------------------------------------------------------ schema

    def definition(self) -> Any:
        if self.take("define"):
            self.need("collection")
            name = self.name()
            guard = self.take("if")
            if guard:
                self.need("not")
                self.need("exists")
            return ast.Define(name, self.block(self.field_definition), guard)
        if self.take("alter"):
            self.need("collection")
            return ast.Alter(self.name(), self.block(self.alteration))
        if self.take("drop"):
            self.need("collection")
            name = self.name()
            guard = self.take("if")
            if guard:
                self.need("exists")
            return ast.Drop(name, guard)
        raise self.fail("define, alter or drop")

    def field_definition(self) -> ast.FieldDef:
        name = self.name("a field")
        self.need(":")
        kind, required = self.type()
        return ast.FieldDef(name, kind, required, self.directives())

    def alteration(self) -> tuple:
        if self.take("add"):
            f = self.field_definition()
            if self.take("="):
                f.default, f.has_default = self.value(), True
            return "add", f
        if self.take("drop"):
            return "drop", self.name()
        if self.take("rename"):
            old = self.name()
            self.need("to")
            return "rename", old, self.name()
        if self.take("modify"):
            return "modify", self.field_definition()
        raise self.fail("add, drop, rename or modify")

    def step(self) -> tuple[str, list]:
        t = self.peek()
        if t.kind not in ("string", "block", "number", "name"):
            raise self.fail("a version")
        self.at += 1
        version = t.value if t.kind in ("string", "block") else t.text
        self.need(":")
        return version, self.block(self.migration_action)

    def migration_action(self) -> Any:
        if not self.take("migrate"):
            return self.definition()
        self.need("data")
        self.need("in")
        name = self.name()

        def one() -> tuple:
            self.need("set")
            target = self.name()
            self.need("=")
            expr = self.expression()
            where = self.value() if self.take("where") else None
            return target, expr, where

        return ast.DataMigration(name, self.block(one))


def parse(text: str) -> ast.Document:
    return Parser(text).document()


def parse_expression(text: str) -> Any:
    p = Parser(text)
    x = p.expression()
    if p.peek().kind != "end":
        raise p.fail("the end")
    return x
