"""Scalar functions and expressions of the query language, as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..lang import ast

_UNITS = {"second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY", "week": "WEEK", "month": "MONTH", "year": "YEAR"}


class Typed:
    """A column with its type, where that is known: some operators depend on it."""

    def __init__(self, column: Column, kind: T.DataType | None = None, value: Any = None):
        self.column, self.kind, self.value = column, kind, value

    @property
    def text(self) -> bool:
        return isinstance(self.kind, T.StringType)

    @property
    def whole(self) -> bool:
        return isinstance(self.kind, T.IntegralType)


_STRING, _LONG, _DOUBLE, _BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def literal(value: Any) -> Typed:
    kind = {bool: _BOOL, int: _LONG, float: _DOUBLE, str: _STRING}.get(type(value), T.NullType())
    return Typed(F.lit(value).cast("long") if kind is _LONG else F.lit(value), kind, value)


def truth(x: Typed) -> Column:
    """Null, zero, the empty string and false are false."""
    c = x.column
    if isinstance(x.kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(x.kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    if x.text:
        return F.coalesce(c != "", F.lit(False))
    return c.isNotNull()


def _element(x: Typed) -> T.DataType | None:
    return x.kind.elementType if isinstance(x.kind, T.ArrayType) else None


def _unit(x: Typed) -> str:
    unit = str(x.value).lower().removesuffix("s")
    if unit not in _UNITS:
        raise ValidationError(f"unknown unit {x.value!r}")
    return _UNITS[unit]


def _length(x: Typed) -> Column:
    if isinstance(x.kind, (T.ArrayType, T.MapType)):
        return F.size(x.column).cast("long")
    return F.char_length(x.column).cast("long")


def _fold(op: str, xs: tuple[Typed, ...]) -> Typed:
    out = xs[0]
    for x in xs[1:]:
        out = arithmetic(op, out, x)
    return out


def _guarded(x: Typed, y: Typed, op: str) -> Column:
    """Integer division truncates; otherwise a double; by zero null."""
    a, b = x.column, y.column
    if x.whole and y.whole:
        safe = F.when(b != 0, b)
        return (F.try_divide(a - F.try_mod(a, safe), safe).cast("long")) if op == "/" else F.try_mod(a, safe)
    a, b = a.cast("double"), b.cast("double")
    return F.try_divide(a, b) if op == "/" else F.try_mod(a, b)


def arithmetic(op: str, x: Typed, y: Typed) -> Typed:
    if op == "+" and (x.text or y.text):
        return Typed(F.concat(x.column.cast("string"), y.column.cast("string")), _STRING)
    kind = _LONG if x.whole and y.whole else _DOUBLE
    if op in "/%":
        return Typed(_guarded(x, y, op), kind)
    a, b = x.column.cast(kind), y.column.cast(kind)
    return Typed(a + b if op == "+" else a - b if op == "-" else a * b, kind)


def compare(op: str, x: Typed, y: Typed) -> Typed:
    """Two-valued: null equals null and is below everything else in no order."""
    a, b = x.column, y.column
    if op in ("==", "!="):
        same = a.eqNullSafe(b)
        return Typed(same if op == "==" else ~same, _BOOL)
    c = {">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
    return Typed(F.coalesce(c, F.lit(False)), _BOOL)


def _cast(x: Typed, kind: T.DataType) -> Typed:
    return Typed(x.column.try_cast(kind), kind)


def _all(xs: tuple[Typed, ...], both: bool) -> Typed:
    out = F.lit(both)
    for x in xs:
        out = out & truth(x) if both else out | truth(x)
    return Typed(out, _BOOL)


def _pick(x: Typed, name: Typed) -> Typed:
    inner = _element(x)
    if isinstance(inner, T.StructType) and str(name.value) in inner.names:
        return Typed(F.transform(x.column, lambda e: e[str(name.value)]), T.ArrayType(inner[str(name.value)].dataType))
    raise ValidationError(f"pluck finds no {name.value!r}")


def _numbers(x: Typed) -> Column:
    return F.transform(x.column, lambda e: e.cast("double"))


def _total(x: Typed) -> Column:
    return F.aggregate(_numbers(x), F.lit(0.0), lambda a, e: a + F.coalesce(e, F.lit(0.0)))


def _mean(x: Typed) -> Column:
    some = F.filter(_numbers(x), lambda e: e.isNotNull())
    return F.try_divide(F.aggregate(some, F.lit(0.0), lambda a, e: a + e), F.size(some).cast("double"))


def _end(x: Typed, place: int) -> Typed:
    return Typed(F.when(F.size(x.column) > 0, F.element_at(x.column, place)), _element(x))


def _same_kind(xs: tuple[Typed, ...]) -> T.DataType | None:
    kinds = [x.kind for x in xs if x.kind is not None and not isinstance(x.kind, T.NullType)]
    if kinds and all(isinstance(k, T.NumericType) for k in kinds):
        return _LONG if all(isinstance(k, T.IntegralType) for k in kinds) else _DOUBLE
    return kinds[0] if kinds else None


def _extreme(f: Callable, xs: tuple[Typed, ...]) -> Typed:
    if len(xs) == 1 and isinstance(xs[0].kind, T.ArrayType):
        return Typed((F.array_min if f is F.least else F.array_max)(xs[0].column), _element(xs[0]))
    kind = _same_kind(xs)
    return Typed(f(*(x.column.cast(kind) if kind else x.column for x in xs)), kind)


def _if(c: Typed, yes: Typed, no: Typed) -> Typed:
    kind = _same_kind((yes, no))
    if isinstance(kind, T.NumericType):
        return Typed(F.when(truth(c), yes.column.cast(kind)).otherwise(no.column.cast(kind)), kind)
    return Typed(F.when(truth(c), yes.column).otherwise(no.column), kind)


def _seconds(name: str) -> Callable[[Typed], Typed]:
    return lambda d: Typed(getattr(F, name)(d.column).cast("long"), _LONG)


def _rounded(x: Typed, places: Typed | None = None) -> Typed:
    return Typed(F.round(x.column.cast("double"), int(places.value or 0) if places else 0), _DOUBLE)


def _text(f: Callable[..., Column]) -> Callable[..., Typed]:
    return lambda *xs: Typed(f(*xs), _STRING)


def _dbl(f: Callable[..., Column]) -> Callable[..., Typed]:
    return lambda *xs: Typed(f(*xs), _DOUBLE)


def _whole_or(f: Callable[[Column], Column]) -> Callable[[Typed], Typed]:
    return lambda x: Typed(f(x.column).cast("long"), _LONG)


#: Functions by name.  Each takes typed columns and gives one.
FUNCTIONS: dict[str, Callable[..., Typed]] = {
    "concat": _text(lambda *xs: F.concat(*(F.coalesce(x.column.cast("string"), F.lit("")) for x in xs))),
    "uppercase": _text(lambda x: F.upper(x.column)),
    "lowercase": _text(lambda x: F.lower(x.column)),
    "trim": _text(lambda x: F.trim(x.column)),
    "substring": _text(lambda s, start, n=None: F.substring(s.column, start.column.cast("int") + 1, n.column.cast("int") if n else F.lit(2**31 - 1))),
    "truncate": _text(lambda s, n: F.left(s.column, n.column.cast("int"))),
    "replace": _text(lambda s, a, b: F.replace(s.column, a.column, b.column)),
    "length": lambda x: Typed(_length(x), _LONG),
    "format": _text(lambda f, *xs: F.format_string(str(f.value), *(x.column for x in xs))),
    "coalesce": lambda *xs: Typed(F.coalesce(*(x.column for x in xs)), _same_kind(xs)),
    "add": lambda *xs: _fold("+", xs),
    "subtract": lambda *xs: _fold("-", xs),
    "multiply": lambda *xs: _fold("*", xs),
    "divide": lambda x, y: Typed(F.try_divide(x.column.cast("double"), y.column.cast("double")), _DOUBLE),
    "mod": lambda x, y: arithmetic("%", x, y),
    "abs": lambda x: Typed(F.abs(x.column), x.kind),
    "round": _rounded,
    "floor": _whole_or(F.floor),
    "ceil": _whole_or(F.ceil),
    "min": lambda *xs: _extreme(F.least, xs),
    "max": lambda *xs: _extreme(F.greatest, xs),
    "pow": _dbl(lambda x, y: F.pow(x.column.cast("double"), y.column.cast("double"))),
    "sqrt": _dbl(lambda x: F.sqrt(x.column.cast("double"))),
    "if": _if,
    "and": lambda *xs: _all(xs, True),
    "or": lambda *xs: _all(xs, False),
    "not": lambda x: Typed(~truth(x), _BOOL),
    "eq": lambda x, y: compare("==", x, y),
    "ne": lambda x, y: compare("!=", x, y),
    "gt": lambda x, y: compare(">", x, y),
    "gte": lambda x, y: compare(">=", x, y),
    "lt": lambda x, y: compare("<", x, y),
    "lte": lambda x, y: compare("<=", x, y),
    "isNull": lambda x: Typed(x.column.isNull(), _BOOL),
    "isNotNull": lambda x: Typed(x.column.isNotNull(), _BOOL),
    "sum": _dbl(_total),
    "avg": _dbl(_mean),
    "count": lambda x: Typed(F.size(x.column).cast("long"), _LONG),
    "first": lambda x: _end(x, 1),
    "last": lambda x: _end(x, -1),
    "pluck": _pick,
    "join": _text(lambda x, sep=None: F.array_join(F.transform(x.column, lambda e: e.cast("string")), str(sep.value) if sep else ",")),
    "sort": lambda x: Typed(F.sort_array(x.column), x.kind),
    "now": lambda: Typed(F.current_timestamp(), T.TimestampType()),
    "dateAdd": lambda d, n, unit: Typed(F.timestamp_add(_unit(unit), n.column.cast("int"), d.column), d.kind),
    "dateDiff": lambda a, b, unit: Typed(F.timestamp_diff(_unit(unit), a.column, b.column), _LONG),
    "formatDate": _text(lambda d, f: F.date_format(d.column, str(f.value))),
    **{n: _seconds(n) for n in ("year", "month", "day", "hour", "minute", "second")},
    "toString": lambda x: _cast(x, _STRING),
    "toInt": lambda x: _cast(x, _LONG),
    "toFloat": lambda x: _cast(x, _DOUBLE),
    "toBoolean": lambda x: _cast(x, _BOOL),
}
FUNCTIONS |= {"upper": FUNCTIONS["uppercase"], "lower": FUNCTIONS["lowercase"], "len": FUNCTIONS["length"]}
#: Functions of which the second argument is evaluated for each element of an array, which `it` names.
_PER_ELEMENT = {"filter", "map"}
_NAMES = re.compile(r"\$\{\s*([A-Za-z_][\w.]*)\s*\}|\$([A-Za-z_]\w*)")


class Scope:
    """What names mean: the columns of a schema, or those of an array's element."""

    def __init__(self, schema: T.StructType, element: Typed | None = None):
        self.schema, self.element = schema, element

    def find(self, parts: tuple[str, ...]) -> Typed | None:
        """The field of a path; None if there is none."""
        if parts[0] == "doc" and parts[0] not in self.schema.names:
            parts = parts[1:] or parts
        if self.element is not None and parts[0] == "it":
            c, kind = self.element.column, self.element.kind
        elif parts[0] in self.schema.names:
            c, kind = F.col(f"`{parts[0]}`"), self.schema[parts[0]].dataType
        else:
            return None
        for p in parts[1:]:
            if isinstance(kind, T.StructType) and p in kind.names:
                c, kind = c.getField(p), kind[p].dataType
            elif isinstance(kind, T.MapType):
                c, kind = F.try_element_at(c, F.lit(p)), kind.valueType
            else:
                return None
        return Typed(c, kind)


def evaluate(x: Any, scope: Scope) -> Typed:
    """The column of an expression."""
    if isinstance(x, ast.Lit):
        return literal(x.value)
    if isinstance(x, ast.Path):
        if (found := scope.find(x.parts)) is None:
            raise ValidationError(f"unknown field {'.'.join(x.parts)}")
        return found
    if isinstance(x, ast.Template):
        return Typed(template(x.text, scope), _STRING)
    if isinstance(x, ast.Sql):
        return Typed(F.expr(x.text))
    if isinstance(x, ast.Ternary):
        return _if(evaluate(x.test, scope), evaluate(x.yes, scope), evaluate(x.no, scope))
    if isinstance(x, ast.Unary):
        inner = evaluate(x.operand, scope)
        return Typed(~truth(inner), _BOOL) if x.op == "!" else Typed(-inner.column, inner.kind)
    if isinstance(x, ast.Binary):
        left, right = evaluate(x.left, scope), evaluate(x.right, scope)
        if x.op in ("&&", "||"):
            return _all((left, right), x.op == "&&")
        return arithmetic(x.op, left, right) if x.op in "+-*/%" else compare(x.op, left, right)
    if isinstance(x, ast.Call):
        return _call(x, scope)
    raise ValidationError(f"no expression: {x!r}")


def _call(x: ast.Call, scope: Scope) -> Typed:
    if x.name in _PER_ELEMENT:
        over = evaluate(x.args[0], scope)
        kinds: list[T.DataType | None] = []

        def one(e: Column) -> Column:
            got = evaluate(x.args[1], Scope(scope.schema, Typed(e, _element(over))))
            kinds.append(got.kind)
            return truth(got) if x.name == "filter" else got.column

        c = (F.filter if x.name == "filter" else F.transform)(over.column, one)
        return Typed(c, over.kind if x.name == "filter" else T.ArrayType(kinds[0]) if kinds[0] else None)
    f = FUNCTIONS.get(x.name)
    if f is None:
        raise ValidationError(f"unknown function {x.name}")
    try:
        return f(*(evaluate(a, scope) for a in x.args))
    except TypeError as e:
        if "argument" in str(e):
            raise ValidationError(f"{x.name} doesn't take {len(x.args)} arguments") from None
        raise


def template(text: str, scope: Scope) -> Column:
    """A text with ${field} and $field filled in, null as nothing; unknown names stay as they are written."""
    parts: list[Column] = []
    at = 0
    for m in _NAMES.finditer(text):
        if (found := scope.find(tuple((m[1] or m[2]).split(".")))) is not None:
            parts += [F.lit(text[at : m.start()]), F.coalesce(found.column.cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(text[at:]))


def roots_of(x: Any) -> set[str] | None:
    """The columns that an expression reads; None if that can't be told."""
    if isinstance(x, (ast.Template, ast.Sql)):
        return None
    if isinstance(x, ast.Path):
        return {x.parts[0], *x.parts[1:2]} if x.parts[0] == "doc" else {x.parts[0]}
    inner = x.args if isinstance(x, ast.Call) else (x.left, x.right) if isinstance(x, ast.Binary) else (x.operand,) if isinstance(x, ast.Unary) else (x.test, x.yes, x.no) if isinstance(x, ast.Ternary) else ()
    out: set[str] = set()
    for part in inner:
        got = roots_of(part)
        if got is None:
            return None
        out |= got
    return out
