"""Filters: a tree of conditions, and the Spark column it stands for.

Filters are two-valued: a condition on a missing value is false (ne, nin and isNull:
true), also below `not`.  A bare predicate is pushed down to the scan, so nulls are
only made explicit below a negation, where they change the answer.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.scalar import Scope, Typed


@dataclass(frozen=True)
class Leaf:
    field: str
    op: str
    value: Any = None

    def __and__(self, other: Any) -> And:
        return And((self, other))

    def __or__(self, other: Any) -> Or:
        return Or((self, other))

    def __invert__(self) -> Not:
        return Not(self)


@dataclass(frozen=True)
class And:
    of: tuple

    __and__, __or__, __invert__ = Leaf.__and__, Leaf.__or__, Leaf.__invert__


@dataclass(frozen=True)
class Or:
    of: tuple

    __and__, __or__, __invert__ = Leaf.__and__, Leaf.__or__, Leaf.__invert__


@dataclass(frozen=True)
class Not:
    of: Any

    __and__, __or__, __invert__ = Leaf.__and__, Leaf.__or__, Leaf.__invert__


OPERATORS = {"eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "notin", "contains", "containsAny", "containsAll", "startsWith", "endsWith", "matches", "isNull", "isNotNull", "between"}


def from_object(obj: Any) -> Any:
    """The tree of a filter object: all its entries must hold, and all operators of an entry."""
    if not isinstance(obj, dict):
        raise ValidationError(f"no filter: {obj!r}")
    parts: list[Any] = []
    for key, value in obj.items():
        if key in ("and", "or") and isinstance(value, list):
            inner = tuple(from_object(v) for v in value)
            parts.append(And(inner) if key == "and" else Or(inner))
        elif key == "not" and isinstance(value, dict):
            parts.append(Not(from_object(value)))
        elif isinstance(value, dict):
            for op, v in value.items():
                if op not in OPERATORS:
                    raise ValidationError(f"unknown operator {op} on {key}")
                parts.append(Leaf(key, op, v))
        else:
            parts.append(Leaf(key, "eq", value))
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def fields_of(tree: Any) -> set[str]:
    if isinstance(tree, Leaf):
        return {tree.field}
    return set().union(*map(fields_of, tree.of)) if isinstance(tree, (And, Or)) else fields_of(tree.of)


def compile_filter(tree: Any, scope: Scope, sid: Sid | None = None) -> Column:
    """The column of a tree; sid says what the pseudo-field _sid is."""
    return _compile(tree, scope, sid, False)


class Sid:
    """The system id of a collection: its key columns as one string."""

    def __init__(self, keys: list[T.StructField]):
        self.keys = keys

    @property
    def column(self) -> Column:
        parts = [F.col(f"`{k.name}`").cast("string") for k in self.keys]
        return parts[0] if len(parts) == 1 else F.concat_ws(":", *parts)

    def equal(self, values: Iterable[str]) -> Column:
        """Whether the id is one of values, on the key itself where that can be pushed down."""
        values = [str(v) for v in values]
        if len(self.keys) == 1 and isinstance(self.keys[0].dataType, T.IntegralType):
            whole = [int(v) for v in values if v.lstrip("-").isdigit()]
            return F.col(f"`{self.keys[0].name}`").isin(whole) if whole else F.lit(False)
        return self.column.isin(values)


def _compile(tree: Any, scope: Scope, sid: Sid | None, negated: bool) -> Column:
    if isinstance(tree, (And, Or)):
        both = isinstance(tree, And)
        out: Column | None = None
        for part in tree.of:
            c = _compile(part, scope, sid, negated)
            out = c if out is None else out & c if both else out | c
        return F.lit(both) if out is None else out
    if isinstance(tree, Not):
        return ~_compile(tree.of, scope, sid, True)
    return _leaf(tree, scope, sid, negated)


def _leaf(x: Leaf, scope: Scope, sid: Sid | None, negated: bool) -> Column:
    if x.field == "_sid" and sid is not None and "_sid" not in scope.schema.names:
        if x.op in ("eq", "in"):
            return sid.equal(x.value if x.op == "in" else [x.value])
        found = Typed(sid.column, T.StringType())
    else:
        got = scope.find(tuple(x.field.split(".")))
        if got is None:
            raise ValidationError(f"unknown field {x.field}")
        found = got
    c = _condition(x, found)
    return F.coalesce(c, F.lit(False)) if negated and x.op not in ("ne", "nin", "notin", "isNull", "isNotNull") else c


def _operand(value: Any, kind: T.DataType | None, field: str) -> Column:
    """A literal of the column's type; values that can't be compared with it are errors."""
    if isinstance(value, (list, dict)):
        raise ValidationError(f"{field} can't be compared with {value!r}")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        if not isinstance(value, (str, dt.date)):
            raise ValidationError(f"{field} can't be compared with {value!r}")
        return F.lit(value).cast(kind)
    fits = isinstance(value, bool) == isinstance(kind, T.BooleanType) and isinstance(value, (int, float)) == isinstance(kind, (T.NumericType, T.BooleanType))
    if kind is not None and not fits:
        raise ValidationError(f"{field} can't be compared with {value!r}")
    return F.lit(value)


def _list(x: Leaf) -> list:
    if not isinstance(x.value, (list, tuple)):
        raise ValidationError(f"{x.op} on {x.field} needs a list")
    return list(x.value)


def _member(x: Leaf, c: Column, kind: T.DataType | None) -> Column:
    values = _list(x)
    some = [_operand(v, kind, x.field) for v in values if v is not None]
    out = c.isin(some) if some else F.lit(False)
    return out | c.isNull() if None in values else out


def _text(x: Leaf, kind: T.DataType | None) -> str:
    if not isinstance(x.value, str) or not isinstance(kind, (T.StringType, type(None))):
        raise ValidationError(f"{x.op} on {x.field} needs strings")
    return x.value


def _condition(x: Leaf, found: Typed) -> Column:
    c, kind, v = found.column, found.kind, x.value
    match x.op:
        case "eq":
            return c.isNull() if v is None else c == _operand(v, kind, x.field)
        case "ne":
            return c.isNotNull() if v is None else ~c.eqNullSafe(_operand(v, kind, x.field))
        case "gt" | "gte" | "lt" | "lte":
            if v is None:
                return F.lit(False)
            o = _operand(v, kind, x.field)
            return {"gt": c > o, "gte": c >= o, "lt": c < o, "lte": c <= o}[x.op]
        case "between":
            low, high = _list(x)
            return c.between(_operand(low, kind, x.field), _operand(high, kind, x.field))
        case "in":
            return _member(x, c, kind)
        case "nin" | "notin":
            return ~F.coalesce(_member(x, c, kind), F.lit(False))
        case "contains":
            if isinstance(kind, T.ArrayType):
                return F.array_contains(c, _operand(v, kind.elementType, x.field))
            return c.contains(_text(x, kind))
        case "containsAny" | "containsAll":
            if not isinstance(kind, T.ArrayType):
                raise ValidationError(f"{x.op} on {x.field} needs an array")
            values = [_operand(e, kind.elementType, x.field) for e in _list(x)]
            if not values:
                return c.isNotNull() & F.lit(x.op == "containsAll")
            wanted = F.array(*(e.cast(kind.elementType) for e in values))
            return F.arrays_overlap(F.filter(c, lambda e: e.isNotNull()), wanted) if x.op == "containsAny" else F.size(F.array_except(wanted, c)) == 0
        case "startsWith":
            return c.startswith(_text(x, kind))
        case "endsWith":
            return c.endswith(_text(x, kind))
        case "matches":
            return c.rlike(pattern(_text(x, kind)))
        case "isNull" | "isNotNull":
            return c.isNull() if (x.op == "isNull") == (v is not False) else c.isNotNull()
    raise ValidationError(f"unknown operator {x.op}")


def pattern(text: str) -> str:
    """A regular expression without look-around or back-references, whose time stays linear elsewhere."""
    if re.search(r"\(\?<?[=!]|\\[1-9]|\\k<", text):
        raise ValidationError("look-around and back-references aren't supported")
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", text).replace(r"\p{", "[{").replace(r"\P{", "[{"))
    except re.error:
        if r"\p" not in text and r"\P" not in text:
            raise ValidationError(f"no regular expression: {text!r}") from None
    return text


def rules(obj: dict[str, dict[str, Any]], scope: Scope) -> Column:
    """Row validation: each constraint of each field; a missing value passes."""
    out = F.lit(True)
    for name, wanted in obj.items():
        got = scope.find(tuple(name.split(".")))
        if got is None:
            raise ValidationError(f"unknown field {name}")
        c = got.column
        for rule, v in wanted.items():
            if rule == "min":
                ok = c >= F.lit(v)
            elif rule == "max":
                ok = c <= F.lit(v)
            elif rule == "minLength":
                ok = F.octet_length(c) >= int(v)
            elif rule == "maxLength":
                ok = F.octet_length(c) <= int(v)
            elif rule == "pattern":
                ok = c.rlike(pattern(v))
            elif rule == "format":
                ok = _format(c, v)
            else:
                raise ValidationError(f"unknown constraint {rule}")
            out = out & F.coalesce(ok, F.lit(True))
    return out


def _format(c: Column, name: str) -> Column:
    if name == "email":
        return F.regexp_like(c, F.lit(r"^[^@]*@.*\..*$"))
    if name == "url":
        return c.startswith("http://") | c.startswith("https://")
    if name == "uuid":
        return F.regexp_like(c, F.lit(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))
    return F.lit(True)
