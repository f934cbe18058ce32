"""What a query asks for; all front ends make one of these."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..errors import ValidationError
from ..lang import ast
from ..operators import predicates as P


@dataclass
class Search:
    query: str
    fields: list[str] | None = None
    #: Greatest edit distance; None asks for substrings.
    fuzzy: int | None = None
    min_score: float | None = None


@dataclass
class QuerySpec:
    collection: str
    where: Any = None
    validate: dict | None = None
    search: Search | None = None
    #: (field, descending)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    after: str | None = None
    before: str | None = None
    last: int | None = None
    selections: list[ast.Field] | None = None


def _count(args: dict, *names: str) -> int | None:
    for n in names:
        if (v := args.get(n)) is not None:
            if isinstance(v, bool) or not isinstance(v, int) or v < 0:
                raise ValidationError(f"{n} must be a whole number of 0 or more")
            return v
    return None


def order_of(value: Any) -> list[tuple[str, bool]]:
    """Orders as "f", {field, direction}, {f: ASC, g: DESC}, or a list of these."""
    if value is None:
        return []
    if isinstance(value, list):
        return [o for v in value for o in order_of(v)]
    if isinstance(value, str):
        return [(value, False)]
    if not isinstance(value, dict):
        raise ValidationError(f"no order: {value!r}")
    pairs = [(value["field"], value.get("direction", "ASC"))] if "field" in value and set(value) <= {"field", "direction"} else list(value.items())
    for name, direction in pairs:
        if str(direction).upper() not in ("ASC", "DESC"):
            raise ValidationError(f"{name} is ordered by neither ASC nor DESC")
    return [(n, str(d).upper() == "DESC") for n, d in pairs]


_ARGS = {"where", "filter", "orderBy", "limit", "first", "offset", "skip", "after", "before", "last", "search", "validate"}


def from_field(f: ast.Field, selections: list[ast.Field] | None) -> QuerySpec:
    """The query of a root field of a text."""
    args = f.args
    if unknown := set(args) - _ARGS:
        raise ValidationError(f"unknown argument {sorted(unknown)[0]} of {f.name}")
    where = args.get("where", args.get("filter"))
    search = None
    if (s := args.get("search")) is not None:
        fuzzy = s.get("fuzzy")
        search = Search(str(s.get("query", "")), s.get("fields"), None if fuzzy in (None, False) else 1 if fuzzy is True else int(fuzzy), s.get("minScore"))
    return QuerySpec(
        f.name,
        P.from_object(where) if where is not None else None,
        args.get("validate"),
        search,
        order_of(args.get("orderBy")),
        _count(args, "limit", "first"),
        _count(args, "offset", "skip") or 0,
        args.get("after"),
        args.get("before"),
        _count(args, "last"),
        selections,
    )


#: Operators of a JSON payload.
_PAYLOAD = {"eq", "ne", "lt", "lte", "gt", "gte", "contains"}


def from_payload(collection: str, payload: dict[str, Any]) -> QuerySpec:
    """The query of a JSON payload {filters, sort, limit, offset, select}.  A missing value fails each of its filters, also ne."""
    parts: list[Any] = []
    for f in payload.get("filters") or []:
        op = str(f["operator"]).lower()
        if op not in _PAYLOAD:
            raise ValidationError(f"unknown operator {f['operator']}")
        parts.append(P.Leaf(f["field"], op, f["value"]))
        if op == "ne":
            parts.append(P.Leaf(f["field"], "isNotNull", True))
    sort = payload.get("sort")
    order = []
    for s in sort if isinstance(sort, list) else [sort] if sort else []:
        order.append((s["field"], not s["ascending"]) if "ascending" in s else order_of(s)[0])
    select = payload.get("select")
    return QuerySpec(collection, P.And(tuple(parts)) if parts else None, order=order, limit=_count(payload, "limit"), offset=_count(payload, "offset") or 0, selections=[ast.Field(s) for s in select] if select else None)
