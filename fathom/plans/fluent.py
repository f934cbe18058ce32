"""Queries built by calls."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ValidationError
from ..lang import ast
from ..operators import predicates as P
from ..operators import search
from ..streaming import feed
from .spec import QuerySpec

if TYPE_CHECKING:
    from ..engine import Engine


class Filters:
    """Conditions; they combine with &, | and ~."""

    def __getattr__(self, name: str) -> Callable[..., P.Leaf]:
        op = {"in_values": "in", "in_vec": "in", "nin": "nin", "starts_with": "startsWith", "ends_with": "endsWith", "contains_any": "containsAny", "contains_all": "containsAll", "is_null": "isNull", "is_not_null": "isNotNull"}.get(name, name)
        if op not in P.OPERATORS or op == "between":
            raise AttributeError(name)
        return lambda field, value=None: P.Leaf(field, op, value)

    def between(self, field: str, low: Any, high: Any) -> P.Leaf:
        return P.Leaf(field, "between", [low, high])


class QueryBuilder:
    def __init__(self, engine: Engine, collection: str):
        self.engine, self.collection = engine, collection
        self.filters: list[Any] = []
        self.order: list[tuple[str, bool]] = []
        self._limit: int | None = None
        self._offset = 0
        self.fields: list[str] | None = None
        self.interval: str | None = None

    def filter(self, f: Callable[[Filters], Any]) -> QueryBuilder:
        self.filters.append(f(Filters()))
        return self

    def order_by(self, field: str, ascending: bool = True) -> QueryBuilder:
        self.order.append((field, not ascending))
        return self

    def limit(self, n: int) -> QueryBuilder:
        self._limit = n
        return self

    def offset(self, n: int) -> QueryBuilder:
        self._offset = n
        return self

    def select(self, *fields: str) -> QueryBuilder:
        self.fields = list(fields)
        return self

    def debounce(self, interval: str) -> QueryBuilder:
        self.interval = interval
        return self

    @property
    def where(self) -> Any:
        return P.And(tuple(self.filters)) if self.filters else None

    def spec(self) -> QuerySpec:
        return QuerySpec(self.collection, self.where, order=self.order, limit=self._limit, offset=self._offset, selections=[ast.Field(f) for f in self.fields] if self.fields else None)

    def frame(self) -> DataFrame:
        return self.engine.compile(self.spec()).frame

    def collect(self) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.frame().collect()]

    def first_one(self) -> dict[str, Any] | None:
        got = self.limit(1).collect()
        return got[0] if got else None

    def count(self) -> int:
        return self.frame().count()

    def delete(self) -> int:
        from ..engine import Transaction

        tx = Transaction(self.engine)
        out = self.engine._delete(tx, ast.Field("delete"), self.collection, self.where, None)
        self.engine._commit(tx)
        return out.affected

    def watch(self) -> feed.Watch:
        """The query live: its rows now, and a stream of what is added, modified and removed; order and limit don't apply."""
        c = self.engine.catalog.get(self.collection)
        return feed.Watch(self.engine, c, self.where, self.interval)


class SearchBuilder:
    def __init__(self, engine: Engine, collection: str):
        self.engine, self.collection = engine, collection
        self.text, self.distance, self.names, self.n, self.least = "", None, None, None, None  # type: ignore[var-annotated]

    def query(self, text: str) -> SearchBuilder:
        self.text = text
        return self

    def fuzzy(self, distance: int = 1) -> SearchBuilder:
        self.distance = distance
        return self

    def fields(self, *names: str) -> SearchBuilder:
        self.names = list(names)
        return self

    def limit(self, n: int) -> SearchBuilder:
        self.n = n
        return self

    def min_score(self, least: float) -> SearchBuilder:
        self.least = least
        return self

    def frame(self) -> DataFrame:
        """Rows with the text in a field; with a distance, rows with words near it and their _score, best first."""
        c = self.engine.catalog.get(self.collection)
        df = c.frame()
        if self.distance is None:
            out = search.substring(df, self.text, self.names)
        else:
            out = search.fuzzy(df, self.text, self.distance, self.names)
        return self._best(out, c, self.distance is not None)

    def ranked(self, field: str) -> DataFrame:
        """Rows by BM25 of one field."""
        if self.names and field not in self.names:
            raise ValidationError(f"{field} isn't among the fields")
        c = self.engine.catalog.get(self.collection)
        df = c.frame()
        return self._best(search.bm25(df, field, self.text, key=c.sid(df.schema).column, distance=self.distance or 0), c, True)

    def _best(self, df: DataFrame, c: Any, scored: bool) -> DataFrame:
        if scored and self.least is not None:
            df = df.filter(F.col("_score") >= self.least)
        if scored:
            df = df.orderBy(F.col("_score").desc(), *(F.col(f"`{k}`") for k in c.keys))
        return df if self.n is None else df.limit(self.n)
