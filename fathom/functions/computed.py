"""Computed fields that a collection registers: each is a function of the schema that gives a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.parser import parse_expression
from .scalar import Scope, evaluate, template

Computed = Callable[[T.StructType], Column]


def concat(*fields: str) -> Computed:
    """The fields as strings, separated by a space; nulls are left out."""
    return lambda schema: F.concat_ws(" ", *(F.col(f"`{f}`").cast("string") for f in fields))


def total(*fields: str) -> Computed:
    """The sum of the fields; null counts as nothing."""
    return lambda schema: sum((F.coalesce(F.col(f"`{f}`"), F.lit(0)) for f in fields[1:]), F.coalesce(F.col(f"`{fields[0]}`"), F.lit(0)))


def product(*fields: str) -> Computed:
    """The product of the fields; null if one is."""

    def build(schema: T.StructType) -> Column:
        out = F.col(f"`{fields[0]}`")
        for f in fields[1:]:
            out = out * F.col(f"`{f}`")
        return out

    return build


def average(*fields: str) -> Computed:
    """The mean of the fields that aren't null."""
    several = lambda: F.filter(F.array(*(F.col(f"`{f}`").cast("double") for f in fields)), lambda x: x.isNotNull())
    return lambda schema: F.try_divide(F.aggregate(several(), F.lit(0.0), lambda a, x: a + x), F.size(several()).cast("double"))


def templated(text: str) -> Computed:
    return lambda schema: template(text, Scope(schema))


def script(text: str) -> Computed:
    """An expression over doc.field or field."""
    parsed = parse_expression(text)
    return lambda schema: evaluate(parsed, Scope(schema)).column


def custom(f: Computed) -> Computed:
    return f
