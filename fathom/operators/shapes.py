"""Aggregates and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..lang import ast
from . import timeseries

_AGGREGATES = {"sum", "avg", "min", "max", "count"}


def aggregate_column(name: str, field: str | None, schema: T.StructType) -> Column:
    """One aggregate.  All are doubles but count, and min and max of what isn't a number; the sum of nothing is 0."""
    if name == "count" and field is None:
        return F.count(F.lit(1))
    if field not in schema.names:
        raise ValidationError(f"unknown field {field}")
    kind, c = schema[field].dataType, F.col(f"`{field}`")
    if name == "count":
        return F.count(c)
    number = c.cast("double") if isinstance(kind, T.NumericType) else None
    if name in ("min", "max"):
        return (F.min if name == "min" else F.max)(c if number is None else number)
    number = c.try_cast("double") if number is None else number
    return F.coalesce(F.sum(number), F.lit(0.0)) if name == "sum" else F.avg(number)


def aggregate_columns(fields: list[ast.Field], schema: T.StructType) -> list[tuple[str, Column]]:
    """(name, column) of an aggregate block; several fields make a struct."""
    out = []
    for f in fields:
        if f.name not in _AGGREGATES:
            raise ValidationError(f"unknown aggregate {f.name}")
        if (many := f.args.get("fields")) is not None:
            out.append((f.out, F.struct(*(aggregate_column(f.name, m, schema).alias(m) for m in many))))
        else:
            if f.name != "count" and "field" not in f.args:
                raise ValidationError(f"{f.name} needs field")
            out.append((f.out, aggregate_column(f.name, f.args.get("field"), schema)))
    return out


def group(df: DataFrame, f: ast.Field, inner: list[ast.Field], nodes: dict[str, list[tuple[str, Column]]], blocks: dict[str, list[ast.Field]]) -> DataFrame:
    """A row for each group: key (a string, "null" for none), keys, timestamp, count, aggregate blocks and nodes, as selected."""
    args = f.args
    by = args.get("fields") or ([args["field"]] if "field" in args else [])
    for name in by:
        if name not in df.columns:
            raise ValidationError(f"unknown field {name}")
    if not by:
        raise ValidationError("groupBy needs field or fields")
    text = lambda n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("null"))
    if "interval" in args:
        at = timeseries.epoch(df, by[0])
        keys = [timeseries.bucket(at, timeseries.seconds(args["interval"])).alias("timestamp")]
    else:
        keys = [text(n).alias(f"__k{i}") for i, n in enumerate(by)]
    aggregates: list[Column] = []
    outs: list[Column] = []
    for x in inner:
        name = x.out
        if x.name == "key":
            outs.append((F.col("timestamp").cast("string") if "interval" in args else F.concat_ws(",", *(F.col(f"__k{i}") for i in range(len(by))))).alias(name))
        elif x.name == "keys":
            outs.append(F.struct(*(F.col(f"__k{i}").alias(n) for i, n in enumerate(by))).alias(name))
        elif x.name == "timestamp":
            if "interval" not in args:
                raise ValidationError("timestamp needs an interval")
            outs.append(F.col("timestamp").alias(name))
        elif x.name == "count":
            aggregates.append(F.count(F.lit(1)).alias(f"__a_{name}"))
            outs.append(F.col(f"`__a_{name}`").alias(name))
        elif x.name == "aggregate":
            aggregates.append(F.struct(*(c.alias(n) for n, c in aggregate_columns(blocks[name], df.schema))).alias(f"__a_{name}"))
            outs.append(F.col(f"`__a_{name}`").alias(name))
        elif x.name == "nodes":
            aggregates.append(F.array_sort(F.collect_list(F.struct(*(c.alias(n) for n, c in nodes[name])))).alias(f"__a_{name}"))
            outs.append(F.col(f"`__a_{name}`").alias(name))
        elif x.name in by and "interval" not in args:
            outs.append(F.col(f"__k{by.index(x.name)}").alias(name))
        else:
            raise ValidationError(f"groupBy has no {x.name}")
    return df.groupBy(*keys).agg(*(aggregates or [F.count(F.lit(1)).alias("__a")])).select(*outs)
