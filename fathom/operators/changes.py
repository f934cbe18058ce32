"""How rows are changed: modifiers, checks of constraints, imports, and the events that tell of changes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..sources.catalog import Catalog, Collection
from . import predicates as P

MODIFIERS = {"increment", "decrement", "push", "pull", "addToSet"}


def cast_value(value: Any, kind: T.DataType) -> Column:
    """A literal of a column's type; objects become JSON text in a text column."""
    import json

    if isinstance(value, (dict, list)) and isinstance(kind, T.StringType):
        return F.lit(json.dumps(value))
    if isinstance(value, list) and isinstance(kind, T.ArrayType):
        return F.array(*(cast_value(v, kind.elementType) for v in value)).cast(kind)
    if isinstance(value, dict):
        return F.from_json(F.lit(json.dumps(value)), kind) if isinstance(kind, T.StructType) else F.lit(json.dumps(value))
    return F.lit(value).cast(kind)


def new_value(column: Column, kind: T.DataType, value: Any) -> Column:
    """What an update makes of a column: a value, or a modifier of the old one; a missing number counts as 0, a missing list as empty."""
    if not (isinstance(value, dict) and len(value) == 1 and next(iter(value)) in MODIFIERS):
        return cast_value(value, kind)
    op, v = next(iter(value.items()))
    if op in ("increment", "decrement"):
        if not isinstance(kind, T.NumericType):
            raise ValidationError(f"{op} needs a number")
        old = F.coalesce(column, F.lit(0).cast(kind))
        return (old + F.lit(v) if op == "increment" else old - F.lit(v)).cast(kind)
    if not isinstance(kind, T.ArrayType):
        raise ValidationError(f"{op} needs a list")
    old, item = F.coalesce(column, F.array().cast(kind)), cast_value(v, kind.elementType)
    if op == "push":
        return F.concat(old, F.array(item))
    if op == "pull":
        return F.filter(column, lambda x: ~x.eqNullSafe(item))
    return F.when(F.exists(old, lambda x: x.eqNullSafe(item)), old).otherwise(F.concat(old, F.array(item)))


def updated(df: DataFrame, hit: Column, data: dict[str, Any]) -> DataFrame:
    """df with data set in the rows that are hit; all see the old row."""
    if unknown := [k for k in data if k not in df.columns]:
        raise ValidationError(f"unknown field {unknown[0]}")
    hit = F.coalesce(hit, F.lit(False))
    return df.withColumns({k: F.when(hit, new_value(F.col(f"`{k}`"), df.schema[k].dataType, v)).otherwise(F.col(f"`{k}`")) for k, v in data.items()})


def check(catalog: Catalog, c: Collection, before: DataFrame, fresh: DataFrame, after: DataFrame, frames: dict[str, DataFrame], validate: bool) -> None:
    """Raises where new rows break a constraint: required fields, unique ones, relations and, if asked for, validations.

    fresh: the rows that are new or changed; after: the whole table as it would be.
    Each kind of check is one pass over the new rows, and the joins are semi or anti.
    """
    required = [f.name for f in c.fields.values() if f.required and f.name in fresh.columns]
    scope = c.scope(fresh.schema)
    broken = [F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in required]
    ruled = {f.name: f.rules for f in c.fields.values() if f.rules and f.name in fresh.columns} if validate else {}
    broken += [F.count_if(~P.rules({n: r}, scope)).alias(f"rule {n}") for n, r in ruled.items()]
    if broken:
        for name, n in fresh.agg(*broken).first().asDict().items():
            if n:
                raise ValidationError(f"{name.removeprefix('rule ')} of {c.name} breaks its validation" if name.startswith("rule ") else f"{name} of {c.name} is required")
    for f in c.fields.values():
        if f.name not in fresh.columns:
            continue
        col = F.col(f"`{f.name}`")
        if f.unique:
            new = fresh.select(col.alias("v")).filter("v is not null")
            twice = after.select(col.alias("v")).join(new.distinct(), "v", "left_semi").groupBy("v").count().filter("count > 1").limit(1).collect()
            if twice:
                raise ValidationError(f"unique constraint violation: {c.name}.{f.name} = {twice[0][0]!r}")
        if f.relation is not None:
            other = catalog.get(f.relation[0])
            right = frames.get(other.name)
            right = other.load() if right is None else right
            key = other.sid(right.schema).column if f.relation[1] == "_sid" and "_sid" not in right.columns else F.col(f"`{f.relation[1]}`")
            lost = fresh.select(col.cast("string").alias("v")).filter("v is not null").join(right.select(key.cast("string").alias("v")), "v", "left_anti").limit(1).collect()
            if lost:
                raise ValidationError(f"foreign key violation: {c.name}.{f.name} = {lost[0][0]!r} isn't in {other.name}")


def events(collection: str, kind: str, old: DataFrame | None, new: DataFrame | None, sid: Column, fields: list[str]) -> DataFrame:
    """Change events (collection, change_type, sid, document, old_document, changed_fields) of rows inserted, updated or deleted."""
    body = F.to_json(F.struct(*(F.col(f"`{f}`") for f in fields)), {"ignoreNullFields": "false"})
    none, no_fields = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    head = [F.lit(collection).alias("collection"), F.lit(kind).alias("change_type")]
    if old is None or new is None:
        df = new if old is None else old
        assert df is not None
        return df.select(*head, sid.alias("sid"), (body if old is None else none).alias("document"), (none if old is None else body).alias("old_document"), no_fields.alias("changed_fields"))
    a = old.select(sid.alias("sid"), body.alias("old_document"), F.struct(*(F.col(f"`{f}`") for f in fields)).alias("a"))
    b = new.select(sid.alias("sid"), body.alias("document"), F.struct(*(F.col(f"`{f}`") for f in fields)).alias("b"))
    changed = F.array_compact(F.array(*(F.when(~F.col("a").getField(f).eqNullSafe(F.col("b").getField(f)), F.lit(f)) for f in fields)))
    both = a.join(b, "sid").withColumn("changed_fields", changed)
    return both.select(*head, "sid", "document", "old_document", "changed_fields")


def importable(rows: DataFrame, existing: DataFrame, c: Collection) -> tuple[DataFrame, DataFrame]:
    """(rows to import, rows that are skipped): a row goes in if neither its key nor a unique field of it is there already; of equal keys one does."""
    on = [k for k in c.keys if k in rows.columns] or [f.name for f in c.fields.values() if f.unique and f.name in rows.columns]
    if not on:
        return rows, rows.limit(0)
    fresh = rows.dropDuplicates(on).join(existing.select(*on).distinct(), on, "left_anti")
    for f in c.fields.values():
        if f.unique and f.name in rows.columns and f.name not in on:
            seen = existing.select(F.col(f"`{f.name}`").alias("__v")).filter("__v is not null").distinct()
            fresh = fresh.join(seen, F.col(f"`{f.name}`") == F.col("__v"), "left_anti").withColumn("__r", F.when(F.col(f"`{f.name}`").isNotNull(), F.col(f"`{f.name}`").cast("string")).otherwise(F.uuid())).dropDuplicates(["__r"]).drop("__r")
    fresh = fresh.select(*rows.columns)
    return fresh, rows.exceptAll(fresh)
