"""Streams of changes: event filters, subscriptions, live queries."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import Scope
from ..operators import predicates as P
from ..sources.catalog import SYSTEM_KEY, Collection

if TYPE_CHECKING:
    from ..engine import Engine


def schema_of(c: Collection) -> T.StructType:
    return T.StructType([f for f in c.load().schema if f.name != SYSTEM_KEY])


def parsed(events: DataFrame, c: Collection) -> DataFrame:
    """A collection's events with documents as structs."""
    kind = schema_of(c)
    of = events.filter(F.col("collection") == c.name)
    return of.withColumns({n: F.from_json(n, kind) for n in ("document", "old_document")})


def _holds(events: DataFrame, where: Any, column: str) -> Column:
    """Whether a condition holds of a document; never of one that isn't there."""
    kind = events.schema[column].dataType
    inside = P.compile_filter(_within(where, column), Scope(events.schema)) if where is not None else F.lit(True)
    assert isinstance(kind, T.StructType)
    return F.col(column).isNotNull() & F.coalesce(inside, F.lit(False))


def _within(tree: Any, column: str) -> Any:
    if isinstance(tree, P.Leaf):
        return P.Leaf("sid" if tree.field == "_sid" else f"{column}.{tree.field}", tree.op, tree.value)
    if isinstance(tree, P.Not):
        return P.Not(_within(tree.of, column))
    return type(tree)(tuple(_within(x, column) for x in tree.of))


# ---------------------------------------------------------------- event filters


def of_type(kind: str) -> Column:
    return F.col("change_type") == kind


def has_field(name: str) -> Column:
    return F.coalesce(F.col("document").getField(name).isNotNull(), F.lit(False))


def field_changed(name: str) -> Column:
    return F.coalesce(F.array_contains("changed_fields", name), F.lit(False))


def watching(names: list[str]) -> Column:
    """Leaves out updates that touch none of the fields."""
    return (F.col("change_type") != "Update") | F.coalesce(F.arrays_overlap("changed_fields", F.array(*map(F.lit, names))), F.lit(False))


def listen(events: DataFrame, c: Collection | None = None, condition: Column | None = None) -> DataFrame:
    """Events of a collection, or of all, that meet a condition."""
    out = parsed(events, c) if c is not None else events
    return out if condition is None else out.filter(condition)


def subscription(events: DataFrame, c: Collection, where: Any, fields: list[tuple[str, str]] | None) -> DataFrame:
    """Events whose document (for deletions: the old one) meets a filter, and its fields."""
    of = parsed(events, c)
    of = of.withColumn("document", F.coalesce("document", "old_document")).drop("old_document")
    of = of.filter(_holds(of, where, "document")) if where is not None else of
    if fields is None:
        return of
    column = lambda n: F.col("sid") if n == "_sid" else F.col("document").getField(n)
    return of.select("seq", "change_type", F.col("sid").alias("_sid"), *(column(n).alias(o) for o, n in fields if o != "_sid"))


# ---------------------------------------------------------------- live queries


def deltas(events: DataFrame, c: Collection, where: Any) -> DataFrame:
    """(seq, ts, sid, change, document, old_document): what changes mean for a query.

    An event carries both documents, so whether the row was and is in the result is
    seen without state: Added, Removed, or Modified.  Changes outside it give nothing.
    """
    of = parsed(events, c)
    was, now = _holds(of, where, "old_document"), _holds(of, where, "document")
    change = F.when(~was & now, "Added").when(was & ~now, "Removed").when(was & now, "Modified")
    out = of.select("seq", "ts", "sid", change.alias("change"), "document", "old_document")
    return out.filter(F.col("change").isNotNull())


def last_by_id(batch: DataFrame) -> DataFrame:
    """The last change of each id of a micro-batch."""
    fields = [F.col(n) for n in batch.columns if n not in ("sid", "seq")]
    last = batch.groupBy("sid").agg(F.max_by(F.struct("seq", *fields), "seq").alias("x"))
    return last.select("sid", "x.*").select(*batch.columns)


class Watch:
    """A live query."""

    def __init__(self, engine: Engine, c: Collection, where: Any, interval: str | None):
        self.engine, self.c, self.where, self.interval = engine, c, where, interval

    def snapshot(self) -> DataFrame:
        """The rows of now, each as Added."""
        df = self.c.load()
        scope, sid = self.c.scope(df.schema), self.c.sid(df.schema)
        hit = df.filter(P.compile_filter(self.where, scope, sid)) if self.where is not None else df
        kind = schema_of(self.c)
        doc = F.struct(*(F.col(f"`{f.name}`") for f in kind))
        return hit.select(F.lit(0).cast("long").alias("seq"), F.current_timestamp().alias("ts"), sid.column.alias("sid"), F.lit("Added").alias("change"), doc.alias("document"), F.lit(None).cast(kind).alias("old_document"))

    def stream(self, **options: Any) -> DataFrame:
        return deltas(self.engine.store.stream(**options), self.c, self.where)

    def start(self, sink: Any, checkpoint: str, *, available_now: bool = False, **options: Any) -> Any:
        """Runs the stream into sink(batch, id).  Debounced, a micro-batch comes each interval and has one change of an id."""
        debounced = self.interval is not None
        writer = self.stream(**options).writeStream.option("checkpointLocation", checkpoint).foreachBatch((lambda b, i: sink(last_by_id(b), i)) if debounced else sink)
        if available_now:
            writer = writer.trigger(availableNow=True)
        elif debounced:
            writer = writer.trigger(processingTime=self.interval)
        return writer.start()
