"""From a QuerySpec to a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..functions.scalar import evaluate, roots_of
from ..lang import ast
from ..operators import predicates as P
from ..operators import search, shapes, timeseries
from ..sources.catalog import Catalog, Collection
from ..sources.shared import checked
from .spec import QuerySpec

#: A limit up to this leaves so few rows that their keys may be broadcast, if they are of a fixed width; text keys are left to Spark, which measures them.
FEW_ROWS = 100_000


@dataclass
class Compiled:
    frame: DataFrame
    #: documents, connection, groups, aggregate or buckets.
    shape: str = "documents"
    deferred: list[str] = field(default_factory=list)


class Compiler:
    """flatten: gives the fields of a selection set on a collection."""

    def __init__(self, catalog: Catalog, flatten: Any = None):
        self.catalog = catalog
        self.flatten = flatten or (lambda selections, on: list(selections))

    # ------------------------------------------------------------ rows

    def rows(self, spec: QuerySpec, c: Collection) -> tuple[DataFrame, list[tuple[Column, bool]]]:
        """The rows of a query, before they are shaped, and the order that they are in."""
        df = c.frame()
        scope, sid = c.scope(df.schema), c.sid(df.schema)
        if spec.where is not None:
            df = df.filter(P.compile_filter(spec.where, scope, sid))
        if spec.validate:
            df = df.filter(P.rules(spec.validate, scope))
        order: list[tuple[Column, bool]] = []
        if spec.search is not None:
            df, scored = self.found(df, spec)
            if scored and not spec.order:
                order.append((F.col("_score"), True))
        for name, down in spec.order:
            order.append((self.order_column(name, c, df), down))
        paged = spec.limit is not None or spec.offset or spec.after or spec.before or spec.last is not None
        if not order and not paged:
            return df, []
        order += [(F.col(f"`{k}`"), False) for k in c.keys]
        if spec.after is not None:
            df = self.beyond(df, c, spec.after, order, False)
        if spec.before is not None:
            df = self.beyond(df, c, spec.before, order, True)
        return df, order

    def order_column(self, name: str, c: Collection, df: DataFrame) -> Column:
        if name == "_sid" and "_sid" not in df.columns:
            return c.sid(df.schema).column
        if name == "_score" and "_score" in df.columns:
            return F.col("_score")
        if (found := c.scope(df.schema).find(tuple(name.split(".")))) is None:
            raise ValidationError(f"{c.name} has no field {name}")
        return found.column

    def found(self, df: DataFrame, spec: QuerySpec) -> tuple[DataFrame, bool]:
        s = spec.search
        assert s is not None
        if s.fuzzy is None:
            if s.min_score is not None:
                raise ValidationError("minScore needs fuzzy")
            return search.substring(df, s.query, s.fields), False
        df = search.fuzzy(df, s.query, s.fuzzy, s.fields)
        return (df.filter(F.col("_score") >= float(s.min_score)) if s.min_score is not None else df), True

    def beyond(self, df: DataFrame, c: Collection, cursor: str, order: list[tuple[Column, bool]], before: bool) -> DataFrame:
        """The rows after the cursor's (or before it), by a comparison of keys; an unknown cursor skips nothing."""
        whole = c.frame()
        if "_score" in df.columns and "_score" not in whole.columns:
            whole = df
        got = whole.filter(c.sid(whole.schema).equal([cursor])).select(*(o.alias(f"k{i}") for i, (o, _) in enumerate(order))).limit(1).collect()
        if not got:
            return df
        out: Column = F.lit(False)
        for (o, down), v in reversed(list(zip(order, got[0], strict=True))):
            up = down == before
            at = F.lit(v)
            same = o.eqNullSafe(at)
            # In ascending order nulls come first, in descending order last.
            past = (o.isNotNull() if v is None else o > at) if up else (F.lit(False) if v is None else (o < at) | o.isNull())
            out = past | (same & out)
        return df.filter(F.coalesce(out, F.lit(False)))

    @staticmethod
    def sorts(order: list[tuple[Column, bool]], backwards: bool = False) -> list[Column]:
        return [o.desc() if down != backwards else o.asc() for o, down in order]

    def page(self, df: DataFrame, spec: QuerySpec, order: list[tuple[Column, bool]], extra: int = 0) -> DataFrame:
        if spec.last is not None:
            return df.orderBy(*self.sorts(order, True)).limit(spec.last + extra)
        plain = not spec.order and spec.search is None and not spec.offset and spec.after is None and spec.before is None and not extra
        if order and not plain:
            df = df.orderBy(*self.sorts(order))
        if spec.offset:
            df = df.offset(spec.offset)
        return df if spec.limit is None else df.limit(spec.limit + extra)

    # ------------------------------------------------------------ shapes

    def compile(self, spec: QuerySpec) -> Compiled:
        c = self.catalog.get(spec.collection)
        df, order = self.rows(spec, c)
        selections = spec.selections
        if selections is None:
            return Compiled(self.ordered(self.page(df, spec, order), spec, order))
        by = {f.name: f for f in selections if f.name in ("edges", "pageInfo", "groupBy", "aggregate", "downsample")}
        if "edges" in by or "pageInfo" in by:
            return Compiled(self.connection(df, spec, c, order), "connection")
        df = self.ordered(self.page(df, spec, order), spec, order)
        if (g := by.get("groupBy")) is not None:
            inner = self.flatten(g.selections or [ast.Field("key"), ast.Field("count")], c.name)
            nodes = {f.out: self.columns(df, c, self.flatten(f.selections or [], c.name) or [ast.Field(n) for n in df.columns]) for f in inner if f.name == "nodes"}
            blocks = {f.out: self.flatten(f.selections or [], c.name) for f in inner if f.name == "aggregate"}
            return Compiled(shapes.group(df, g, inner, nodes, blocks), "groups")
        if (d := by.get("downsample")) is not None:
            if "interval" not in d.args or "aggregation" not in d.args:
                raise ValidationError("downsample needs interval and aggregation")
            fields = [(f.name, f.out) for f in self.flatten(d.selections or [], c.name) if f.name not in ("timestamp", "count")]
            return Compiled(timeseries.downsample(df, d.args["interval"], d.args["aggregation"], fields), "buckets")
        if (a := by.get("aggregate")) is not None:
            columns = shapes.aggregate_columns(self.flatten(a.selections or [], c.name), df.schema)
            total = df.agg(F.struct(*(x.alias(n) for n, x in columns)).alias(a.out))
            rest = [f for f in selections if f.name != "aggregate"]
            if not rest:
                return Compiled(total, "aggregate")
            out, deferred = self.project(df, c, rest, order, spec)
            return Compiled(out.crossJoin(F.broadcast(total)), "documents", deferred)  # one row
        out, deferred = self.project(df, c, selections, order, spec)
        return Compiled(out, "documents", deferred)

    def ordered(self, df: DataFrame, spec: QuerySpec, order: list[tuple[Column, bool]]) -> DataFrame:
        """The last rows come from the end, so they are turned round."""
        return df.orderBy(*self.sorts(order)) if spec.last is not None else df

    def columns(self, df: DataFrame, c: Collection, fields: list[ast.Field]) -> list[tuple[str, Column]]:
        return [(f.out, self.column(df, c, f)) for f in fields]

    def column(self, df: DataFrame, c: Collection, f: ast.Field) -> Column:
        if f.expr is not None:
            return evaluate(f.expr, c.scope(df.schema)).column
        if f.name == "_sid" and "_sid" not in df.columns:
            return c.sid(df.schema).column
        if f.name == "id" and "id" not in df.columns:
            return F.lit(None).cast("string")
        if f.name not in df.columns:
            raise ValidationError(f"{c.name} has no field {f.name}")
        column, kind = F.col(f"`{f.name}`"), df.schema[f.name].dataType
        if f.selections:
            if not isinstance(kind, T.StructType):
                raise ValidationError(f"{f.name} of {c.name} has no fields of its own")
            inner = self.flatten(f.selections, None)
            return F.when(column.isNotNull(), F.struct(*(column.getField(x.name).alias(x.out) for x in inner)))
        return column

    def project(self, df: DataFrame, c: Collection, fields: list[ast.Field], order: list[tuple[Column, bool]], spec: QuerySpec) -> tuple[DataFrame, list[str]]:
        """Selected columns: fields, expressions, lookups and rolling windows; @defer leaves a field out."""
        deferred = [f.out for f in fields if any(d.name == "defer" for d in f.directives)]
        fields = [f for f in fields if f.out not in deferred]
        if len({f.out for f in fields}) < len(fields):
            fields = list({f.out: f for f in fields}.values())
        windows = {f.out: f for f in fields if f.name == "windowFunc"}
        if windows:
            along = self.sorts(order) if order else [F.col(f"`{k}`").asc() for k in c.keys]
            bounded = spec.limit is not None or spec.last is not None
            if not bounded and (names := self.needed(c, fields, spec)) is not None:
                df = df.select(*(F.col(f"`{n}`") for n in df.columns if n in names))
            args = {f"__w_{o}": (str(f.args.get("field")), str(f.args.get("function", "avg")), int(f.args.get("windowSize", 3))) for o, f in windows.items()}
            df = timeseries.rolling(df, args, along, bounded)
        few = spec.limit is not None and spec.limit <= FEW_ROWS or spec.last is not None and spec.last <= FEW_ROWS
        outs: list[Column] = []
        for i, f in enumerate(fields):
            if f.out in windows:
                outs.append(F.col(f"`__w_{f.out}`").alias(f.out))
            elif (lookup := self.as_lookup(c, f)) is not None:
                df = self.lookup(df, c, lookup, f"__l{i}", few)
                outs.append(F.col(f"__l{i}").alias(f.out))
            else:
                outs.append(self.column(df, c, f).alias(f.out))
        return df.select(*outs), deferred

    @staticmethod
    def needed(c: Collection, fields: list[ast.Field], spec: QuerySpec) -> set[str] | None:
        """The columns that the fields and the order read; None if that can't be told."""
        names = {*c.keys, "_sid", "_score", *(n.split(".")[0] for n, _ in spec.order)}
        for f in fields:
            if f.expr is not None:
                read = roots_of(f.expr)
                if read is None:
                    return None
                names |= read
            else:
                names |= {f.name, str(f.args.get("localField")), str(f.args.get("field"))}
        return names

    # ------------------------------------------------------------ lookups

    @staticmethod
    def as_lookup(c: Collection, f: ast.Field) -> ast.Field | None:
        if f.name == "lookup":
            if missing := [a for a in ("collection", "localField", "foreignField") if a not in f.args]:
                raise ValidationError(f"lookup needs {missing[0]}")
            return f
        info = c.fields.get(f.name)
        if f.selections and info is not None and info.relation is not None:
            return replace(f, name="lookup", alias=f.out, args={**f.args, "collection": info.relation[0], "localField": f.name, "foreignField": info.relation[1]})
        return None

    def key_column(self, c: Collection, df: DataFrame, name: str) -> Column:
        if name == "_sid" and "_sid" not in df.columns:
            return c.sid(df.schema).column
        if name not in df.columns:
            raise ValidationError(f"{c.name} has no field {name}")
        return F.col(f"`{name}`")

    def lookup(self, df: DataFrame, c: Collection, f: ast.Field, out: str, few: bool) -> DataFrame:
        """df with an array of the matching rows of another collection, in order; null where the local field is null.

        The other side is filtered and projected first, then gathered by key, which
        is one shuffle and left out where the key is unique; after a small limit only
        the keys that are wanted are kept.
        """
        other = self.catalog.get(f.args["collection"])
        right = other.frame()
        if (where := f.args.get("where")) is not None:
            right = right.filter(P.compile_filter(P.from_object(where), other.scope(right.schema), other.sid(right.schema)))
        own, key, found = f"{out}_own", f"{out}_key", f"{out}_found"
        local, foreign = self.key_column(c, df, f.args["localField"]), self.key_column(other, right, f.args["foreignField"])
        left = df.withColumn(own, local)
        right = right.withColumn(key, foreign).filter(F.col(key).isNotNull())
        kinds = left.schema[own].dataType, right.schema[key].dataType
        if isinstance(kinds[0], T.StringType) != isinstance(kinds[1], T.StringType):
            left, right = left.withColumn(own, F.col(own).cast("string")), right.withColumn(key, F.col(key).cast("string"))
        if few:
            want = left.select(F.col(own).alias("__want")).distinct()
            fixed = isinstance(left.schema[own].dataType, (T.NumericType, T.DatetimeType, T.BooleanType))
            right = right.join(checked(want, FEW_ROWS, 16) if fixed else want, F.col(key) == F.col("__want"), "left_semi")
        inner = self.flatten(f.selections or [], other.name) or [ast.Field(n) for n in other.fields]
        outs: list[Column] = []
        for i, x in enumerate(inner):
            if (deeper := self.as_lookup(other, x)) is not None:
                right = self.lookup(right, other, deeper, f"{out}_{i}", False)
                outs.append(F.col(f"{out}_{i}").alias(x.out))
            elif x.name == "id" and x.expr is None and "id" not in right.columns:
                outs.append(other.sid(right.schema).column.alias(x.out))
            else:
                outs.append(self.column(right, other, x).alias(x.out))
        info = other.fields.get(f.args["foreignField"])
        if other.keys == [f.args["foreignField"]] or f.args["foreignField"] == "_sid" or (info is not None and info.unique):
            gathered = right.select(F.col(key), F.array(F.struct(*outs)).alias(found))  # a key has one row: nothing to gather
        else:
            gathered = right.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*outs))).alias(found))
        joined = left.join(gathered, F.col(own) == F.col(key), "left")
        empty = F.array().cast(gathered.schema[found].dataType)
        return joined.withColumn(out, F.when(F.col(own).isNotNull(), F.coalesce(found, empty))).drop(own, key, found)

    # ------------------------------------------------------------ connections

    def connection(self, df: DataFrame, spec: QuerySpec, c: Collection, order: list[tuple[Column, bool]]) -> DataFrame:
        """One row: edges, an array of (cursor, node), and pageInfo.  One row more than the page is read, to see whether there are more."""
        order = order or [(F.col(f"`{k}`"), False) for k in c.keys]
        size = spec.last if spec.last is not None else spec.limit
        if size is None:
            raise ValidationError("a connection is one row, so it needs first or last")
        page = self.page(df, spec, order, 1)
        page = page.withColumn("__n", F.row_number().over(Window.orderBy(*self.sorts(order, spec.last is not None))))
        selections = spec.selections or []
        nodes = [n for e in selections if e.name == "edges" for x in self.flatten(e.selections or [], c.name) if x.name == "node" for n in self.flatten(x.selections or [], c.name)]
        rows = page.withColumn("__cursor", c.sid(page.schema).column)
        plain = [(f, f"__e{i}") for i, f in enumerate(nodes)]
        for f, name in plain:
            deeper = self.as_lookup(c, f)
            rows = self.lookup(rows, c, deeper, name, size <= FEW_ROWS) if deeper is not None else rows.withColumn(name, self.column(rows, c, f))
        place = F.col("__n") if spec.last is None else -F.col("__n")
        edge = F.struct(F.col("__cursor").alias("cursor"), F.struct(*(F.col(n).alias(f.out) for f, n in plain)).alias("node") if plain else F.lit(None).alias("node"))
        inside = F.col("__n") <= size
        more = F.coalesce(F.max("__n") > size, F.lit(False))
        got = rows.agg(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct(place.alias("n"), edge.alias("edge"))))), lambda x: x["edge"]).alias("edges"), more.alias("more"))
        ends = F.when(F.size("edges") > 0, F.struct(F.element_at("edges", 1)["cursor"].alias("a"), F.element_at("edges", -1)["cursor"].alias("b")))
        backwards = spec.last is not None
        info = F.struct(
            (F.lit(spec.before is not None) if backwards else F.col("more")).alias("hasNextPage"),
            (F.col("more") if backwards else F.lit(spec.after is not None or spec.offset > 0)).alias("hasPreviousPage"),
            ends["a"].alias("startCursor"),
            ends["b"].alias("endCursor"),
        )
        outs = []
        for f in selections:
            if f.name == "edges":
                outs.append(F.col("edges").alias(f.out))
            elif f.name == "pageInfo":
                wanted = [x.name for x in self.flatten(f.selections or [], None)] or ["hasNextPage", "hasPreviousPage", "startCursor", "endCursor"]
                outs.append(F.struct(*(info.getField(w).alias(w) for w in wanted)).alias(f.out))
            else:
                raise ValidationError(f"a connection has no {f.name}")
        return got.select(*outs)
