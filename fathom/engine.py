"""The engine: texts, builders and payloads in, DataFrames and effects out."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jobs
from .errors import EngineError, ValidationError
from .functions.scalar import evaluate
from .lang import ast, bind
from .lang.parser import parse
from .operators import changes, search
from .operators import predicates as P
from .plans.compile import Compiled, Compiler
from .plans.fluent import QueryBuilder, SearchBuilder
from .plans.spec import QuerySpec, from_field, from_payload, order_of
from .sources import io
from .sources.catalog import SYSTEM_KEY, Catalog, Collection, FieldInfo, spark_type
from .sources.shared import checked, written
from .sources.store import Store
from .streaming import feed
from .streaming.handlers import Handlers


@dataclass
class Options:
    user: str | None = None
    roles: set[str] = field(default_factory=set)
    #: Check @validate rules of written rows.
    validate: bool = True


@dataclass
class Result:
    #: query, mutation, subscription, schema, migration, introspection or handler.
    kind: str
    name: str = ""
    frame: DataFrame | None = None
    affected: int = 0
    deferred: list[str] = field(default_factory=list)
    #: Of a migration: applied or skipped; of an @explain: the plan.
    status: str = ""
    parts: list[Result] = field(default_factory=list)

    def rows(self) -> list[dict[str, Any]]:
        return [] if self.frame is None else [r.asDict(recursive=True) for r in self.frame.collect()]


class Transaction:
    """Tables as they will be, and the events of that, until one commit."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self.frames: dict[str, DataFrame] = {}
        #: Of each table that changes: the files that stay, and the rows to write beside them.
        self.kept: dict[str, list[str]] = {}
        self.rows: dict[str, DataFrame | None] = {}
        self.events: list[DataFrame] = []
        self.definitions = copy.copy(engine.catalog.collections)
        self.migrations = list(engine.store.state["migrations"])
        self.dropped: set[str] = set()
        self.defined = False

    def frame(self, c: Collection) -> DataFrame:
        return self.frames[c.name] if c.name in self.frames else c.load()

    def _begin(self, name: str) -> None:
        if name not in self.kept:
            self.kept[name], self.rows[name] = list(self.engine.store.state["collections"][name]["files"]), None

    def replace(self, name: str, df: DataFrame) -> None:
        """Writes a table anew."""
        self.frames[name], self.kept[name], self.rows[name] = df, [], df

    def add(self, name: str, new: DataFrame, after: DataFrame) -> None:
        """Adds rows; no file of the table is touched."""
        self._begin(name)
        rows = self.rows[name]
        self.frames[name], self.rows[name] = after, new if rows is None else rows.unionByName(new)

    def change(self, name: str, before: DataFrame, hit: Column, change: Callable[[DataFrame], DataFrame], after: DataFrame) -> None:
        """Changes rows; only the files that hold rows that are hit are written anew."""
        self._begin(name)
        schema = before.schema
        store, rows = self.engine.store, self.rows[name]
        files = store.hit(self.kept[name], schema, hit)
        if files:
            part = store.read(files, schema)
            rows = part if rows is None else part.unionByName(rows)
        self.frames[name] = after
        self.kept[name] = [f for f in self.kept[name] if f not in set(files)]
        self.rows[name] = None if rows is None else change(rows)


class Session:
    """What can be done in a transaction."""

    def __init__(self, engine: Engine):
        self.engine, self.tx = engine, Transaction(engine)

    def execute(self, text: str, variables: dict[str, Any] | None = None, options: Options | None = None) -> list[Result]:
        """Runs the mutations of a text."""
        document = parse(text)
        out: list[Result] = []
        for o in document.operations:
            if not isinstance(o, ast.Operation) or o.kind != "mutation":
                raise ValidationError("a transaction takes mutations")
            given = bind.variables(o.variables, variables)
            known = self.engine.catalog.__contains__
            flat = lambda selections, on, given=given: bind.flatten(selections, document.fragments, given, on, known)
            for f in bind.flatten(o.selections, document.fragments, given, None, known):
                out += self.engine._mutate(self.tx, f, given, flat, options or Options())
        return out

    def insert(self, collection: str, *rows: dict[str, Any]) -> int:
        return self.engine._insert(self.tx, ast.Field("insert"), collection, list(rows), None, Options()).affected

    def frame(self, collection: str) -> DataFrame:
        """A table as it is within the transaction."""
        return self.tx.frame(self.engine._own(self.tx, collection, write=False))


class Engine:
    """Collections over tables that others keep (register) and over the engine's own, which it can change.

    path: the folder of the engine's own tables; without it, one in the shared
    folder that goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.catalog = Catalog()
        self.path = path
        self.handlers = Handlers(self)
        if path is not None:
            for name, d in self.store.state["collections"].items():
                self._restore(name, d)

    @cached_property
    def store(self) -> Store:
        """Made when first needed: queries over registered tables write nothing."""
        return Store(self.spark, self.path)

    # ------------------------------------------------------------ catalog

    def register(self, name: str, table: Any, keys: Any, **options: Any) -> Collection:
        return self.catalog.register(name, table, keys, **options)

    def register_computed_field(self, collection: str, name: str, computed: Any) -> None:
        self.catalog.get(collection).computed[name] = computed

    def _restore(self, name: str, d: dict[str, Any]) -> None:
        schema = T.StructType.fromJson(d["schema"])
        fields = {n: FieldInfo(**{**f, "relation": tuple(f["relation"]) if f["relation"] else None}) for n, f in d["fields"].items()}
        old = self.catalog.collections.get(name)
        self.catalog.collections[name] = Collection(name, fields, d["keys"], lambda: self.store.read(d["files"], schema), dict(old.computed) if old else {})

    # ------------------------------------------------------------ texts

    def execute(self, text: str, variables: dict[str, Any] | None = None, options: Options | None = None) -> Result:
        """Runs a text.  Several operations, or several roots of one, give a result with parts."""
        options = options or Options()
        document = parse(text)
        if any(isinstance(o, ast.Operation) for o in document.operations):
            bind.check_fragments(document, self.catalog.__contains__)
        results = [self._operation(o, document, variables, options) for o in document.operations]
        return results[0] if len(results) == 1 else Result("batch", parts=results, affected=sum(r.affected for r in results))

    def plan(self, text: str, variables: dict[str, Any] | None = None) -> DataFrame:
        """The DataFrame of a query with one root."""
        result = self.execute(text, variables)
        if result.frame is None:
            raise ValidationError("no query with one root")
        return result.frame

    def _operation(self, o: Any, document: ast.Document, variables: dict[str, Any] | None, options: Options) -> Result:
        if isinstance(o, ast.Operation):
            given = bind.variables(o.variables, variables)
            bind.authorize(o.directives, given, options.user, options.roles, "write" if o.kind == "mutation" else "read")
            explain = any(d.name == "explain" for d in o.directives)
            roots = bind.flatten(o.selections, document.fragments, given, None, self.catalog.__contains__)
            flat = lambda selections, on: bind.flatten(selections, document.fragments, given, on, self.catalog.__contains__)
            if o.kind == "mutation":
                return self._mutation(roots, given, flat, options)
            parts = [(self._query if o.kind == "query" else self._subscription)(f, flat, given, options, explain) for f in roots]
            return parts[0] if len(parts) == 1 else Result("batch", parts=parts)
        if isinstance(o, ast.Schema):
            tx = Transaction(self)
            for d in o.definitions:
                self._define(tx, d)
            self._commit(tx)
            return Result("schema", affected=len(o.definitions))
        if isinstance(o, ast.Migration):
            return self._migrate(o)
        if isinstance(o, ast.Introspection):
            return Result("introspection", frame=self.catalog.describe(self.spark))
        if isinstance(o, ast.Handler):
            self.handlers.define(o)
            return Result("handler", o.name)
        raise EngineError(f"unknown operation {o!r}")

    def _query(self, f: ast.Field, flat: Any, given: dict[str, Any], options: Options, explain: bool) -> Result:
        bind.authorize(f.directives, given, options.user, options.roles, "read")
        self.catalog.get(f.name)
        selections = flat(f.selections, f.name) if f.selections is not None else None
        for s in selections or []:
            bind.authorize(s.directives, given, options.user, options.roles, "read")
        got = Compiler(self.catalog, flat).compile(from_field(f, selections))
        if explain or any(d.name == "explain" for d in f.directives):
            text = got.frame._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return Result("query", f.out, self.spark.createDataFrame([(f.name, text)], "collection string, plan string"), status=text)
        return Result("query", f.out, got.frame, deferred=got.deferred)

    def _subscription(self, f: ast.Field, flat: Any, given: dict[str, Any], options: Options, explain: bool) -> Result:
        bind.authorize(f.directives, given, options.user, options.roles, "read")
        c = self.catalog.get(f.name)
        where = f.args.get("where", f.args.get("filter"))
        stream = feed.subscription(self.store.stream(), c, P.from_object(where) if where is not None else None, [(s.out, s.name) for s in flat(f.selections or [], f.name)] or None)
        return Result("subscription", f.out, stream)

    # ------------------------------------------------------------ other front ends

    def query(self, collection: str) -> QueryBuilder:
        return QueryBuilder(self, collection)

    def search(self, collection: str) -> SearchBuilder:
        return SearchBuilder(self, collection)

    def compile(self, spec: QuerySpec) -> Compiled:
        return Compiler(self.catalog).compile(spec)

    def run_payload(self, collection: str, payload: dict[str, Any] | str) -> DataFrame:
        return self.compile(from_payload(collection, json.loads(payload) if isinstance(payload, str) else payload)).frame

    def find(self, collection: str, where: dict[str, Any] | None = None) -> DataFrame:
        return self.compile(QuerySpec(collection, P.from_object(where or {}))).frame

    def find_by_id(self, collection: str, sid: str) -> DataFrame:
        return self.compile(QuerySpec(collection, P.Leaf("_sid", "eq", sid), limit=1)).frame

    def find_one(self, collection: str, where: dict[str, Any] | None = None) -> dict[str, Any] | None:
        got = self.compile(QuerySpec(collection, P.from_object(where or {}), limit=1)).frame.collect()
        return got[0].asDict(recursive=True) if got else None

    def find_by_field(self, collection: str, name: str, value: Any) -> DataFrame:
        return self.find_by_fields(collection, {name: value})

    def find_by_fields(self, collection: str, values: dict[str, Any]) -> DataFrame:
        return self.compile(QuerySpec(collection, P.And(tuple(P.Leaf(n, "eq", v) for n, v in values.items())))).frame

    def find_complex(self, collection: str, where: dict[str, Any], *, order: dict[str, str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """Rows that meet a nested filter, in an order, a page of them."""
        return self.compile(QuerySpec(collection, P.from_object(where), order=order_of(order), limit=limit, offset=offset)).frame

    def search_by_value(self, collection: str, name: str, value: Any) -> DataFrame:
        """Rows with a value in a field that create_index was called for; scans skip files and row groups by their statistics."""
        c = self.catalog.get(collection)
        if name not in c.fields or not c.fields[name].indexed:
            raise ValidationError(f"{collection} has no index on {name}")
        return self.find_by_fields(collection, {name: value})

    def put_blob(self, path: str, content: bytes) -> str:
        return io.write_blob(self.spark, path, content)

    def blobs(self, path: str) -> DataFrame:
        return io.read_blobs(self.spark, path)

    def find_in_range(self, collection: str, name: str, low: Any, high: Any) -> DataFrame:
        return self.compile(QuerySpec(collection, P.Leaf(name, "between", [low, high]))).frame

    def with_prefix(self, collection: str, prefix: str) -> DataFrame:
        """Rows whose system id begins so."""
        return self.compile(QuerySpec(collection, P.Leaf("_sid", "startsWith", prefix))).frame

    def matching(self, collection: str, pattern: str) -> DataFrame:
        """Rows whose system id is like an SQL pattern."""
        c = self.catalog.get(collection)
        df = c.frame()
        return df.filter(c.sid(df.schema).column.like(pattern))

    def rows(self, collection: str) -> Iterator[dict[str, Any]]:
        """All rows, a partition at a time."""
        return (r.asDict(recursive=True) for r in self.catalog.get(collection).frame().toLocalIterator())

    def text_index(self, collection: str, name: str) -> DataFrame:
        """(word, sid, n): how often a word occurs in a text field of a row."""
        c = self.catalog.get(collection)
        df = c.frame()
        return search.inverted_index(df, name, c.sid(df.schema).column)

    # ------------------------------------------------------------ full-text index

    def create_text_index(self, collection: str, name: str) -> None:
        """Stores the words of a text field with the rows that hold them, sorted by word, and what BM25 needs to know of all rows."""
        c = self.catalog.get(collection)
        df = c.frame()
        # Files are sorted each by itself: a search skips the pages without its words in each of them.
        files = self.store.write("_text", search.postings(df, name, c.sid(df.schema).column).sortWithinPartitions("word"))
        docs, mean = self.store.read(files, search.POSTINGS).filter(F.col("word") == search.WHOLE).agg(F.count(F.lit(1)), F.avg("length")).first()
        state = copy.deepcopy(self.store.state)
        state.setdefault("indexes", {})[f"{collection}.{name}"] = {"files": files, "docs": docs, "mean": mean, "of": self._files(collection)}
        self.store.commit(state, None)

    def _files(self, collection: str) -> list[str] | None:
        """The files of one of the engine's own tables; None for others, of whose changes nothing is known."""
        return self.store.state["collections"].get(collection, {}).get("files")

    def full_text_search(self, collection: str, name: str, query: str, *, limit: int | None = None) -> DataFrame:
        """Rows with words of the query in a text field, by BM25 over the stored index; best first.

        Only the postings of the query's words are read.  The index is made if there is
        none, and again if the collection is the engine's own and changed since.
        """
        key = f"{collection}.{name}"
        index = self.store.state.get("indexes", {}).get(key)
        if index is None or index["of"] != self._files(collection):
            self.create_text_index(collection, name)
            index = self.store.state["indexes"][key]
        c = self.catalog.get(collection)
        df = c.frame()
        scores = search.scored(self.store.read(index["files"], search.POSTINGS), query, index["docs"], index["mean"])
        if scores is None:
            return df.withColumn("_score", F.lit(0.0)).limit(0)
        out = df.withColumn("__sid", c.sid(df.schema).column).join(scores, F.col("__sid") == F.col("sid")).drop("__sid", "sid")
        out = out.orderBy(F.col("_score").desc(), *(F.col(f"`{k}`") for k in c.keys))
        return out if limit is None else out.limit(limit)

    def index_stats(self, collection: str, name: str) -> DataFrame:
        """(field, rows, keys, most): about how many values a field has, and how many rows share the most frequent one."""
        by = self.catalog.get(collection).frame().groupBy(F.col(f"`{name}`").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return by.agg(F.lit(name).alias("field"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("k").alias("keys"), F.max("n").alias("most"))

    def database_stats(self) -> DataFrame:
        """stats of every collection."""
        out = None
        for name in self.catalog.collections:
            one = self.stats(name)
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValidationError("there are no collections")
        return out

    def stats(self, collection: str) -> DataFrame:
        return self.catalog.stats(self.spark, collection)

    def prewarm(self, collection: str) -> int:
        """Caches a collection and counts it; what a lost executor held is read again."""
        return self.catalog.get(collection).frame().cache().count()

    def changes(self) -> DataFrame:
        return self.store.changes()

    # ------------------------------------------------------------ writing by calls

    @contextmanager
    def transaction(self) -> Iterator[Session]:
        """Mutations that take effect together at the end, or not at all if one fails; they see each other's rows."""
        session = Session(self)
        yield session
        self._commit(session.tx)

    def insert_into(self, collection: str, *rows: dict[str, Any]) -> int:
        with self.transaction() as t:
            return t.insert(collection, *rows)

    def create_index(self, collection: str, *names: str) -> None:
        """Rewrites one of the engine's own tables in ranges of these fields, sorted within, so that scans skip by the files' statistics."""
        tx = Transaction(self)
        c = self._own(tx, collection)
        tx.definitions[collection] = replace(c, fields={n: replace(i, indexed=i.indexed or n in names) for n, i in c.fields.items()})
        order = [F.col(f"`{n}`") for n in names]
        tx.replace(collection, tx.frame(c).repartitionByRange(*order).sortWithinPartitions(*order))
        self._commit(tx)

    def optimize(self, collection: str) -> None:
        """Rewrites one of the engine's own tables into files of an even size."""
        tx = Transaction(self)
        c = self._own(tx, collection)
        tx.replace(collection, tx.frame(c).hint("rebalance"))
        self._commit(tx)

    # ------------------------------------------------------------ mutations

    def _mutation(self, roots: list[ast.Field], given: dict[str, Any], flat: Any, options: Options) -> Result:
        """All of a mutation, or nothing of it, takes effect."""
        tx = Transaction(self)
        parts = [self._mutate(tx, f, given, flat, options) for f in roots]
        parts = [p for ps in parts for p in ps]
        self._commit(tx)
        for p in parts:
            if p.kind == "export" and p.frame is not None:
                p.kind = "mutation"
        return replace(parts[0]) if len(parts) == 1 else Result("mutation", parts=parts, affected=sum(p.affected for p in parts))

    def _mutate(self, tx: Transaction, f: ast.Field, given: dict[str, Any], flat: Any, options: Options) -> list[Result]:
        bind.authorize(f.directives, given, options.user, options.roles, "write")
        if f.name == "transaction":
            return [r for x in bind.flatten(f.selections or [], {}, given, None, lambda _: True) for r in self._mutate(tx, x, given, flat, options)]
        a = f.args
        if f.name in ("enqueueJob", "enqueueJobs"):
            many = a.get("jobs") or a.get("payloads") if f.name == "enqueueJobs" else [a]
            wanted = [j if "jobType" in j else {"jobType": a.get("jobType"), "payload": j, **{k: a[k] for k in ("priority", "maxRetries", "scheduledAt") if k in a}} for j in many or []]
            self._ensure_jobs(tx)
            return [self._insert(tx, f, jobs.COLLECTION, [jobs.row(j) for j in wanted], flat, options)]
        if "collection" not in a:
            raise ValidationError(f"{f.name} needs collection")
        name = str(a["collection"])
        where = P.from_object(a["where"]) if a.get("where") is not None else None
        data = a.get("data", a.get("set"))
        match f.name:
            case "insert" | "insertInto":
                return [self._insert(tx, f, name, [data], flat, options)]
            case "insertMany":
                return [self._insert(tx, f, name, list(data or []), flat, options)]
            case "import":
                return [self._import(tx, f, name, list(data or []), flat, options)]
            case "update":
                return [self._update(tx, f, name, where, data, flat, options)]
            case "upsert":
                return [self._upsert(tx, f, name, where, data, flat, options)]
            case "delete" | "deleteFrom":
                return [self._delete(tx, f, name, where, flat)]
            case "export":
                df = tx.frame(self._own(tx, name, write=False))
                if a.get("path"):
                    io.export(df, str(a["path"]), str(a.get("format", "JSON")))
                return [Result("export", f.out, df, affected=df.count())]
        raise ValidationError(f"unknown mutation {f.name}")

    def _own(self, tx: Transaction, name: str, write: bool = True) -> Collection:
        if name not in tx.definitions:
            self.catalog.get(name)
        c = tx.definitions[name]
        if write and name not in self.store.state["collections"] and name not in tx.frames:
            raise ValidationError(f"{name} is read-only")
        return c

    def _frame_of(self, c: Collection, rows: list[dict[str, Any]], schema: T.StructType) -> DataFrame:
        """Rows as a table of a schema: JSON text, read by Spark; what the schema lacks is an error."""
        for r in rows:
            if not isinstance(r, dict):
                raise ValidationError("data must be an object")
            if unknown := [k for k in r if k not in schema.names]:
                raise ValidationError(f"unknown field {unknown[0]} of {c.name}")
        texts = {f.name for f in schema if isinstance(f.dataType, T.StringType)}
        lines = [(json.dumps({k: json.dumps(v) if k in texts and isinstance(v, (dict, list)) else v for k, v in r.items()}),) for r in rows]
        got = self.spark.createDataFrame(lines, "j string").select(F.from_json("j", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
        if c.own_sid:
            by_id = F.col("id").cast("string") if "id" in schema.names else F.lit(None).cast("string")
            got = got.withColumn(SYSTEM_KEY, F.coalesce(F.col(SYSTEM_KEY), by_id, F.uuid()))
        return written(got.select(*schema.names))

    def _record(self, tx: Transaction, c: Collection, kind: str, old: DataFrame | None, new: DataFrame | None) -> None:
        some = new if new is not None else old
        assert some is not None
        fields = [n for n in some.columns if n != SYSTEM_KEY]
        tx.events.append(changes.events(c.name, kind, old, new, c.sid(some.schema).column, fields))

    def _returned(self, c: Collection, f: ast.Field, rows: DataFrame, flat: Any) -> Result:
        n = rows.count()
        if f.selections:
            compiler = Compiler(self.catalog, flat)
            rows, _ = compiler.project(rows, c, flat(f.selections, c.name), [], QuerySpec(c.name, limit=n))
        return Result("mutation", f.out, rows, affected=n)

    def _insert(self, tx: Transaction, f: ast.Field, name: str, rows: list, flat: Any, options: Options) -> Result:
        c = self._own(tx, name)
        before = tx.frame(c)
        new = self._frame_of(c, rows, before.schema)
        after = before.unionByName(new)
        changes.check(self.catalog, c, before, new, after, tx.frames, options.validate)
        self._same_keys(c, after, new)
        tx.add(name, new, after)
        self._record(tx, c, "Insert", None, new)
        return self._returned(c, f, new, flat)

    def _same_keys(self, c: Collection, after: DataFrame, new: DataFrame) -> None:
        twice = after.join(new.select(*c.keys).distinct(), c.keys, "left_semi").groupBy(*c.keys).count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValidationError(f"unique constraint violation: {c.name} has {twice[0][0]!r} already")

    def _import(self, tx: Transaction, f: ast.Field, name: str, rows: list, flat: Any, options: Options) -> Result:
        c = self._own(tx, name)
        before = tx.frame(c)
        new = self._frame_of(c, rows, before.schema)
        fresh, skipped = changes.importable(new, before, c)
        fresh = written(fresh)
        changes.check(self.catalog, c, before, fresh, before.unionByName(fresh), tx.frames, options.validate)
        tx.add(name, fresh, before.unionByName(fresh))
        self._record(tx, c, "Insert", None, fresh)
        out = self._returned(c, f, fresh, flat)
        out.status = f"{skipped.count()} skipped"
        return out

    def import_json(self, name: str, path: str, *, multi_line: bool = False) -> dict[str, int]:
        """Imports a file; {imported, skipped, failed}."""
        tx = Transaction(self)
        c = self._own(tx, name)
        before = tx.frame(c)
        good, bad = io.read_json(self.spark, path, before.schema, multi_line=multi_line)
        if c.own_sid:
            by_id = F.col("id").cast("string") if "id" in before.columns else F.lit(None).cast("string")
            good = good.withColumn(SYSTEM_KEY, F.coalesce(F.col(SYSTEM_KEY), by_id, F.uuid())).select(*before.columns)
        rows = written(good)
        fresh, skipped = changes.importable(rows, before, c)
        fresh = written(fresh)
        tx.add(name, fresh, before.unionByName(fresh))
        self._record(tx, c, "Insert", None, fresh)
        out = {"imported": fresh.count(), "skipped": skipped.count(), "failed": bad.count()}
        self._commit(tx)
        return out

    def _hit(self, c: Collection, df: DataFrame, where: Any) -> Column:
        return F.lit(True) if where is None else F.coalesce(P.compile_filter(where, c.scope(df.schema), c.sid(df.schema)), F.lit(False))

    def _update(self, tx: Transaction, f: ast.Field, name: str, where: Any, data: Any, flat: Any, options: Options) -> Result:
        if not isinstance(data, dict) or not data:
            raise ValidationError("update needs data")
        c = self._own(tx, name)
        before = tx.frame(c)
        hit = self._hit(c, before, where)
        old = before.filter(hit)
        # Only the rows that change are written here, and the files that hold them at the commit.
        new = written(changes.updated(old, F.lit(True), data))
        after = changes.updated(before, hit, data)
        changes.check(self.catalog, c, before, new, after, tx.frames, options.validate)
        tx.change(name, before, hit, lambda df: changes.updated(df, hit, data), after)
        self._record(tx, c, "Update", old, new)
        return self._returned(c, f, new, flat)

    def _upsert(self, tx: Transaction, f: ast.Field, name: str, where: Any, data: Any, flat: Any, options: Options) -> Result:
        """Updates the matching row with the least id, or inserts."""
        c = self._own(tx, name)
        before = tx.frame(c)
        sid = c.sid(before.schema)
        first = before.filter(self._hit(c, before, where)).agg(F.min(sid.column)).first()[0] if where is not None else None
        if first is None:
            return self._insert(tx, f, name, [data], flat, options)
        return self._update(tx, f, name, P.Leaf("_sid", "eq", first), data, flat, options)

    def _delete(self, tx: Transaction, f: ast.Field, name: str, where: Any, flat: Any) -> Result:
        c = self._own(tx, name)
        hit = self._hit(c, tx.frame(c), where)
        return self._returned(c, f, self._remove(tx, c, hit), flat)

    def _remove(self, tx: Transaction, c: Collection, hit: Column) -> DataFrame:
        """Removes the rows that are hit, and gives them."""
        name, before = c.name, tx.frame(c)
        gone = written(before.filter(hit))
        tx.change(name, before, hit, lambda df: df.filter(~hit), before.filter(~hit))
        self._record(tx, c, "Delete", gone, None)
        return gone

    def assign(self, collection: str, rows: list[dict[str, Any]]) -> None:
        """Sets fields of rows, each by its _sid, in one commit; all rows give the same fields."""
        if not rows:
            return
        tx = Transaction(self)
        c = self._own(tx, collection)
        before = tx.frame(c)
        names = [n for n in rows[0] if n != SYSTEM_KEY]
        values = self._frame_of(c, rows, T.StructType([before.schema[n] for n in rows[0]]))
        values = values.select(F.col(SYSTEM_KEY).alias("__k"), F.struct(*names).alias("__v"))

        def change(df: DataFrame) -> DataFrame:
            both = df.join(checked(values, len(rows), 4096), F.col(SYSTEM_KEY) == F.col("__k"), "left")
            return both.withColumns({n: F.when(F.col("__k").isNotNull(), F.col("__v").getField(n)).otherwise(F.col(n)) for n in names}).select(*df.columns)

        hit = F.col(SYSTEM_KEY).isin([r[SYSTEM_KEY] for r in rows])
        old = before.filter(hit)
        new = written(change(old))
        tx.change(collection, before, hit, change, change(before))
        self._record(tx, c, "Update", old, new)
        self._commit(tx)

    def delete_where(self, collection: str, hit: Column) -> int:
        """Deletes the rows of one of the engine's own tables that meet a condition on its columns."""
        tx = Transaction(self)
        gone = self._remove(tx, self._own(tx, collection), F.coalesce(hit, F.lit(False))).count()
        self._commit(tx)
        return gone

    def _commit(self, tx: Transaction) -> None:
        """Writes the rows that are new or whose files changed, then one manifest."""
        state = copy.deepcopy(self.store.state)
        for name in tx.dropped:
            state["collections"].pop(name, None)
        for name, df in tx.frames.items():
            c = tx.definitions[name]
            schema = df.schema
            for s in schema.fields:
                s.nullable = True
            rows = tx.rows[name]
            files = tx.kept[name] + (self.store.write(name, rows) if rows is not None else [])
            state["collections"][name] = {"files": files, "schema": schema.jsonValue(), "keys": c.keys, "fields": {n: vars(i) for n, i in c.fields.items()}}
        state["migrations"] = tx.migrations
        if not tx.frames and not tx.dropped and tx.migrations == self.store.state["migrations"]:
            return
        told = None
        if tx.events:
            for i, e in enumerate(tx.events):
                e = e.withColumn("seq", F.lit(i).cast("long"))
                told = e if told is None else told.unionByName(e)
            at = (self.store.version + 1) << 32
            told = told.select((F.lit(at) + F.col("seq")).alias("seq"), F.current_timestamp().alias("ts"), "collection", "change_type", "sid", "document", "old_document", "changed_fields")
        self.store.commit(state, told)
        for name in tx.dropped:
            self.catalog.collections.pop(name, None)
        for name in tx.frames:
            self._restore(name, self.store.state["collections"][name])

    # ------------------------------------------------------------ schema

    def new_collection(self, name: str, fields: dict[str, str], *, unique: tuple[str, ...] = ()) -> None:
        tx = Transaction(self)
        self._define(tx, ast.Define(name, [ast.FieldDef(n, t.rstrip("!"), t.endswith("!"), [ast.Directive("unique", {})] if n in unique else []) for n, t in fields.items()]))
        self._commit(tx)

    def _ensure_jobs(self, tx: Transaction) -> None:
        if jobs.COLLECTION not in tx.definitions:
            self._define(tx, ast.Define(jobs.COLLECTION, [ast.FieldDef(n, t) for n, t in jobs.FIELDS.items()]))

    @staticmethod
    def _info(f: ast.FieldDef) -> FieldInfo:
        info = FieldInfo(f.name, f.type, f.required)
        for d in f.directives:
            if d.name in ("unique", "primary"):
                info.unique = True
            if d.name in ("indexed", "index", "primary"):
                info.indexed = True
            if d.name == "relation":
                info.relation = (str(d.args.get("to") or d.args.get("collection")), str(d.args.get("key", "id")))
            if d.name == "validate":
                info.validations = dict(d.args)
        return info

    def _define(self, tx: Transaction, d: Any) -> None:
        if isinstance(d, ast.Define):
            if d.collection in tx.definitions:
                if d.if_not_exists:
                    return
                raise ValidationError(f"{d.collection} exists")
            infos = {f.name: self._info(f) for f in d.fields}
            schema = T.StructType([T.StructField(SYSTEM_KEY, T.StringType()), *(T.StructField(n, spark_type(i.type)) for n, i in infos.items() if n != SYSTEM_KEY)])
            c = Collection(d.collection, infos, [SYSTEM_KEY], lambda: self.spark.createDataFrame([], schema))
            tx.definitions[d.collection] = c
            tx.replace(d.collection, self.spark.createDataFrame([], schema))
        elif isinstance(d, ast.Drop):
            if d.collection not in tx.definitions:
                if d.if_exists:
                    return
                raise ValidationError(f"no collection {d.collection}")
            del tx.definitions[d.collection]
            for held in (tx.frames, tx.kept, tx.rows):
                held.pop(d.collection, None)
            tx.dropped.add(d.collection)
        else:
            self._alter(tx, d)

    def _alter(self, tx: Transaction, d: ast.Alter) -> None:
        c = self._own(tx, d.collection)
        df = tx.frame(c)
        c = replace(c, fields=dict(c.fields))
        for action in d.actions:
            if action[0] == "add":
                f = action[1]
                if f.name in c.fields:
                    raise ValidationError(f"{c.name} has {f.name} already")
                c.fields[f.name] = self._info(f)
                kind = spark_type(f.type)
                df = df.withColumn(f.name, changes.cast_value(f.default, kind) if f.has_default else F.lit(None).cast(kind))
            elif action[0] == "drop":
                if c.fields.pop(action[1], None) is None:
                    raise ValidationError(f"{c.name} has no field {action[1]}")
                df = df.drop(action[1])
            elif action[0] == "rename":
                if action[1] not in c.fields or action[2] in c.fields:
                    raise ValidationError(f"{c.name} can't rename {action[1]} to {action[2]}")
                c.fields = {action[2] if n == action[1] else n: replace(i, name=action[2]) if n == action[1] else i for n, i in c.fields.items()}
                df = df.withColumnRenamed(action[1], action[2])
            else:
                f = action[1]
                if f.name not in c.fields:
                    raise ValidationError(f"{c.name} has no field {f.name}")
                c.fields[f.name] = self._info(f)
                df = df.withColumn(f.name, F.col(f"`{f.name}`").try_cast(spark_type(f.type)))
        tx.definitions[c.name] = c
        tx.replace(c.name, df)

    def _migrate(self, o: ast.Migration) -> Result:
        """Applies the versions that weren't applied before, each once, all in one commit."""
        tx = Transaction(self)
        applied = 0
        for version, actions in o.steps:
            if version in tx.migrations:
                continue
            for a in actions:
                if isinstance(a, ast.DataMigration):
                    self._migrate_data(tx, a)
                else:
                    self._define(tx, a)
            tx.migrations.append(version)
            applied += 1
        self._commit(tx)
        return Result("migration", o.steps[-1][0] if o.steps else "", affected=applied, status="applied" if applied else "skipped")

    def _migrate_data(self, tx: Transaction, a: ast.DataMigration) -> None:
        """All transforms of a block see the rows as they were before it."""
        c = self._own(tx, a.collection)
        df = tx.frame(c)
        scope = c.scope(df.schema)
        outs: dict[str, Column] = {}
        for target, expr, where in a.sets:
            if target not in df.columns:
                raise ValidationError(f"{c.name} has no field {target}")
            new = evaluate(expr, scope).column.try_cast(df.schema[target].dataType)
            hit = self._hit(c, df, P.from_object(where) if where is not None else None)
            outs[target] = F.when(hit, new).otherwise(outs.get(target, F.col(f"`{target}`")))
        tx.replace(c.name, df.withColumns(outs))
