"""The engine's queries over the test tables, and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import computed
from ..operators import search

#: Keys and relations of the test tables.  lineitem has no key: all its columns stand in for one.
_KEYS: dict[str, list[str]] = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}
_RELATIONS: dict[str, dict[str, tuple[str, str]]] = {
    "nation": {"n_regionkey": ("region", "r_regionkey")},
    "customer": {"c_nationkey": ("nation", "n_nationkey")},
    "supplier": {"s_nationkey": ("nation", "n_nationkey")},
    "orders": {"o_custkey": ("customer", "c_custkey")},
    "lineitem": {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")},
    "labels": {"doc_id": ("documents", "doc_id")},
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """An engine with the test tables as collections.  Derived: part.tags, the words of its name; events.props as an object; orders.priority and nation.zone, null where they are the first."""
    e = Engine(spark)
    for name in names or _KEYS:
        def load(name: str = name) -> DataFrame:
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            if name == "part":
                return df.withColumn("tags", F.split("p_name", " "))
            if name == "events":
                return df.withColumn("props", F.from_json("props", "k long"))
            if name == "nation":
                return df.withColumn("zone", F.nullif("n_regionkey", F.lit(0)))
            return df.withColumn("priority", F.nullif("o_orderpriority", F.lit("1-URGENT"))) if name == "orders" else df

        e.register(name, load, _KEYS[name], relations=_RELATIONS.get(name))
    return e


def _text(name: str, text: str, sql: str | None, then: Callable[[DataFrame], DataFrame] | None = None, variables: dict[str, Any] | None = None, *, on: tuple[str, ...]) -> None:
    """A query that is a text; `then` makes its result flat."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir, *on).plan(text, variables)
        return then(df) if then else df

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _code(name: str, sql: str | None, *on: str) -> Callable:
    def add(f: Callable[[Engine], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(engine(spark, sf_dir, *on))
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- scans, projection, filters

_text("scan_project", "query { nation { n_nationkey n_name } }", "SELECT n_nationkey, n_name FROM nation", on=("nation",))
_text("alias", "query { nation { key: n_nationkey label: n_name } }", "SELECT n_nationkey AS key, n_name AS label FROM nation", on=("nation",))
_text("system_id", 'query { nation(where: {_sid: {in: ["3", "5"]}}) { _sid n_name } }', "SELECT n_nationkey::VARCHAR AS _sid, n_name FROM nation WHERE n_nationkey IN (3, 5)", on=("nation",))


def _where(name: str, collection: str, where: str, fields: str, sql: str) -> None:
    _text(name, f"query {{ {collection}(where: {where}) {{ {fields} }} }}", f"SELECT {', '.join(fields.split())} FROM {collection} WHERE {sql}", on=(collection,))


_where("filter_eq", "orders", '{o_orderstatus: {eq: "F"}}', "o_orderkey o_totalprice", "o_orderstatus = 'F'")
_where("filter_ne", "orders", '{o_orderstatus: {ne: "F"}}', "o_orderkey o_orderstatus", "o_orderstatus <> 'F'")
_where("filter_gt", "lineitem", "{l_quantity: {gt: 45}}", "l_orderkey l_quantity", "l_quantity > 45")
_where("filter_gte", "lineitem", "{l_discount: {gte: 0.09}}", "l_orderkey l_discount", "l_discount >= 0.09")
_where("filter_lt", "lineitem", "{l_extendedprice: {lt: 2000.0}}", "l_orderkey l_extendedprice", "l_extendedprice < 2000.0")
_where("filter_lte", "lineitem", '{l_shipdate: {lte: "1993-01-01"}}', "l_orderkey l_shipdate", "l_shipdate <= TIMESTAMP '1993-01-01'")
_where("filter_in", "orders", '{o_orderpriority: {in: ["1-URGENT", "2-HIGH"]}}', "o_orderkey o_orderpriority", "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_where("filter_nin", "orders", '{o_orderpriority: {nin: ["1-URGENT", "2-HIGH"]}}', "o_orderkey o_orderpriority", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
_where("filter_contains_string", "part", '{p_name: {contains: "ring"}}', "p_partkey p_name", "contains(p_name, 'ring')")
_where("filter_starts_with", "part", '{p_name: {startsWith: "small"}}', "p_partkey p_name", "p_name LIKE 'small%'")
_where("filter_ends_with", "part", '{p_name: {endsWith: "ring"}}', "p_partkey p_name", "p_name LIKE '%ring'")
_where("filter_matches", "part", '{p_brand: {matches: "#[12]\\\\d$"}}', "p_partkey p_brand", r"regexp_matches(p_brand, '#[12]\d$')")
_where("filter_contains_array", "part", '{tags: {contains: "small"}}', "p_partkey p_name", "list_contains(string_split(p_name, ' '), 'small')")
_where("filter_contains_any", "part", '{tags: {containsAny: ["small", "ring"]}}', "p_partkey p_name", "list_has_any(string_split(p_name, ' '), ['small', 'ring'])")
_where("filter_contains_all", "part", '{tags: {containsAll: ["small", "ring"]}}', "p_partkey p_name", "list_has_all(string_split(p_name, ' '), ['small', 'ring'])")
_where("filter_is_null", "orders", "{priority: {isNull: true}}", "o_orderkey", "nullif(o_orderpriority, '1-URGENT') IS NULL")
_where("filter_is_not_null", "orders", "{priority: {isNotNull: true}}", "o_orderkey", "nullif(o_orderpriority, '1-URGENT') IS NOT NULL")
_where("filter_and_or_not", "orders", '{and: [{or: [{o_orderstatus: {eq: "F"}}, {o_orderstatus: {eq: "P"}}]}, {not: {o_totalprice: {lt: 200000}}}]}', "o_orderkey o_totalprice", "o_orderstatus IN ('F', 'P') AND NOT o_totalprice < 200000")
_where("filter_not_on_null", "orders", '{not: {priority: {eq: "2-HIGH"}}}', "o_orderkey", "coalesce(nullif(o_orderpriority, '1-URGENT') <> '2-HIGH', true)")
_where("filter_ne_on_null", "orders", '{priority: {ne: "2-HIGH"}}', "o_orderkey", "nullif(o_orderpriority, '1-URGENT') IS DISTINCT FROM '2-HIGH'")
_where("filter_nin_on_null", "orders", '{priority: {nin: ["2-HIGH", null]}}', "o_orderkey", "coalesce(nullif(o_orderpriority, '1-URGENT'), '2-HIGH') <> '2-HIGH'")
_where("filter_multi_op_field", "orders", "{o_totalprice: {gt: 100000, lt: 200000}}", "o_orderkey o_totalprice", "o_totalprice > 100000 AND o_totalprice < 200000")
_where("filter_siblings", "orders", '{o_orderstatus: {eq: "O"}, o_totalprice: {gte: 300000}, not: {o_orderpriority: {eq: "1-URGENT"}}}', "o_orderkey", "o_orderstatus = 'O' AND o_totalprice >= 300000 AND o_orderpriority <> '1-URGENT'")
_where("validate_filter", "part", '{}, validate: {p_size: {min: 10, max: 20}, p_brand: {pattern: "#1"}, p_type: {maxLength: 8}}', "p_partkey p_size", "p_size BETWEEN 10 AND 20 AND contains(p_brand, '#1') AND strlen(p_type) <= 8")
_where("validate_url", "pages", '{}, validate: {url: {format: "url", minLength: 30}}', "page_id url", "(url LIKE 'http://%' OR url LIKE 'https://%') AND strlen(url) >= 30")
_text("filter_nested_path", 'query { events(where: {"props.k": {gt: 50}}) { event_id k: props.k } }', "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k')::BIGINT > 50", on=("events",))
_text("nested_selection", "query { events { event_id props { j: k } } }", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS j FROM events", lambda df: df.select("event_id", "props.j"), on=("events",))


@_code("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000", "orders")
def _(e: Engine) -> DataFrame:
    return e.query("orders").filter(lambda f: f.between("o_totalprice", 1000, 50000)).select("o_orderkey", "o_totalprice").frame()


@_code("prefix_scan", "SELECT o_orderkey FROM orders WHERE o_orderkey::VARCHAR LIKE '12%'", "orders")
def _(e: Engine) -> DataFrame:
    return e.with_prefix("orders", "12").select("o_orderkey")


@_code("find_by_fields", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'", "orders")
def _(e: Engine) -> DataFrame:
    return e.find_by_fields("orders", {"o_orderstatus": "F", "o_orderpriority": "2-HIGH"}).select("o_orderkey")


@_code("find_in_range", "SELECT event_id FROM events WHERE value BETWEEN 10 AND 20", "events")
def _(e: Engine) -> DataFrame:
    return e.find_in_range("events", "value", 10, 20).select("event_id")


@_code("pattern_scan", "SELECT c_custkey FROM customer WHERE c_custkey::VARCHAR LIKE '1_'", "customer")
def _(e: Engine) -> DataFrame:
    return e.matching("customer", "1_").select("c_custkey")


@_code("index_stats", "SELECT 'o_custkey' AS field, sum(n)::BIGINT AS rows, count(*) AS keys, max(n) AS most FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)", "orders")
def _(e: Engine) -> DataFrame:
    return e.index_stats("orders", "o_custkey")


@_code("point_get", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77", "orders")
def _(e: Engine) -> DataFrame:
    return e.find_by_id("orders", "77").select("o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- order and pages

_text("topk", 'query { orders(where: {o_orderstatus: {eq: "F"}, o_totalprice: {gt: 100000.0}}, orderBy: {field: "o_totalprice", direction: DESC}, limit: 20) { o_orderkey o_totalprice } }', "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000.0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", on=("orders",))
_text("order_multi", 'query { orders(orderBy: [{field: "o_orderstatus", direction: ASC}, {field: "o_totalprice", direction: DESC}], limit: 50) { o_orderkey o_orderstatus o_totalprice } }', "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 50", on=("orders",))
_text("order_nulls", "query { orders(orderBy: {priority: ASC, o_orderkey: DESC}, limit: 40) { o_orderkey priority } }", "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS priority FROM orders ORDER BY priority NULLS FIRST, o_orderkey DESC LIMIT 40", on=("orders",))
_text("offset_page", "query { orders(orderBy: {o_totalprice: ASC}, offset: 100, limit: 25) { o_orderkey o_totalprice } }", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 100", on=("orders",))
_CURSOR = "(SELECT o_totalprice FROM orders WHERE o_orderkey = 50)"
_text("cursor_after", 'query { orders(orderBy: {o_totalprice: ASC}, after: "50", first: 25) { o_orderkey o_totalprice } }', f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > {_CURSOR} OR (o_totalprice = {_CURSOR} AND o_orderkey > 50) ORDER BY o_totalprice, o_orderkey LIMIT 25", on=("orders",))
_text("cursor_before", 'query { orders(orderBy: {o_totalprice: ASC}, before: "50", last: 25) { o_orderkey o_totalprice } }', f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < {_CURSOR} OR (o_totalprice = {_CURSOR} AND o_orderkey < 50) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25", on=("orders",))
_text("connection_page", "query { orders(orderBy: {o_totalprice: DESC}, first: 10) { edges { cursor node { o_orderkey o_totalprice } } pageInfo { hasNextPage endCursor } } }", "SELECT (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1)::INTEGER AS pos, o_orderkey::VARCHAR AS cursor, o_orderkey, o_totalprice, true AS has_next FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", lambda df: df.select(F.posexplode("edges").alias("pos", "e"), F.col("pageInfo.hasNextPage").alias("has_next")).select("pos", "e.cursor", "e.node.o_orderkey", "e.node.o_totalprice", "has_next"), on=("orders",))

# ---------------------------------------------------------------- aggregates and groups

_flat = lambda df: df.select("aggregate.*")
_round = lambda *names: lambda df: df.withColumns({n: F.round(n, 2 if n == "s" else 6) for n in names})
_text("agg_count", "query { lineitem { aggregate { count } } }", "SELECT count(*) AS count FROM lineitem", _flat, on=("lineitem",))
_text("agg_all", 'query { lineitem { aggregate { n: count s: sum(field: "l_extendedprice") a: avg(field: "l_quantity") lo: min(field: "l_discount") hi: max(field: "l_tax") } } }', "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s, round(avg(l_quantity), 6) AS a, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem", lambda df: _round("s", "a")(_flat(df)), on=("lineitem",))
_text("agg_fields", 'query { lineitem { aggregate { m: max(fields: ["l_quantity", "l_tax"]) } } }', "SELECT max(l_quantity) AS l_quantity, max(l_tax) AS l_tax FROM lineitem", lambda df: df.select("aggregate.m.*"), on=("lineitem",))
_text("agg_filtered", 'query { orders(where: {o_orderstatus: {eq: "F"}}) { aggregate { count s: sum(field: "o_totalprice") } } }', "SELECT count(*) AS count, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderstatus = 'F'", lambda df: _round("s")(_flat(df)), on=("orders",))
_text("agg_empty", 'query { orders(where: {o_orderstatus: {eq: "none"}}) { aggregate { count s: sum(field: "o_totalprice") a: avg(field: "o_totalprice") } } }', "SELECT count(*) AS count, coalesce(sum(o_totalprice), 0.0)::DOUBLE AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'none'", _flat, on=("orders",))
_text("agg_after_limit", 'query { orders(orderBy: {o_totalprice: DESC}, limit: 10) { aggregate { count s: sum(field: "o_totalprice") } } }', "SELECT count(*) AS count, round(sum(o_totalprice), 2) AS s FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)", lambda df: _round("s")(_flat(df)), on=("orders",))
_text("agg_broadcast", 'query { orders(where: {o_orderstatus: {eq: "P"}}) { o_orderkey aggregate { count } } }', "SELECT o_orderkey, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'P'", lambda df: df.select("o_orderkey", F.col("aggregate.count").alias("n")), on=("orders",))
_text("agg_dates", 'query { orders { aggregate { a: min(field: "o_orderdate") b: max(field: "o_orderdate") } } }', "SELECT min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders", _flat, on=("orders",))
_text("groupby_single", 'query { lineitem { groupBy(field: "l_returnflag") { key count aggregate { s: sum(field: "l_quantity") a: avg(field: "l_extendedprice") } } } }', "SELECT l_returnflag AS key, count(*) AS count, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 6) AS a FROM lineitem GROUP BY l_returnflag", lambda df: _round("s", "a")(df.select("key", "count", "aggregate.*")), on=("lineitem",))
_text("groupby_multi", 'query { lineitem { groupBy(fields: ["l_returnflag", "l_linestatus"]) { keys count aggregate { s: sum(field: "l_extendedprice") } } } }', "SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY ALL", lambda df: _round("s")(df.select("keys.*", "count", "aggregate.*")), on=("lineitem",))
_text("groupby_null_key", 'query { orders { groupBy(field: "priority") { key count } } }', "SELECT coalesce(nullif(o_orderpriority, '1-URGENT'), 'null') AS key, count(*) AS count FROM orders GROUP BY 1", on=("orders",))
_text("groupby_interval", 'query { events { groupBy(field: "ts", interval: "6h") { timestamp count aggregate { m: max(field: "value") } } } }', "SELECT to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMP AS timestamp, count(*) AS count, max(value) AS m FROM (SELECT ts AT TIME ZONE 'UTC' AS ts, value FROM events) GROUP BY 1".replace("to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMP", "make_timestamp((floor(epoch(ts) / 21600) * 21600 * 1000000)::BIGINT)"), lambda df: df.select("timestamp", "count", "aggregate.*"), on=("events",))
_text("groupby_nodes", 'query { nation { groupBy(field: "n_regionkey") { key nodes { n_name } } } }', "SELECT n_regionkey::VARCHAR AS key, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1", lambda df: df.select("key", F.array_join("nodes.n_name", ",").alias("names")), on=("nation",))
_text("groupby_filtered", 'query { orders(where: {o_totalprice: {gt: 300000}}) { groupBy(field: "o_orderpriority") { key count } } }', "SELECT o_orderpriority AS key, count(*) AS count FROM orders WHERE o_totalprice > 300000 GROUP BY 1", on=("orders",))

# ---------------------------------------------------------------- lookups

_text("lookup_basic", 'query { orders { o_orderkey c: lookup(collection: "customer", localField: "o_custkey", foreignField: "c_custkey") { c_name } } }', "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey", lambda df: df.select("o_orderkey", F.explode_outer("c").alias("c")).select("o_orderkey", "c.c_name"), on=("orders", "customer"))
_text("lookup_where", 'query q($seg: String!) { orders { o_orderkey c: lookup(collection: "customer", localField: "o_custkey", foreignField: "c_custkey", where: {c_mktsegment: {eq: $seg}}) { c_name } } }', "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'", lambda df: df.select("o_orderkey", F.explode_outer("c").alias("c")).select("o_orderkey", "c.c_name"), {"seg": "BUILDING"}, on=("orders", "customer"))
_text("lookup_many", 'query { customer { c_custkey os: lookup(collection: "orders", localField: "c_custkey", foreignField: "o_custkey") { o_orderkey } } }', "SELECT c_custkey, count(o_orderkey)::INTEGER AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1", lambda df: df.select("c_custkey", F.size("os").alias("n"), F.nullif(F.array_join(F.transform("os.o_orderkey", lambda x: x.cast("string")), ","), F.lit("")).alias("keys")), on=("customer", "orders"))
_text("lookup_nested", 'query { orders { o_orderkey c: lookup(collection: "customer", localField: "o_custkey", foreignField: "c_custkey") { c_name n: lookup(collection: "nation", localField: "c_nationkey", foreignField: "n_nationkey") { n_name } } } }', "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", lambda df: df.select("o_orderkey", F.explode_outer("c").alias("c")).select("o_orderkey", "c.c_name", F.explode_outer("c.n").alias("n")).select("o_orderkey", "c_name", "n.n_name"), on=("orders", "customer", "nation"))
_text("lookup_after_topk", 'query { orders(orderBy: {o_totalprice: DESC}, limit: 100) { o_orderkey c: lookup(collection: "customer", localField: "o_custkey", foreignField: "c_custkey") { c_name n: lookup(collection: "nation", localField: "c_nationkey", foreignField: "n_nationkey") { n_name } } } }', "SELECT o_orderkey, c_name, n_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", lambda df: df.select("o_orderkey", F.explode_outer("c").alias("c")).select("o_orderkey", "c.c_name", F.explode_outer("c.n").alias("n")).select("o_orderkey", "c_name", "n.n_name"), on=("orders", "customer", "nation"))
_text("relation_auto", "query { nation { n_name n_regionkey { r_name } } }", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", lambda df: df.select("n_name", F.explode_outer("n_regionkey").alias("r")).select("n_name", "r.r_name"), on=("nation", "region"))
_text("lookup_missing", 'query { documents { doc_id l: lookup(collection: "labels", localField: "doc_id", foreignField: "doc_id") { quality } } }', "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", lambda df: df.select("doc_id", F.explode_outer("l").alias("l")).select("doc_id", "l.quality"), on=("documents", "labels"))
_text("lookup_null_key", 'query { nation { n_name r: lookup(collection: "region", localField: "zone", foreignField: "r_regionkey") { r_name } } }', "SELECT n_name, CASE WHEN n_regionkey = 0 THEN NULL ELSE 1 END::INTEGER AS n, r_name FROM nation LEFT JOIN region ON r_regionkey = nullif(n_regionkey, 0)", lambda df: df.select("n_name", F.when(F.col("r").isNotNull(), F.size("r")).alias("n"), F.get("r.r_name", 0).alias("r_name")), on=("nation", "region"))

# ---------------------------------------------------------------- windows

for _f in ("Avg", "Sum", "Min", "Max"):
    _text(f"rolling_{_f.lower()}", f'query {{ events(orderBy: {{ts: ASC}}) {{ event_id r: windowFunc(field: "value", function: "rolling{_f}", windowSize: 3) }} }}', f"SELECT event_id, round({_f}(value) OVER (ORDER BY ts, event_id ROWS 2 PRECEDING), 6) AS r FROM events", _round("r"), on=("events",))
for _f in ("avg", "sum", "min", "max", "count"):
    _text(f"downsample_{_f}", f'query {{ events {{ downsample(interval: "1h", aggregation: "{_f}") {{ value }} }} }}', f"SELECT make_timestamp((floor(epoch(ts) / 3600) * 3600 * 1000000)::BIGINT) AS timestamp, count(*) AS count, round({_f}(value)::DOUBLE, 6) AS value FROM events GROUP BY 1", _round("value"), on=("events",))
_text("rolling_limited", 'query { events(orderBy: {ts: DESC}, limit: 100) { event_id r: windowFunc(field: "value", function: "sum", windowSize: 5) } }', "SELECT event_id, round(sum(value) OVER (ORDER BY ts DESC, event_id ROWS 4 PRECEDING), 6) AS r FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 100)", _round("r"), on=("events",))

# ---------------------------------------------------------------- functions


def _fn(name: str, collection: str, key: str, exprs: dict[str, tuple[str, str]], rounded: tuple[str, ...] = ()) -> None:
    fields = " ".join(f"{n}: {e}" for n, (e, _) in exprs.items())
    sql = ", ".join(f"{'round(' if n in rounded else ''}{s}{', 6)' if n in rounded else ''} AS {n}" for n, (_, s) in exprs.items())
    _text(name, f"query {{ {collection} {{ {key} {fields} }} }}", f"SELECT {key}, {sql} FROM {collection}", (lambda df: df.withColumns({n: F.round(n, 6) for n in rounded})) if rounded else None, on=(collection,))


_fn("fn_string", "part", "p_partkey", {"a": ('concat(p_brand, "/", p_type)', "concat(p_brand, '/', p_type)"), "b": ("uppercase(p_name)", "upper(p_name)"), "c": ("lowercase(p_type)", "lower(p_type)"), "d": ("substring(p_name, 2, 3)", "substr(p_name, 3, 3)"), "e": ('replace(p_brand, "Brand", "B")', "replace(p_brand, 'Brand', 'B')"), "f": ("length(p_name)", "length(p_name)"), "g": ('trim(concat("  ", p_name, " "))', "p_name"), "h": ('format("%s-%d", p_brand, p_size)', "concat(p_brand, '-', p_size)"), "i": ("truncate(p_name, 4)", "left(p_name, 4)")})
_fn("fn_math", "part", "p_partkey", {"a": ("p_size + 1 * 2", "p_size::BIGINT + 2"), "b": ("p_retailprice / 7", "p_retailprice / 7"), "c": ("p_size / 7", "p_size::BIGINT // 7"), "d": ("p_size % 7", "p_size::BIGINT % 7"), "e": ("round(p_retailprice, 1)", "round(p_retailprice, 1)"), "f": ("floor(p_retailprice)", "floor(p_retailprice)::BIGINT"), "g": ("ceil(p_retailprice)", "ceil(p_retailprice)::BIGINT"), "h": ("min(p_size, 20)", "least(p_size::BIGINT, 20)"), "i": ("max(p_size, 20)", "greatest(p_size::BIGINT, 20)"), "j": ("pow(p_size, 2)", "pow(p_size, 2)"), "k": ("sqrt(p_retailprice)", "sqrt(p_retailprice)"), "l": ("abs(0 - p_size)", "p_size::BIGINT"), "m": ("divide(p_size, 0)", "NULL::DOUBLE"), "n": ("subtract(p_size, 1.5)", "p_size - 1.5::DOUBLE")}, ("b", "k", "j"))
_fn("fn_logic", "orders", "o_orderkey", {"a": ('if(gt(o_totalprice, 200000), "big", "small")', "CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END"), "b": ('and(eq(o_orderstatus, "F"), lt(o_custkey, 500))', "o_orderstatus = 'F' AND o_custkey < 500"), "c": ('or(eq(o_orderstatus, "F"), not(isNull(priority)))', "o_orderstatus = 'F' OR nullif(o_orderpriority, '1-URGENT') IS NOT NULL"), "d": ('priority != "2-HIGH" && o_custkey >= 10', "nullif(o_orderpriority, '1-URGENT') IS DISTINCT FROM '2-HIGH' AND o_custkey >= 10"), "e": ('coalesce(priority, "none")', "coalesce(nullif(o_orderpriority, '1-URGENT'), 'none')")})
_fn("fn_date", "orders", "o_orderkey", {"a": ("year(o_orderdate)", "year(o_orderdate)"), "b": ("month(o_orderdate)", "month(o_orderdate)"), "c": ("day(o_orderdate)", "day(o_orderdate)"), "d": ('dateAdd(o_orderdate, 36, "hour")', "o_orderdate + INTERVAL 36 HOUR"), "e": ('dateDiff(o_orderdate, dateAdd(o_orderdate, 10, "day"), "hour")', "240::BIGINT"), "f": ('formatDate(o_orderdate, "yyyy/MM/dd")', "strftime(o_orderdate, '%Y/%m/%d')"), "g": ("hour(o_orderdate)", "hour(o_orderdate)")})
_fn("fn_array", "part", "p_partkey", {"a": ("count(tags)", "len(string_split(p_name, ' '))::BIGINT"), "b": ("first(tags)", "string_split(p_name, ' ')[1]"), "c": ("last(tags)", "string_split(p_name, ' ')[-1]"), "d": ('join(sort(tags), "+")', "array_to_string(list_sort(string_split(p_name, ' ')), '+')"), "e": ('join(map(tags, uppercase(it)), "-")', "replace(upper(p_name), ' ', '-')"), "f": ("sum(map(tags, length(it)))", "length(replace(p_name, ' ', ''))::DOUBLE"), "g": ('count(filter(tags, it == "small"))', "len(list_filter(string_split(p_name, ' '), lambda x: x = 'small'))::BIGINT"), "h": ("avg(map(tags, length(it)))", "length(replace(p_name, ' ', '')) / len(string_split(p_name, ' '))::DOUBLE")}, ("h",))
_fn("fn_convert", "part", "p_partkey", {"a": ("toString(p_size)", "p_size::VARCHAR"), "b": ('toInt(replace(p_brand, "Brand#", ""))', "replace(p_brand, 'Brand#', '')::BIGINT"), "c": ("toFloat(p_size)", "p_size::DOUBLE"), "d": ("toInt(p_name)", "NULL::BIGINT"), "e": ('toBoolean("true")', "true")})
_fn("fn_template", "part", "p_partkey", {"a": ('"${p_brand}: $p_name ($unknown)"', "concat(p_brand, ': ', p_name, ' ($unknown)')")})
_fn("fn_pipe", "part", "p_partkey", {"a": ("p_name | uppercase | substring(0, 5)", "left(upper(p_name), 5)")})
_fn("fn_ternary", "orders", "o_orderkey", {"a": ("o_totalprice > 100000 ? o_custkey : 0 - 1", "CASE WHEN o_totalprice > 100000 THEN o_custkey ELSE -1 END"), "b": ('priority ? priority : "urgent"', "coalesce(nullif(o_orderpriority, '1-URGENT'), 'urgent')")})
_fn("fn_expr", "orders", "o_orderkey", {"a": ('expr("cast(o_totalprice as bigint) % 10")', "trunc(o_totalprice)::BIGINT % 10")})


@_code("computed_fields", "SELECT l_orderkey, round(l_quantity + l_tax, 4) AS total, round(l_extendedprice * l_discount, 4) AS off, round((l_quantity + l_tax) / 2, 4) AS mean, concat(l_returnflag, ' ', l_linestatus) AS flags, round(l_extendedprice * (1 - l_discount), 4) AS net, concat(l_returnflag, '/', l_linestatus) AS label FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000", "lineitem")
def _(e: Engine) -> DataFrame:
    for name, f in {"total": computed.total("l_quantity", "l_tax"), "off": computed.product("l_extendedprice", "l_discount"), "mean": computed.average("l_quantity", "l_tax"), "flags": computed.concat("l_returnflag", "l_linestatus"), "net": computed.script("doc.l_extendedprice * (1 - doc.l_discount)"), "label": computed.templated("${l_returnflag}/$l_linestatus")}.items():
        e.register_computed_field("lineitem", name, f)
    df = e.plan("query { lineitem(where: {net: {gt: 50000}}) { l_orderkey total off mean flags net label } }")
    return df.withColumns({n: F.round(n, 4) for n in ("total", "off", "mean", "net")})


# ---------------------------------------------------------------- search

_text("search_substring", 'query { part(search: {query: "RING", fields: ["p_name"]}) { p_partkey p_name } }', "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')", on=("part",))
_text("search_all_fields", 'query { customer(search: {query: "auto"}) { c_custkey } }', "SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'auto') OR contains(lower(c_mktsegment), 'auto')", on=("customer",))
_FUZZY = "list_sum(list_transform(list_filter(list_transform(list_filter(string_split_regex(lower(p_name), '\\s+'), lambda w: w <> ''), lambda w: levenshtein(w, 'smal')), lambda d: d <= 1), lambda d: 1 / (1 + 0.3 * d)))"
_text("search_fuzzy", 'query { part(where: {p_size: {gt: 5}}, search: {query: "smal", fields: ["p_name"], fuzzy: true}) { p_partkey _score } }', f"SELECT p_partkey, round({_FUZZY}, 6) AS _score FROM part WHERE p_size > 5 AND {_FUZZY} > 0", _round6 := (lambda df: df.withColumn("_score", F.round("_score", 6))), on=("part",))
_STOP = ", ".join(f"'{w}'" for w in sorted(search.STOP_WORDS))
_WORDS = f"list_filter(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+)', 1), lambda w: strlen(w) > 1 AND w NOT IN ({_STOP}))"
_TERMS = ["random", "thtion", "und"]


def _bm25_sql() -> str:
    tf = ", ".join(f"len(list_filter(ws, lambda w: w = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS))
    dfs = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(_TERMS)))
    idf = lambda i: f"CASE WHEN df{i} >= docs THEN 0.1 ELSE greatest(ln((docs - df{i} + 0.5) / (df{i} + 0.5)), 0.1) END"
    score = " + ".join(f"tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean)) * {idf(i)}" for i in range(len(_TERMS)))
    return f"WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), c AS (SELECT doc_id, len(ws) AS dl, {tf} FROM d), s AS (SELECT count(*) AS docs, avg(dl) AS mean, {dfs} FROM c) SELECT doc_id, round(({score})::DOUBLE, 6) AS _score FROM c, s WHERE {' + '.join(f'tf{i}' for i in range(len(_TERMS)))} > 0"


@_code("search_bm25", _bm25_sql(), "documents")
def _(e: Engine) -> DataFrame:
    return _round6(e.search("documents").query(" ".join(_TERMS)).ranked("text")).select("doc_id", "_score")


@_code("full_text_search", _bm25_sql(), "documents")
def _(e: Engine) -> DataFrame:
    return _round6(e.full_text_search("documents", "text", " ".join(_TERMS))).select("doc_id", "_score")


_text("search_min_score", 'query { part(search: {query: "smal", fields: ["p_name"], fuzzy: true, minScore: 0.7}) { p_partkey _score } }', f"SELECT p_partkey, round({_FUZZY}, 6) AS _score FROM part WHERE {_FUZZY} >= 0.7", _round6, on=("part",))


@_code("text_index", "SELECT word, p_partkey::VARCHAR AS sid, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY ALL", "part")
def _(e: Engine) -> DataFrame:
    return e.text_index("part", "p_name")


_BM25_FUZZY = """
WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part), n AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM w),
t AS (SELECT p_partkey, len(ws) AS dl, unnest(list_distinct(ws)) AS word, ws FROM w), m AS (SELECT *, levenshtein(word, 'smal') AS d FROM t WHERE levenshtein(word, 'smal') <= 1),
f AS (SELECT word, count(*) AS df FROM m GROUP BY 1)
SELECT p_partkey, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) * CASE WHEN df >= docs THEN 0.1 ELSE greatest(ln((docs - df + 0.5) / (df + 0.5)), 0.1) END / (1 + 0.3 * d)), 6) AS _score
FROM (SELECT *, len(list_filter(ws, lambda x: x = word)) AS tf FROM m) JOIN f USING (word), n GROUP BY 1
"""


@_code("search_bm25_fuzzy", _BM25_FUZZY, "part")
def _(e: Engine) -> DataFrame:
    return _round6(e.search("part").query("smal").fuzzy(1).ranked("p_name")).select("p_partkey", "_score")


@_code("highlight", "SELECT p_partkey, regexp_replace(p_name, '(?i)(small|ring)', '<mark>\\1</mark>', 'g') AS marked FROM part", "part")
def _(e: Engine) -> DataFrame:
    return e.catalog.get("part").frame().select("p_partkey", search.highlight(F.col("p_name"), "Small ring").alias("marked"))


# ---------------------------------------------------------------- language

_text("fragment", "fragment Basics on customer { c_custkey ...Money } fragment Money on customer { balance: c_acctbal } query { customer { ...Basics } }", "SELECT c_custkey, c_acctbal AS balance FROM customer", on=("customer",))
_text("inline_fragment", "query { customer { c_custkey ... on customer { c_name } } }", "SELECT c_custkey, c_name FROM customer", on=("customer",))
_text("include_skip", "query q($a: Boolean!, $b: Boolean = true) { customer { c_custkey c_name @include(if: $a) c_acctbal @skip(if: $b) } }", "SELECT c_custkey, c_name FROM customer", None, {"a": True}, on=("customer",))
_text("variables", 'query q($min: Float!, $seg: [String] = ["BUILDING"], $n: Int = 30) { customer(where: {c_acctbal: {gt: $min}, c_mktsegment: {in: $seg}}, orderBy: {c_acctbal: DESC}, limit: $n) { c_custkey c_acctbal } }', "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 100 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 30", None, {"min": 100.0}, on=("customer",))
_text("defer", "query { customer { c_custkey c_name @defer } }", "SELECT c_custkey FROM customer", on=("customer",))
_text("explain", 'query @explain { customer(where: {c_mktsegment: {eq: "BUILDING"}}) { c_name } }', "SELECT 'customer' AS collection, true AS has_filter", lambda df: df.select("collection", F.col("plan").contains("c_mktsegment,BUILDING").alias("has_filter")), on=("customer",))
_text("introspect", "__schema { collections fields }", "SELECT * FROM (VALUES ('region', 'r_regionkey', 'Int'), ('region', 'r_name', 'String'), ('nation', 'n_nationkey', 'Int'), ('nation', 'n_name', 'String'), ('nation', 'n_regionkey', 'Int'), ('nation', 'zone', 'Int')) t(collection, name, type)", lambda df: df.select("collection", "name", "type"), on=("region", "nation"))


@_code("multi_root", "SELECT 'region' AS root, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation", "region", "nation")
def _(e: Engine) -> DataFrame:
    a, b = (p.frame.agg(F.lit(p.name).alias("root"), F.count(F.lit(1)).alias("n")) for p in e.execute("query { region { r_name } nation { n_name } }").parts)
    return a.unionByName(b)


@_code("stats", "SELECT 'nation' AS collection, count(*) AS documents FROM nation", "nation")
def _(e: Engine) -> DataFrame:
    return e.stats("nation").select("collection", "documents")


_PARITY = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000 AND o_orderstatus <> 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15"


@_code("payload_query", _PARITY, "orders")
def _(e: Engine) -> DataFrame:
    return e.run_payload("orders", {"filters": [{"field": "o_totalprice", "operator": "Gte", "value": 250000}, {"field": "o_orderstatus", "operator": "ne", "value": "F"}], "sort": {"field": "o_totalprice", "ascending": False}, "limit": 15, "select": ["o_orderkey", "o_totalprice"]})


@_code("fluent_query", _PARITY, "orders")
def _(e: Engine) -> DataFrame:
    return e.query("orders").filter(lambda f: f.gte("o_totalprice", 250000) & ~f.eq("o_orderstatus", "F")).order_by("o_totalprice", False).limit(15).select("o_orderkey", "o_totalprice").frame()


# ---------------------------------------------------------------- changes


def _owned(e: Engine, source: str, name: str, fields: dict[str, str]) -> None:
    """A collection of the engine's own with the rows of another."""
    from ..engine import Transaction
    from ..lang import ast

    tx = Transaction(e)
    e._define(tx, ast.Define(name, [ast.FieldDef(n, t) for n, t in {"id": "ID", **fields}.items()]))
    c = e.catalog.get(source)
    df = c.load()
    frame = tx.frames[name]
    casts = [F.col(f"`{n}`").cast(frame.schema[n].dataType).alias(n) for n in fields]
    key = c.sid(df.schema).column
    tx.replace(name, df.select(key.alias("_sid"), key.alias("id"), *casts))
    e._commit(tx)


_NATION = {"n_nationkey": "Int", "n_name": "String", "n_regionkey": "Int"}


def _nation(name: str, sql: str) -> Callable:
    def add(f: Callable[[Engine], Any]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            e = engine(spark, sf_dir, "nation")
            _owned(e, "nation", "land", _NATION)
            got = f(e)
            return got if isinstance(got, DataFrame) else e.plan("query { land { n_nationkey n_name n_regionkey } }")

        QUERIES[name], SQL[name] = run, sql
        return f

    return add


_ALL = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"


@_nation("update_expr", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN n_nationkey < 5 THEN n_regionkey + 10 ELSE n_regionkey END::BIGINT AS n_regionkey FROM nation")
def _(e: Engine) -> Any:
    return e.execute("mutation { update(collection: \"land\", where: {n_nationkey: {lt: 5}}, data: {n_regionkey: {increment: 10}}) { id } }")


@_nation("upsert", f"{_ALL} WHERE n_nationkey <> 3 UNION ALL VALUES (3::BIGINT, 'changed', 99::BIGINT), (77::BIGINT, 'new', NULL::BIGINT)")
def _(e: Engine) -> Any:
    e.execute('mutation { upsert(collection: "land", where: {n_nationkey: {eq: 3}}, data: {n_name: "changed", n_regionkey: 99}) { id } }')
    return e.execute('mutation { upsert(collection: "land", where: {n_nationkey: {eq: 77}}, data: {n_nationkey: 77, n_name: "new"}) { id } }')


@_nation("delete", f"{_ALL} WHERE NOT n_regionkey = 2")
def _(e: Engine) -> Any:
    return e.execute('mutation { deleteFrom(collection: "land", where: {n_regionkey: {eq: 2}}) { id } }')


@_nation("import_skip", f"{_ALL} UNION ALL VALUES (100::BIGINT, 'added', 1::BIGINT)")
def _(e: Engine) -> Any:
    return e.execute('mutation { import(collection: "land", data: [{id: "0", n_nationkey: 0, n_name: "dup"}, {id: "100", n_nationkey: 100, n_name: "added", n_regionkey: 1}]) { id } }')


@_nation("transaction", f"{_ALL} WHERE n_nationkey <> 1 UNION ALL VALUES (200::BIGINT, 'in one', 7::BIGINT)")
def _(e: Engine) -> Any:
    return e.execute('mutation { transaction { insertInto(collection: "land", data: {id: "200", n_nationkey: 200, n_name: "in one", n_regionkey: 7}) { id } deleteFrom(collection: "land", where: {n_nationkey: {eq: 1}}) { id } } }')


@_nation("migrate", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS label, CASE WHEN n_regionkey = 1 THEN 'west' ELSE 'rest' END AS side FROM nation")
def _(e: Engine) -> DataFrame:
    text = 'migrate { "v1": { alter collection land { add side: String = "rest" rename n_name to label } } "v2": { migrate data in land { set side = "west" where {n_regionkey: {eq: 1}} } } }'
    e.execute(text)
    e.execute(text)
    return e.plan("query { land { n_nationkey label side } }")


@_nation("modifiers", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey < 3 THEN 'a,c' ELSE 'a,b' END AS tags FROM nation")
def _(e: Engine) -> DataFrame:
    e.execute('schema { alter collection land { add tags: [String] = ["a", "b"] } }')
    for change in ('push: "c"', 'pull: "b"', 'addToSet: "c"'):
        e.execute(f'mutation {{ update(collection: "land", where: {{n_nationkey: {{lt: 3}}}}, data: {{tags: {{{change}}}}}) {{ id }} }}')
    return e.plan("query { land { n_nationkey tags } }").withColumn("tags", F.array_join("tags", ","))


@_nation("changed_fields", "SELECT n_nationkey::VARCHAR AS sid, 'n_regionkey' AS fields FROM nation WHERE n_nationkey < 5")
def _(e: Engine) -> DataFrame:
    e.execute('mutation { update(collection: "land", where: {n_nationkey: {lt: 5}}, data: {n_regionkey: {increment: 1}}) { id } }')
    return e.changes().filter("change_type = 'Update'").select("sid", F.array_join("changed_fields", ",").alias("fields"))


@_nation("live_query_delta", "SELECT n_nationkey::VARCHAR AS sid, CASE WHEN n_regionkey = 1 THEN 'Removed' ELSE 'Modified' END AS change FROM nation WHERE n_regionkey IN (1, 2)")
def _(e: Engine) -> DataFrame:
    from ..streaming import feed

    e.execute('mutation { a: update(collection: "land", where: {n_regionkey: {eq: 1}}, data: {n_regionkey: 9}) { id } b: update(collection: "land", where: {n_regionkey: {eq: 2}}, data: {n_name: "x"}) { id } }')
    watch = e.query("land").filter(lambda f: f.in_values("n_regionkey", [1, 2])).watch()
    return feed.deltas(e.changes(), watch.c, watch.where).select("sid", "change")


@_nation("subscription_filter", "SELECT n_nationkey::VARCHAR AS _sid, 'Delete' AS change_type, n_name FROM nation WHERE n_regionkey = 3 AND n_name > 'D'")
def _(e: Engine) -> DataFrame:
    from ..operators import predicates as P
    from ..streaming import feed

    e.execute('mutation { delete(collection: "land", where: {n_regionkey: {eq: 3}}) { id } }')
    return feed.subscription(e.changes(), e.catalog.get("land"), P.Leaf("n_name", "gt", "D"), [("n_name", "n_name")]).drop("seq")


# ---------------------------------------------------------------- more of the engine's own tables

_text("connection_cursors", 'query { orders(orderBy: {o_totalprice: DESC}, first: 5, after: "77") { edges { cursor } pageInfo { hasNextPage hasPreviousPage startCursor endCursor } } }', "WITH p AS (SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, -o_orderkey) < (SELECT (o_totalprice, -o_orderkey) FROM orders WHERE o_orderkey = 77) ORDER BY o_totalprice DESC, o_orderkey LIMIT 6), q AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM p) SELECT count(*) > 5 AS more, true AS before, max(o_orderkey::VARCHAR) FILTER (i = 1) AS a, max(o_orderkey::VARCHAR) FILTER (i = least(5, (SELECT count(*) FROM p))) AS z FROM q", lambda df: df.select(F.col("pageInfo.hasNextPage").alias("more"), F.col("pageInfo.hasPreviousPage").alias("before"), F.col("pageInfo.startCursor").alias("a"), F.col("pageInfo.endCursor").alias("z")), on=("orders",))


@_code("find_complex", "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 400000) AND o_orderpriority <> '5-LOW' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", "orders")
def _(e: Engine) -> DataFrame:
    return e.find_complex("orders", {"or": [{"o_orderstatus": {"eq": "F"}}, {"o_totalprice": {"gt": 400000}}], "o_orderpriority": {"ne": "5-LOW"}}, order={"o_totalprice": "DESC"}, limit=10, offset=5).select("o_orderkey", "o_totalprice")


@_nation("insert_many", f"{_ALL} UNION ALL VALUES (300::BIGINT, 'one', 1::BIGINT), (301::BIGINT, 'two', 2::BIGINT)")
def _(e: Engine) -> Any:
    return e.execute('mutation { insertMany(collection: "land", data: [{id: "300", n_nationkey: 300, n_name: "one", n_regionkey: 1}, {id: "301", n_nationkey: 301, n_name: "two", n_regionkey: 2}]) { id } }')


@_nation("returned_rows", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name AS label FROM nation WHERE n_regionkey = 1")
def _(e: Engine) -> DataFrame:
    return e.execute('mutation { delete(collection: "land", where: {n_regionkey: {eq: 1}}) { n_nationkey label: n_name } }').frame


@_nation("search_by_value", f"{_ALL} WHERE n_regionkey = 3")
def _(e: Engine) -> DataFrame:
    e.create_index("land", "n_regionkey")
    return e.search_by_value("land", "n_regionkey", 3).select("n_nationkey", "n_name", "n_regionkey")


def _refused(e: Engine, *texts: str) -> DataFrame:
    """How many texts are refused, beside the rows that stay as they were."""
    from ..errors import ValidationError

    n = 0
    for t in texts:
        try:
            e.execute(t)
        except ValidationError:
            n += 1
    return e.plan("query { land { n_nationkey n_name n_regionkey } }").withColumn("refused", F.lit(n))


@_nation("foreign_keys", "SELECT *, 2 AS refused FROM (" + _ALL + ")")
def _(e: Engine) -> DataFrame:
    e.execute('schema { define collection town { id: ID land: String @relation(to: "land", key: "id") } }')
    e.execute('mutation { insertInto(collection: "town", data: {id: "t", land: "3"}) { id } }')
    return _refused(e, 'mutation { insertInto(collection: "town", data: {id: "u", land: "none"}) { id } }', 'mutation { update(collection: "town", data: {land: "no"}) { id } }', 'mutation { insertInto(collection: "town", data: {id: "v", land: "4"}) { id } }')


@_nation("unique_keys", "SELECT *, 1 AS refused FROM (" + _ALL + ") UNION ALL VALUES (500::BIGINT, 'new', NULL::BIGINT, 1)")
def _(e: Engine) -> DataFrame:
    return _refused(e, 'mutation { insertInto(collection: "land", data: {id: "3", n_nationkey: 3}) { id } }', 'mutation { insertInto(collection: "land", data: {id: "500", n_nationkey: 500, n_name: "new"}) { id } }')


@_nation("event_filters", "SELECT count(*) AS updates, count(*) FILTER (n_regionkey = 1) AS regions, count(*) FILTER (n_regionkey = 2) AS names FROM nation WHERE n_regionkey IN (1, 2)")
def _(e: Engine) -> DataFrame:
    from ..streaming import feed

    e.execute('mutation { a: update(collection: "land", where: {n_regionkey: {eq: 1}}, data: {n_regionkey: 9}) { id } b: update(collection: "land", where: {n_regionkey: {eq: 2}}, data: {n_name: "x"}) { id } }')
    events = feed.listen(e.changes(), e.catalog.get("land"))
    return events.agg(F.count_if(feed.of_type("Update")).alias("updates"), F.count_if(feed.field_changed("n_regionkey")).alias("regions"), F.count_if(feed.watching(["n_name"]) & feed.of_type("Update")).alias("names"))


@_nation("handlers", "SELECT n_nationkey::VARCHAR AS id, n_name AS who FROM nation WHERE n_regionkey = 4")
def _(e: Engine) -> DataFrame:
    e.execute("schema { define collection log { id: ID who: String } }")
    e.execute('define handler "h" { on: "delete land", action: { insertInto(collection: "log", data: {id: $_id, who: $_n_name}) { id } } }')
    e.execute('mutation { delete(collection: "land", where: {n_regionkey: {eq: 4}}) { id } }')
    e.handlers.apply(e.changes())
    return e.plan("query { log { id who } }")


@_nation("jobs", "SELECT 'COMPLETED' AS status, count(*) AS n FROM nation WHERE n_nationkey < 4 UNION ALL SELECT 'DEAD', 1")
def _(e: Engine) -> DataFrame:
    from ..jobs import Queue

    payloads = ", ".join(f"{{n: {i}}}" for i in range(4))
    e.execute(f'mutation {{ a: enqueueJobs(jobType: "ok", payloads: [{payloads}]) {{ id }} b: enqueueJob(jobType: "bad", maxRetries: 1) {{ id }} }}')
    queue = Queue(e)
    queue.on("ok", lambda p: p["n"])
    queue.on("bad", lambda p: p["n"])
    queue.run()
    return queue.stats()


@_nation("export_import", _ALL)
def _(e: Engine) -> DataFrame:
    from ..sources.shared import shared_dir
    import uuid

    at = f"{shared_dir(e.spark).rstrip('/')}/fathom-export-{uuid.uuid4().hex}"
    e.execute(f'mutation {{ export(collection: "land", format: JSON, path: "{at}") {{ id }} }}')
    e.new_collection("copy", {"id": "ID", **_NATION})
    e.import_json("copy", at)
    return e.plan("query { copy { n_nationkey n_name n_regionkey } }")


@_nation("drop_field", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def _(e: Engine) -> DataFrame:
    e.execute("schema { alter collection land { drop n_regionkey } }")
    return e.catalog.get("land").load().drop("_sid", "id")
