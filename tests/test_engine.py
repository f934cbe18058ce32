"""The engine on small collections, with the values that its semantics ask for."""

import json

import pytest
from pyspark.sql import functions as F

from fathom.engine import Engine, Options
from fathom.errors import CollectionNotFound, Forbidden, SyntaxProblem, Unauthorized, ValidationError
from fathom.functions import computed
from fathom.jobs import Queue
from fathom.operators import timeseries


@pytest.fixture(scope="module")
def e(spark):
    e = Engine(spark)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    e.register("products", frame([(1, "Laptop", "Electronics", 1200.0, 50), (2, "Phone", "Electronics", 800.0, 100), (3, "Tablet", "Electronics", 500.0, 30), (4, "Chair", "Furniture", 150.0, 200), (5, "Desk", "Furniture", 300.0, 50), (6, "Monitor", "Electronics", 200.0, 75)], "id long, name string, category string, price double, stock long"), "id")
    e.register("items", frame([(i, f"Item {i}", i) for i in range(1, 6)], "id long, name string, value long"), "id")
    e.register("posts", frame([(1, "Rust async", ["rust", "async"], "u1"), (2, "Go channels", ["go", "concurrency"], None), (3, "Python ML", None, "zz")], "id long, title string, tags array<string>, author string"), "id", relations={"author": ("users", "id")})
    e.register("users", frame([("u1", "Alice", "admin", 30, "alice@gmail.com"), ("u2", "Bob", "moderator", 25, "bob@yahoo.com"), ("u3", "Charlie", "user", 20, None)], "id string, name string, role string, age long, email string"), "id")
    e.register("docs", frame([(1, "rust programming"), (2, "rast programming"), (3, "wireless headphones"), (4, None)], "id long, text string"), "id")
    return e


def rows(e, text, variables=None, options=None):
    return e.execute(text, variables, options).rows()


def test_aggregates(e):
    got = rows(e, '{ products { aggregate { count sum(field: "stock") avg(field: "price") } } }')[0]["aggregate"]
    assert got == {"count": 6, "sum": 505.0, "avg": 525.0}
    got = rows(e, '{ products(where: {category: {eq: "Furniture"}}) { aggregate { lo: min(field: "price") hi: max(field: "price") } } }')[0]["aggregate"]
    assert got == {"lo": 150.0, "hi": 300.0}
    got = rows(e, '{ products(where: {category: {eq: "Cars"}}) { aggregate { count avg(field: "price") sum(field: "price") } } }')[0]["aggregate"]
    assert got == {"count": 0, "avg": None, "sum": 0.0}


def test_groups_with_nodes(e):
    got = {r["key"]: r for r in rows(e, '{ products { groupBy(field: "category") { key count nodes { name } aggregate { sum(field: "stock") } } } }')}
    assert got["Furniture"]["count"] == 2 and [n["name"] for n in got["Furniture"]["nodes"]] == ["Chair", "Desk"]
    assert got["Electronics"]["aggregate"] == {"sum": 255.0}


def test_connection_pages(e):
    text = "query q($after: String) { items(orderBy: {value: ASC}, first: 2, after: $after) { edges { cursor node { value } } pageInfo { hasNextPage hasPreviousPage startCursor endCursor } } }"
    seen, after = [], None
    for more in (True, True, False):
        page = rows(e, text, {"after": after} if after else None)[0]
        seen += [x["node"]["value"] for x in page["edges"]]
        assert page["pageInfo"]["hasNextPage"] is more and page["pageInfo"]["hasPreviousPage"] is (after is not None)
        after = page["pageInfo"]["endCursor"]
    assert seen == [1, 2, 3, 4, 5]
    page = rows(e, '{ items(orderBy: {value: ASC}, last: 2, before: "5") { edges { node { value } } pageInfo { hasNextPage hasPreviousPage } } }')[0]
    assert [x["node"]["value"] for x in page["edges"]] == [3, 4] and page["pageInfo"] == {"hasNextPage": True, "hasPreviousPage": True}
    assert rows(e, '{ items(where: {value: {gt: 99}}, first: 2) { edges { cursor } pageInfo { endCursor hasNextPage } } }') == [{"edges": [], "pageInfo": {"endCursor": None, "hasNextPage": False}}]


def test_cursor_over_nulls(e):
    everyone = [r["name"] for r in rows(e, "{ users(orderBy: {email: ASC}) { name } }")]
    assert everyone == ["Charlie", "Alice", "Bob"]
    assert [r["name"] for r in rows(e, '{ users(orderBy: {email: ASC}, after: "u3", first: 5) { name } }')] == ["Alice", "Bob"]
    assert [r["name"] for r in rows(e, '{ users(orderBy: {email: DESC}, after: "u1", first: 5) { name } }')] == ["Charlie"]


@pytest.mark.parametrize(
    "where, names",
    [
        ('{email: {matches: ".*@gmail\\\\.com$"}}', ["Alice"]),
        ('{email: {isNull: true}}', ["Charlie"]),
        ('{email: {isNull: false}}', ["Alice", "Bob"]),
        ('{email: {ne: "bob@yahoo.com"}}', ["Alice", "Charlie"]),
        ('{email: {nin: ["bob@yahoo.com"]}}', ["Alice", "Charlie"]),
        ('{email: {in: ["bob@yahoo.com", null]}}', ["Bob", "Charlie"]),
        ('{not: {email: {startsWith: "a"}}}', ["Bob", "Charlie"]),
        ('{not: {not: {email: {startsWith: "a"}}}}', ["Alice"]),
        ('{or: [{role: {eq: "admin"}}, {role: {eq: "moderator"}}], age: {gt: 20}}', ["Alice", "Bob"]),
        ('{age: {gt: 20, lt: 30}}', ["Bob"]),
        ('{and: []}', ["Alice", "Bob", "Charlie"]),
        ('{or: []}', []),
        ('{_sid: {in: ["u1", "u3", "none"]}}', ["Alice", "Charlie"]),
        ('{name: {contains: "li"}}', ["Alice", "Charlie"]),
    ],
)
def test_filters(e, where, names):
    assert sorted(r["name"] for r in rows(e, f"{{ users(where: {where}) {{ name }} }}")) == names


@pytest.mark.parametrize("where, ids", [('{tags: {containsAny: ["rust", "go"]}}', [1, 2]), ('{tags: {containsAll: ["rust", "async"]}}', [1]), ('{not: {tags: {contains: "rust"}}}', [2, 3]), ('{tags: {containsAll: []}}', [1, 2]), ('{tags: {containsAny: []}}', [])])
def test_array_filters(e, where, ids):
    assert sorted(r["id"] for r in rows(e, f"{{ posts(where: {where}) {{ id }} }}")) == ids


@pytest.mark.parametrize("text", ['{ users(where: {age: {near: 1}}) { name } }', '{ users(where: {nope: {eq: 1}}) { name } }', '{ users { nope } }', '{ users(where: {age: {eq: "x"}}) { name } }', '{ users(limit: -1) { name } }', '{ users(where: {email: {matches: "(?=x)"}}) { name } }', '{ users(what: 1) { name } }'])
def test_invalid_requests(e, text):
    with pytest.raises(ValidationError):
        rows(e, text)


def test_unknown_collection(e):
    with pytest.raises(CollectionNotFound):
        rows(e, "{ nowhere { x } }")


def test_relations_and_lookups(e):
    got = {r["id"]: r["author"] for r in rows(e, "{ posts { id author { name } } }")}
    assert got == {1: [{"name": "Alice"}], 2: None, 3: []}
    got = rows(e, '{ users(where: {id: {eq: "u1"}}) { name ps: lookup(collection: "posts", localField: "_sid", foreignField: "author") { title } } }')
    assert got == [{"name": "Alice", "ps": [{"title": "Rust async"}]}]


def test_search(e):
    got = rows(e, '{ docs(search: {query: "rust", fuzzy: true}) { id _score } }')
    assert [r["id"] for r in got] == [1, 2] and got[0]["_score"] == pytest.approx(1.0) and got[1]["_score"] == pytest.approx(1 / 1.3)
    assert [r["id"] for r in rows(e, '{ docs(search: {query: "rust", fuzzy: true, minScore: 0.9}) { id } }')] == [1]
    assert [r["id"] for r in e.search("docs").query("wireles").fuzzy(1).frame().collect()] == [3]
    assert [r["id"] for r in e.search("docs").query("HEADPHONES").frame().collect()] == [3]
    assert [r["id"] for r in e.search("docs").query("rust headphones").ranked("text").collect()] == [1, 3]
    assert e.search("docs").query("the").ranked("text").count() == 0


def test_permissions(e):
    text = '{ users @require(role: "admin") { name } }'
    with pytest.raises(Unauthorized):
        rows(e, text)
    with pytest.raises(Forbidden):
        rows(e, text, options=Options(user="x", roles={"user"}))
    assert len(rows(e, text, options=Options(user="x", roles={"admin"}))) == 3


def test_deferred_explained_and_many_roots(e):
    r = e.execute("{ users { name age @defer } }")
    assert r.deferred == ["age"] and r.frame.columns == ["name"]
    assert "Scan" in e.execute("query @explain { users { name } }").status
    parts = e.execute("{ a: users { name } b: items { value } }").parts
    assert [(p.name, p.frame.count()) for p in parts] == [("a", 3), ("b", 5)]


def test_computed_fields(e, spark):
    e.register("cart", spark.createDataFrame([(1, "Apple", 10, 5), (2, "Pear", None, 2)], "id long, item string, price long, qty long"), "id", computed={"total": computed.script("price * qty"), "label": computed.templated("${item} x$qty ($nope)")})
    assert rows(e, "{ cart(where: {total: {gte: 50}}) { total label } }") == [{"total": 50, "label": "Apple x5 ($nope)"}]
    got = rows(e, "{ cart { id a: price ? price : 0  b: qty / 0  c: qty > 3 && price == 10 } }")
    assert got == [{"id": 1, "a": 10, "b": None, "c": True}, {"id": 2, "a": 0, "b": None, "c": False}]


@pytest.mark.parametrize("n, block", [(0, 8), (1, 8), (5, 8), (100, 8), (1000, 16)])
def test_rolling_in_blocks(spark, monkeypatch, n, block):
    monkeypatch.setattr(timeseries, "BLOCK", block)
    df = spark.createDataFrame([(i, float(i * i % 37) if i % 5 else None) for i in range(n)], "id long, v double")
    columns = {"s": ("v", "rollingSum", 4), "m": ("v", "max", 2), "one": ("v", "avg", 1)}
    got, want = ({r.id: (r.s, r.m, r.one) for r in timeseries.rolling(df, columns, [F.col("id").asc()], bounded).collect()} for bounded in (False, True))
    assert got == want and len(got) == n


def test_front_ends_agree(e):
    a = rows(e, '{ users(where: {age: {gte: 25}}, orderBy: {age: DESC}) { name } }')
    b = e.query("users").filter(lambda f: f.gte("age", 25)).order_by("age", False).select("name").collect()
    c = [r.asDict() for r in e.run_payload("users", json.dumps({"filters": [{"field": "age", "operator": "gte", "value": 25}], "sort": {"field": "age", "ascending": False}, "select": ["name"]})).collect()]
    assert a == b == c == [{"name": "Alice"}, {"name": "Bob"}]
    assert e.run_payload("users", {"filters": [{"field": "email", "operator": "ne", "value": "x"}]}).count() == 2
    assert e.find_by_id("users", "u2").first()["name"] == "Bob" and e.query("users").count() == 3


def plan_of(e, text):
    return e.plan(text)._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 as k", "cast(id as string) as s").write.parquet(f"{tmp_path}/t")
    e = Engine(spark)
    e.register("t", spark.read.parquet(f"{tmp_path}/t"), "id")
    plan = plan_of(e, '{ t(where: {k: {gt: 3}, s: {startsWith: "9"}}) { k } }')
    assert "GreaterThan(k,3)" in plan and "StringStartsWith(s,9)" in plan and "ReadSchema: struct<k:bigint,s:string>" in plan
    assert "In(id, [5,7])" in plan_of(e, '{ t(where: {_sid: {in: ["5", "7"]}}) { s } }')
    assert "TakeOrderedAndProject" in plan_of(e, "{ t(orderBy: {k: DESC}, limit: 5) { s } }")
    assert "Exchange" not in plan_of(e, "{ t(where: {not: {k: {eq: 3}}}) { s } }")


# ---------------------------------------------------------------- changes


@pytest.fixture
def own(spark):
    e = Engine(spark)
    e.execute('schema { define collection users { id: ID name: String! email: String @unique age: Int tags: [String] } }')
    e.execute('mutation { insertMany(collection: "users", data: [{id: "a", name: "Ann", email: "a@x.org", age: 30, tags: ["x", "y"]}, {id: "b", name: "Ben", email: "b@x.org"}]) { id } }')
    return e


def users(e):
    return {r["id"]: r for r in rows(e, "{ users { id name email age tags } }")}


def test_mutations(own):
    r = own.execute('mutation { insertInto(collection: "users", data: {id: "c", name: "Cy", age: 5}) { id name } }')
    assert r.affected == 1 and r.rows() == [{"id": "c", "name": "Cy"}]
    own.execute('mutation { update(collection: "users", where: {id: {eq: "a"}}, data: {age: {increment: 5}, tags: {push: "z"}}) { id } }')
    own.execute('mutation { update(collection: "users", where: {id: {eq: "b"}}, data: {age: {decrement: 3}, tags: {addToSet: "z"}}) { id } }')
    own.execute('mutation { update(collection: "users", where: {id: {eq: "a"}}, data: {tags: {pull: "x"}}) { id } }')
    got = users(own)
    assert (got["a"]["age"], got["a"]["tags"]) == (35, ["y", "z"]) and (got["b"]["age"], got["b"]["tags"]) == (-3, ["z"])
    assert own.execute('mutation { upsert(collection: "users", where: {age: {lt: 6}}, data: {name: "first"}) { id } }').rows() == [{"id": "b"}]
    assert own.execute('mutation { deleteFrom(collection: "users", where: {not: {age: {gt: 5}}}) { id } }').affected == 2
    assert set(users(own)) == {"a"}
    kinds = [r.change_type for r in own.changes().orderBy("seq").collect()]
    assert kinds.count("Insert") == 3 and kinds.count("Update") == 4 and kinds.count("Delete") == 2
    assert own.query("users").delete() == 1 and users(own) == {}


@pytest.mark.parametrize("text", ['insertInto(collection: "users", data: {id: "d", name: "D", email: "a@x.org"}) { id }', 'insertInto(collection: "users", data: {id: "a", name: "again"}) { id }', 'insertInto(collection: "users", data: {id: "d"}) { id }', 'insertInto(collection: "users", data: {id: "d", name: "D", other: 1}) { id }', 'update(collection: "users", data: {email: "same"}) { id }', 'update(collection: "users", data: {name: {increment: 1}}) { id }'])
def test_nothing_of_a_failed_mutation_stays(own, text):
    before = users(own)
    with pytest.raises(ValidationError):
        own.execute(f'mutation {{ transaction {{ deleteFrom(collection: "users", where: {{id: {{eq: "b"}}}}) {{ id }} x: insertInto(collection: "users", data: {{id: "z", name: "Z"}}) {{ id }} }} y: {text} }}')
    assert users(own) == before


def test_relations_are_checked(own):
    own.execute('schema { define collection notes { id: ID user: String @relation(to: "users", key: "id") size: Int @validate(min: 1, max: 9) } }')
    own.execute('mutation { insertInto(collection: "notes", data: {id: "n", user: "a", size: 3}) { id } }')
    for bad in ('user: "nobody"', "size: 10"):
        with pytest.raises(ValidationError):
            own.execute(f'mutation {{ insertInto(collection: "notes", data: {{id: "m", {bad}}}) {{ id }} }}')
    assert rows(own, "{ notes { user { name } } }") == [{"user": [{"name": "Ann"}]}]


def test_schema_changes_survive_a_restart(own, spark):
    with pytest.raises(ValidationError):
        own.execute("schema { define collection users { id: ID } }")
    own.execute("schema { define collection users if not exists { id: ID } drop collection nope if exists }")
    text = 'migrate { "v1": { alter collection users { add role: String = "member" rename age to years drop tags } } "v2": { migrate data in users { set role = "old" where {years: {gt: 20}} set name = role } } }'
    r = own.execute(text)
    assert (r.status, r.affected, r.name) == ("applied", 2, "v2")
    assert own.execute(text).status == "skipped"
    again = Engine(spark, own.store.files.root)
    got = {r["id"]: r for r in rows(again, "{ users { id name role years } }")}
    assert got == {"a": {"id": "a", "name": "member", "role": "old", "years": 30}, "b": {"id": "b", "name": "member", "role": "member", "years": None}}
    again.execute("schema { alter collection users { modify years: String } }")
    assert users_schema(again)["years"] == "string"
    again.execute("schema { drop collection users }")
    with pytest.raises(CollectionNotFound):
        rows(again, "{ users { id } }")


def users_schema(e):
    return dict(e.catalog.get("users").load().dtypes)


def test_two_commits_at_once(own, spark):
    other = Engine(spark, own.store.files.root)
    own.execute('mutation { insertInto(collection: "users", data: {id: "c", name: "C"}) { id } }')
    with pytest.raises(Exception, match="another commit"):
        other.execute('mutation { insertInto(collection: "users", data: {id: "d", name: "D"}) { id } }')


def test_import_and_export(own, tmp_path, spark):
    (tmp_path / "in.json").write_text('{"id": "a", "name": "dup"}\n{"id": "k", "name": "Kim", "age": 4}\n{"id": "l", "name": "Lee", "email": "b@x.org"}\n{broken\n')
    assert own.import_json("users", f"{tmp_path}/in.json") == {"imported": 1, "skipped": 2, "failed": 1}
    r = own.execute('mutation { import(collection: "users", data: [{id: "k", name: "again"}, {id: "m", name: "Mo"}]) { id } }')
    assert r.rows() == [{"id": "m"}] and r.status == "1 skipped"
    for kind in ("JSON", "CSV", "PARQUET"):
        own.execute(f'mutation {{ export(collection: "users", format: {kind}, path: "{tmp_path}/{kind}") {{ id }} }}')
        assert getattr(spark.read.option("header", True), kind.lower())(f"{tmp_path}/{kind}").count() == 4
    with pytest.raises(ValidationError):
        own.execute(f'mutation {{ export(collection: "users", format: EXCEL, path: "{tmp_path}/x") {{ id }} }}')


# ---------------------------------------------------------------- streams and jobs


def test_live_query(own, tmp_path):
    got = []
    watch = own.query("users").filter(lambda f: f.gt("age", 18)).watch()
    assert [r.sid for r in watch.snapshot().collect()] == ["a"]

    def drain(w=watch, at="c"):
        q = w.start(lambda b, i: got.extend((r.change, r.sid) for r in b.orderBy("seq", "sid").collect()), f"{tmp_path}/{at}", available_now=True)
        q.awaitTermination()
        out = list(got)
        got.clear()
        return out

    assert drain() == [("Added", "a")]
    own.execute('mutation { a: update(collection: "users", where: {id: {eq: "b"}}, data: {age: 40}) { id } b: update(collection: "users", where: {id: {eq: "a"}}, data: {age: 50}) { id } }')
    own.execute('mutation { a: update(collection: "users", where: {id: {eq: "a"}}, data: {age: 1}) { id } b: deleteFrom(collection: "users", where: {id: {eq: "b"}}) { id } }')
    assert sorted(drain()) == [("Added", "b"), ("Modified", "a"), ("Removed", "a"), ("Removed", "b")]
    assert drain() == []
    debounced = own.query("users").filter(lambda f: f.gt("age", 18)).debounce("1 second").watch()
    assert sorted(drain(debounced, "d")) == [("Removed", "a"), ("Removed", "b")]


def test_subscription(own, spark, tmp_path):
    r = own.execute('subscription { users(where: {age: {gt: 18}}) { name } }')
    q = r.frame.writeStream.format("memory").queryName("subscribed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/s").start()
    q.awaitTermination()
    assert [tuple(x) for x in spark.table("subscribed").select("change_type", "_sid", "name").collect()] == [("Insert", "a", "Ann")]


def test_event_filters(own):
    from fathom.streaming import feed

    own.execute('mutation { update(collection: "users", where: {id: {eq: "a"}}, data: {age: 31}) { id } }')
    c = own.catalog.get("users")
    events = own.changes()
    count = lambda x: feed.listen(events, c, x).count()
    assert (count(feed.of_type("Insert")), count(feed.field_changed("age")), count(feed.field_changed("name")), count(feed.has_field("email"))) == (2, 1, 0, 3)
    assert (count(feed.watching(["name"])), count(feed.watching(["age", "name"]))) == (2, 3)
    assert feed.listen(events).count() == 3


def test_handlers(own, tmp_path):
    own.execute("schema { define collection log { id: ID who: String what: String } }")
    own.execute('define handler "h" { on: "insert users", action: { insertInto(collection: "log", data: {id: $_id, who: $_name, what: "new"}) { id } } }')
    own.handlers.start(f"{tmp_path}/h", available_now=True).awaitTermination()
    assert sorted((r["id"], r["who"]) for r in rows(own, "{ log { id who } }")) == [("a", "Ann"), ("b", "Ben")]


def test_jobs(own):
    r = own.execute('mutation { a: enqueueJob(jobType: "mail", payload: {to: "x"}, priority: LOW) { id } b: enqueueJob(jobType: "mail", payload: {to: "y"}, priority: HIGH) { id } c: enqueueJob(jobType: "bad", maxRetries: 1) { id } }')
    assert r.affected == 3
    queue, seen = Queue(own), []
    queue.on("mail", lambda p: seen.append(p["to"]))
    queue.on("bad", lambda p: 1 / 0)
    assert queue.run() == 3 and seen == ["y", "x"]
    assert {x.status: x.n for x in queue.stats().collect()} == {"COMPLETED": 2, "DEAD": 1}


def test_prefix_and_stats(e):
    assert e.with_prefix("users", "u").count() == 3
    s = e.stats("users").first()
    assert s.documents == 3 and s.bytes > 0
    assert e.prewarm("users") == 3
    with pytest.raises(SyntaxProblem):
        e.execute("{ users { ")


def test_transactions_by_calls(own, spark):
    with own.transaction() as t:
        t.insert("users", {"id": "c", "name": "Cy"})
        t.execute('mutation { update(collection: "users", where: {id: {eq: "c"}}, data: {age: 7}) { id } }')
        assert t.frame("users").count() == 3 and "c" not in users(own)
    assert users(own)["c"]["age"] == 7
    with pytest.raises(ValidationError), own.transaction() as t:
        t.insert("users", {"id": "d", "name": "D"})
        t.insert("users", {"id": "d", "name": "again"})
    assert "d" not in users(own)
    assert own.insert_into("users", {"id": "e", "name": "E"}, {"id": "f", "name": "F"}) == 2
    own.create_index("users", "age")
    own.optimize("users")
    assert len(users(own)) == 5 and own.find_one("users", {"age": {"eq": 7}})["id"] == "c"
    assert {r["id"] for r in own.rows("users")} == {"a", "b", "c", "e", "f"}
    assert own.index_stats("users", "age").first()["rows"] == 5 and own.database_stats().count() == 1
