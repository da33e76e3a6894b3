"""Document operators on small literal tables: worked examples and edge cases."""

import math
from decimal import Decimal

import pytest

from bramble.operators import index as ix
from bramble.operators import zmap
from bramble.operators.bucket import Bucket, Catalog
from bramble.operators.project import project
from bramble.operators.stash import Stash
from bramble.operators.update import update
from bramble.operators.vector import vector_search
from bramble.plans.bql import BqlError
from bramble.streaming import changelog


@pytest.fixture(scope="module")
def sensors(spark):
    return Bucket("sensors", spark.createDataFrame([("temp-01", [22, 45, 52]), ("temp-02", [78, 82, 95]), ("temp-03", [60, 65, 70])], "_id string, readings array<int>"))


@pytest.mark.parametrize(
    "condition, ids",
    [({"$gt": 80}, "2"), ({"$gte": 50, "$lte": 70}, "13"), ({"$eq": 45}, "1"), ({"$ne": 78}, "123"), ({"$in": [22, 60, 95]}, "123"), ({"$or": [{"$gt": 90}, {"$lt": 25}]}, "12"), ({}, "123")],
)
def test_scalar_elements(sensors, condition, ids):
    assert "".join(sorted(r._id[-1] for r in sensors.find({"readings": {"$elemMatch": condition}}).collect())) == ids


@pytest.fixture(scope="module")
def orders(spark):
    ddl = "_id string, items array<struct<product:string,category:string,price:double,status:string,tags:array<string>,discount:int>>"
    return Bucket(
        "orders",
        spark.createDataFrame(
            [
                ("Alice", [("Headphones", "electronics", 79.99, "shipped", ["sale", "new"], None), ("Novel", "books", 14.99, "delivered", ["bestseller"], None)]),
                ("Bob", [("Laptop", "electronics", 999.99, "processing", ["sale", "new", "featured"], None), ("Mouse", "electronics", 29.99, "cancelled", ["sale"], None)]),
                ("Carol", [("Desk", "furniture", 249.99, "shipped", ["new"], 15)]),
            ],
            ddl,
        ),
    )


@pytest.mark.parametrize(
    "condition, ids",
    [
        ({"price": {"$gt": 100}}, "BC"), ({"category": "electronics", "price": {"$gt": 100}}, "B"), ({"status": {"$ne": "cancelled"}}, "ABC"),
        ({"discount": {"$exists": True}}, "C"), ({"tags": {"$all": ["sale", "new"]}}, "AB"), ({"tags": {"$size": 1}}, "ABC"), ({"tags": {"$elemMatch": {"$regex": "^feat"}}}, "B"),
    ],
)
def test_document_elements(orders, condition, ids):
    assert "".join(sorted(r._id[0] for r in orders.find({"items": {"$elemMatch": condition}}).collect())) == ids


def test_paths(spark):
    rows = spark.createDataFrame([("x", [([("Alpha",), ("Beta",)],), ([("Gamma",)],)], [95, 87])], "_id string, departments array<struct<teams:array<struct<name:string>>>>, scores array<int>")
    b = Bucket("paths", rows)
    for query, n in [({"departments.teams.name": "Gamma"}, 1), ({"departments.teams.name": {"$size": 3}}, 1), ({"scores.1": 87}, 1), ({"scores.5": None}, 1), ({"scores.x": {"$exists": False}}, 1), ({"_id.first": 1}, 0)]:
        assert b.find(query).count() == n, query


def test_projection(orders):
    one = lambda spec, query=None: orders.query(query or {"_id": "Bob"}, projection=spec).collect()[0].asDict(recursive=True)
    assert one({"items.product": 1}) == {"_id": "Bob", "items": [{"product": "Laptop"}, {"product": "Mouse"}]}
    assert set(one({"items.tags": 0, "items.price": 0})["items"][0]) == {"product", "category", "status", "discount"}
    assert one({"items": {"$slice": -1}})["items"][0]["product"] == "Mouse"
    assert one({"items": {"$slice": [1, 5]}})["items"][0]["product"] == "Mouse"
    assert one({"items.$": 1}, {"items.status": "cancelled"})["items"][0]["product"] == "Mouse"
    assert len(one({"items.$": 1}, {"_id": "Bob"})["items"]) == 1
    assert one({"_id": 1}) == {"_id": "Bob"} and "_id" not in one({"_id": 0})
    for bad in ({"items": 1, "_id": 1, "x": 0}, {"a.$": 1, "b.$": 1}, {"items": {"$foo": 1}}, {"items": 1, "items.product": 1}, {"items": {"$slice": [0, 0]}}, {"a.$.b": 1}):
        with pytest.raises(BqlError):
            project(orders.table, bad)


def test_updates(spark, orders):
    def after(query, spec, row="Bob"):
        return update(orders.table, query, spec).table.where(f"_id = '{row}'").collect()[0].asDict(recursive=True)

    assert [i["price"] for i in after({"_id": "Bob"}, {"$set": {"items.$[].price": 1.0}})["items"]] == [1.0, 1.0]
    assert [i["status"] for i in after({"items.status": "cancelled"}, {"$set": {"items.$.status": "open"}})["items"]] == ["processing", "open"]
    assert [i["product"] for i in after({}, {"$unset": ["items.$[x]"], "array_filters": [{"x.price": {"$lt": 100}}]})["items"]] == ["Laptop"]
    assert after({"_id": "Bob"}, {"$unset": ["items.$[]"]})["items"] == []
    assert after({"items.product": "Mouse"}, {"$unset": ["items.$"]})["items"][1] is None
    assert len(after({"_id": "Bob"}, {"$unset": ["items.5"]})["items"]) == 2 and len(after({"_id": "Bob"}, {"$unset": ["items.0"]})["items"]) == 1
    assert after({"_id": "Bob"}, {"$set": {"a.b": 5}})["a"] == {"b": 5}
    changed = update(orders.table, {"items.category": "electronics"}, {"$set": {"items.$[].status": "shipped"}}).ids
    assert sorted(r[0] for r in changed.collect()) == ["Alice", "Bob"]
    assert update(orders.table, {"_id": "Bob"}, {"$set": {"items.0.status": "processing"}}).ids.count() == 0
    done = update(orders.table, {"_id": "Dan"}, {"$set": {"items": []}, "upsert": True}, new_id="x")
    assert done.table.count() == 4 and done.ids.collect()[0][0] == "Dan"
    for bad in ({"$set": {"_id": 1}}, {"$inc": {"a": 1}}, {}, {"$set": {"items.$[q].price": 1.0}}, {"$set": {"items.$.price": 1.0}, "upsert": True}, {"$set": {"items": 5}}):
        with pytest.raises(BqlError):
            update(orders.table, {}, bad)


def test_nested_document_update(spark):
    table = spark.createDataFrame([(1, (1, ("x",))), (2, None)], "_id int, o struct<a:int,p:struct<q:string>>")
    rows = {r._id: r.o for r in update(table, {}, {"$set": {"o.p.q": "y"}}).table.collect()}
    assert rows[1].p.q == "y" and rows[1].a == 1 and rows[2].p.q == "y" and rows[2].a is None
    rows = {r._id: r.o for r in update(table, {}, {"$unset": ["o.a"]}).table.collect()}
    assert rows[1].a is None and rows[1].p.q == "x" and rows[2] is None


def test_bucket_session(spark):
    session = Catalog(spark).session()
    session.namespace_create("a.b")
    session.namespace_use("a.b")
    table = spark.createDataFrame([(f"{i:03d}", i % 5, None if i % 7 == 0 else i) for i in range(50)], "_id string, g int, v int")
    session.create("t", table, indexes={"v": {"bson_type": "int32"}, "$compound": {"fields": [{"selector": "g", "bson_type": "int32"}, {"selector": "v", "bson_type": "int32"}], "name": "gv"}})
    assert session.list_buckets() == ["t"] and session.namespace_list("a") == ["b"]
    cursor = session.open_cursor("t", {"g": {"$lt": 4}}, sort_by=("v", "DESC"), limit=7)
    seen = []
    while page := session.advance("QUERY", cursor):
        seen += [(r.v, r._id) for r in page]
    want = sorted(((r.v, r._id) for r in table.collect() if r.g < 4), key=lambda x: (x[0] is not None, x[0] or 0, x[1]), reverse=True)
    assert seen == want
    session.close("QUERY", cursor)
    with pytest.raises(BqlError):
        session.advance("QUERY", cursor)
    b = session.bucket("t")
    b.check_sort(b.tree({"g": 1}), "v")
    with pytest.raises(BqlError):
        b.query({}, sort_by=("w", "ASC"), strict_sort=True)
    with pytest.raises(BqlError):
        b.query({}, sort_by=("v", "ASC"), result_sort=("v", "DESC"))
    with pytest.raises(BqlError):
        b.create_index({"g": {"bson_type": "int32", "unique": True, "name": "u"}})
    with pytest.raises(BqlError):
        b.create_index({"g": {"bson_type": "string", "name": "s"}})
    assert "EQ g 1" in b.explain({"g": 1})
    session.begin()
    session.delete("t", {"g": 1})
    assert session.bucket("t").table.count() == 40
    session.rollback()
    assert session.bucket("t").table.count() == 50
    session.begin()
    session.update("t", {"g": 2}, {"$set": {"v": 0}}, limit=3, sort_by=("v", "ASC"))
    other = session.catalog.session()
    other.namespace_use("a.b")
    other.insert("t", [{"g": 9}])
    with pytest.raises(BqlError):
        session.commit()
    assert session.bucket("t").table.where("g = 9 AND length(_id) = 24").count() == 1
    session.namespace_move("a.b", "a.c")
    session.namespace_remove("a.c")
    assert not session.namespace_exists("a.c")
    session.namespace_purge("a.c")
    assert session.namespace_list("a") == []


def test_vector(spark):
    table = spark.createDataFrame([(1, [0.1, 0.2, 0.3], "a"), (2, [0.9, 0.1, 0.0], "b"), (3, [0.0, 0.0, 0.0], "a"), (4, [1.0, 2.0], "a")], "_id int, e array<double>, l string")
    found = vector_search(table, "e", [0.4, 0.5, 0.6]).collect()
    assert [r._id for r in found] == [1, 2] and math.isclose(found[0]._score, 0.98731589, rel_tol=1e-5)
    assert [r._id for r in vector_search(table, "e", [0.4, 0.5, 0.6], query={"l": "b"}).collect()] == [2]
    assert [r._id for r in vector_search(table, "e", [0.9, 0.1, 0.0], distance="EUCLIDEAN", threshold=0.9).collect()] == [2]
    for bad in ([], [float("nan")], [True, 1, 1]):
        with pytest.raises(BqlError):
            vector_search(table, "e", bad)
    with pytest.raises(BqlError):
        vector_search(table, "e", [1.0, 2.0], dimensions=3)


def test_histogram(spark):
    rows = ix.histogram(spark.createDataFrame([(i % 23,) for i in range(100)], "v int"), "v").orderBy("bucket").collect()
    assert sum(r.distinct_values for r in rows) == 23 and [r.bucket for r in rows] == list(range(1, 11))
    assert all(a.high < b.low for a, b in zip(rows, rows[1:]))
    assert ix.histogram(spark.createDataFrame([], "v int"), "v").count() == 0


def test_zmap(spark):
    m = zmap.of(spark, {"a": "1", "b": "2", "d": "4"})
    keys = lambda df: [k.decode() for k, _ in zmap.rows(df)]
    assert keys(zmap.get_range(m, "a", "b")) == ["a", "b"]
    assert keys(zmap.get_range(m, "a", "c", end_selector="LAST_LESS_THAN")) == ["a"]
    assert keys(zmap.get_range(m, "c", "*", begin_selector="LAST_LESS_OR_EQUAL")) == ["b", "d"]
    assert keys(zmap.delete_range(m, "*", "b")) == ["b", "d"] and keys(zmap.delete(m, "b")) == ["a", "d"]
    m = zmap.put_i64(m, "n", 2**63 - 1)
    m = zmap.increment_i64(m, spark.createDataFrame([(bytearray(b"n"), 2), (bytearray(b"new"), -5)], "key binary, delta bigint"))
    assert zmap.get_i64(m, "n").first()[0] == -(2**63) + 1 and zmap.get_i64(m, "new").first()[0] == -5
    m = zmap.increment_f64(zmap.put_f64(m, "f", -0.0), "f", 1.5)
    assert zmap.get_f64(m, "f") == 1.5
    for x in (Decimal("1.50"), Decimal("-7E+100"), Decimal("0"), Decimal(10**33)):
        assert zmap.decode_d128(zmap.encode_d128(x)) == x
    assert zmap.get_d128(zmap.increment_d128(m, "dec", Decimal("2.5")), "dec") == Decimal("2.5")
    with pytest.raises(BqlError):
        zmap.encode_f64(math.inf)
    batch = spark.createDataFrame([(bytearray(b"a"), bytearray(b"x")), (bytearray(b"z"), bytearray(b"y"))], "key binary, param binary")
    assert dict(zmap.rows(zmap.mutate(m, batch, "APPEND_IF_FITS")))[b"a"] == b"1x"
    assert dict(zmap.rows(zmap.mutate(m, batch, "BYTE_MAX")))[b"a"] == b"x"
    numbers = spark.createDataFrame([(bytearray(b"a"), 2**63 - 1), (bytearray(b"b"), -1)], "key binary, value bigint")
    more = spark.createDataFrame([(bytearray(b"a"), 1), (bytearray(b"b"), 5), (bytearray(b"c"), 3)], "key binary, param bigint")
    found = lambda kind: {bytes(r.key): r.value for r in zmap.mutate(numbers, more, kind).collect()}
    assert found("ADD") == {b"a": -(2**63), b"b": 4, b"c": 3} and found("MAX")[b"b"] == -1 and found("MIN")[b"b"] == 5
    clear = spark.createDataFrame([(bytearray(b"a"), bytearray(b"1")), (bytearray(b"b"), bytearray(b"9"))], "key binary, param binary")
    assert {k for k, _ in zmap.rows(zmap.mutate(m, clear, "COMPARE_AND_CLEAR"))} == {b"b", b"d", b"n", b"new", b"f"}
    stamp = spark.createDataFrame([(bytearray(b"s"), bytearray(b"\0" * 10 + b"tail"))], "key binary, param binary")
    assert dict(zmap.rows(zmap.mutate(m, stamp, "SET_VERSIONSTAMPED_VALUE", b"0123456789")))[b"s"] == b"0123456789tail"


def test_stash(spark):
    now = [1_000_000]
    s = Stash(spark, clock=lambda: now[0])
    assert s.set("k", "abc") == "OK" and s.get("k") == b"abc" and s.getrange("k", -2, -1) == b"bc" and s.getrange("k", 0, 0) == b"a"
    assert s.setrange("k", 5, "z") == 6 and s.get("k") == b"abc\0\0z"
    assert s.incr("n") == 1 and s.decrby("n", 5) == -4 and s.incrbyfloat("x", 1.5) == 1.5
    with pytest.raises(BqlError):
        s.incr("k")
    assert s.setex("t", 10, "v") == "OK" and s.ttl("t") == 10 and s.expire("t", 5, "GT") == 0 and s.expire("t", 5, "LT") == 1
    now[0] += 6000
    assert s.get("t") is None and s.ttl("t") == -2 and s.ttl("k") == -1
    assert s.hset("h", {"a": 1, "b": 2}) == 2 and s.hincrby("h", "a", 4) == 5 and s.hmget("h", "a", "q") == [b"5", None] and s.hdel("h", "a", "q") == 1
    assert s.type("h") == "hash" and s.hlen("h") == 1 and s.exists("h", "h", "zz") == 2
    with pytest.raises(BqlError):
        s.get("h")
    assert s.msetnx({"k": 1, "new": 2}) == 0 and s.mget("k", "h", "zz") == [b"abc\0\0z", None, None]
    assert s.renamenx("k", "n") == 0 and s.rename("k", "kk") == "OK" and s.get("kk") == b"abc\0\0z"
    cursor, found = 0, []
    while True:
        cursor, keys = s.scan(cursor, 2)
        found += keys
        if not cursor:
            break
    assert sorted(found) == ["h", "kk", "n", "x"]
    s.watch("n")
    s.multi()
    s.queue("incr", "n")
    s.set("n", 7)
    assert s.exec() is None and s.get("n") == b"7"
    s.multi()
    s.queue("incr", "n")
    assert s.exec() == [8]
    assert s.cluster_keyslot("123456789") == 12739
    assert s.flushdb() == "OK" and s.randomkey() is None


def test_change_log_streaming(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = lambda *r: spark.createDataFrame([(n, op, bytearray(k), bytearray(v) if v else None) for n, op, k, v in r], changelog.DDL)
    rows((1, "SET", b"a", b"1"), (2, "SET", b"b", b"2")).write.parquet(path)
    target = {}

    def apply(batch, number):
        for r in batch.collect():
            if r.op == "SET":
                target[bytes(r.key)] = bytes(r.value)
            else:
                target.pop(bytes(r.key), None)

    run = lambda: changelog.replicate(changelog.read_changes(spark, path), apply, f"{tmp_path}/checkpoint").awaitTermination()
    run()
    assert target == {b"a": b"1", b"b": b"2"}
    rows((3, "SET", b"a", b"9"), (4, "DELETE", b"b", None), (5, "SET", b"a", b"7")).write.mode("append").parquet(path)
    run()
    assert target == {b"a": b"7"}
    journal = lambda: spark.read.parquet(path)
    consumer = changelog.Consumer(spark, journal, f"{tmp_path}/offsets", "EARLIEST")
    assert [r.seq for r in consumer.poll(2)] == [1, 2]
    consumer.commit()
    assert [r.seq for r in changelog.Consumer(spark, journal, f"{tmp_path}/offsets").poll()] == [3, 4, 5]
    assert changelog.Consumer(spark, journal, f"{tmp_path}/offsets", "LATEST").poll() == []
    assert changelog.watch(journal(), b"b").count() == 2


def test_numeric_collation_of_long_numbers(spark):
    rows = Bucket("t", spark.createDataFrame([(1, "a123456789012345678901"), (2, "a123456789012345678905"), (3, "a99999999999999999999"), (4, "a100000000000000000000"), (5, "a007"), (6, "a7b"), (7, "a10")], "_id int, s string"))
    numeric = {"locale": "en", "numeric_ordering": True}
    found = lambda q: sorted(r._id for r in rows.find({"s": q}, numeric).collect())
    assert found("a123456789012345678901") == [1] and found("a7") == [5]
    assert found({"$gt": "a99999999999999999999"}) == [1, 2, 4] and found({"$lt": "a10"}) == [5, 6]


def test_unique_index_on_schemaless_documents(spark):
    session = Catalog(spark).session()
    session.create("u", dynamic=True)
    session.insert("u", [{"_id": "1", "email": "a", "at": {"$date": "2024-01-01T00:00:00Z"}}, {"_id": "2", "email": "b"}, {"_id": "3", "email": 7}])
    unique = session.bucket("u").create_index({"email": {"bson_type": "string", "unique": True}}, strict_types=False)
    session._put(unique)
    with pytest.raises(BqlError, match="duplicate"):
        session.insert("u", [{"_id": "4", "email": "a"}])
    with pytest.raises(BqlError, match="duplicate"):
        session.insert("u", [{"_id": "1", "email": "z"}])
    with pytest.raises(BqlError, match="duplicate"):
        session.insert("u", [{"_id": "8", "email": "q"}, {"_id": "9", "email": "q"}])
    with pytest.raises(BqlError, match="duplicate"):
        session.update("u", {"email": "b"}, {"$set": {"email": "a"}})
    session.insert("u", [{"_id": "5", "email": "7"}])
    assert session.bucket("u").table.count() == 4
    with pytest.raises(BqlError, match="type mismatch"):
        unique.create_index({"email": {"bson_type": "string", "name": "strict"}})
    strict = session.bucket("u").create_index({"at": {"bson_type": "datetime"}})
    with pytest.raises(BqlError, match="type mismatch"):
        strict.insert([{"_id": "6", "email": "n", "at": "soon"}])
    assert strict.insert([{"_id": "6", "email": "n", "at": {"$date": "2024-01-02T00:00:00Z"}}]).find({"at": {"$gt": {"$date": "2024-01-01T12:00:00Z"}}}).count() == 1
    assert strict.index_tasks("at") == [{"kind": "BUILD", "index": "at", "status": "COMPLETED", "processed": 4}]


def test_change_cursors(spark):
    session = Catalog(spark).session()
    session.create("t", spark.createDataFrame([(f"{i:02d}", i % 2, i) for i in range(20)], "_id string, g int, v int"))
    update = session.open_cursor("t", {"g": 1}, "UPDATE", {"$set": {"g": 5}}, limit=4, sort_by=("v", "DESC"))
    assert session.advance("UPDATE", update) == ["13", "15", "17", "19"]
    assert session.advance("UPDATE", update) == ["05", "07", "09", "11"]
    assert session.advance("UPDATE", update) == ["01", "03"] and session.advance("UPDATE", update) == []
    still = session.open_cursor("t", {"v": {"$gte": 0}}, "UPDATE", {"$set": {"w": 1}}, limit=15)  # rows go on matching
    assert len(session.advance("UPDATE", still)) == 15 and len(session.advance("UPDATE", still)) == 5 and session.advance("UPDATE", still) == []
    delete = session.open_cursor("t", {"g": 5}, "DELETE", limit=6)
    assert len(session.advance("DELETE", delete)) == 6 and len(session.advance("DELETE", delete)) == 4 and session.advance("DELETE", delete) == []
    assert sorted((r.g, r.w) for r in session.bucket("t").table.collect()) == [(0, 1)] * 10
    assert session.list_cursors("DELETE") == {"DELETE": [delete]}
    with pytest.raises(BqlError):
        session.open_cursor("t", {}, "UPDATE")
    session.close_session()
    assert session.list_cursors() == {"QUERY": [], "UPDATE": [], "DELETE": []}


def test_conflicts_are_by_bucket(spark):
    catalog = Catalog(spark)
    one, two = catalog.session(), catalog.session()
    for name in ("a", "b"):
        one.create(name, spark.createDataFrame([(1, 1)], "_id int, v int"))
    one.begin()
    one.update("a", {}, {"$set": {"v": 2}})
    two.update("b", {}, {"$set": {"v": 3}})
    assert one.commit("VERSIONSTAMP") == f"{catalog.version:020x}"
    one.begin()
    one.snapshot_read()
    one.bucket("b")
    one.snapshot_read(False)
    one.update("a", {}, {"$set": {"v": 4}})
    two.update("b", {}, {"$set": {"v": 5}})
    one.commit()
    one.begin()
    one.bucket("b")
    one.update("a", {}, {"$set": {"v": 6}})
    two.update("b", {}, {"$set": {"v": 7}})
    with pytest.raises(BqlError, match="conflict"):
        one.commit()
    assert one.bucket("a").table.first().v == 4 and one.approximate_size() > 0
    with pytest.raises(BqlError):
        one.set_attribute("reply_type", "xml")
    one.set_attribute("reply_type", "json_text")
    assert one.query("a", {"v": 4}).first()[0] == '{"_id":1,"v":4}'


def test_appends_in_order(spark):
    m = zmap.of(spark, {"x": "", "big": "b" * (zmap.MOST_VALUE - 3), "q": "1"})
    batch = spark.createDataFrame([(bytearray(k.encode()), bytearray(v.encode()), n) for k, v, n in [("x", "z", 1), ("x", "a", 2), ("big", "1234", 1), ("big", "ab", 2), ("big", "cd", 3), ("big", "e", 4), ("new", "n", 1)]], "key binary, param binary, seq int")
    got = dict(zmap.rows(zmap.mutate(m, batch, "APPEND_IF_FITS")))
    assert got[b"x"] == b"za" and got[b"big"] == b"b" * (zmap.MOST_VALUE - 3) + b"abe" and got[b"new"] == b"n" and got[b"q"] == b"1"
    stamps = spark.createDataFrame([(bytearray(b"s"), bytearray(b".........." + v), n) for v, n in [(b"zz", 1), (b"aa", 2)]], "key binary, param binary, seq int")
    assert dict(zmap.rows(zmap.mutate(m, stamps, "SET_VERSIONSTAMPED_VALUE", b"0123456789")))[b"s"] == b"0123456789aa"


def test_scan_sees_every_loaded_key(spark):
    s = Stash(spark, checkpoint_every=3)
    s.bulk_load(spark.createDataFrame([(f"k{i}", str(i)) for i in range(9)], "key string, value string").repartition(3))
    s.set("z", 1)
    s.bulk_load(spark.createDataFrame([("k1", "new"), ("y", "2")], "key string, value string"))
    cursor, found = 0, []
    while True:
        cursor, keys = s.scan(cursor, 2)
        found += keys
        if not cursor:
            break
    assert sorted(found) == sorted([*(f"k{i}" for i in range(9)), "y", "z"])
    with pytest.raises(BqlError):
        s.bulk_incrby(spark.createDataFrame([("k1", 1)], "key string, delta long"))
    with pytest.raises(BqlError):
        s.bulk_hset(spark.createDataFrame([("k1", "f", "v")], "key string, field string, value string"))
    assert s.cluster_slots()[0][:2] == [0, 16383] and s.cluster_myid() in s.cluster_nodes()


def test_sampled_statistics(spark):
    rows = spark.range(20_000).selectExpr("id AS _id", "id % 97 AS v")
    hints = ix.sample_hints(rows, "v", mask=0xF)
    assert 800 < hints.count() < 1800
    sampled = ix.sampled_histogram(rows, "v", 5, mask=0xF).collect()
    assert sum(r.distinct_values for r in sampled) == 97 and min(r.low for r in sampled) == 0


def test_overquery_is_checked(spark):
    b = Bucket("v", spark.createDataFrame([(1, [0.1, 0.2])], "_id int, e array<double>"))
    assert b.vector("e", [0.1, 0.2], overquery=2).count() == 1
    for wrong in (0.5, True, "x"):
        with pytest.raises(BqlError):
            b.vector("e", [0.1, 0.2], overquery=wrong)
