"""Stored collections: order, versions, writers, cursors and coded errors."""

import datetime as dt

import pytest

from sedge.commands import Client
from sedge.errors import QueryError
from sedge.operators.pipeline import aggregate
from sedge.sources import catalog as storage
from sedge.sources.catalog import Catalog


@pytest.fixture
def client(spark, tmp_path):
    return Client(Catalog(spark, f"file://{tmp_path}/data"), now=lambda: dt.datetime(2024, 5, 1))


def fill(client, name, start, n, **more):
    client.run("app", {"insert": name, "documents": [{"_id": i, "v": i % 3, **more} for i in range(start, start + n)]})


def every(client, reply, name):
    out, at = reply["cursor"]["firstBatch"], reply["cursor"]["id"]
    while at:
        more = client.run("app", {"getMore": at, "collection": name, "batchSize": 7})["cursor"]
        out, at = out + more["nextBatch"], more["id"]
    return out


def code(client, command):
    with pytest.raises(QueryError) as e:
        client.run("app", command)
    return e.value.code


def test_documents_come_in_the_order_of_insertion(client):
    fill(client, "c", 50, 3)
    fill(client, "c", 60, 200, pad="x" * 50)
    fill(client, "c", 0, 2)
    ids = [d["_id"] for d in every(client, client.run("app", {"find": "c", "batchSize": 5}), "c")]
    assert ids[:3] == [50, 51, 52] and len(ids) == len(set(ids))
    assert ids[-2:] == [0, 1] and ids[3:-2] == sorted(ids[3:-2])
    got = client.run("app", {"aggregate": "c", "pipeline": [{"$group": {"_id": None, "first": {"$first": "$_id"}, "last": {"$last": "$_id"}}}], "cursor": {}})
    assert got["cursor"]["firstBatch"] == [{"_id": None, "first": 50, "last": 1}] or got["cursor"]["firstBatch"] == [{"first": 50, "last": 1}]
    client.run("app", {"update": "c", "updates": [{"q": {"v": 1}, "u": {"$set": {"w": 1}}}]})
    assert [d["_id"] for d in client.run("app", {"find": "c", "filter": {"w": 1}})["cursor"]["firstBatch"]] == [52]
    client.run("app", {"delete": "c", "deletes": [{"q": {}, "limit": 1}]})
    assert client.run("app", {"find": "c", "batchSize": 1})["cursor"]["firstBatch"][0]["_id"] == 51
    kinds = client.run("app", {"aggregate": "c", "pipeline": [{"$group": {"_id": None, "vs": {"$addToSet": "$v"}}}, {"$project": {"_id": 0, "vs": 1}}], "cursor": {}})
    assert kinds["cursor"]["firstBatch"] == [{"vs": [0, 1, 2]}]


def test_find_without_sort_sorts_nothing_as_a_whole(client, spark):
    fill(client, "c", 0, 300)
    ids = [d["_id"] for d in every(client, client.run("app", {"find": "c", "filter": {"v": {"$ne": 1}}, "projection": {"_id": 1}}), "c")]
    assert ids == [i for i in range(300) if i % 3 != 1]


def test_a_cursor_reads_the_version_that_it_was_opened_on(client):
    fill(client, "c", 0, 400)
    found = client.run("app", {"find": "c", "batchSize": 5})
    made = client.run("app", {"aggregate": "c", "pipeline": [{"$match": {}}], "cursor": {"batchSize": 5}})
    for i in range(storage.KEPT + 2):
        client.run("app", {"delete": "c", "deletes": [{"q": {"_id": {"$lt": 100 * (i + 1)}}, "limit": 0}]})
    assert [d["_id"] for d in every(client, found, "c")] == list(range(400))
    assert [d["_id"] for d in every(client, made, "c")] == list(range(400))
    assert not client.catalog._pins and not client.catalog._stale
    left = client.catalog._children(f"{client.catalog.root}/app/c")
    assert len(left) <= storage.KEPT + 1


def test_manifests_are_never_replaced(client, monkeypatch):
    fill(client, "c", 0, 3)
    before = client.catalog.manifest("app", "c")
    # A crash between the new version and its manifest leaves the old one in place.
    with monkeypatch.context() as m:
        m.setattr(client.catalog, "_write_new", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            fill(client, "c", 10, 3)
    assert client.catalog.manifest("app", "c") == before and client.run("app", {"count": "c"})["n"] == 3
    fill(client, "c", 10, 3)
    assert client.run("app", {"count": "c"})["n"] == 6


def test_the_second_of_two_writers_fails(client, spark):
    fill(client, "c", 0, 3)
    other = Client(Catalog(spark, client.catalog.root))
    real = other.catalog.replace

    def late(*args, **more):
        fill(client, "c", 10, 1)
        return real(*args, **more)

    other.catalog.replace = late
    assert code(other, {"insert": "c", "documents": [{"_id": 20}]}) == 112
    assert client.run("app", {"count": "c"})["n"] == 4


def test_ints_outgrow_their_width_and_longs_fail_with_a_code(client):
    client.run("app", {"insert": "n", "documents": [{"_id": 1, "i": 2147483647, "l": 2**62, "z": 0}]})
    reply = client.run("app", {"update": "n", "updates": [{"q": {}, "u": {"$inc": {"i": 1}}}, {"q": {}, "u": {"$mul": {"l": 4}}}]})
    assert reply["nModified"] == 1 and reply["writeErrors"][0]["index"] == 1 and reply["writeErrors"][0]["code"] == 2
    assert client.run("app", {"find": "n"})["cursor"]["firstBatch"][0]["i"] == 2147483648
    assert code(client, {"aggregate": "n", "pipeline": [{"$project": {"x": {"$divide": ["$i", "$z"]}}}], "cursor": {}}) == 2


@pytest.mark.parametrize("name", ["store", "live", "manifest", "_init__", "hint", "workflow", "find ", ""])
def test_only_commands_are_commands(client, name):
    assert code(client, {name: 1}) == 59


def test_add_to_set_keeps_the_order_of_first_sight(spark):
    rows = [(i, i % 2, v) for i, v in enumerate([3, 1, 3, None, 2, 1, 1, 9, None, 3])]
    df = spark.createDataFrame(rows, "i int, g int, v int").repartition(4)
    got = aggregate(df, [{"$sort": {"i": 1}}, {"$group": {"_id": "$g", "vs": {"$addToSet": "$v"}, "n": {"$sum": 1}, "is": {"$addToSet": "$i"}}}]).collect()
    for r in got:
        own = [v for _, g, v in rows if g == r._id]
        assert r.vs == list(dict.fromkeys(own)) and r.n == len(own) and r["is"] == [i for i, g, _ in rows if g == r._id]


def test_lookup_then_unwind_is_a_join(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 5)], "_id int, k int")
    right = spark.createDataFrame([(i, k) for i, k in enumerate([5, None, 5, 8, None])], "_id int, k int")
    look = {"$lookup": {"from": "r", "localField": "k", "foreignField": "k", "as": "m"}}
    pairs = [(a, b) for a, k in [(1, 5), (2, None), (3, 7), (4, 5)] for b, x in enumerate([5, None, 5, 8, None]) if x == k]
    out = aggregate(left, [look, {"$unwind": "$m"}], lambda _: right, ordered=True)
    assert [(r._id, r.m._id) for r in out.sort("_id", "m._id").collect()] == pairs
    assert "collect_list" not in out._jdf.queryExecution().toString()
    kept = aggregate(left, [look, {"$unwind": {"path": "$m", "preserveNullAndEmptyArrays": True}}], lambda _: right)
    assert sorted((r._id, r.m and r.m._id) for r in kept.where("_id = 3 or m is not null").collect()) == sorted([*pairs, (3, None)])
    # Without the unwinding only keys that are asked for are gathered, the null key too.
    lists = aggregate(left, [look], lambda _: right)
    assert {r._id: [x._id for x in r.m] for r in lists.collect()} == {1: [0, 2], 2: [1, 4], 3: [], 4: [0, 2]}
    sorted_first = aggregate(left, [{"$sort": {"_id": -1}}, look, {"$unwind": "$m"}, {"$limit": 3}], lambda _: right, ordered=True)
    assert [(r._id, r.m._id) for r in sorted_first.collect()] == [(4, 0), (4, 2), (2, 1)]


def test_array_updates_follow_the_collation(client):
    client.run("app", {"insert": "a", "documents": [{"_id": 1, "tags": ["x", "X", "y"], "items": [{"k": "A", "n": 1}, {"k": "b", "n": 2}]}]})
    by = {"locale": "en", "strength": 2}
    client.run("app", {"update": "a", "updates": [
        {"q": {"_id": 1}, "u": {"$pull": {"tags": "x"}}, "collation": by}, {"q": {"$and": [{"items.k": "B"}]}, "u": {"$set": {"items.$.n": 9}}, "collation": by},
        {"q": {}, "u": {"$set": {"items.$[e].n": 7}}, "arrayFilters": [{"e.k": "a"}], "collation": by},
    ]})
    got = client.run("app", {"find": "a"})["cursor"]["firstBatch"][0]
    assert got["tags"] == ["y"] and [x["n"] for x in got["items"]] == [7, 9]


def test_null_is_not_missing(client):
    client.run("app", {"insert": "n", "documents": [{"_id": 1, "x": None}, {"_id": 2}, {"_id": 3, "x": 5, "d": {"y": None, "z": 1}}]})
    assert client.run("app", {"find": "n"})["cursor"]["firstBatch"] == [{"_id": 1, "x": None}, {"_id": 2}, {"_id": 3, "x": 5, "d": {"y": None, "z": 1}}]
    assert [d["_id"] for d in client.run("app", {"find": "n", "filter": {"x": {"$exists": True}}, "sort": {"_id": 1}})["cursor"]["firstBatch"]] == [1, 3]
    assert client.run("app", {"count": "n", "query": {"x": None}})["n"] == 2
    assert client.run("app", {"count": "n", "query": {"d.y": {"$exists": True}}})["n"] == 1
    reply = client.run("app", {"update": "n", "updates": [{"q": {"_id": 2}, "u": {"$set": {"x": None}}}, {"q": {"_id": 1}, "u": {"$set": {"x": 1}}}, {"q": {"_id": 3}, "u": {"$unset": {"x": ""}}}]})
    assert reply["nModified"] == 3
    assert client.run("app", {"find": "n", "projection": {"x": 1}})["cursor"]["firstBatch"] == [{"_id": 1, "x": 1}, {"_id": 2, "x": None}, {"_id": 3}]
    again = client.run("app", {"update": "n", "updates": [{"q": {"_id": 2}, "u": {"$set": {"x": None}}}]})
    assert (again["n"], again["nModified"]) == (1, 0)
    got = client.run("app", {"aggregate": "n", "pipeline": [{"$match": {"x": {"$exists": True}}}, {"$sort": {"_id": -1}}], "cursor": {}})
    assert got["cursor"]["firstBatch"] == [{"_id": 2, "x": None}, {"_id": 1, "x": 1}]


def test_a_sparse_unique_index_holds_explicit_nulls(client):
    index = {"createIndexes": "s", "indexes": [{"key": {"k": 1}, "unique": True, "sparse": True}]}
    client.run("app", {"insert": "s", "documents": [{"_id": 1, "k": "a"}, {"_id": 2}, {"_id": 3}, {"_id": 4, "k": None}]})
    client.run("app", index)
    assert client.run("app", {"insert": "s", "documents": [{"_id": 5, "k": None}]})["writeErrors"][0]["code"] == 11000
    assert client.run("app", {"insert": "s", "documents": [{"_id": 6}]})["n"] == 1
    client.run("app", {"insert": "t", "documents": [{"_id": 1, "k": None}, {"_id": 2, "k": None}, {"_id": 3, "k": "b"}]})
    assert code(client, {**index, "createIndexes": "t"}) == 11000


def test_required_fields_may_hold_null(client):
    client.run("app", {"create": "v", "validator": {"$jsonSchema": {"bsonType": "object", "required": ["a"], "properties": {"b": {"bsonType": "string"}, "c": {"bsonType": ["string", "null"]}}}}})
    assert client.run("app", {"insert": "v", "documents": [{"_id": 1, "a": None, "c": None, "b": "x"}, {"_id": 2, "a": "x"}]})["n"] == 2
    assert client.run("app", {"insert": "v", "documents": [{"_id": 3, "b": "x"}]})["writeErrors"][0]["code"] == 121
    assert client.run("app", {"insert": "v", "documents": [{"_id": 4, "a": "y", "b": None}]})["writeErrors"][0]["code"] == 121
