import datetime as dt
import uuid

import pytest

from sedge.commands import Client
from sedge.errors import QueryError
from sedge.sources.catalog import Catalog

NOW = dt.datetime(2024, 5, 1)


@pytest.fixture
def client(spark, tmp_path):
    return Client(Catalog(spark, f"file://{tmp_path}/data"), now=lambda: NOW)


def rows(reply):
    return reply["cursor"]["firstBatch"]


def code(client, command, db="app"):
    with pytest.raises(QueryError) as e:
        client.run(db, command)
    return e.value.code


def test_insert_find_update_delete(client):
    people = [{"_id": "a", "name": "Ann", "age": 30, "tags": ["x", "y"]}, {"_id": "b", "name": "Bo", "age": 40}, {"_id": "c", "name": "Cy", "tags": ["x"]}]
    assert client.run("app", {"insert": "people", "documents": people})["n"] == 3
    again = client.run("app", {"insert": "people", "documents": [{"_id": "a", "name": "Zed"}, {"_id": "d", "name": "Di"}], "ordered": False})
    assert again["n"] == 1 and again["writeErrors"][0]["code"] == 11000
    got = rows(client.run("app", {"find": "people", "filter": {"tags": "x"}, "sort": {"name": -1}, "projection": {"name": 1, "_id": 0}}))
    assert got == [{"name": "Cy"}, {"name": "Ann"}]
    up = client.run("app", {"update": "people", "updates": [{"q": {"age": {"$gte": 30}}, "u": {"$inc": {"age": 1}}, "multi": True}, {"q": {"_id": "z"}, "u": {"$set": {"name": "Zo"}}, "upsert": True}]})
    assert (up["n"], up["nModified"], up["upserted"]) == (3, 2, [{"index": 1, "_id": "z"}])
    assert client.run("app", {"count": "people", "query": {"age": 31}})["n"] == 1
    assert client.run("app", {"delete": "people", "deletes": [{"q": {"name": {"$regex": "^[AB]"}}, "limit": 0}]})["n"] == 2
    assert client.run("app", {"distinct": "people", "key": "name"})["values"] == ["Cy", "Di", "Zo"]
    same = client.run("app", {"update": "people", "updates": [{"q": {"_id": "c"}, "u": {"$set": {"name": "Cy"}}}]})
    assert (same["n"], same["nModified"]) == (1, 0)


def test_find_and_modify(client):
    client.run("app", {"insert": "jobs", "documents": [{"_id": i, "p": p, "state": "new"} for i, p in enumerate((3, 9, 5))]})
    got = client.run("app", {"findAndModify": "jobs", "query": {"state": "new"}, "sort": {"p": -1}, "update": {"$set": {"state": "run"}}, "new": True})
    assert got["value"] == {"_id": 1, "p": 9, "state": "run"}
    assert client.run("app", {"findAndModify": "jobs", "query": {"state": "new"}, "sort": {"p": 1}, "remove": True, "fields": {"p": 1, "_id": 0}})["value"] == {"p": 3}
    assert client.run("app", {"findAndModify": "jobs", "query": {"_id": 77}, "update": {"$set": {"p": 1}}, "upsert": True, "new": True})["value"] == {"_id": 77, "p": 1}
    assert code(client, {"findAndModify": "jobs", "query": {}, "remove": True, "update": {"$set": {"p": 1}}}) == 9
    assert code(client, {"findAndModify": "jobs", "findandmodify": "jobs", "remove": True}) == 9


def test_catalog_lifecycle(client):
    client.run("app", {"create": "empty"})
    client.run("other", {"create": "x"})
    assert [d["name"] for d in client.run("admin", {"listDatabases": 1})["databases"]] == ["app", "other"]
    assert code(client, {"create": "more", "capped": True}) == 72
    client.run("app", {"drop": "empty"})
    client.run("other", {"dropDatabase": 1})
    assert client.run("admin", {"listDatabases": 1})["databases"] == []
    assert client.run("app", {"ping": 1}) == {"ok": 1.0} and client.run("app", {"hello": 1})["isWritablePrimary"]
    assert code(client, {"collStats": "x"}) == 59 and code(client, {"collMod": "x", "validator": {}}) == 26


def test_cursors(client):
    client.run("app", {"insert": "n", "documents": [{"_id": i} for i in range(5)]})
    first = client.run("app", {"find": "n", "sort": {"_id": 1}, "batchSize": 2})["cursor"]
    assert [r["_id"] for r in first["firstBatch"]] == [0, 1] and first["id"] > 0
    more = client.run("app", {"getMore": first["id"], "collection": "n", "batchSize": 2})["cursor"]
    assert [r["_id"] for r in more["nextBatch"]] == [2, 3]
    assert code(client, {"getMore": first["id"], "collection": "n", "batchSize": 0}) == 9
    assert client.run("app", {"killCursors": "n", "cursors": [first["id"], 999]})["cursorsNotFound"] == [999]
    assert code(client, {"getMore": first["id"], "collection": "n"}) == 43
    assert code(client, {"aggregate": "n", "pipeline": [], "cursor": {"batchSize": 0}}) == 9


def test_indexes_constraints_and_expiry(client):
    client.run("app", {"insert": "u", "documents": [{"_id": 1, "email": "a", "at": NOW - dt.timedelta(hours=2)}, {"_id": 2, "email": "b", "at": NOW}, {"_id": 3}]})
    client.run("app", {"createIndexes": "u", "indexes": [{"key": {"email": 1}, "unique": True}, {"key": {"at": 1}, "expireAfterSeconds": 3600}]})
    assert [i["name"] for i in rows(client.run("app", {"listIndexes": "u"}))] == ["_id_", "email_1", "at_1"]
    assert [r["_id"] for r in rows(client.run("app", {"find": "u"}))] == [2, 3]
    assert client.run("app", {"insert": "u", "documents": [{"_id": 9, "email": "b"}]})["writeErrors"][0]["code"] == 11000
    assert client.run("app", {"insert": "u", "documents": [{"_id": 9}]})["writeErrors"][0]["code"] == 11000  # missing equals missing
    assert client.run("app", {"update": "u", "updates": [{"q": {"_id": 3}, "u": {"$set": {"email": "b"}}}]})["writeErrors"][0]["code"] == 11000
    assert client.run("app", {"collMod": "u", "index": {"name": "at_1", "expireAfterSeconds": 5}})["expireAfterSeconds_old"] == 3600
    assert code(client, {"createIndexes": "u", "indexes": [{"key": {"email": 1}, "sparse": True}]}) == 85
    assert code(client, {"createIndexes": "u", "indexes": [{"key": {"t": "text"}}]}) == 72
    assert code(client, {"dropIndexes": "u", "index": "_id_"}) == 67
    assert code(client, {"find": "u", "hint": "nope"}) == 2
    plan = client.run("app", {"find": "u", "filter": {"email": "b"}, "explain": True})["queryPlanner"]["winningPlan"]
    assert (plan["indexName"], plan["scanStrategy"], plan["prefixLen"]) == ("email_1", "exact", 1)
    client.run("app", {"dropIndexes": "u", "index": "email_1"})
    assert client.run("app", {"insert": "u", "documents": [{"_id": 9, "email": "b"}]})["n"] == 1


def test_validation(client):
    spec = {"$jsonSchema": {"bsonType": "object", "required": ["name"], "properties": {"name": {"bsonType": "string"}, "profile": {"bsonType": "object", "required": ["city"]}}}}
    client.run("app", {"create": "v", "validator": spec})
    assert client.run("app", {"insert": "v", "documents": [{"_id": 1}]})["writeErrors"][0]["code"] == 121
    assert client.run("app", {"insert": "v", "documents": [{"_id": 1, "name": "a", "profile": {"city": "x"}}]})["n"] == 1
    assert client.run("app", {"update": "v", "updates": [{"q": {}, "u": {"$unset": {"name": 1}}}]})["writeErrors"][0]["code"] == 121
    assert client.run("app", {"update": "v", "updates": [{"q": {}, "u": {"$unset": {"name": 1}}}], "bypassDocumentValidation": True})["nModified"] == 1
    assert code(client, {"collMod": "v", "validationLevel": "moderate"}) == 72
    client.run("app", {"collMod": "v", "validator": {}})
    assert client.run("app", {"insert": "v", "documents": [{"_id": 2}]})["n"] == 1


def test_workflow(client):
    session = {"id": uuid.uuid4()}
    command = {"insert": "w", "documents": [{"_id": 1}], "lsid": session, "txnNumber": 1}
    assert client.run("app", command) == client.run("app", command) == {"n": 1, "ok": 1.0}
    assert code(client, {**command, "documents": [{"_id": 2}]}) == 72
    assert code(client, {"find": "w", "readConcern": {"level": "snapshot"}}) == 72
    assert code(client, {"insert": "w", "documents": [{}], "writeConcern": {"w": 0}}) == 72
    assert code(client, {"find": "w", "startTransaction": True}) == 72
    assert code(client, {"find": "w", "lsid": {"id": 5}}) == 9
    assert client.run("app", {"endSessions": [session]}) == {"ok": 1.0}
    assert client.run("app", {"count": "w"})["n"] == 1
    out = client.run("app", {"aggregate": "w", "pipeline": [{"$lookup": {"from": "w", "localField": "_id", "foreignField": "_id", "as": "o"}}], "cursor": {}})
    assert rows(out) == [{"_id": 1, "o": [{"_id": 1}]}]
