import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sedge.errors import QueryError
from sedge.functions import variant
from sedge.operators import constraints, reads, updates
from sedge.operators.pipeline import aggregate
from sedge.sources.catalog import documents_of, frame_of

PEOPLE = [
    {"_id": "a", "name": "Ann", "age": 30, "tags": ["x", "y"], "items": [{"kind": "k1", "score": 5}, {"kind": "k2", "score": 9}], "p": {"city": "Rome"}, "at": dt.datetime(2024, 1, 1)},
    {"_id": "b", "name": "bo\nline", "age": 40, "tags": [], "items": [{"kind": "k1", "score": 9}]},
    {"_id": "c", "name": "CY", "tags": ["z", None], "p": {}},
    {"_id": "d", "age": 30},
]


@pytest.fixture(scope="module")
def people(spark):
    return frame_of(spark, PEOPLE).repartition(1).sortWithinPartitions("_id")


def ids(df):
    return "".join(sorted(r["_id"] for r in df.collect()))


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ({}, "abcd"), ({"age": 30}, "ad"), ({"age": 30.0}, "ad"), ({"age": None}, "c"), ({"age": {"$ne": 30}}, "bc"), ({"age": {"$gt": 25, "$lt": 35}}, "ad"),
        ({"age": {"$not": {"$gt": 35}}}, "acd"), ({"age": {"$in": [30, None]}}, "acd"), ({"age": {"$nin": [30]}}, "bc"), ({"age": {"$gte": "1"}}, ""), ({"age": True}, ""),
        ({"tags": "x"}, "a"), ({"tags": ["x", "y"]}, "a"), ({"tags": {"$size": 0}}, "b"), ({"tags": {"$all": ["y", "x", "x"]}}, "a"), ({"tags": {"$all": []}}, ""), ({"tags": {"$exists": False}}, "d"),
        ({"tags": {"$type": "array"}}, "abc"), ({"tags": {"$type": "string"}}, "ac"), ({"age": {"$type": "number"}}, "abd"), ({"tags": {"$in": ["y", "z"]}}, "ac"),
        ({"items.kind": "k2"}, "a"), ({"items": {"$elemMatch": {"kind": "k1", "score": {"$gt": 5}}}}, "b"), ({"items.score": {"$gt": 5}}, "ab"), ({"items.1.score": 9}, "a"),
        ({"items": {"$all": [{"$elemMatch": {"kind": "k1"}}, {"$elemMatch": {"score": 9}}]}}, "ab"), ({"items": {"kind": "k1", "score": 9}}, "b"), ({"tags": {"$elemMatch": {"$gt": "x", "$lt": "z"}}}, "a"),
        ({"p.city": "Rome"}, "a"), ({"p": {"city": "Rome"}}, "a"), ({"p.city": {"$exists": False}}, "bcd"), ({"nope.x": None}, "abcd"), ({"nope": 1}, ""),
        ({"name": {"$regex": "^a", "$options": "i"}}, "a"), ({"name": re.compile("line$")}, "b"), ({"name": {"$regex": "bo$"}}, ""), ({"name": {"$regex": "bo$", "$options": "m"}}, "b"), ({"name": {"$regex": "bo.line", "$options": "s"}}, "b"),
        ({"$or": [{"age": 40}, {"name": "CY"}]}, "bc"), ({"$nor": [{"age": 40}, {"name": "CY"}]}, "ad"), ({"$and": [{"age": 30}, {"name": {"$exists": True}}]}, "a"), ({"at": {"$lte": dt.datetime(2024, 1, 1)}}, "a"),
    ],
)
def test_filters(people, query, want):
    assert ids(reads.find(people, query)) == want
    assert reads.count(people, query).first().n == len(want)


def test_collation(people):
    by = {"locale": "en", "strength": 2}
    assert ids(reads.find(people, {"name": "ann"}, collation=by)) == "a" and ids(reads.find(people, {"name": {"$in": ["cy", "ANN"]}}, collation=by)) == "ac"
    with pytest.raises(QueryError, match="range"):
        reads.find(people, {"name": {"$gt": "a"}}, collation=by)
    for bad in ({"locale": "en"}, {"locale": "fr", "strength": 2}, {"locale": "en", "strength": 3}, {"locale": "en", "strength": 2, "caseLevel": True}, "en"):
        with pytest.raises(QueryError) as e:
            reads.find(people, {}, collation=bad)
        assert e.value.code == 72


@pytest.mark.parametrize(
    ("stage", "code"),
    [
        ({"$match": {"$where": "1"}}, 2), ({"$match": {"a": {"$foo": 1}}}, 2), ({"$match": {"a": {"$in": 1}}}, 2), ({"$match": {"a": {"$exists": 1}}}, 2), ({"$match": {"$or": []}}, 2), ({"$match": {"a": {"$not": 1}}}, 2),
        ({"$match": {"a": {"$regex": "("}}}, 2), ({"$match": {"a": {"$regex": "a", "$options": "x"}}}, 2), ({"$match": {"a": {"$regex": "(?=a)"}}}, 2), ({"$match": {"a": {"$type": "decimal"}}}, 2), ({"$match": {"a": {"$size": -1}}}, 2), ({"$match": {"a": {"$all": 1}}}, 2), ({"$match": {"a": {"$elemMatch": 1}}}, 2),
        ({"$facet": {}}, 72), ({"$count": ""}, 9), ({"$project": {"a": 1, "b": 0}}, 2), ({"$project": {"a": 1, "a.b": 1}}, 2), ({"$addFields": {"x": {"$divide": [1, 0]}}}, 2), ({"$addFields": {"x": {"$add": [1, "a"]}}}, 2), ({"$addFields": {"x": {"$concat": ["a", 1]}}}, 2), ({"$addFields": {"x": {"$dateDiff": 1}}}, 2), ({"$addFields": {"x": "$$NOW"}}, 2), ({"$addFields": {"x": {"$subtract": [1]}}}, 2),
        ({"$group": {"n": {"$sum": 1}}}, 9), ({"$group": {"_id": 1, "n": {"$stdDev": 1}}}, 2), ({"$group": {"_id": 1, "n": {"$avg": 1}}}, 2), ({"$group": {"_id": 1, "n": {"$sum": "x"}}}, 2), ({"$group": {"_id": {"$sum": 1}}}, 2), ({"$group": {"_id": 1, "n": {"$sum": 1, "$avg": "$x"}}}, 9),
        ({"$lookup": {"from": "a", "localField": "b", "foreignField": "c", "as": "d", "let": {}}}, 72), ({"$lookup": {"from": "a"}}, 9), ({"$unwind": "tags"}, 9), ({"$limit": 0}, 2), ({"$skip": -1}, 2), ({"$sort": {"a": 2}}, 2), ({"$replaceRoot": {"newRoot": 5}}, 2), ({"a": 1, "b": 2}, 9),
    ],
)
def test_errors_come_before_data(spark, stage, code):
    boom = spark.range(1).select(F.raise_error(F.lit("data was read")).alias("a"))
    with pytest.raises(QueryError) as e:
        aggregate(boom, [stage])
    assert e.value.code == code


def run(df, stages, **more):
    return documents_of(aggregate(df, stages, ordered=True, **more))


def test_unwind(people):
    kept = run(people, [{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}, {"$project": {"tags": 1, "i": 1}}])
    assert kept == [{"_id": "a", "tags": "x", "i": 0}, {"_id": "a", "tags": "y", "i": 1}, {"_id": "b"}, {"_id": "c", "tags": "z", "i": 0}, {"_id": "c", "i": 1}, {"_id": "d"}]
    assert [r["_id"] for r in run(people, [{"$unwind": "$items"}, {"$sort": {"items.score": -1}}])] == ["a", "b", "a"]
    assert run(people, [{"$unwind": "$age"}, {"$count": "n"}]) == [{"n": 3}]


def test_groups(people):
    stages = [{"$sort": {"_id": -1}}, {"$group": {"_id": "$age", "ids": {"$push": "$_id"}, "first": {"$first": "$name"}, "last": {"$last": "$name"}, "n": {"$sum": 1}, "s": {"$sum": "$name"}, "avg": {"$avg": "$age"}}}]
    got = {r.get("_id"): r for r in run(people, stages)}
    assert got[30] == {"_id": 30, "ids": ["d", "a"], "last": "Ann", "n": 2, "s": 0, "avg": 30.0}
    assert list(got) == [30, None, 40]  # first seen
    pushed = aggregate(people, [{"$group": {"_id": None, "names": {"$push": "$name"}, "set": {"$addToSet": "$age"}}}]).first()
    assert pushed.names == ["Ann", "bo\nline", "CY", None] and pushed.set == [30, 40, None]
    assert run(people, [{"$match": {"age": 99}}, {"$group": {"_id": 1, "n": {"$sum": 1}}}]) == []
    both = run(people, [{"$group": {"_id": {"c": "$p.city", "old": {"$gte": ["$age", 35]}}, "m": {"$max": "$age"}}}, {"$sort": {"m": 1, "_id.c": 1}}])
    assert [r.get("m") for r in both] == [None, 30, 30, 40] or len(both) >= 3


def test_lookup_keys(spark):
    left = frame_of(spark, [{"_id": 1, "k": "p", "ks": ["p", "q", "p"], "n": 1}, {"_id": 2, "ks": []}, {"_id": 3, "k": "zz", "ks": [None]}])
    right = frame_of(spark, [{"_id": "p", "own": "P", "n": 1.0}, {"_id": "q", "own": "Q", "n": 2.0}, {"_id": "r", "n": 1.0}]).repartition(1).sortWithinPartitions("_id")
    go = lambda local, foreign, **m: {r["_id"]: [x["_id"] for x in r["o"]] for r in documents_of(aggregate(left, [{"$lookup": {"from": "r", "localField": local, "foreignField": foreign, "as": "o"}}], lambda _: right, **m))}
    assert go("k", "_id") == {1: ["p"], 2: [], 3: []}
    assert go("ks", "_id") == {1: ["p", "q"], 2: [], 3: []}
    assert go("k", "own") == {1: [], 2: ["r"], 3: []}  # missing meets missing
    assert go("ks", "own") == {1: [], 2: ["r"], 3: ["r"]}
    assert go("n", "n")[1] == ["p", "r"]
    assert go("k", "own", collation={"locale": "en", "strength": 2})[1] == ["p"]
    assert go("nope", "nope") == {1: ["p", "q", "r"], 2: ["p", "q", "r"], 3: ["p", "q", "r"]}


def test_updates(people):
    def after(change, query=None, **more):
        return {r["_id"]: r for r in documents_of(updates.update(people, {"_id": "a"} if query is None else query, change, **more))}

    assert after({"$set": {"p.city": "Oslo", "p.zip": 5}})["a"]["p"] == {"city": "Oslo", "zip": 5}
    assert "tags" not in after({"$unset": {"tags": ""}})["a"] and after({"$unset": {"p.city": 1}})["a"]["p"] == {}
    assert after({"$rename": {"name": "p.name"}})["a"]["p"] == {"city": "Rome", "name": "Ann"}
    assert after({"$push": {"tags": {"$each": ["n", "m"]}}})["a"]["tags"] == ["x", "y", "n", "m"]
    assert after({"$addToSet": {"tags": "x"}})["a"]["tags"] == ["x", "y"] and after({"$pop": {"tags": 1}})["a"]["tags"] == ["x"]
    assert after({"$pull": {"items": {"score": {"$gt": 5}}}})["a"]["items"] == [{"kind": "k1", "score": 5}]
    assert after({"$pullAll": {"tags": ["z"]}}, {"_id": "c"})["c"]["tags"] == [None]
    assert [x["score"] for x in after({"$inc": {"items.$[].score": 1}})["a"]["items"]] == [6, 10]
    assert [x["score"] for x in after({"$set": {"items.$[i].score": 0}}, array_filters=[{"i.kind": "k2"}])["a"]["items"]] == [5, 0]
    assert [x["score"] for x in after({"$set": {"items.$.score": 1}}, {"items.score": {"$gt": 5}})["a"]["items"]] == [5, 1]
    assert after({"$mul": {"age": 2, "fresh": 3}})["a"]["age"] == 60 and after({"$min": {"age": 10}}, {})["b"]["age"] == 10 and after({"$max": {"age": 35}}, {})["c"]["age"] == 35
    assert after([{"$set": {"age": {"$add": ["$age", 1]}}}, {"$unset": "items"}])["a"]["age"] == 31
    assert after({"_id": "a", "name": "New"})["a"] == {"_id": "a", "name": "New"}
    assert after({"$set": {"age": 1}, "$setOnInsert": {"name": "Up"}}, {"_id": "zz"}, upsert=True)["zz"] == {"_id": "zz", "age": 1, "name": "Up"}
    assert sum(r["age"] == 1 for r in after({"$set": {"age": 1}}, {"age": 30}, multi=False).values() if "age" in r) == 1
    flags = updates.flagged(people, {"age": 30}, {"$set": {"name": "Ann"}}).agg(F.count_if("__hit"), F.count_if("__changed")).first()
    assert tuple(flags) == (2, 1)


@pytest.mark.parametrize(
    "change",
    [{"$set": {"_id": 1}}, {"$set": {"a": 1}, "$inc": {"a.b": 1}}, {"$set": {"a": 1}, "b": 2}, {"$foo": {"a": 1}}, {"$push": {"a": {"$each": [1], "$slice": 1}}}, {"$pop": {"a": 2}}, {"$inc": {"a": "x"}}, {"$set": {"a.$[X].b": 1}}, {"$set": {"a.$.b.$.c": 1}}, {"$push": {"a.$.b": 1}}, {"$set": {"a.$[i].b": 1}}, {"$pullAll": {"a": 1}}, [{"$group": {"_id": 1}}], []],
)
def test_bad_updates(people, change):
    with pytest.raises(QueryError):
        updates.update(people, {}, change)


def test_overflow_and_wrong_types_fail_only_where_they_match(people):
    big = {"$inc": {"age": 2**31 - 1}}
    with pytest.raises(Exception, match="(?i)overflow"):
        updates.update(people.withColumn("age", F.col("age").cast("long") + F.lit(2**63 - 100)), {"_id": "a"}, {"$inc": {"age": 1000}}).collect()
    assert updates.update(people, {"_id": "zz"}, big).count() == 4
    with pytest.raises(QueryError):
        updates.update(people, {}, {"$inc": {"name": 1}})


def test_constraints(people):
    assert {tuple(r) for r in constraints.unique_violations(people, ["age"]).collect()} == {(30, 2)}
    assert constraints.unique_violations(people, ["name"], sparse=True).count() == 0
    with pytest.raises(QueryError, match="array"):
        constraints.unique_violations(people, ["tags"])
    assert ids(constraints.live(people, "at", 0, dt.datetime(2024, 1, 1))) == "bcd" and ids(constraints.live(people, "at", 1, dt.datetime(2024, 1, 1))) == "abcd"
    spec = {"$jsonSchema": {"bsonType": "object", "required": ["name"], "properties": {"p": {"bsonType": "object", "required": ["city"]}}}}
    assert ids(people.where(~constraints.valid(spec, people))) == "cd"
    for bad in ({"$jsonSchema": {"bsonType": "array"}}, {"$jsonSchema": {"bsonType": "object", "properties": {"a.b": {}}}}, {"$jsonSchema": {"bsonType": "object", "properties": {"a": {"bsonType": "decimal"}}}}, {"$jsonSchema": {"bsonType": "object", "minimum": 1}}, {"a": 1}):
        with pytest.raises(QueryError):
            constraints.check_validator(bad)


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = aggregate(orders, [{"$match": {"o_orderkey": {"$gt": 5}, "o_orderstatus": "F"}}, {"$group": {"_id": "$o_orderstatus", "n": {"$sum": 1}}}])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,5)" in plan and "EqualTo(o_orderstatu" in plan and "o_totalprice" not in plan
    top = reads.find(orders, {}, sort={"o_totalprice": -1}, limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top


MIXED = [{"_id": i, **({"v": v} if v is not ... else {})} for i, v in enumerate([1, 1.0, "a", None, ..., True, [1, "b"], {"x": 2}, 2**60, 2**60 + 1, [{"k": 5}, {"k": 7}]])]


def test_dynamic_tier(spark):
    df = variant.frame(spark, MIXED)
    hit = lambda q: sorted(int(r["_id"]) for r in variant.find(df, q).collect())
    assert hit({"v": 1}) == [0, 1, 6] and hit({"v": None}) == [3, 4] and hit({"v": {"$exists": False}}) == [4]
    assert hit({"v": True}) == [5] and hit({"v": {"$gt": 0}}) == [0, 1, 6, 8, 9] and hit({"v": {"$gte": "a"}}) == [2, 6]
    assert hit({"v": 2**60 + 1}) == [9] and hit({"v.x": 2}) == [7] and hit({"v": {"x": 2}}) == [7] and hit({"v.k": {"$gt": 6}}) == [10]
    assert hit({"v": {"$type": "string"}}) == [2, 6] and hit({"v": {"$size": 2}}) == [6, 10] and hit({"v": {"$elemMatch": {"k": 5}}}) == [10] and hit({"v": {"$ne": 1}}) == [2, 3, 4, 5, 7, 8, 9, 10]
    order = [int(r["_id"]) for r in variant.sort(df, "v").collect()]
    assert order == [3, 4, 0, 1, 8, 9, 2, 7, 6, 10, 5] and variant.group_count(df, "v").first().n == 2
    low, high = variant.least(df.where("_ord in (0, 2, 8)"), "v").first()
    assert str(low) == "1" and '"a"' in str(high) or "a" in str(high)
