"""Commands as plain documents: ``Client(catalog).run(database, command)`` gives a reply document.

A command is checked whole before anything is read or written; then expired documents
go, and then it runs. Writes are computed as new frames, checked against validators and
unique indexes, and stored as a new version.
"""

from __future__ import annotations

import datetime as dt
import secrets
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import __version__, errors
from .errors import QueryError
from .functions import filters
from .functions.collation import Collation
from .functions.paths import NULLS, Scope, check_path, null_paths
from .operators import constraints, pipeline, reads, shaping, updates
from .operators.frame import ORD, Frame
from .sources.catalog import Catalog, documents_of, frame_of, infer, merged, widened
from .streaming.cursors import MOST, Cursors

WRITES = ("insert", "update", "delete", "findAndModify")
#: Commands by name, with their other spellings.
COMMANDS = {
    **{c: c for c in (
        "hello", "isMaster", "ping", "buildInfo", "endSessions", "listDatabases", "create", "listCollections", "collMod", "drop", "dropDatabase", "createIndexes",
        "listIndexes", "dropIndexes", "find", "aggregate", "count", "distinct", "getMore", "killCursors", "insert", "update", "delete", "findAndModify",
    )},
    "findandmodify": "findAndModify", "ismaster": "isMaster", "buildinfo": "buildInfo",
}
REPLAYS = 128
WORKFLOW = {"$db", "lsid", "txnNumber", "readConcern", "writeConcern", "autocommit", "startTransaction", "$clusterTime", "$readPreference", "comment"}


def parse_error(message: str) -> QueryError:
    return QueryError(errors.FAILED_TO_PARSE, message)


def option_error(message: str) -> QueryError:
    return QueryError(errors.INVALID_OPTIONS, message)


class Client:
    """One connection: its cursors, its retryable writes, and a clock for expiry."""

    def __init__(self, catalog: Catalog, now=lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)):
        self.catalog, self.now, self.cursors = catalog, now, Cursors()
        self.replays: OrderedDict = OrderedDict()
        #: Number of the manifest at which each collection was last read, so that a write of another client isn't lost.
        self.read_at: dict[tuple[str, str], int | None] = {}

    def run(self, db: str, command: dict) -> dict:
        name = next(iter(command))
        if "findAndModify" in command and "findandmodify" in command:
            raise parse_error("findAndModify has both command aliases")
        if name in ("commitTransaction", "abortTransaction", "prepareTransaction"):
            raise option_error("transactions are not supported")
        if name not in COMMANDS:
            raise QueryError(errors.NO_COMMAND, f"command {name!r} is not supported yet")
        name = COMMANDS[name]
        handler = getattr(self, f"_{name}")
        self._workflow(name, command)
        key = None
        if name in WRITES and "txnNumber" in command:
            key = (bytes(command["lsid"]["id"].bytes), command["txnNumber"])
            if key in self.replays:
                body, reply = self.replays[key]
                if body != repr(command):
                    raise option_error(f"txnNumber {command['txnNumber']} was already used for a different command")
                return reply
        with errors.coded():
            reply = handler(db, command[next(iter(command))], {k: v for k, v in command.items() if k not in WORKFLOW})
        if key:
            self.replays[key] = (repr(command), reply)
            while len(self.replays) > REPLAYS:
                self.replays.popitem(last=False)
        return reply

    # Workflow

    def _workflow(self, name: str, command: dict) -> None:
        if "autocommit" in command or "startTransaction" in command:
            raise option_error("transactions are not supported")
        if (lsid := command.get("lsid")) is not None and not (isinstance(lsid, dict) and isinstance(lsid.get("id"), uuid.UUID)):
            raise parse_error("lsid.id must be a UUID")
        if "txnNumber" in command:
            n = command["txnNumber"]
            if isinstance(n, bool) or not isinstance(n, int) or n < 0 or "lsid" not in command:
                raise parse_error("txnNumber requires a non-negative integer and an lsid")
        if (concern := command.get("readConcern")) is not None:
            level = concern.get("level", "local") if isinstance(concern, dict) else None
            if level not in ("local", "available") or set(concern) - {"level"}:
                raise option_error(f"readConcern level {level} is not supported")
        if (concern := command.get("writeConcern")) is not None:
            if not isinstance(concern, dict) or set(concern) - {"w", "j", "wtimeout"}:
                raise option_error("writeConcern is not supported")
            if concern.get("w", 1) not in (1, "majority") or isinstance(concern.get("w"), bool):
                raise option_error(f"writeConcern w{concern.get('w')} is not supported")
            if not isinstance(concern.get("j", False), bool) or concern.get("wtimeout", 0) < 0:
                raise option_error("writeConcern option is not supported")

    def _hello(self, db, arg, doc):
        return {"isWritablePrimary": True, "maxBsonObjectSize": 16777216, "maxMessageSizeBytes": 48000000, "maxWriteBatchSize": 100000, "minWireVersion": 0, "maxWireVersion": 21, "readOnly": False, "ok": 1.0}

    def _isMaster(self, db, arg, doc):
        return self._hello(db, arg, doc) | {"ismaster": True, "helloOk": True}

    def _ping(self, db, arg, doc):
        return {"ok": 1.0}

    def _buildInfo(self, db, arg, doc):
        return {"version": __version__, "allocator": "jvm", "engine": f"spark {self.catalog.spark.version}", "bits": 64, "maxBsonObjectSize": 16777216, "ok": 1.0}

    def _endSessions(self, db, arg, doc):
        if not isinstance(arg, list) or not all(isinstance(s, dict) and isinstance(s.get("id"), uuid.UUID) for s in arg):
            raise parse_error("endSessions requires session documents with UUID ids")
        return {"ok": 1.0}

    # Catalog

    def _listDatabases(self, db, arg, doc):
        return {"databases": [{"name": d, "sizeOnDisk": 0, "empty": False} for d in self.catalog.databases()], "totalSize": 0, "ok": 1.0}

    def _options(self, doc: dict, allowed: set) -> None:
        for k in list(doc)[1:]:
            if k not in allowed:
                raise option_error(f"option {k} is not supported")

    def _validator(self, doc: dict) -> dict | None:
        for k, want in (("validationLevel", "strict"), ("validationAction", "error")):
            if doc.get(k, want) != want:
                raise option_error(f"{k} {doc[k]} is not supported")
        spec = doc.get("validator")
        if spec:
            constraints.check_validator(spec)
        return spec

    def _create(self, db, name, doc):
        for k in list(doc)[1:]:
            if k not in ("validator", "validationLevel", "validationAction"):
                raise option_error(f"create option {k} is not supported")
        spec = self._validator(doc)
        if self.catalog.manifest(db, name) is not None:
            raise QueryError(48, f"collection {db}.{name} already exists")
        self.catalog.create(db, name, spec or None)
        return {"ok": 1.0}

    def _listCollections(self, db, arg, doc):
        wanted = doc.get("filter") or {}
        if set(wanted) - {"name"} or not isinstance(wanted.get("name", ""), str):
            raise option_error("listCollections filter supports only name equality")
        out = []
        for c in self.catalog.collections(db):
            if wanted.get("name", c) == c:
                row = {"name": c, "type": "collection"}
                if not doc.get("nameOnly"):
                    spec = self.catalog.manifest(db, c)["validator"]
                    row["options"] = {"validator": spec, "validationLevel": "strict", "validationAction": "error"} if spec else {}
                out.append(row)
        return {"cursor": {"id": 0, "ns": f"{db}.$cmd.listCollections", "firstBatch": out}, "ok": 1.0}

    def _collMod(self, db, name, doc):
        self._options(doc, {"validator", "validationLevel", "validationAction", "index"})
        spec = self._validator(doc)
        manifest = self._manifest(db, name)
        if "index" in doc and ("validator" in doc):
            raise parse_error("collMod index and validator cannot conflict in one command")
        reply = {"ok": 1.0}
        if "index" in doc:
            index = doc["index"]
            if not isinstance(index, dict) or set(index) != {"name", "expireAfterSeconds"}:
                raise option_error("collMod index supports only name and expireAfterSeconds")
            seconds = self._seconds(index["expireAfterSeconds"])
            found = next((i for i in manifest["indexes"] if i["name"] == index["name"]), None)
            if found is None or "expireAfterSeconds" not in found:
                raise option_error(f"index {index['name']} has no expireAfterSeconds")
            reply |= {"expireAfterSeconds_old": found["expireAfterSeconds"], "expireAfterSeconds_new": seconds}
            found["expireAfterSeconds"] = seconds
        if "validator" in doc:
            manifest["validator"] = spec or None
        self.catalog.save_manifest(db, name, manifest)
        return reply

    def _manifest(self, db: str, name: str) -> dict:
        if (doc := self.catalog.manifest(db, name)) is None:
            raise QueryError(errors.NO_NAMESPACE, f"namespace {db}.{name} does not exist")
        return doc

    def _drop(self, db, name, doc):
        self._manifest(db, name)
        self.catalog.drop(db, name)
        return {"ns": f"{db}.{name}", "ok": 1.0}

    def _dropDatabase(self, db, arg, doc):
        self.catalog.drop_database(db)
        return {"dropped": db, "ok": 1.0}

    # Indexes

    @staticmethod
    def _seconds(n) -> int:
        if isinstance(n, bool) or not isinstance(n, (int, float)) or not 0 <= n <= 2147483647:
            raise option_error("expireAfterSeconds must be a number from 0 to 2147483647")
        return int(n)

    def _index(self, spec: dict) -> dict:
        keys = spec.get("key")
        if not isinstance(keys, dict) or not keys:
            raise parse_error("an index requires a key document")
        for k, v in keys.items():
            if v in ("text", "2d", "2dsphere", "hashed"):
                raise option_error(f"{v} indexes are not supported")
            if "$**" in k:
                raise option_error("wildcard indexes are not supported")
            check_path(k)
            if isinstance(v, bool) or v not in (1, -1):
                raise option_error(f"index direction of {k} must be 1 or -1")
        for k in spec:
            if k not in ("key", "name", "unique", "sparse", "partialFilterExpression", "expireAfterSeconds", "collation", "v"):
                raise option_error(f"index option {k} is not supported")
        out = {"v": 2, "key": keys, "name": spec.get("name") or "_".join(f"{k}_{v}" for k, v in keys.items())}
        for k in ("unique", "sparse"):
            if spec.get(k):
                out[k] = True
        if "partialFilterExpression" in spec:
            constraints.check_partial(spec["partialFilterExpression"])
            out["partialFilterExpression"] = spec["partialFilterExpression"]
            if out.get("sparse"):
                raise option_error("partialFilterExpression is not supported for this command with sparse")
        if "expireAfterSeconds" in spec:
            if len(keys) > 1 or "_id" in keys or {"sparse", "partialFilterExpression", "collation"} & set(spec):
                raise option_error("expireAfterSeconds supports plain single-field indexes only")
            out["expireAfterSeconds"] = self._seconds(spec["expireAfterSeconds"])
        if Collation.parse(spec.get("collation")).folds:
            out["collation"] = spec["collation"]
        return out

    def _createIndexes(self, db, name, doc):
        self._options(doc, {"indexes"})
        made = [self._index(s) for s in doc.get("indexes", [])]
        manifest = self.catalog.manifest(db, name) or self.catalog.create(db, name)
        before = len(manifest["indexes"]) + 1
        df = self.catalog.read(db, name)
        for index in made:
            same = next((i for i in manifest["indexes"] if i["name"] == index["name"] or (i["key"] == index["key"] and list(i["key"]) == list(index["key"]))), None)
            if same is not None:
                if same != index:
                    raise QueryError(errors.OPTIONS_CONFLICT, f"index {index['name']} conflicts with {same['name']}")
                continue
            self._check_unique(df, [index])
            manifest["indexes"].append(index)
        self.catalog.save_manifest(db, name, manifest)
        return {"numIndexesBefore": before, "numIndexesAfter": len(manifest["indexes"]) + 1, "createdCollectionAutomatically": False, "ok": 1.0}

    def _listIndexes(self, db, name, doc):
        out = [{"v": 2, "key": {"_id": 1}, "name": "_id_"}, *self._manifest(db, name)["indexes"]]
        return {"cursor": {"id": 0, "ns": f"{db}.{name}", "firstBatch": out}, "ok": 1.0}

    def _dropIndexes(self, db, name, doc):
        manifest, which = self._manifest(db, name), doc.get("index")
        before = len(manifest["indexes"]) + 1
        if which == "_id_" or which == {"_id": 1}:
            raise QueryError(errors.NO_DROP, "cannot drop _id index")
        if which == "*":
            left = []
        else:
            left = [i for i in manifest["indexes"] if which not in (i["name"], i["key"])]
            if len(left) == len(manifest["indexes"]):
                raise QueryError(27, f"index not found: {which}")
        manifest["indexes"] = left
        self.catalog.save_manifest(db, name, manifest)
        return {"nIndexesWas": before, "ok": 1.0}

    def _hint(self, db: str, name: str, hint) -> dict | None:
        if hint is None:
            return None
        known = [{"name": "_id_", "key": {"_id": 1}}, *(self.catalog.manifest(db, name) or {"indexes": []})["indexes"]]
        found = next((i for i in known if hint in (i["name"], i["key"])), None)
        if found is None:
            raise QueryError(errors.BAD_VALUE, f"hint {hint} does not name an index")
        return found

    # Reads

    def _live(self, db: str, name: str) -> DataFrame:
        """A collection without its expired documents."""
        manifest = self.catalog.manifest(db, name)
        self.read_at[db, name] = manifest and manifest["n"]
        df = self.catalog.read(db, name)
        for i in (manifest or {"indexes": []})["indexes"]:
            if "expireAfterSeconds" in i:
                df = constraints.live(df, next(iter(i["key"])), i["expireAfterSeconds"], self.now())
        return df

    def _explained(self, db: str, name: str, doc: dict, query: dict) -> dict:
        hint = self._hint(db, name, doc.get("hint"))
        fields = [k for k in query if not k.startswith("$")]
        index, prefix = None, 0
        for i in [hint] if hint else [{"name": "_id_", "key": {"_id": 1}}, *(self.catalog.manifest(db, name) or {"indexes": []})["indexes"]]:
            n = 0
            for k in i["key"]:
                if k not in fields:
                    break
                n += 1
            if n > prefix:
                index, prefix = i, n
        plan = {"stage": "IXSCAN" if index else "COLLSCAN", "scanStrategy": ("id" if index["name"] == "_id_" else "exact" if prefix == len(index["key"]) else "prefix") if index else "collection", "indexName": index["name"] if index else None, "prefixLen": prefix, "fallbackReason": None if index else "no index covers the filter"}
        return {"queryPlanner": {"namespace": f"{db}.{name}", "winningPlan": plan, "executedPlan": self.catalog.read(db, name).where(filters.matches(query, Scope.of(self.catalog.read(db, name))))._jdf.queryExecution().executedPlan().toString()}, "ok": 1.0}

    def _find(self, db, name, doc):
        self._options(doc, {"filter", "projection", "sort", "skip", "limit", "batchSize", "singleBatch", "collation", "hint", "explain"})
        query = doc.get("filter") or {}
        filters.parse(query)
        self._hint(db, name, doc.get("hint"))
        if "batchSize" in doc:
            shaping.check_count("batchSize", doc["batchSize"])
        if doc.get("explain"):
            return self._explained(db, name, doc, query)
        live, shape, by = self._live(db, name), doc.get("projection"), doc.get("collation")
        out = reads.find(live, query, shape, doc.get("sort"), doc.get("skip", 0), doc.get("limit", 0), by, ordered=True, nulls=True)
        if ORD in live.columns and not (doc.get("sort") or doc.get("skip") or doc.get("limit")):
            out = reads.pages(live, query, shape, by)
        return self._opened(f"{db}.{name}", out, doc.get("batchSize"), bool(doc.get("singleBatch")), self.catalog.pin(db, [name]))

    def _opened(self, namespace: str, out, batch, single: bool, done) -> dict:
        try:
            return self.cursors.open(namespace, out, batch, single, done)
        except Exception:
            done()
            raise

    def _aggregate(self, db, name, doc):
        self._options(doc, {"pipeline", "cursor", "collation"})
        stages = pipeline.parse(doc.get("pipeline"))
        batch = (doc.get("cursor") or {}).get("batchSize")
        if batch is not None and (isinstance(batch, bool) or not isinstance(batch, int) or not 0 < batch <= MOST):
            raise parse_error(f"aggregate batchSize must be positive and at most {MOST}")
        for stage, spec in stages:
            if stage == "$lookup" and "." in spec["from"]:
                raise option_error("$lookup supports collections of the same database only")
        out = pipeline.aggregate(self._live(db, name), doc["pipeline"], lambda c: self._live(db, c), doc.get("collation"), ordered=True, nulls=True)
        return self._opened(f"{db}.{name}", out, batch, False, self.catalog.pin(db, [name, *[spec["from"] for stage, spec in stages if stage == "$lookup"]]))

    def _count(self, db, name, doc):
        self._options(doc, {"query", "skip", "limit", "collation", "hint", "explain"})
        query = doc.get("query") or {}
        filters.parse(query)
        self._hint(db, name, doc.get("hint"))
        if doc.get("explain"):
            return self._explained(db, name, doc, query)
        return {"n": reads.count(self._live(db, name), query, doc.get("skip", 0), doc.get("limit", 0), doc.get("collation")).first().n, "ok": 1.0}

    def _distinct(self, db, name, doc):
        if "hint" in doc:
            raise option_error("distinct hint is not supported")
        self._options(doc, {"key", "query", "collation"})
        out = reads.distinct(self._live(db, name), doc.get("key"), doc.get("query"), doc.get("collation"))
        by = Collation.parse(doc.get("collation"))
        return {"values": [r.value for r in out.orderBy(by.key(F.col("value"), out.schema["value"].dataType)).toLocalIterator()], "ok": 1.0}

    def _getMore(self, db, cursor, doc):
        return self.cursors.more(cursor, f"{db}.{doc.get('collection')}", doc.get("batchSize"))

    def _killCursors(self, db, name, doc):
        return self.cursors.kill(f"{db}.{name}", doc.get("cursors"))

    # Writes

    def _check_unique(self, df: DataFrame, indexes: list[dict]) -> None:
        for i in indexes:
            if i.get("unique"):
                bad = constraints.unique_violations(df, list(i["key"]), i.get("sparse", False), i.get("partialFilterExpression"), i.get("collation"))
                if not bad.isEmpty():
                    raise QueryError(errors.DUPLICATE_KEY, f"duplicate key for index {i['name']}")

    def _check_valid(self, db: str, name: str, df: DataFrame, doc: dict) -> None:
        spec = (self.catalog.manifest(db, name) or {}).get("validator")
        if spec and not doc.get("bypassDocumentValidation") and not df.where(~constraints.valid(spec, df)).isEmpty():
            raise QueryError(errors.INVALID_DOCUMENT, "document failed validation")

    def _store(self, db: str, name: str, df: DataFrame, changed: DataFrame | None, doc: dict, following: int | None = None) -> None:
        if changed is not None:
            self._check_valid(db, name, changed, doc)
        self._check_unique(df, (self.catalog.manifest(db, name) or {"indexes": []})["indexes"])
        self._replace(db, name, df, following)

    def _replace(self, db: str, name: str, df: DataFrame, following: int | None = None) -> None:
        self.catalog.replace(db, name, df, following, self.read_at.get((db, name)))

    def _next(self, db: str, name: str) -> int:
        return (self.catalog.manifest(db, name) or {}).get("next", 0)

    def _insert(self, db, name, doc):
        self._options(doc, {"documents", "ordered", "bypassDocumentValidation"})
        batch = doc.get("documents")
        if not isinstance(batch, list) or not batch or not all(isinstance(d, dict) for d in batch):
            raise parse_error("insert requires documents")
        if self.catalog.manifest(db, name) is None:
            self.catalog.create(db, name)
        df = self._live(db, name)
        batch = [d if "_id" in d else {"_id": secrets.token_hex(12), **d} for d in batch]
        indexes, place = self.catalog.manifest(db, name)["indexes"], self._next(db, name)

        def fits(some: list[dict]) -> DataFrame:
            """The collection with some documents more; raises where one doesn't fit."""
            kind = df.schema if self.catalog.manifest(db, name)["version"] else T.StructType()
            new = frame_of(self.catalog.spark, [{**d, ORD: place + i, **({NULLS: at} if (at := null_paths(d)) else {})} for i, d in enumerate(some)], kind)
            new = new.withColumn(ORD, F.col(ORD).cast("long"))
            self._check_valid(db, name, new, doc)
            out = widened(df, new.schema).unionByName(new) if kind.fields else new
            ids = [{"name": "_id_", "key": {"_id": 1}, "unique": True}]
            self._check_unique(out, [*ids, *indexes])
            return out

        try:
            out, bad, good = fits(batch), [], batch
        except QueryError:
            # Some document doesn't fit: find which, one after the other.
            out, bad, good = None, [], []
            for k, d in enumerate(batch):
                try:
                    out = fits([*good, d])
                    good.append(d)
                except QueryError as e:
                    bad.append({"index": k, "code": e.code, "errmsg": e.message})
                    if doc.get("ordered", True):
                        break
        if good:
            self._replace(db, name, out, place + len(good))
        return {"n": len(good), "ok": 1.0} | ({"writeErrors": bad} if bad else {})

    def _update(self, db, name, doc):
        self._options(doc, {"updates", "ordered", "bypassDocumentValidation"})
        n = modified = 0
        upserted, bad = [], []
        for k, u in enumerate(doc.get("updates") or []):
            try:
                with errors.coded():
                    a, b, new = self._one_update(db, name, u, doc)
                n, modified = n + a, modified + b
                if new is not None:
                    upserted.append({"index": k, "_id": new})
            except QueryError as e:
                bad.append({"index": k, "code": e.code, "errmsg": e.message})
                if doc.get("ordered", True):
                    break
        return {"n": n, "nModified": modified, "ok": 1.0} | ({"upserted": upserted} if upserted else {}) | ({"writeErrors": bad} if bad else {})

    def _one_update(self, db: str, name: str, u: dict, doc: dict) -> tuple[int, int, object]:
        query, change, multi = u.get("q") or {}, u.get("u"), bool(u.get("multi"))
        kind = updates.parse(change, u.get("arrayFilters"))
        if kind == "replacement" and multi:
            raise QueryError(errors.BAD_VALUE, "a replacement updates one document only")
        self._hint(db, name, u.get("hint"))
        df = self._live(db, name)
        # Counts, checks and the new version all read the updated documents: they are made once.
        out = updates.flagged(df, query, change, multi, u.get("arrayFilters"), u.get("collation")).persist()
        try:
            return self._updated(db, name, u, doc, df, out)
        finally:
            out.unpersist()

    def _updated(self, db: str, name: str, u: dict, doc: dict, df: DataFrame, out: DataFrame) -> tuple[int, int, object]:
        query, change = u.get("q") or {}, u.get("u")
        hits, changed = out.agg(F.count_if("__hit"), F.count_if("__changed")).first()
        if not hits:
            if not u.get("upsert"):
                return 0, 0, None
            row = updates.upserted(df, query, change)
            if "_id" not in row.columns or row.first()["_id"] is None:
                row = row.withColumn("_id", F.lit(secrets.token_hex(12)))
            place = self._next(db, name)
            row = row.withColumn(ORD, F.lit(place).cast("long"))
            kind = merged(df.schema, row.schema)
            self._store(db, name, widened(df, kind).unionByName(widened(row, kind)), row, doc, place + 1)
            return 1, 0, row.first()["_id"]
        if changed:
            clean = out.drop("__hit", "__changed", "__old")
            self._store(db, name, clean, out.where("__changed").select(*clean.columns), doc)
        return hits, changed, None

    def _delete(self, db, name, doc):
        self._options(doc, {"deletes", "ordered"})
        n, bad = 0, []
        for k, d in enumerate(doc.get("deletes") or []):
            try:
                filters.parse(d.get("q") or {})
                self._hint(db, name, d.get("hint"))
                df = self._live(db, name)
                left = updates.delete(df, d.get("q") or {}, d.get("limit", 0), d.get("collation"))
                with errors.coded():
                    gone = df.count() - left.count()
                if gone:
                    self._replace(db, name, left)
                n += gone
            except QueryError as e:
                bad.append({"index": k, "code": e.code, "errmsg": e.message})
                if doc.get("ordered", True):
                    break
        return {"n": n, "ok": 1.0} | ({"writeErrors": bad} if bad else {})

    def _findAndModify(self, db, name, doc):
        self._options(doc, {"query", "sort", "remove", "update", "new", "fields", "projection", "upsert", "collation", "arrayFilters", "hint", "bypassDocumentValidation"})
        query, remove = doc.get("query") or {}, bool(doc.get("remove"))
        if remove == ("update" in doc):
            raise parse_error("findAndModify requires either remove or update")
        if remove and (doc.get("new") or doc.get("upsert")):
            raise parse_error("findAndModify remove conflicts with new and upsert")
        if "fields" in doc and "projection" in doc:
            raise parse_error("findAndModify takes fields or projection")
        filters.parse(query)
        shape, by = doc.get("fields") or doc.get("projection"), Collation.parse(doc.get("collation"))
        if shape:
            shaping.mode(shape)
        if doc.get("sort"):
            shaping.check_sort(doc["sort"])
        if not remove:
            updates.parse(doc["update"], doc.get("arrayFilters"))
        self._hint(db, name, doc.get("hint"))
        df = self._live(db, name)
        image = lambda d: (documents_of(reads.find(d, {}, shape, nulls=True)) or [None])[0]
        if remove:
            numbered = df if ORD in df.columns else df.withColumn(ORD, F.monotonically_increasing_id())
            frame = Frame(numbered.where(filters.matches(query, Scope.of(df), by))).numbered()
            frame = shaping.sort(frame, doc["sort"], by) if doc.get("sort") else frame
            one = frame.df.orderBy(*frame.keys()).limit(1)
            value = image(one.select(*df.columns))
            if value is not None:
                self._replace(db, name, numbered.join(F.broadcast(one.select(ORD)), ORD, "left_anti"))
            return {"lastErrorObject": {"n": int(value is not None)}, "value": value, "ok": 1.0}
        out = updates.flagged(df, query, doc["update"], False, doc.get("arrayFilters"), doc.get("collation"), doc.get("sort"))
        hit = out.where("__hit")
        if hit.isEmpty():
            if not doc.get("upsert"):
                return {"lastErrorObject": {"n": 0, "updatedExisting": False}, "value": None, "ok": 1.0}
            _, _, new = self._one_update(db, name, {"q": query, "u": doc["update"], "upsert": True}, doc)
            value = image(self._live(db, name).where(F.col("_id") == new)) if doc.get("new") else None
            return {"lastErrorObject": {"n": 1, "updatedExisting": False, "upserted": new}, "value": value, "ok": 1.0}
        clean = out.drop("__hit", "__changed", "__old")
        value = image(hit.select(*clean.columns) if doc.get("new") else hit.select("__old.*"))
        self._store(db, name, clean, hit.select(*clean.columns), doc)
        return {"lastErrorObject": {"n": 1, "updatedExisting": True}, "value": value, "ok": 1.0}
