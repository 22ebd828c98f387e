"""Cursors: a result in order, handed out in batches to the client that asked for it."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from ..errors import FAILED_TO_PARSE, NO_CURSOR, QueryError
from ..sources.catalog import document

DEFAULT_BATCH = 101
MOST = 1000


class Cursors:
    """Live cursors of one client; a result is read partition by partition or page by page, never as a whole.

    A cursor holds the versions that it reads until it ends: ``done`` lets go of them.
    """

    def __init__(self):
        self.live: dict[int, tuple[str, Iterator, Callable[[], None]]] = {}
        self._next = itertools.count(1)

    def open(self, namespace: str, df: DataFrame | Iterator, batch: int | None = None, single: bool = False, done: Callable[[], None] = lambda: None) -> dict:
        rows = map(document, df.toLocalIterator() if isinstance(df, DataFrame) else df)
        first, rest = self._take(rows, DEFAULT_BATCH if batch is None else batch)
        cursor = 0
        if rest is not None and not single:
            cursor = next(self._next)
            self.live[cursor] = (namespace, rest, done)
        else:
            done()
        return {"cursor": {"firstBatch": first, "id": cursor, "ns": namespace}, "ok": 1.0}

    @staticmethod
    def _take(rows: Iterator, n: int) -> tuple[list, Iterator | None]:
        batch = list(itertools.islice(rows, n))
        more = next(rows, None)
        return batch, (itertools.chain([more], rows) if more is not None else None)

    def more(self, cursor: int, namespace: str, batch: int | None = None) -> dict:
        if batch is not None and (isinstance(batch, bool) or not isinstance(batch, int) or batch <= 0):
            raise QueryError(FAILED_TO_PARSE, "getMore batchSize must be positive")
        if self.live.get(cursor, ("",))[0] != namespace:
            raise QueryError(NO_CURSOR, f"cursor not found: {cursor}")
        _, rows, done = self.live.pop(cursor)
        rows, rest = self._take(rows, min(batch or DEFAULT_BATCH, MOST))
        if rest is not None:
            self.live[cursor] = (namespace, rest, done)
        else:
            done()
        return {"cursor": {"nextBatch": rows, "id": cursor if rest is not None else 0, "ns": namespace}, "ok": 1.0}

    def kill(self, namespace: str, cursors: list) -> dict:
        if not isinstance(cursors, list) or not all(isinstance(c, int) and not isinstance(c, bool) for c in cursors):
            raise QueryError(FAILED_TO_PARSE, "killCursors requires an array of cursor ids")
        killed = [c for c in cursors if self.live.get(c, ("",))[0] == namespace]
        for c in killed:
            self.live.pop(c)[2]()
        return {"cursorsKilled": killed, "cursorsNotFound": [c for c in cursors if c not in killed], "cursorsAlive": [], "cursorsUnknown": [], "ok": 1.0}
