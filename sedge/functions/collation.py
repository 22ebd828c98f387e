"""The two collations: binary, and case-insensitive English of strength 2."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import INVALID_OPTIONS, QueryError


@dataclass(frozen=True)
class Collation:
    folds: bool = False

    @staticmethod
    def parse(spec) -> Collation:
        if spec is None:
            return Collation()
        if not isinstance(spec, dict):
            raise QueryError(INVALID_OPTIONS, "collation must be a document")
        for k in spec:
            if k not in ("locale", "strength"):
                raise QueryError(INVALID_OPTIONS, f"collation option {k} is not supported")
        locale, strength = spec.get("locale"), spec.get("strength")
        if locale == "simple" and strength is None:
            return Collation()
        if locale not in ("en", "en_US"):
            raise QueryError(INVALID_OPTIONS, f"collation locale {locale} is not supported")
        if isinstance(strength, bool) or strength != 2:
            raise QueryError(INVALID_OPTIONS, f"collation locale {locale} requires strength 2")
        return Collation(True)

    def key(self, c: Column, kind: T.DataType) -> Column:
        """A column that compares by this collation."""
        return F.collate(c, "UTF8_LCASE") if self.folds and isinstance(kind, T.StringType) else c
