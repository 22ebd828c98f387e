"""A stream of documents: a DataFrame and the order that it is in, added only where it shows."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import NULLS

HIDDEN = "__o"
#: The place of a stored document in its collection, written with it: rising in the order of insertion.
ORD = "__ord"


@dataclass(frozen=True)
class Frame:
    """``order`` lists (column, ascending); None is the order of the scan, not yet a column.

    Keeping the scan's order out of the plan lets filters and projections reach the scan. Stored
    collections bring their order as a column.
    """

    df: DataFrame
    order: tuple[tuple[str, bool], ...] | None = None

    def numbered(self) -> Frame:
        """With the order in columns."""
        if self.order is not None:
            return self
        if ORD in self.df.columns:
            return Frame(self.df, ((ORD, True),))
        name = self.fresh()
        return Frame(self.df.withColumn(name, F.monotonically_increasing_id()), ((name, True),))

    def fresh(self) -> str:
        return f"{HIDDEN}{sum(c.startswith('__') for c in self.df.columns)}"

    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith("__")]

    def shown(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def keys(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in self.order or ()]

    def where(self, p: Column) -> Frame:
        return replace(self, df=self.df.where(p))

    def select(self, columns: list[Column]) -> Frame:
        return replace(self, df=self.df.select(*columns, *self.hidden()))

    def rising(self) -> tuple[Frame, Column]:
        """A key that rises along the order, for min_by and sorting within groups; descending numbers are negated."""
        f = self.numbered()
        parts = []
        for c, up in f.order:
            kind = f.df.schema[c].dataType
            if up:
                parts.append(F.col(c))
            elif isinstance(kind, (T.FractionalType, T.DecimalType)):
                parts += [F.col(c).isNull(), -F.col(c)]
            elif isinstance(kind, T.IntegralType):
                parts += [F.col(c).isNull(), -F.col(c).cast("decimal(20,0)")]
            elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                parts += [F.col(c).isNull(), -F.unix_micros(F.col(c).cast("timestamp"))]
            elif isinstance(kind, T.BooleanType):
                parts += [F.col(c).isNull(), ~F.col(c)]
            else:
                # Strings descending: each byte's complement sorts the other way round, an end mark after all of them.
                parts += [F.col(c).isNull(), F.concat(F.translate(F.hex(F.col(c).cast("string")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))]
        return f, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])

    def result(self, ordered: bool = False, nulls: bool = False) -> DataFrame:
        """The documents; ``nulls`` keeps the column that tells explicit nulls from missing fields."""
        df = self.df
        if ordered and self.order:
            df = df.orderBy(*self.keys())
        return df.select(*[F.col(f"`{c}`") for c in self.shown()], *[c for c in self.hidden() if nulls and c == NULLS])
