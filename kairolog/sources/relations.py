"""Tables as facts: the key is the entity, every other scalar column an attribute ``:<table>/<column>``."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kairolog.functions.values import Val


@dataclass(frozen=True)
class Relation:
    """``refs``: columns that hold keys of other relations. Without a key, an entity is a hash of the whole row.

    ``source`` may be a function; it is called when a query first names the table, so the others cost no file listing.
    """

    name: str
    source: DataFrame | Callable[[], DataFrame]
    key: str | None = None
    refs: Mapping[str, str] = field(default_factory=dict)

    @cached_property
    def df(self) -> DataFrame:
        return self.source() if callable(self.source) else self.source

    def entity(self) -> Val:
        if self.key is None:
            return Val(f"ent:{self.name}", F.xxhash64(*(F.col(f"`{c}`") for c in self.df.columns)))
        return Val(f"ent:{self.name}", F.col(f"`{self.key}`").cast("bigint"))

    def attribute(self, name: str) -> Val | None:
        """The column's values, or None if it is no attribute."""
        if name not in self.df.columns:
            return None
        c, kind = F.col(f"`{name}`"), self.df.schema[name].dataType
        if name in self.refs:
            return Val(f"ent:{self.refs[name]}", c.cast("bigint"))
        if isinstance(kind, T.IntegralType):
            return Val("int", c.cast("bigint"))
        if isinstance(kind, (T.FractionalType, T.DecimalType)):
            return Val("float", c.cast("double"))
        if isinstance(kind, T.StringType):
            return Val("str", c)
        if isinstance(kind, T.BooleanType):
            return Val("bool", c)
        if isinstance(kind, T.TimestampType):
            return Val("int", F.unix_millis(c))
        if isinstance(kind, (T.TimestampNTZType, T.DateType)):
            return Val("int", _epoch_millis(name))
        return None


def _epoch_millis(name: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{name}` AS TIMESTAMP_NTZ))")
