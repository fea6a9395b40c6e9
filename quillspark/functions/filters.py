"""A small algebra of filter conditions that compiles to Columns, so that Catalyst can push them down.

A missing value satisfies no condition, but survives must_not: each condition is made non-null before it is negated.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnknownField(ValueError):
    """A condition names a field that the table lacks; it is never dropped in silence."""


def _known(schema: T.StructType, name: str) -> T.DataType:
    if name not in schema.names:
        raise UnknownField(name)
    return schema[name].dataType


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _present(name: str, condition: Column) -> Column:
    """The condition, false where the field is null; unlike coalesce this reaches the scan as pushed filters."""
    return F.col(name).isNotNull() & condition


@dataclass(frozen=True)
class Match:
    """Equal; on an array, some member equal."""

    name: str
    value: object

    def column(self, schema: T.StructType) -> Column:
        kind = _known(schema, self.name)
        return _sure(F.array_contains(self.name, self.value)) if isinstance(kind, T.ArrayType) else _present(self.name, F.col(self.name) == F.lit(self.value))


@dataclass(frozen=True)
class In:
    """One of the values; of none, never. On an array, some member."""

    name: str
    values: tuple

    def column(self, schema: T.StructType) -> Column:
        kind = _known(schema, self.name)
        if not self.values:
            return F.lit(False)
        if isinstance(kind, T.ArrayType):
            return _sure(F.arrays_overlap(self.name, F.array(*[F.lit(v) for v in self.values])))
        return _present(self.name, F.col(self.name).isin(*self.values))


HasAny = In


@dataclass(frozen=True)
class Range:
    name: str
    gt: object = None
    gte: object = None
    lt: object = None
    lte: object = None

    def column(self, schema: T.StructType) -> Column:
        kind, c = _known(schema, self.name), F.col(self.name)
        if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(False)
        parts = [f(c, v) for v, f in ((self.gt, Column.__gt__), (self.gte, Column.__ge__), (self.lt, Column.__lt__), (self.lte, Column.__le__)) if v is not None]
        return reduce(and_, parts, c.isNotNull())


@dataclass(frozen=True)
class PrefixMatch:
    """A dotted path in a subtree, by whole segments; on an array of ancestors, membership."""

    name: str
    prefix: str

    def column(self, schema: T.StructType) -> Column:
        if isinstance(_known(schema, self.name), T.ArrayType):
            return _sure(F.array_contains(self.name, self.prefix))
        c = F.col(self.name)
        return _present(self.name, (c == self.prefix) | c.startswith(self.prefix + "."))


@dataclass(frozen=True)
class IsNull:
    name: str

    def column(self, schema: T.StructType) -> Column:
        _known(schema, self.name)
        return F.col(self.name).isNull()


@dataclass(frozen=True)
class And:
    parts: tuple

    def column(self, schema: T.StructType) -> Column:
        return reduce(and_, [p.column(schema) for p in self.parts], F.lit(True))


@dataclass(frozen=True)
class Or:
    """Of no parts, false."""

    parts: tuple

    def column(self, schema: T.StructType) -> Column:
        return reduce(or_, [p.column(schema) for p in self.parts], F.lit(False))


@dataclass(frozen=True)
class VectorFilter:
    """All of must, none of must_not, and at least max(1, min_should) of should where there is any."""

    must: tuple = ()
    must_not: tuple = ()
    should: tuple = ()
    min_should: int = 1

    def column(self, schema: T.StructType) -> Column:
        parts = [p.column(schema) for p in self.must] + [~p.column(schema) for p in self.must_not]
        if self.should:
            met = reduce(lambda a, b: a + b, [p.column(schema).cast("int") for p in self.should])
            parts.append(met >= max(1, self.min_should))
        return reduce(and_, parts, F.lit(True))

    def intersect(self, other: VectorFilter | None) -> VectorFilter:
        """Both filters: nothing that either one rejects passes."""
        if other is None:
            return self
        extra = tuple(Or(f.should) for f in (self, other) if f.should)
        return VectorFilter(self.must + other.must + extra, self.must_not + other.must_not)


def ancestor_paths(path: Column) -> Column:
    """a.b.c -> [a, a.b, a.b.c]; null and empty paths have none."""
    parts = F.split(path, r"\.")
    whole = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return F.when(path.isNull() | (path == ""), F.array().cast("array<string>")).otherwise(whole)


def to_epoch(day: Column) -> Column:
    """Seconds since 1970 of a date, taken as midnight UTC (the session's zone must be UTC)."""
    return F.unix_seconds(day.cast("timestamp")).cast("double")
