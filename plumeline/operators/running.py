"""Running values over long timelines without one task per key.

A plain ``partitionBy(key).orderBy(time)`` window puts the whole timeline of a
key on one task.  Here every timeline is cut into chunks: a window runs inside
each ``(key, chunk)``, a small table with one row per chunk carries the state
from chunk to chunk, and both meet in a join on ``(key, chunk)`` that reuses
the partitioning of the window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

_KEY, _CHUNK, _ORDER = "__key", "__chunk", "__order"


@dataclass(frozen=True)
class LastValue:
    """Last non-null value at or before the row."""

    value: Column
    name: str

    def local(self, w):
        return F.last(self.value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))

    def per_chunk(self):
        return F.max_by(self.value, F.when(self.value.isNotNull(), F.col(_ORDER)))

    def carry(self, column, w):
        return F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def combine(self, local, carried, first):
        return F.coalesce(local, carried)


@dataclass(frozen=True)
class RunningSum:
    """Sum of all values up to and including the row."""

    value: Column
    name: str

    def local(self, w):
        return F.sum(F.coalesce(self.value, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))

    def per_chunk(self):
        return F.sum(F.coalesce(self.value, F.lit(0)))

    def carry(self, column, w):
        return F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def combine(self, local, carried, first):
        return local + F.coalesce(carried, F.lit(0))


@dataclass(frozen=True)
class MaxBefore:
    """Largest value on the rows strictly before this one."""

    value: Column
    name: str

    def local(self, w):
        return F.max(self.value).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def per_chunk(self):
        return F.max(self.value)

    def carry(self, column, w):
        return F.max(column).over(w.rowsBetween(Window.unboundedPreceding, -1))

    def combine(self, local, carried, first):
        return F.greatest(local, carried)


@dataclass(frozen=True)
class Previous:
    """Value on the row just before this one."""

    value: Column
    name: str

    def local(self, w):
        return F.lag(self.value).over(w)

    def per_chunk(self):
        return F.max_by(self.value, F.col(_ORDER))

    def carry(self, column, w):
        return F.lag(column).over(w)

    def combine(self, local, carried, first):
        return F.when(first, carried).otherwise(local)


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    values: Sequence[LastValue | RunningSum | MaxBefore | Previous],
) -> DataFrame:
    """Add running columns to ``df``.

    ``order`` must be unique within a key.  ``chunk`` must never decrease along
    ``order`` (a truncated timestamp, ``lineno div n``, a block number); it sets
    how many rows one task sees for one key.
    """
    # A struct key is never NULL itself, so NULL key fields join like any value.
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    base = df.withColumns(
        {_KEY: key, _CHUNK: chunk, _ORDER: F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])}
    )
    within = Window.partitionBy(_KEY, _CHUNK).orderBy(_ORDER)
    along = Window.partitionBy(_KEY).orderBy(_CHUNK)
    local = base.withColumns(
        {f"__local_{v.name}": v.local(within) for v in values} | {"__first": F.row_number().over(within) == 1}
    )
    chunks = base.groupBy(_KEY, _CHUNK).agg(*[v.per_chunk().alias(f"__chunk_{v.name}") for v in values])
    carried = chunks.select(
        _KEY, _CHUNK, *[v.carry(F.col(f"__chunk_{v.name}"), along).alias(f"__carry_{v.name}") for v in values]
    )
    out = local.join(carried, [_KEY, _CHUNK], "left")
    return out.select(
        *df.columns,
        *[
            v.combine(F.col(f"__local_{v.name}"), F.col(f"__carry_{v.name}"), F.col("__first")).alias(v.name)
            for v in values
        ],
    )
