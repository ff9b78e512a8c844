"""Owners of keys: ranges that tile a key space of any types, and the one range that each key lies in.

Keys and bounds become order keys: text that sorts as the values do, parts of a compound key one behind the other, with
``MIN_KEY`` below and ``MAX_KEY`` above everything.  So open-ended, mixed and compound bounds are plain comparisons.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumeline.operators.running import LastValue, with_running
from plumeline.session import staged

# How values of different types follow each other.
MIN_KEY, NULL, NUMBER, STRING, BOOLEAN, DATE, MAX_KEY = "00", "10", "20", "30", "70", "80", "FF"

#: Rows of one chunk of the merge.
CHUNK_ROWS = 200_000


def _class(tag: str, text: Column) -> Column:
    return F.concat(F.lit(tag), text)


def _whole(value: Column) -> Column:
    # With the sign turned over, 16 hexadecimal digits sort as the numbers do.
    return F.lpad(F.hex(value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def number_key(value: Column) -> Column:
    """Order key of a whole number; NULL sorts below all numbers."""
    return F.coalesce(_class(NUMBER, _whole(value)), F.lit(NULL))


def string_key(value: Column) -> Column:
    """Order key of a text in order of its bytes; a longer text follows its beginning."""
    # A zero byte inside is marked, so that the end is below any text that goes on.
    body = F.regexp_replace(F.regexp_replace(F.hex(F.encode(value, "UTF-8")), "(..)", "$1 "), "00 ", "00FF ")
    return F.coalesce(_class(STRING, F.concat(F.replace(body, F.lit(" "), F.lit("")), F.lit("0000"))), F.lit(NULL))


def boolean_key(value: Column) -> Column:
    return F.coalesce(_class(BOOLEAN, F.when(value, "01").otherwise(F.when(~value, "00"))), F.lit(NULL))


def date_key(value: Column) -> Column:
    return F.coalesce(_class(DATE, _whole(F.unix_micros(value.cast("timestamp")))), F.lit(NULL))


def min_key() -> Column:
    return F.lit(MIN_KEY)


def max_key() -> Column:
    return F.lit(MAX_KEY)


def compound(*parts: Column) -> Column:
    """Order key of a compound key from those of its parts."""
    return F.concat(*parts)


def owners(points: DataFrame, ranges: DataFrame, space: Sequence[str], key: str, low: str, high: str, owner: str) -> DataFrame:
    """``points`` with ``owner`` of the range ``low <= key < high`` of their space; NULL where no range holds them.

    ``key``, ``low`` and ``high`` are order keys.  Ranges of a space don't overlap; a range without end has ``MAX_KEY`` or
    NULL as ``high`` and also holds what sorts above everything.  Points and lower bounds are sorted together once and cut
    into chunks; a chunk of points needs the last bound before it and no other, so neither a hot space nor a hot key is one
    task, and no point meets a range that it doesn't lie in.
    """
    names = [c for c in points.columns if c not in space]
    sorted_key, kind, salt, bound, row, chunk = ("__owner_" + n for n in ("key", "kind", "salt", "bound", "row", "chunk"))
    held = F.struct(F.coalesce(F.nullif(F.col(high), F.lit(MAX_KEY)), F.lit("~")).alias("high"), F.col(owner).alias("owner"))
    bounds = ranges.select(*space, F.col(low).alias(sorted_key), F.lit(0).alias(kind), F.lit(0).cast("bigint").alias(salt), held.alias(bound))
    rows = points.select(*space, F.col(key).alias(sorted_key), F.lit(1).alias(kind), F.xxhash64(*points.columns).alias(salt), F.struct(*names).alias(row))
    both = bounds.unionByName(rows, allowMissingColumns=True)
    order = [sorted_key, kind, salt]
    # Sorted and written once: the place in the sorted table is the chunk.
    placed = staged(
        both.repartitionByRange(*space, *order).sortWithinPartitions(*space, *order).withColumn(chunk, F.monotonically_increasing_id()),
        "keys_and_bounds",
    )
    part = F.shiftright(chunk, 33) * F.lit(1 << 33) + F.floor(F.col(chunk).bitwiseAND((1 << 33) - 1) / CHUNK_ROWS)
    carried = with_running(placed, space, order, part, [LastValue(F.col(bound), "__owner_last")])
    found = carried.filter(F.col(kind) == 1)
    inside = F.col("__owner_last.high").isNotNull() & (F.col(sorted_key) < F.col("__owner_last.high"))
    return found.select(*space, f"{row}.*", F.when(inside, F.col("__owner_last.owner")).alias(owner)).select(*points.columns, owner)
