"""Range, dictionary and fallback lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Leading values are told apart up to this size; beyond it only the exact test does.
_FAR = 2.0**62
_FINEST = -20


def range_join(
    points: DataFrame, ranges: DataFrame, key: Column, low: Column, high: Column,
    lead_key: Column, lead_low: Column, lead_high: Column, on: dict[str, str] | None = None,
) -> DataFrame:
    """Join points to ranges ``[low, high)`` without comparing all pairs.

    ``key``, ``low`` and ``high`` may be structs for composite keys; the
    ``lead_*`` columns are their numeric leading parts.  A range of width w
    belongs to the level of bins that are at least w wide, by powers of two, and
    touches two of them at most.  A point is looked up once per level that has
    ranges (84 levels at most, usually a few), so the join is an equi-join on
    level and bin, with the exact comparison on top, at any number of ranges.
    ``on`` maps further equal columns of points to ranges (a namespace).
    """

    def near(value: Column) -> Column:
        return F.greatest(F.least(value.cast("double"), F.lit(_FAR)), F.lit(-_FAR))

    def bin_of(value: Column, level: Column) -> Column:
        return F.floor(near(value) / F.pow(F.lit(2.0), level)).cast("bigint")

    width = near(lead_high) - near(lead_low)
    level = F.when(width > 0, F.greatest(F.ceil(F.log2(width)).cast("int"), F.lit(_FINEST))).otherwise(F.lit(0))
    listed = ranges.withColumn("__level", level).filter(F.col("__level").isNotNull() & lead_low.isNotNull() & lead_high.isNotNull())
    levels = sorted(r[0] for r in listed.select("__level").distinct().collect())
    listed = listed.withColumn("__bin", F.explode(F.sequence(bin_of(lead_low, F.col("__level")), bin_of(lead_high, F.col("__level")))))
    at = F.array(*[F.lit(x) for x in levels]).cast("array<int>")
    located = points.withColumn("__at", F.explode(at)).withColumn("__in", bin_of(lead_key, F.col("__at")))
    cond = (F.col("__at") == F.col("__level")) & (F.col("__in") == F.col("__bin")) & (low <= key) & (key < high)
    for mine, theirs in (on or {}).items():
        cond = cond & (located[mine] == listed[theirs])
    return located.join(listed, cond).drop("__at", "__in", "__level", "__bin")


def with_dictionary(rows: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Inner lookup by id; broadcast only while Spark measures the side as small."""
    return rows.join(dictionary, key)


def rows_with_match(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows that have data on the other side."""
    return rows.join(other.select(*on), on, "left_semi")


def rows_without_match(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows that have no data on the other side."""
    return rows.join(other.select(*on), on, "left_anti")


def join_with_fallback(
    left: DataFrame, right: DataFrame, exact: list[tuple[str, str]], fallback: list[tuple[Column, str]]
) -> DataFrame:
    """Exact join; left rows without a partner try the fallback key.

    ``match`` tells which key found the rows.
    """

    def on(pairs, l, r):
        cond = F.lit(True)
        for a, b in pairs:
            cond = cond & ((l[a] if isinstance(a, str) else a) == r[b])
        return cond

    first = left.join(right, on(exact, left, right)).withColumn("match", F.lit("exact"))
    keys = right.select(*[b for _, b in exact]).distinct()
    rest = left.join(keys, on(exact, left, keys), "left_anti")
    second = rest.join(right, on(fallback, rest, right)).withColumn("match", F.lit("fallback"))
    return first.unionByName(second)
