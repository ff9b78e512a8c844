"""Metrics per time bucket, crosstabs and gap filling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumeline.functions.times import bucket_start
from plumeline.session import staged

# Accumulator names a metric may use.
ACCUMULATORS = ("$sum", "$avg", "$min", "$max", "$first", "$last", "$push", "$addToSet")

# Fixed value: where absent and unlisted items are counted.
OTHER = "Other"

_DAY = 86400


@dataclass(frozen=True)
class Metric:
    """One user-chosen measure: ``name|unit|var|op|field``.

    ``field`` is a Spark SQL expression.  ``$push`` keeps every value of a
    bucket in one cell; use it with narrow buckets only.
    """

    name: str
    unit: str
    var: str
    op: str | None = None
    field: str | None = None

    @classmethod
    def parse(cls, text: str) -> "Metric":
        parts = text.split("|")
        if len(parts) not in (3, 5):
            raise ValueError(f"expected name|unit|var or name|unit|var|op|field, got {text!r}")
        return cls(*parts)

    def aggregate(self, order: Sequence[str]) -> Column:
        value = F.expr(self.field)
        at = F.struct(*order)
        table = {
            "$sum": lambda: F.coalesce(F.sum(value), F.lit(0)),
            "$avg": lambda: F.avg(value),
            "$min": lambda: F.min(value),
            "$max": lambda: F.max(value),
            "$first": lambda: F.min_by(value, at),
            "$last": lambda: F.max_by(value, at),
            "$push": lambda: F.collect_list(value),
            "$addToSet": lambda: F.array_sort(F.collect_set(value)),
        }
        if self.op not in table:
            raise ValueError(f"unknown accumulator {self.op!r}; use one of {ACCUMULATORS}")
        return table[self.op]().alias(self.var)


def time_metrics(
    df: DataFrame,
    seconds: int,
    metrics: Sequence[Metric] = (),
    predicate: str | None = None,
    ts: str = "ts",
    fill: bool = True,
    ordered: bool = True,
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """``Time``, one column per metric and ``Total`` for every bucket.

    Rows of one time are in order of ``tie_break``: file and line by default, if
    the table has them.
    """
    rows = df.filter(predicate) if predicate else df
    ties = tie_break if tie_break is not None else [c for c in ("infile", "lineno") if c in df.columns]
    aggs = [m.aggregate([ts, *ties]) for m in metrics if m.op]
    out = rows.groupBy(bucket_start(F.col(ts), seconds).alias("Time")).agg(*aggs, F.count("*").alias("Total"))
    if fill:
        out = fill_gaps(out, "Time", seconds)
    return out.orderBy("Time") if ordered else out


def fill_gaps(buckets: DataFrame, time: str, seconds: int) -> DataFrame:
    """Add the empty buckets between the first and the last one, numbers as 0.

    ``buckets`` holds one row per bucket.  It is written once, so the log rows
    behind it are read once and not again for the first and last bucket.  The
    time line is spread day by day over the cluster, so seconds over years do
    not come from one task.
    """
    spark = buckets.sparkSession
    buckets = staged(buckets, "buckets")
    day = F.window(F.col("lo"), f"{_DAY} seconds").getField("start") if seconds < _DAY else F.col("lo")
    step = max(seconds, _DAY)
    days = (
        buckets.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
        .filter(F.col("lo").isNotNull())
        .withColumn("first_day", day)
        .select("lo", "hi", F.explode(F.expr(f"sequence(first_day, hi, interval {step} seconds)")).alias("day"))
    )
    if seconds < _DAY:
        if _DAY % seconds:
            raise ValueError("bucket width must divide a day")
        days = days.repartition(spark.sparkContext.defaultParallelism, "day").select(
            "lo",
            "hi",
            F.explode(
                F.expr(f"sequence(day, day + interval {_DAY - seconds} seconds, interval {seconds} seconds)")
            ).alias(time),
        )
        spine = days.filter(F.col(time).between(F.col("lo"), F.col("hi"))).select(time)
    else:
        spine = days.select(F.col("day").alias(time))
    return spine.join(buckets, time, "left").fillna(0)


def crosstab_long(df: DataFrame, item: str, seconds: int, predicate: str | None = None, ts: str = "ts") -> DataFrame:
    """Count by bucket and item, an absent item under ``Other``; any number of items."""
    rows = df.filter(predicate) if predicate else df
    return rows.groupBy(
        bucket_start(F.col(ts), seconds).alias("Time"),
        F.coalesce(F.expr(item).cast("string"), F.lit(OTHER)).alias("Item"),
    ).agg(F.count("*").alias("Total"))


def crosstab_items(long: DataFrame) -> list[str]:
    """Item names in order of first appearance, then by name.

    The list becomes column names, so it is bounded by the pivot limit of the
    session; a longer one stays in the long form.
    """
    limit = int(long.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    names = (
        long.groupBy("Item").agg(F.min("Time").alias("seen")).orderBy("seen", "Item").limit(limit + 1).collect()
    )
    if len(names) > limit:
        raise ValueError(f"more than {limit} items: use crosstab_long")
    return [r["Item"] for r in names]


def crosstab(
    df: DataFrame,
    item: str,
    seconds: int,
    items: Sequence[str] | None = None,
    predicate: str | None = None,
    ts: str = "ts",
    fill: bool = True,
) -> DataFrame:
    """One row per bucket, one column per item.

    With a given list, items that are not on it are counted under ``Other``.
    """
    if items is not None:
        listed = ", ".join("'" + i.replace("\\", "\\\\").replace("'", "\\'") + "'" for i in items)
        item = f"case when ({item}) in ({listed}) then ({item}) end" if items else "cast(null as string)"
    long = crosstab_long(df, item, seconds, predicate, ts)
    names = list(dict.fromkeys([*items, OTHER])) if items is not None else crosstab_items(long)
    wide = long.groupBy("Time").pivot("Item", names).agg(F.sum("Total")).fillna(0)
    if fill:
        wide = fill_gaps(wide, "Time", seconds)
    return wide.orderBy("Time")
