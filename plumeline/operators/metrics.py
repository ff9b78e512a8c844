"""Increments of metric series and where they jumped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumeline.operators.running import MaxBefore, Previous, RunningSum, with_running


def increments(
    samples: DataFrame,
    series: Sequence[str] = ("file", "chunk_no", "path"),
    order: Sequence[str] = ("sample_no",),
    value: str = "value",
) -> DataFrame:
    """``inc`` against the sample before, 0 on the first sample of a series.

    For series of bounded length, such as one metric in one archive chunk.
    """
    w = Window.partitionBy(*series).orderBy(*order)
    return samples.withColumn("inc", F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0)))


def series_increments(series: DataFrame) -> DataFrame:
    """The samples of archive series (``decode_series``) with ``inc``, as ``increments`` gives it, inside their rows: nothing is sorted."""
    steps = F.transform("values", lambda v, i: F.struct(v.alias("value"), (v - F.coalesce(F.get("values", i - 1), "before")).alias("inc")))
    found = series.select("file", "chunk_no", "path", "first", "starts", F.posexplode(steps).alias("at", "step"))
    return found.select(
        "file", "chunk_no", (F.col("first") + F.col("at")).alias("sample_no"), "path",
        F.timestamp_millis(F.get("starts", F.col("at"))).alias("ts"), "step.value", "step.inc",
    )


def largest_steps(series: DataFrame, by: Sequence[str] = ("file", "path")) -> DataFrame:
    """``max_increment`` of archive series: each row gives its largest step, so that only a row for some thousand samples is sorted."""
    steps = F.transform(
        "values",
        lambda v, i: F.struct((v - F.coalesce(F.get("values", i - 1), "before")).alias("inc"), F.timestamp_millis(F.get("starts", i)).alias("ts")),
    )
    return max_increment(series.select(*by, F.array_max(steps).alias("step")).select(*by, "step.inc", "step.ts"), by)


def increments_across(
    samples: DataFrame, series: Sequence[str], order: Sequence[str], chunk: Column, value: str = "value"
) -> DataFrame:
    """``inc`` over unbounded series: the sample before may lie in an earlier chunk."""
    out = with_running(samples, series, order, chunk, [Previous(F.col(value), "__prev")])
    return out.withColumn("inc", F.coalesce(F.col(value) - F.col("__prev"), F.lit(0))).drop("__prev")


def max_increment(incs: DataFrame, by: Sequence[str] = ("path",), ts: str = "ts") -> DataFrame:
    """Largest positive increase of every series and its time; the latest wins a tie."""
    best = F.max(F.struct(F.col("inc"), F.col(ts)))
    return (
        incs.filter(F.col("inc") > 0)
        .groupBy(*by)
        .agg(best.alias("best"))
        .select(*by, F.col("best.inc").alias("max_inc"), F.col(f"best.{ts}").alias("max_ts"))
    )


def record_highs(incs: DataFrame, by: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """Samples whose increase is at least as large as every one before."""
    out = with_running(incs, by, order, chunk, [MaxBefore(F.col("inc"), "__before")])
    return out.filter((F.col("inc") > 0) & (F.col("inc") >= F.coalesce("__before", F.lit(0)))).drop("__before")


def delta_decode(
    deltas: DataFrame, series: Sequence[str], order: Sequence[str], chunk: Column, delta: str = "delta",
    out: str = "value",
) -> DataFrame:
    """Values from deltas: running sum from the first value of the series."""
    return with_running(deltas, series, order, chunk, [RunningSum(F.col(delta), out)])


def metric_keys(samples: DataFrame) -> DataFrame:
    """Distinct metric paths."""
    return samples.select("path").distinct()


def first_of_chunk(samples: DataFrame) -> DataFrame:
    """First sample of every chunk only."""
    return samples.filter(F.col("sample_no") == 0)
