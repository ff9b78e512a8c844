"""Entries, restarts and carried headers on tables of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumeline.operators.running import LastValue, RunningSum, with_running


def stitch_by_start(
    lines: DataFrame, keys: Sequence[str], order: str, value: str, is_start: Column, chunk: Column, separator: str = "",
) -> DataFrame:
    """Join every line that is no entry start onto the entry before.

    Lines ahead of the first start form entry 0.
    """
    numbered = with_running(lines, keys, [order], chunk, [RunningSum(is_start.cast("int"), "entry_id")])
    return _gather(numbered, keys, order, value, separator)


def stitch_by_end(
    lines: DataFrame, keys: Sequence[str], order: str, value: str, is_end: Column, chunk: Column, separator: str = "\\n",
) -> DataFrame:
    """Join lines until one that ends an entry."""
    ended = is_end.cast("int")
    numbered = with_running(lines, keys, [order], chunk, [RunningSum(ended, "entry_id")])
    # The ending line itself still belongs to its entry.
    numbered = numbered.withColumn("entry_id", F.col("entry_id") - ended)
    return _gather(numbered, keys, order, value, separator)


def _gather(numbered: DataFrame, keys: Sequence[str], order: str, value: str, separator: str) -> DataFrame:
    line = F.struct(F.col(order).alias("o"), F.col(value).alias("v"))
    texts = F.transform(F.array_sort(F.collect_list(line)), lambda x: x.v)
    return numbered.groupBy(*keys, "entry_id").agg(
        F.min(order).alias("first_line"),
        F.max(order).alias("last_line"),
        F.count("*").alias("n_lines"),
        F.array_join(texts, separator).alias("entry"),
    )


def carry_forward(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, chunk: Column
) -> DataFrame:
    """Last non-null value at or before each row."""
    return with_running(rows, keys, order, chunk, [LastValue(value, name)])


def restart_headers(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], is_restart: Column, chunk: Column,
    attributes: dict[str, Column], at: str = "ts",
) -> DataFrame:
    """One header row per restart with the attributes reported until the next.

    Rows ahead of the first restart have no header.
    """
    numbered = with_running(rows, keys, order, chunk, [RunningSum(is_restart.cast("int"), "restart_id")])
    return (
        numbered.filter(F.col("restart_id") > 0)
        .groupBy(*keys, "restart_id")
        .agg(F.min(at).alias(at), *[F.max(v).alias(n) for n, v in attributes.items()])
    )


def stop_after_end(rows: DataFrame, keys: Sequence[str], order: str, ts: str, end) -> DataFrame:
    """Rows ahead of the first one past ``end`` in every file; later rows go, in range or not."""
    stop = rows.filter(F.col(ts) > F.lit(end)).groupBy(*keys).agg(F.min(order).alias("__stop"))
    return rows.join(stop, list(keys), "left").filter(
        F.col("__stop").isNull() | (F.col(order) < F.col("__stop"))
    ).drop("__stop")
