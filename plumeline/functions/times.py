"""Time buckets, date parsing and range predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted date texts (day, second, fraction with offset).
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX][XX]")


def parse_date(text: Column) -> Column:
    """First format that fits the text, NULL when none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in DATE_FORMATS])


def bucket_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling bucket of ``ts``; keeps TIMESTAMP or TIMESTAMP_NTZ."""
    return F.window(ts, f"{seconds} seconds").getField("start")


def between_strict(ts: Column, start=None, end=None) -> Column:
    """Report convention: both ends excluded, either side may be open."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (ts > F.lit(start))
    if end is not None:
        cond = cond & (ts < F.lit(end))
    return cond


def between_inclusive(ts: Column, start=None, end=None) -> Column:
    """Ingest convention: both ends included."""
    if start is not None and end is not None and start > end:
        raise ValueError(f"start {start} is after end {end}")
    cond = F.lit(True)
    if start is not None:
        cond = cond & (ts >= F.lit(start))
    if end is not None:
        cond = cond & (ts <= F.lit(end))
    return cond


def minus_millis(ts: Column, millis: Column) -> Column:
    """``ts`` moved back by a number of milliseconds."""
    return F.timestamp_add("MILLISECOND", -millis, ts)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference in seconds as a double, microseconds kept."""
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return micros / F.lit(1e6)


def iso_duration(earlier: Column, later: Column) -> Column:
    """Distance as ISO-8601 text (``PT1H2M3.5S``), sign on every part."""
    ms = F.timestamp_diff("MILLISECOND", earlier, later)
    hours = (ms / 3600000).cast("bigint")
    minutes = ((ms % 3600000) / 60000).cast("bigint")
    rest = (ms % 60000).cast("decimal(18,3)") / F.lit(1000).cast("decimal(4,0)")
    seconds = F.regexp_replace(F.regexp_replace(rest.cast("decimal(18,3)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    body = F.concat(
        F.when(hours != 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""),
        F.when(minutes != 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""),
        F.when(rest != 0, F.concat(seconds, F.lit("S"))).otherwise(""),
    )
    return F.concat(F.lit("PT"), F.when(ms == 0, F.lit("0S")).otherwise(body))
