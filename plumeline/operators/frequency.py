"""Token, driver and event frequency counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Keywords a slow text line may carry.
LOG_KEYWORDS = (
    "command:", "numYields:", "reslen:", "nShards:", "ninserted:", "nreturned:",
    "cursorExhausted:", "nMatched:", "nModified:", "cursorid:", "originatingCommand:",
    "locks:", "storage:", "planSummary:", "keysExamined:",
    "docsExamined:", "flowControl:", "writeConflicts:", "keysInserted:",
    "keysDeleted:", "appName:", "hasSortStage:", "prepareReadConflicts:", "fromMultiPlanner:",
    "ndeleted:", "planCacheKey:", "queryHash:",
)


def token_frequency(lines: DataFrame, text: Column) -> DataFrame:
    """``kind, token, count`` of all whitespace tokens; dots become ``_``.

    Tokens are counted inside each task before the shuffle, so a token that
    fills a third of the text is one row per task.
    """
    token = F.explode(F.filter(F.split(text, r"\s+"), lambda t: t != ""))
    kind = F.when(F.col("token").isin(*LOG_KEYWORDS), "keyword").otherwise("string")
    return (
        lines.select(token.alias("token"))
        .select(kind.alias("kind"), F.replace("token", F.lit("."), F.lit("_")).alias("token"))
        .groupBy("kind", "token")
        .agg(F.count("*").alias("count"))
    )


def command_frequency(ops: DataFrame, command: str = "command") -> DataFrame:
    """Count by command name, an absent one as ``Missing``."""
    name = F.coalesce(F.replace(F.col(command), F.lit("."), F.lit("_")), F.lit("Missing"))
    return ops.groupBy(name.alias("token")).agg(F.count("*").alias("count")).select(
        F.lit("command").alias("kind"), "token", "count"
    )


def driver_counts(clients: DataFrame, ip: Column, driver: Column) -> DataFrame:
    """Connections by client address and driver."""
    return clients.groupBy(ip.alias("ip"), driver.alias("driver")).agg(F.count("*").alias("count"))


def event_time_by_key(events: DataFrame, key: Column, millis: Column) -> DataFrame:
    """Number of events and total time by key."""
    return events.groupBy(key.alias("key")).agg(
        F.count("*").alias("count"), F.coalesce(F.sum(millis), F.lit(0)).alias("total_time")
    )
