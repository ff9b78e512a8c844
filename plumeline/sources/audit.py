"""Audit logs and search-daemon logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumeline.functions.jsonpath import key_values
from plumeline.schemas import as_log_events

# Fields of a search-daemon entry and of its configuration message.
SEARCH_ENVELOPE = "t string, s string, svc string, n string, msg string, attr string"
CONFIG_MESSAGE = "ConfCallResponse"
CONFIG_KEYS = (
    "id", "version", "mongoDbUri", "mongosUri", "mongoDbClusterUri", "createDate", "lastUpdateDate",
    "searchIndexes", "vectorIndexes", "analyzerDefinitions", "blobstoreParams", "embeddingServiceConfigs",
)


def audit_ts(entry: Column) -> Column:
    """Time of an audit entry, plain or wrapped."""
    return F.try_to_timestamp(F.coalesce(F.get_json_object(entry, "$.ts.$date"), F.get_json_object(entry, "$.ts")))


def parse_audit(entries: DataFrame) -> DataFrame:
    """Entries with type and time; NULL time marks rejects."""
    return entries.withColumns(
        {"atype": F.get_json_object("entry", "$.atype"), "ts": audit_ts(F.col("entry"))}
    )


def audit_events(parsed: DataFrame, base: dict[str, Column]) -> DataFrame:
    """Log events of audit entries; the whole entry stays in ``raw``."""
    return as_log_events(
        parsed,
        base | {"type": F.col("atype"), "ts": F.col("ts"), "raw": F.col("entry"), "log_date": F.to_date("ts")},
    )


def parse_search(entries: DataFrame) -> DataFrame:
    """Search-daemon entries with envelope ``s``; NULL time marks rejects."""
    text = F.substring(F.col("s.t"), 1, 23)
    return entries.withColumn("s", F.from_json("entry", SEARCH_ENVELOPE)).withColumn(
        "ts", F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))
    )


def search_config(msg: Column) -> Column:
    """Configuration fields of a ``ConfCallResponse`` message as a map."""
    keys = "|".join(CONFIG_KEYS)
    pattern = rf"\b({keys})=(?:Optional\[)?(.+?)(?=\]?, (?:{keys})=|\]?\}}?\)?$)"
    return F.when(msg.startswith(CONFIG_MESSAGE), key_values(msg, pattern))


def search_events(parsed: DataFrame, base: dict[str, Column]) -> DataFrame:
    """Log events of search-daemon entries."""
    msg = F.col("s.msg")
    return as_log_events(
        parsed,
        base
        | {
            "type": F.col("s.svc"),
            "ts": F.col("ts"),
            "module": F.col("s.n"),
            "severity": F.col("s.s"),
            "message": F.when(msg.startswith(CONFIG_MESSAGE), CONFIG_MESSAGE).otherwise(msg),
            "attr": F.col("s.attr"),
            "config": search_config(msg),
            "raw": F.col("entry"),
            "log_date": F.to_date("ts"),
        },
    )
