"""Columns of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_PARAMS = "array<struct<type:string,value:string>>"

# Documents stay JSON text: their key order matters for shapes and shard keys.
LOG_EVENT = {
    "type": "string",
    "ts": "timestamp",
    "infile": "string",
    "short_name": "string",
    "lineno": "bigint",
    "id": "bigint",
    "severity": "string",
    "host": "string",
    "node_type": "string",
    "module": "string",
    "operation": "string",
    "connection": "string",
    "thread": "string",
    "ip_addr": "string",
    "user": "string",
    "message": "string",
    "applied_op": "string",
    "connection_count": "bigint",
    "connection_info": "string",
    "command": "string",
    "object": "string",
    "application": "string",
    "cursor": "string",
    "batch_size": "bigint",
    "filter_shape": "string",
    "filter_params": _PARAMS,
    "query_hash": "string",
    "plan_cache_key": "string",
    "plan_summary": "string",
    "docs_examined": "bigint",
    "keys_examined": "bigint",
    "nreturned": "bigint",
    "n_shards": "bigint",
    "num_yields": "bigint",
    "reslen": "bigint",
    "duration_millis": "bigint",
    "has_sort_stage": "boolean",
    "ratio": "double",
    "start_ts": "timestamp",
    "waits": "struct<total_micros:bigint,locks:array<string>>",
    "session_id": "string",
    "txn_number": "bigint",
    "shard_op": "string",
    "collection": "string",
    "shard_range": "struct<min:string,max:string>",
    "config": "map<string,string>",
    "stats": "map<string,string>",
    "truncated": "string",
    "size": "bigint",
    "attr": "string",
    "originating_command": "string",
    "locks": "string",
    "storage": "string",
    "details": "string",
    "raw": "string",
    "log_date": "date",
}


def as_log_events(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """All columns of a log event, NULL where ``columns`` has none."""
    unknown = set(columns) - set(LOG_EVENT)
    if unknown:
        raise ValueError(f"not log event columns: {sorted(unknown)}")
    return df.select(
        *[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in LOG_EVENT.items()]
    )
