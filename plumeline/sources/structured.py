"""Structured JSON logs: one column set per component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumeline.functions import jsonpath as jp
from plumeline.functions.shape import query_shape
from plumeline.functions.times import minus_millis
from plumeline.operators.commands import ratio
from plumeline.operators.running import RunningSum, with_running
from plumeline.schemas import as_log_events

# Fields of an entry and of its attributes.
ENVELOPE = (
    "t struct<`$date`:string>, s string, c string, id bigint, ctx string, msg string, attr string, "
    "truncated string, size bigint"
)
ATTR = (
    "type string, ns string, appName string, command string, originatingCommand string, planSummary string, "
    "queryHash string, planCacheKey string, docsExamined bigint, keysExamined bigint, nreturned bigint, "
    "nShards bigint, numYields bigint, reslen bigint, durationMillis bigint, hasSortStage boolean, "
    "locks string, storage string, remote string, connectionId string, connectionCount bigint, "
    "client string, doc string, host string"
)
# Messages that describe the process, and the header field of each.
HEADER_MESSAGES = {
    "Process Details": "process",
    "Build Info": "build",
    "Operating System": "os",
    "Options set by command line": "cmd_line",
}
# Components whose entries carry a thread, a message and details.
DETAIL_COMPONENTS = ("REPL", "SHARDING", "SH_REFR", "ELECTION")
SLOW_COMPONENTS = ("COMMAND", "WRITE")
ACCESS_COMPONENTS = ("-", "ACCESS")
SLOW_MESSAGE = "Slow query"


def parse_envelopes(entries: DataFrame) -> DataFrame:
    """Entries with their envelope ``e`` and attributes ``a``; ``ts`` is NULL for rejects."""
    return (
        entries.withColumn("e", F.from_json("entry", ENVELOPE))
        .withColumn("a", F.from_json("e.attr", ATTR))
        .withColumn("ts", F.try_to_timestamp(F.col("e.t.`$date`")))
    )


def is_header(c: Column, msg: Column) -> Column:
    return (c == "CONTROL") & msg.isin(*HEADER_MESSAGES)


def header_rows(parsed: DataFrame) -> DataFrame:
    """The entries that describe a process."""
    return parsed.filter(is_header(F.col("e.c"), F.col("e.msg")))


def structured_events(parsed: DataFrame, base: dict[str, Column]) -> DataFrame:
    """Log events of structured entries; ``base`` holds the columns common to all formats."""
    c, msg, ctx, attr = F.col("e.c"), F.col("e.msg"), F.col("e.ctx"), F.col("e.attr")
    a = {n.split()[0]: F.col(f"a.{n.split()[0]}") for n in ATTR.split(", ")}
    rows = parsed.filter(~F.coalesce(is_header(c, msg), F.lit(False)))

    slow = c.isin(*SLOW_COMPONENTS) & (msg == SLOW_MESSAGE)
    net = c == "NETWORK"
    kind = a["type"]
    command_doc = a["command"].startswith("{")
    ns_target = F.get(F.split(a["ns"], r"\."), F.lit(1))
    first = jp.first_key(a["command"])
    first_value = F.element_at(F.from_json(a["command"], "map<string,string>"), first)
    origin_first = jp.first_key(a["originatingCommand"])
    origin_value = F.element_at(F.from_json(a["originatingCommand"], "map<string,string>"), origin_first)

    # One parse of the command names the operation; the rest follows from it.
    rows = rows.withColumns(
        {
            "op_name": F.when(
                slow,
                F.when((kind == "command") & command_doc, first)
                .when(kind == "getmore", first)
                .when(kind.isin("update", "remove"), kind)
                .when(kind != "command", kind),
            ),
            "op_target": F.when(
                slow,
                F.when(
                    (kind == "command") & command_doc,
                    F.when(
                        first == "getMore",
                        F.coalesce(F.get_json_object(a["command"], "$.collection"), ns_target),
                    ).otherwise(first_value),
                )
                .when(kind == "getmore", origin_value)
                .otherwise(ns_target),
            ),
            "op_cursor": F.when(slow & (first == "getMore"), first_value),
            "op_doc": F.when(slow, F.when(kind == "getmore", a["originatingCommand"]).otherwise(a["command"])),
            "op_of_filter": F.when(slow, F.when(kind == "getmore", origin_first).when(kind.isin("update", "remove"), kind).otherwise(first)),
        }
    )
    own = jp.filter_of(F.col("op_of_filter"), F.col("op_doc"))
    opened = F.when(F.col("op_name") == "getMore", jp.getmore_filter(a["originatingCommand"]))
    rows = rows.withColumn("filter_text", F.when(slow, F.coalesce(own, opened)))
    rows = rows.withColumns(
        {"q": query_shape("filter_text"), "w": jp.waits(F.when(slow, a["locks"]), F.when(slow, a["storage"]))}
    )
    has_filter = F.col("filter_text").isNotNull()

    details_of = c.isin(*DETAIL_COMPONENTS)
    accepted, ended, client = (msg == m for m in ("Connection accepted", "Connection ended", "client metadata"))
    known_net = accepted | ended | client
    applied = (c == "REPL") & (msg == "Applied op")
    txn_plain = (c == "TXN") & (msg == "transaction")
    other = ~(net | details_of | c.isin("CONTROL", "TXN", *SLOW_COMPONENTS, *ACCESS_COMPONENTS))
    session_doc = F.when(slow, F.col("op_doc")).when(c == "TXN", attr)

    return as_log_events(
        rows,
        base
        | {
            "type": c,
            "ts": F.col("ts"),
            "id": F.col("e.id"),
            "severity": F.col("e.s"),
            "operation": F.when(net, F.when(accepted, "accept").when(ended, "end").when(client, "start")),
            "connection": F.when(
                net,
                F.when(accepted, F.concat(F.lit("conn"), a["connectionId"])).when(ended, ctx).when(client, a["client"]),
            )
            .when(c.isin("TXN", *SLOW_COMPONENTS, *ACCESS_COMPONENTS), ctx)
            .when(other, jp.connection_id(ctx)),
            "connection_count": F.when(net & accepted, a["connectionCount"]),
            "connection_info": F.when(net & client, a["doc"]),
            "thread": F.when((net & ~known_net) | details_of, ctx),
            "ip_addr": F.when(net, jp.ip_address(a["remote"])),
            "message": F.when(~slow & ~applied & ~txn_plain & ~(net & known_net), msg),
            "applied_op": F.when(applied, jp.first_key(attr)),
            "details": F.when((net & ~known_net) | details_of | ((c == "TXN") & ~txn_plain), attr),
            "attr": F.when(slow, F.col("op_doc")).when(
                txn_plain | other | c.isin(*SLOW_COMPONENTS, *ACCESS_COMPONENTS), attr
            ),
            "command": F.col("op_name"),
            "object": F.col("op_target"),
            "application": F.when(slow, a["appName"]),
            "cursor": F.col("op_cursor"),
            "batch_size": F.when(slow, F.get_json_object(a["command"], "$.batchSize").try_cast("bigint")),
            "filter_shape": F.when(has_filter, F.col("q.shape")),
            "filter_params": F.when(has_filter, F.col("q.params")),
            "query_hash": F.when(slow, a["queryHash"]),
            "plan_cache_key": F.when(slow, a["planCacheKey"]),
            "plan_summary": F.when(slow, a["planSummary"]),
            "docs_examined": F.when(slow, a["docsExamined"]),
            "keys_examined": F.when(slow, a["keysExamined"]),
            "nreturned": F.when(slow, a["nreturned"]),
            "n_shards": F.when(slow, a["nShards"]),
            "num_yields": F.when(slow, a["numYields"]),
            "reslen": F.when(slow, a["reslen"]),
            "duration_millis": F.when(slow, a["durationMillis"]),
            "has_sort_stage": F.when(slow, a["hasSortStage"]),
            "ratio": F.when(slow, ratio(a["docsExamined"], a["nreturned"])),
            "start_ts": F.when(slow, minus_millis(F.col("ts"), a["durationMillis"])),
            "waits": F.col("w"),
            "session_id": jp.session_id(session_doc),
            "txn_number": jp.txn_number(session_doc),
            "originating_command": F.when(slow, a["originatingCommand"]),
            "locks": F.when(slow, a["locks"]),
            "storage": F.when(slow, a["storage"]),
            "truncated": F.col("e.truncated"),
            "size": F.col("e.size"),
            "log_date": F.to_date("ts"),
        },
    )


def oversize_lengths(events: DataFrame) -> DataFrame:
    """Claimed length of invalid messages as an exact number of any size."""
    length = jp.oversize_number(F.get_json_object("details", "$.msgLen"))
    return events.filter(F.col("message") == "recv(): message mstLen is invalid.").select("infile", "lineno", length.alias("msg_len"))


def log_headers(parsed: DataFrame) -> DataFrame:
    """One row per process start with what it reported until the next one."""
    rows = header_rows(parsed).select(
        "infile", "block", "lineno", "ts",
        F.col("e.msg").alias("msg"), F.col("e.attr").alias("attr"), F.col("a.host").alias("host"),
    )
    start = F.when(F.col("msg") == "Process Details", 1).otherwise(0)
    numbered = with_running(rows, ["infile"], ["lineno"], F.col("block"), [RunningSum(start, "restart_id")])
    fields = [
        F.max_by(F.when(F.col("msg") == m, F.col("attr")), F.when(F.col("msg") == m, F.col("lineno"))).alias(name)
        for m, name in HEADER_MESSAGES.items()
    ]
    return (
        numbered.filter(F.col("restart_id") > 0)
        .groupBy("infile", "restart_id")
        .agg(F.min("ts").alias("ts"), F.min("lineno").alias("lineno"), F.max("host").alias("host"), *fields)
    )
