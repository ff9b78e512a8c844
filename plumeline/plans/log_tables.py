"""The given tables rendered as log entries, and the ingest jobs over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumeline.operators import commands as cm
from plumeline.operators import fields as fi
from plumeline.operators import profile as pr
from plumeline.operators import schema_profile as sp
from plumeline.plans import tables as tb
from plumeline.plans.tables import prop_k, read
from plumeline.session import scratch_path, staged
from plumeline.sources import audit, structured, textlog

# Entries that stand in one block of a rendered file.
BLOCK_LINES = 1000


def fill(template: str, **values: Column) -> Column:
    """``template`` with every ``<name>`` replaced by a column."""
    parts = re.split(r"<(\w+)>", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p or i % 2])


def _choice(number: Column, templates: list[str], values: dict[str, Column]) -> Column:
    out = None
    for i, template in enumerate(templates):
        text = fill(template, **values)
        out = F.when(number == i, text) if out is None else out.when(number == i, text)
    return out


def _event_values(ts: str = "ts") -> dict[str, Column]:
    return {
        "at": F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"),
        "n": F.col("event_id"),
        "u": F.col("user_id"),
        "k": prop_k(),
        "ms": F.floor(F.col("value") * 100),
        "d": F.floor(F.col("value") * 10),
        "h": F.col("user_id") % 7,
    }


def _placed(rows: DataFrame, key: str, entry: Column) -> DataFrame:
    """Entries of three files in the columns of the stitching step."""
    line = F.col(key)
    # Written, as the conditions on parsed lines, and so the parsing, would else be moved ahead of the spreading.
    return staged(tb.spread(rows, key), "spread").select(
        F.concat(F.lit("node"), (line % 3).cast("string"), F.lit(".log")).alias("infile"),
        (F.floor(line / BLOCK_LINES) * BLOCK_LINES).cast("bigint").alias("block"),
        line.cast("bigint").alias("lineno"),
        entry.alias("entry"),
    )


_HEAD = '{"t":{"$date":"<at>+00:00"},"s":"I","c":'
_JSON = [
    _HEAD + '"COMMAND","id":51803,"ctx":"conn<u>","msg":"Slow query","attr":{"type":"command","ns":"shop.u<u>","appName":"app<h>",'
    '"command":{"find":"u<u>","filter":{"k":<k>,"u":{"$in":[<u>,<k>]}},"sort":{"k":-1},"batchSize":<k>,"lsid":{"id":"s<u>"},"txnNumber":<n>},'
    '"planSummary":"IXSCAN { k: 1 }","keysExamined":<d>,"docsExamined":<d>,"nreturned":<k>,"nShards":<h>,"queryHash":"H<h>","planCacheKey":"P<h>",'
    '"hasSortStage":true,"locks":{"Global":{"acquireCount":{"r":1},"timeWaitingMicros":{"r":<k>}}},'
    '"storage":{"data":{"timeReadingMicros":<d>},"timeWaitingMicros":{"cache":<ms>}},"durationMillis":<ms>}}',
    _HEAD + '"COMMAND","id":51803,"ctx":"conn<u>","msg":"Slow query","attr":{"type":"command","ns":"shop.u<u>","command":{"getMore":<n>,"collection":"u<u>"},'
    '"originatingCommand":{"aggregate":"u<u>","pipeline":[{"$addFields":{"x":1}},{"$match":{"k":{"$gt":<k>}}}]},"docsExamined":<d>,"nreturned":0,"durationMillis":<ms>}}',
    _HEAD + '"WRITE","id":51803,"ctx":"conn<u>","msg":"Slow query","attr":{"type":"update","ns":"shop.u<u>","command":{"q":{"_id":{"$oid":"a<k>"}},"u":{"$set":{"b":1}}},"durationMillis":<ms>}}',
    _HEAD + '"NETWORK","id":22943,"ctx":"listener","msg":"Connection accepted","attr":{"remote":"10.0.0.<h>:5001","connectionId":<n>,"connectionCount":<k>}}',
    _HEAD + '"REPL","id":51801,"ctx":"repl-<h>","msg":"Applied op","attr":{"CRUD<h>":{"op":"i"}}}',
    _HEAD + '"TXN","id":51802,"ctx":"conn<u>","msg":"transaction","attr":{"parameters":{"lsid":{"id":"s<u>"},"txnNumber":<n>},"durationMillis":3}}',
    _HEAD + '"NETWORK","id":4615638,"ctx":"conn<u>","msg":"recv(): message mstLen is invalid.","attr":{"msgLen":18446744073709551<k>}}',
    _HEAD + '"COMMAND","id":51803,"ctx":"conn<u>","msg":"Slow qu',
]


def json_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Events as structured log entries: slow operations, connections, replication, transactions, damaged lines."""
    rows = read(spark, sf, "events")
    return _placed(rows, "event_id", _choice(F.col("event_id") % len(_JSON), _JSON, _event_values()))


def _base() -> dict[str, Column]:
    return {"infile": F.col("infile"), "lineno": F.col("lineno"), "short_name": F.col("infile")}


def _params(column: str = "filter_params") -> Column:
    return F.array_join(F.transform(column, lambda p: F.concat_ws(":", p["type"], p["value"])), "|")


def _stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS")


def _parsed_json(spark: SparkSession, sf: str) -> DataFrame:
    return structured.parse_envelopes(json_entries(spark, sf))


def _json_events(spark: SparkSession, sf: str) -> DataFrame:
    return structured.structured_events(_parsed_json(spark, sf).filter("ts IS NOT NULL"), _base())


def json_log_events(spark: SparkSession, sf: str) -> DataFrame:
    return _json_events(spark, sf).select(
        "infile", "lineno", "type", _stamp("ts").alias("ts"), "operation", "connection", "connection_count", "ip_addr", "thread", "applied_op",
        "command", "object", "application", "cursor", "batch_size", "filter_shape", _params().alias("params"), "query_hash", "plan_cache_key",
        "plan_summary", "docs_examined", "nreturned", "n_shards", "duration_millis", "has_sort_stage", F.round("ratio", 6).alias("ratio"),
        _stamp("start_ts").alias("start_ts"), F.col("waits.total_micros").alias("wait_micros"), F.array_join("waits.locks", "|").alias("wait_names"),
        "session_id", "txn_number",
    )


def oversize_messages(spark: SparkSession, sf: str) -> DataFrame:
    out = structured.oversize_lengths(_json_events(spark, sf))
    return out.select("infile", "lineno", F.col("msg_len").cast("string").alias("msg_len"))


_HEADERS = {
    "signup": ("Process Details", '{"pid":<n>,"host":"h<u>"}'),
    "purchase": ("Build Info", '{"version":"v<k>"}'),
    "view": ("Operating System", '{"name":"os<k>"}'),
    "click": ("Options set by command line", '{"opts":<k>}'),
}


def log_headers(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events")
    line = '{"t":{"$date":"<at>+00:00"},"s":"I","c":"CONTROL","ctx":"main","msg":"%s","attr":%s}'
    entry = F.lit(None).cast("string")
    for kind, (msg, attr) in _HEADERS.items():
        entry = F.when(F.col("event_type") == kind, fill(line % (msg, attr), **_event_values())).otherwise(entry)
    placed = _placed(rows, "event_id", F.coalesce(entry, fill(line % ("Other", '{"k":<k>}'), **_event_values())))
    out = structured.log_headers(structured.parse_envelopes(placed).filter("ts IS NOT NULL"))
    return out.select("infile", "restart_id", _stamp("ts").alias("ts"), "lineno", "host", "process", "build", "os", "cmd_line")


_TEXT = [
    "<at>-0000 I COMMAND  [conn<c>] command shop.c<c> appName: \"web <p>\" command: find { find: \"c<c>\", filter: { a: <v>, at: { $gt: new Date(<v>000) }, \"n.x\": 'it' } } "
    "planSummary: IXSCAN { a: 1 } keysExamined:<c> docsExamined:<v> hasSortStage:1 numYields:0 nreturned:<c> queryHash:H<p> planCacheKey:P<p> reslen:<v> "
    "locks:{ Global: { acquireCount: { r: 1 }, timeWaitingMicros: { r: <c> } } } storage:{} protocol:op_msg <v>ms",
    "<at>-0000 I COMMAND  [conn<c>] command shop.c<c> command: getMore { getMore: <n>, collection: \"c<c>\" } originatingCommand: { find: \"c<c>\", filter: { b: { $in: [ <c>, 2 ] } } } "
    "planSummary: COLLSCAN cursorid:<n> keysExamined:0 docsExamined:9 numYields:0 nreturned:3 reslen:10 protocol:op_msg <v>ms",
    "<at>-0000 I NETWORK  [listener] connection accepted from 10.0.0.<p>:4000 #<n> (3 connections now open)",
    "<at>-0000 I REPL     [repl-<p>] applied op: CRUD { op: \"i\", ns: \"shop.c<c>\" }, took <v>ms",
    "<at>-0000 I SHARDING [Balancer] Starting chunk migration for shop.c<c> [{ k: <c> }, { k: <v> }) to s1",
    "<at>-0000 I ACCESS   [conn<c>] Successfully authenticated as principal u<c> on admin",
    "<at>-0000 I COMMAND  [conn<c>] successfully set parameter logLevel to <p> (was 0)",
    "<at>-0000 I COMMAND  [conn<c>] command shop.c<c> command: find { find: \"c<c>\", filter: { a: [ <v> } } planSummary: COLLSCAN docsExamined:2 10ms",
    "no time here <n>",
]


def _order_values() -> dict[str, Column]:
    at = F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    return {
        "at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"),
        "n": F.col("o_orderkey"),
        "c": F.col("o_custkey"),
        "p": F.substring("o_orderpriority", 1, 1),
        "v": F.floor("o_totalprice"),
    }


def text_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as text log entries."""
    rows = read(spark, sf, "orders")
    return _placed(rows, "o_orderkey", _choice(F.col("o_orderkey") % len(_TEXT), _TEXT, _order_values()))


def text_log_events(spark: SparkSession, sf: str) -> DataFrame:
    parsed = textlog.parse_text(text_entries(spark, sf)).filter("ts IS NOT NULL").withColumn("host", F.lit(None).cast("string"))
    events, _ = textlog.text_events(parsed, _base())
    return events.select(
        "infile", "lineno", "type", _stamp("ts").alias("ts"), "operation", "connection", "ip_addr", "user", "thread", "applied_op", "shard_op", "collection",
        F.col("shard_range.min").alias("range_min"), F.col("shard_range.max").alias("range_max"), "module", "command", "object", "application", "cursor",
        "filter_shape", _params().alias("params"), "query_hash", "plan_cache_key", "plan_summary", "docs_examined", "keys_examined", "nreturned", "reslen",
        "duration_millis", "has_sort_stage", F.round("ratio", 6).alias("ratio"), F.col("waits.total_micros").alias("wait_micros"),
        F.col("stats")["newValue"].alias("new_value"),
    )


def sharding_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of every kind of sharding message and of an unknown one; the words of a line are numbered."""
    starts = [words for words, *_ in textlog.SHARD_MESSAGES] + ["Some new kind"]
    bodies = []
    for words in starts:
        first = len(words.split())
        bodies.append(f"{words} " + " ".join(f"t{i}x<u>" for i in range(first, 20)))
    bodies[0] = "moveChunk data transfer progress: mem used: <k> documents remaining to clone: <n>"
    line = _choice(F.col("event_id") % len(bodies), [f"<at>-0000 I SHARDING [conn<u>] {body}" for body in bodies], _event_values())
    parsed = textlog.parse_text(_placed(read(spark, sf, "events"), "event_id", line)).filter("ts IS NOT NULL")
    events, _ = textlog.text_events(parsed.withColumn("host", F.lit(None).cast("string")), _base())
    stats = F.array_sort(F.transform(F.map_entries("stats"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return events.select("infile", "lineno", "shard_op", "collection", F.array_join(stats, ";").alias("stats"))


def log_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """What no reader could take: damaged envelopes, lines without time, unreadable documents."""
    text = textlog.parse_text(text_entries(spark, sf))
    _, broken = textlog.text_events(text.filter("ts IS NOT NULL").withColumn("host", F.lit(None).cast("string")), _base())
    parts = [
        (_parsed_json(spark, sf).filter("ts IS NULL"), "unreadable json entry"),
        (text.filter("ts IS NULL"), "unreadable text entry"),
        (broken, "unreadable document"),
    ]
    out = None
    for rows, error in parts:
        part = rows.select("infile", "lineno", F.lit(error).alias("error"))
        out = part if out is None else out.unionByName(part)
    return out


def syslog_events(spark: SparkSession, sf: str) -> DataFrame:
    line = (
        "<day> host<h> mongod.27017[<n>]: [conn<u>] command shop.u<u> command: count { count: \"u<u>\", query: { a: <k> } } "
        "planSummary: COLLSCAN keysExamined:0 docsExamined:<d> nreturned:<k> locks:{} protocol:op_query <ms>ms"
    )
    values = {**_event_values(), "day": F.date_format("ts", "MMM dd HH:mm:ss")}
    # The line of a process has no blank between its name and its number.
    rows = _placed(read(spark, sf, "events"), "event_id", fill(line.replace("mongod.27017[<n>]:", "mongod.<n>:"), **values))
    events, _ = textlog.text_events(textlog.parse_syslog(rows, 2024).filter("ts IS NOT NULL"), {**_base(), "host": F.col("host")})
    return events.select(
        "infile", "lineno", _stamp("ts").alias("ts"), "host", "connection", "command", "object", "filter_shape", _params().alias("params"),
        "docs_examined", "nreturned", "duration_millis",
    )


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    wrapped = '{ "atype" : "<kind>", "ts" : { "$date" : "<at>Z" }, "param" : { "user" : "u<u>" } }'
    plain = '{ "atype" : "<kind>", "ts" : "<at>Z", "param" : { "user" : "u<u>" } }'
    values = {**_event_values(), "kind": F.col("event_type")}
    entry = F.when(F.col("event_id") % 2 == 0, fill(wrapped, **values)).otherwise(fill(plain, **values))
    parsed = audit.parse_audit(_placed(read(spark, sf, "events"), "event_id", entry)).filter("ts IS NOT NULL")
    out = audit.audit_events(parsed, _base())
    return out.select("infile", "lineno", "type", _stamp("ts").alias("ts"), "raw", F.col("log_date").cast("string").alias("log_date"))


def search_events(spark: SparkSession, sf: str) -> DataFrame:
    config = '{"t":"<at>+0000","s":"INFO","svc":"MONGOT","n":"conf<h>","msg":"ConfCallResponse{id=<n>, version=Optional[<k>], analyzerDefinitions=a<u>}"}'
    plain = '{"t":"<at>+0000","s":"WARN","svc":"MONGOT","n":"idx<h>","msg":"plain <k>","attr":{"u":<u>}}'
    entry = F.when(F.col("event_id") % 3 == 0, fill(config, **_event_values())).otherwise(fill(plain, **_event_values()))
    parsed = audit.parse_search(_placed(read(spark, sf, "events"), "event_id", entry)).filter("ts IS NOT NULL")
    out = audit.search_events(parsed, _base())
    return out.select(
        "infile", "lineno", "type", _stamp("ts").alias("ts"), "module", "severity", "message", "attr",
        F.col("config")["id"].alias("config_id"), F.col("config")["version"].alias("config_version"), F.col("config")["analyzerDefinitions"].alias("config_analyzer"),
    )


# --- stored commands --------------------------------------------------------

_COMMANDS = [
    'find { find: "c<c>", filter: { a.b: <v>, t: Timestamp(<c>, 1), bin: BinData(0, 0AFF) }, sort: { a: -1 }, hint: { a: 1 }, limit: <c> }',
    'aggregate { aggregate: "c<c>", pipeline: [ { $project: { x: 1 } }, { $match: { k: { $ne: <c> }, s: \'it is\' } } ] }',
    'count { count: "c<c>", query: { k: { $nin: [ <c>, <v> ] } } }',
    'insert { insert: "c<c>", documents: [ { a: <v> } ] }',
    'find { find: "c<c>", filter: { a: [ <v> } }',
    "getMore",
]


def _stored_commands(spark: SparkSession, sf: str) -> DataFrame:
    return tb.spread(read(spark, sf, "orders"), "o_orderkey").select(
        F.col("o_orderkey").alias("id"),
        _choice(F.col("o_orderkey") % len(_COMMANDS), _COMMANDS, _order_values()).alias("Command"),
        F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(fill('{ find: "c<c>" }', **_order_values())).alias("originatingCommand"),
        F.floor("o_totalprice").cast("bigint").alias("docsExamined"),
        F.col("o_custkey").alias("nreturned"),
    )


def normalise_commands(spark: SparkSession, sf: str) -> DataFrame:
    good, rejects = cm.normalise_commands(_stored_commands(spark, sf))
    out = good.select(
        "id", "cmd_type", "filter", _params().alias("params"), F.col("Ratio").alias("ratio"), "sort", "hint", "limit",
        F.col("writeConcern").alias("concern"), F.col("hasNE").alias("has_ne"), F.col("hasNIN").alias("has_nin"), F.lit(None).cast("string").alias("error"),
    )
    return out.unionByName(rejects.select("id", "error"), allowMissingColumns=True)


def normalise_updates(spark: SparkSession, sf: str) -> DataFrame:
    update = _choice(
        F.col("o_orderkey") % 3,
        ['{ $set: { a.b: <v>, "c d": \'x\' }, $setOnInsert: { n: { $ne: <c> } }, upsert: true }', "{ $set: { e: 1.5e3 } }", "{ $set: [ }"],
        _order_values(),
    )
    rows = tb.spread(read(spark, sf, "orders"), "o_orderkey").select(
        F.col("o_orderkey").alias("id"), update.alias("Update"), fill("{ _id: ObjectId('<c>'), k: { $nin: [ <c> ] } }", **_order_values()).alias("Query")
    )
    good, rejects = cm.normalise_updates(rows)
    out = good.select(
        "id", "upsert", "filter", _params().alias("params"), "soi", F.col("set").alias("changes"), _params("set_params").alias("set_params"),
        F.col("hasNE").alias("has_ne"), F.col("hasNIN").alias("has_nin"), F.lit(None).cast("string").alias("error"),
    )
    return out.unionByName(rejects.select("id", "error"), allowMissingColumns=True)


def extract_parameters(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    ns = F.concat(F.lit("c"), (F.col("o_custkey") % 10).cast("string"))
    kinds = F.element_at(F.array(F.lit("{a: 1}"), F.lit("{a: {$in: [ 1 ]}}"), F.lit("{d: 1}")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string")
    param = F.when(F.col("o_orderkey") % 3 == 2, F.struct(F.lit("date").alias("type"), at.alias("value"))).otherwise(
        F.struct(F.lit("int").alias("type"), F.col("o_custkey").cast("string").alias("value"))
    )
    samples = orders.select(
        F.col("o_orderkey").alias("id"), ns.alias("object"), ns.alias("collection"), kinds.alias("filter_shape"), F.array(param).alias("filter_params")
    )
    shapes = F.explode(F.array(F.lit("{a: 1}"), F.lit("{a: {$in: [ N ]}}"), F.lit("{d: 1}"), F.lit("{none: 1}")))
    ranked = orders.groupBy(ns.alias("ns")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice")).alias("cost")).select(
        "ns", shapes.alias("filter"), F.when(F.col("ns") != "c3", F.col("n")).alias("stage_rank"), F.col("cost").cast("bigint").alias("prd_rank")
    )
    params, missing = cm.extract_parameters(ranked, samples, "2024-02-01 00:00:00")
    out = params.select(
        "ns", "filter", "prd_rank", "sample_id", "match", F.array_join("params", "|").alias("params"), F.array_join("shifts", "|").alias("shifts")
    )
    return out.unionByName(missing, allowMissingColumns=True)


def update_by_key(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    changes = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_returnflag").alias("o_orderstatus"), F.count("*").alias("lines")
    )
    return cm.update_by_key(orders, changes.filter("lines > 3"), "o_orderkey")


def update_repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item changes its order; the one with the largest number comes last."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    line = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("o_orderstatus"), F.col("l_linenumber").alias("line"))
    return cm.update_by_key(orders, line, "o_orderkey", F.col("line"))


def update_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same on a stored table, twice: only partitions with changed keys are written, and the second run changes nothing."""
    path = scratch_path(spark, "stored_orders")
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority")
    orders.write.partitionBy("o_orderpriority").parquet(path)
    line = read(spark, sf, "lineitem").filter("l_quantity >= 49")
    changes = line.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("o_orderstatus"))
    for _ in range(2):
        cm.update_stored(spark, path, changes, "o_orderkey", "o_orderpriority")
    return spark.read.schema(orders.schema).parquet(path)


# --- profiles and documents -------------------------------------------------


def profile_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Call tree whose last frame names a temperature: hot and total weights."""
    stacks = tb.stacks(spark, sf).withColumn(
        "stack", F.transform("stack", lambda f: F.when(f == "flag_A", F.lit(":hot")).when(f == "flag_N", F.lit(":cold")).otherwise(f))
    )
    ordered = stacks.withColumn("stack", F.reverse("stack"))
    return pr.tree_rollup(ordered, temperature=True).withColumn("node", F.array_join("node", "/"))


def sample_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Three documents of each language and source, the first in a seeded random order."""
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source")
    return fi.sample_documents(docs, ["lang", "source"], "doc_id", 3)


def dominant_types(spark: SparkSession, sf: str) -> DataFrame:
    profile = sp.dominant_type(sp.profile_schema(tb.order_documents(spark, sf, altered=True)))
    return profile.select(F.array_join("path", ".").alias("path"), "type")


QUERIES = {
    f.__name__: f
    for f in (
        json_log_events, oversize_messages, log_headers, text_log_events, sharding_messages, log_rejects, syslog_events, audit_events, search_events,
        normalise_commands, normalise_updates, extract_parameters, update_by_key, update_repeated, update_stored, profile_tree, sample_documents, dominant_types,
    )
}
