"""Text logs and syslog-wrapped logs: regular expressions over each entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from plumeline.functions import jsonpath as jp
from plumeline.functions.relaxed import relaxed_to_json
from plumeline.functions.shape import query_shape
from plumeline.functions.text import outer_groups, strip_nested
from plumeline.functions.times import minus_millis
from plumeline.operators.commands import ratio
from plumeline.operators.frequency import LOG_KEYWORDS
from plumeline.schemas import as_log_events

# Layout of a text entry and of a syslog entry up to its body.
TEXT_HEAD = r"(?s)^(\S+)\s+(\S)\s+(\S+)\s+\[([^\]]*)\]\s+(.*)$"
SYSLOG_HEAD = r"(?s)^([A-Za-z]{3})\s+([0-9]{1,2})\s+([0-9:]{8})\s+(\S+)\s+\S+\s+\[([^\]]*)\]\s+(.*)$"

# Operations of the older text reader.
OPERATIONS = ("find", "getMore", "update", "aggregate", "remove", "findAndModify", "insert", "count")

# Administrative messages and the positions of their values.
ADMIN_MESSAGES = {
    "successfully": ("setParam", {"paramName": 3, "newValue": 5, "oldValue": 7}),
    "serverStatus": ("serverStatus", {"Value": 3, "Data": 4}),
    "mongos": ("mongos", {}),
}

# Sharding messages, first match wins: words, operation, position
# of the collection, positions of further values (tokens of the body, documents
# counted as one token).
SHARD_MESSAGES = (
    ("moveChunk", "status", None, {}),
    ("request split", "spltLookup", 6, {}),
    ("Updating metadata", "updMeta", 4, {"oldCollection": 8, "oldShard": 11, "newCollection": 15, "newShard": 18}),
    ("Migration succeeded", "succeeded", None, {"newCollection": 7}),
    ("Migration successfully entered critical", "entered critical", None, {}),
    ("about to log metadata", "log", None, {}),
    ("autosplitted", "autosplit", 1, {"shard": 4, "lastmod": 6, "nParts": 10, "maxChunkSize": 13}),
    ("Finding the", "findAuto", 6, {"numSplits": 12, "time": 15}),
    ("No documents", "noDoc", 6, {}),
    ("Waiting for replication", "waitRepl", None, {}),
    ("Waiting for", "waitMaj", 8, {}),
    ("migrate commit", "migComm", 7, {}),
    ("Finished deleting documents", "finDel", 4, {}),
    ("Finished deleting", "finDel", 2, {}),
    ("Deferring deletion", "findAuto", 3, {}),
    ("Starting chunk", "startMig", 4, {}),
    ("Queries possibly", "queryPoss", 4, {}),
    ("Scheduling deferred", "schedDef", 4, {}),
    ("Deletion of", "delSched", 2, {}),
    ("Leaving cleanup", "findAuto", 3, {}),
    ("Chunk data", "repSucc", None, {}),
    ("Scheduling deletion", "schedDel", 6, {}),
    ("Starting receiving", "startRec", 12, {"source": 14, "epoch": 17}),
    ("Updating config", "updConfigSet", None, {"cluster": 6}),
)
# Fixed value: what lies between the ends of a chunk, each document one mark.
SHARD_RANGE = r"(?s)^(.*?)\[?\u0001,?\s+(?:-> )?\u0001"
MEM_USED, DOCS_LEFT = r"mem used: (\d+)", r"remaining to clone: (\d+)"

SLOW_COMPONENTS = ("COMMAND", "WRITE")

_KEYWORD = "|".join(k[:-1] for k in LOG_KEYWORDS) + "|protocol"
_STOP = rf"(?=\s+(?:{_KEYWORD}):|\s+\d+ms\s*$|\s*$)"
_COMMAND = rf"(?s)\bcommand:\s+(?:(\w+)\s+)?(\{{.*?\}}){_STOP}(.*)$"
_ORIGIN = rf"(?s)\boriginatingCommand:\s+(\{{.*?\}}){_STOP}"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _number(text: Column, keyword: str) -> Column:
    return _found(text, rf"\b{keyword}:(\d+)").try_cast("bigint")


def _segment(text: Column, keyword: str) -> Column:
    """Document behind a keyword, up to the next keyword."""
    return _found(text, rf"(?s)\b{keyword}:\s*(\{{.*?\}}){_STOP}")


def parse_text(entries: DataFrame, offset: bool = True) -> DataFrame:
    """Entries with ``ts, severity, component, ctx, body``; NULL time marks rejects.

    The offset behind a time counts; ``offset=False`` reads all times as UTC.
    """
    part = {n: F.regexp_extract("entry", TEXT_HEAD, i) for i, n in enumerate(("t", "severity", "component", "ctx", "body"), 1)}
    ts = F.try_to_timestamp(F.substring(part["t"], 1, 23), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS"))
    if offset:
        sign, hours, minutes = (F.regexp_extract(part["t"], r"([+-])(\d{2}):?(\d{2})$", i) for i in (1, 2, 3))
        east = F.coalesce(hours.try_cast("int") * 60 + minutes.try_cast("int"), F.lit(0))
        ts = F.timestamp_add("MINUTE", F.when(sign == "-", east).otherwise(-east), ts)
    return entries.withColumns(
        {"ts": ts, "severity": part["severity"], "component": part["component"], "ctx": part["ctx"], "body": part["body"]}
    )


def parse_syslog(entries: DataFrame, default_year: int) -> DataFrame:
    """Syslog entries in the columns of ``parse_text``; the line has no year."""
    part = {n: F.regexp_extract("entry", SYSLOG_HEAD, i) for i, n in enumerate(("mon", "day", "time", "host", "ctx", "body"), 1)}
    stamp = F.concat_ws(" ", F.lit(str(default_year)), part["mon"], F.lpad(part["day"], 2, "0"), part["time"])
    return entries.withColumns(
        {
            "ts": F.try_to_timestamp(stamp, F.lit("yyyy MMM dd HH:mm:ss")),
            "severity": F.lit(None).cast("string"),
            "component": F.lit("COMMAND"),
            "ctx": part["ctx"],
            "body": part["body"],
            "host": part["host"],
        }
    )


def allowed_operations(events: DataFrame, operations: tuple[str, ...] = OPERATIONS) -> DataFrame:
    """Only the listed operations."""
    return events.filter(F.col("command").isin(*operations))


def _tokens(body: Column) -> Column:
    """Whitespace tokens of a body, every document counted as one, however deep."""
    return F.split(F.trim(strip_nested(body, "{", "}", "JSON")), r"\s+")


def _range_bounds(body: Column) -> tuple[Column, Column]:
    """The first two documents that follow each other as the ends of a chunk."""
    flat = strip_nested(body, "{", "}", "\u0001")
    ahead = F.regexp_extract(flat, SHARD_RANGE, 1)
    first = F.length(ahead) - F.length(F.replace(ahead, F.lit("\u0001"), F.lit("")))
    documents = F.when(flat.rlike(SHARD_RANGE), outer_groups(body, "{", "}"))
    return F.get(documents, first), F.get(documents, first + 1)


def _shard_columns(body: Column, tokens: Column) -> dict[str, Column]:
    def at(i: int) -> Column:
        return F.regexp_replace(F.get(tokens, F.lit(i)), r"[,.)]+$", "")

    op = where = extra = None
    text_map = "map<string,string>"
    for words, name, collection, values in SHARD_MESSAGES:
        hit = body.startswith(words)
        coll = at(collection) if collection is not None else F.lit(None).cast("string")
        pairs = F.create_map(*[x for k, i in values.items() for x in (F.lit(k), at(i))]) if values else F.lit(None).cast(text_map)
        if words == "moveChunk":
            pairs = F.create_map(
                F.lit("memUsed"), _found(body, MEM_USED), F.lit("docsLeft"), _found(body, DOCS_LEFT)
            )
        op = F.when(hit, name) if op is None else op.when(hit, name)
        where = F.when(hit, coll) if where is None else where.when(hit, coll)
        extra = F.when(hit, pairs) if extra is None else extra.when(hit, pairs)
    low, high = _range_bounds(body)
    return {
        "shard_op": op.otherwise(F.concat_ws("", F.slice(tokens, 1, 3))),
        "collection": where,
        "shard_stats": extra,
        "shard_range": F.when(low.isNotNull(), F.struct(low.alias("min"), high.alias("max"))),
    }


def text_events(
    parsed: DataFrame, base: dict[str, Column], older_writes: bool = False, replication: bool = False,
    once: Callable[[DataFrame, str], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Log events of text entries, and the slow lines whose documents cannot be read.

    Components without a rule give no event.  With ``older_writes`` lines that
    name their query and update without a command document are read too, if
    their operation is one of ``OPERATIONS``.  With ``replication`` the details
    of an applied operation are its parts.  ``once`` keeps the lines with their
    documents, by whether they can be read, so that both results read it.
    """
    c, body = F.col("component"), F.col("body")
    slow_line = c.isin(*SLOW_COMPONENTS)
    net, access, repl, shard = c == "NETWORK", c == "ACCESS", c == "REPL", c == "SHARDING"
    accepted = net & body.startswith("connection accepted")
    ended = net & body.startswith("end connection")
    client = net & body.startswith("received client metadata")
    rows = parsed.filter(slow_line | accepted | ended | client | access | repl | shard)

    # The notice ahead of an over-long line is skipped.
    notice = r"(?s)^warning: log line attempted \((\S+?)\) over max size \(\S+?\), printing beginning and end\s*\.*\s*"
    op_body = F.regexp_replace(body, notice, "")
    first_word = F.regexp_extract(op_body, r"^(\S+)", 1)
    admin = slow_line & first_word.isin(*ADMIN_MESSAGES)
    message_doc = slow_line & op_body.startswith("{")
    op = slow_line & ~admin & ~message_doc
    rows = rows.withColumns(
        {
            "op_body": F.when(op, op_body),
            "long_line": _found(body, notice),
            "admin": admin,
            "message_doc": message_doc,
            "first_word": first_word,
        }
    )
    ob = F.col("op_body")
    rows = rows.withColumns(
        {
            "cmd_word": _found(ob, _COMMAND, 1),
            "cmd_text": _found(ob, _COMMAND, 2),
            "tail": F.coalesce(_found(ob, _COMMAND, 3), ob),
        }
    )
    tail = F.col("tail")
    older = F.lit(False)
    if older_writes:
        older = F.coalesce(F.col("cmd_text").isNull() & F.col("first_word").isin(*OPERATIONS) & ob.isNotNull(), F.lit(False))
    rows = rows.withColumn("old", F.when(older, write_segments(ob)))
    # All documents of a line go to Python in one batch.
    rows = rows.withColumns(
        {
            "origin_json": relaxed_to_json(_found(tail, _ORIGIN)),
            "cmd_json": relaxed_to_json(F.col("cmd_text")),
            "info_json": relaxed_to_json(
                F.when(client | repl | F.col("message_doc") | F.col("admin"), _found(body, r"(?s)(\{.*\})"))
            ),
            "old_query": relaxed_to_json(F.col("old.query")),
            "old_update": relaxed_to_json(F.col("old.update")),
            "locks_json": relaxed_to_json(_segment(tail, "locks")),
            "storage_json": relaxed_to_json(_segment(tail, "storage")),
        }
    )
    broken = F.lit(False)
    for text, document in (("cmd_text", "cmd_json"), ("old.query", "old_query"), ("old.update", "old_update")):
        broken = broken | (F.col(text).isNotNull() & F.col(document).isNull())
    rows = rows.withColumn("broken", broken)
    if once:
        rows = once(rows, "broken")
    rejects = rows.filter("broken")
    rows = rows.filter("NOT broken")

    command = F.when(F.col("cmd_text").isNotNull(), F.coalesce("cmd_word", "first_word")).when(F.col("old").isNotNull(), F.col("first_word"))
    own = jp.filter_of(command, F.col("cmd_json"))
    origin = F.col("origin_json")
    opened = F.when(
        command == "getMore",
        F.coalesce(F.get_json_object(origin, "$.filter"), F.get_json_object(origin, "$.pipeline[0].$match")),
    )
    rows = rows.withColumns({"op_name": command, "filter_text": F.coalesce(own, opened, F.col("old_query"))})
    rows = rows.withColumns(
        {
            "q": query_shape("filter_text"),
            "w": jp.waits(F.col("locks_json"), F.col("storage_json")),
            "tokens": F.when(shard | access | F.col("admin"), _tokens(body)),
        }
    )
    has_filter = F.col("filter_text").isNotNull()

    docs, returned = _number(tail, "docsExamined"), _number(tail, "nreturned")
    millis = _found(tail, r"(\d+)ms\s*$").try_cast("bigint")
    shards = _shard_columns(body, F.col("tokens"))
    admin_type = F.element_at(
        F.create_map(*[F.lit(x) for k, (t, _) in ADMIN_MESSAGES.items() for x in (k, t)]), F.col("first_word")
    )
    admin_values = None
    for word, (_, values) in ADMIN_MESSAGES.items():
        got = F.create_map(
            *[x for k, i in values.items() for x in (F.lit(k), F.regexp_replace(F.get("tokens", F.lit(i)), r"\)$", ""))]
        ) if values else F.create_map(F.lit("Value"), F.regexp_extract(body, r"(?s)^\S+\s+(.*)$", 1))
        cond = F.col("first_word") == word
        admin_values = F.when(cond, got) if admin_values is None else admin_values.when(cond, got)
    plain_message = F.when(repl & ~body.startswith("applied op:"), body).when(F.col("message_doc"), F.col("info_json"))
    conn = jp.connection_id(F.col("ctx"))

    events = as_log_events(
        rows,
        base
        | {
            "type": c,
            "ts": F.col("ts"),
            "severity": F.col("severity"),
            "operation": F.when(accepted, "accept").when(ended, "end").when(client, "start"),
            "connection": F.when(accepted, _found(body, r"#(\d+)")).otherwise(conn),
            "ip_addr": F.when(net, jp.ip_address(body)),
            "connection_info": F.when(client, F.col("info_json")),
            "user": F.when(access, F.get("tokens", F.lit(4))),
            "thread": F.when(repl, F.col("ctx")),
            "module": F.when(shard & conn.isNull(), F.regexp_extract("ctx", r"^([a-zA-Z-]*?)-?[0-9]*$", 1)),
            "applied_op": F.when(repl, _found(body, r"^applied op: (\S+)")),
            "message": plain_message,
            "details": F.when(
                repl & body.startswith("applied op:"), F.to_json(replication_op(body)) if replication else F.col("info_json")
            ).when(
                F.col("admin"), F.col("info_json")
            ),
            "shard_op": F.when(shard, shards["shard_op"]),
            "collection": F.when(shard, shards["collection"]),
            "shard_range": F.when(shard, shards["shard_range"]),
            "raw": F.when(shard, body),
            "command": F.when(F.col("admin"), admin_type).otherwise(F.col("op_name")),
            "object": _found(ob, r"^\S+\s+(\S+)"),
            "application": _found(ob, r'\bappName:\s+"([^"]*)"'),
            "attr": F.coalesce(
                "cmd_json",
                F.when(
                    F.col("old").isNotNull(),
                    F.concat(F.lit('{"q":'), F.coalesce("old_query", F.lit("null")), F.lit(',"u":'), F.coalesce("old_update", F.lit("null")), F.lit("}")),
                ),
            ),
            "cursor": _found(tail, r"\bcursorid:(\d+)"),
            "batch_size": F.get_json_object("cmd_json", "$.batchSize").try_cast("bigint"),
            "filter_shape": F.when(has_filter, F.col("q.shape")),
            "filter_params": F.when(has_filter, F.col("q.params")),
            "query_hash": _found(tail, r"\bqueryHash:(\w+)"),
            "plan_cache_key": _found(tail, r"\bplanCacheKey:(\w+)"),
            "plan_summary": _found(tail, rf"(?s)\bplanSummary:\s+(.*?){_STOP}"),
            "docs_examined": docs,
            "keys_examined": _number(tail, "keysExamined"),
            "nreturned": returned,
            "n_shards": _number(tail, "nShards"),
            "num_yields": _number(tail, "numYields"),
            "reslen": _number(tail, "reslen"),
            "has_sort_stage": F.when(_number(tail, "hasSortStage") > 0, F.lit(True)),
            "duration_millis": millis,
            "ratio": ratio(docs, returned),
            "start_ts": minus_millis(F.col("ts"), millis),
            "stats": F.when(shard, shards["shard_stats"])
            .when(F.col("admin"), admin_values)
            .when(ob.isNotNull(), jp.key_values(tail, r"\b([a-zA-Z]+):(\d+)(?=\s)")),
            "originating_command": origin,
            "locks": F.col("locks_json"),
            "storage": F.col("storage_json"),
            "waits": F.col("w"),
            "truncated": F.col("long_line"),
            "log_date": F.to_date("ts"),
        },
    )
    return events, rejects


def write_segments(body: Column) -> Column:
    """Parts of an older write line: query, update, plan, stats, locks, storage."""
    words = ("q", "query", "u", "update", "planSummary", "keysExamined", "locks", "storage")
    stop = rf"(?=\s+(?:{'|'.join(words)}):|\s+\d+ms\s*$)"

    def part(names: str) -> Column:
        return _found(body, rf"(?s)\b(?:{names}):\s*(.*?){stop}")

    return F.struct(
        part("q|query").alias("query"),
        part("u|update").alias("update"),
        part("planSummary").alias("plan"),
        _found(body, rf"(?s)\b(keysExamined:.*?){stop}").alias("stats"),
        part("locks").alias("locks"),
        part("storage").alias("storage"),
        _found(body, r"(\d+)ms\s*$").try_cast("bigint").alias("time"),
    )


def replication_op(body: Column) -> Column:
    """Parts of an ``applied op`` line; ``op_len`` is the length of the whole operation, also of one the server cut."""
    change = F.get(outer_groups(_found(body, r"(?s)\bo:\s+(\{.*)$"), "{", "}"), F.lit(0))
    op = _found(body, r'\bop:\s+"(\w)"')
    kept = F.when(op.isin("u", "i"), change)
    cut = _found(body, r"\((\d+)kB\)").try_cast("bigint") * 1024
    return F.struct(
        op.alias("op"),
        _found(body, r'\bns:\s+"([^"]*)"').alias("ns"),
        _found(body, r"\bts:\s+(Timestamp\([^)]*\)|\[.*?\])").alias("op_time"),
        _found(body, r"\bwall:\s+(new Date\(\d+\))").alias("wall_time"),
        F.when(op == "u", kept).alias("update"),
        F.when(op == "i", kept).alias("insert"),
        F.coalesce(cut, F.length(kept)).alias("op_len"),
        _found(body, r"(\d+)ms\s*$").try_cast("bigint").alias("time"),
    )
