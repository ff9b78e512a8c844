import gzip
import json

import pytest
from pyspark.sql import functions as F

from plumeline.plans.ingest import IngestOptions, ingest_logs, read_events, slow_ops, write_ingested
from plumeline.sources.lines import gzip_without_suffix, number_lines, read_lines, short_name, stitch_files


def j(ts, c, msg, attr=None, ctx="conn9", s="I", id=51803, **more):
    doc = {"t": {"$date": f"2024-03-01T{ts}.000+00:00"}, "s": s, "c": c, "id": id, "ctx": ctx, "msg": msg}
    if attr is not None:
        doc["attr"] = attr
    doc.update(more)
    return json.dumps(doc, separators=(",", ":"))


JSON_LINES = [
    j("10:00:00", "CONTROL", "Process Details", {"pid": 1, "host": "db1:27017"}, "main"),
    j("10:00:00", "CONTROL", "Build Info", {"version": "5.0.1"}, "main"),
    j("10:00:00", "CONTROL", "Operating System", {"name": "os"}, "main"),
    j("10:00:01", "CONTROL", "Options set by command line", {"opts": 1}, "main"),
    j("10:00:02", "CONTROL", "Something", None, "main"),
    j("10:00:03", "NETWORK", "Connection accepted", {"remote": "10.0.0.1:5001", "connectionId": 12, "connectionCount": 3}, "listener"),
    j("10:00:04", "NETWORK", "Connection ended", {"remote": "10.0.0.1:5001"}, "conn12"),
    j("10:00:05", "NETWORK", "client metadata", {"remote": "10.0.0.1:5001", "client": "conn13", "doc": {"driver": {"name": "x"}}}, "conn13"),
    j("10:00:06", "NETWORK", "recv(): message mstLen is invalid.", {"msgLen": 18446744073709551615}, "conn14"),
    j("10:00:07", "ACCESS", "Authenticated", {"user": "u"}, "conn14"),
    j("10:00:08", "REPL", "Applied op", {"CRUD": {"op": "i"}}, "repl-1"),
    j("10:00:09", "SHARDING", "moved", {"a": 1}, "mover"),
    j("10:00:10", "TXN", "transaction", {"parameters": {"lsid": {"id": "s1"}, "txnNumber": 7}, "durationMillis": 3}, "conn15"),
    j("10:00:11", "INDEX", "build", {"b": 1}, "conn16"),
    j(
        "10:01:00", "COMMAND", "Slow query",
        {
            "type": "command", "ns": "shop.cart", "appName": "web",
            "command": {"find": "cart", "filter": {"z": 1, "a": {"$in": [1, 2]}}, "sort": {"z": -1}, "lsid": {"id": "s2"}},
            "planSummary": "IXSCAN { z: 1 }", "keysExamined": 10, "docsExamined": 10, "nreturned": 4, "queryHash": "AB12",
            "locks": {"Global": {"acquireCount": {"r": 1}, "timeWaitingMicros": {"r": 5}}},
            "storage": {"data": {"bytesRead": 1, "timeReadingMicros": 7}, "timeWaitingMicros": {"cache": 9}},
            "durationMillis": 1500,
        },
        size=10,
    ),
    j(
        "10:02:00", "COMMAND", "Slow query",
        {
            "type": "command", "ns": "shop.cart",
            "command": {"getMore": 99, "collection": "cart"},
            "originatingCommand": {"aggregate": "cart", "pipeline": [{"$addFields": {"x": 1}}, {"$match": {"k": {"$gt": 3}}}]},
            "docsExamined": 5, "nreturned": 0, "durationMillis": 200,
        },
    ),
    j("10:03:00", "WRITE", "Slow query", {"type": "update", "ns": "shop.cart", "command": {"q": {"_id": {"$oid": "aa"}}, "u": {"$set": {"b": 1}}}, "durationMillis": 10}),
    j("10:04:00", "WRITE", "Slow query", {"type": "remove", "ns": "shop.cart", "command": {"q": {"b": 1}}, "durationMillis": 11}),
    j("10:05:00", "COMMAND", "Slow query", {"type": "none", "ns": "shop.cart", "durationMillis": 12}),
    j("10:06:00", "COMMAND", "other", {"x": 1}),
    j("10:07:00", "CONTROL", "Process Details", {"pid": 2, "host": "db2:27017"}, "main"),
    j("10:08:00", "COMMAND", "Slow query", {"type": "command", "ns": "shop.cart", "command": {"delete": "cart", "deletes": [{"q": {"c": 5}}]}, "durationMillis": 5}),
]


@pytest.fixture(scope="module")
def json_run(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("json")
    (d / "node1.log").write_text("\n".join(JSON_LINES) + "\n" + '{"t":{"$date":"2024-03-01T11:00:00.000+00:00"},"s":"I","c":\n', encoding="latin-1")
    out = ingest_logs(spark, [str(d / "node1.log")], IngestOptions(name_pattern=r"(node\d)"))
    return {r["lineno"]: r for r in out.events.collect()}, out


def test_json_base(json_run):
    rows, out = json_run
    assert out.headers.count() == 2
    assert sorted(rows) == [5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 22]
    assert {r["short_name"] for r in rows.values()} == {"node1"}
    assert rows[5]["severity"] == "I" and rows[5]["message"] == "Something"
    assert rows[15]["host"] == "db1:27017" and rows[22]["host"] == "db2:27017"


def test_json_components(json_run):
    rows, _ = json_run
    assert (rows[6]["operation"], rows[6]["connection"], rows[6]["ip_addr"], rows[6]["connection_count"]) == ("accept", "conn12", "10.0.0.1", 3)
    assert (rows[7]["operation"], rows[7]["connection"]) == ("end", "conn12")
    assert (rows[8]["operation"], rows[8]["connection"], rows[8]["connection_info"]) == ("start", "conn13", '{"driver":{"name":"x"}}')
    assert rows[9]["thread"] == "conn14" and "msgLen" in rows[9]["details"]
    assert rows[10]["connection"] == "conn14" and rows[10]["message"] == "Authenticated"
    assert rows[11]["applied_op"] == "CRUD" and rows[11]["message"] is None
    assert rows[12]["thread"] == "mover"
    assert (rows[13]["session_id"], rows[13]["txn_number"]) == ("s1", 7)
    assert rows[14]["connection"] == "16" and rows[14]["attr"] == '{"b":1}'
    assert rows[20]["message"] == "other" and rows[20]["command"] is None


def test_json_slow(json_run):
    rows, _ = json_run
    r = rows[15]
    assert (r["command"], r["object"], r["application"], r["session_id"]) == ("find", "cart", "web", "s2")
    assert r["filter_shape"] == "{z: 1,a: {$in: [ N ]}}"
    assert [(p["type"], p["value"]) for p in r["filter_params"]] == [("int", "1"), ("int", "1"), ("int", "2")]
    assert r["ratio"] == 2.5 and r["query_hash"] == "AB12"
    assert (r["ts"] - r["start_ts"]).total_seconds() == 1.5
    assert r["waits"]["total_micros"] == 21
    assert r["waits"]["locks"] == ["locks.Global.r.timeWaitingMicros", "storage.data.timeReadingMicros", "storage.cache.timeWaitingMicros"]
    g = rows[16]
    assert (g["command"], g["object"], g["cursor"], g["filter_shape"], g["ratio"]) == ("getMore", "cart", "99", "{k: {$gt: 1}}", None)
    assert (rows[17]["command"], rows[17]["filter_shape"], rows[17]["object"]) == ("update", "{_id: 1}", "cart")
    assert rows[17]["filter_params"][0]["type"] == "objectid"
    assert (rows[18]["command"], rows[18]["filter_shape"]) == ("remove", "{b: 1}")
    assert rows[19]["command"] == "none" and rows[19]["object"] == "cart"
    assert (rows[22]["command"], rows[22]["filter_shape"]) == ("delete", "{c: 1}")


def test_json_headers_and_rejects(json_run):
    _, out = json_run
    first, second = out.headers.orderBy("restart_id").collect()
    assert first["host"] == "db1:27017" and "5.0.1" in first["build"] and "opts" in first["cmd_line"]
    assert second["host"] == "db2:27017" and second["build"] is None
    rej = out.rejects.collect()
    assert [(r["lineno"], r["error"]) for r in rej] == [(23, "unreadable json entry")]


def test_range_and_write(spark, tmp_path):
    p = tmp_path / "a.log"
    p.write_text("\n".join(JSON_LINES))
    import datetime as dt

    at = lambda m: dt.datetime(2024, 3, 1, 10, m, tzinfo=dt.timezone.utc)
    opts = IngestOptions(start=at(1), end=at(3))
    out = ingest_logs(spark, [str(p)], opts)
    seen = write_ingested(out, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "events"))
    assert sorted(r["lineno"] for r in back.collect()) == [15, 16, 17]
    assert seen.get["rows"] == 3
    again = read_events(spark, str(tmp_path / "out"), start=at(1), end=at(3))
    assert [r["lineno"] for r in again.collect()] == [16]
    assert "PartitionFilters: [isnotnull(log_date" in again._jdf.queryExecution().toString()
    assert slow_ops(back).count() == 3
    with pytest.raises(ValueError):
        ingest_logs(spark, [str(p)], IngestOptions(start=at(3), end=at(1)))


def test_stop_at_end(spark, tmp_path):
    import datetime as dt

    p = tmp_path / "a.log"
    late = [j("10:00:00", "INDEX", "a"), j("12:00:00", "INDEX", "late"), j("10:01:00", "INDEX", "back")]
    p.write_text("\n".join(late))
    end = dt.datetime(2024, 3, 1, 11, 0, tzinfo=dt.timezone.utc)
    keep = ingest_logs(spark, [str(p)], IngestOptions(end=end)).events
    stop = ingest_logs(spark, [str(p)], IngestOptions(end=end, stop_at_end=True)).events
    assert sorted(r["message"] for r in keep.collect()) == ["a", "back"]
    assert [r["message"] for r in stop.collect()] == ["a"]


TEXT = """2020-10-26T18:24:11.313-0000 I NETWORK  [listener] connection accepted from 10.0.0.7:4000 #12 (3 connections now open)
2020-10-26T18:24:12.313-0000 I NETWORK  [conn12] end connection 10.0.0.7:4000 (2 connections now open)
2020-10-26T18:24:13.313-0000 I NETWORK  [conn13] received client metadata from 10.0.0.7:4001 conn13: { driver: { name: "drv", version: "1.2" } }
2020-10-26T18:24:14.000-0000 I ACCESS   [conn13] Successfully authenticated as principal bob on admin
2020-10-26T18:24:15.000-0000 I REPL     [repl-0] applied op: CRUD { op: "i", ns: "a.b" }, took 120ms
2020-10-26T18:24:16.000-0000 I SHARDING [Balancer] Starting chunk migration for shop.cart [{ k: 1 }, { k: 5 }) to s1
2020-10-26T18:24:16.500-0000 I SHARDING [conn77] Some new kind of message here
2020-10-26T18:24:17.000-0000 I COMMAND  [conn14] command shop.cart appName: "web app" command: find { find: "cart", filter: { a: 1, at: { $gt: new Date(1600000000000) }, id: ObjectId('5f'), "n.x": /ab c/i }, $db: "shop" } planSummary: IXSCAN { a: 1 } keysExamined:1 docsExamined:10 hasSortStage:1 cursorExhausted:1 numYields:0 nreturned:4 queryHash:AB12 planCacheKey:CD34 reslen:100 locks:{ Global: { acquireCount: { r: 1 }, timeWaitingMicros: { r: 8 } } } storage:{} protocol:op_msg 153ms
2020-10-26T18:24:18.000-0000 I COMMAND  [conn14] command shop.cart command: getMore { getMore: 77, collection: "cart" } originatingCommand: { find: "cart", filter: { b: { $in: [ 1, 2 ] } } } planSummary: COLLSCAN cursorid:77 keysExamined:0 docsExamined:9 numYields:0 nreturned:3 reslen:10 protocol:op_msg 99ms
2020-10-26T18:24:19.000-0000 I WRITE    [conn15] update shop.cart command: { q: { _id: 3 }, u: { $set: { b: 1 } }, multi: false } planSummary: IDHACK keysExamined:1 docsExamined:1 nMatched:1 nModified:1 numYields:0 locks:{} 12ms
2020-10-26T18:24:20.000-0000 I COMMAND  [conn16] successfully set parameter logLevel to 1 (was 0)
2020-10-26T18:24:21.000-0000 I COMMAND  [conn17] command shop.cart command: find { find: "cart", filter: { a: "x
y" } } planSummary: COLLSCAN keysExamined:0 docsExamined:2 numYields:0 nreturned:1 protocol:op_msg 10ms
2020-10-26T18:24:22.000-0000 I COMMAND  [conn18] command shop.cart command: find { find: "cart", filter: { a: [ 1 } } planSummary: COLLSCAN docsExamined:2 10ms
"""


def test_text_log(spark, tmp_path):
    p = tmp_path / "mongos.log"
    p.write_text(TEXT)
    out = ingest_logs(spark, [str(p)])
    rows = {r["lineno"]: r for r in out.events.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13]
    assert {r["node_type"] for r in rows.values()} == {"mongos"}
    assert (rows[1]["operation"], rows[1]["connection"], rows[1]["ip_addr"]) == ("accept", "12", "10.0.0.7")
    assert (rows[2]["operation"], rows[2]["connection"]) == ("end", "12")
    assert rows[3]["connection_info"] == '{"driver":{"name":"drv","version":"1.2"}}'
    assert rows[4]["user"] == "bob"
    assert rows[5]["applied_op"] == "CRUD" and json.loads(rows[5]["details"])["ns"] == "a.b"
    assert (rows[6]["shard_op"], rows[6]["collection"], rows[6]["module"]) == ("startMig", "shop.cart", "Balancer")
    assert rows[6]["shard_range"]["min"] == "{ k: 1 }" and rows[6]["shard_range"]["max"] == "{ k: 5 }"
    assert rows[7]["shard_op"] == "Somenewkind"
    r = rows[8]
    assert (r["command"], r["object"], r["application"], r["plan_summary"]) == ("find", "shop.cart", "web app", "IXSCAN { a: 1 }")
    assert r["filter_shape"] == "{a: 1,at: {$gt: 1},id: 1,n.x: 1}"
    assert [p["type"] for p in r["filter_params"]] == ["int", "date", "string", "string"]
    assert (r["docs_examined"], r["nreturned"], r["ratio"], r["duration_millis"], r["has_sort_stage"]) == (10, 4, 2.5, 153, True)
    assert (r["query_hash"], r["plan_cache_key"], r["reslen"]) == ("AB12", "CD34", 100)
    assert r["waits"]["total_micros"] == 8
    assert (rows[9]["filter_shape"], rows[9]["plan_summary"], rows[9]["cursor"]) == ("{b: {$in: [ N ]}}", "COLLSCAN", "77")
    assert (rows[10]["command"], rows[10]["filter_shape"], rows[10]["stats"]["nModified"]) == ("update", "{_id: 1}", "1")
    assert (rows[11]["command"], rows[11]["stats"]["paramName"], rows[11]["stats"]["newValue"], rows[11]["stats"]["oldValue"]) == ("setParam", "logLevel", "1", "0")
    assert rows[13]["filter_params"][0]["value"] == "x\ny"
    assert [(r["lineno"], r["error"]) for r in out.rejects.collect()] == [(14, "unreadable document")]


def test_audit_search_syslog_wrapper(spark, tmp_path):
    (tmp_path / "audit.log").write_text('{ "atype" : "authenticate", "ts" : { "$date" : "2024-03-01T10:00:00.000Z" }, "param" : { "user" : "u" } }\n')
    msg = "ConfCallResponse{id=5, version=Optional[2], searchIndexes=[a, b], vectorIndexes=[]}"
    (tmp_path / "search.log").write_text(
        json.dumps({"t": "2025-01-17T10:00:00.123+0000", "s": "INFO", "svc": "MONGOT", "n": "conf", "msg": msg, "attr": {"a": 1}}, separators=(",", ":")) + "\n"
        + json.dumps({"t": "2025-01-17T10:00:01.123+0000", "s": "WARN", "svc": "MONGOT", "n": "idx", "msg": "plain"}, separators=(",", ":")) + "\n"
    )
    (tmp_path / "sys.log").write_text('Mar 14 10:00:00 hostx mongod.27017[123]: [conn5] command shop.cart command: count { count: "cart", query: { a: 1 } } planSummary: COLLSCAN keysExamined:0 docsExamined:5 nreturned:1 locks:{} protocol:op_query 20ms\n')
    (tmp_path / "wrapped.log").write_text("pod-1 | " + j("10:00:00", "INDEX", "café") + "\nnoise\n", encoding="latin-1")
    out = ingest_logs(spark, [str(tmp_path / f) for f in ("audit.log", "search.log", "sys.log")], IngestOptions(default_year=2021))
    rows = {(r["short_name"], r["lineno"]): r for r in out.events.collect()}
    assert rows["audit.log", 1]["type"] == "authenticate" and rows["audit.log", 1]["ts"].hour == 10
    s = rows["search.log", 1]
    assert (s["type"], s["module"], s["message"], s["severity"]) == ("MONGOT", "conf", "ConfCallResponse", "INFO")
    assert s["config"] == {"id": "5", "version": "2", "searchIndexes": "[a, b", "vectorIndexes": "["} or s["config"]["searchIndexes"].startswith("[a, b")
    assert rows["search.log", 2]["config"] is None
    y = rows["sys.log", 1]
    assert (y["ts"].year, y["ts"].month, y["host"], y["command"], y["filter_shape"], y["duration_millis"]) == (2021, 3, "hostx", "count", "{a: 1}", 20)
    wrapped = ingest_logs(spark, [str(tmp_path / "wrapped.log")], IngestOptions(wrapper=r"^pod-\d+ \| (.*)$")).events.collect()
    assert [w["message"] for w in wrapped] == ["café"] and wrapped[0]["lineno"] == 2
    odd = ingest_logs(spark, [str(tmp_path / "wrapped.log")], IngestOptions(wrapper=r"^pod-\d+ \| (.*)$")).unmatched.collect()
    assert [r["n"] for r in odd] == [1]


def test_gzip_parts_join_lines(monkeypatch):
    import io

    from plumeline.sources import streams

    monkeypatch.setattr(streams, "INFLATE_BYTES", 7)
    monkeypatch.setattr(streams, "READ_BYTES", 11)
    text = [f"line {i} " + "x" * (i % 9) for i in range(50)]
    packed = gzip.compress("\n".join(text[:20]).encode() + b"\n") + gzip.compress("\n".join(text[20:]).encode())
    for tail in (b"", b"\0" * 40):
        assert [x.decode() for part in streams.range_lines(io.BytesIO(packed + tail), 0, len(packed), len(packed)) for x in part] == text
    assert list(streams.range_lines(io.BytesIO(packed), 100, len(packed), len(packed))) == []
    with pytest.raises(Exception, match="decompressing"):
        list(streams.range_lines(io.BytesIO(packed[:60] + b"x" * 60 + packed[120:]), 0, len(packed), len(packed)))


@pytest.mark.parametrize("split", [1, 2, 7, 64, 10_000])
def test_every_line_is_in_one_range(monkeypatch, split):
    import io

    from plumeline.sources import streams

    monkeypatch.setattr(streams, "READ_BYTES", 5)
    data = b"one\n\n\r\nfour is a longer line\r\nfive\rsix\nseven"
    ranges = [part for r in streams.cut_ranges([("file:///a", len(data)), ("file:///empty", 0)], split) for part in r.parts]
    got = [x for uri, lo, hi, size in ranges if uri.endswith("a") for part in streams.range_lines(io.BytesIO(data), lo, hi, size) for x in part]
    assert got == [b"one", b"", b"", b"four is a longer line", b"five", b"six", b"seven"]


def test_small_ranges_share_tasks_that_carry_no_list_of_files(spark, tmp_path):
    import json

    from pyspark.serializers import CloudPickleSerializer

    from plumeline.sources import streams
    from plumeline.sources.lines import number_lines, read_lines

    size, split = 10 << 20, 64 << 10
    ranges = streams.cut_ranges([("file:///a", size), ("file:///b", 5)], split, 1 << 20)
    assert [p for r in ranges for p in r.parts] == [p for r in streams.cut_ranges([("file:///a", size), ("file:///b", 5)], split) for p in r.parts]
    assert len(ranges) == 11

    def pickled(files: int) -> tuple[int, int]:
        options = {"kind": "lines", "files": json.dumps([(f"file:///f{i}", size) for i in range(files)]), "split": str(split), "task": str(1 << 20), "known": "{}", "length": "0"}
        source = streams.ByteRanges(options)
        reader = source.reader(None)
        return len(CloudPickleSerializer().dumps((source, reader))), len(reader.partitions())

    (few, n), (many, m) = pickled(1), pickled(300)
    assert few == many and (n, m) == (10, 3000)
    path = tmp_path / "a.log"
    path.write_bytes(b"\n".join(b"line %d" % i * 3 for i in range(2000)))
    lines = read_lines(spark, [str(path)], split_bytes=100)
    assert lines.select("block").distinct().count() > 300 and lines.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert [r["value"] for r in number_lines(lines).orderBy("lineno").collect()] == ["line %d" % i * 3 for i in range(2000)]


def test_small_files_do_not_fill_a_task_up_to_the_size_of_a_range(spark, tmp_path):
    from plumeline.sources.lines import read_lines

    for i in range(16):
        (tmp_path / f"{i}.log").write_bytes(b"some line\n" * 20_000)
    lines = read_lines(spark, [str(tmp_path)])
    assert lines.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and lines.count() == 320_000


def test_text_offsets_and_nested_ranges(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "2020-10-26T18:24:16.000+0230 I SHARDING [Balancer] Starting chunk migration for shop.cart [{ k: { a: { b: { c: { d: 1 } } } } }, { k: { a: 5 } }) to s1\n"
        "2020-10-26T18:24:16.000Z I SHARDING [conn7] autosplitted shop.cart chunk: shard { a: { b: { c: { d: { e: 1 } } } } } x\n"
    )
    rows = {r["lineno"]: r for r in ingest_logs(spark, [str(tmp_path / "a.log")]).events.collect()}
    assert rows[1]["ts"].strftime("%H:%M") == "15:54" and rows[2]["ts"].strftime("%H:%M") == "18:24"
    assert (rows[1]["shard_range"]["min"], rows[1]["shard_range"]["max"]) == ("{ k: { a: { b: { c: { d: 1 } } } } }", "{ k: { a: 5 } }")
    assert rows[1]["shard_op"] == "startMig" and rows[2]["collection"] == "shop.cart"


def test_gzip_without_suffix(spark, tmp_path):
    p = tmp_path / "packed.log"
    p.write_bytes(gzip.compress(("\n".join(JSON_LINES[4:7]) + "\n").encode()))
    q = tmp_path / "plain.log.gz"
    q.write_bytes(gzip.compress((JSON_LINES[7] + "\n").encode()))
    found = gzip_without_suffix(spark, [str(p), str(q)])
    assert len(found) == 1 and found[0].endswith("packed.log")
    out = ingest_logs(spark, [str(p), str(q)])
    assert out.events.groupBy("short_name").count().orderBy("short_name").collect()[0]["count"] == 3
    assert out.events.count() == 4


@pytest.mark.parametrize("block", [300, 4096, 1_000_000])
def test_blocks_do_not_change_entries(spark, tmp_path, block):
    import random

    rng = random.Random(7)
    lines, want = [], []
    for f in range(2):
        text = ["junk before any entry"] if f else []
        expect = [(1, 1, "junk before any entry")] if f else []
        for i in range(80):
            body = [f"2024-01-01T00:00:{i % 60:02d}.000 entry {i}"] + [f"  more {k} " + "x" * rng.randrange(60) for k in range(rng.choice([0, 0, 0, 1, 2, 12]))]
            expect.append((len(text) + len(body), len(body), "\n".join(body)))
            text += body
        (tmp_path / f"f{f}.log").write_text("\n".join(text) + "\n")
        want += [(f"f{f}.log", *e) for e in expect]
    got = stitch_files(read_lines(spark, [str(tmp_path)], split_bytes=block)).entries
    rows = [(r["n"], r["lineno"], r["n_lines"], r["entry"]) for r in got.select(short_name(F.col("infile")).alias("n"), "lineno", "n_lines", "entry").collect()]
    assert sorted(rows) == sorted(want)


@pytest.mark.parametrize("block", [40, 300, 1_000_000])
def test_blocks_do_not_change_entries_that_end_with_a_pattern(spark, tmp_path, block):
    """Runs of short and of very long entries, entries that end with a block, and text behind the last end."""
    import random

    rng = random.Random(8)
    want = []
    for f in range(3):
        text = []
        for i in range(60):
            body = [f"2024-01-01T00:00:{i % 60:02d}.000 entry {i}"] + ["  more " + "x" * rng.randrange(40) for _ in range(rng.choice([0, 0, 1, 2, 40]))]
            body[-1] += f" {i}ms"
            text += body
            want.append((f"f{f}.log", len(text), len(body), "\n".join(body)))
        if f == 1:
            text += ["2024-01-01T00:01:00.000 open", "end"]
            want.append(("f1.log", len(text), 2, "\n".join(text[-2:])))
        (tmp_path / f"f{f}.log").write_text("\n".join(text) + "\n")
    got = stitch_files(read_lines(spark, [str(tmp_path)], split_bytes=block), end_pattern=r"\d+ms$")
    rows = got.entries.select(short_name(F.col("infile")).alias("n"), "lineno", "n_lines", "entry", "format").collect()
    assert sorted(tuple(r)[:4] for r in rows) == sorted(want)
    assert {r["format"] for r in rows} == {"text"}
    numbered = number_lines(read_lines(spark, [str(tmp_path)], split_bytes=block)).select(short_name(F.col("infile")).alias("n"), "lineno", "value")
    lines = {(r["n"], r["lineno"]): r["value"] for r in numbered.collect()}
    assert lines == {(f"f{f}.log", k): line for f in range(3) for k, line in enumerate((tmp_path / f"f{f}.log").read_text().splitlines(), 1)}


OLDER = """2015-10-26T18:24:19.000-0000 I WRITE    [conn15] update shop.cart query: { _id: 3,
 n: "a" } planSummary: IDHACK update: { $set: { b: 1 } } keysExamined:1 docsExamined:1 nMatched:1 numYields:0 locks:{} 12ms
2015-10-26T18:24:20.000-0000 I WRITE    [conn15] remove shop.cart query: { k: [ } planSummary: IDHACK docsExamined:1 3ms
2015-10-26T18:24:21.000-0000 I REPL     [repl-0] applied op: CRUD { ts: Timestamp(5, 1), op: "u", ns: "a.b", o: { $set: { x: 1 } } }, took 120ms
"""


def test_older_writes_end_rule_and_replication(spark, tmp_path):
    (tmp_path / "old.log").write_text(OLDER)
    options = IngestOptions(end_pattern=r"\d+ms$", older_writes=True, replication_ops=True)
    out = ingest_logs(spark, [str(tmp_path / "old.log")], options)
    rows = {r["lineno"]: r for r in out.events.collect()}
    assert (rows[2]["command"], rows[2]["filter_shape"], rows[2]["docs_examined"], rows[2]["duration_millis"]) == ("update", "{_id: 1,n: 1}", 1, 12)
    assert json.loads(rows[2]["attr"]) == {"q": {"_id": 3, "n": "a"}, "u": {"$set": {"b": 1}}}
    assert json.loads(rows[4]["details"])["update"] == "{ $set: { x: 1 } }"
    assert [(r["lineno"], r["error"]) for r in out.rejects.collect()] == [(3, "unreadable document")]


def test_a_batch_can_be_repeated_and_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(JSON_LINES) + "\n" + OLDER.replace("WRITE    [conn15] update", "COMMAND  [conn15] command") + '{"t":{"$date":"2024-0\n')
    (tmp_path / "b.log").write_text(JSON_LINES[4] + "\n")
    lake = str(tmp_path / "lake")
    first = ingest_logs(spark, [str(tmp_path / "a.log")])
    for frame in (first.events, first.headers, first.rejects):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "from_json(StructField(t,StructType" not in plan
    assert "ArrowEvalPython" not in first.rejects._jdf.queryExecution().executedPlan().toString()
    seen = []
    for run in range(2):
        write_ingested(first if run == 0 else ingest_logs(spark, [str(tmp_path / "a.log")]), lake, "monday")
        write_ingested(ingest_logs(spark, [str(tmp_path / "b.log")]), lake, "tuesday")
        seen.append([sorted(map(str, spark.read.parquet(f"{lake}/{t}").select("infile", "batch").collect())) for t in ("events", "headers", "rejects")])
    assert seen[0] == seen[1] and "tuesday" in str(seen[0][0]) and seen[0][2]
    with pytest.raises(ValueError):
        write_ingested(first, lake, "a/b")
