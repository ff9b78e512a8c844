import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from plumeline.operators.indexes import ID_INDEX, host_shards, index_report, user_collections
from plumeline.operators.metrics import first_of_chunk, increments, max_increment, metric_keys
from plumeline.sources.collstats import oplog_rows, read_shard_map, read_snapshots
from plumeline.sources.ftdc import decode_ftdc, metric_format, read_documents, read_metrics, read_server_status
from plumeline.sources.stacks import read_schema_export, read_stacks

STATS = """shell says hello
--CUT HERE--
{ _id: {Server: "server", DB: "all", Collection: "all"},
    runTime: ISODate("2024-03-10T00:00:00.000Z"),
   Tags:
{ "dc" : "x" }
, Databaselist:
[ ]
}
{ _id: {Server: "n1", DB: "local" ,Collection: "oplog.rs"},
   runTime: ISODate("2024-03-10T00:00:00.000Z"),

     size: 100,
     maxSize: 1000,
     headroom: 12.5,
     avgObjSize: 10,
     storageSize: 90}
{ _id: {Server: "n1", DB: "shop",Collection: "cart"},
2024-03-10T00:00:00.425-0000 I  NETWORK  [js] stray { line
   runTime: ISODate("2024-03-10T00:00:00.000Z"),

     NumIndexes: 4,
     totalIndexSize: 120,
     size: 500,
     count: 10,
     avgObjSize: undefined,
     storageSize: 4096,
     freeSpace: 0,
     collectedAt: ISODate("2024-03-10T00:00:00.000Z"),
     indexSizes:
{ "_id_" : 40, "a_1" : 50, "ttl_1" : 20, "late_1" : 10 }
,     indexStats: [
{ "name" : "_id_", "key" : { "_id" : 1 }, "host" : "h1:1", "shard" : "s1",
  "accesses" : { "ops" : NumberLong(0), "since" : ISODate("2024-03-01T00:00:00.000Z") }, "spec" : { "v" : 2, "key" : { "_id" : 1 }, "name" : "_id_" }, "v" : 2 }
,
{ "name" : "a_1", "key" : { "a" : 1, "b" : -1 }, "host" : "h1:1", "shard" : "s1",
  "accesses" : { "ops" : NumberLong(86400), "since" : ISODate("2024-03-09T00:00:00.000Z") }, "spec" : { "v" : 2 }, "v" : 2 }
,
{ "name" : "a_1", "key" : { "a" : 1, "b" : -1 }, "host" : "h2:1", "shard" : "s2",
  "accesses" : { "ops" : NumberLong(864000), "since" : ISODate("2024-02-29T00:00:00.000Z") }, "spec" : { "v" : 2, "expireAfterSeconds" : 5 }, "v" : 2 }
,
{ "name" : "ttl_1", "key" : { "t" : 1 }, "host" : "h1:1", "shard" : "s1",
  "accesses" : { "ops" : NumberLong(0), "since" : ISODate("2024-03-10T00:00:00.000Z") }, "spec" : { "v" : 2, "expireAfterSeconds" : 60 }, "v" : 2 }
]}
{ _id: {Server: "n1", DB: "shop",Collection: "empty"},
   runTime: ISODate("2024-03-10T00:00:00.000Z"),
     size: 0, count: 0, totalIndexSize: 8,
     indexSizes: { "_id_" : 8, "x_1": 0 },     indexStats: [
{ "name" : "x_1", "key" : { "x" : 1 }, "host" : "h1:1", "shard" : "s1",
  "accesses" : { "ops" : NumberLong(0), "since" : ISODate("2024-01-10T00:00:00.000Z") }, "spec" : { "v" : 2 }, "v" : 2 }
]}
{ _id: {Server: "n1", DB: "shop",Collection: "aborted"},
   runTime: ISODate("2024-03-10T00:00:00.000Z"),
     size: }
bye
"""

STATUS = """--- Sharding Status ---
  databases:
        {  "_id" : "shop",  "primary" : "s1",  "partitioned" : true }
                shop.cart
                        shard key: { "a" : 1, "b" : -1 }
                        unique: false
                shop.other
                        shard key: { "h" : "hashed" }
        {  "_id" : "plain",  "primary" : "s2",  "partitioned" : false }
                plain.skipped
                        shard key: { "z" : 1 }
"""


@pytest.fixture(scope="module")
def snaps(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("stats") / "stats.txt"
    p.write_text(STATS)
    good, rejects = read_snapshots(spark, [str(p)])
    return good.cache(), rejects


def test_snapshots(snaps):
    good, rejects = snaps
    assert sorted(r["_id"]["Collection"] for r in good.collect()) == ["all", "cart", "empty", "oplog.rs"]
    assert "aborted" in rejects.collect()[0]["raw"]
    oplog = oplog_rows(good).collect()[0]
    assert (oplog["maxSize"], oplog["headroom"]) == (1000, 12.5)
    assert user_collections(good).count() == 3
    cart = good.filter("_id.Collection = 'cart'").collect()[0]
    assert cart["indexStats"][1]["key"] == '{"a":1,"b":-1}' and cart["avgObjSize"] is None


def test_index_report(spark, snaps, tmp_path):
    good, _ = snaps
    (tmp_path / "sh.txt").write_text(STATUS)
    shard_map = read_shard_map(spark, [str(tmp_path / "sh.txt")])
    assert {(r["db"], r["primary"], r["collection"], r["shard_key"]) for r in shard_map.collect()} == {
        ("shop", "s1", "cart", '{"a":1,"b":-1}'),
        ("shop", "s1", "other", '{"h":"hashed"}'),
    }
    report = index_report(good, shard_map, host_shards(good))
    ix = {r["name"]: r for r in report.indexes.collect()}
    assert set(ix) == {"cart._id_", "cart.a_1", "cart.ttl_1", "cart.late_1", "empty._id_", "empty.x_1"}
    a = ix["cart.a_1"]
    assert a["total_ops"] == pytest.approx(2.0) and a["is_ttl"] == "mixed" and a["shard_key"] and a["n_shards"] == 2
    assert a["new_index"] and not a["unused"] and a["key_size"] == 5.0
    assert not ix["cart._id_"]["new_index"] and ix["cart._id_"]["is_id"] and ix["cart._id_"]["unused"]
    assert ix["cart.ttl_1"]["is_ttl"] == "TRUE" and not ix["cart.ttl_1"]["unused"] and ix["cart.ttl_1"]["total_ops"] == 0
    assert ix["cart.late_1"]["total_ops"] is None and ix["cart.late_1"]["key_size"] == -1
    assert ix["empty.x_1"]["unused"] and ix["empty.x_1"]["key_size"] == 0 and not ix["empty.x_1"]["shard_key"]
    db = report.databases.collect()[0]
    assert (db["db"], db["collections"], db["data_size"], db["index_size"], db["used_index_size"], db["n_shards"]) == ("shop", 2, 500, 128, 110, 2)
    ops = {(r["index_name"], r["shard"]): r["shard_ops"] for r in report.per_shard.filter("collection = 'cart'").collect()}
    assert ops["a_1", "s1"] == pytest.approx(1.0) and ops["a_1", "s2"] == pytest.approx(1.0)
    assert ID_INDEX == "_id_"


# --- metric archives --------------------------------------------------------


def bson(doc):
    out = b""
    for k, v in doc.items():
        key = k.encode() + b"\0"
        if isinstance(v, bool):
            out += b"\x08" + key + bytes([v])
        elif isinstance(v, float):
            out += b"\x01" + key + struct.pack("<d", v)
        elif isinstance(v, int):
            out += b"\x12" + key + struct.pack("<q", v)
        elif isinstance(v, str):
            out += b"\x02" + key + struct.pack("<i", len(v) + 1) + v.encode() + b"\0"
        elif isinstance(v, bytes):
            out += b"\x05" + key + struct.pack("<i", len(v)) + b"\0" + v
        elif isinstance(v, dict):
            out += b"\x03" + key + bson(v)
        elif isinstance(v, tuple) and v[0] == "date":
            out += b"\x09" + key + struct.pack("<q", v[1])
        elif isinstance(v, tuple):
            out += b"\x11" + key + struct.pack("<II", *v)
    return struct.pack("<i", len(out) + 5) + out + b"\0"


def varint(n):
    n &= 0xFFFFFFFFFFFFFFFF
    out = b""
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def chunk(reference, columns, n_metrics=None):
    """A chunk whose metric columns follow the numeric leaves of the reference."""
    flat = [d for col in columns for d in (b - a for a, b in zip(col, col[1:]))]
    body, i = b"", 0
    while i < len(flat):
        body += varint(flat[i])
        if flat[i] == 0:
            run = 0
            while i + 1 + run < len(flat) and flat[i + 1 + run] == 0:
                run += 1
            body += varint(run)
            i += run
        i += 1
    data = bson(reference) + struct.pack("<II", n_metrics or len(columns), len(columns[0]) - 1) + body
    return bson({"_id": ("date", 0), "type": 1, "data": struct.pack("<I", len(data)) + zlib.compress(data)})


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    d = tmp_path_factory.mktemp("ftdc")
    start = [1_700_000_000_000 + 1000 * i for i in range(5)]
    ref = {"start": ("date", start[0]), "name": "skip", "net": {"in": 10, "ok": True, "load": 1.9}, "op": (7, 3)}
    cols = [start, [10, 12, 5, 5, 2**40], [1, 1, 1, 1, 1], [1, 1, 1, 1, 2], [7, 7, 8, 9, 9], [3, 3, 3, 3, 3]]
    meta = bson({"_id": ("date", 1), "type": 0, "doc": {"host": "h", "n": 3, "when": ("date", 5)}})
    more = [s + 5000 for s in start]
    second = chunk({**ref, "start": ("date", more[0]), "net": {"in": 100, "ok": True, "load": 1.9}}, [more, [100, 101, 2**40 + 101 - 5, 0, 1]] + cols[2:])
    bad = chunk(ref, cols, n_metrics=9)
    (d / "metrics.bin").write_bytes(meta + chunk(ref, cols) + second + bad)
    return d


def test_ftdc(spark, archive):
    samples, metadata, rejects = decode_ftdc(spark, [str(archive / "metrics.bin")])
    samples = samples.cache()
    got = {}
    for r in samples.orderBy("chunk_no", "sample_no").collect():
        got.setdefault((r["chunk_no"], ".".join(r["path"])), []).append(r["value"])
    assert got[1, "net.in"] == [10, 12, 5, 5, 2**40]
    assert got[1, "net.load"] == [1, 1, 1, 1, 2] and got[1, "op.t"] == [7, 7, 8, 9, 9]
    assert got[2, "net.in"] == [100, 101, 2**40 + 96, 0, 1]
    assert metric_keys(samples).count() == 6
    assert first_of_chunk(samples).count() == 12
    assert json.loads(metadata.collect()[0]["doc"]) == {"host": "h", "n": 3, "when": {"$date": 5}}
    assert "9 expected" in rejects.collect()[0]["error"]
    best = max_increment(increments(samples.filter("array_join(path, '.') = 'net.in'")))
    best = best.select("max_inc", F.unix_seconds("max_ts").alias("at")).collect()[0]
    assert (best["max_inc"], best["at"]) == (2**40 - 5, 1_700_000_007)  # the later of two equal jumps


def test_damaged_archives_and_missing_clocks(spark, tmp_path):
    ref, cols = {"n": 3, "net": {"in": 10}}, [[3, 4, 5], [10, 10, 12]]
    regex = b"\x0bre\0a+\0i\0" + b"\x13dec\0" + b"\0" * 16
    body = bson({"type": 0, "doc": {"h": 1}})
    odd = struct.pack("<i", len(body) + len(regex)) + body[4:-1] + regex + b"\0"
    (tmp_path / "a.bin").write_bytes(chunk(ref, cols) + odd + b"\0" * 64)
    (tmp_path / "b.bin").write_bytes(chunk(ref, cols)[:40])
    samples, metadata, rejects = decode_ftdc(spark, [str(tmp_path)])
    got = {(".".join(r["path"]), r["sample_no"]): (r["ts"], r["value"]) for r in samples.collect()}
    assert got["n", 2] == (None, 5) and got["net.in", 0] == (None, 10) and len(got) == 6
    assert [json.loads(r["doc"]) for r in metadata.collect()] == [{"h": 1}]
    assert sorted((r["file"][-5:], r["chunk_no"]) for r in rejects.collect()) == [("a.bin", 2), ("b.bin", 0)]


@pytest.mark.parametrize("split", [170, 2000, 1 << 27])
def test_an_archive_is_the_same_in_ranges_of_any_size(spark, tmp_path, split):
    """Documents over range edges, damage, a document that holds what looks like one, and documents of another form."""
    inner = bson({"_id": ("date", 9), "type": 0, "doc": {"host": "inner"}})
    docs = []
    for i in range(12):
        start = [1_700_000_000_000 + 1000 * (5 * i + k) for k in range(5)]
        docs.append(chunk({"start": ("date", start[0]), "n": i}, [start, [i, i + 1, i, i, 2**40 + i]]))
        if i % 3 == 0:
            docs.append(bson({"_id": ("date", i), "type": 0, "doc": {"host": f"h{i}", "raw": inner + b"x" * 400}}))
        if i == 5:
            docs.append(bson({"type": 0, "doc": {"no": "id", "pad": "y" * 900}}))
    (tmp_path / "good.bin").write_bytes(b"".join(docs))
    (tmp_path / "damaged.bin").write_bytes(b"".join(docs[:4]) + b"\xff" * 300 + b"".join(docs[4:9]) + docs[9][:50])
    (tmp_path / "plain.bin").write_bytes(b"".join(bson({"type": 0, "doc": {"k": i}}) for i in range(40)))
    found = {}
    for r in read_documents(spark, [str(tmp_path)], split).collect():
        found.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["chunk_no"], r["kind"], bytes(r["doc"])))
    kinds = {name: [kind for _, kind, _ in sorted(rows)] for name, rows in found.items()}
    assert [d for _, _, d in sorted(found["good.bin"])] == docs
    assert [d for _, k, d in sorted(found["damaged.bin"]) if k >= 0] == docs[:9] and kinds["damaged.bin"].count(-1) == 2
    assert kinds["plain.bin"] == [0] * 40 and all([n for n, _, _ in sorted(rows)] == list(range(len(rows))) for rows in found.values())
    samples, metadata, rejects = decode_ftdc(spark, [str(tmp_path / "good.bin")], split)
    assert (samples.count(), metadata.count(), rejects.count()) == (120, 5, 0)
    assert samples.filter("array_join(path, '.') = 'n' and sample_no = 4").agg(F.sum("value")).first()[0] == 12 * 2**40 + 66


def test_formats_change_inside_a_stack_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("main;k\n#format timestamp;stack\n1.5;main;f\n#format count;stack\n4;main;g\n")
    rows, rejects = read_stacks(spark, [str(tmp_path)])
    assert sorted((r["ts"], tuple(r["stack"]), r["weight"]) for r in rows.collect()) == [(0.0, ("main", "g"), 4.0), (0.0, ("main", "k"), 1.0), (1.5, ("main", "f"), 1.0)]
    assert rejects.count() == 0


def test_schema_export_to_the_last_level(spark, tmp_path):
    field = {"name": "f12", "count": 1, "probability": 1, "types": [{"name": "Int32", "count": 1}]}
    for level in range(11, 0, -1):
        field = {"name": f"f{level}", "count": 1, "probability": 1, "types": [{"name": "Document", "count": 1, "fields": [field]}]}
    (tmp_path / "s.json").write_text(json.dumps({"fields": [field]}))
    rows = read_schema_export(spark, [str(tmp_path / "s.json")]).collect()
    assert sorted(r["level"] for r in rows) == list(range(1, 13))


def test_server_status_and_detection(spark, archive):
    lines = [{"localTime": f"2024-01-01T00:00:{i % 60:02d}Z", "a": {"b": {"floatApprox": i}, "c": 1.5, "s": "x"}, "up": True} for i in range(205)]
    p = archive / "status.json"
    p.write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    rows = read_server_status(spark, [str(p)])
    b = rows.filter("array_join(path, '.') = 'serverStatus.a.b'").orderBy("chunk_no", "sample_no").collect()
    assert [r["value"] for r in b] == list(range(205))
    assert {r["chunk_no"] for r in b} == {0, 1, 2} and b[100]["sample_no"] == 0
    assert {r["format"] for r in metric_format(spark, [str(archive)]).collect()} == {"archive", "status"}
    both = read_metrics(spark, [str(archive / "metrics.bin"), str(p)])
    assert both.select("file").distinct().count() == 2


def test_stacks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("#format timestamp;count;stack\n1.0;3;main;f(int);g<T<int>>\n1.0;2;main;f(char)\nshort\n")
    (tmp_path / "b.txt").write_text("#format timestamp;time;stack-id\n#stack 7 main;h\n2.5;9;7\n")
    (tmp_path / "c.txt").write_text("main;k\n")
    rows, rejects = read_stacks(spark, [str(tmp_path)])
    got = sorted((r["file"][-5], r["ts"], tuple(r["stack"]), r["weight"], r["is_time"]) for r in rows.collect())
    assert got == [
        ("a", 1.0, ("main", "f"), 2.0, False),
        ("a", 1.0, ("main", "f", "g<...>"), 3.0, False),
        ("b", 2.5, ("main", "h"), 9.0, True),
        ("c", 0.0, ("main", "k"), 1.0, False),
    ]
    assert [r["raw"] for r in rejects.collect()] == ["short"]


def test_schema_export(spark, tmp_path):
    doc = {
        "fields": [
            {"name": "_id", "count": 10, "probability": 1, "has_duplicates": False, "types": [{"name": "ObjectID", "count": 10}]},
            {"name": "a", "count": 8, "probability": 0.8, "has_duplicates": True, "types": [
                {"name": "Document", "count": 6, "fields": [{"name": "x", "count": 6, "probability": 1, "types": [{"name": "Int32", "count": 6}]}]},
                {"name": "String", "count": 2}]},
            {"name": "l", "count": 4, "probability": 0.4, "types": [
                {"name": "Array", "count": 4, "probability": 1, "types": [{"name": "String", "count": 9}]}]},
            {"name": "u", "count": 1, "probability": 0.1},
        ]
    }
    (tmp_path / "s.json").write_text(json.dumps(doc))
    rows = {tuple(r["path"]): r for r in read_schema_export(spark, [str(tmp_path / "s.json")]).collect()}
    assert set(rows) == {("_id",), ("a",), ("a", "x"), ("l",), ("l", "[]"), ("u",)}
    assert [(t["type"], t["percent"]) for t in rows["a",]["types"]] == [("Document", 75.0), ("String", 25.0)]
    assert rows["a",]["has_duplicates"] and rows["a", "x"]["level"] == 2
    assert rows["l",]["types"][0]["type"] == "Array" and rows["u",]["types"][0]["type"] == "Undefined"
