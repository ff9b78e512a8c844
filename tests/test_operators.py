import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import Window, functions as F

from plumeline.functions import jsonpath as jp
from plumeline.functions.flatten import flatten_json, json_rejects
from plumeline.functions.jsonpath import waits
from plumeline.functions.relaxed import relaxed_to_json
from plumeline.functions.shape import query_shape, shallow_shape
from plumeline.functions.text import cell, clean_function_name, outer_groups
from plumeline.functions.times import iso_duration, parse_date
from plumeline.operators import commands as cm
from plumeline.operators import fields as fi
from plumeline.operators import lookups as lk
from plumeline.operators import profile as pr
from plumeline.operators import running as rn
from plumeline.operators import schema_profile as sp
from plumeline.operators import shape_report as sr
from plumeline.operators import timeseries as ts
from plumeline.operators.docdiff import diff_documents, diff_lines
from plumeline.session import clear_scratch, scratch_root, staged
from plumeline.sinks import files as sinks
from plumeline.sources.textlog import replication_op, write_segments


def one(spark, schema, value, expr):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("x")).collect()[0]["x"]


# --- shapes -----------------------------------------------------------------

SHAPES = [
    ('{"b": 1, "a": "x"}', "{b: 1,a: 1}", ["int", "string"]),
    ('{"_$or": [{"a": 1}, {"b": null}]}', "{$or: [ {a: 1},{b: 1} ]}", ["int", "null"]),
    ('{"a": {"$in": [1, 2, 3]}}', "{a: {$in: [ N ]}}", ["int"] * 3),
    ('{"a": {"$in": [1]}}', "{a: {$in: [ 1 ]}}", ["int"]),
    ('{"a": {"$in": []}}', "{a: {$in: [  ]}}", []),
    ('{"a": [{"x": 1}, [2, 3], 4, 5]}', "{a: [ {x: 1},[ N ],N ]}", ["int"] * 5),
    ('{"t": {"$date": "2024-01-01T00:00:00Z"}, "i": {"$oid": "ab"}}', "{t: 1,i: 1}", ["date", "objectid"]),
    ('{"r": {"$regex": "^a", "$options": "i"}}', "{r: 1}", ["regex"]),
    ('[{"$match": {"k": 5000000000}}]', "{k: 1}", ["long"]),
    ('[{"$group": {"k": 1}}]', '[{"$group": {"k": 1}}]', []),
    ("not json", "not json", []),
]


def test_query_shape(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(SHAPES)], "i int, t string")
    rows = df.select("i", query_shape("t").alias("s")).orderBy("i").collect()
    assert [r["s"]["shape"] for r in rows] == [s for _, s, _ in SHAPES]
    assert [[p["type"] for p in r["s"]["params"]] for r in rows] == [p for _, _, p in SHAPES]


def test_shape_ignores_values(spark):
    a = one(spark, "t string", '{"k":{"$gte":1,"$lt":[1,2]}}', query_shape("t"))
    b = one(spark, "t string", '{"k":{"$gte":"z","$lt":[9,8,7]}}', query_shape("t"))
    assert a["shape"] == b["shape"]


def test_shallow_shape(spark):
    got = one(spark, "t string", '{"a":-1,"b":{"$in":[1,2]},"c":{"$x":{"y":1}},"d":{"$m":"t"}}', shallow_shape("t"))
    assert got == "{a: 1,b: {$in: [2]},c: {$x: {}},d: {$m: 1}}"


RELAXED = [
    ("{ a: 1, b: 'x y', $or: [ { c: true } ] }", {"a": 1, "b": "x y", "$or": [{"c": True}]}),
    ("{ at: new Date(1600000000000), id: ObjectId('5f'), t: Timestamp(1, 2) }", {"at": {"$date": 1600000000000}, "id": "ObjectId('5f')", "t": "Timestamp(1, 2)"}),
    ("{ d: ISODate(\"2020-01-01T00:00:00Z\"), n: NumberLong(5), u: undefined }", {"d": {"$date": "2020-01-01T00:00:00Z"}, "n": 5, "u": None}),
    ("{ a.b: /x, y/i, k: MinKey, q: \"it's\" }", {"a.b": "/x, y/i", "k": "MinKey", "q": "it's"}),
    ('{ s: "a\\"b", b: BinData(0, AB12), f: 1.5e3 }', {"s": 'a"b', "b": "BinData(0, AB12)", "f": 1500.0}),
    ("{ a: { b: 1 }", None),
    ("plain words", None),
]


def test_relaxed_to_json(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RELAXED)], "i int, t string")
    rows = df.select("i", relaxed_to_json("t").alias("j")).orderBy("i").collect()
    assert [json.loads(r["j"]) if r["j"] else None for r in rows] == [w for _, w in RELAXED]


def test_small_functions(spark):
    assert one(spark, "t string", "{x}::std::map<a<b>, c>::f(int (*)(x)) const [clone]", clean_function_name(F.col("t"))) == "std::map<...>::f "
    assert one(spark, "a array<string>", ["x"], cell(F.col("a"))) == "x"
    assert one(spark, "a array<string>", [], cell(F.col("a"))) == ""
    assert one(spark, "a array<string>", ["x", "y"], cell(F.col("a"))) == '["x","y"]'
    assert one(spark, "a array<string>", None, cell(F.col("a"), "1")) == "1"
    for text in ("2024-01-02", "2024-01-02T00:00:00", "2024-01-02T00:00:00.000+00:00", "2024-01-02T01:00:00.000000+0100"):
        assert one(spark, "t string", text, parse_date(F.col("t")).cast("string")) == "2024-01-02 00:00:00"
    assert one(spark, "t string", "nope", parse_date(F.col("t"))) is None
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    for text, want in (("2024-01-01 01:02:03.5", "PT1H2M3.5S"), ("2023-12-31 23:59:00", "PT-1M"), ("2024-01-01 00:00:00", "PT0S")):
        assert one(spark, "t string", text, iso_duration(at, F.col("t").cast("timestamp"))) == want
    assert one(spark, "t string", "a=1, b=2, a=3", jp.key_values(F.col("t"), r"(\w)=(\d)")) == {"a": "3", "b": "2"}
    pipeline = '{"pipeline":[{"$group":{"x":1}},{"$match":{"a":1}}]}'
    doc = F.get_json_object("t", "$.pipeline")
    assert one(spark, "t string", pipeline, jp.any_match(doc)) == '{"a":1}'
    assert one(spark, "t string", pipeline, jp.leading_match(doc)) is None
    body = 'update shop.cart query: { a: 1 } planSummary: IDHACK update: { $set: { b: 2 } } keysExamined:1 docsExamined:1 locks:{ Global: 1 } storage:{} 15ms'
    seg = one(spark, "t string", body, write_segments(F.col("t")))
    assert (seg["query"], seg["update"], seg["plan"], seg["stats"], seg["time"]) == ("{ a: 1 }", "{ $set: { b: 2 } }", "IDHACK", "keysExamined:1 docsExamined:1", 15)
    op = 'applied op: CRUD { ts: Timestamp(5, 1), op: "u", ns: "a.b", wall: new Date(7), o: { $set: { x: 1 } } }, took 120ms'
    got = one(spark, "t string", op, replication_op(F.col("t")))
    assert (got["op"], got["ns"], got["op_time"], got["wall_time"], got["time"]) == ("u", "a.b", "Timestamp(5, 1)", "new Date(7)", 120)


def test_outer_groups(spark):
    text = 'move [{ k: { a: 1 } }, { k: { a: { b: 2 } } }) now'
    assert one(spark, "t string", text, outer_groups(F.col("t"), "{", "}")) == ["{ k: { a: 1 } }", "{ k: { a: { b: 2 } } }"]
    assert one(spark, "t string", "none", outer_groups(F.col("t"), "{", "}")) is None


def test_shared_folder_is_named_and_cleared(spark):
    kept = staged(spark.range(5), "x")
    assert kept.count() == 5 and os.path.isdir(scratch_root(spark))
    clear_scratch(spark)
    assert not os.path.exists(scratch_root(spark))


# --- running values ---------------------------------------------------------


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_equals_plain_window(spark, width):
    rng = random.Random(width)
    keys = [None, "hot", "cold"]
    rows = [(rng.choices(keys, [1, 8, 1])[0], i, rng.choice([None, rng.randrange(-50, 50)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    got = rn.with_running(
        df, ["k"], ["at"], F.floor(F.col("at") / width),
        [rn.LastValue(F.col("v"), "last"), rn.RunningSum(F.col("v"), "sum"), rn.MaxBefore(F.col("v"), "high"), rn.Previous(F.col("v"), "prev")],
    )
    w = Window.partitionBy("k").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "*", F.last("v", True).over(upto).alias("last"), F.sum(F.coalesce("v", F.lit(0))).over(upto).alias("sum"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("high"), F.lag("v").over(w).alias("prev"),
    )
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)


# --- time series ------------------------------------------------------------


def test_gap_fill_keeps_totals(spark):
    t0 = dt.datetime(2024, 1, 1, 23, 59, 58)
    rows = [(t0 + dt.timedelta(seconds=s), k) for s, k in ((0, "a"), (0, None), (3, "b"), (86400 * 2, "a"))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, item string")
    out = ts.time_metrics(df, 1)
    assert out.agg(F.sum("Total")).first()[0] == 4
    assert out.count() == 86400 * 2 + 1
    wide = ts.crosstab(df, "item", 3600)
    assert wide.columns == ["Time", "Other", "a", "b"]
    assert wide.count() == 49
    total = wide.agg(*[F.sum(c).alias(c) for c in ("Other", "a", "b")]).first()
    assert tuple(total) == (1, 2, 1)
    assert ts.time_metrics(df.filter("false"), 60).count() == 0
    with pytest.raises(ValueError):
        ts.Metric.parse("a|b")
    with pytest.raises(ValueError):
        ts.time_metrics(df, 60, [ts.Metric("a", "b", "c", "$median", "item")])


def test_series_files(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 5), (dt.datetime(2024, 1, 1, 0, 2), 7)], "ts timestamp, v int")
    metric = ts.Metric.parse("Cost|ms|cost|$sum|v")
    table = sinks.series_table(ts.time_metrics(df, 60, [metric]), [metric], "load")
    assert table.columns == ["Time", "Cost#units=ms;section=load"]
    assert [tuple(r) for r in table.collect()] == [(1704067200, 5), (1704067260, 0), (1704067320, 7)]
    sinks.write_csv(table, str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).count() == 3
    cross = sinks.crosstab_table(ts.crosstab(df, "v", 60), "Ops", "n", "load")
    assert cross.columns == ["Time", "5 Ops#units=n;section=load", "7 Ops#units=n;section=load"]


# --- reports ----------------------------------------------------------------


def ops(spark):
    cols = (
        "ts timestamp, infile string, lineno bigint, command string, object string, query_hash string, filter_shape string, "
        "plan_summary string, duration_millis bigint, docs_examined bigint, nreturned bigint, ratio double, "
        "has_sort_stage boolean, n_shards bigint, attr string, originating_command string"
    )
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [
        (at(2), "f", 2, "find", "c1", "H1", "{a: 1}", "COLLSCAN", 2000, 10, 2, 5.0, None, 1, '{"filter":{"a":2},"sort":{"a":1},"limit":5}', None),
        (at(1), "f", 1, "find", "c1", "H1", "{a: 1,b: 1}", "IXSCAN", 100, 10, 5, 2.0, True, 3, '{"filter":{"a":1},"limit":7}', None),
        (at(3), "f", 3, "getMore", "x", None, "{k: 1}", "IXSCAN", 50, 4, 1, 4.0, None, 2, '{"collection":"c2"}', '{"filter":{"k":1},"sort":{"z":1}}'),
        (at(4), "g", 4, "update", "c3", None, None, None, None, None, None, None, None, None, '{"updates":[{"q":{"u":1}}]}', None),
    ]
    return spark.createDataFrame(rows, cols)


def test_shape_report(spark):
    rows = sr.shape_report(ops(spark)).collect()
    assert [(r["col"], r["shape"], r["cnt"], r["cost"], r["limit"]) for r in rows] == [("c1", "H1", 2, 2100, 7), ("c2", "{k: 1}", 1, 50, None)]
    assert rows[0]["filters"] == ["{a: 1,b: 1}", "{a: 1}"] and rows[0]["ratio"] == 3.5
    assert (rows[0]["sample"]["lineno"], rows[0]["sample"]["filter"]) == (1, '{"a":1}')
    assert rows[1]["sorts"] == ['{"z":1}'] and rows[1]["sample"]["filter"] == '{"k":1}'
    everything = sr.shape_report(ops(spark), all_queries=True).collect()
    assert [(r["col"], r["shape"], r["cost"], r["sample"]["filter"]) for r in everything][-1] == ("c3", None, -1, '{"u":1}')
    assert [r["col"] for r in sr.shape_report(ops(spark), "long").collect()] == ["c1"]
    assert [r["cnt"] for r in sr.shape_report(ops(spark), "sort").collect()] == [1]
    assert "limit" not in sr.shape_report(ops(spark), multi_tenant=True).columns
    where = sr.selection(["f"], start=dt.datetime(2024, 1, 1, 0, 0, 1), end=dt.datetime(2024, 1, 1, 0, 0, 3))
    assert [r["cnt"] for r in sr.shape_report(ops(spark), where=where).collect()] == [1]
    with pytest.raises(ValueError):
        sr.shape_report(ops(spark), "nope")


def test_router_report_and_file(spark, tmp_path):
    r = sr.router_report(ops(spark), "multi_shard").collect()
    assert [(x["col"], x["min_shards"], x["max_shards"]) for x in r] == [("c1", 1, 3), ("x", 2, 2), ("c3", None, None)]
    assert [x["col"] for x in sr.router_report(ops(spark), "multi_shard_gt1").collect()] == ["c1", "x"]
    assert [x["col"] for x in sr.router_report(ops(spark), "multi_shard_gt1", mode="compat").collect()] == ["c1"]
    report = sr.full_report(ops(spark))
    assert report.filter("section = 'Overall Cost'").count() == 2
    sinks.write_sections(report, str(tmp_path / "r"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert text[0] == "Overall Cost" and text[1] == "============" and text[2].startswith("hash,collection")
    assert text.count("Has Sort Stage") == 1 and len(text) == 4 * 3 + report.count()
    assert sr.full_router_report(ops(spark)).count() == 3 + 1 + 3 + 2


# --- joins ------------------------------------------------------------------


def test_range_join_matches_all_pairs(spark):
    rng = random.Random(3)
    points = [(i, rng.randrange(0, 50), rng.randrange(0, 10)) for i in range(300)]
    cuts = sorted({(rng.randrange(0, 50), rng.randrange(0, 10)) for _ in range(60)})
    ranges = [(*a, *b, f"s{i}") for i, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(10, 0, 40, 0, "wide")]
    p = spark.createDataFrame(points, "id int, a int, b int")
    r = spark.createDataFrame(ranges, "la int, lb int, ha int, hb int, shard string")
    got = lk.range_join(p, r, F.struct("a", "b"), F.struct("la", "lb"), F.struct("ha", "hb"), F.col("a"), F.col("la"), F.col("ha"))
    want = {(i, s) for i, a, b in points for la, lb, ha, hb, s in ranges if (la, lb) <= (a, b) < (ha, hb)}
    assert {(x["id"], x["shard"]) for x in got.collect()} == want and got.count() == len(want)


# --- profiles ---------------------------------------------------------------


def stacks(spark):
    rows = [(1.0, ["main", "f", "g"], 6.0), (1.0, ["main", "f", "g"], 2.0), (1.0, ["main", "h"], 1.9), (1.0, ["main", "tiny"], 0.05), (2.0, ["main", "h", ":hot"], 4.0), (2.0, ["main", "h", ":cold"], 1.0)]
    return spark.createDataFrame(rows, "ts double, stack array<string>, weight double")


def test_profile(spark, tmp_path):
    tree = pr.tree_rollup(stacks(spark), temperature=True).cache()
    root = {r["ts"]: r["weight"] for r in tree.filter("depth = 0").collect()}
    assert root == {1.0: pytest.approx(9.95), 2.0: 5.0}
    hot = {(r["ts"], tuple(r["node"])): (r["weight"], r["hot"]) for r in tree.collect()}
    assert hot[2.0, ("main", "h")] == (5.0, 4.0)
    prof = pr.profile_tree(stacks(spark), temperature=True)
    names = {tuple(r["node"]) for r in prof.collect()}
    assert ("main", "tiny") not in names and ("main", "f", "g") in names
    walk = [tuple(r["node"]) for r in pr.tree_order(pr.node_totals(tree)).orderBy("position").collect()]
    assert walk == [("main",), ("main", "f"), ("main", "f", "g"), ("main", "h"), ("main", "tiny")]
    table = sinks.profile_table(prof, temperature=True)
    assert len(table.columns) == 1 + 3 * 4 and table.columns[1].startswith("000000#distinctName=cold;color=0;units=%")
    threads = sinks.profile_table(pr.profile_tree(stacks(spark).filter("ts = 1"), style="threads"), style="threads")
    assert len(threads.columns) == 1 + 5 and "name=tiny" in threads.columns[5]
    rev = {tuple(r["node"]) for r in pr.tree_rollup(stacks(spark), reverse=True).collect()}
    assert ("LEAF", "g", "f", "main") in rev
    with pytest.raises(ValueError):
        pr.profile_tree(stacks(spark), style="flame")
    sinks.write_stacks(stacks(spark).filter("ts = 1"), str(tmp_path / "st"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "st")).collect()]
    assert "#format timestamp;stack" in lines and "1.0;main;f;g" in lines


# --- documents --------------------------------------------------------------

LEFT = [("1", '{"a":1,"b":{"c":[1,{"d":"x"}],"e":true},"z":null}'), ("2", '{"s":"t"}'), ("3", "[]")]
RIGHT = [("1", '{"a":"1","b":{"c":[1,{"d":"y"},3]},"n":5,"z":null}'), ("2", '{"s":"t"}'), ("4", '{"q":1}')]


def test_diff(spark):
    left, right = (spark.createDataFrame(x, "id string, body string") for x in (LEFT, RIGHT))
    got = {(r["id"], ".".join(r["path"]), r["change"]) for r in diff_documents(left, right).collect()}
    assert got == {
        ("1", "a", "type"), ("1", "b.c.[1].d", "value"), ("1", "b.c.[2]", "only_right"), ("1", "b.e", "only_left"),
        ("1", "n", "only_right"), ("3", "", "only_left"), ("4", "q", "only_right"),
    }
    assert diff_documents(left, left).count() == 0
    lines = {r["line"] for r in diff_lines(diff_documents(left, right)).collect()}
    assert "<   a:Integer64" in lines and ">   a:string" in lines and ">" + "   " * 4 + "b.c.[1].d:y" in lines


def _nested(levels):
    return '{"a":' * levels + "1" + "}" * levels


def test_flatten_opens_every_level(spark):
    df = spark.createDataFrame([(1, _nested(12)), (2, '{"l":[[[{"x":null}]],[]],"n":1.50,"e":2e3,"big":12345678901234567890}'), (3, "no"), (4, None)], "id int, j string")
    got = {(r["id"], ".".join(r["path"]), r["type"], r["value"]) for r in flatten_json(df, "j", ["id"]).collect()}
    assert got == {
        (1, ".".join("a" * 12), "Integer64", "1"), (2, "l.[0].[0].[0].x", "null", None), (2, "l.[1]", "array", "[]"),
        (2, "n", "number", "1.5"), (2, "e", "number", "2000.0"), (2, "big", "number", "12345678901234567890"),
    }
    deep = df.filter("id = 1").select(F.lit("c").alias("ns"), F.col("id").cast("string").alias("id"), F.col("j").alias("body"))
    assert fi.find_fields(deep.withColumn("body", F.lit(_nested(11)[:-11] + "}" * 11)), "a").count() == 11
    assert sp.profile_schema(deep).agg(F.max("level")).first()[0] == 12
    other = deep.withColumn("body", F.lit(_nested(12).replace("1", "2")))
    (row,) = diff_documents(deep, other).collect()
    assert (len(row["path"]), row["change"], row["left_value"], row["right_value"]) == (12, "value", "1", "2")


def test_names_of_any_nesting(spark):
    for depth in (1, 4, 12):
        name = "a" + "<b" * depth + ">" * depth + "::f" + "(" * depth + ")" * depth
        assert spark.range(1).select(clean_function_name(F.lit(name))).first()[0] == "a<...>::f"


def test_crosstab_counts_unlisted_items(spark):
    rows = [("2024-01-01 00:00:00", k) for k in ("a", "b", "c", None, "it's", "a")]
    df = spark.createDataFrame(rows, "t string, k string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "k")
    row = ts.crosstab(df, "k", 3600, items=["a", "it's"]).first().asDict()
    assert (row["a"], row["it's"], row["Other"]) == (2, 1, 3)


def test_first_and_last_break_ties(spark):
    rows = [("2024-01-01 00:00:00", "f", n, n) for n in (3, 1, 2)]
    df = spark.createDataFrame(rows, "t string, infile string, lineno int, v int").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    metrics = [ts.Metric("F", "v", "first", "$first", "v"), ts.Metric("L", "v", "last", "$last", "v")]
    row = ts.time_metrics(df, 60, metrics).first()
    assert (row["first"], row["last"]) == (1, 3)


def test_find_fields(spark):
    docs = [("c1", str(i), json.dumps({"Name": i, "sub": {"username": 1}, "l": [{"name": 1}, {"name": 2}]})) for i in range(20)]
    docs += [("c2", "x", '{"k":1}')]
    df = spark.createDataFrame(docs, "ns string, id string, body string")
    got = {(r["ns"], r["field"]): r["documents"] for r in fi.find_fields(df, "name").collect()}
    assert got == {("c1", "Name"): 5, ("c1", "sub.username"): 5, ("c1", "l.[].name"): 5}
    every = {r["field"]: r["documents"] for r in fi.find_fields(df, "name", n=None).collect()}
    assert every["Name"] == 20
    assert [r["ns"] for r in fi.without_matches(df, fi.find_fields(df, "name")).collect()] == ["c2"]
    assert fi.array_field(df, "body", "$.l").count() == 20
    assert fi.of_type(df, "body", "$.l[1].name", "2").count() == 20
    assert fi.sample_documents(df, ["ns"], "id", 3, seed=1).count() == 4


def test_schema_profile_and_document(spark, tmp_path):
    docs = [("1", '{"a":1,"o":{"x":"s"},"l":[1,2]}'), ("2", '{"a":"t","o":{"x":"s","y":true},"l":[]}'), ("3", '{"a":2}')]
    df = spark.createDataFrame(docs, "id string, body string")
    prof = sp.profile_schema(df)
    rows = {".".join(r["path"]): r for r in prof.collect()}
    assert set(rows) == {"a", "o", "o.x", "o.y", "l", "l.[]"}
    assert rows["a"]["probability"] == 1 and [(t["type"], round(t["percent"], 2)) for t in rows["a"]["types"]] == [("Long", 66.67), ("String", 33.33)]
    assert rows["o.x"]["has_duplicates"] and not rows["o.y"]["has_duplicates"]
    assert rows["l.[]"]["count"] == 2 and rows["l"]["count"] == 2
    schema = sp.to_json_schema(sp.dominant_type(prof), title="t")
    doc = json.loads(schema.collect()[0]["schema"])
    js = doc["validator"]["$jsonSchema"]
    assert js["title"] == "t" and js["required"] == ["a"] and doc["validationAction"] == "warn"
    assert js["properties"]["a"] == {"bsonType": "long"}
    assert js["properties"]["o"] == {"bsonType": "object", "properties": {"x": {"bsonType": "string"}, "y": {"bsonType": "bool"}}}
    assert js["properties"]["l"] == {"bsonType": "array", "items": {"bsonType": "long"}}
    sinks.write_schema(schema, str(tmp_path / "schema"))
    assert spark.read.text(str(tmp_path / "schema")).count() == 1


# --- commands ---------------------------------------------------------------


def test_normalise_commands(spark):
    rows = [
        (1, 'find { find: "c", filter: { a.b: { $ne: 1 }, at: Timestamp 1600000000000|4 }, sort: { a: -1 }, hint: { a: 1 }, limit: 5 }', None, 10, 3),
        (2, 'aggregate { aggregate: "c", pipeline: [ { $group: { _id: 1 } }, { $match: { k: { $nin: [ 1, 2 ] } } } ] }', None, 7, 0),
        (3, 'getMore { getMore: 5 }', '', 1, 1),
        (4, 'insert { insert: "c", id: BinData(0, AB) }', None, 0, 0),
        (5, 'findAndModify { findAndModify: "c", query: { q: 1 }, writeConcern: { w: 1 } }', None, None, None),
        (6, 'find { filter: { a: [ 1 } }', None, 1, 1),
        (7, None, None, 1, 1),
    ]
    df = spark.createDataFrame(rows, "id int, Command string, originatingCommand string, docsExamined bigint, nreturned bigint")
    good, bad = cm.normalise_commands(df)
    got = {r["id"]: r for r in good.collect()}
    assert set(got) == {1, 2, 4, 5} and [r["id"] for r in bad.collect()] == [6]
    assert (got[1]["filter"], got[1]["sort"], got[1]["hint"], got[1]["limit"], got[1]["hasNE"], got[1]["Ratio"]) == ("{a.b: {$ne: 1},at: 1}", "{a: 1}", "{a: 1}", 5, True, 3.0)
    assert (got[2]["filter"], got[2]["hasNIN"], got[2]["Ratio"], got[2]["writeConcern"]) == ("{k: {$nin: [ N ]}}", True, 7.0, None)
    assert got[4]["writeConcern"] == '{"w":"default"}' and got[4]["filter"] is None and got[4]["Ratio"] is None
    assert got[5]["writeConcern"] == '{"w":1}' and got[5]["filter"] == "{q: 1}"
    table = cm.update_by_key(df, good.select("id", "filter"))
    assert table.filter("filter is not null").count() == 3 and table.count() == 7


def test_normalise_updates_and_test_queries(spark):
    rows = [(1, '{ $set: { a.b: 1, c: "x" }, $setOnInsert: { n: 1 }, upsert: true }', "{ _id: { $ne: 3 } }"), (2, "{ broken", None)]
    good, bad = cm.normalise_updates(spark.createDataFrame(rows, "id int, Update string, Query string"))
    r = good.collect()[0]
    assert (r["upsert"], r["filter"], r["set"], r["soi"], r["hasNE"]) == (True, "{_id: {$ne: 1}}", "{a.b: 1,c: 1}", "{n: 1}", True)
    assert [x["id"] for x in bad.collect()] == [2]
    tests = spark.createDataFrame([(1, "d", "c", '{"a": 1}', "TRUE", None), (2, "d", "c", "oops", "FALSE", 4)], "id int, db string, collection string, query string, doCount string, limit int")
    got = {r["id"]: r for r in cm.normalise_test_queries(tests).collect()}
    assert (got[1]["ns"], got[1]["hasCount"], got[1]["limit"], got[1]["filter"]) == ("d.c", True, 0, "{a: 1}")
    assert (got[2]["hasCount"], got[2]["limit"], got[2]["filter"]) == (False, 4, None)


def test_extract_parameters(spark, tmp_path):
    ranked = spark.createDataFrame([("d.c", "{a: 1}", 1, 1), ("d.c", "{k: {$in: [ N ]}}", 2, 2), ("d.c", "{gone: 1}", 3, 3), ("d.c", "{x: 1}", None, 4)], "ns string, filter string, stage_rank int, prd_rank int")
    params = "array<struct<type:string,value:string>>"
    samples = spark.createDataFrame(
        [
            (1, "d.c", None, "{a: 1}", [("string", "it's"), ("date", "1704067200000"), ("int", "4")]),
            (2, "d.c", None, "{a: 1}", [("null", None), ("objectid", "5f"), ("bool", "true")]),
            (3, None, "d.c", "{k: {$in: [ 1 ]}}", [("string", "p")]),
        ],
        f"id int, object string, collection string, filter_shape string, filter_params {params}",
    )
    got, missing = cm.extract_parameters(ranked, samples, "2024-01-01 01:00:00")
    rows = {r["sample_id"]: r for r in got.collect()}
    assert rows[1]["params"] == ['"it\'s"', "4"] and rows[1]["shifts"] == ["PT1H"]
    assert rows[2]["params"] == ["null", "ObjectId('5f')", "true"]
    assert rows[3]["match"] == "fallback" and rows[3]["params"] == ["'p'"]
    assert [r["filter"] for r in missing.collect()] == ["{gone: 1}"]
    sinks.write_parameters(got, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).select("shape_id").distinct().count() == 2


# --- documents of any depth -------------------------------------------------


def test_documents_beyond_a_recursive_parser(spark):
    deep = '{"a":' * 20000 + "1" + "}" * 20000
    long_number = "1" * 5000
    rows = [(1, deep), (2, f'{{"n": {long_number}, "m": -{long_number}}}'), (3, '{"open": 1'), (4, None), (5, "[1.50, 2e3, -0.0]")]
    df = spark.createDataFrame(rows, "id int, body string")
    flat = {}
    for r in flatten_json(df, "body", ["id"], rejects=True).collect():
        flat.setdefault(r["id"], []).append((r["path"], r["type"], r["value"]))
    assert flat[1] == [(["a"] * 20000, "Integer64", "1")]
    assert flat[2] == [(["n"], "number", long_number), (["m"], "number", "-" + long_number)]
    assert flat[3] == [(None, "reject", '{"open": 1')] and flat[4] == [(None, "reject", None)]
    assert [v for _, _, v in flat[5]] == ["1.5", "2000.0", "0"]
    assert sorted(r["id"] for r in json_rejects(df, "body", ["id"]).collect()) == [3, 4]
    shapes = df.select("id", query_shape("body").alias("s")).filter("id < 4").collect()
    by_id = {r["id"]: r["s"] for r in shapes}
    assert by_id[1]["shape"].count("a: ") == 20000 and by_id[2]["params"][0]["type"] == "long" and by_id[3]["shape"] == '{"open": 1'


def test_events_of_a_document_follow_each_other():
    from plumeline.functions import pull

    text = ' {"a": [1, {}, "x"], "b": {"c": null}} '
    assert [k for k, _ in pull.events(text)] == ["object", "key", "array", "value", "object", "end", "value", "end", "key", "object", "key", "value", "end", "end"]
    rng = random.Random(3)
    marks = '{}[],:"0-1. exnull'
    for _ in range(3000):
        text = list(json.dumps([{"k": [1, -2.5e3, None, True, "q\\\"é"]}, {}, [], ""]))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(marks)
        text = "".join(text)
        try:
            want = json.loads(text, parse_float=pull.Real)
        except ValueError:
            with pytest.raises(ValueError):
                pull.build(pull.events(text))
        else:
            assert pull.build(pull.events(text)) == want


def test_damaged_wait_counters_have_no_sum(spark):
    deep = '{"x":' * 9000 + '{"timeReadingMicros": 5}' + "}" * 9000
    rows = [(1, '{"G":{"timeWaitingMicros":{"r":3}}}', None), (2, '{"timeWaitingMicros":{"r":', None), (3, deep, None), (4, "{}", "{}"), (5, '{"timeWaitingMicros":{"r":"much"}}', None),
            (6, '{"timeReadingMicros": 9223372036854775807, "b": {"timeReadingMicros": 1}}', None)]
    df = spark.createDataFrame(rows, "id int, locks string, storage string")
    got = {r["id"]: r["w"] for r in df.select("id", waits(F.col("locks"), F.col("storage")).alias("w")).collect()}
    assert got[1]["total_micros"] == 3 and got[1]["locks"] == ["locks.G.r.timeWaitingMicros"]
    assert got[3]["total_micros"] == 5 and [got[k] for k in (2, 4, 5, 6)] == [None] * 4


def test_repeated_keys_pair_up_and_add_up(spark, monkeypatch):
    from plumeline.operators import docdiff

    left = [("a", '{"x":1}')] * 3 + [("a", '{"x":2}'), ("b", '{"y":1}'), ("c", "no json"), (None, '{"z":1}')]
    right = [("a", '{"x":1}'), ("a", '{"x":3}'), ("b", '{"y":1}'), ("c", '{"q":1}'), ("d", '{"d":1}'), (None, '{"z":2}')]
    frames = [spark.createDataFrame(rows, "id string, body string") for rows in (left, right)]
    for hot in (100_000, 0):
        monkeypatch.setattr(docdiff, "HOT_DOCUMENTS", hot)
        rows = [tuple(r) for r in docdiff.diff_documents(*frames, pairs=True).select("id", "pair", F.array_join("path", ".").alias("p"), "change", "left_value", "right_value").collect()]
        a = [r for r in rows if r[0] == "a"]
        # Two copies of x=1 and x=2 are left, against x=3.
        assert sorted(r[4] for r in a) == ["1", "1", "2"] and sorted(r[3] for r in a) == ["only_left", "only_left", "value"] and {r[1] for r in a} == {1, 2, 3}
        assert ("c", 1, "", "only_left", "no json", None) in rows and ("d", 1, "d", "only_right", None, "1") in rows
        assert (None, 1, "z", "value", "1", "2") in rows and not [r for r in rows if r[0] == "b"]


def test_owners_of_typed_and_compound_keys(spark):
    from plumeline.operators import owners as ow

    values = [None, -(1 << 63), -5, -1, 0, 1, 7, 1 << 40, (1 << 63) - 1]
    texts = [None, "", "\0", "\0a", "a", "a\0", "a\0b", "aa", "b", "é", "漢"]
    for make, items, kind, key in ((ow.number_key, values, "long", lambda v: v), (ow.string_key, texts, "string", lambda v: v.encode())):
        df = spark.createDataFrame([(v,) for v in items], f"v {kind}").select("v", make(F.col("v")).alias("k"))
        got = [r["v"] for r in df.orderBy("k").collect()]
        assert got == [None] + sorted((v for v in items if v is not None), key=key)
    num, text = (lambda v: ow.number_key(F.lit(v).cast("long"))), (lambda v: ow.string_key(F.lit(v)))
    bounds = [(ow.min_key(), num(5), "low"), (num(5), ow.compound(num(5), ow.max_key()), "five"), (num(7), text("m"), "mixed"), (text("m"), ow.max_key(), "high")]
    ranges = None
    for low, high, owner in bounds:
        row = spark.range(1).select(F.lit("s").alias("space"), low.alias("low"), high.alias("high"), F.lit(owner).alias("owner"))
        ranges = row if ranges is None else ranges.unionByName(row)
    keys = {"n": ow.number_key(F.lit(None).cast("long")), "-": num(-9), "5": num(5), "5x": ow.compound(num(5), text("x")), "6": num(6), "7": num(7), "a": text("a"), "m": text("m"), "z": text("z"), "top": ow.max_key()}
    points = None
    for name, key in keys.items():
        row = spark.range(3).select(F.lit("s").alias("space"), F.lit(name).alias("name"), key.alias("key"))
        points = row if points is None else points.unionByName(row)
    points = points.unionByName(spark.range(1).select(F.lit("other").alias("space"), F.lit("o").alias("name"), num(5).alias("key")))
    got = ow.owners(points, ranges, ["space"], "key", "low", "high", "owner").groupBy("name", "owner").count().collect()
    assert {(r["name"], r["owner"], r["count"]) for r in got} == {
        ("n", "low", 3), ("-", "low", 3), ("5", "five", 3), ("5x", "five", 3), ("6", None, 3), ("7", "mixed", 3), ("a", "mixed", 3), ("m", "high", 3), ("z", "high", 3), ("top", "high", 3), ("o", None, 1)
    }


def test_stored_updates_touch_their_partitions_only(spark, tmp_path):
    from plumeline.operators.commands import update_by_key, update_stored

    path = str(tmp_path / "t")
    spark.createDataFrame([(i, "old", i % 4) for i in range(40)], "id int, v string, p int").repartition(1).write.partitionBy("p").parquet(path)
    before = {f.name for f in (tmp_path / "t" / "p=3").iterdir()}
    changes = spark.createDataFrame([(1, "first", 1), (1, "last", 2), (5, "x", 1), (99, "nobody", 1)], "id int, v string, n int")
    for _ in range(2):
        assert update_stored(spark, path, changes.drop("n"), "id", "p", None) == 1
    got = {r["id"]: r["v"] for r in spark.read.parquet(path).collect()}
    assert len(got) == 40 == spark.read.parquet(path).count() and got[1] == "last" and got[5] == "x" and got[9] == "old"
    assert {f.name for f in (tmp_path / "t" / "p=3").iterdir()} == before
    table = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    assert {tuple(r)[:2] for r in update_by_key(table, changes, "id", F.col("n")).collect()} == {(1, "last"), (2, "old")}
