"""Every operator run over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumeline.functions import shape as shapes
from plumeline.functions.flatten import dotted, flatten_json, json_rejects
from plumeline.functions.text import clean_function_name, literal_text, rename_dollar_keys, to_number, token_kind
from plumeline.functions.times import iso_duration, minus_millis, parse_date
from plumeline.operators import entries as en
from plumeline.operators import fields as fi
from plumeline.operators import frequency as fr
from plumeline.operators import indexes as ix
from plumeline.operators import lookups as lk
from plumeline.operators import metrics as me
from plumeline.operators import profile as pr
from plumeline.operators import owners as ow
from plumeline.operators import schema_profile as sp
from plumeline.operators import shape_report as sr
from plumeline.operators import timeseries as ts
from plumeline.operators.docdiff import diff_documents, diff_lines, key_difference
from plumeline.plans import tables as tb
from plumeline.plans.tables import read
from plumeline.session import staged

HOUR, DAY = 3600, 86400
# Items listed in a crosstab; the others are counted together.
KINDS = ["view", "signup", "purchase"]


def _money(column: str) -> F.col:
    return F.col(column).cast("decimal(18,2)")


# --- time series ------------------------------------------------------------


def ts_hourly_metrics(spark: SparkSession, sf: str) -> DataFrame:
    metrics = [
        ts.Metric("Cost", "value", "cost", "$sum", "cast(value as decimal(18,2))"),
        ts.Metric("Slowest", "value", "slowest", "$max", "value"),
        ts.Metric("Fastest", "value", "fastest", "$min", "value"),
    ]
    out = ts.time_metrics(read(spark, sf, "events"), HOUR, metrics)
    return out.withColumn("cost", F.col("cost").cast("double"))


def ts_minute_metrics(spark: SparkSession, sf: str) -> DataFrame:
    metrics = [
        ts.Metric.parse("First|id|first_id|$first|event_id"),
        ts.Metric.parse("Last|id|last_id|$last|event_id"),
        ts.Metric.parse("Kinds|n|kinds|$addToSet|event_type"),
    ]
    out = ts.time_metrics(read(spark, sf, "events"), 60, metrics, fill=False, tie_break=["event_id"])
    return out.withColumn("kinds", F.array_join("kinds", ","))


def ts_second_totals(spark: SparkSession, sf: str) -> DataFrame:
    return ts.time_metrics(read(spark, sf, "events"), 1, predicate="event_type = 'error'", fill=False)


def ts_minute_filled(spark: SparkSession, sf: str) -> DataFrame:
    return ts.time_metrics(read(spark, sf, "events"), 60)


def crosstab_day_type(spark: SparkSession, sf: str) -> DataFrame:
    return ts.crosstab(read(spark, sf, "events"), "event_type", DAY)


def crosstab_other(spark: SparkSession, sf: str) -> DataFrame:
    item = "case when value > 10 then event_type end"
    return ts.crosstab_long(read(spark, sf, "events"), item, HOUR)


def crosstab_minute_filled(spark: SparkSession, sf: str) -> DataFrame:
    return ts.crosstab(read(spark, sf, "events"), "event_type", 60, items=KINDS)


# --- slow-query reports -----------------------------------------------------


def _flat(ranked: DataFrame) -> DataFrame:
    sets = {c: F.array_join(c, "|") for c in ("filters", "operations", "sorts", "plans")}
    out = ranked.withColumns({**sets, "ratio": F.round("ratio", 6)})
    if "sample" in ranked.columns:
        out = out.withColumns(
            {"sample_line": F.col("sample.lineno"), "sample_filter": F.col("sample.filter")}
        ).drop("sample")
    return out


def shape_overall_cost(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(sr.shape_report(tb.event_ops(spark, sf)))


def shape_collscan(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(sr.shape_report(tb.event_ops(spark, sf), "collscan"))


def shape_long_running(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(sr.shape_report(tb.event_ops(spark, sf), "long"))


def shape_has_field(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(sr.shape_report(tb.event_ops(spark, sf), "sort"))


def shape_multi_tenant(spark: SparkSession, sf: str) -> DataFrame:
    ops = tb.line_ops(spark, sf).withColumn("object", F.col("plan_summary"))
    return _flat(sr.shape_report(ops, multi_tenant=True, all_queries=True, sample=False))


def shape_all_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(sr.shape_report(tb.event_ops(spark, sf), all_queries=True, top=None, sample=False))


def router_overall(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(sr.router_report(tb.line_ops(spark, sf), sample=False))


def router_multi_shard(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(sr.router_report(tb.line_ops(spark, sf), "multi_shard_gt1", sample=False))


def report_union(spark: SparkSession, sf: str) -> DataFrame:
    ops = tb.event_ops(spark, sf)
    found = sr.shape_sections(ops, sample=False)
    return sr.union_sections([sr.report_cells(ranked, name) for name, ranked in found.items()]).drop("ratio")


def date_range_strict(spark: SparkSession, sf: str) -> DataFrame:
    start = parse_date(F.lit("2024-01-05")).cast("timestamp_ntz")
    end = parse_date(F.lit("2024-01-10T12:00:00")).cast("timestamp_ntz")
    return read(spark, sf, "events").filter(sr.selection(start=start, end=end)).select("event_id", "ts", "event_type")


def file_in(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").withColumns({"infile": F.col("source"), "ts": F.lit(None).cast("timestamp")})
    return docs.filter(sr.selection(files=["src1", "src2", "src3"])).groupBy("source").agg(
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars")
    )


def range_stop_per_group(spark: SparkSession, sf: str) -> DataFrame:
    # Order by value within a user, so that later rows may lie in range again.
    end = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    rows = read(spark, sf, "events").select("user_id", "event_id", "ts", F.struct("value", "event_id").alias("at"))
    return en.stop_after_end(rows, ["user_id"], "at", "ts", end).select("user_id", "event_id", "ts")


def ratio_modes(spark: SparkSession, sf: str) -> DataFrame:
    from plumeline.operators.commands import ratio

    line = read(spark, sf, "lineitem")
    docs = F.floor("l_extendedprice").cast("bigint")
    returned = F.floor(F.col("l_quantity") - 5).cast("bigint")
    return line.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        ratio(docs, returned).alias("ratio_double"),
        ratio(docs, returned, mode="integer").alias("ratio_integer"),
    )


def start_ts(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events")
    millis = F.floor(F.col("value") * 100).cast("bigint")
    return events.select("event_id", minus_millis(F.col("ts"), millis).alias("start_ts"))


def wait_sum(spark: SparkSession, sf: str) -> DataFrame:
    from plumeline.functions.jsonpath import waits

    line = read(spark, sf, "lineitem")
    quantity = F.floor("l_quantity").cast("bigint").cast("string")
    locks = F.concat(
        F.lit('{"Global":{"acquireCount":{"r":1},"timeWaitingMicros":{"'), F.col("l_returnflag"), F.lit('":'), quantity, F.lit("}}}")
    )
    storage = F.concat(
        F.lit('{"data":{"bytesRead":7,"timeReadingMicros":'), F.col("l_linenumber").cast("string"),
        F.lit('},"timeWritingMicros":'), quantity, F.lit("}"),
    )
    out = line.select("l_orderkey", "l_linenumber", "l_partkey", waits(locks, storage).alias("w"))
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("w.total_micros").alias("total_micros"), F.array_join("w.locks", "|").alias("locks"),
    )


def topn_user_value(spark: SparkSession, sf: str) -> DataFrame:
    # Orders as operations of their customers: the 50 most expensive customers and priorities.
    ops = read(spark, sf, "orders").select(
        F.col("o_orderdate").alias("ts"), F.lit("orders").alias("infile"), F.col("o_orderkey").alias("lineno"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("col_name"), F.col("o_orderpriority").alias("shape"),
        F.floor("o_totalprice").cast("bigint").alias("tms"), F.lit(1.0).alias("ratio"), F.lit(1).cast("bigint").alias("docs_examined"),
        F.lit(1).cast("bigint").alias("nreturned"), F.col("o_orderpriority").alias("filter_shape"), F.col("o_orderstatus").alias("command"),
        F.lit(None).cast("string").alias("sort"), F.lit(None).cast("string").alias("plan_summary"),
    )
    out = sr.rank_shapes(ops, top=50, limit=False, sample=False)
    return out.select("col", "shape", "cnt", "cost", "max_time", F.array_join("operations", "|").alias("operations"))


# --- indexes ----------------------------------------------------------------


def index_sizes_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ix.index_sizes(tb.snapshots(spark, sf))


def index_usage(spark: SparkSession, sf: str) -> DataFrame:
    out = ix.index_usage(tb.snapshots(spark, sf))
    return out.withColumns(
        {"ops": F.round(F.col("ops") * 1e6, 6), "index_versions": F.array_join("index_versions", ",")}
    )


def index_merge_lookup(spark: SparkSession, sf: str) -> DataFrame:
    out = ix.merged_index_table(tb.snapshots(spark, sf))
    return out.select("server", "name", "index", "size", "db", "collection", "unused", "is_id", "days", "n_shards")


def _shard_map(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    return part.groupBy(F.col("p_brand").alias("db"), tb.part_collection().alias("collection")).agg(
        F.concat(F.lit('{"'), F.split_part(F.min("p_name"), F.lit(" "), F.lit(1)), F.lit('":1}')).alias("shard_key")
    )


def index_report_indexes(spark: SparkSession, sf: str) -> DataFrame:
    snaps = tb.snapshots(spark, sf)
    out = ix.index_report(snaps, _shard_map(spark, sf), ix.host_shards(snaps)).indexes
    return out.withColumns({"total_ops": F.round(F.col("total_ops") * 1e6, 6), "key_size": F.round("key_size", 6)})


def index_report_per_shard(spark: SparkSession, sf: str) -> DataFrame:
    snaps = tb.snapshots(spark, sf)
    out = ix.index_report(snaps, None, ix.host_shards(snaps)).per_shard
    return out.select("server", "db", "collection", "index_name", "shard", F.round(F.col("shard_ops") * 1e6, 6).alias("shard_ops"))


def db_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ix.index_report(tb.snapshots(spark, sf)).databases


def collection_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ix.index_report(tb.snapshots(spark, sf)).collections


def host_shard_map(spark: SparkSession, sf: str) -> DataFrame:
    return ix.host_shards(tb.snapshots(spark, sf))


def shard_key_lookup(spark: SparkSession, sf: str) -> DataFrame:
    nation = read(spark, sf, "nation").select(
        F.col("n_name").alias("collection"), F.col("n_regionkey").cast("string").alias("db")
    )
    region = read(spark, sf, "region").select(
        F.col("r_regionkey").cast("string").alias("db"), F.when(F.col("r_name").startswith("A"), F.col("r_name")).alias("shard_key")
    )
    keys = region.join(nation, "db").select("db", "collection", "shard_key")
    return ix.with_shard_key(nation, keys)


def span_hours(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").withColumn("server", F.col("event_type"))
    return ix.oplog_headroom(events)


def nested_export(spark: SparkSession, sf: str) -> DataFrame:
    return ix.nested_paths(
        tb.snapshots(spark, sf).withColumn("indexStats", F.array_sort("indexStats")),
        {"server": "_id.Server", "db": "_id.DB", "coll": "_id.Collection", "first_index": "indexStats.0.name",
         "first_ops": "indexStats.0.accesses.ops"},
    )


# --- joins ------------------------------------------------------------------


def _bands(spark: SparkSession, sf: str) -> DataFrame:
    """Price bands of four widths over all orders."""
    price = F.floor("o_totalprice").cast("bigint")
    widths = F.array(*[F.lit(w).cast("bigint") for w in (500, 3000, 70_000, 1_000_000)])
    bands = read(spark, sf, "orders").select(F.explode(widths).alias("w"), price.alias("p")).select(
        (F.col("p") - F.col("p") % F.col("w")).alias("lo"), "w"
    )
    return bands.distinct().select("lo", (F.col("lo") + F.col("w")).alias("hi"))


def range_join_chunk(spark: SparkSession, sf: str) -> DataFrame:
    points = read(spark, sf, "orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("k"))
    out = lk.range_join(points, _bands(spark, sf), F.col("k"), F.col("lo"), F.col("hi"), F.col("k"), F.col("lo"), F.col("hi"))
    return out.select("o_orderkey", "k", "lo", "hi")


def range_join_composite(spark: SparkSession, sf: str) -> DataFrame:
    # Chunks of a compound key (customer, order) within a priority: each ends where the next one starts.
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("ns"))
    cuts = orders.groupBy("ns", "o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).select("ns", F.struct("o_custkey", "o_orderkey").alias("lo"))
    follows = F.lead("lo").over(Window.partitionBy("ns", F.floor(F.col("lo.o_custkey") / 50)).orderBy("lo"))
    end = F.struct(((F.floor(F.col("lo.o_custkey") / 50) + 1) * 50).cast("bigint").alias("o_custkey"), F.lit(0).cast("bigint").alias("o_orderkey"))
    chunks = cuts.withColumn("hi", F.coalesce(follows, end)).withColumnRenamed("ns", "range_ns")
    points = orders.select("o_orderkey", "ns", F.struct("o_custkey", "o_orderkey").alias("k"))
    out = lk.range_join(
        points, chunks, F.col("k"), F.col("lo"), F.col("hi"), F.col("k.o_custkey"), F.col("lo.o_custkey"), F.col("hi.o_custkey"), {"ns": "range_ns"}
    )
    return out.select("o_orderkey", "ns", F.col("lo.o_custkey").alias("lo_cust"), F.col("lo.o_orderkey").alias("lo_order"))


def chunk_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Line items in chunks of a compound key that begin at every order: half of them end with their customer, half go on."""
    orders = read(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("ns"), "o_custkey", "o_orderkey")
    cust = ow.number_key(F.col("o_custkey"))
    ends = F.when(F.col("o_orderkey") % 2 == 1, ow.compound(cust, ow.max_key()))
    ranges = orders.select("ns", ow.compound(cust, ow.number_key(F.col("o_orderkey"))).alias("low"), ends.alias("high"), F.col("o_orderkey").alias("owner"))
    first = orders.select("ns").distinct().select("ns", ow.min_key().alias("low"), ow.max_key().alias("high"), F.lit(-1).cast("bigint").alias("owner"))
    line = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_linenumber") % 5 + 1).alias("ns"),
        ow.compound(ow.number_key(F.col("l_suppkey")), ow.number_key(F.col("l_orderkey"))).alias("key"),
    )
    return ow.owners(line, ranges.unionByName(first), ["ns"], "key", "low", "high", "owner").drop("key")


def semi_has_data(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return lk.rows_with_match(read(spark, sf, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


def anti_no_data(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "lang")
    return lk.rows_without_match(docs, read(spark, sf, "labels"), ["doc_id"])


def param_join_fallback(spark: SparkSession, sf: str) -> DataFrame:
    # Ranked: brands and sizes; samples: parts by even size, so odd sizes are found by brand only.
    part = read(spark, sf, "part")
    ranked = part.groupBy("p_brand", F.col("p_size").alias("size")).agg(F.count("*").alias("parts"))
    even = (F.col("p_size") - F.col("p_size") % 2).alias("psize")
    samples = part.groupBy(F.col("p_brand").alias("brand"), even).agg(F.min("p_partkey").alias("sample"), F.count("*").alias("n"))
    out = lk.join_with_fallback(
        ranked, samples, [("p_brand", "brand"), ("size", "psize")], [(F.col("p_brand"), "brand"), (F.lit(2), "psize")]
    )
    return out.select("p_brand", "size", "parts", "sample", "n", "match")


def dictionary_lookup(spark: SparkSession, sf: str) -> DataFrame:
    nation = read(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return lk.with_dictionary(read(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), nation, "s_nationkey")


# --- running values ---------------------------------------------------------


def _by_day() -> F.col:
    return F.to_date("ts")


def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    value = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return en.carry_forward(rows, ["user_id"], ["ts"], value, "last_signup", _by_day())


def restart_sessions(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return en.restart_headers(
        rows, ["user_id"], ["ts"], F.col("event_type") == "signup", _by_day(),
        {
            "last_error": F.when(F.col("event_type") == "error", F.col("event_id")),
            "last_click": F.when(F.col("event_type") == "click", F.col("event_id")),
        },
    )


def stitch_by_start(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations")
    chunk = F.floor(F.col("turn") / 4)
    return en.stitch_by_start(rows, ["conv_id"], "turn", "text", F.col("role") == "user", chunk)


def stitch_by_end(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations")
    chunk = F.floor(F.col("turn") / 4)
    return en.stitch_by_end(rows, ["conv_id"], "turn", "text", F.col("role") == "assistant", chunk)


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("user_id", "ts", F.floor(F.col("value") * 100).cast("bigint").alias("value"))


def increments(spark: SparkSession, sf: str) -> DataFrame:
    return me.increments_across(_series(spark, sf), ["user_id"], ["ts"], _by_day())


def increments_per_chunk(spark: SparkSession, sf: str) -> DataFrame:
    rows = _series(spark, sf).withColumn("day", _by_day())
    return me.increments(rows, ["user_id", "day"], ["ts"]).select("user_id", "ts", "inc")


def max_increment(spark: SparkSession, sf: str) -> DataFrame:
    return me.max_increment(increments(spark, sf), ["user_id"])


def record_highs(spark: SparkSession, sf: str) -> DataFrame:
    return me.record_highs(increments(spark, sf), ["user_id"], ["ts"], _by_day()).select("user_id", "ts", "inc")


def delta_decode(spark: SparkSession, sf: str) -> DataFrame:
    # Deltas of the series with its first value in front: decoding gives it back.
    deltas = increments(spark, sf).withColumnRenamed("value", "original")
    starts = deltas.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.min_by("original", "ts").alias("base"))
    joined = deltas.join(starts, "user_id").withColumn(
        "delta", F.when(F.col("ts") == F.col("first_ts"), F.col("base")).otherwise(F.col("inc"))
    )
    return me.delta_decode(joined, ["user_id"], ["ts"], _by_day()).select("user_id", "ts", "value")


# --- documents --------------------------------------------------------------


def first_n_per_group(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source")
    return fi.first_n_per_group(docs, ["lang"], [F.col("doc_id")], 5, "doc_id")


def field_name_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = tb.order_documents(spark, sf, altered=True).select("id", "body", F.lit("orders").alias("ns"))
    return fi.find_fields(docs, "(pri|rush|stat)", n=None)


def schema_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = sp.profile_schema(tb.order_documents(spark, sf, altered=True))
    return out.select(
        dotted(F.col("path")).alias("path"), "level", "count", F.round("probability", 9).alias("probability"),
        F.array_join(F.transform("types", lambda t: F.concat(t.type, F.lit(":"), F.round(t.percent, 4).cast("decimal(18,4)").cast("string"))), ",").alias("types"),
        "has_duplicates",
    )


def schema_document(spark: SparkSession, sf: str) -> DataFrame:
    profile = sp.dominant_type(sp.profile_schema(tb.order_documents(spark, sf, altered=True)))
    return sp.to_json_schema(profile, title="orders", description="all orders")


def doc_diff(spark: SparkSession, sf: str) -> DataFrame:
    diff = diff_documents(tb.order_documents(spark, sf, False), tb.order_documents(spark, sf, True))
    return diff.withColumn("path", dotted(F.col("path")))


def doc_diff_lines(spark: SparkSession, sf: str) -> DataFrame:
    diff = diff_documents(tb.order_documents(spark, sf, False), tb.order_documents(spark, sf, True))
    return diff_lines(diff).select("id", "line_no", "line")


def doc_diff_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of customers, many with one key: some are missing, some differ, most are equal."""
    orders = read(spark, sf, "orders")

    def side(status, keep: str) -> DataFrame:
        body = F.concat(F.lit('{"p":"'), F.col("o_orderpriority"), F.lit('","s":"'), status, F.lit('"}'))
        return orders.filter(keep).select(F.col("o_custkey").alias("id"), body.alias("body"))

    left = side(F.col("o_orderstatus"), "o_orderkey % 11 <> 3")
    right = side(F.when(F.col("o_orderkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")), "o_orderkey % 13 <> 4")
    out = diff_documents(left, right, pairs=True)
    return out.select("id", "pair", dotted(F.col("path")).alias("path"), "change", "left_value", "right_value")


def key_difference_sides(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return key_difference(read(spark, sf, "labels"), vectors, ["doc_id"])


def array_key_count(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("events")
    )
    out = fi.count_array_keys(events, F.transform("events", lambda e: e.role))
    return out.withColumn("key", F.array_join("key", ","))


def flatten_paths(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").select("event_id", "props")
    return flatten_json(events, "props", ["event_id"]).withColumn("path", dotted(F.col("path")))


def flatten_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of up to thousands of levels, and numbers of thousands of digits."""
    k = tb.prop_k().cast("string")
    depth = F.when(F.col("event_id") % 500 == 0, F.lit(4000)).otherwise(F.col("event_id") % 7 + 1).cast("int")
    value = F.when(F.col("event_id") % 500 == 1, F.repeat(F.lit("9"), 5000)).otherwise(k)
    body = F.concat(F.repeat(F.lit('{"a":'), depth), value, F.repeat(F.lit("}"), depth))
    flat = flatten_json(read(spark, sf, "events").select("event_id", body.alias("body")), "body", ["event_id"])
    return flat.select("event_id", F.size("path").alias("depth"), "type", "value")


def json_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """What is no JSON: documents that stop early or go on behind their end, and missing ones."""
    kind = F.col("event_id") % 8
    body = F.when(kind == 1, F.expr("left(props, length(props) - 1)")).when(kind == 2, F.concat("props", F.lit("x"))).when(kind != 3, F.col("props"))
    rejects = json_rejects(read(spark, sf, "events").select("event_id", body.alias("body")), "body", ["event_id"])
    return rejects.filter("error IS NOT NULL").select("event_id", "raw")


# --- text -------------------------------------------------------------------


def token_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return fr.token_frequency(read(spark, sf, "conversations"), F.col("text"))


def token_counts_all(spark: SparkSession, sf: str) -> DataFrame:
    return fr.token_frequency(read(spark, sf, "documents"), F.col("text"))


def command_counts(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").withColumn("command", F.when(F.col("value") > 5, F.concat("event_type", F.lit(".x"))))
    return fr.command_frequency(events)


def driver_counts(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
    return fr.driver_counts(pages, host, lang)


def event_time_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return fr.event_time_by_key(read(spark, sf, "events"), F.col("event_type"), F.floor(F.col("value") * 100).cast("bigint"))


def key_value_config(spark: SparkSession, sf: str) -> DataFrame:
    from plumeline.functions.jsonpath import key_values

    pages = read(spark, sf, "pages")
    config = key_values(F.regexp_extract("url", r"\?([^#]*)", 1), r"(\w+)=([^&]*)")
    return pages.select("page_id", F.explode(config).alias("name", "value"))


def name_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    part = tb.spread(read(spark, sf, "part"), "p_partkey")
    raw = F.concat(
        F.lit("(anonymous namespace)::{lambda}::"), F.col("p_name"), F.lit("<std::map<"), F.col("p_type"),
        F.lit(", int> >::run("), F.col("p_brand"), F.lit(" const&, (x)) const [clone .1]"),
    )
    return part.select("p_partkey", clean_function_name(raw).alias("name"))


def dollar_keys(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit('{"$match":{"k":{"$gt":'), tb.prop_k().cast("string"), F.lit("}}}"))
    return read(spark, sf, "events").select("event_id", rename_dollar_keys(body).alias("body"))


def token_coercion(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k")).when(
        F.col("event_type") == "click", F.col("value").cast("decimal(10,2)").cast("string")
    ).otherwise(F.col("event_type"))
    return read(spark, sf, "events").select("event_id", token_kind(text).alias("kind"), to_number(text).alias("number"))


def replay_offset(spark: SparkSession, sf: str) -> DataFrame:
    run = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return read(spark, sf, "events").select("event_id", iso_duration(F.date_trunc("second", "ts").cast("timestamp_ntz"), run).alias("shift"))


def param_literals(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "int").when(F.col("event_type") == "click", "objectid").when(
        F.col("event_type") == "error", "null").otherwise("string")
    return read(spark, sf, "events").select("event_id", literal_text(kind, F.get_json_object("props", "$.k")).alias("literal"))


def query_shape(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    body = (
        F.when(F.col("event_type") == "view", F.col("props"))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"k":{"$in":['), k, F.lit(','), k, F.lit(']}}')))
        .when(F.col("event_type") == "error", F.concat(F.lit('{"$or":[{"k":'), k, F.lit('},{"u":{"$ne":"x"}}]}')))
        .otherwise(F.concat(F.lit('{"k":{"$gte":'), k, F.lit('},"at":{"$date":"2024-01-01T00:00:00Z"}}')))
    )
    out = events.select(shapes.query_shape(body).alias("s"), shapes.has_operator(body, "$ne").alias("has_ne"))
    return out.groupBy(F.col("s.shape").alias("shape"), "has_ne").agg(
        F.count("*").alias("cnt"), F.sum(F.size("s.params")).alias("n_params"),
        F.sum(F.element_at("s.params", 1)["value"].try_cast("bigint")).alias("first_sum"),
    )


def sort_shape(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"a":1,"b":{"$in":['), k, F.lit(',2,3]},"c":{"$x":{"y":1}},"d":{"$meta":"'), F.col("event_type"), F.lit('"}}'))
    return events.select(shapes.shallow_shape(body).alias("shape")).groupBy("shape").agg(F.count("*").alias("cnt"))


# --- profiles ---------------------------------------------------------------


def _tree_text(df: DataFrame) -> DataFrame:
    return df.withColumn("node", F.array_join("node", "/"))


def tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_text(pr.tree_rollup(tb.stacks(spark, sf))).drop("hot")


def tree_share(spark: SparkSession, sf: str) -> DataFrame:
    out = pr.with_share(pr.tree_rollup(tb.stacks(spark, sf)))
    return _tree_text(out).select("ts", "node", F.round("share", 9).alias("share"))


def tree_prune(spark: SparkSession, sf: str) -> DataFrame:
    tree = staged(pr.tree_rollup(tb.stacks(spark, sf), reverse=True), "tree")
    return _tree_text(pr.prune(pr.with_share(tree), 0.08)).select("ts", "node", "weight")


def tree_order(spark: SparkSession, sf: str) -> DataFrame:
    return _tree_text(pr.tree_order(pr.node_totals(pr.tree_rollup(tb.stacks(spark, sf)))))
