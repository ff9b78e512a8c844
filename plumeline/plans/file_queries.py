"""The given tables written as log files and metric archives into the shared folder, and read back by the file sources.

Files are cut into ranges much smaller than they are, so entries, lines and documents cross the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumeline.operators import metrics as mt
from plumeline.plans.ingest import IngestOptions, Ingested, ingest_logs
from plumeline.plans.log_tables import _event_values, _order_values, _stamp, fill
from plumeline.plans.tables import prop_k, read
from plumeline.session import scratch_path
from plumeline.sinks.archive import archive_chunks, write_archive
from plumeline.sources.ftdc import decode_ftdc, decode_series, read_metrics
from plumeline.sources.lines import number_lines, read_lines, short_name, stitch_files
from plumeline.sources.stacks import read_stacks

#: Entries of a log file, bytes of a range, samples of a chunk (at most).
FILE_ENTRIES, RANGE_BYTES, ARCHIVE_RANGE_BYTES = 20_000, 64 << 10, 32 << 10

_FILE = r"file=(\d+)"


def _write_lines(rows: DataFrame, number: str, entry: Column, path: str, **options: str) -> None:
    """Entries as text files of ``FILE_ENTRIES``, in order of their number; an entry may have several lines."""
    placed = rows.select(F.col(number).alias("number"), F.floor(F.col(number) / FILE_ENTRIES).alias("file"), entry.alias("value"))
    # A file is one task's, so its entries stay in order.
    dealt = placed.repartition("file").sortWithinPartitions("file", "number")
    dealt.select("file", "value").write.partitionBy("file").options(**options).text(path)


def _bare_gzip(spark: SparkSession, path: str) -> None:
    """Take the suffix from the gzip files below ``path``; their content alone says what they are."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(hadoop.Path(f"{path}/file=*/part-*.gz")):
        name = status.getPath().toString()
        fs.rename(hadoop.Path(name), hadoop.Path(name.removesuffix(".gz")))


# Logs ---------------------------------------------------------------------------------------------------------------

_INGESTED = {
    0: '{"t":{"$date":"<at>+00:00"},"s":"I","c":"COMMAND","id":51803,"ctx":"conn<u>","msg":"Slow query","attr":{"type":"command","ns":"shop.u<u>",'
    '"command":{"find":"u<u>","filter":{"k":<k>,"u":{"$in":[<u>,<k>]}}},"docsExamined":<d>,"nreturned":<k>,"durationMillis":<ms>}}',
    # Lines that begin nothing belong to the entry before.
    1: '<at>-0000 I COMMAND  [conn<u>] command shop.c<u> command: find { find: "c<u>",\n  filter: { a: <k>,\n  b: { $gt: <d> } } } '
    "planSummary: COLLSCAN keysExamined:0 docsExamined:<d> numYields:0 nreturned:<k> reslen:10 protocol:op_msg <ms>ms",
    2: '{"t":{"$date":"<at>+00:00"},"s":"I","c":"CONTROL","ctx":"main","msg":"Process Details","attr":{"pid":<n>,"host":"h<u>"}}',
    3: '{ "atype" : "login<h>", "ts" : { "$date" : "<at>Z" }, "param" : { "user" : "u<u>" } }',
    4: '{"t":"<at>+0000","s":"WARN","svc":"MONGOT","n":"idx<h>","msg":"plain <k>","attr":{"u":<u>}}',
    5: '{"t":{"$date":"<at>+00:00"},"s":"I","c":"COMMAND","id":51803,"ctx":"conn<u>","msg":"Slow qu',
    6: "<at>-0000 I WRITE    [conn<u>] update shop.c<u> command: { q: { _id: <k> }, u: { $set: { b: 1 } } } planSummary: IDHACK keysExamined:1 docsExamined:1 nMatched:1 numYields:0 locks:{} <ms>ms",
    7: "<at>-0000 I NETWORK  [listener] connection accepted from 10.0.0.<h>:4000 #<n> (3 connections now open)",
}


def _ingested(spark: SparkSession, sf: str) -> Ingested:
    """Events as log files of five formats, through the whole ingest job."""
    rows = read(spark, sf, "events")
    entry = None
    for kind, template in _INGESTED.items():
        text = fill(template, **_event_values())
        entry = F.when(F.col("event_id") % len(_INGESTED) == kind, text) if entry is None else entry.when(F.col("event_id") % len(_INGESTED) == kind, text)
    path = scratch_path(spark, "rendered_logs")
    _write_lines(rows, "event_id", entry, path, compression="gzip")
    _bare_gzip(spark, path)
    plain = scratch_path(spark, "rendered_logs")
    _write_lines(rows, "event_id", entry, plain)
    return ingest_logs(spark, [f"{path}/file=*", f"{plain}/file=*"], IngestOptions(name_pattern=_FILE, split_bytes=RANGE_BYTES))


def ingest_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every file occurs twice, plain and as gzip data without suffix: each event must be found twice at one place."""
    events = _ingested(spark, sf).events
    place = ["file", "lineno", "type", "ts", "host", "command", "object", "filter_shape", "docs_examined", "duration_millis", "module", "ip_addr", "log_date"]
    rows = events.withColumns({"file": F.col("short_name").cast("bigint"), "ts": _stamp("ts"), "log_date": F.col("log_date").cast("string")})
    return rows.groupBy(*place).agg(F.count("*").alias("copies"))


def ingest_headers(spark: SparkSession, sf: str) -> DataFrame:
    headers = _ingested(spark, sf).headers.withColumn("file", short_name(F.col("infile"), _FILE).cast("bigint"))
    return headers.groupBy("file", "restart_id", "lineno", "host", _stamp("ts").alias("ts")).agg(F.count("*").alias("copies"))


def ingest_rejects(spark: SparkSession, sf: str) -> DataFrame:
    rejects = _ingested(spark, sf).rejects.withColumn("file", short_name(F.col("infile"), _FILE).cast("bigint"))
    return rejects.groupBy("file", "lineno", "error", F.length("raw").alias("raw_length")).agg(F.count("*").alias("copies"))


def _orders_with_ends(spark: SparkSession, sf: str) -> str:
    """Orders as entries of one to four lines, of which only the last ends with a duration."""
    values = _order_values()
    body = fill("<at>-0000 I COMMAND  [conn<c>] command shop.c<c> planSummary: COLLSCAN", **values)
    more = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("o_custkey") % 4).cast("int")), lambda i: F.concat(F.lit("\n  part "), i.cast("string"))), "")
    entry = F.concat(body, F.when(F.col("o_custkey") % 4 == 0, F.lit("")).otherwise(more), fill(" docsExamined:1 <v>ms", **values))
    path = scratch_path(spark, "rendered_ends")
    _write_lines(read(spark, sf, "orders"), "o_orderkey", entry, path)
    return path


def stitched_by_end(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_lines(spark, [f"{_orders_with_ends(spark, sf)}/file=*"], split_bytes=RANGE_BYTES)
    entries = stitch_files(lines, end_pattern=r" [0-9]+ms$").entries
    return entries.select(short_name(F.col("infile"), _FILE).cast("bigint").alias("file"), "lineno", "n_lines", "format", F.md5("entry").alias("entry"))


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = number_lines(read_lines(spark, [f"{_orders_with_ends(spark, sf)}/file=*"], split_bytes=RANGE_BYTES))
    return lines.select(short_name(F.col("infile"), _FILE).cast("bigint").alias("file"), "lineno", F.md5("value").alias("value"))


# Archives -----------------------------------------------------------------------------------------------------------


def _archives(spark: SparkSession, sf: str) -> str:
    """Events as metric archives: a file for each day, a chunk for each hour, the counts of a day in front."""
    rows = read(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    day = F.date_format("at", "yyyy-MM-dd")
    cents = F.floor(F.col("value") * 100).cast("bigint")
    samples = rows.select(
        day.alias("file"), F.hour("at").alias("chunk"), F.col("at").alias("ts"), F.array(F.col("event_id"), F.col("user_id"), cents, prop_k()).alias("values")
    )
    counts = rows.groupBy(day.alias("file")).agg(F.min("at").alias("at"), F.map_from_arrays(F.array(F.lit("events")), F.array(F.count("*").cast("string"))).alias("entries"))
    path = scratch_path(spark, "archives")
    write_archive(archive_chunks(samples, ["event.id", "event.user", "cents", "event.k"]), path, counts)
    return path


def _archived(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return decode_ftdc(spark, [_archives(spark, sf)], ARCHIVE_RANGE_BYTES)


def archive_samples(spark: SparkSession, sf: str) -> DataFrame:
    samples = _archived(spark, sf)[0]
    return samples.select(
        short_name(F.col("file")).alias("file"), "chunk_no", "sample_no", F.array_join("path", ".").alias("path"), _stamp("ts").alias("ts"), "value"
    )


def archive_metadata(spark: SparkSession, sf: str) -> DataFrame:
    _, metadata, rejects = _archived(spark, sf)
    found = metadata.select(short_name(F.col("file")).alias("file"), "chunk_no", F.get_json_object("doc", "$.events").cast("bigint").alias("events"))
    # No document may be refused.
    return found.unionByName(rejects.select(short_name(F.col("file")).alias("file"), "chunk_no"), allowMissingColumns=True)


def archive_metric_keys(spark: SparkSession, sf: str) -> DataFrame:
    return mt.metric_keys(_archived(spark, sf)[0]).select(F.array_join("path", ".").alias("path"))


def archive_first_samples(spark: SparkSession, sf: str) -> DataFrame:
    first = mt.first_of_chunk(_archived(spark, sf)[0])
    return first.select(short_name(F.col("file")).alias("file"), "chunk_no", F.array_join("path", ".").alias("path"), "value")


def archive_increments(spark: SparkSession, sf: str) -> DataFrame:
    """The largest step of every metric inside a chunk of a file, from the decoded series."""
    series = decode_series(spark, [_archives(spark, sf)], ARCHIVE_RANGE_BYTES)[0]
    best = mt.largest_steps(series, ["file", "path"])
    return best.select(short_name(F.col("file")).alias("file"), F.array_join("path", ".").alias("path"), "max_inc", _stamp("max_ts").alias("max_ts"))


# Profiles and status files --------------------------------------------------------------------------------------------


def stack_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Events as stack files: directives at the begin of a file, and one sample in a thousand in another format, from the dictionary."""
    n = F.col("event_id")
    plain = fill("<n>;<k>;main;<kind>(int);u<u>", **_event_values(), kind=F.col("event_type"))
    named = fill("#format timestamp;time;stack-id\n<n>;<k>;7", **_event_values())
    head = F.lit("#format timestamp;count;stack\n")
    entry = F.when(n % 1000 == 500, named).when(n % FILE_ENTRIES == 0, F.concat(head, F.lit("#stack 7 main;dict;seven\n"), plain))
    entry = entry.when(n % 1000 == 501, F.concat(head, plain)).otherwise(plain)
    path = scratch_path(spark, "rendered_stacks")
    _write_lines(read(spark, sf, "events"), "event_id", entry, path)
    samples, rejects = read_stacks(spark, [f"{path}/file=*"])
    found = samples.select(short_name(F.col("file"), _FILE).cast("bigint").alias("file"), "ts", F.array_join("stack", "/").alias("stack"), "weight", "is_time")
    # No line may be refused.
    return found.unionByName(rejects.select(F.col("raw").alias("stack")), allowMissingColumns=True)


def status_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Events as status documents, one on a line."""
    entry = fill('{"localTime":"<at>Z","a":{"b":{"floatApprox":<k>},"c":<d>.5,"s":"x"},"up":true}', **_event_values())
    path = scratch_path(spark, "rendered_status")
    _write_lines(read(spark, sf, "events"), "event_id", entry, path)
    samples = read_metrics(spark, [f"{path}/file=*"])
    return samples.select(
        short_name(F.col("file"), _FILE).cast("bigint").alias("file"), "chunk_no", "sample_no", F.array_join("path", ".").alias("path"), _stamp("ts").alias("ts"), "value"
    )


QUERIES = {
    f.__name__: f
    for f in (
        ingest_events, ingest_headers, ingest_rejects, stitched_by_end, numbered_lines,
        archive_samples, archive_metadata, archive_metric_keys, archive_first_samples, archive_increments,
        stack_samples, status_samples,
    )
}
