"""Log files to events, headers and rejects."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from plumeline.functions.times import between_inclusive
from plumeline.operators.entries import stop_after_end
from plumeline.operators.shape_report import selection
from plumeline.sources import audit, structured, textlog
from plumeline.session import staged
from plumeline.sources.lines import LATIN, UTF8, node_type, read_lines, short_name, stitch_files, unmatched_lines
from plumeline.sources.streams import SPLIT_BYTES


@dataclass(frozen=True)
class IngestOptions:
    """Choices of one ingest run."""

    utf8: bool = False
    start: object = None
    end: object = None
    stop_at_end: bool = False
    wrapper: str | None = None
    name_pattern: str | None = None
    node_type: str | None = None
    #: Bytes of a file that one task reads.
    split_bytes: int = SPLIT_BYTES
    #: Entries end with a line that this matches, as in older logs; by default they begin with a pattern.
    end_pattern: str | None = None
    older_writes: bool = False
    replication_ops: bool = False
    default_year: int = 2000


@dataclass(frozen=True)
class Ingested:
    """The tables of one ingest run."""

    events: DataFrame
    headers: DataFrame
    rejects: DataFrame
    unmatched: DataFrame | None = None


def _block_hosts(parsed_json: DataFrame, blocks: DataFrame) -> DataFrame:
    """Process headers folded to one row per block.

    ``before`` is the host in force at the block start, ``changes`` are the
    headers inside the block.
    """
    starts = parsed_json.filter((F.col("e.c") == "CONTROL") & (F.col("e.msg") == "Process Details")).select(
        "infile", "block", F.struct("lineno", F.col("a.host").alias("host")).alias("h")
    )
    inside = starts.groupBy("infile", "block").agg(F.array_sort(F.collect_list("h")).alias("changes"))
    along = Window.partitionBy("infile").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.join(inside, ["infile", "block"], "left")
        .withColumn("before", F.last(F.element_at("changes", -1)["host"], ignorenulls=True).over(along))
        .filter(F.col("before").isNotNull() | F.col("changes").isNotNull())
        .select("infile", "block", "before", "changes")
    )


def _with_host(rows: DataFrame, block_hosts: DataFrame) -> DataFrame:
    """Host of the last process header at or before each row of the same file."""
    known = rows.join(block_hosts, ["infile", "block"], "left")
    passed = F.filter("changes", lambda c: c["lineno"] <= F.col("lineno"))
    return known.withColumn(
        "host", F.coalesce(F.when(F.size(passed) > 0, F.element_at(passed, -1)["host"]), F.col("before"))
    ).drop("before", "changes")


def ingest_logs(spark: SparkSession, paths: Sequence[str], options: IngestOptions = IngestOptions()) -> Ingested:
    """Read, stitch, route, parse and enrich log files of any mix of formats.

    Gzip files are found by their first bytes.  With a wrapper ``unmatched``
    counts the lines it does not match.
    """
    o = options
    # Fails early when the range is upside down.
    in_range = between_inclusive(F.col("ts"), o.start, o.end)
    lines = read_lines(spark, paths, UTF8 if o.utf8 else LATIN, o.split_bytes)
    stitched = stitch_files(lines, o.wrapper, end_pattern=o.end_pattern)
    routed = stitched.entries

    def of(fmt: str) -> DataFrame:
        # In even parts: how many entries lie in one stored piece differs by the file they came from, gzip data most of all.
        return routed.filter(F.col("format") == fmt).repartition("infile", "lineno")

    base: dict[str, Column] = {
        "infile": F.col("infile"),
        "lineno": F.col("lineno"),
        "short_name": short_name(F.col("infile"), o.name_pattern),
        "node_type": node_type(F.col("infile"), o.node_type),
    }
    # Envelopes and documents are parsed once, into the shared folder and apart by outcome; all tables read what they need.
    envelopes = structured.parse_envelopes(of("json")).withColumn("readable", F.col("ts").isNotNull())
    parsed = {
        "text": textlog.parse_text(of("text")),
        "json": staged(envelopes, "envelopes", ("readable",)),
        "audit": audit.parse_audit(of("audit")),
        "search": audit.parse_search(of("search")),
        "syslog": textlog.parse_syslog(of("syslog"), o.default_year),
    }
    unreadable = [
        p.filter(~F.col("readable") if n == "json" else F.col("ts").isNull()).select("infile", "lineno", F.col("entry").alias("raw"), F.lit(f"unreadable {n} entry").alias("error"))
        for n, p in parsed.items()
    ]
    unreadable.append(
        routed.filter(F.col("format").isNull()).select("infile", "lineno", F.col("entry").alias("raw"), F.lit("unknown format").alias("error"))
    )
    good = {n: p.filter(F.col("readable") if n == "json" else F.col("ts").isNotNull()) for n, p in parsed.items()}
    headers = structured.log_headers(good["json"])
    hosts = stitched.per_block(staged(_block_hosts(good["json"], stitched.blocks), "block-hosts"))

    def ranged(df: DataFrame) -> DataFrame:
        if o.stop_at_end and o.end is not None:
            df = stop_after_end(df, ["infile"], "lineno", "ts", o.end)
        return df.filter(in_range)

    hosted = {**base, "host": F.col("host")}
    lines_of_text = ranged(good["text"]).withColumn("host", F.lit(None).cast("string"))
    text, text_rejects = textlog.text_events(
        lines_of_text.unionByName(ranged(good["syslog"])), hosted, o.older_writes, o.replication_ops,
        lambda rows, outcome: staged(rows, "text-documents", (outcome,)),
    )
    events = [
        structured.structured_events(_with_host(ranged(good["json"]), hosts), hosted),
        text,
        audit.audit_events(ranged(good["audit"]), base),
        audit.search_events(_with_host(ranged(good["search"]), hosts), hosted),
    ]
    broken = [
        text_rejects.select("infile", "lineno", F.col("entry").alias("raw"), F.lit("unreadable document").alias("error"))
    ]

    def union(frames: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), frames)

    return Ingested(union(events), headers, union(unreadable + broken), unmatched_lines(lines, o.wrapper) if o.wrapper else None)


def write_ingested(out: Ingested, path: str, batch: str | None = None) -> Observation:
    """Write the three tables below ``path``; events by date, sorted by type.

    A ``batch`` names what was read: its rows replace those of an earlier run of the same batch and no others, so a run
    can be repeated.  Without it rows are appended.  Returns the row counts Spark observed while writing the events.
    """
    if batch is not None and not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"not a name for a folder: {batch}")
    mode, below = ("append", "") if batch is None else ("overwrite", f"/batch={batch}")
    counted = Observation("events")
    events = out.events.observe(counted, F.count("*").alias("rows"), F.count("duration_millis").alias("slow"))
    events.sortWithinPartitions("log_date", "type").write.mode(mode).partitionBy("log_date").parquet(f"{path}/events{below}")
    out.headers.write.mode(mode).parquet(f"{path}/headers{below}")
    out.rejects.write.mode(mode).parquet(f"{path}/rejects{below}")
    return counted


def read_events(
    spark: SparkSession, path: str, files: Sequence[str] | None = None, start=None, end=None
) -> DataFrame:
    """Stored events, optionally of some files and strictly between two dates.

    The date range also prunes the partitions by day.
    """
    events = spark.read.parquet(f"{path}/events").filter(selection(files, start, end))
    if start is not None:
        events = events.filter(F.col("log_date") >= F.to_date(F.lit(start)))
    if end is not None:
        events = events.filter(F.col("log_date") <= F.to_date(F.lit(end)))
    return events


def slow_ops(events: DataFrame) -> DataFrame:
    """The slow operations among the events."""
    return events.filter(F.col("type").isin("COMMAND", "WRITE") & F.col("command").isNotNull())
