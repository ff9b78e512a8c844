"""Metric archives: binary documents with compressed chunks of samples."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumeline.functions.flatten import flatten_json
from plumeline.session import staged
from plumeline.sources.lines import UTF8, read_lines, stitch_files
from plumeline.sources.streams import SMALLEST_DOCUMENT, SPLIT_BYTES, file_documents, file_heads, list_files

# Document kinds, sample clock, lines per chunk of status files.
METADATA, METRICS = 0, 1
CLOCK = "start"
STATUS_LINES = 100

#: Samples of a row of series: a reader holds some thousand rows at once, whatever the size of a chunk.
SLICE = 1024

_SERIES = "file string, chunk_no int, path array<string>, first int, before bigint, starts array<bigint>, values array<bigint>, error string"

# Element codes of the document format.
_FIXED = {1: "<d", 8: "<?", 9: "<q", 16: "<i", 17: "<II", 18: "<q"}
_IGNORED = {6: 0, 7: 12, 10: 0, 19: 16, 0x7F: 0, 0xFF: 0}

# What a damaged document can raise.
_DAMAGE = (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error)


def _document(buf: bytes, at: int = 0) -> tuple[dict, int]:
    """Fields of one binary document and its end; values keep their element code."""
    (size,) = struct.unpack_from("<i", buf, at)
    end, at, out = at + size, at + 4, {}
    if size < SMALLEST_DOCUMENT or end > len(buf):
        raise ValueError(f"document of {size} bytes")
    while buf[at]:
        code = buf[at]
        stop = buf.index(0, at + 1)
        name, at = buf[at + 1 : stop].decode(), stop + 1
        if code in _FIXED:
            value = struct.unpack_from(_FIXED[code], buf, at)
            out[name] = (code, value if code == 17 else value[0])
            at += struct.calcsize(_FIXED[code])
        elif code in (3, 4):
            value, at = _document(buf, at)
            out[name] = (code, value)
        elif code in (2, 13, 14):
            (n,) = struct.unpack_from("<i", buf, at)
            out[name], at = (2, buf[at + 4 : at + 3 + n].decode("utf-8", "replace")), at + 4 + n
        elif code == 5:
            (n,) = struct.unpack_from("<i", buf, at)
            out[name], at = (5, buf[at + 5 : at + 5 + n]), at + 5 + n
        elif code == 11:
            # A regular expression: its pattern and its options.
            for _ in range(2):
                at = buf.index(0, at) + 1
        elif code in _IGNORED:
            at += _IGNORED[code]
        else:
            raise ValueError(f"unknown element {code}")
    return out, end


def _numbers(doc: dict, path: tuple = ()) -> Iterator[tuple[tuple, int]]:
    """(path, whole number) of every numeric leaf, in document order."""
    for name, (code, value) in doc.items():
        if code in (3, 4):
            yield from _numbers(value, path + (name,))
        elif code == 17:
            yield path + (name, "t"), value[0]
            yield path + (name, "i"), value[1]
        elif code in _FIXED:
            yield path + (name,), int(value)


def _plain(doc: dict):
    """JSON-ready form of a document."""

    def one(code, value):
        if code == 3:
            return _plain(value)
        if code == 4:
            return list(_plain(value).values())
        if code == 9:
            return {"$date": value}
        if code == 17:
            return {"t": value[0], "i": value[1]}
        return value.hex() if code == 5 else value

    return {name: one(code, value) for name, (code, value) in doc.items()}


def _packed(data: bytes) -> np.ndarray:
    """All variable-length integers of a byte string."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        # A chunk of one sample has no differences.
        return np.array([], dtype=np.int64)
    last = np.flatnonzero(raw < 0x80)
    first = np.concatenate(([0], last[:-1] + 1))
    shift = (np.arange(len(raw)) - np.repeat(first, last - first + 1)).astype(np.uint64) * np.uint64(7)
    parts = (raw & 0x7F).astype(np.uint64) << shift
    return np.add.reduceat(parts, first).view(np.int64)


def _deltas(data: bytes, total: int) -> np.ndarray:
    """Deltas with runs of zeros opened; a zero is followed by how many more come."""
    out, at, packed = np.zeros(total, dtype=np.int64), 0, iter(_packed(data))
    for value in packed:
        if value:
            out[at] = value
            at += 1
        else:
            at += 1 + int(next(packed))
    if at != total:
        raise ValueError(f"{at} of {total} deltas")
    return out


def _series(doc: bytes) -> list[tuple[tuple, np.ndarray]]:
    """Values of every metric of one chunk."""
    data = zlib.decompress(_document(doc)[0]["data"][1][4:])
    reference, at = _document(data)
    metrics = list(_numbers(reference))
    n_metrics, n_deltas = struct.unpack_from("<II", data, at)
    if n_metrics != len(metrics):
        raise ValueError(f"{len(metrics)} metrics found, {n_metrics} expected")
    steps = _deltas(data[at + 8 :], n_metrics * n_deltas).reshape(n_metrics, n_deltas)
    first = np.array([v for _, v in metrics], dtype=np.int64)[:, None]
    return [(path, row) for (path, _), row in zip(metrics, np.cumsum(np.hstack([first, steps]), axis=1))]


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file", "chunk_no", "path", "first", "before", "starts", "values", "error"]
    for pdf in batches:
        for file, chunk_no, doc in zip(pdf["file"], pdf["chunk_no"], pdf["doc"]):
            try:
                found = _series(doc)
                starts = dict(found).get((CLOCK,))
                rows = [
                    (file, chunk_no, list(p), at, v[max(at - 1, 0)], None if starts is None else starts[at : at + SLICE], v[at : at + SLICE], None)
                    for p, v in found
                    for at in range(0, len(v), SLICE)
                ]
            except _DAMAGE as problem:
                rows = [(file, chunk_no, None, 0, 0, None, None, str(problem))]
            yield pd.DataFrame(rows, columns=columns)


def read_documents(spark: SparkSession, paths: Sequence[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``file, chunk_no, kind, doc`` of archive files, one row per document; kind is -1 for damaged ones.

    Tasks read ranges of ``split_bytes``.  The first task of a file follows the sizes of documents from its begin, the others
    from the first place in their range that looks like a document.  That place must be where the range before ended; files
    for which it is not, because their documents look different or contain what looks like one, are read on from the last
    place that is known to be right, each by one task.  So the result does not depend on how files are cut.
    """

    def kind_of(doc: bytes | None) -> int:
        try:
            return int(_document(bytes(doc))[0].get("type", (16, -1))[1])
        except _DAMAGE:
            return -1

    @F.pandas_udf("int")
    def kind(docs: pd.Series) -> pd.Series:
        return docs.map(kind_of).astype("int32")

    def documents(**how) -> DataFrame:
        return staged(file_documents(spark, files, **how).withColumn("kind", kind("doc")), "archive-documents")

    files = list_files(spark, paths)
    found = documents(split=split_bytes)
    ranges = found.groupBy("file", "range", "stop").agg(F.min("offset").alias("first"), F.max("next").alias("next"), F.count("offset").alias("n"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("next").over(before), F.lit(0))
    ranges = ranges.withColumn("reach", reach)
    fits = F.when(F.col("reach") < F.col("stop"), F.col("first").eqNullSafe(F.col("reach"))).otherwise(F.col("first").isNull())
    # Only files with a break come to the driver.
    broken = ranges.filter(~fits).groupBy("file").agg(F.min_by(F.struct("range", "reach"), "range").alias("at")).select("file", "at.range", "at.reach")
    known = {r["file"]: r["reach"] for r in broken.collect()}
    columns = ["file", "range", "nth", "kind", "doc"]
    docs = found.filter(F.col("doc").isNotNull())
    if known:
        cut = spark.createDataFrame(broken.collect(), "file string, broken long, reach long")
        docs = docs.join(F.broadcast(cut), "file", "left").filter(F.col("broken").isNull() | (F.col("range") < F.col("broken")))
        docs = docs.select(columns).unionByName(documents(known=known).filter(F.col("doc").isNotNull()).select(columns))
    counts = docs.groupBy("file", "range").count()
    starts = counts.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    numbered = docs.join(starts, ["file", "range"]).withColumn("chunk_no", (F.col("start") + F.col("nth")).cast("int"))
    return numbered.select("file", "chunk_no", "kind", "doc")


def decode_series(spark: SparkSession, paths: Sequence[str], split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Series, metadata and rejected chunks of archive files.

    A series is a metric of a chunk, in rows ``file, chunk_no, path, first, before, starts, values`` of up to ``SLICE`` samples:
    ``first`` is the number of the first one, ``before`` the value before it (at the begin of a chunk its own), ``starts``
    their times, NULL in a chunk without a clock.  Chunks are spread over the cluster before they are opened, because the
    samples take far more room than the compressed chunks; they are opened once, into the shared folder.
    """
    docs = read_documents(spark, paths, split_bytes)
    # By its size alone, the compressed data would be one task's.
    chunks = docs.filter(F.col("kind") == METRICS).select("file", "chunk_no", "doc").repartition(spark.sparkContext.defaultParallelism, "file", "chunk_no")
    found = staged(chunks.mapInPandas(_decode, _SERIES), "archive-series")
    series = found.filter(F.col("error").isNull()).drop("error")
    damaged = docs.filter(F.col("kind") == -1).select("file", "chunk_no", F.lit("not a document").alias("error"))
    rejects = found.filter(F.col("error").isNotNull()).select("file", "chunk_no", "error").unionByName(damaged)

    @F.pandas_udf("string")
    def meta(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: json.dumps(_plain(_document(bytes(d))[0]).get("doc")))

    metadata = docs.filter(F.col("kind") == METADATA).select("file", "chunk_no", meta("doc").alias("doc"))
    return series, metadata, rejects


def decode_ftdc(spark: SparkSession, paths: Sequence[str], split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metric samples, metadata and rejected chunks of archive files.  A chunk without a clock gives samples without time."""
    series, metadata, rejects = decode_series(spark, paths, split_bytes)
    samples = series.select("file", "chunk_no", "path", "first", "starts", F.posexplode("values").alias("at", "value")).select(
        "file", "chunk_no", (F.col("first") + F.col("at")).alias("sample_no"), "path",
        F.timestamp_millis(F.get("starts", F.col("at"))).alias("ts"), "value",
    )
    return samples, metadata, rejects


def read_server_status(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Metric samples of files with one status document per line."""
    entries = stitch_files(read_lines(spark, paths, UTF8), patterns={"doc": r"^\s*\{"}).entries
    clock = F.try_to_timestamp(F.get_json_object("entry", "$.localTime"))
    flat = flatten_json(
        entries.select(F.col("infile").alias("file"), "lineno", "entry", clock.alias("ts")), "entry", ["file", "lineno", "ts"],
        skip_parts=("floatApprox",),
    )
    at = F.col("lineno") - 1
    value = F.coalesce(F.col("value").try_cast("bigint"), F.col("value").try_cast("double").cast("bigint"))
    value = F.when(F.col("type") == "boolean", (F.col("value") == "true").cast("bigint")).otherwise(value)
    return (
        flat.withColumn("value", value)
        .filter(F.col("value").isNotNull())
        .select(
            "file",
            F.floor(at / STATUS_LINES).cast("int").alias("chunk_no"),
            (at % STATUS_LINES).cast("int").alias("sample_no"),
            F.concat(F.array(F.lit("serverStatus")), "path").alias("path"),
            "ts",
            "value",
        )
    )


def metric_format(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, format``: text that opens a JSON document is ``status``, all else ``archive``; tasks read the first bytes."""
    heads = file_heads(spark, list_files(spark, paths), 1)
    return heads.select(F.col("infile").alias("file"), F.when(F.col("value") == b"{", "status").otherwise("archive").alias("format"))


def read_metrics(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Metric samples of files of either kind."""
    kinds = metric_format(spark, paths).collect()
    by_kind = {k: [r["file"] for r in kinds if r["format"] == k] for k in ("archive", "status")}
    parts = []
    if by_kind["archive"]:
        parts.append(decode_ftdc(spark, by_kind["archive"])[0])
    if by_kind["status"]:
        parts.append(read_server_status(spark, by_kind["status"]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
