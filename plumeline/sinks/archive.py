"""Metric archives as files: samples to compressed chunks, chunks to files.

The counterpart of ``sources/ftdc.py``.  A chunk is a reference document with the first value of every metric, and for each
metric the differences of the later values as variable-length integers, a zero followed by the number of zeros behind it,
all in one zlib stream.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# Element codes of documents, kinds of archive documents, the sample clock.
DOCUMENT, DATE, INT32, INT64, STRING, BINARY = 3, 9, 16, 18, 2, 5
METADATA, METRICS = 0, 1
CLOCK = "start"


def _element(code: int, name: str, data: bytes) -> bytes:
    return bytes([code]) + name.encode() + b"\0" + data


def _closed(elements: bytes) -> bytes:
    return struct.pack("<i", len(elements) + 5) + elements + b"\0"


def encode_document(doc: dict) -> bytes:
    """A binary document of texts, whole numbers and documents; dates are ``(milliseconds,)``."""
    out = b""
    for name, value in doc.items():
        if isinstance(value, dict):
            out += _element(DOCUMENT, name, encode_document(value))
        elif isinstance(value, tuple):
            out += _element(DATE, name, struct.pack("<q", value[0]))
        elif isinstance(value, bytes):
            out += _element(BINARY, name, struct.pack("<i", len(value)) + b"\0" + value)
        elif isinstance(value, str):
            text = value.encode()
            out += _element(STRING, name, struct.pack("<i", len(text) + 1) + text + b"\0")
        else:
            out += _element(INT64, name, struct.pack("<q", value))
    return _closed(out)


def archive_document(at: int, kind: int, name: str, data: bytes) -> bytes:
    """A document of an archive: its time, its kind, and an element of its own, binary data or a document."""
    if kind == METRICS:
        data = struct.pack("<i", len(data)) + b"\0" + data
    return _closed(_element(DATE, "_id", struct.pack("<q", at)) + _element(INT32, "type", struct.pack("<i", kind)) + _element(BINARY if kind == METRICS else DOCUMENT, name, data))


def pack_integers(values: np.ndarray) -> bytes:
    """Variable-length integers, seven bits a byte, least first; negative ones as 64-bit numbers without sign."""
    rest = values.astype(np.int64).view(np.uint64)
    sizes = np.ones(len(rest), np.int64)
    for bits in range(7, 64, 7):
        sizes += rest >= np.uint64(1 << bits)
    stop = np.cumsum(sizes)
    out = np.zeros(int(stop[-1]) if len(stop) else 0, np.uint8)
    for k in range(10):
        has = np.flatnonzero(sizes > k)
        more = (sizes[has] > k + 1).astype(np.uint8) << 7
        out[(stop - sizes)[has] + k] = ((rest[has] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8) | more
    return out.tobytes()


def pack_deltas(deltas: np.ndarray) -> bytes:
    """Differences with every run of zeros as a zero and the number of zeros that follow it."""
    zero = deltas == 0
    fresh = zero.copy()
    fresh[1:] &= ~zero[:-1]
    use = np.flatnonzero(~zero | fresh)
    length = np.diff(np.append(use, len(deltas)))
    numbers = np.stack([deltas[use], length - 1], 1).ravel()
    keep = np.ones(len(numbers), bool)
    keep[1::2] = deltas[use] == 0
    return pack_integers(numbers[keep])


def _nested(names: Sequence[str], values: Sequence[int]) -> dict:
    """A document from dotted names, in their order."""
    out: dict = {}
    for name, value in zip(names, values, strict=True):
        *parents, leaf = name.split(".")
        at = out
        for part in parents:
            at = at.setdefault(part, {})
        at[leaf] = value
    return out


def _leaf_order(doc: dict, prefix: str = "") -> Iterator[str]:
    for name, value in doc.items():
        if isinstance(value, dict):
            yield from _leaf_order(value, f"{prefix}{name}.")
        else:
            yield prefix + name


def encode_chunk(millis: np.ndarray, names: Sequence[str], values: np.ndarray) -> bytes:
    """One chunk from sample times and a row of values for each sample; ``names`` are dotted paths."""
    first = _nested(names, [int(v) for v in values[0]])
    # Metrics follow the reference document, which keeps the parts of a path together.
    place = {name: k for k, name in enumerate(names)}
    series = np.stack([millis, *(values[:, place[name]] for name in _leaf_order(first))])
    with np.errstate(over="ignore"):
        deltas = np.diff(series, axis=1)
    reference = encode_document({CLOCK: (int(millis[0]),), **first})
    data = reference + struct.pack("<II", len(series), len(millis) - 1) + pack_deltas(deltas.ravel())
    return archive_document(int(millis[0]), METRICS, "data", struct.pack("<I", len(data)) + zlib.compress(data))


def archive_chunks(samples: DataFrame, names: Sequence[str], chunk: str = "chunk") -> DataFrame:
    """``file, chunk, doc`` from samples ``file, chunk, ts, values``: a chunk document for each file and chunk.

    A chunk is put together in one place, so its number of samples is the caller's choice.  Samples of one time follow in
    the order of their values.
    """
    names = list(names)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        millis = table.column("millis").to_numpy()
        values = np.asarray(table.column("values").combine_chunks().flatten(), np.int64).reshape(table.num_rows, len(names))
        order = np.lexsort((*values.T[::-1], millis))
        doc = encode_chunk(millis[order], names, values[order])
        return pa.table({"file": table.column("file").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "doc": pa.array([doc], pa.binary())})

    rows = samples.select("file", F.col(chunk).cast("long").alias("chunk"), F.unix_millis("ts").alias("millis"), F.col("values").cast("array<bigint>").alias("values"))
    return rows.groupBy("file", "chunk").applyInArrow(run, "file string, chunk long, doc binary")


# Files --------------------------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    """Files of one task, by their temporary and their last name."""

    files: tuple[tuple[str, str], ...]


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> _Written:
        fs, root = pa.fs.FileSystem.from_uri(self.path)
        attempt, files, stream, name = uuid.uuid4().hex, [], None, None
        try:
            for row in iterator:
                if row["file"] != name:
                    if stream:
                        stream.close()
                    name = row["file"]
                    files.append((f"{root}/_writing-{attempt}-{len(files)}", f"{root}/{name}"))
                    stream = fs.open_output_stream(files[-1][0])
                stream.write(row["data"])
        finally:
            if stream:
                stream.close()
        return _Written(tuple(files))

    def commit(self, messages) -> None:
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        for message in messages:
            for temporary, last in message.files if message else ():
                fs.move(temporary, last)

    def abort(self, messages) -> None:
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        for message in messages:
            for temporary, _ in message.files if message else ():
                fs.delete_file(temporary)


class BinaryFiles(DataSource):
    """Rows ``file, data`` written one behind the other into files; a task's files get their names when the job commits."""

    @classmethod
    def name(cls) -> str:
        return "plumeline_binary"

    def schema(self) -> str:
        return "file string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> _FileWriter:
        return _FileWriter(self.options["path"])


def write_files(parts: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Write ``file, data`` rows into files below ``path``, each by one task, in ``order``; readers skip what was not committed."""
    spark = parts.sparkSession
    spark.dataSource.register(BinaryFiles)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    uri = fs.makeQualified(place).toUri().toString()
    uri = f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri
    dealt = parts.repartition("file").sortWithinPartitions("file", *order).select("file", "data")
    dealt.write.format(BinaryFiles.name()).mode("append").option("path", uri).save()


def write_archive(chunks: DataFrame, path: str, metadata: DataFrame | None = None) -> None:
    """Archive files of chunks ``file, chunk, doc``, in order of the chunks.

    A row ``file, at, entries map<string,string>`` of ``metadata`` becomes the first document of its file.
    """
    parts = chunks.select("file", F.col("chunk"), F.col("doc").alias("data"))
    if metadata is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                docs = [archive_document(r["at"], METADATA, "doc", encode_document(dict(r["entries"]))) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("file"), pa.array([None] * len(docs), pa.int64()), pa.array(docs, pa.binary())], ["file", "chunk", "data"]
                )

        heads = metadata.select("file", F.unix_millis("at").alias("at"), "entries").mapInArrow(run, "file string, chunk long, data binary")
        parts = heads.unionByName(parts)
    write_files(parts, path, ("chunk",))
