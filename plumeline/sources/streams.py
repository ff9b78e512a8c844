"""Files as byte ranges: a data source whose partitions open, sniff and read their own part of a file.

The driver only lists files.  A task opens its ranges itself, sees from the first bytes of a file whether it is gzip data,
and hands out lines, or whole binary documents, as it reads; its memory is bounded by its buffers and the longest line or
document.  Files must lie where ``pyarrow.fs`` can open them (local or mounted folders, HDFS, S3, GCS, Azure).
"""

from __future__ import annotations

import itertools
import json
import operator
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Gzip magic bytes; how a document of an archive begins behind its size: a date, then a number for its kind.
GZIP_MAGIC = b"\x1f\x8b"
DOCUMENT_ID, DOCUMENT_TYPE, NUMBERS = b"\x09_id\x00", b"type\x00", b"\x01\x10\x12"
SMALLEST_DOCUMENT = 5

#: Schemes that tasks can open.
OPENED = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")
#: Bytes of a range, of ranges that one task reads if they are smaller, of one read, of the first look for a line end, of
#: text inflated at once, and of a batch of lines.
SPLIT_BYTES = 128 << 20
TASK_BYTES = 4 << 20
READ_BYTES = 1 << 20
LOOK_BYTES = 4 << 10
INFLATE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20

_LINES = pa.schema([("infile", pa.string()), ("block", pa.int64()), ("value", pa.binary())])
_DOCS = pa.schema(
    [("file", pa.string()), ("range", pa.int64()), ("stop", pa.int64()), ("nth", pa.int64()), ("offset", pa.int64()), ("next", pa.int64()), ("doc", pa.binary())]
)


def list_files(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """``(location, size)`` of every file that ``paths`` name: files, folders or patterns; none is opened."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = []
    for path in paths:
        place = hadoop.Path(path)
        fs = place.getFileSystem(conf)
        found = list(fs.globStatus(place) or [])
        if not found:
            raise FileNotFoundError(path)
        for status in found:
            inner = list(fs.listStatus(status.getPath())) if status.isDirectory() else [status]
            files += [(s.getPath(), s.getLen()) for s in inner if s.isFile() and s.getPath().getName()[0] not in "._"]
    # The form of Spark's file metadata.
    uris = [(place.toUri().toString(), size) for place, size in files]
    return [(f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri, size) for uri, size in uris]


def can_open(files: Sequence[tuple[str, int]]) -> bool:
    """Whether tasks can open all of these files themselves."""
    return all(uri.split(":", 1)[0] in OPENED for uri, _ in files)


@dataclass
class Range(InputPartition):
    """Parts ``(location, start, stop, size of the file)`` of one task."""

    parts: tuple[tuple[str, int, int, int], ...]

    def __init__(self, parts):
        self.parts = tuple(parts)


def cut_ranges(files: Sequence[tuple[str, int]], split: int, task: int = 0) -> list[Range]:
    """Files cut at multiples of ``split``; small files, ends and small ranges share a task of ``task`` bytes (``split`` by default)."""
    task = task or split
    out, held, room = [], [], task
    for uri, size in files:
        for start in range(0, max(size, 1), split):
            part = (uri, start, min(start + split, size), size)
            length = part[2] - part[1]
            if held and length > room:
                out.append(Range(held))
                held, room = [], task
            held.append(part)
            # A file costs something to open, however small it is.
            room -= max(length, task // 1000)
    return [*out, Range(held)] if held else out


def _open(uri: str):
    """A random-access file; ``s3a`` and ``gcs`` are other names of schemes that pyarrow knows."""
    for other, known in (("s3a:", "s3:"), ("gcs:", "gs:")):
        if uri.startswith(other):
            uri = known + uri[len(other) :]
    fs, path = pa.fs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def inflated(stream) -> Iterator[bytes]:
    """The text of gzip data of one or more members, a bounded part at a time.

    Data may stop early, as in a file that is still written, and zero bytes may follow a member; damage raises.
    """
    reader = zlib.decompressobj(31)
    while piece := stream.read(READ_BYTES):
        while piece:
            if reader is None:
                piece = piece.lstrip(b"\0")
                if not piece:
                    break
                reader = zlib.decompressobj(31)
            text = reader.decompress(piece, INFLATE_BYTES)
            if text:
                yield text
            piece = reader.unconsumed_tail
            if reader.eof:
                piece, reader = reader.unused_data, None


def _split_lines(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Lines that end with a line feed, a carriage return or both."""
    for lines in _fed_lines(texts):
        if any(b"\r" in line for line in lines):
            lines = [part for line in lines for part in line.removesuffix(b"\r").split(b"\r")]
        yield lines


def _fed_lines(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    rest: list[bytes] = []
    for text in texts:
        head, *lines = text.split(b"\n")
        rest.append(head)
        if lines:
            *lines, tail = [b"".join(rest), *lines]
            rest = [tail]
            yield lines
    last = b"".join(rest)
    if last:
        yield [last]


def range_lines(stream, start: int, stop: int, size: int) -> Iterator[list[bytes]]:
    """Lines of a file that begin in ``start .. stop``; a gzip file is all in its first range."""
    stream.seek(0)
    if stream.read(len(GZIP_MAGIC)) == GZIP_MAGIC:
        if start == 0:
            stream.seek(0)
            yield from _split_lines(inflated(stream))
        return

    def texts() -> Iterator[bytes]:
        at = start
        if start:
            # The line that reaches over the start belongs to the range before, unless it ends just there.
            at, look = start - 1, LOOK_BYTES
            stream.seek(at)
            while at < size:
                piece = stream.read(min(look, size - at))
                cut = piece.find(b"\n")
                at += len(piece) if cut < 0 else cut + 1
                if cut >= 0:
                    break
                look = min(4 * look, READ_BYTES)
        stream.seek(at)
        while at < stop:
            piece = stream.read(min(READ_BYTES, stop - at))
            if not piece:
                return
            at += len(piece)
            yield piece
            if at >= stop and not piece.endswith(b"\n"):
                # The last line goes on behind the range.
                look = LOOK_BYTES
                while piece := stream.read(look):
                    cut = piece.find(b"\n")
                    if cut >= 0:
                        yield piece[: cut + 1]
                        return
                    yield piece
                    look = min(4 * look, READ_BYTES)

    yield from _split_lines(texts())


def _line_batches(parts) -> Iterator[pa.RecordBatch]:
    # A file is opened once for all of its ranges that follow each other.
    for uri, ranges in itertools.groupby((p for p in parts if p[1] < p[2]), operator.itemgetter(0)):
        with _open(uri) as stream:
            for _, start, stop, size in ranges:
                held, room = [], BATCH_BYTES
                for lines in range_lines(stream, start, stop, size):
                    held += lines
                    room -= sum(map(len, lines))
                    if room <= 0:
                        yield _of_lines(uri, start, held)
                        held, room = [], BATCH_BYTES
                if held:
                    yield _of_lines(uri, start, held)


def _of_lines(uri: str, block: int, lines: list[bytes]) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([uri] * n), pa.array([block] * n, pa.int64()), pa.array(lines, pa.binary())], schema=_LINES)


# Documents ----------------------------------------------------------------------------------------------------------


class Bytes:
    """A file as a sequence of bytes, read as far as it is looked at; what lies before the last place asked for is let go."""

    def __init__(self, stream, size: int):
        self.stream, self.size = stream, size
        self.at, self.held = 0, b""

    def get(self, start: int, length: int) -> bytes:
        """Bytes from ``start``, fewer at the end of the file."""
        stop = min(start + length, self.size)
        if start < self.at or start > self.at + len(self.held):
            self.at, self.held = start, b""
        if stop > self.at + len(self.held):
            keep = self.held[start - self.at :]
            self.stream.seek(start + len(keep))
            more = self.stream.read(max(stop - start - len(keep), READ_BYTES))
            self.at, self.held = start, keep + more
        return self.held[start - self.at : stop - self.at]

    def document_size(self, at: int) -> int:
        """The size of the document that may begin here; 0 if none can."""
        head = self.get(at, 4)
        size = struct.unpack("<i", head)[0] if len(head) == 4 else 0
        return size if SMALLEST_DOCUMENT <= size <= self.size - at and self.get(at, size)[-1:] == b"\0" else 0

    def resync(self, at: int) -> int:
        """The first place from ``at`` where a document of an archive begins: size, id, kind and end all fit; else the end."""
        step = READ_BYTES
        while at < self.size:
            part = self.get(at, step + 64)
            look = part.find(DOCUMENT_ID, 4)
            if look < 0 or look - 4 >= step:
                at += min(step, len(part))
                continue
            found = at + look - 4
            kind = look + len(DOCUMENT_ID) + 8
            if part[kind : kind + 1] in NUMBERS and part[kind + 1 : kind + 6] == DOCUMENT_TYPE and self.document_size(found):
                return found
            at = found + 1
        return self.size


def range_documents(stream, start: int, stop: int, size: int, known: bool) -> Iterator[tuple[int, int, bytes]]:
    """``(offset, next, bytes)`` of the documents that begin in ``start .. stop``.

    Documents follow each other by their sizes.  Where none can begin, what lies before the next recognisable one is given
    as one damaged document.  ``known`` says that one begins at ``start``; else the first recognisable place counts.
    """
    data = Bytes(stream, size)
    at = start if known else data.resync(start)
    while at < stop:
        length = data.document_size(at)
        after = at + length if length else data.resync(at + 1)
        # Of damaged bytes a bounded part is enough to name them.
        yield at, after, data.get(at, length or min(after - at, READ_BYTES))
        at = after


def _document_batches(parts, known: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for uri, start, stop, size in parts:
        if start >= stop:
            continue
        first = known.get(uri, start)
        with _open(uri) as stream:
            held, room, nth = [], BATCH_BYTES, 0
            for at, after, doc in range_documents(stream, first, stop, size, uri in known or start == 0):
                held.append((nth, at, after, doc))
                nth += 1
                room -= len(doc)
                if room <= 0:
                    yield _of_documents(uri, first, stop, held)
                    held, room = [], BATCH_BYTES
            # One row without document for every range, so that ranges without any are known as well.
            yield _of_documents(uri, first, stop, [*held, (None, None, None, None)])


def _of_documents(uri: str, start: int, stop: int, rows: list) -> pa.RecordBatch:
    n = len(rows)
    columns = [[uri] * n, [start] * n, [stop] * n, *zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _DOCS, strict=True)], schema=_DOCS)


def _head_batches(parts, length: int) -> Iterator[pa.RecordBatch]:
    for uri, start, _, _ in parts:
        if start == 0:
            with _open(uri) as stream:
                yield _of_lines(uri, 0, [stream.read(length)])


class _Reader(DataSourceReader):
    def __init__(self, options, files):
        self.files, self.split, self.task = files, int(options["split"]), int(options["task"])
        self.kind, self.known, self.length = options["kind"], json.loads(options["known"]), int(options["length"])

    def __getstate__(self) -> dict:
        """Every task gets the reader: the list of files is not in it, or tasks and what each reads would both grow with the files."""
        return {**self.__dict__, "files": None}

    def partitions(self) -> Sequence[InputPartition]:
        if self.known:
            return [Range([(uri, 0, size, size)]) for uri, size in self.files]
        return cut_ranges(self.files, self.split, self.task)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if self.kind == "documents":
            yield from _document_batches(partition.parts, self.known)
        else:
            yield from _line_batches(partition.parts) if self.kind == "lines" else _head_batches(partition.parts, self.length)


class ByteRanges(DataSource):
    """Lines, first bytes or documents of ranges of ``files``; used through the functions below."""

    @classmethod
    def name(cls) -> str:
        return "plumeline_ranges"

    def schema(self) -> str:
        if self.options["kind"] == "documents":
            return "file string, range bigint, stop bigint, nth bigint, offset bigint, next bigint, doc binary"
        return "infile string, block bigint, value binary"

    def reader(self, schema) -> _Reader:
        # Tasks get this source as well, and not its files.
        return _Reader(self.options, [tuple(f) for f in json.loads(self.options.pop("files"))])


def _load(
    spark: SparkSession, kind: str, files: Sequence[tuple[str, int]], split: int = SPLIT_BYTES, known: dict[str, int] | None = None, length: int = 0
) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    # Small ranges and files share tasks, as long as there is a task for every core; a larger range is one by itself.
    task = min(TASK_BYTES, max(sum(size for _, size in files) // max(spark.sparkContext.defaultParallelism, 1), TASK_BYTES >> 6))
    options = {"kind": kind, "files": json.dumps(files), "split": str(split), "task": str(task), "known": json.dumps(known or {}), "length": str(length)}
    return spark.read.format(ByteRanges.name()).options(**options).load()


def file_lines(spark: SparkSession, files: Sequence[tuple[str, int]], split: int = SPLIT_BYTES) -> DataFrame:
    """``infile, block, value``: lines in file order inside a block; gzip files are found by their content, one block each."""
    return _load(spark, "lines", files, split)


def file_heads(spark: SparkSession, files: Sequence[tuple[str, int]], length: int) -> DataFrame:
    """``infile, block, value``: the first ``length`` bytes of every file."""
    return _load(spark, "heads", [(uri, 0) for uri, _ in files], length=length)


def file_documents(spark: SparkSession, files: Sequence[tuple[str, int]], split: int = SPLIT_BYTES, known: dict[str, int] | None = None) -> DataFrame:
    """``file, range, stop, nth, offset, next, doc``: documents by the range they begin in, and a row without document for each.

    ``known`` gives the place of a document of some files; these files alone are read, each from there to its end as one range.
    """
    return _load(spark, "documents", [f for f in files if f[0] in known] if known else files, split, known)
