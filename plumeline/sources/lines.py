"""Log files to numbered, stitched entries.

A file is read in blocks of bytes.  One narrow pass joins the lines
of each block into pieces; only pieces at a block edge ever meet pieces of
another block.  Line numbers come from a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumeline.session import staged
from plumeline.sources.streams import GZIP_MAGIC, SPLIT_BYTES, can_open, file_heads, file_lines, list_files

# How an entry of each format begins.
ENTRY_PATTERNS = {
    "text": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T",
    "json": r'^\{"t":\{"\$date":',
    "audit": r'^\{ "atype"',
    "search": r'^\{"t":"[0-9]{4}-[0-9]{2}-[0-9]{2}T.*MONGOT',
    "syslog": r"^[A-Za-z]{3} [ 0-9][0-9] .* mongod\.[0-9]*\[.*\] command",
}
# Encodings, router marker in a path.
LATIN, UTF8 = "ISO-8859-1", "UTF-8"
ROUTER = "mongos"

# A block table below this many rows may travel to every executor (about 100 MB).
BROADCAST_BLOCKS = 500_000

_PIECES = (
    "infile string, block bigint, first bigint, last bigint, head boolean, tail boolean, closed boolean, format string, entry string"
)


def gzip_without_suffix(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths of gzip files that Spark would read as plain text; tasks look at their first bytes."""
    heads = file_heads(spark, list_files(spark, paths), len(GZIP_MAGIC))
    packed = heads.filter((F.col("value") == GZIP_MAGIC) & ~F.col("infile").endswith(".gz"))
    return [r["infile"] for r in packed.select("infile").collect()]


def read_lines(spark: SparkSession, paths: Sequence[str], encoding: str = LATIN, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``infile, block, value`` of plain and gzip files, in file order inside a block.

    A block is ``split_bytes`` of a file; tasks find gzip files by their first bytes and read each as one block, as a
    stream.  Files in a store that tasks can't open themselves are read by Spark's text source, which splits them by
    ``spark.sql.files.maxPartitionBytes`` and knows gzip files by their suffix.
    """
    files = list_files(spark, paths)
    if can_open(files):
        lines = file_lines(spark, files, split_bytes)
    else:
        lines = spark.read.text(list(paths)).select(
            F.col("_metadata.file_path").alias("infile"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("value"),
        )
    # A carriage return belongs to the line end, not to the line.
    text = F.decode("value", encoding) if encoding != UTF8 else F.col("value").cast("string")
    return lines.withColumn("value", F.regexp_replace(text, r"\r$", ""))


def strip_wrapper(value: Column, wrapper: str | None) -> Column:
    """Group 1 of the wrapper pattern; a line it does not match stays whole."""
    if not wrapper:
        return value
    return F.when(value.rlike(wrapper), F.regexp_extract(value, wrapper, 1)).otherwise(value)


def unmatched_lines(lines: DataFrame, wrapper: str) -> DataFrame:
    """``infile, n``: lines that the wrapper pattern does not match, of files that have such lines."""
    odd = lines.filter(~F.col("value").rlike(wrapper))
    return odd.groupBy("infile").agg(F.count("*").alias("n"))


def short_name(path: Column, pattern: str | None = None) -> Column:
    """Group 1 of a pattern over the path, or the file name."""
    base = F.element_at(F.split(path, "/"), -1)
    if not pattern:
        return base
    return F.coalesce(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), base)


def node_type(path: Column, given: str | None = None) -> Column:
    """The given node type, or the router type when the path says so."""
    return F.lit(given) if given else F.when(path.contains(ROUTER), F.lit(ROUTER))


def entry_format(entry: Column, patterns: dict[str, str] = ENTRY_PATTERNS) -> Column:
    """Format an entry starts like, NULL for none."""
    out = None
    for name, pattern in patterns.items():
        out = F.when(entry.rlike(pattern), name) if out is None else out.when(entry.rlike(pattern), name)
    return out


def _join_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Join the lines of each entry inside a block; the last entry stays open between batches.

    An entry begins with a line of some format, or, with a column ``ends``, behind a line that ends one.
    """
    held: dict | None = None

    def rows(piece: dict, tail: bool) -> pd.DataFrame:
        done = {k: piece[k] for k in ("infile", "block", "first", "last", "head", "closed", "format")}
        return pd.DataFrame([{**done, "tail": tail, "entry": "\n".join(piece["parts"])}])

    for pdf in batches:
        n = len(pdf)
        if n == 0:
            continue
        infile, block = pdf["infile"].to_numpy(), pdf["block"].to_numpy()
        kind, value = pdf["format"].to_numpy(), pdf["value"].to_numpy()
        by_end = "ends" in pdf
        ends_here = pdf["ends"].to_numpy(dtype=bool) if by_end else np.zeros(n, dtype=bool)
        start = np.append(held is not None and held["closed"], ends_here[:-1]) if by_end else pdf["format"].notna().to_numpy()
        fresh = np.empty(n, dtype=bool)
        fresh[1:] = (block[1:] != block[:-1]) | (infile[1:] != infile[:-1])
        fresh[0] = held is None or held["block"] != block[0] or held["infile"] != infile[0]
        begins = np.flatnonzero(fresh | start)
        # Line number inside the block, counted on from the held piece.
        at = np.arange(1, n + 1)
        base = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        line = np.where(base >= 0, at - base, at + (held["last"] if held and not fresh[0] else 0))
        if len(begins) == 0 or begins[0] > 0:
            upto = begins[0] if len(begins) else n
            held["parts"].extend(value[:upto])
            held["last"], held["closed"] = int(line[upto - 1]), bool(ends_here[upto - 1])
        if len(begins) == 0:
            continue
        if held is not None:
            yield rows(held, bool(fresh[begins[0]]))
        ends = np.append(begins[1:], n)
        entry = value[begins].copy()
        for i in np.flatnonzero(ends - begins > 1):
            entry[i] = "\n".join(value[begins[i] : ends[i]])
        out = pd.DataFrame(
            {
                "infile": infile[begins],
                "block": block[begins],
                "first": line[begins],
                "last": line[ends - 1],
                # A block's first piece may go on with the last one of the block before.
                "head": fresh[begins] if by_end else ~start[begins],
                "tail": np.append(fresh[begins[1:]], False),
                "closed": ends_here[ends - 1],
                "format": kind[begins],
                "entry": entry,
            }
        )
        final = out.iloc[-1]
        held = {k: final[k] for k in ("infile", "block", "first", "last", "head", "closed", "format")} | {
            "parts": list(value[begins[-1] :])
        }
        yield out.iloc[:-1]
    if held is not None:
        yield rows(held, True)


@dataclass(frozen=True)
class Entries:
    """Stitched entries and the table of blocks they came from."""

    entries: DataFrame  # infile, block, lineno, n_lines, format, entry
    blocks: DataFrame  # infile, block, offset, n_lines
    few_blocks: bool  # whether one row per block may be broadcast

    def per_block(self, table: DataFrame) -> DataFrame:
        """A table with at most one row per block, broadcast while that is small."""
        return F.broadcast(table) if self.few_blocks else table


def stitch_files(
    lines: DataFrame, wrapper: str | None = None, patterns: dict[str, str] = ENTRY_PATTERNS, end_pattern: str | None = None
) -> Entries:
    """Entries of all files; a line that starts no entry belongs to the entry before.

    With ``end_pattern`` entries are known by their last line instead, and what
    follows the last such line of a file is an entry too.

    ``lineno`` is the last physical line of an entry.  The pieces are written
    once to the shared folder, apart by format and by whether they lie at a
    block edge, so every later step sees the same blocks and reads its own part.
    Text is joined inside its block; of all pieces only the first and the last
    of a block meet others, and whether two of them are one entry is known from
    their flags: the merge does not depend on how blocks are grouped.
    """
    value = F.col("value")
    stripped = lines.select("infile", "block", strip_wrapper(value, wrapper).alias("value"))
    ends = [] if end_pattern is None else [value.rlike(end_pattern).alias("ends")]
    pieces = staged(
        stripped.select("infile", "block", entry_format(value, patterns).alias("format"), *ends, "value")
        .mapInPandas(_join_pieces, _PIECES)
        .withColumn("edge", F.col("head") | F.col("tail")),
        "pieces",
        ("edge", "format"),
    )
    edges = pieces.filter(F.col("edge"))
    before = Window.partitionBy("infile").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # The last piece of a block ends on its last line.
    blocks = edges.filter(F.col("tail")).select("infile", "block", F.col("last").alias("n_lines")).withColumn(
        "offset", F.coalesce(F.sum("n_lines").over(before), F.lit(0))
    )
    inner = pieces.filter(~F.col("edge")).select(
        "infile",
        "block",
        "last",
        (F.col("last") - F.col("first") + 1).alias("n_lines"),
        "format",
        "entry",
        F.col("block").alias("last_block"),
    )
    # Two pieces per block at most: number their entries on the keys alone.
    along = Window.partitionBy("infile").orderBy("block", "first")
    goes_on = F.col("head") if end_pattern is None else ~F.lag("closed", 1, True).over(along)
    numbered = (
        edges.select("infile", "block", "first", goes_on.alias("goes_on"))
        .withColumn("entry_no", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(along))
        .drop("goes_on")
    )
    joined = (
        edges.join(numbered, ["infile", "block", "first"])
        .groupBy("infile", "entry_no")
        .agg(F.array_sort(F.collect_list(F.struct("block", "first", "last", "format", "entry"))).alias("p"))
        .select(
            "infile",
            F.get("p", F.lit(0))["block"].alias("block"),
            F.element_at("p", -1)["last"].alias("last"),
            F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["last"] - x["first"] + 1).alias("n_lines"),
            F.get("p", F.lit(0))["format"].alias("format"),
            F.array_join(F.transform("p", lambda x: x["entry"]), "\n").alias("entry"),
            F.element_at("p", -1)["block"].alias("last_block"),
        )
    )
    few = edges.filter(F.col("tail")).limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    offsets = blocks.select("infile", F.col("block").alias("last_block"), "offset")
    entries = (
        inner.unionByName(joined)
        .join(F.broadcast(offsets) if few else offsets, ["infile", "last_block"])
        .select("infile", "block", (F.col("offset") + F.col("last")).alias("lineno"), "n_lines", "format", "entry")
    )
    return Entries(entries, blocks.select("infile", "block", "offset", "n_lines"), few)


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the lines of each block from 1."""
    last: tuple | None = None
    count = 0
    for pdf in batches:
        if not len(pdf):
            continue
        keys = list(zip(pdf["infile"], pdf["block"]))
        at = np.arange(len(pdf))
        fresh = np.array([keys[0] != last] + [a != b for a, b in zip(keys, keys[1:])])
        base = np.maximum.accumulate(np.where(fresh, at, -1))
        pdf["row"] = np.where(base >= 0, at - base + 1, at + 1 + count)
        last, count = keys[-1], int(pdf["row"].iloc[-1])
        yield pdf


def number_lines(lines: DataFrame) -> DataFrame:
    """``lineno`` of every line: its number in its block, and the lines of the blocks before.

    The lines never move: only counts by block meet.  They are read twice, once to be counted.
    """
    counts = staged(lines.groupBy("infile", "block").agg(F.count("*").alias("n")), "line-counts")
    before = Window.partitionBy("infile").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    few = counts.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    numbered = lines.mapInPandas(_number, "infile string, block bigint, value string, row bigint")
    numbered = numbered.join(F.broadcast(offsets) if few else offsets, ["infile", "block"])
    return numbered.select("infile", "block", "value", (F.col("offset") + F.col("row")).cast("bigint").alias("lineno"))
