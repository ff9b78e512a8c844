"""Collocations: frequent phrases whose words belong together, counted in tiles of frequency-ranked ids.

Every language has statistics of its own (``und`` where it is null).  A symbol is a frequent phrase of a language; those of
one word come first:

1. Documents are coded in blocks of bounded size: a dictionary of the block's words and the sequence of their codes, 0
   between pieces.  Only dictionaries, never texts, meet in the shuffle.  Frequent words get ids in order of frequency.
2. Two neighbouring symbols are a phrase of one word more.  Pairs of a block are counted there.  Their cells lie in tiles of
   ``TILE`` by ``TILE`` ids; tiles are dealt to buckets, and a block sends each bucket its cells packed, as sorted
   differences.  A bucket adds a tile up by direct address (``bincount`` into a dense table) if many of its cells are used,
   else as sorted coordinates.
3. The frequent pairs of a bucket are ranked by frequency again; the ranks of all buckets, taken in turn, are the ids of the
   next round's symbols.  Blocks get the ids of their pairs back, bucket by bucket.  Rounds go up to the longest phrase: a
   phrase is frequent only if the two phrases it overlaps are.
4. Phrases are scored by their weakest cut, and those that mostly occur inside a longer frequent phrase go.  A longer
   phrase of any length has one of one word more between, so only these have to be looked at.

Null, empty and wordless texts have no words; every row counts, repeated ones and those without id too.  A long text is a
block of its own.  An empty table gives no rows.  There may be 2**32 frequent phrases of a length, beyond that it raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumeline.llm import words as W
from plumeline.session import staged

#: Ids on a side of a tile: 8 bits.
TILE = 256
#: From so many entries on, a tile is a dense table.
DENSE = TILE * TILE // 16
BLOCK_BYTES = 8 << 20
#: Buckets of tiles: so many at least, and one for so many blocks.
LEAST_BUCKETS, BUCKET_BLOCKS = 64, 4
#: Blocks whose pairs of a bucket get their ids in one task.
REPLY_BLOCKS = 64
LONGEST = 4
_FLUSH = 1 << 19
_PAIRS = "batch long, bucket int, first int, data binary"


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _packed(seq: np.ndarray) -> pa.Array:
    return pa.array([zstandard.ZstdCompressor(1).compress(seq.astype("<i4").tobytes())], pa.binary())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i4").astype(np.int64)


def code_words(buf: np.ndarray, offsets: np.ndarray, kinds: np.ndarray):
    """The words of documents of some kinds: dictionary (word, kind, count) and codes from 1, 0 before every piece."""
    breaks = np.zeros(256, bool)
    breaks[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
    solid = ~breaks
    solid[[0x20, 0x09]] = False
    buf = W.lower_ascii(buf)
    starts, ends, first = W.find_words(buf, offsets, solid)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    piece = np.concatenate([[0], np.cumsum(breaks[buf])])[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (piece[1:] != piece[:-1])
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(buf[solid[buf]])])
    coded = column.dictionary_encode()
    word = coded.indices.to_numpy().astype(np.int64)
    width = int(kinds.max(initial=0)) + 1
    found, code, count = np.unique(word * width + kinds[doc], return_inverse=True, return_counts=True)
    seq = np.zeros(len(starts) + int(fresh.sum()), np.int64)
    seq[np.arange(len(starts)) + np.cumsum(fresh)] = code + 1
    return coded.dictionary.take(pa.array(found // width)).cast(pa.large_string()).cast(pa.string()), found % width, count, seq


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        names, kinds = langs.dictionary, langs.indices.to_numpy()
        buf, offsets = W.text_buffer(batch.column("text"))
        for lo, hi, part, offs in W.groups(buf, offsets, BLOCK_BYTES):
            words, kind, count, seq = code_words(part, offs, kinds[lo:hi])
            if len(words):
                ends = pa.array([0, len(words)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), _packed(seq), pa.ListArray.from_arrays(ends, names.take(pa.array(kind))),
                        pa.ListArray.from_arrays(ends, words), _lists(count, pa.int64()),
                    ],
                    ["batch", "seq", "lang", "word", "n"],
                )
                number += 1


def cells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of ids as one number: the tile above, the place in the tile below."""
    if max(a.max(initial=0), b.max(initial=0)) >= 1 << 32:
        raise ValueError("more than 2**32 frequent phrases")
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    low, eight = np.uint64(255), np.uint64(8)
    return (a >> eight) << np.uint64(40) | (b >> eight) << np.uint64(16) | (a & low) << eight | (b & low)


def pairs_of(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a pair."""
    low, eight = np.uint64(255), np.uint64(8)
    a = (cell >> np.uint64(40)) << eight | (cell >> eight) & low
    b = (cell >> np.uint64(16) & np.uint64(0xFFFFFF)) << eight | cell & low
    return a.astype(np.int64), b.astype(np.int64)


def bucket_of(cell: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that a cell's tile is dealt to."""
    return (W.mix(cell >> np.uint64(16)) % np.uint64(buckets)).astype(np.int32)


def pair_up(seq: np.ndarray, codes: np.ndarray, ids: np.ndarray, buckets: int):
    """Neighbouring symbols of a block: the sequence of pair codes (0: not both are symbols), and each pair's bucket, cell and count.

    ``ids`` has the symbols of some ``codes`` of the sequence; all other codes are none.  Pairs are in order of bucket and
    cell, and their codes count from 1.
    """
    table = np.full(max(int(seq.max(initial=0)), int(codes.max(initial=0))) + 1, -1, np.int64)
    table[codes] = ids
    symbols = table[seq]
    both = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
    cell, code, count = np.unique(cells(symbols[both], symbols[both + 1]), return_inverse=True, return_counts=True)
    bucket = bucket_of(cell, buckets)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) + 1
    pairs = np.zeros(max(len(seq) - 1, 0), np.int64)
    pairs[both] = place[code]
    return pairs, bucket[order], cell[order], count[order]


def pack_cells(cell: np.ndarray, count: np.ndarray) -> bytes:
    steps = np.diff(cell, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(1).compress(len(cell).to_bytes(8, "little") + steps.astype("<u8").tobytes() + count.astype("<u8").tobytes())


def unpack_cells(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(data[:8], "little")
    return np.cumsum(np.frombuffer(data, "<u8", n, 8), dtype=np.uint64), np.frombuffer(data, "<u8", n, 8 + 8 * n).astype(np.int64)


def _pair(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["batch", "bucket", "first", "data"]
        for batch in batches:
            for k in range(batch.num_rows):
                known = batch.column("known").slice(k, 1).flatten()
                codes, ids = (known.field(name) for name in ("code", "id"))
                if pa.types.is_binary(codes.type):
                    codes, ids = (np.frombuffer(b"".join(x.to_pylist()), np.int64) for x in (codes, ids))
                seq, bucket, cell, count = pair_up(_unpacked(batch.column("seq")[k].as_py()), np.asarray(codes, np.int64), np.asarray(ids, np.int64), buckets)
                number = batch.column("batch")[k].as_py()
                first = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(first, len(cell))[1:]
                parts = [pack_cells(cell[lo:hi], count[lo:hi]) for lo, hi in zip(first, ends, strict=True)]
                columns = [pa.array([number] * len(first), pa.int64()), pa.array(bucket[first]), pa.array(first, pa.int32()), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
                # The sequence itself is a row without bucket.
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.int32()), pa.array([None], pa.int32()), _packed(seq)], names)

    return run


class TileCounts:
    """Sums of pair counts: dense tables for full tiles, sorted cells for the rest."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.cell, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, cell: np.ndarray, n: np.ndarray) -> None:
        self.new.append((cell, n))
        self.waiting += len(cell)
        if self.waiting >= max(_FLUSH, len(self.cell)):
            self.flush()

    def flush(self) -> None:
        cell = np.concatenate([self.cell, *(c for c, _ in self.new)])
        n = np.concatenate([self.n, *(c for _, c in self.new)])
        self.new, self.waiting = [], 0
        order = np.argsort(cell, kind="stable")
        cell, n = cell[order], n[order]
        tile = cell >> np.uint64(16)
        heads = np.flatnonzero(np.diff(tile)) + 1
        bounds = np.concatenate([[0], heads, [len(cell)]]) if len(cell) else np.zeros(1, np.int64)
        left = np.ones(len(cell), bool)
        full = np.diff(bounds) >= DENSE
        for k in np.flatnonzero(full | np.isin(tile[bounds[:-1]], list(self.dense))):
            lo, hi = bounds[k], bounds[k + 1]
            table = self.dense.setdefault(int(tile[lo]), np.zeros(TILE * TILE, np.int64))
            table += np.bincount((cell[lo:hi] & np.uint64(0xFFFF)).astype(np.int64), n[lo:hi], TILE * TILE).astype(np.int64)
            left[lo:hi] = False
        cell, n = cell[left], n[left]
        if len(cell):
            fresh = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            cell, n = cell[fresh], np.add.reduceat(n, fresh)
        self.cell, self.n = cell, n

    def at_least(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        self.flush()
        use = self.n >= least
        found, counts = [self.cell[use]], [self.n[use]]
        for tile, table in self.dense.items():
            place = np.flatnonzero(table >= least)
            found.append(np.uint64(tile << 16) | place.astype(np.uint64))
            counts.append(table[place])
        return np.concatenate(found), np.concatenate(counts)


def _count_tiles(least: int, buckets: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TileCounts()
        for batch in batches:
            for raw in batch.column("data"):
                counts.add(*unpack_cells(raw.as_py()))
        cell, f = counts.at_least(least)
        order = np.lexsort((cell, -f))
        a, b = pairs_of(cell[order])
        bucket = key[0].as_py()
        ids = np.arange(len(order)) * buckets + bucket
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), bucket), pa.int32()), pa.array(a), pa.array(b), pa.array(f[order]), pa.array(ids)], ["bucket", "a", "b", "f", "id"]
        )

    return run


def _reply(pairs: pa.Table, found: pa.Table) -> pa.Table:
    """Codes and ids of the frequent pairs of some blocks' parts of one bucket."""
    cell = cells(*(found.column(c).to_numpy() for c in ("a", "b")))
    order = np.argsort(cell)
    cell, ids = cell[order], found.column("id").to_numpy()[order]
    out = []
    for batch, first, raw in zip(*(pairs.column(c).to_pylist() for c in ("batch", "first", "data")), strict=True):
        own, _ = unpack_cells(raw)
        at = np.minimum(np.searchsorted(cell, own), max(len(cell) - 1, 0))
        hit = np.flatnonzero(cell[at] == own) if len(cell) else np.zeros(0, np.int64)
        if len(hit):
            out.append((batch, (hit + first + 1).astype("<i8").tobytes(), ids[at[hit]].astype("<i8").tobytes()))
    columns = zip(*out, strict=True) if out else ([], [], [])
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["batch", "code", "id"])


def ranked(rows: DataFrame, *by: Column) -> DataFrame:
    """``rows`` with ``id``, counted from 1 in the order ``by``: a range sort and prefix sums over its partitions."""
    place = F.monotonically_increasing_id()
    placed = staged(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", place), "ranked")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the sort.
    starts = placed.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("id", F.col("start") + row + 1).drop("part", "place", "start")


def _next_pairs(sequences: DataFrame, known: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Sequences and packed pairs of all blocks; ``known`` has ``batch, code, id``."""
    # A block's dictionary bounds its list.
    lists = known.groupBy("batch").agg(F.collect_list(F.struct("code", "id")).alias("known"))
    both = staged(sequences.join(lists, "batch").mapInArrow(_pair(buckets), _PAIRS).withColumn("part", F.col("bucket").isNull()), "pairs", ("part",))
    return both.filter("part").select("batch", F.col("data").alias("seq")), both.filter("NOT part").drop("part")


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables of phrases of 1, 2, ... ``longest`` words that occur ``least`` times or more, and ``lang, n`` of all words.

    A phrase has ``id, lang, words, f``, the ids ``a`` and ``b`` of its parts without its last and its first word, and the
    counts of its ``heads`` and ``tails`` of 1, 2, ... words.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    coded = staged(rows.mapInArrow(_code, "batch long, seq binary, lang array<string>, word array<string>, n array<long>"), "coded")
    blocks = coded.count()
    buckets, groups = max(LEAST_BUCKETS, blocks // BUCKET_BLOCKS), blocks // REPLY_BLOCKS + 1
    entries = coded.select("batch", F.posexplode(F.arrays_zip("lang", "word", "n")).alias("code", "entry")).select("batch", (F.col("code") + 1).alias("code"), "entry.*")
    sums = staged(entries.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = sums.groupBy("lang").agg(F.sum("f").alias("n"))
    words = ranked(sums.filter(F.col("f") >= least), F.desc("f"), F.col("lang"), F.col("word"))
    levels = [staged(words.select("id", "lang", F.array("word").alias("words"), "f", F.array("f").alias("heads"), F.array("f").alias("tails")), "phrases")]
    known = entries.join(levels[0].select("lang", F.col("words")[0].alias("word"), "id"), ["lang", "word"]).select("batch", "code", "id")
    sequences = coded.select("batch", "seq")
    for size in range(2, longest + 1):
        sequences, packed = _next_pairs(sequences, known, buckets)
        found = "bucket int, a long, b long, f long, id long"
        pairs = staged(packed.select("bucket", "data").groupBy("bucket").applyInArrow(_count_tiles(least, buckets), found), "frequent")
        front = levels[-1].select(F.col("id").alias("a"), "lang", F.col("words").alias("front"), F.col("heads").alias("front_heads"))
        back = levels[-1].select(F.col("id").alias("b"), F.col("words").alias("back"), F.col("tails").alias("back_tails"))
        grown = pairs.join(front, "a").join(back, "b").select(
            "id", "a", "b", "lang", "f",
            F.concat("front", F.slice("back", -1, 1)).alias("words"),
            F.concat("front_heads", F.array("f")).alias("heads"),
            F.concat("back_tails", F.array("f")).alias("tails"),
        )
        levels.append(staged(grown, "phrases"))
        # A bucket's frequent pairs meet the blocks in groups, so that no task has all of them.
        dealt = packed.withColumn("part", F.pmod(F.xxhash64("batch"), F.lit(groups)).cast("int")).groupBy("bucket", "part")
        copies = pairs.select("bucket", "a", "b", "id", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part")).groupBy("bucket", "part")
        known = dealt.cogroup(copies).applyInArrow(_reply, "batch long, code binary, id binary")
    return levels, totals


def _weakest_cut(size: int) -> Column:
    """Score, place and parts of the cut with the least score; decimals of 38 digits, so that no product overflows."""
    wide = lambda c: c.cast("decimal(20,0)")
    cuts = []
    for k in range(1, size):
        left, right = F.col("heads")[k - 1], F.col("tails")[size - k - 1]
        whole = F.call_function("div", wide(F.col("f")) * F.lit(2000000).cast("decimal(7,0)"), wide(left) + wide(right))
        cuts.append(F.struct(whole.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def collocations(docs: DataFrame, least: int = 30, longest: int = LONGEST, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language."""
    levels, totals = frequent_phrases(docs, least, longest)
    found = []
    for size in range(2, longest + 1):
        rows = levels[size - 1]
        if size < longest:
            longer = levels[size]
            around = longer.select(F.col("a").alias("id"), "f").unionByName(longer.select(F.col("b").alias("id"), "f"))
            rows = rows.join(around.groupBy("id").agg(F.max("f").alias("most")), "id", "left")
            wide = [F.col(c).cast("decimal(20,0)") for c in ("most", "f")]
            rows = rows.filter(F.col("most").isNull() | (wide[0] * 5 < wide[1] * 4))
        found.append(rows.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), _weakest_cut(size).alias("cut")))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # Only the first rows of every task reach the language's window.
    best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
