"""SimHash near-dedup with pigeonhole blocks.

A fingerprint has a bit set where more than half of the document's shingle hashes have it set.  Fingerprints link at
``distance`` or fewer differing bits.  The 64 bits are cut into ``blocks`` blocks; two linked fingerprints agree on
at least ``blocks - distance`` of them, so a join on every choice of that many blocks meets all links.  The number of
blocks follows the number of fingerprints: keys keep some bits more than fingerprints need to be told apart, so chance
meetings stay rare at any size; every choice is exact.

Equal fingerprints are one row before the join, whatever the size of their group.  Links are connected by alternating
large-star and small-star steps; every step is a table in the shared folder.

Texts that are less alike differ in more bits than blocks of 64 can tell apart.  ``wide_prints`` gives them longer fingerprints,
and of each block the bit that the shingles agree on most: the last one to turn when a text is edited.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plumeline.llm import words as W
from plumeline.session import staged

SHINGLE = 3
SEED = 42
_PART_BYTES = 256 << 10
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MANY_ROUNDS = 60
#: Bits of a block of a wide fingerprint, and of the mark that names its strongest bit and the value of that.
MARK_BLOCK = 16
MARK_BITS = 5
#: Eight bits as eight counters of a byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_of(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number; 0 without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _PART_BYTES):
        part = hashes[lo : lo + _PART_BYTES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def bit_sums(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many hashes of each document have each of the 64 bits; ``bounds`` are the first hash of every document, and their number."""
    first = bounds[:-1]
    # A counter of a byte holds 255 hashes.
    parts = np.union1d(first, np.arange(0, len(hashes), 255))
    data = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    sums = [np.add.reduceat(_LANES[data[:, k]], parts).view(np.uint8).reshape(-1, 8) for k in range(8)]
    return np.add.reduceat(np.concatenate(sums, axis=1), np.searchsorted(parts, first), axis=0, dtype=np.int32)


def wide_prints(hashes: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``words`` numbers of 64 bits, and the mark of every block of ``MARK_BLOCK`` bits.

    Every document has a hash.  A bit is set if more than half of the document's hashes, scrambled anew for each number, have it
    set.  A mark is the place of the bit that has the largest majority in its block, and its value.
    """
    n, blocks = len(bounds) - 1, 64 // MARK_BLOCK
    prints, marks = np.zeros((n, words), np.uint64), np.zeros((n, words * blocks), np.uint8)
    if not n:
        return prints, marks
    counts = np.diff(bounds).astype(np.int32)[:, None]
    for word in range(words):
        lead = 2 * bit_sums(W.mix(hashes, word + 1), bounds) - counts
        prints[:, word] = np.packbits(lead > 0, axis=1, bitorder="little").view("<u8").ravel()
        lead = lead.reshape(n, blocks, MARK_BLOCK)
        at = np.abs(lead).argmax(2)
        value = np.take_along_axis(lead, at[:, :, None], 2)[:, :, 0] > 0
        marks[:, word * blocks : (word + 1) * blocks] = 2 * at + value
    return prints, marks


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            prints = np.array([fingerprint_of(t.as_py(), size) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(prints.view(np.int64))], ["doc_id", "text_key", "fingerprint"]
            )

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_key, fingerprint)``: a hash of the text, the fingerprint as a signed 64-bit number."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(_fingerprints(size), "doc_id long, text_key long, fingerprint long")


def block_count(distinct: int, distance: int, spare_bits: int = 6) -> int:
    """The fewest blocks (``distance`` + 2 at least) whose keys have ``spare_bits`` more bits than a number below ``distinct``."""
    for blocks in range(distance + 2, 64):
        if 64 * (blocks - distance) // blocks >= distinct.bit_length() + spare_bits:
            return blocks
    return 64


def block_keys(fingerprint: Column, blocks: int, distance: int) -> Column:
    """An array of ``(choice, key)``: the bits of every choice of ``blocks - distance`` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(itertools.combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        mask -= 1 << 64 if mask >> 63 else 0
        keys.append(F.struct(F.lit(number).alias("choice"), fingerprint.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*keys)


def links(prints: DataFrame, distance: int = 3, blocks: int | None = None) -> DataFrame:
    """Pairs ``(low, high)`` of distinct fingerprints with at most ``distance`` differing bits, each once.

    ``prints`` has a column ``fingerprint`` without repeats.
    """
    blocks = blocks or block_count(prints.count(), distance)
    keyed = prints.select("fingerprint", F.explode(block_keys(F.col("fingerprint"), blocks, distance)).alias("k")).select(
        "fingerprint", "k.choice", "k.key"
    )
    a = keyed.select(F.col("fingerprint").alias("low"), F.col("choice").alias("choice_a"), F.col("key").alias("key_a"))
    b = keyed.select(F.col("fingerprint").alias("high"), F.col("choice").alias("choice_b"), F.col("key").alias("key_b"))
    same = (F.col("choice_a") == F.col("choice_b")) & (F.col("key_a") == F.col("key_b"))
    near = F.bit_count(F.col("low").bitwiseXOR(F.col("high"))) <= distance
    met = a.join(b, same & (F.col("low") < F.col("high")) & near)
    return met.select("low", "high").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(low, high)``; the root is the smallest node that can be reached."""
    now = staged(edges.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).filter("low <> high"), "links")
    # A checksum of the edges; a round that changes nothing ends the loop.
    seen = None
    for _ in range(_MANY_ROUNDS):
        both = now.union(now.select("high", "low"))
        least = both.groupBy("low").agg(F.min("high").alias("m")).select("low", F.least("low", "m").alias("m"))
        large = both.filter("high > low").join(least, "low").select(F.col("m").alias("low"), "high").distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(least, "high")
        stars = small.select(F.col("m").alias("low"), F.explode(F.array("low", "high")).alias("high")).filter("low < high").distinct()
        now = staged(stars, "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
                now.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
            )
        seen = state
    raise RuntimeError(f"links did not settle in {_MANY_ROUNDS} rounds")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, fingerprint (signed), component_id (the smallest doc_id that can be reached).

    A null text is empty; texts without words have fingerprint 0.  Null ids take part and count as larger than all
    others: a group of only null ids has a null component_id.
    """
    prints = staged(fingerprints(docs, size), "fingerprints")
    reps = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "reps")
    tree = staged(components(links(reps, distance)), "tree")
    rooted = reps.join(tree, reps["fingerprint"] == tree["node"]).select("root", "node", "first_id")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = rooted.select("root", F.col("node").alias("fingerprint")).join(smallest, "root").select("fingerprint", "component_id")
    owner = reps.join(linked, "fingerprint", "left").select(
        "fingerprint", F.coalesce("component_id", "first_id").alias("component_id")
    )
    return prints.join(owner, "fingerprint").select("doc_id", "text_key", "fingerprint", "component_id")


def hex_fingerprint(column: str = "fingerprint") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, size: int = SHINGLE, distance: int = 3) -> DataFrame:
    """The documents whose id is the smallest of their component, equal rows of one id once; all columns are returned.

    Documents without id are no smaller than any other, and are kept once for each text.
    """
    groups = near_duplicates(docs, size, distance)
    id_, text, dropped_id, dropped_text = W.free_names(docs.columns, "id_of_row", "key_of_text", "dropped_id", "dropped_text")
    dropped = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(dropped_id), F.col("text_key").alias(dropped_text)).distinct()
    keyed = docs.withColumns({id_: docs["doc_id"].cast("bigint"), text: F.xxhash64(docs["text"].cast("string"))})
    kept = keyed.join(dropped, (keyed[id_] == dropped[dropped_id]) & (keyed[text] == dropped[dropped_text]), "left_anti")
    return kept.dropDuplicates(["doc_id", text]).select(*docs.columns)
