"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment.

1. The n-grams of the test items are counted over the whole corpus.
2. Every n-gram that is rare in the corpus, at most ``RARE_SHARE`` of all its n-grams, is a seed.  Each item is cut
   into strata of ``STRATUM`` n-grams; a stratum without a rare one has its rarest as a seed (by powers of two, the
   first of equals), so a passage that is everywhere in the corpus still has its seeds.
   N-grams not far more frequent than the rarest of their item are seeds too: a copied item makes all its own frequent.
   All other n-grams of the items are weak seeds.
3. Seeds meet the documents; hits of one item whose regions overlap are one candidate, if one is of a seed or two of weak
   seeds lie near one diagonal.
4. The candidate's region is aligned to the item by Smith-Waterman over words (match 2, mismatch -1, gap -1), and again
   what is left on both sides of a match until nothing reaches the threshold.  The
   score is the alignment's share of a perfect one; a bound by common words skips regions that can't reach it.

Words are runs of letters, digits and bytes above 0x7F, A to Z in lower case, so punctuation does not matter.  Test
items go to the tasks in blocks of ``ITEM_BYTES`` of text; a larger benchmark takes more passes over the documents.
Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumeline.llm import words as W

SEED_WORDS = 3
STRATUM = 4
RARE_SHARE = 1e-6
#: Occurrences up to which an n-gram is rare in a small corpus.
RARE_LEAST = 20
#: Times the least count of an item's n-grams up to which its others are seeds.
ITEM_LEAST = 8
ITEM_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1


def _solid() -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[lo:hi] = True
    return table


def hashed_words(buf: np.ndarray, offsets: np.ndarray):
    starts, ends, first = W.find_words(buf, offsets, _solid())
    return W.word_hashes(W.lower_ascii(buf), starts, ends), first


def best_end(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment of ``a`` and ``b``: its score, and where it ends in both (exclusive; first of equals)."""
    steps = np.arange(len(b) + 1) * -GAP
    row = np.zeros(len(b) + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(a):
        diagonal = row[:-1] + np.where(b == word, MATCH, MISMATCH)
        row = np.maximum(row + GAP, 0)
        row[1:] = np.maximum(row[1:], diagonal)
        row = np.maximum.accumulate(row + steps) - steps
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The score of the best local alignment and its first and last (exclusive) word in ``b``."""
    score, i, j = best_end(a, b)
    if not score:
        return 0, 0, 0
    _, _, back = best_end(a[:i][::-1], b[:j][::-1])
    return score, j - back, j


class Items:
    """The test items of one block: their words and n-grams."""

    def __init__(self, ids: list[int], texts: list[str | None], size: int):
        buf, offsets = W.text_buffer(pa.array(texts, pa.string()))
        self.words, self.first = hashed_words(buf, offsets)
        self.ids, self.size = np.array(ids, np.int64), size
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.diff(self.first)
        # Items below the seed size have one n-gram: all their words.
        for n in sorted({min(size, int(x)) for x in lengths if x}):
            hashes, begin, item = W.window_hashes(self.words, self.first, n)
            use = (lengths[item] >= size) if n == size else (lengths[item] == n)
            self.grams[n] = hashes[use], begin[use] - self.first[item[use]], item[use]

    def of(self, item: int) -> np.ndarray:
        return self.words[self.first[item] : self.first[item + 1]]


class Probe:
    """A sorted set of hashes with a bitmap in front."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.unique(hashes)
        self.bitmap = np.zeros(1 << 22, bool)
        self.bitmap[self.keys >> np.uint64(42)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are in the set, and their number there."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bitmap[hashes >> np.uint64(42)])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


def _count_grams(grams: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = {n: Probe(h) for n, h in grams.items()}
        counts = {n: np.zeros(len(p.keys), np.int64) for n, p in probes.items()}
        windows = dict.fromkeys(probes, 0)
        for batch in batches:
            buf, offsets = W.text_buffer(batch.column("text"))
            for _, _, part, offs in W.groups(buf, offsets):
                words, first = hashed_words(part, offs)
                for n, probe in probes.items():
                    hashes = W.window_hashes(words, first, n)[0]
                    _, key = probe.find(hashes)
                    counts[n] += np.bincount(key, minlength=len(probe.keys))
                    windows[n] += len(hashes)
        for n, c in counts.items():
            at = np.flatnonzero(c)
            # The row without a gram has the number of all n-grams.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at) + 1, n, np.int32)),
                    pa.array([None, *probes[n].keys[at].view(np.int64).tolist()], pa.int64()),
                    pa.array(np.append(windows[n], c[at])),
                ],
                ["size", "gram", "n"],
            )

    return run


def choose_seeds(items: Items, counts: dict[tuple[int, int | None], int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By n-gram size: sorted seed hashes with their place in the item, their item, and whether one hit is enough.

    ``counts`` has the corpus count of ``(size, n-gram)`` and, for the n-gram None, of all n-grams.  An n-gram that the
    corpus does not have can find nothing and is no seed.
    """
    seeds = {}
    for n, (hashes, place, item) in items.grams.items():
        seen = np.array([counts.get((n, h), 0) for h in hashes.view(np.int64).tolist()], np.int64)
        rare = (seen > 0) & (seen <= max(RARE_LEAST, RARE_SHARE * counts.get((n, None), 0)))
        stratum = place // STRATUM
        scale = np.where(seen > 0, np.log2(np.maximum(seen, 1)).astype(np.int64), 64)
        order = np.lexsort((place, scale, stratum, item))
        head = np.ones(len(order), bool)
        head[1:] = (item[order[1:]] != item[order[:-1]]) | (stratum[order[1:]] != stratum[order[:-1]])
        first = np.zeros(len(order), bool)
        first[order[head]] = True
        least = np.full(len(items.ids), np.iinfo(np.int64).max // ITEM_LEAST)
        np.minimum.at(least, item[seen > 0], seen[seen > 0])
        # The rarest of a stratum is rare if any is.
        strong = rare | first | (seen <= ITEM_LEAST * least[item])
        pick = np.flatnonzero(seen > 0)
        pick = pick[np.argsort(hashes[pick], kind="stable")]
        seeds[n] = hashes[pick], place[pick], item[pick], strong[pick]
    return seeds


def _candidates(items: Items, seeds, words: np.ndarray, first: np.ndarray):
    """``(document, item, from, to)``: word ranges around seed hits, cut at the document's ends."""
    lengths = np.diff(items.first)
    found = []
    for n, (hashes, place, item, strong) in seeds.items():
        probe = Probe(hashes)
        lo = np.searchsorted(hashes, probe.keys, "left")
        count = np.searchsorted(hashes, probe.keys, "right") - lo
        all_hashes, begin, docs = W.window_hashes(words, first, n)
        at, key = probe.find(all_hashes)
        # A seed of several items hits each of them.
        times = count[key]
        at = np.repeat(at, times)
        s = np.repeat(lo[key], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        found.append((docs[at], item[s], begin[at] - place[s], strong[s]))
    if not found:
        return
    docs, item, start, strong = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(docs):
        return
    order = np.lexsort((start, item, docs))
    docs, item, start, strong = docs[order], item[order], start[order], strong[order]
    pad = lengths[item] // 2 + 4
    same = (docs[1:] == docs[:-1]) & (item[1:] == item[:-1])
    new = np.ones(len(order), bool)
    new[1:] = ~same | (np.diff(start) > lengths[item[1:]] + 2 * pad[1:])
    strong[1:] |= same & (np.diff(start) <= pad[1:])
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(order))
    use = np.logical_or.reduceat(strong, heads)
    for a, b in zip(heads[use].tolist(), ends[use].tolist(), strict=True):
        d, i = int(docs[a]), int(item[a])
        yield d, i, max(int(start[a] - pad[a]), int(first[d])), min(int(start[b - 1] + lengths[i] + pad[a]), int(first[d + 1]))


def matches(items: Items, seeds, buf: np.ndarray, offsets: np.ndarray, least: float):
    """``(document, item, score, start, stop)`` of all aligned passages; places count words of the document."""
    words, first = hashed_words(buf, offsets)
    for d, i, lo, hi in _candidates(items, seeds, words, first):
        item, parts = items.of(i), [(lo, hi)]
        least_score = least * MATCH * len(item)
        while parts:
            lo, hi = parts.pop()
            region = words[lo:hi]
            if MATCH * min(int(np.isin(region, item).sum()), int(np.isin(item, region).sum())) < least_score:
                continue
            score, start, stop = align(item, region)
            if score and score >= least_score:
                yield d, i, score / (MATCH * len(item)), lo + start - int(first[d]), lo + stop - int(first[d])
                parts += [(lo + stop, hi), (lo, lo + start)]


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in parts of about ITEM_BYTES, by a hash of the item."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = size // ITEM_BYTES + 1
    return [rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) for k in range(parts)]


def _prepared(docs: DataFrame, block: DataFrame, size: int):
    # A block has a bounded size; it is the query set that all documents are held against.
    rows = block.orderBy("item_id", "text").toArrow()
    items = Items(rows.column("item_id").fill_null(-1).to_pylist(), rows.column("text").to_pylist(), size)
    counted = (
        docs.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(_count_grams({n: g[0] for n, g in items.grams.items()}), "size int, gram long, n long")
        .groupBy("size", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = {(s, g): n for s, g, n in zip(*(counted.column(c).to_pylist() for c in ("size", "gram", "n")), strict=True)}
    return items, choose_seeds(items, counts)


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, size: int = SEED_WORDS) -> DataFrame:
    """``doc_id, item_id, score, start, stop`` of every passage that aligns to a test item with ``least`` or more.

    Items without words and null texts match nothing.  A null id stays null.  An item shorter than ``size`` words is
    looked for as a whole.
    """
    schema = "doc_id long, item_id long, score double, start long, stop long"
    out = None
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for block in _blocks(benchmark):
        items, seeds = _prepared(docs, block, size)
        part = rows.mapInArrow(_passages(items, seeds, least), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _passages(items: Items, seeds, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            buf, offsets = W.text_buffer(batch.column("text"))
            for lo, _, part, offs in W.groups(buf, offsets):
                rows = [(ids[lo + d], int(items.ids[i]), s, a, b) for d, i, s, a, b in matches(items, seeds, part, offs, least)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "start", "stop"]
                )

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, size: int = SEED_WORDS) -> DataFrame:
    """The documents without any contaminated passage, with all their columns."""
    (name,) = W.free_names(docs.columns, "scanned")
    for block in _blocks(benchmark):
        items, seeds = _prepared(docs, block, size)
        keyed = docs.withColumn(name, F.col("text").cast("string"))
        docs = keyed.mapInArrow(_clean(items, seeds, least, name), docs.schema)
    return docs


def _clean(items: Items, seeds, least: float, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            buf, offsets = W.text_buffer(batch.column(name))
            for lo, _, part, offs in W.groups(buf, offsets):
                for d, *_ in matches(items, seeds, part, offs, least):
                    clean[lo + d] = False
            yield batch.drop_columns([name]).filter(pa.array(clean))

    return run
