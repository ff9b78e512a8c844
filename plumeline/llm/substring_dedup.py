"""Substring dedup by Rabin-Karp hashes of every fixed-length word window.

A window is ``window`` consecutive words of one document.  A word goes if a window that covers it also starts in a
document with a smaller id.  All windows are hashed (64-bit Rabin-Karp, mixed) and counted by hash range:

1. Each task hashes the windows of a group of documents.  Inside a group a hash keeps the windows of its smallest
   document; windows of later documents are hits at once, so a passage that many documents share reaches the shuffle
   once per group.
2. The rest is packed: one row per group and range with seven hash bytes a window.  The range of a window is that of
   its anchor, the least hash of all runs of ``ANCHOR`` words in it: equal windows have equal anchors, and windows that
   follow each other mostly share one, so their places and the hits of a document stay together.  A range holds about
   ``RANGE_WINDOWS`` windows; the number of ranges follows the input.
3. A task per range sorts its hashes and returns the windows whose hash has a smaller first document.
4. Hits meet the texts by document; overlapping windows merge into maximal intervals of words to remove.

Rows with one id but different texts are told apart by a hash of the text.  A null id counts as larger than all others.
A null text has no words.  Windows meet if 56 bits of their hash and the range of their anchor agree (at least ``MIN_RANGES``): the
chance of any false hit is below n**2 / 2**(57 + range bits) for n windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from plumeline.llm import words as W

#: Windows that one hash range should hold; a task needs about 60 bytes of memory for each.
RANGE_WINDOWS = 4_000_000
MIN_RANGES = 16
ANCHOR = 8
_LAST = (1 << 63) - 1
_CELL = "range int, docs binary, hashes binary, steps binary, doc_id long, text_key int, starts binary"


def _pack_table(ids: np.ndarray, keys: np.ndarray, first: np.ndarray) -> bytes:
    parts = np.diff(ids, prepend=0).astype("<i8"), keys.astype("<i4"), np.diff(first, prepend=0).astype("<i8")
    return zstandard.compress(b"".join(x.tobytes() for x in parts), 1)


def _unpack_table(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    n = (len(raw) - 8) // 20
    ids = np.cumsum(np.frombuffer(raw, "<i8", n))
    keys = np.frombuffer(raw, "<i4", n, 8 * n)
    return ids, keys, np.cumsum(np.frombuffer(raw, "<i8", n + 1, 12 * n))


def _pack_steps(begin: np.ndarray) -> bytes:
    """Increasing word numbers as byte planes of their differences."""
    steps = np.diff(begin, prepend=0).astype("<u4")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack_steps(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64))


def _hit_rows(ids, keys, first, begin, docs) -> list[tuple]:
    """A row per document: its hit windows as packed word numbers of the document."""
    if not len(docs):
        return []
    edges = np.flatnonzero(np.diff(docs, prepend=-1))
    out = []
    for lo, hi in zip(edges, [*edges[1:], len(docs)], strict=True):
        d = docs[lo]
        out.append((int(ids[d]), int(keys[d]), _pack_steps(begin[lo:hi] - first[d])))
    return out


def _anchors(words: np.ndarray, size: int) -> np.ndarray:
    """For the window from each word: the least hash of its runs of ANCHOR words, scrambled."""
    run = min(ANCHOR, size)
    at = np.arange(max(len(words) - run + 1, 0))
    return W.mix(W.sliding_min(W.mix(W.span_hashes(words, at, at + run, W.STEP)), size - run + 1), 1)


def _cells(size: int, ranges: int):
    bits = (ranges - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("range", pa.int32()), ("docs", pa.binary()), ("hashes", pa.binary()), ("steps", pa.binary())]
            + [("doc_id", pa.int64()), ("text_key", pa.int32()), ("starts", pa.binary())]
        )
        for batch in batches:
            batch = batch.take(pa.compute.sort_indices(batch.column("doc_id")))
            all_ids = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
            all_keys = batch.column("text_key").to_numpy(zero_copy_only=False)
            buf, offsets = W.text_buffer(batch.column("text"))
            for lo, hi, part, offs in W.groups(buf, offsets):
                ids, keys = all_ids[lo:hi], all_keys[lo:hi]
                starts, ends, first = W.find_words(part, offs)
                words = W.word_hashes(part, starts, ends)
                hashes, begin, docs = W.window_hashes(words, first, size)
                if not len(hashes):
                    continue
                anchor = _anchors(words, size)[begin]
                order = np.argsort(hashes, kind="stable")
                lead = np.zeros(len(order), np.int64)
                lead[1:] = np.where(hashes[order[1:]] == hashes[order[:-1]], 0, np.arange(1, len(order)))
                lead = np.maximum.accumulate(lead)
                repeat = np.zeros(len(order), bool)
                repeat[order] = ids[docs[order]] > ids[docs[order[lead]]]
                del order, lead
                rows = [
                    (int(i) % ranges, None, None, None, i, k, s)
                    for i, k, s in _hit_rows(ids, keys, first, begin[repeat], docs[repeat])
                ]
                table = _pack_table(ids, keys, first)
                hashes, begin, anchor = hashes[~repeat], begin[~repeat], anchor[~repeat]
                target = (anchor >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(target, kind="stable")
                edges = np.searchsorted(target[order], np.arange(ranges + 1))
                low = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
                for r in range(ranges):
                    at = order[edges[r] : edges[r + 1]]
                    if len(at):
                        rows.append((r, table, low[at].tobytes(), _pack_steps(begin[at]), None, None, None))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
                )

    return run


def _resolve(table: pa.Table) -> pa.Table:
    """Hits of one hash range: windows whose hash has a smaller first document."""
    cells, passed = [], []
    for row in table.select(["docs", "hashes", "steps", "doc_id", "text_key", "starts"]).to_pylist():
        if row["docs"] is None:
            passed.append((row["doc_id"], row["text_key"], row["starts"]))
        else:
            cells.append(row)
    hashes, owner, held = [], [], []
    for row in cells:
        low = np.frombuffer(row["hashes"], np.uint8).reshape(-1, 7)
        full = np.zeros((len(low), 8), np.uint8)
        full[:, :7] = low
        ids, keys, first = _unpack_table(row["docs"])
        begin = _unpack_steps(row["steps"])
        docs = np.searchsorted(first, begin, "right") - 1
        hashes.append(full.view("<u8").ravel())
        owner.append(ids[docs])
        held.append((ids, keys, first, begin, docs))
    if cells:
        sizes = [len(h) for h in hashes]
        h, ids = np.concatenate(hashes), np.concatenate(owner)
        del hashes, owner
        order = np.argsort(h)
        new = np.ones(len(order), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        least = np.minimum.reduceat(ids[order], np.flatnonzero(new))
        hit = np.zeros(len(order), bool)
        hit[order] = ids[order] > least[np.cumsum(new) - 1]
        at = 0
        for n, (own, keys, first, begin, docs) in zip(sizes, held, strict=True):
            mask = hit[at : at + n]
            at += n
            passed += _hit_rows(own, keys, first, begin[mask], docs[mask])
    columns = list(zip(*passed, strict=True)) or [[], [], []]
    return pa.table(
        {
            "doc_id": pa.array(list(columns[0]), pa.int64()),
            "text_key": pa.array(list(columns[1]), pa.int32()),
            "starts": pa.array(list(columns[2]), pa.binary()),
        }
    )


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(1)
    for batch in batches:
        texts = [packer.compress(x.as_buffer()) if x.is_valid else None for x in batch.column("text").cast(pa.large_binary())]
        ids = batch.column("doc_id").fill_null(_LAST)
        yield pa.RecordBatch.from_arrays(
            [ids, batch.column("text_key"), pa.array(texts, pa.binary())], ["doc_id", "text_key", "packed"]
        )


def _remove(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "intervals": [], "kept": []}
            for packed, hits in zip(batch.column("packed"), batch.column("hits"), strict=True):
                words = zstandard.decompress(packed.as_py()).split() if packed.is_valid else []
                spans: list[tuple[int, int]] = []
                if hits.is_valid and len(hits):
                    begin = np.unique(np.concatenate([_unpack_steps(x) for x in hits.as_py()]))
                    edge = np.flatnonzero(np.diff(begin, prepend=-size - 1) > size)
                    last = np.append(edge[1:], len(begin)) - 1
                    spans = [(int(a), int(b) + size) for a, b in zip(begin[edge], begin[last], strict=True)]
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["intervals"].append([{"start": a, "stop": b} for a, b in spans])
                out["kept"].append(b" ".join(kept).decode())
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.compute.if_else(pa.compute.equal(ids, _LAST), pa.scalar(None, pa.int64()), ids),
                    pa.array(out["n_words"], pa.int64()),
                    pa.array(out["n_removed"], pa.int64()),
                    pa.array(out["intervals"], span),
                    pa.array(out["kept"], pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "intervals", "kept"],
            )

    return run


def hash_ranges(docs: DataFrame) -> int:
    """Hash ranges for the input: a power of two that follows the bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # A word and its space have five bytes or more in most languages; fewer only make larger ranges.
    return max(MIN_RANGES, 1 << max(0, (size // 5 // RANGE_WINDOWS)).bit_length())


def remove_repeats(docs: DataFrame, window: int = 50, ranges: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, intervals of removed words, kept text.

    Empty tables give no rows, empty texts no words; repeated rows of one id are no repeats of each other.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.hash("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    cells = rows.mapInArrow(_cells(window, ranges or hash_ranges(rows)), _CELL)
    hits = cells.groupBy("range").applyInArrow(_resolve, "doc_id long, text_key int, starts binary")
    per_doc = hits.groupBy("doc_id", "text_key").agg(F.collect_list("starts").alias("hits"))
    packed = rows.mapInArrow(_compress, "doc_id long, text_key int, packed binary")
    return packed.join(per_doc, ["doc_id", "text_key"], "left").mapInArrow(
        _remove(window),
        "doc_id long, n_words long, n_removed long, intervals array<struct<start:bigint,stop:bigint>>, kept string",
    )


def kept_digest(kept: DataFrame) -> DataFrame:
    """The kept text as its SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"), F.size("intervals").alias("n_intervals"))


def brute_force(rows: list[tuple[int, str | None]], window: int) -> list[tuple]:
    """The definition, for tests: quadratic memory in nothing but the windows of a small input."""
    least: dict[tuple, int] = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
