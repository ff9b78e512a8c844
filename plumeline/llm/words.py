"""Words and hashes of whole Arrow text columns, as NumPy arrays.

A word is a run of bytes other than space and 0x09-0x0D.  Batch functions cut a column into groups of whole documents
of bounded size, so that the memory of a worker does not follow the size of a batch; a document above the bound is a
group of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
GROUP_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15
STEP = 0xD1342543DE82EF95


def whitespace() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, offsets


def groups(buf: np.ndarray, offsets: np.ndarray, limit: int = GROUP_BYTES):
    """Ranges ``(lo, hi)`` of documents with about ``limit`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def find_words(buf: np.ndarray, offsets: np.ndarray, solid_bytes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of every document (one entry more than documents)."""
    n = len(buf)
    solid = (~whitespace() if solid_bytes is None else solid_bytes)[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | cut[:n]))
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of ``values[start:end]`` modulo 2**64, from one prefix sum."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=prefix[1:], dtype=np.uint64)
    inverse = powers(pow(base, -1, 1 << 64), n + 1)
    return (prefix[ends] - prefix[starts]) * inverse[starts]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of words; bytes count from 1, so that a leading zero byte matters."""
    raw = span_hashes(buf.astype(np.uint64) + np.uint64(1), starts, ends, _BASE)
    return mix(raw, salt)


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of ``size`` words that lie in one document.

    Returns the hashes, the first word of each window and the document of each window.
    """
    counts = np.maximum(np.diff(first) - size + 1, 0)
    docs = np.repeat(np.arange(len(counts)), counts)
    begin = np.arange(len(docs)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1], counts)
    return mix(span_hashes(words, begin, begin + size, STEP)), begin, docs


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``values[i : i + width]`` for every i, by doubling; the end counts as full of large values."""
    out, done = values.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[:-step] = np.minimum(out[:-step], out[step:]) if step < len(out) else out[:-step]
        done += step
    return out


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A to Z in lower case, all other bytes unchanged."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def free_names(taken, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it needs to be none of ``taken``; case is ignored."""
    lower = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        out.append(name)
    return out
