"""Token ids of documents in a compact file format: canonical length-limited Huffman codes of ids.

Writing takes three passes over token ids, which are made once and kept packed in the shared folder:

1. Every text is encoded and closed with the end id.
2. Ids are counted over all documents; the code lengths come from package-merge over these counts (one entry for each
   id of the vocabulary, so the driver holds a bounded table).  Codes are canonical: the lengths define them.
3. Documents are range-partitioned and sorted by id and written in blocks of whole documents.

File format (a Parquet folder in ascending order of part and block; texts are not kept):

* ``blocks``: ``part, block, start, n_tokens, docs, lengths, checkpoints, bits``.  ``bits`` has the codes of the block
  from bit 0, most significant bit first; ``checkpoints`` has the bit offset of every ``CHECKPOINT``-th id, so a block
  can be decoded from many places at once; ``start`` counts ids of the part before the block.  ``docs`` and
  ``lengths`` have ids (64 bits) and numbers of token ids (64 bits) of the documents, little-endian, zstd.
* ``codebook``: ``token_id, length``.
* ``parts``: ``part, start``: ids of all parts before it.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from plumeline.session import scratch_path, staged

MAX_BITS = 18
CHECKPOINT = 512
BLOCK_TOKENS = 1 << 16
PART_TOKENS = 8 << 20
#: Pieces that a task remembers the ids of.
CACHE_PIECES = 800_000
_NO_ID = -(1 << 63)
_BATCH = 256
#: Blocks that are decoded in step.
_BLOCKS = 64


# Encoding -----------------------------------------------------------------------------------------------------------


def byte_characters() -> dict[int, str]:
    """The character that a byte-level vocabulary has for each byte: itself if it is printable, else the next one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Parts(dict):
    """Ids of single pre-tokens, in characters of the vocabulary; the model is asked once for each."""

    def __init__(self, model_ids):
        super().__init__()
        self.model_ids = model_ids

    def __missing__(self, mapped: str) -> bytes:
        ids = self[mapped] = self.model_ids(mapped)
        return ids


class _Learned(dict):
    """Ids by piece; an unknown piece is encoded when it is first asked for."""

    def __init__(self, encoder: PieceEncoder, front: str, lead: str):
        super().__init__()
        self.encoder, self.front, self.lead = encoder, front, lead

    def __missing__(self, piece: str) -> bytes:
        encoder = self.encoder
        if piece.isalpha() and piece.isascii():
            # Most pieces.
            ids = encoder.model_ids(self.front + piece)
        else:
            ids = encoder.compose(piece, self)
            if ids is None:
                (ids,) = encoder.direct([self.lead + piece])
        self[piece] = ids
        return ids


class PieceEncoder:
    """The ids of whole texts by a byte-level BPE of the tokenizers library, with the ids of pieces remembered.

    A piece is a run without spaces with one space in front.  The pre-tokenizer of such a vocabulary always cuts
    before a single space that has no white space around it, so the ids of a text are those of its pieces.  It also
    cuts between letters and ASCII punctuation that ends the piece, and around a single line end between them: such
    pieces are put together from words, tails of punctuation and line ends, which go to the model one by one.  All
    other pieces are encoded by the whole tokenizer, and so are texts with other white space around a space, texts
    with the text of a special token, and everything with a tokenizer of another kind.
    """

    PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Letters below this (Latin, Greek, Cyrillic) are letters to every version of Unicode in use.
    OLD_LETTERS = "\u0530"

    def __init__(self, tokenizer_json: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        config = json.loads(tokenizer_json)
        pre, model = config.get("pre_tokenizer") or {}, config["model"]
        self.by_piece = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not config.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        )
        self.special = [t["content"] for t in config.get("added_tokens", [])]
        # Without a space with white space behind it no text has white space on both sides of a space.
        self.wide = re.compile(r" \s")
        self.spaced = re.compile(r"\s \s|\s $")
        size = max([*(t["id"] for t in config.get("added_tokens", [])), *model["vocab"].values()]) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.packed = [i.to_bytes(self.kind.itemsize, "little") for i in range(size)]
        self.characters = byte_characters()
        self.mapped = "".join(self.characters[b] for b in range(256))
        letters = "".join(c for c in map(chr, range(ord(self.OLD_LETTERS))) if c.isalpha())
        self.simple = re.compile(f"([{letters}]+)([{re.escape(self.PUNCTUATION)}]*)").fullmatch
        self.space = self.characters[ord(" ")]
        self.pieces = _Learned(self, self.space, " ")
        self.heads = _Learned(self, "", "")
        self.parts = _Parts(self.model_ids)
        self.tokenize = self.tokenizer.model.tokenize

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def model_ids(self, mapped: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(mapped)])

    def _simple(self, run: str, learned: _Learned) -> bytes | None:
        """The ids of letters with punctuation behind them, where ``learned`` has them; None for any other run."""
        found = self.simple(run)
        if found is None:
            return None
        word, tail = found.groups()
        if tail:
            return learned[word] + self.parts[tail]
        if word.isascii():
            return learned[word]
        return self.model_ids(learned.front + codecs.charmap_decode(word.encode(), "strict", self.mapped)[0])

    def compose(self, piece: str, learned: _Learned) -> bytes | None:
        if "\n" not in piece:
            return self._simple(piece, learned)
        first, *lines = piece.split("\n")
        out = self._simple(first, learned)
        for line in lines:
            more = None if out is None else self._simple(line, self.heads)
            if more is None:
                return None
            out += self.parts[self.characters[ord("\n")]] + more
        return out

    def _whole(self, text: str) -> bool:
        """Whether a text can't be cut into pieces."""
        if any(t in text for t in self.special):
            return True
        return (text.endswith(" ") or self.wide.search(text) is not None) and self.spaced.search(text) is not None

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed little-endian numbers."""
        if not self.by_piece:
            return self.direct(texts)
        for table in (self.pieces, self.heads, self.parts):
            if len(table) > CACHE_PIECES:
                table.clear()
        of = self.pieces.__getitem__
        out = []
        for text in texts:
            if self._whole(text):
                out += self.direct([text])
            else:
                head, *rest = text.split(" ")
                out.append(self.heads[head] + b"".join(map(of, rest)))
        return out


def _encode(tokenizer_json: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(tokenizer_json)
        end = b"" if end_id is None else np.array([end_id], encoder.kind).tobytes()
        packer = zstandard.ZstdCompressor(1)
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH):
                part = batch.slice(lo, _BATCH)
                ids = [x + end for x in encoder.encode(part.column("text").fill_null("").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("text_key"),
                        pa.array([len(x) // encoder.kind.itemsize for x in ids], pa.int64()),
                        pa.array([packer.compress(x) for x in ids], pa.binary()),
                    ],
                    ["doc_id", "text_key", "n_tokens", "ids"],
                )

    return run


def encode_documents(docs: DataFrame, tokenizer_json: str, end_id: int | None = 0) -> DataFrame:
    """``doc_id, text_key, n_tokens, ids``: packed ids of every whole text (null: empty), closed with ``end_id``."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(_encode(tokenizer_json, end_id), "doc_id long, text_key long, n_tokens long, ids binary")


# Codes --------------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    most = max(most, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, merged = [], leaves
    for level in range(most):
        if level:
            even = merged[: len(merged) // 2 * 2]
            both = np.concatenate([leaves, even[::2] + even[1::2]])
            rank = np.argsort(both, kind="stable")
            merged = both[rank]
            levels.append(rank < len(leaves))
        else:
            levels.append(np.ones(len(leaves), bool))
    take = 2 * len(leaves) - 2
    depth = np.zeros(len(leaves), np.int64)
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length and id."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        at = np.flatnonzero(lengths == n)
        code <<= n - last
        codes[at] = code + np.arange(len(at))
        code, last = code + len(at), n
    return codes


def pack_bits(tokens: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ``tokens`` one behind the other, and the bit offsets of every CHECKPOINT-th of them."""
    size = lengths[tokens].astype(np.int64)
    stop = np.cumsum(size)
    at = stop - size
    total = int(stop[-1]) if len(stop) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    if total:
        code, word = codes[tokens], at >> 6
        room = 64 - (at & 63) - size
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[heads]] = np.bitwise_or.reduceat(high, heads)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], at[::CHECKPOINT]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """For each value of the next ``bits`` bits: the id and, in the low byte, the length of its code."""
    bits = max(1, int(lengths.max(initial=0)))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    table = np.repeat((order.astype(np.uint64) << np.uint64(8)) | lengths[order].astype(np.uint64), spans)
    return np.concatenate([table, np.zeros((1 << bits) - len(table), np.uint64)]), bits


def unpack_bits(blocks: list[tuple[bytes, np.ndarray, int]], table: np.ndarray, bits: int) -> np.ndarray:
    """The ids of ``(bits, checkpoints, count)`` blocks, all checkpoints in step."""
    tail = b"\0" * 8
    buf = np.frombuffer(b"".join(b for b, _, _ in blocks) + tail, np.uint8)
    base = np.cumsum([0, *(len(b) for b, _, _ in blocks)]) * 8
    places = np.concatenate([c + p for (_, c, _), p in zip(blocks, base, strict=False)] or [np.zeros(0, np.int64)])
    sizes = np.concatenate([np.minimum(CHECKPOINT, n - np.arange(0, n, CHECKPOINT)) for _, _, n in blocks] or [np.zeros(0, np.int64)])
    total = int(sizes.sum())
    out = np.zeros(total, np.uint32)
    order = np.argsort(-sizes, kind="stable")
    to = (np.cumsum(sizes) - sizes)[order]
    at, left = places[order], sizes[order]
    view = np.ndarray((len(buf) - 7,), ">u8", buf.data, strides=(1,))
    down = np.uint64(64 - bits)
    for step in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -step, "left"))
        p = at[:n]
        found = table[(view[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)) >> down]
        out[to[:n] + step] = found >> np.uint64(8)
        at[:n] += (found & np.uint64(255)).astype(np.int64)
    return out


# Files --------------------------------------------------------------------------------------------------------------


def _numbers(values) -> bytes:
    return zstandard.compress(np.diff(np.asarray(values, np.int64), prepend=0).astype("<i8").tobytes(), 1)


def _read_numbers(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(blob), "<i8"))


def _ids(blob: bytes, count: int) -> np.ndarray:
    raw = zstandard.decompress(blob)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * count else "<u4")


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            held = [_ids(blob.as_buffer(), n) for n, blob in zip(batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True)]
            for lo in range(0, len(held), _BATCH):
                counts += np.bincount(np.concatenate(held[lo : lo + _BATCH]), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["token_id", "n"])

    return run


def _write_blocks(lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal block, start
            tokens = np.concatenate(held)
            bits, checkpoints = pack_bits(tokens, codes, lengths)
            row = (part, block, start, len(tokens), _numbers(docs), _numbers([len(x) for x in held]), _numbers(checkpoints), bits)
            block, start = block + 1, start + len(tokens)
            docs.clear()
            held.clear()
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            names = ["part", "block", "start", "n_tokens", "docs", "lengths", "checkpoints", "bits"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        waiting = 0
        for batch in batches:
            for doc, n, blob in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids"), strict=True):
                docs.append(_NO_ID if doc is None else doc)
                held.append(_ids(blob.as_buffer(), n))
                waiting += n
                if waiting >= BLOCK_TOKENS:
                    yield close()
                    waiting = 0
        if docs:
            yield close()

    return run


_BLOCK = "part int, block long, start long, n_tokens long, docs binary, lengths binary, checkpoints binary, bits binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_json: str, end_id: int | None = 0, vocabulary: int | None = None) -> None:
    """Encode ``docs`` and write them at ``path``, in ascending order of doc_id (null first; equal ids by their text's hash)."""
    import json

    spark = docs.sparkSession
    if vocabulary is None:
        config = json.loads(tokenizer_json)
        known = [*(t["id"] for t in config.get("added_tokens", [])), *config["model"]["vocab"].values()]
        vocabulary = max([end_id or 0, *known]) + 1
    tokens = staged(encode_documents(docs, tokenizer_json, end_id), "token_ids")
    counted = tokens.select("n_tokens", "ids").mapInArrow(_count(vocabulary), "token_id int, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # a row for each id of the vocabulary at most
    counts = np.zeros(vocabulary, np.int64)
    counts[table.column("token_id").to_numpy()] = table.column("n").to_numpy()
    lengths = code_lengths(counts)
    parts = int(counts.sum()) // PART_TOKENS + 1
    ordered = tokens.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "text_key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_key")
    ordered.mapInArrow(_write_blocks(lengths), _BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths)
    book = pa.table({"token_id": pa.array(used, pa.int32()), "length": pa.array(lengths[used].astype(np.int32))})
    spark.createDataFrame(book).write.parquet(f"{path}/codebook")
    sums = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row for each part of some million ids.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/parts")


def _read_blocks(lengths: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits = decode_table(lengths)
        for batch in batches:
            for lo in range(0, batch.num_rows, _BLOCKS):
                rows = batch.slice(lo, _BLOCKS).to_pylist()
                ids = unpack_bits([(r["bits"], _read_numbers(r["checkpoints"]), r["n_tokens"]) for r in rows], table, bits).astype("<u4")
                out: dict[str, list] = {k: [] for k in ("doc_id", "part", "start", "n_tokens", "ids_crc32", "ids")}
                at = 0
                for r in rows:
                    start = r["start"]
                    for doc, n in zip(_read_numbers(r["docs"]).tolist(), _read_numbers(r["lengths"]).tolist(), strict=True):
                        own = ids[at : at + n]
                        out["doc_id"].append(None if doc == _NO_ID else doc)
                        out["part"].append(r["part"])
                        out["start"].append(start)
                        out["n_tokens"].append(n)
                        out["ids_crc32"].append(zlib.crc32(own))
                        out["ids"].append(own if with_ids else None)
                        at, start = at + n, start + n
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.uint32())]
                arrays = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
                if with_ids:
                    arrays[-1] = arrays[-1].cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(arrays[: 6 if with_ids else 5], list(out)[: 6 if with_ids else 5])

    return run


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``) of the documents in the files at ``path``."""
    book = spark.read.parquet(f"{path}/codebook").toArrow()
    lengths = np.zeros(int(max(book.column("token_id").to_pylist(), default=0)) + 1, np.uint8)
    lengths[book.column("token_id").to_numpy()] = book.column("length").to_numpy()
    schema = "doc_id long, part int, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    rows = spark.read.schema(_BLOCK).parquet(f"{path}/blocks").mapInArrow(_read_blocks(lengths, with_ids), schema)
    parts = spark.read.schema("part int, start long").parquet(f"{path}/parts").withColumnRenamed("start", "before")
    placed = rows.join(parts, "part").withColumn("start", F.col("start") + F.col("before"))
    return placed.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer_json: str, path: str | None = None, end_id: int | None = 0) -> DataFrame:
    """Write ``docs`` at ``path`` (a new folder in the shared one by default) and read them back."""
    path = path or scratch_path(docs.sparkSession, "token_store")
    write_tokens(docs, path, tokenizer_json, end_id)
    return read_tokens(docs.sparkSession, path)
