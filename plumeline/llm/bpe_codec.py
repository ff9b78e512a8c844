"""Byte-level BPE: exact encoding in linear time by backtracking, decoding by an offset table.

Encoding a pre-token (a run that merges never leave):

1. One Aho-Corasick pass over the reversed pre-token finds, for every place, the longest token that starts there.
2. The tokens of a BPE result are exactly those whose neighbours are all compatible: a pair is compatible if no merge of
   a lower rank would have joined the two across their border.  Compatibility follows from the merges alone and is kept
   in a table that fills as pairs occur.
3. From the left, the longest token that is compatible with the one before is taken; if none fits, the place is marked
   dead and the token before gives way to its next shorter prefix.  A place dies once, so work is linear in the length.

Decoding looks up the bytes of all ids in one buffer through an offset table, a whole batch at a time.

Texts are cut into pre-tokens by the tokenizer's own rule.  Places where a single space stands between two characters
that are no white space are always such cuts, so texts are cut there first and the ids of the pieces are remembered
(``CACHE_PIECES`` of up to ``CACHE_LETTERS``).  Null texts are empty; null ids of documents stay null; repeated rows are separate rows; a
text of any length is one row and is never cut off.  Texts of added tokens (``<|endoftext|>``) become their ids.
"""

from __future__ import annotations

import json
import os
import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

CACHE_PIECES = 500_000
CACHE_LETTERS = 64
CACHE_PAIRS = 2_000_000
_ROWS = 256
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Merge tables of a byte-level BPE tokenizer, from its JSON definition.

    Tokens are numbered by rank: single bytes first, then the results of merges in their order.  ``ValueError`` for
    definitions of another kind, or if one token has two merges (then neighbours alone do not decide).
    """

    def __init__(self, definition: str):
        config = json.loads(definition)
        pre, model = config.get("pre_tokenizer") or {}, config["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or config.get("normalizer"):
            raise ValueError("the tokenizer is not a byte-level BPE without normaliser and prefix space")
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("the model is not a plain BPE")
        self.added = {t["content"]: t["id"] for t in config.get("added_tokens", [])}
        if any(t.get(k) for t in config.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens with rules of their own are not supported")
        self.definition = definition
        vocab, letters = model["vocab"], byte_letters()
        self.tokens: list[str] = list(letters)
        number = {t: k for k, t in enumerate(self.tokens)}
        self.left, self.right = list(range(256)), list(range(256))
        pairs = []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if a + b in number:
                raise ValueError(f"two merges for one token: {a + b}")
            number[a + b] = len(self.tokens)
            self.tokens.append(a + b)
            self.left.append(number[a])
            self.right.append(number[b])
            pairs.append((number[a], number[b]))
        self.ids = [vocab[t] for t in self.tokens]
        self.sizes = [len(t) for t in self.tokens]
        self.pairs = {a << 32 | b: k + 256 for k, (a, b) in enumerate(pairs)}
        # A token that other merges take apart never occurs; its merge then never happens either.
        self.alive = [True] * 256
        for k in range(256, len(self.tokens)):
            a, b = self.left[k], self.right[k]
            self.alive.append(self.alive[a] and self.alive[b] and self.compatible(a, b, k))
        real = {t: k for k, t in enumerate(self.tokens) if self.alive[k]}
        #: The longest real token that is a proper prefix; -1 for single bytes.
        self.shorter = [next((real[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in real), -1) for t in self.tokens]
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        size = max(names) + 1
        # As bytes if all its characters stand for bytes, else as the text itself.
        raw = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in (names.get(i, "") for i in range(size))]
        self.bytes = b"".join(raw)
        #: Where the bytes of each id begin; one empty entry more stands for ids that the vocabulary doesn't have.
        self.offsets = np.cumsum([0, *map(len, raw), 0])

    def compatible(self, a: int, b: int, limit: int = 1 << 62) -> bool:
        """Whether no merge of a rank below ``limit`` joins the border between ``a`` and ``b``.

        The two are taken apart from the border's sides, latest merge first: at each step the pair of tokens at the border
        must not have a merge that comes before the one just undone.
        """
        pairs, left, right = self.pairs, self.left, self.right
        while True:
            joined = pairs.get(a << 32 | b)
            if joined is not None and joined < limit:
                return False
            if a > b:
                steps = ((True, a), (False, b))
            else:
                steps = ((False, b), (True, a))
            for on_left, token in steps:
                if token >= 256:
                    if on_left:
                        limit, a = token, right[token]
                    else:
                        # At equal ranks the leftmost pair goes first, so the right side's own merge loses a tie.
                        limit, b = token + 1, left[token]
                    break
            else:
                return True

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the offset of each id among them; unknown ids are empty."""
        last = len(self.offsets) - 2
        known = np.where((ids < 0) | (ids >= last), last, ids)
        sizes = np.diff(self.offsets)[known]
        stop = np.cumsum(sizes)
        at = np.concatenate([[0], stop]).astype(np.int64)
        source = np.arange(at[-1]) + np.repeat(self.offsets[known] - at[:-1], sizes)
        return np.frombuffer(self.bytes, np.uint8)[source], at


class _Words(dict):
    """Packed ids by pre-token, in letters of the vocabulary."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.backtrack(word)
        if len(word) <= CACHE_LETTERS:
            self[word] = ids
        return ids


class _Pieces(dict):
    """Packed ids by piece; ``lead`` stands before each of them."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str) -> bytes:
        ids = self.encoder.cut(self.lead, piece)
        if len(piece) <= CACHE_LETTERS:
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts to packed 32-bit ids."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.v = vocabulary
        self.pre = Tokenizer.from_str(vocabulary.definition).pre_tokenizer.pre_tokenize_str
        self.packed = [i.to_bytes(4, "little") for i in vocabulary.ids]
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, token in enumerate(vocabulary.tokens):
            if vocabulary.alive[k]:
                self.finder.add_word(token[::-1], k)
        self.finder.make_automaton()
        self.fits: dict[int, bool] = {}
        self.words = _Words(self)
        self.heads, self.pieces = _Pieces(self, ""), _Pieces(self, " ")
        added = sorted(vocabulary.added, key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, added))})") if added else None
        spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
        self.wide = [f" {c}" for c in spaces] + [f"{c} " for c in spaces]
        self.space = next(c for c, b in byte_letters().items() if b == 32)

    def backtrack(self, word: str) -> bytes:
        """The ids of one pre-token."""
        v = self.v
        n = len(word)
        longest = array("i", [-1]) * n
        for end, token in self.finder.iter(word[::-1]):
            at = n - 1 - end
            if longest[at] < 0 or v.sizes[token] > v.sizes[longest[at]]:
                longest[at] = token
        dead = bytearray(n + 1)
        fits, sizes, shorter = self.fits, v.sizes, v.shorter
        taken, at = array("i"), 0
        token = longest[0] if n else -1
        while at < n:
            before = taken[-1] if taken else -1
            while True:
                end = at + sizes[token]
                if not dead[end]:
                    if before < 0:
                        break
                    key = before << 32 | token
                    fit = fits.get(key)
                    if fit is None:
                        if len(fits) > CACHE_PAIRS:
                            fits.clear()
                        fit = fits[key] = v.compatible(before, token)
                    if fit:
                        break
                token = shorter[token]
                if token < 0:
                    break
            if token < 0:
                dead[at] = 1
                token = taken.pop()
                at -= sizes[token]
            else:
                taken.append(token)
                at = end
                token = longest[at] if at < n else -1
        packed = self.packed
        return b"".join([packed[t] for t in taken])

    def cut(self, lead: str, piece: str) -> bytes:
        """The ids of a piece: of its pre-tokens one after the other."""
        word = piece.rstrip(_PUNCTUATION)
        if word.isascii() and word.isalpha():
            # Most pieces: letters, with or without punctuation behind them.
            ids = self.words[(self.space if lead else "") + word]
            return ids + self.words[piece[len(word) :]] if len(word) < len(piece) else ids
        return b"".join([self.words[w] for w, _ in self.pre(lead + piece)])

    def plain(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        if any(w in text for w in self.wide) or text[:1] == " " or text[-1:] == " ":
            parts = re.split(r"(?<=\S) (?=\S)", text)
        else:
            parts = text.split(" ")
        return self.heads[parts[0]] + b"".join(map(self.pieces.__getitem__, parts[1:])) if text else b""

    def encode(self, text: str) -> bytes:
        for table in (self.words, self.heads, self.pieces):
            if len(table) > CACHE_PIECES:
                table.clear()
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        parts = self.added.split(text)
        return b"".join([self.v.added[p].to_bytes(4, "little") if k % 2 else self.plain(p) for k, p in enumerate(parts)])


def _send(spark: SparkSession, vocabulary: Vocabulary) -> Broadcast:
    """The vocabulary (a few MB, whatever the data) for all tasks, with its class."""
    return spark.sparkContext.broadcast({"vocabulary": cloudpickle.dumps(vocabulary)})


def _received(shared: Broadcast) -> Vocabulary:
    """The vocabulary in a task; a worker process unpacks it once."""
    held = shared.value
    if isinstance(held["vocabulary"], bytes):
        held["vocabulary"] = pickle.loads(held["vocabulary"])
    return held["vocabulary"]


def _lists(parts: list[bytes]) -> pa.ListArray:
    ids = np.frombuffer(b"".join(parts), "<i4")
    return pa.ListArray.from_arrays(np.cumsum([0, *(len(p) // 4 for p in parts)]).astype(np.int32), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, ids``: the token ids of every whole text, in order."""
    shared = _send(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value.get("encoder")
        if encoder is None:
            encoder = shared.value["encoder"] = Encoder(_received(shared))
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                ids = [encoder.encode(t) if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, ids, text`` of ``doc_id, ids``; null lists are empty, bytes that are no UTF-8 become U+FFFD."""
    shared = _send(tokens.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _received(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                lists = part.column("ids")
                sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy()
                flat = lists.flatten().fill_null(-1).to_numpy()
                data, at = vocabulary.decode_bytes(flat)
                edges = at[np.concatenate([[0], np.cumsum(sizes)])]
                rows = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
                try:
                    texts = rows.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:
                    texts = pa.array([r.decode("utf-8", "replace") for r in rows.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, texts], ["doc_id", "ids", "text"])

    rows = tokens.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of decoded documents."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
