"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise interactions in time
linear in the words.  A hashed word has the value sqrt(count / words of the text); structure statistics are shares and
logarithms, scaled by their mean and deviation in the sample; ``n_chars``, if there, is metadata.  The machine is
fitted by Adagrad on at most ``CLASS_ROWS`` labelled rows of each class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumeline.llm import words as W
from plumeline.llm.toxicity import labelled_sample

CLASS_ROWS = 3000
BITS = 16
FACTORS = 8
EPOCHS = 6
_STATS = 18


def structure(buf, offsets, starts, ends, first, words, n_chars) -> np.ndarray:
    """Structure statistics and metadata of each document."""
    sizes = np.diff(offsets).astype(float)
    counts = np.diff(first).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1)
        np.cumsum(mask, out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(sizes, 1)

    def per_word(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1)
        np.cumsum(values, out=sums[1:])
        return (sums[first[1:]] - sums[first[:-1]]) / np.maximum(counts, 1)

    letter = ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    upper = (buf >= 65) & (buf <= 90)
    digit = (buf >= 48) & (buf <= 57)
    symbol = ~(letter | upper | digit) & (buf > 32)
    dots = (buf == 44) | (buf == 46) | (buf == 33) | (buf == 63)
    width = ends - starts
    doc = np.repeat(np.arange(len(counts)), np.diff(first))
    keys = np.lexsort((words, doc))
    head = np.ones(len(keys), bool)
    head[1:] = (words[keys[1:]] != words[keys[:-1]]) | (doc[keys[1:]] != doc[keys[:-1]])
    at = np.flatnonzero(head)
    run = np.diff(np.append(at, len(keys)))
    top = np.zeros(len(counts))
    np.maximum.at(top, doc[keys[at]], run)
    distinct = np.bincount(doc[keys[at]], minlength=len(counts)) if len(at) else np.zeros(len(counts))
    again = np.zeros(len(words))
    again[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    sym = symbol & ~dots
    return np.stack(
        [
            np.log1p(counts), np.log1p(sizes), sizes / np.maximum(counts, 1), share(letter), share(upper), share(digit),
            share(sym), share(dots), share(buf == 10), share(buf == 124), share(buf == 33), per_word(width > 15),
            per_word(width <= 2), per_word(sym[ends - 1]) if len(ends) else np.zeros(len(counts)), distinct / np.maximum(counts, 1),
            top / np.maximum(counts, 1), per_word(again), np.log1p(np.maximum(n_chars, 0)),
        ],
        1,
    )


def features(part: np.ndarray, offs: np.ndarray, n_chars: np.ndarray):
    """Word features as ``(document, hashed word, value)`` and the statistics."""
    starts, ends, first = W.find_words(part, offs)
    words = W.word_hashes(W.lower_ascii(part), starts, ends)
    stats = structure(part, offs, starts, ends, first, words, n_chars)
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    pair, count = np.unique((doc << BITS) | (words >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    doc = pair >> BITS
    return doc, pair & ((1 << BITS) - 1), np.sqrt(count / np.maximum(np.diff(first), 1)[doc]), stats


@dataclass(frozen=True)
class Machine:
    """``weights`` and ``factors`` of hashed words and, behind them, of the statistics."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray

    def margins(self, doc, column, value, stats: np.ndarray) -> np.ndarray:
        """The score before the sigmoid, by the sum-of-squares identity."""
        n = len(stats)
        z = self.scaled(stats)
        tail = self.factors[1 << BITS :]
        linear = self.bias + np.bincount(doc, self.weights[column] * value, n) + z @ self.weights[1 << BITS :]
        inner, squares = z @ tail, (z * z) @ (tail * tail)
        for f in range(self.factors.shape[1]):
            x = self.factors[column, f] * value
            inner[:, f] += np.bincount(doc, x, n)
            squares[:, f] += np.bincount(doc, x * x, n)
        return linear + 0.5 * (inner * inner - squares).sum(1)

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.deviation, -4, 4)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chars = batch.column("n_chars").fill_null(0).to_numpy()
        buf, offsets = W.text_buffer(batch.column("text"))
        for lo, hi, part, offs in W.groups(buf, offsets):
            doc, column, value, stats = features(part, offs, chars[lo:hi])
            edges = pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (column.astype(np.int32), value.astype(np.float32))]
            table = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, _STATS, dtype=np.int32)), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), batch.column("label").slice(lo, hi - lo), *lists, table], ["doc_id", "label", "columns", "values", "stats"]
            )


def fit(first, columns, values, stats, labels, seed: int = 0, rate: float = 0.1, penalty: float = 1e-5) -> Machine:
    """Adagrad on the logistic loss; both classes have the same weight."""
    rng = np.random.default_rng(seed)
    size = (1 << BITS) + _STATS
    mean, deviation = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    w, v, bias = np.zeros(size), rng.normal(0, 0.03, (size, FACTORS)), 0.0
    gw, gv, gb = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3), 1e-3
    z = np.clip((stats - mean) / deviation, -4, 4)
    balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 64):
            rows = order[lo : lo + 64]
            counts = first[rows + 1] - first[rows]
            at = np.repeat(first[rows], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            doc = np.concatenate([np.repeat(np.arange(len(rows)), counts), np.repeat(np.arange(len(rows)), _STATS)])
            col = np.concatenate([columns[at], np.tile(np.arange(1 << BITS, size), len(rows))])
            val = np.concatenate([values[at], z[rows].ravel()])
            x = v[col] * val[:, None]
            inner = np.zeros((len(rows), FACTORS))
            np.add.at(inner, doc, x)
            squares = np.zeros((len(rows), FACTORS))
            np.add.at(squares, doc, x * x)
            margin = bias + np.bincount(doc, w[col] * val, len(rows)) + 0.5 * (inner**2 - squares).sum(1)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) * balance[rows] / len(rows)
            used, back = np.unique(col, return_inverse=True)
            step_w = np.bincount(back, error[doc] * val, len(used)) + penalty * w[used]
            step_v = np.zeros((len(used), FACTORS))
            np.add.at(step_v, back, (error[doc] * val)[:, None] * (inner[doc] - x))
            step_v += penalty * v[used]
            gw[used] += step_w**2
            gv[used] += step_v**2
            gb += error.sum() ** 2
            w[used] -= rate * step_w / np.sqrt(gw[used])
            v[used] -= rate * step_v / np.sqrt(gv[used])
            bias -= rate * error.sum() / np.sqrt(gb)
    return Machine(float(bias), w, v, mean, deviation)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", class_rows: int = CLASS_ROWS) -> Machine:
    """A machine from the rows of ``labels``; with one class or no labels it scores the share of label 1."""
    sample = labelled_sample(with_chars(docs), labels, label, class_rows, ("n_chars",))
    share = min(max(sample.share, 1e-6), 1 - 1e-6)
    prior = float(np.log(share / (1 - share)))
    size = (1 << BITS) + _STATS
    if min(sample.counts) == 0:
        return Machine(prior, np.zeros(size), np.zeros((size, FACTORS)), np.zeros(_STATS), np.ones(_STATS))
    schema = "doc_id long, label int, columns array<int>, values array<float>, stats array<double>"
    rows = sample.rows.mapInArrow(_sample_rows, schema).toArrow().combine_chunks().sort_by("doc_id")
    if not rows.num_rows:
        return Machine(prior, np.zeros(size), np.zeros((size, FACTORS)), np.zeros(_STATS), np.ones(_STATS))
    lists = rows.column("columns").combine_chunks()
    first = np.append(0, np.cumsum(np.asarray(pa.compute.list_value_length(lists), np.int64)))
    flat = lambda c: np.asarray(rows.column(c).combine_chunks().flatten())
    machine = fit(first, flat("columns"), flat("values").astype(float), flat("stats").reshape(-1, _STATS), rows.column("label").to_numpy().astype(float))
    return Machine(machine.bias + prior, machine.weights, machine.factors, machine.mean, machine.deviation)


def with_chars(docs: DataFrame) -> DataFrame:
    """``n_chars`` as a number; computed from the text where the table has none."""
    return docs.withColumn("n_chars", _chars(docs))


def _chars(docs: DataFrame) -> Column:
    if "n_chars" in docs.columns:
        return F.col("n_chars").try_cast("bigint")
    return F.length(F.col("text").cast("string")).cast("bigint")


def _score(machine: Machine, carry: list[str], name: str, text: str, size: str):
    small = Machine(machine.bias, machine.weights.astype(np.float32), machine.factors.astype(np.float32), machine.mean, machine.deviation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            chars = batch.column(size).fill_null(0).to_numpy()
            buf, offsets = W.text_buffer(batch.column(text))
            for lo, hi, part, offs in W.groups(buf, offsets):
                out[lo:hi] = small.margins(*features(part, offs, chars[lo:hi]))
            score = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(score)], [*carry, name])

    return run


def score(docs: DataFrame, machine: Machine, carry: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``carry`` and the score (0 to 1) of every row; null and empty texts have no words."""
    text, size = W.free_names(carry, "whole_text", "text_size")
    rows = docs.select(*carry, F.col("text").cast("string").alias(text), _chars(docs).alias(size))
    kept = [f for f in rows.schema if f.name in carry]
    return rows.mapInArrow(_score(machine, list(carry), name, text, size), T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def good_documents(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    (name,) = W.free_names(docs.columns, "quality_score")
    return score(docs, machine, tuple(docs.columns), name).filter(F.col(name) >= least).drop(name)
