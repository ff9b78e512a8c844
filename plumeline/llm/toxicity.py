"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed n-gram of code points (A to Z in lower case).  The classifier is fitted on a
bounded sample of labelled rows, at most ``CLASS_ROWS`` of each class in order of a hash:

1. The sample's features are staged.  Rows of both classes with a feature are counted; r = log of the ratio of their
   shares, smoothed in the classes' own proportion so that a feature of no row has r = 0.  A feature's value is r,
   damped by the odds that a ratio so many standard errors from 0 is chance, relative to the clearest feature.
2. Logistic regression on these values, with an L2 penalty; the intercept is set back from the sample's class shares to
   those of all labelled rows.  No feature is left out: a rare one has a small value and a small weight.

A round of the regression is a Spark job over the staged features, so the driver holds tables of 2**``BITS`` numbers
and never the rows.  Errors are rounded so that their sums are exact: the model does not depend on how rows are split.
The model is a table of bounded size.  Scoring reads whole texts and counts each feature once per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumeline.llm import words as W
from plumeline.session import staged

CLASS_ROWS = 4000
BITS = 20
GRAMS = (4, 5)
#: Features of chance for one that tells the classes apart, before their ratios are seen.
CHANCE_ODDS = 1000.0
#: Tasks of a round of the fit; each sends a table of 2**BITS numbers (8 MB) to the driver.
FIT_TASKS = 4
_STEP = 0x9E3779B97F4A7C15


def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a UTF-8 buffer, A to Z in lower case, and the documents' offsets among them."""
    raw = W.lower_ascii(buf)
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    return np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32), heads[offsets]


def _rolled(points: np.ndarray):
    """``(n, features)`` of the n-grams that begin at every place, for each size n; the last n - 1 reach over the end."""
    values = points.astype(np.uint64)
    rolling = np.zeros(len(values), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolling *= np.uint64(_STEP)
        rolling[: max(len(values) - n + 1, 0)] += values[n - 1 :]
        if n in GRAMS:
            yield n, (W.mix(rolling, n) >> np.uint64(64 - BITS)).astype(np.int32)


def gram_features(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document, feature)``, each pair once and in order."""
    stop = np.repeat(first[1:], np.diff(first))
    pairs = []
    for n, feature in _rolled(points):
        at = np.flatnonzero(np.arange(len(points)) + n <= stop)
        pairs.append((np.searchsorted(first, at, "right") - 1 << BITS) | feature[at].astype(np.int64))
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return both >> BITS, both & ((1 << BITS) - 1)


def summed_weights(points: np.ndarray, first: np.ndarray, weights: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The sum of the weights of each document's features, each feature once; ``place`` is room for a number a feature.

    Writing the places of a document's n-grams by feature leaves the last one of each: those are the features, without a sort.
    """
    rolled = list(_rolled(points))
    out = np.zeros(len(first) - 1)
    for d, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        found = np.concatenate([feature[lo : max(hi - n + 1, lo)] for n, feature in rolled])
        at = np.arange(len(found), dtype=np.int32)
        place[found] = at
        out[d] = weights[found[place[found] == at]].sum()
    return out


def fold(column: str, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


@dataclass(frozen=True)
class Sample:
    """Labelled texts of both classes, and the share of label 1 among all labelled rows."""

    rows: DataFrame
    share: float
    counts: tuple[int, int]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, extra: tuple[str, ...] = ()) -> Sample:
    """At most ``most`` rows of each class, the first by a hash of the id; ids labelled in two ways take the larger label.

    Of documents with one id the first by text is used.
    """
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    parts = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * most rows of 12 bytes
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra).join(chosen, "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct("text", *extra)).alias("row"))
    rows = one.select("doc_id", "row.*", "label")
    return Sample(rows, n1 / max(n0 + n1, 1), (n0, n1))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets = W.text_buffer(batch.column("text"))
        for lo, hi, part, offs in W.groups(buf, offsets):
            doc, feature = gram_features(*code_points(part, offs))
            edges = np.searchsorted(doc, np.arange(hi - lo + 1))
            lists = [feature[a:b].astype("<i4").tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), pa.array(lists, pa.binary())], ["label", "features"])


def _feature_groups(batches: Iterator[pa.RecordBatch]):
    """``(labels, row, feature)`` of groups of staged rows."""
    for batch in batches:
        labels = batch.column("label").to_numpy()
        buf, offsets = W.text_buffer(batch.column("features"))
        for lo, hi, part, offs in W.groups(buf, offsets):
            yield labels[lo:hi], np.repeat(np.arange(hi - lo), np.diff(offs) // 4), np.frombuffer(part.tobytes(), "<i4")


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for labels, row, feature in _feature_groups(batches):
        for k in (0, 1):
            counts[k] += np.bincount(feature[labels[row] == k], minlength=1 << BITS)
    at = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], ["feature", "n0", "n1"])


def _round_errors(state, class_weights: tuple[float, float]):
    """One row for each task: the rows' weighted loss, and the sums of their errors in all and by feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = state.value
        by_class = np.array(class_weights)
        errors, total, loss = np.zeros(1 << BITS), 0.0, 0.0
        for labels, row, feature in _feature_groups(batches):
            z = np.clip(np.bincount(row, weights[feature], len(labels)) + bias, -30, 30)
            error = np.round((1 / (1 + np.exp(-z)) - labels) * by_class[labels] * 2.0**50) / 2.0**50
            loss += float((np.round((np.log1p(np.exp(z)) - labels * z) * by_class[labels] * 2.0**44) / 2.0**44).sum())
            errors += np.bincount(feature, error[row], 1 << BITS)
            total += float(error.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array([loss]), pa.array([total]), pa.array([errors.tobytes()], pa.binary())], ["loss", "total", "errors"]
        )

    return run


def minimise(evaluate, x: np.ndarray, rounds: int = 25, memory: int = 5) -> np.ndarray:
    """The least place of a smooth convex function by L-BFGS; ``evaluate`` gives value and gradient, ``rounds`` times at most."""
    value, slope = evaluate(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    size = 1 / max(float(np.linalg.norm(slope)), 1e-12)
    for _ in range(rounds - 1):
        if np.linalg.norm(slope) <= 1e-4:
            break
        q, factors = slope.copy(), []
        for s, y in reversed(steps):
            factors.append(s @ q / (s @ y))
            q -= factors[-1] * y
        if steps:
            s, y = steps[-1]
            q *= s @ y / (y @ y)
        for (s, y), f in zip(steps, reversed(factors), strict=True):
            q += (f - y @ q / (s @ y)) * s
        at = x - size * q
        value_at, slope_at = evaluate(at)
        if value_at > value - 1e-4 * size * (q @ slope):
            size /= 4
            continue
        s, y = at - x, slope_at - slope
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y)]
        x, value, slope, size = at, value_at, slope_at, 1.0
    return x


def fit_logistic(features: DataFrame, values: np.ndarray, class_weights: tuple[float, float], penalty: float) -> tuple[np.ndarray, float]:
    """Weights of all features, times their values, and the intercept."""
    context = features.sparkSession.sparkContext

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        state = context.broadcast((x[:-1] * values, float(x[-1])))
        rows = features.mapInArrow(_round_errors(state, class_weights), "loss double, total double, errors binary").toArrow()
        state.destroy()
        slope = np.zeros(len(values) + 1)
        for part in rows.column("errors"):
            slope[:-1] += np.frombuffer(part.as_buffer(), np.float64)
        slope[:-1] *= values
        slope[:-1] += penalty * x[:-1]
        slope[-1] = pa.compute.sum(rows.column("total")).as_py()
        return float(pa.compute.sum(rows.column("loss")).as_py()) + penalty / 2 * float(x[:-1] @ x[:-1]), slope

    x = minimise(evaluate, np.zeros(len(values) + 1))
    return x[:-1] * values, float(x[-1])


@dataclass(frozen=True)
class Model:
    """Weights by feature (0: unused) and the intercept."""

    weights: np.ndarray
    bias: float


def _constant(sample: Sample) -> Model:
    share = min(max(sample.share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", class_rows: int = CLASS_ROWS, penalty: float = 1e-4) -> Model:
    """A model from the rows of ``labels``; with one class or no labels it scores the share of label 1."""
    sample = labelled_sample(docs, labels, label, class_rows)
    if min(sample.counts) == 0:
        return _constant(sample)
    features = staged(sample.rows.mapInArrow(_sample_features, "label int, features binary"), "toxicity_sample").coalesce(FIT_TASKS)
    counted = features.mapInArrow(_class_counts, "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    if not counted.num_rows:
        return _constant(sample)
    feature, n0, n1 = (counted.column(c).to_numpy() for c in ("feature", "n0", "n1"))
    all0, all1 = (min(c, class_rows) for c in sample.counts)
    # One row of a balanced sample, dealt to the classes as they are.
    extra0, extra1 = 2 * all0 / (all0 + all1), 2 * all1 / (all0 + all1)
    ratio = np.zeros(1 << BITS)
    ratio[feature] = np.log((n1 + extra1) / (all1 + 2 * extra1)) - np.log((n0 + extra0) / (all0 + 2 * extra0))
    errors2 = ratio[feature] ** 2 / (1 / (n1 + extra1) + 1 / (n0 + extra0))
    size = np.zeros(1 << BITS)
    size[feature] = np.abs(ratio[feature]) / (1 + CHANCE_ODDS * np.exp(-errors2 / 2))
    values = np.sign(ratio) * np.sqrt(3 * size / max(float(size.max()), 1e-300))
    # Both classes have the same weight in the fit.
    weights, bias = fit_logistic(features, values, (0.5 / all0, 0.5 / all1), penalty)
    return Model(weights.astype(np.float32), bias + float(np.log(sample.share / (1 - sample.share))))


def _score(model: Model, carry: list[str], name: str):
    used = np.flatnonzero(model.weights)
    values, bias = model.weights[used], model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, place = np.zeros(1 << BITS, np.float64), np.zeros(1 << BITS, np.int32)
        weights[used] = values
        for batch in batches:
            out = np.full(batch.num_rows, bias)
            buf, offsets = W.text_buffer(batch.column("__text"))
            for lo, hi, part, offs in W.groups(buf, offsets):
                out[lo:hi] += summed_weights(*code_points(part, offs), weights, place)
            score = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(score)], [*carry, name])

    return run


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``carry`` and the score (0 to 1) of every row; null and empty texts have no features."""
    rows = docs.select(*carry, F.col("text").cast("string").alias("__text"))
    kept = [f for f in rows.schema if f.name in carry]
    return rows.mapInArrow(_score(model, list(carry), name), T.StructType([*kept, T.StructField(name, T.DoubleType())]))
