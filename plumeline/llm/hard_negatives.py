"""Hard negatives of labelled vectors by angular triangle filtering.

Vectors are made of whole numbers (``floor(SCALE * x)``) and a score is an integer inner product, so results are exact.

1. Every row keeps its angles to ``REFERENCES`` directions, which are chosen far apart in a bounded sample of
   ``SAMPLE_ROWS`` rows.  Rows are sorted by their nearest direction and the angle to it and packed into blocks of bounded
   size; a block also keeps the range of each angle and of the norms.
2. The angle between two rows is at least the difference of their angles to any direction, and at most their sum.  That
   bounds the cosine and, times the norms and widened for rounding, the score.
3. Anchors go through the index in blocks of ``ANCHOR_ROWS``, each written before the next is read, twice: for the
   positives, and for the rows in the score windows that the positives open.  A row is scored only if its bounds overlap
   what an anchor still looks for.

No row is left out by sampling: directions only decide how much is skipped.  Rows with a null id, label or vector or a null
or non-finite component take no part.  ``vec_id`` is the identity: equal rows count once, and of different rows with one id
the first by label and vector is used.  Only vectors of one length meet.  Zero vectors score 0 with all.  Scores must fit
64 bits, else ``ValueError``.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumeline.session import scratch_path, staged

SCALE = 256
REFERENCES = 8
SAMPLE_ROWS = 1024
BLOCK_ROWS = 2048
BLOCK_BYTES = 4 << 20
ANCHOR_ROWS = 8192
#: Anchors that are compared with a block at once.
_STEP = 256
#: More than arccos can lose near 1.
_SLACK = 2e-6
_NONE = np.iinfo(np.int64).min
_ROWS = "vec_id long, label long, dim int, vector binary, near int, angle double, angles binary, norm double"
_BLOCK = "dim int, n int, ids binary, labels binary, vectors binary, angles binary, norms binary"
_PAIR = "anchor_id long, vec_id long, score long"


def usable(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, one for each id; ``label`` replaces the column."""
    label = F.col("label") if label is None else label
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(~bad)
    first = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return first.select("vec_id", "row.label", "row.vector")


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)`` as doubles, which hold it exactly."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * SCALE)
    if not np.isfinite(out).all():
        raise ValueError("a component is too large for whole numbers")
    return out


def far_apart(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit directions: rows of the sample, each the one farthest from all before it."""
    norms = np.linalg.norm(sample, axis=1)
    sample = sample[(norms > 0) & np.isfinite(norms)]
    if not len(sample):
        return sample[:0]
    sample = sample / np.linalg.norm(sample, axis=1)[:, None]
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def angles_to(vectors: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and angles; a vector without direction has angle 0 to all, which its norm makes harmless."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        norms = np.linalg.norm(vectors, axis=1)
        cosines = vectors @ references.T / norms[:, None]
    return norms, np.arccos(np.clip(np.nan_to_num(cosines, nan=1.0), -1, 1))


def score_bounds(norms_a: np.ndarray, least: np.ndarray, most: np.ndarray, norms_low: np.ndarray, norms_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Safe bounds of scores from those of angles and norms; without finite norms they bound nothing."""
    with np.errstate(over="ignore", invalid="ignore"):
        top, bottom = np.cos(np.clip(least - _SLACK, 0, np.pi)), np.cos(np.clip(most + _SLACK, 0, np.pi))
        high = norms_a * np.where(top > 0, norms_high, norms_low) * top
        low = norms_a * np.where(bottom > 0, norms_low, norms_high) * bottom
        room = norms_a * norms_high * 1e-9 + 1
        high, low = high + room, low - room
    high[~np.isfinite(high)] = np.inf
    low[~np.isfinite(low)] = -np.inf
    return low, high


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b`` as 64-bit integers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    scores = whole[0] @ whole[1].T if a.shape[1] else np.zeros((len(a), len(b)), object)
    if any(abs(s) >= 1 << 63 for s in scores.ravel()):
        raise ValueError("a score does not fit 64 bits")
    return scores.astype(np.int64)


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of every row by score descending and id; places without a score hold ``_NONE``."""
    if scores.shape[-1] > 4 * k:
        # All that reach the k-th score, ties included.
        edge = np.partition(scores, -k, axis=-1)[..., -k]
        use = (scores >= edge[..., None]) & (scores != _NONE)
        width = max(int(use.sum(-1).max(initial=0)), k)
        place = np.argsort(~use, axis=-1, kind="stable")[..., :width]
        scores = np.where(np.take_along_axis(use, place, -1), np.take_along_axis(scores, place, -1), _NONE)
        ids = np.take_along_axis(ids, place, -1)
    order = np.lexsort((ids, ~scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def _prepare(references: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = pa.compute.list_value_length(lists).to_numpy()
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                vectors = whole_numbers(np.asarray(part.column("vector").flatten(), np.float64).reshape(part.num_rows, dim))
                norms, angles = angles_to(vectors, references.get(int(dim), np.zeros((0, int(dim)))))
                near = angles.argmin(1) if angles.shape[1] else np.zeros(len(angles), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id"), part.column("label"), pa.array(np.full(part.num_rows, dim), pa.int32()),
                        pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(near, pa.int32()),
                        pa.array(angles.min(1, initial=np.pi)), pa.array([a.tobytes() for a in angles], pa.binary()), pa.array(norms),
                    ],
                    ["vec_id", "label", "dim", "vector", "near", "angle", "angles", "norm"],
                )

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows, all of one length."""

    def block(dim: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        number = lambda c, kind: np.asarray(rows.column(c), kind).tobytes()
        joined = lambda c: b"".join(rows.column(c).to_pylist())
        row = (dim, rows.num_rows, number("vec_id", np.int64), number("label", np.int64), joined("vector"), joined("angles"), number("norm", np.float64))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["dim", "n", "ids", "labels", "vectors", "angles", "norms"])

    held: list[pa.RecordBatch] = []
    count, dim = 0, -1
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        at = 0
        while at < batch.num_rows:
            if dims[at] != dim or count >= max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(8 * dim, 1))):
                if held:
                    yield block(dim, held)
                held, count, dim = [], 0, int(dims[at])
            most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(8 * dim, 1)))
            other = np.flatnonzero(dims[at:] != dim)
            take = min(most - count, int(other[0]) if len(other) else batch.num_rows - at)
            held.append(batch.slice(at, take))
            count += take
            at += take
    if held:
        yield block(dim, held)


def build_index(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(index, rows)`` of usable rows: blocks of whole-number vectors, and the rows with their angles."""
    rows = staged(rows, "labelled_vectors")
    sample = rows.select("vec_id", "vector").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    by_size: dict[int, list] = {}
    for vector in sample.column("vector").to_pylist():
        by_size.setdefault(len(vector), []).append(vector)
    references = {dim: far_apart(whole_numbers(np.array(v, np.float64).reshape(len(v), dim))) for dim, v in by_size.items()}
    prepared = staged(rows.mapInArrow(_prepare(references), _ROWS), "angles")
    order = ["dim", "near", "angle", "vec_id"]
    return staged(prepared.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack, _BLOCK), "angle_index"), prepared


class Block:
    """A block of the index in arrays."""

    def __init__(self, row: dict):
        self.dim, n = row["dim"], row["n"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, self.dim)
        self.norms = np.frombuffer(row["norms"], np.float64)
        self.angles = np.frombuffer(row["angles"], np.float64).reshape(n, -1)


class Anchors:
    """A block of anchors of one length in arrays."""

    def __init__(self, rows: pa.Table, dim: int):
        self.ids, self.labels = (np.asarray(rows.column(c), np.int64) for c in ("vec_id", "label"))
        self.vectors = np.frombuffer(b"".join(rows.column("vector").to_pylist()), np.float64).reshape(len(self.ids), dim)
        self.norms = np.asarray(rows.column("norm"), np.float64)
        self.angles = np.frombuffer(b"".join(rows.column("angles").to_pylist()), np.float64).reshape(len(self.ids), -1)


class Filter:
    """Which rows of a block a few anchors have to score, and their scores."""

    def __init__(self):
        self.pairs = self.scored = 0

    def whole_block(self, a: Anchors, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each anchor's scores with any row of the block."""
        least, most = np.zeros(len(a.ids)), np.full(len(a.ids), np.pi)
        for r in range(a.angles.shape[1]):
            low, high = block.angles[:, r].min(), block.angles[:, r].max()
            own = a.angles[:, r]
            least = np.maximum(least, np.maximum(low - own, own - high))
            # The sum of angles, or what is left of the full circle, whichever is less, at its largest in the block.
            most = np.minimum(most, np.where((own + low <= np.pi) & (own + high >= np.pi), np.pi, np.maximum(np.minimum(own + low, 2 * np.pi - own - low), np.minimum(own + high, 2 * np.pi - own - high))))
        return score_bounds(a.norms, least, most, np.full(len(a.ids), block.norms.min()), np.full(len(a.ids), block.norms.max()))

    def scores(self, a: Anchors, use: np.ndarray, block: Block, wanted) -> np.ndarray:
        """Scores of anchors ``use`` with all rows; ``_NONE`` where ``wanted(low, high)`` rules a row out."""
        least, most = np.zeros((len(use), len(block.ids))), np.full((len(use), len(block.ids)), np.pi)
        for r in range(a.angles.shape[1]):
            own, other = a.angles[use, r][:, None], block.angles[:, r]
            both = own + other
            np.maximum(least, np.abs(own - other), out=least)
            np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
        n = np.broadcast_to(block.norms, least.shape)
        mask = wanted(*score_bounds(np.broadcast_to(a.norms[use][:, None], least.shape), least, most, n, n))
        self.pairs += mask.size
        self.scored += int(mask.sum())
        out = np.full(mask.shape, _NONE)
        at, row = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        if len(at):
            out[np.ix_(at, row)] = np.where(mask[np.ix_(at, row)], exact_scores(a.vectors[use[at]], block.vectors[row]), _NONE)
        return out


def best_positives(a: Anchors, blocks: Iterator[Block], k: int, work: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each anchor's first ``k`` other rows of its label."""
    scores, ids = np.full((len(a.ids), k), _NONE), np.zeros((len(a.ids), k), np.int64)
    for block in blocks:
        _, high = work.whole_block(a, block)
        open_ = np.flatnonzero((high >= scores[:, -1]) & np.isin(a.labels, block.labels))
        for lo in range(0, len(open_), _STEP):
            use = open_[lo : lo + _STEP]
            own = (block.labels == a.labels[use][:, None]) & (block.ids != a.ids[use][:, None])
            found = work.scores(a, use, block, lambda _, high, own=own, use=use: own & (high >= scores[use, -1][:, None]))
            near, their = first_of(found, np.broadcast_to(block.ids, found.shape), k)
            scores[use], ids[use] = first_of(np.concatenate([scores[use], near], 1), np.concatenate([ids[use], their], 1), k)
    return scores, ids


def best_negatives(a: Anchors, low: np.ndarray, high: np.ndarray, blocks: Iterator[Block], k: int, work: Filter) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor and window ``low .. high`` of scores, the first ``k`` rows of another label in it."""
    scores, ids = np.full((*low.shape, k), _NONE), np.zeros((*low.shape, k), np.int64)
    some = low <= high
    for block in blocks:
        # A window looks for scores that are at least its k-th so far.
        floor = np.where(some, np.maximum(low, scores[:, :, -1]), np.iinfo(np.int64).max)
        bottom, top = work.whole_block(a, block)
        open_ = np.flatnonzero(((top[:, None] >= floor) & (bottom[:, None] <= high) & some).any(1))
        for lo in range(0, len(open_), _STEP):
            use = open_[lo : lo + _STEP]
            other = block.labels != a.labels[use][:, None]

            def wanted(least, most, use=use, other=other, floor=floor):
                out = np.zeros(other.shape, bool)
                for j in range(low.shape[1]):
                    out |= (most >= floor[use, j][:, None]) & (least <= high[use, j][:, None]) & some[use, j][:, None]
                return out & other

            found = work.scores(a, use, block, wanted)
            for j in range(low.shape[1]):
                inside = (found != _NONE) & (found >= low[use, j][:, None]) & (found <= high[use, j][:, None]) & some[use, j][:, None]
                at = np.flatnonzero(inside.any(1))
                if len(at):
                    near, their = first_of(np.where(inside[at], found[at], _NONE), np.broadcast_to(block.ids, (len(at), len(block.ids))), k)
                    to = use[at]
                    scores[to, j], ids[to, j] = first_of(np.concatenate([scores[to, j], near], 1), np.concatenate([ids[to, j], their], 1), k)
    return scores, ids


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            if batch.column("dim")[k].as_py() == dim:
                yield Block(batch.slice(k, 1).to_pylist()[0])


def _positives(anchors: Anchors, dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, ids = best_positives(anchors, _blocks(batches, dim), k, Filter())
        at, col = np.nonzero(scores != _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[at]), pa.array(ids[at, col]), pa.array(scores[at, col])], ["anchor_id", "vec_id", "score"])

    return run


def window(score: int, least: int) -> tuple[int, int]:
    """Whole scores from ``least`` percent of a positive's score up to it; empty for negative ones."""
    return -(-least * score // 100), score


def _negatives(anchors: Anchors, dim: int, k: int, positives: list[list[tuple[int, int]]], least: int):
    slots = max(map(len, positives), default=0)
    low, high = np.ones((len(positives), slots), np.int64), np.zeros((len(positives), slots), np.int64)
    for at, found in enumerate(positives):
        for j, (score, _) in enumerate(found):
            low[at, j], high[at, j] = window(score, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, ids = best_negatives(anchors, low, high, _blocks(batches, dim), k, Filter())
        at, slot, col = np.nonzero(scores != _NONE)
        positive = np.array([positives[x][j][1] for x, j in zip(at, slot, strict=True)], np.int64)
        columns = [anchors.ids[at], positive, high[at, slot], ids[at, slot, col], scores[at, slot, col]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


_FOUND = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors among usable rows.

    A positive is one of an anchor's first ``positives`` other rows of its label; for each, the first ``negatives`` rows of
    another label whose score lies between ``least`` percent of the positive's and the positive's.
    """
    spark = rows.sparkSession
    index, prepared = build_index(rows)
    anchors = prepared.filter(is_anchor)
    count = -(-anchors.count() // ANCHOR_ROWS)
    number = F.pmod(F.xxhash64("vec_id"), F.lit(max(count, 1)))
    anchors = staged(anchors.select("vec_id", "label", "dim", "vector", "angles", "norm", number.alias("part")), "anchors", ("part",))
    path = scratch_path(spark, "negatives")
    spark.createDataFrame([], f"{_FOUND}, rank int").write.parquet(path)
    for part in range(count):
        # A bounded block of the stated query set; its result is written before the next is read.
        block = anchors.filter(F.col("part") == part).toArrow()
        for dim in sorted(set(block.column("dim").to_pylist())):
            some = Anchors(block.filter(pa.compute.equal(block.column("dim"), dim)).combine_chunks(), dim)
            ahead = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
            found = index.mapInArrow(_positives(some, dim, positives), _PAIR).withColumn("rank", F.row_number().over(ahead)).filter(F.col("rank") <= positives)
            by_anchor: dict[int, list[tuple[int, int]]] = {}
            for row in found.toArrow().sort_by("rank").to_pylist():
                by_anchor.setdefault(row["anchor_id"], []).append((row["score"], row["vec_id"]))
            task = _negatives(some, dim, negatives, [by_anchor.get(int(i), []) for i in some.ids], least)
            ahead = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
            result = index.mapInArrow(task, _FOUND).withColumn("rank", F.row_number().over(ahead)).filter(F.col("rank") <= negatives)
            result.write.mode("append").parquet(path)
    return spark.read.parquet(path).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
