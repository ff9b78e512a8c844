"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Equal vectors are one node that holds its ``k + 1`` smallest ids; with ties going to smaller ids, no other copy can
be among the ``k`` nearest.  Nodes are dealt to shards of about ``SHARD_NODES`` by a hash.  In every shard nodes are
inserted in batches: a greedy beam search on the graph so far proposes neighbours, relaxed distance pruning (factor
``ALPHA``) keeps diverse ones, and edges back are pruned in the same way when a node has too many.  Queries run a beam
search in every shard; beams are ranked in double precision on the original vectors, and the shards' results are merged.

Queries are a stated set: they go to the shards in blocks of ``QUERY_BLOCK``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plumeline.session import scratch_path, staged

SHARD_NODES = 4096
DEGREE = 32
SLACK = 16
BUILD_BEAM = 64
SEARCH_BEAM = 160
ALPHA = 1.2
QUERY_BLOCK = 20_000
_BATCH = 256
_INDEX = "shard long, dim int, vectors binary, edges binary, entry int, sizes binary, ids binary"


def beam_search(vectors, norms, edges, entry: int, queries, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes found for each query, nearest first, and their squared distances; -1 pads."""
    n, b = len(vectors), len(queries)
    qn = np.einsum("ij,ij->i", queries, queries)
    ids = np.full((b, beam), -1, np.int32)
    dist = np.full((b, beam), np.inf, np.float32)
    ids[:, 0] = entry
    dist[:, 0] = norms[entry] + qn - 2 * (queries @ vectors[entry])
    done = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)
    seen[:, [entry, n]] = True
    rows = np.arange(b)
    while len(rows):
        open_dist = np.where(done[rows], np.inf, dist[rows])
        j = open_dist.argmin(1)
        alive = np.isfinite(open_dist[np.arange(len(rows)), j])
        rows, j = rows[alive], j[alive]
        if not len(rows):
            break
        node = ids[rows, j]
        done[rows, j] = True
        near = edges[node]
        new = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        safe = np.where(near < n, near, 0)
        d = norms[safe] + qn[rows, None] - 2 * np.matmul(vectors[safe], queries[rows][:, :, None])[:, :, 0]
        d = np.where(new, d, np.inf).astype(np.float32)
        all_d = np.concatenate([dist[rows], d], 1)
        pick = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        at = np.arange(len(rows))[:, None]
        dist[rows] = all_d[at, pick]
        ids[rows] = np.concatenate([ids[rows], near], 1)[at, pick]
        done[rows] = np.concatenate([done[rows], np.zeros(near.shape, bool)], 1)[at, pick]
    ids[~np.isfinite(dist)] = -1
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(vectors, norms, nodes, candidates, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours for each node from its candidates (-1 pads); the rest is padded with len(vectors).

    The nearest candidate is kept; it drops every candidate that is ``alpha`` times nearer to it than to the node.
    """
    n = len(vectors)
    safe = np.where(candidates < 0, 0, candidates)
    points = vectors[safe]
    own = vectors[nodes]
    d = norms[safe] + norms[nodes][:, None] - 2 * np.matmul(points, own[:, :, None])[:, :, 0]
    d = np.where((candidates < 0) | (candidates == nodes[:, None]), np.inf, np.maximum(d, 0))
    out = np.full((len(nodes), degree), n, np.int32)
    at = np.arange(len(nodes))
    for k in range(degree):
        best = d.argmin(1)
        ok = np.isfinite(d[at, best])
        if not ok.any():
            break
        out[ok, k] = candidates[at, best][ok]
        chosen = points[at, best]
        between = norms[safe] + norms[safe[at, best]][:, None] - 2 * np.matmul(points, chosen[:, :, None])[:, :, 0]
        d = np.where((alpha * alpha * np.maximum(between, 0) <= d) & ok[:, None], np.inf, d)
        d[at, best] = np.inf
    return out


def build_graph(vectors: np.ndarray, seed: int = 0) -> tuple[np.ndarray, int]:
    """Edges (padded with the number of nodes) and the entry node."""
    n = len(vectors)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    centre = vectors.mean(0)
    entry = int((norms - 2 * vectors @ centre).argmin())
    width = DEGREE + SLACK
    edges = np.full((n, width), n, np.int32)
    degree = np.zeros(n, np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    lo = 1
    while lo < n:
        batch = order[lo : lo + min(_BATCH, lo)]
        lo += len(batch)
        found, _ = beam_search(vectors, norms, edges, entry, vectors[batch], BUILD_BEAM)
        kept = robust_prune(vectors, norms, batch, found, DEGREE, ALPHA)
        edges[batch, :DEGREE] = kept
        degree[batch] = (kept < n).sum(1)
        to, back = kept.ravel(), np.repeat(batch, DEGREE)
        real = to < n
        to, back = to[real], back[real]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        fits = degree[nodes] + count <= width
        roomy = np.repeat(fits, count)
        rank = np.arange(len(to)) - np.repeat(first, count)
        edges[to[roomy], (degree[to] + rank)[roomy]] = back[roomy]
        degree[nodes[fits]] += count[fits]
        full = nodes[~fits]
        if len(full):
            more = np.full((len(full), int(count[~fits].max())), -1, np.int32)
            tight = ~roomy
            more[np.repeat(np.arange(len(full)), count[~fits]), rank[tight]] = back[tight]
            held = np.where(edges[full] < n, edges[full], -1)
            kept = robust_prune(vectors, norms, full, np.concatenate([held, more], 1), DEGREE, ALPHA)
            edges[full] = n
            edges[full, :DEGREE] = kept
            degree[full] = (kept < n).sum(1)
    return edges, entry


def _build(table: pa.Table) -> pa.Table:
    table = table.combine_chunks().sort_by("first_id")
    dim = table.column("dim")[0].as_py()
    vectors = np.asarray(table.column("vector").combine_chunks().flatten(), np.float32).reshape(-1, dim)
    edges, entry = build_graph(vectors)
    lists = table.column("ids").combine_chunks()
    sizes = np.asarray(pa.compute.list_value_length(lists), np.int32)
    row = (table.column("shard")[0].as_py(), dim, vectors.tobytes(), edges.tobytes(), entry, sizes.tobytes(), np.asarray(lists.flatten(), np.int64).tobytes())
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    names = ["shard", "dim", "vectors", "edges", "entry", "sizes", "ids"]
    return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector`` of the rows that take part: no null, zero, or null or non-finite component."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))


def build_index(vectors: DataFrame, k: int = 10) -> DataFrame:
    """One row for each shard with its graph, from ``(vec_id, embedding)``."""
    rows = usable(vectors)
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    nodes = rows.withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = staged(nodes.withColumn("first_id", F.col("ids")[0]), "nodes")
    shards = nodes.count() // SHARD_NODES + 1
    dealt = nodes.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))
    return dealt.groupBy("dim", "shard").applyInArrow(_build, _INDEX)


def _search(query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] != queries.shape[1]:
                    continue
                vectors = np.frombuffer(row["vectors"], np.float32).reshape(-1, row["dim"])
                edges = np.frombuffer(row["edges"], np.int32).reshape(len(vectors), -1)
                sizes, ids = np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["ids"], np.int64)
                first = np.cumsum(sizes) - sizes
                norms = np.einsum("ij,ij->i", vectors, vectors)
                for lo in range(0, len(queries), _BATCH):
                    q, own = queries[lo : lo + _BATCH], query_ids[lo : lo + _BATCH]
                    found, _ = beam_search(vectors, norms, edges, row["entry"], q, min(beam, len(vectors)))
                    safe = np.maximum(found, 0)
                    gap = vectors[safe].astype(np.float64) - q[:, None, :].astype(np.float64)
                    score = np.sqrt((gap * gap).sum(2))
                    at, col = np.nonzero(found >= 0)
                    node = found[at, col]
                    times = sizes[node]
                    vec = ids[np.repeat(first[node], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                    at, value = np.repeat(at, times), np.repeat(score[at, col], times)
                    other = vec != own[at]
                    at, value, vec = at[other], value[other], vec[other]
                    order = np.lexsort((vec, value, at))
                    at, value, vec = at[order], value[order], vec[order]
                    count = np.bincount(at, minlength=len(q))
                    top = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) < k
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[at[top]]), pa.array(vec[top]), pa.array(value[top])], ["query_id", "vec_id", "score"]
                    )

    return run


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score`` for queries ``(vec_id, embedding)``; a query is no candidate of its own.

    Queries that can't take part give no rows; with fewer than ``k`` candidates all are given.
    """
    rows = usable(queries)
    blocks = rows.count() // QUERY_BLOCK + 1
    spark, schema = index.sparkSession, "query_id long, vec_id long, score double"
    path = scratch_path(spark, "nearest")
    spark.createDataFrame([], schema).write.parquet(path)
    for number in range(blocks):
        block = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).withColumn("dim", F.size("vector")).toArrow()
        for dim in set(block.column("dim").to_pylist()):
            part = block.filter(pa.compute.equal(block.column("dim"), dim)).combine_chunks()
            vectors = np.asarray(part.column("vector").combine_chunks().flatten(), np.float32).reshape(-1, dim)
            ids = part.column("vec_id").to_numpy()
            # Written before the next block is read: the driver holds one.
            index.mapInArrow(_search(ids, vectors, k, beam), schema).write.mode("append").parquet(path)
    found = spark.read.parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
