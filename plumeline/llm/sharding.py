"""Rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number for a key from one hash of both, and the highest weighted draw wins.  The id alone decides;
an additional shard can only win rows, so nothing moves between the old ones.  Slots number the rows of a shard from
0: rows are put into hash ranges of about ``RANGE_ROWS`` rows, windows run inside a shard's range, and one row per
shard and range carries the counts on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGE_ROWS = 20_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``: the largest weight / -ln(u), u in (0, 1) from the hash of key and shard; ties to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    draws = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11).cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((F.lit(float(weight)) / -F.log(u)).alias("draw"), F.lit(-shard).alias("shard")))
    return -F.array_max(F.array(*draws))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: Sequence[float] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text has no bytes (size 1, checksum 0).  A null id is a key like any other.  Rows with one id share a
    shard; equal rows get slots in any order.
    """
    grown = tuple(grown) if grown is not None else (*weights, weights[-1])
    text = F.coalesce(F.encode(F.col("text").cast("string"), "UTF-8"), F.lit(b""))
    key = F.col("doc_id").cast("bigint")
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
    ).withColumn("place", F.xxhash64("doc_id", "text_crc32", "size"))
    ranges = max(1, docs.count() // RANGE_ROWS)
    rows = rows.withColumn("range", F.pmod("place", F.lit(ranges)))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    carried = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried"))
    inside = Window.partitionBy("shard", "range").orderBy("place", "doc_id")
    return (
        rows.withColumn("local", F.row_number().over(inside) - 1)
        .join(carried, ["shard", "range"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("local") + F.col("carried")).cast("bigint").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
        )
    )
