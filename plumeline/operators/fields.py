"""Search field names in sampled documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumeline.functions.flatten import dotted, flatten_json

# Documents sampled per collection, salt buckets of a hot group.
SAMPLE_SIZE = 5
SALTS = 64


def first_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, row_key: str) -> DataFrame:
    """First ``n`` rows of every group.

    A hot group is ranked in two steps: every salt bucket keeps its first ``n``,
    then the group ranks what is left, at most ``n * SALTS`` rows.
    """
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(row_key), F.lit(SALTS)))
    inner = Window.partitionBy(*group, "__salt").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("__rank", F.row_number().over(inner))
        .filter(F.col("__rank") <= n)
        .withColumn("__rank", F.row_number().over(outer))
        .filter(F.col("__rank") <= n)
        .drop("__rank", "__salt")
    )


def sample_documents(df: DataFrame, group: Sequence[str], row_key: str, n: int = SAMPLE_SIZE, seed: int = 0) -> DataFrame:
    """``n`` documents of every group in a seeded random order."""
    return first_n_per_group(df, group, [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_key).cast("string"))), F.col(row_key)], n, row_key)


def find_fields(
    df: DataFrame,
    pattern: str,
    body: str = "body",
    ns: str = "ns",
    row_key: str = "id",
    n: int | None = SAMPLE_SIZE,
    seed: int = 0,
) -> DataFrame:
    """Paths whose last part matches ``pattern``, case ignored, with the documents seen.

    ``n=None`` searches every document.
    """
    docs = df if n is None else sample_documents(df, [ns], row_key, n, seed)
    flat = flatten_json(docs, body, [ns, row_key], containers=True, positions=False)
    hits = flat.filter((F.size("path") > 0) & F.element_at("path", -1).rlike(f"(?i){pattern}"))
    # An array repeats a path inside one document: count the document once.
    return (
        hits.groupBy(ns, dotted(F.col("path")).alias("field"), row_key)
        .agg(F.lit(1).alias("one"))
        .groupBy(ns, "field")
        .agg(F.count("*").alias("documents"))
    )


def without_matches(df: DataFrame, found: DataFrame, ns: str = "ns") -> DataFrame:
    """Collections in which no field matched."""
    return df.select(ns).distinct().join(found.select(ns).distinct(), ns, "left_anti")


def array_field(df: DataFrame, body: str, path: str) -> DataFrame:
    """Documents whose field holds an array."""
    return df.filter(F.get_json_object(F.col(body), path).startswith("["))


def of_type(df: DataFrame, body: str, path: str, value: str) -> DataFrame:
    """Documents whose value at a JSON path, such as ``$.events[0].kind``, is ``value``."""
    return df.filter(F.get_json_object(F.col(body), path) == value)


def count_array_keys(df: DataFrame, key: Column) -> DataFrame:
    """Count by an array-valued key; ``type`` is its first element."""
    return (
        df.groupBy(key.alias("key"))
        .agg(F.count("*").alias("count"))
        .select("key", F.get("key", F.lit(0)).alias("type"), "count")
    )
