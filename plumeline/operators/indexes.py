"""Index and storage reports over collection-stats snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumeline.functions.times import seconds_between
from plumeline.session import staged

# Report constants.
ID_INDEX = "_id_"
NEW_INDEX_SECONDS = 7 * 24 * 3600
NO_SHARD_KEY = "No Shard Key"
ALL_DATABASES = "all"
SYSTEM_DATABASES = ("admin", "config", "test", "local")
SYSTEM_COLLECTIONS = ("system.views",)

_NS = ["server", "db", "collection"]


def user_collections(snapshots: DataFrame) -> DataFrame:
    """Snapshots of user data only."""
    return snapshots.filter(
        ~F.col("_id.DB").isin(*SYSTEM_DATABASES) & ~F.col("_id.Collection").isin(*SYSTEM_COLLECTIONS)
    )


def measured(snapshots: DataFrame) -> DataFrame:
    """Without the summary row, empty collections and rows without index stats."""
    return snapshots.filter(
        (F.col("_id.DB") != ALL_DATABASES) & F.col("size").isNotNull() & F.col("indexStats").isNotNull()
    ).withColumns({"server": F.col("_id.Server"), "db": F.col("_id.DB"), "collection": F.col("_id.Collection")})


def host_shards(snapshots: DataFrame) -> DataFrame:
    """Shard of every host that reports index stats."""
    return (
        snapshots.filter(F.col("_id.DB") != ALL_DATABASES)
        .select(F.explode("indexStats").alias("s"))
        .groupBy(F.col("s.host").alias("host"))
        .agg(F.min("s.shard").alias("shard"))
    )


def with_shard_key(rows: DataFrame, shard_map: DataFrame | None) -> DataFrame:
    """Shard key of (db, collection) or the default text.

    The map has one row per sharded collection; Spark broadcasts it while it is
    below the session's broadcast threshold and shuffles it otherwise.
    """
    if shard_map is None:
        return rows.withColumn("shard_key", F.lit(""))
    keys = shard_map.select("db", "collection", "shard_key")
    return rows.join(keys, ["db", "collection"], "left").withColumn(
        "shard_key", F.coalesce("shard_key", F.lit(NO_SHARD_KEY))
    )


def index_ops(stats: DataFrame) -> DataFrame:
    """One row per index and host: period, ops per second and flags."""
    return (
        stats.select(*_NS, "runTime", F.explode("indexStats").alias("s"))
        .filter(F.col("s.accesses").isNotNull())
        .select(
            *_NS,
            F.col("s.name").alias("index_name"),
            F.col("s.host").alias("host"),
            F.col("s.shard").alias("stat_shard"),
            F.col("s.key").alias("key"),
            F.col("s.spec.expireAfterSeconds").isNotNull().alias("ttl"),
            F.col("s.accesses.ops").alias("ops"),
            seconds_between(F.col("runTime"), F.col("s.accesses.since")).alias("period"),
        )
        .withColumn("ops_per_sec", F.when(F.col("ops") == 0, F.lit(0.0)).otherwise(F.try_divide("ops", "period")))
    )


@dataclass(frozen=True)
class IndexReport:
    """The four tables of one run."""

    indexes: DataFrame
    per_shard: DataFrame
    collections: DataFrame
    databases: DataFrame


def index_report(
    snapshots: DataFrame, shard_map: DataFrame | None = None, hosts: DataFrame | None = None
) -> IndexReport:
    """Index usage, ops per shard, collection and database rollups.

    With ``hosts`` (host, shard) ops are added up per shard, without it per host.
    """
    # Read for all four tables.
    stats = staged(measured(snapshots), "snapshots")
    ops = index_ops(stats)
    if hosts is None:
        ops = ops.withColumn("shard", F.coalesce("stat_shard", "host", F.lit("")))
    else:
        ops = ops.join(hosts.select("host", "shard"), "host", "left").fillna("", ["shard"])

    index_key = _NS + ["index_name"]
    per_shard_ops = ops.groupBy(*index_key, "shard").agg(F.sum("ops_per_sec").alias("shard_ops"))
    usage = (
        ops.groupBy(*index_key)
        .agg(
            F.sum("ops_per_sec").alias("total_ops"),
            F.min("period").alias("period"),
            F.min("ttl").alias("ttl_min"),
            F.max("ttl").alias("ttl_max"),
            F.count_distinct("shard").alias("n_shards"),
            F.min("key").alias("key"),
        )
        .withColumn(
            "is_ttl",
            F.when(F.col("ttl_min") != F.col("ttl_max"), "mixed").otherwise(F.upper(F.col("ttl_max").cast("string"))),
        )
        .drop("ttl_min", "ttl_max")
    )
    sizes = stats.select(
        *_NS, F.col("count").alias("docs"), F.explode("indexSizes").alias("index_name", "size")
    )
    joined = with_shard_key(sizes.join(usage, index_key, "left"), shard_map)
    is_id = F.col("index_name") == ID_INDEX
    has_stats = F.col("total_ops").isNotNull() | F.col("period").isNotNull()
    indexes = joined.select(
        F.concat_ws(".", "collection", "index_name").alias("name"),
        *_NS,
        "index_name",
        "size",
        "docs",
        "total_ops",
        F.when(~has_stats, F.lit(-1.0))
        .when(F.col("docs") > 0, F.col("size") / F.col("docs"))
        .otherwise(0.0)
        .alias("key_size"),
        "key",
        is_id.alias("is_id"),
        "is_ttl",
        F.coalesce((F.col("total_ops") == 0) & (F.col("is_ttl") == "FALSE"), F.lit(False)).alias("unused"),
        F.coalesce(F.col("period") < NEW_INDEX_SECONDS, F.lit(False)).alias("new_index"),
        F.coalesce(F.col("key") == F.col("shard_key"), F.lit(False)).alias("shard_key"),
        F.col("n_shards"),
    )
    in_use = F.coalesce(F.col("total_ops") > 0, F.lit(False)) | (has_stats & (is_id | (F.col("is_ttl") != "FALSE")))
    per_collection = joined.groupBy(*_NS).agg(
        F.coalesce(F.sum(F.when(in_use, F.col("size"))), F.lit(0)).alias("used_size"),
        F.max("n_shards").alias("n_shards"),
    )
    totals = stats.select(*_NS, "size", "totalIndexSize").join(per_collection, _NS, "left")
    databases = totals.groupBy("db").agg(
        F.count("*").alias("collections"),
        F.sum("size").alias("data_size"),
        F.sum("totalIndexSize").alias("index_size"),
        F.coalesce(F.sum("used_size"), F.lit(0)).alias("used_index_size"),
        F.greatest(F.coalesce(F.max("n_shards"), F.lit(1)), F.lit(1)).alias("n_shards"),
    )
    collections = stats.groupBy("collection").agg(F.count("*").alias("databases"))
    per_shard = indexes.drop("total_ops", "n_shards").join(per_shard_ops, index_key)
    return IndexReport(indexes, per_shard, collections, databases)


# --- the size / usage / merge pipeline -------------------------------------


def with_namespace(snapshots: DataFrame) -> DataFrame:
    """Server and full name of every collection except the summary row."""
    return snapshots.filter(F.col("_id.DB") != ALL_DATABASES).select(
        F.col("_id.Server").alias("server"),
        F.col("_id.DB").alias("db"),
        F.col("_id.Collection").alias("coll"),
        F.concat_ws(".", "_id.DB", "_id.Collection").alias("collection"),
        F.col("collectedAt").alias("ran_at"),
        "indexSizes",
        "indexStats",
    )


def index_sizes(snapshots: DataFrame) -> DataFrame:
    """Total index size and count per collection, largest first."""
    return (
        with_namespace(snapshots)
        .select("server", "db", "collection", F.explode("indexSizes").alias("index", "size"))
        .groupBy("server", "db", "collection")
        .agg(F.sum("size").alias("total_size"), F.count("*").alias("index_count"))
        .orderBy(F.desc("total_size"), "server", "collection")
    )


def index_usage(snapshots: DataFrame) -> DataFrame:
    """Usage of every index over all hosts of a server."""
    return _usage(with_namespace(snapshots))


def _usage(named: DataFrame) -> DataFrame:
    period = seconds_between(F.col("ran_at"), F.col("s.accesses.since"))
    rows = named.select("server", "collection", "ran_at", F.explode("indexStats").alias("s"))
    return (
        rows.select(
            "server",
            F.concat_ws(".", "collection", "s.name").alias("name"),
            (F.col("s.name") == ID_INDEX).alias("is_id"),
            F.col("s.v").alias("v"),
            F.when(F.col("s.accesses.ops") > 0, 1).otherwise(0).alias("used"),
            F.try_divide(F.col("s.accesses.ops"), period).alias("ops"),
            (period / 86400).alias("days"),
        )
        .groupBy("server", "name")
        .agg(
            (F.sum("used") <= 0).alias("unused"),
            F.max("is_id").alias("is_id"),
            F.avg("ops").alias("ops"),
            F.min("days").alias("days"),
            F.count("*").alias("n_shards"),
            F.array_sort(F.collect_set("v")).alias("index_versions"),
        )
    )


def merged_index_table(snapshots: DataFrame) -> DataFrame:
    """Size of every index with its usage; an index without usage keeps NULLs."""
    named = staged(with_namespace(snapshots), "namespaces")
    sizes = named.select(
        "server", "db", "coll", "collection", F.explode("indexSizes").alias("index", "size")
    )
    sizes = sizes.withColumn("name", F.concat_ws(".", "collection", "index"))
    return sizes.join(_usage(named), ["server", "name"], "left").select(
        "server", "name", "index", "size", "ops", "db", F.col("coll").alias("collection"),
        "unused", "is_id", "days", "n_shards", "index_versions",
    )


def oplog_headroom(entries: DataFrame, server: str = "server", ts: str = "ts") -> DataFrame:
    """Hours between the first and the last entry of every server."""
    return entries.groupBy(server).agg(
        (seconds_between(F.max(ts), F.min(ts)) / 3600).alias("headroom_hours")
    )


def nested_paths(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Pick nested values by dotted path; a number is an array position from 0."""

    def pick(path: str) -> Column:
        head, *rest = path.split(".")
        out = F.col(head)
        for part in rest:
            out = F.get(out, F.lit(int(part))) if part.isdigit() else out.getField(part)
        return out

    return df.select(*[pick(path).alias(name) for name, path in paths.items()])
