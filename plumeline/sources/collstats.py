"""Collection-stats snapshots and shard maps printed by a database shell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumeline.functions.relaxed import relaxed_to_json
from plumeline.sources.lines import UTF8, number_lines, read_lines, stitch_files

# How a document begins, and stray log lines between its lines.
DOCUMENT_START = {"doc": r"^\s*\{ _id\s*:"}
STRAY_LINE = r"(?m)^[0-9]{4}-[0-9]{2}-[0-9]{2}T.*$"

_DATE = "struct<`$date`:string>"
_SHARD = (
    "struct<NumIndexes:int,totalIndexSize:bigint,size:bigint,count:bigint,avgObjSize:bigint,storageSize:bigint,"
    "freeSpace:bigint,indexSizes:map<string,bigint>>"
)
_STAT = (
    f"struct<name:string,key:string,host:string,shard:string,v:int,accesses:struct<ops:bigint,since:{_DATE}>,"
    "spec:struct<v:int,key:string,name:string,expireAfterSeconds:bigint>>"
)
# Fields of a snapshot document.
SNAPSHOT = (
    "_id struct<Server:string,DB:string,Collection:string>, "
    f"runTime {_DATE}, collectedAt {_DATE}, NumIndexes int, totalIndexSize bigint, size bigint, count bigint, "
    "avgObjSize bigint, storageSize bigint, freeSpace bigint, maxSize bigint, headroom double, "
    f"indexSizes map<string,bigint>, shardStats map<string,{_SHARD}>, indexStats array<{_STAT}>"
)


def _time(date: Column) -> Column:
    return F.try_to_timestamp(date["$date"])


def snapshots_from_json(documents: DataFrame, column: str = "json") -> DataFrame:
    """Snapshot table from strict JSON documents."""
    d = documents.select("*", F.from_json(column, SNAPSHOT).alias("d"))
    stats = F.transform(
        "d.indexStats",
        lambda s: F.struct(
            s["name"].alias("name"), s["key"].alias("key"), s["host"].alias("host"), s["shard"].alias("shard"),
            s["v"].alias("v"),
            F.when(
                s["accesses"].isNotNull(),
                F.struct(s["accesses"]["ops"].alias("ops"), _time(s["accesses"]["since"]).alias("since")),
            ).alias("accesses"),
            s["spec"].alias("spec"),
        ),
    )
    plain = [n.split()[0] for n in SNAPSHOT.split(", ")]
    made = {
        "runTime": F.coalesce(_time(F.col("d.runTime")), _time(F.col("d.collectedAt"))),
        "collectedAt": F.coalesce(_time(F.col("d.collectedAt")), _time(F.col("d.runTime"))),
        "indexStats": F.filter(stats, lambda s: s["name"].isNotNull()),
    }
    return d.select(*[(made[n] if n in made else F.col(f"d.{n}")).alias(n) for n in plain])


def read_snapshots(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Snapshots of shell output, and the documents that could not be read.

    Everything ahead of the first document of a file, banner included, is no
    document; stray log lines inside one are dropped.
    """
    entries = stitch_files(read_lines(spark, paths, UTF8), patterns=DOCUMENT_START).entries
    text = F.regexp_replace("entry", STRAY_LINE, "")
    # Anything behind the last closing brace is shell chatter.
    docs = entries.filter(F.col("format") == "doc").withColumn("json", relaxed_to_json(F.regexp_extract(text, r"(?s)^(.*\})", 1)))
    rejects = docs.filter(F.col("json").isNull()).select(
        "infile", "lineno", F.col("entry").alias("raw"), F.lit("unreadable snapshot").alias("error")
    )
    return snapshots_from_json(docs.filter(F.col("json").isNotNull())), rejects


def oplog_rows(snapshots: DataFrame) -> DataFrame:
    """The operation-log rows of the snapshots."""
    return snapshots.filter((F.col("_id.DB") == "local") & (F.col("_id.Collection") == "oplog.rs")).select(
        "_id.Server", "size", "maxSize", "headroom", "avgObjSize", "storageSize"
    )


# Layout of the cluster status text.
DATABASES_LINE = "  databases"
DATABASE = (
    r'\{\s*"_id"\s*:\s*"([a-zA-Z0-9_.]*)".*"primary"\s*:\s*"([a-zA-Z0-9_]*)".*"partitioned"\s*:\s*(true|false)'
)
COLLECTION_INDENT = " " * 16
KEY_PREFIX = "shard key: "


def read_shard_map(spark: SparkSession, paths: Sequence[str], encoding: str = UTF8) -> DataFrame:
    """``db, primary, collection, shard_key`` from cluster status text.

    A status text lists collections, not data, so one window per file is enough.
    """
    lines = number_lines(read_lines(spark, paths, encoding))
    w = Window.partitionBy("infile").orderBy("lineno")
    is_db = F.col("value").rlike(DATABASE)
    db = F.when(
        is_db,
        F.struct(*[F.regexp_extract("value", DATABASE, i).alias(n) for i, n in enumerate(("name", "primary", "partitioned"), 1)]),
    )
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = lines.withColumns(
        {
            "listed": F.max(F.col("value").startswith(DATABASES_LINE)).over(upto),
            "db": F.last(db, ignorenulls=True).over(upto),
            "next": F.lead("value").over(w),
        }
    )
    prefix = F.concat(F.lit(COLLECTION_INDENT), F.col("db.name"), F.lit("."))
    name = F.regexp_extract(F.substring("value", F.length(prefix) + 1, F.length("value")), r"^([a-zA-Z0-9_.]*)", 1)
    key = F.regexp_replace(F.trim("next"), f"^{KEY_PREFIX}", "")
    return seen.filter(
        F.col("listed") & ~is_db & (F.col("db.partitioned") == "true") & F.col("value").startswith(prefix)
    ).select(
        F.col("db.name").alias("db"),
        F.col("db.primary").alias("primary"),
        name.alias("collection"),
        F.coalesce(relaxed_to_json(key), key).alias("shard_key"),
    )
