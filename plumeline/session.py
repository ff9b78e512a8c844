"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  Cluster sizing (executors, memory, shuffle
# partitions) stays with whoever submits the job; AQE sizes the reducers.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Staged tables have a few partition values: write them without a sort.
    "spark.sql.maxConcurrentOutputFileWriters": "64",
}


def build_session(app_name: str = "plumeline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library defaults; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return configured


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's staged tables below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/plumeline-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one staged table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all staged tables of this application; results that still read them fail afterwards."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def staged(df, name: str, partition_by: tuple[str, ...] = ()):
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage with a table that outlives lost executors, and fixes anything
    that depends on how the input was split.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
