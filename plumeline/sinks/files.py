"""Report, series, parameter, profile and schema files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumeline.operators.indexes import IndexReport, nested_paths
from plumeline.operators.profile import caption
from plumeline.operators.timeseries import Metric

# Columns of the merged index export.
MERGED_PATHS = {
    "Server": "server", "Idx Path": "name", "Index": "index", "Size": "size", "Ops": "ops", "DB": "db",
    "Collection": "collection", "Unused": "unused", "IsId": "is_id", "Days": "days", "IndexVersion": "index_versions",
}
SIZE_PATHS = {"Server": "server", "DB": "db", "NS": "collection", "TotalSize": "total_size", "Count": "index_count"}


def _csv(columns: Sequence[str]) -> Column:
    return F.to_csv(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]))


def write_sections(sections: DataFrame, path: str) -> None:
    """One text file with a banner, a header and the rows of every section.

    For ranked reports only: each section holds its top rows.
    """
    columns = [c for c in sections.columns if c != "section"]
    rows = sections.withColumn("__at", F.monotonically_increasing_id()).select("section", "__at", _csv(columns).alias("line"))
    first = rows.groupBy("section").agg(F.min("__at").alias("__first"))
    head = F.array(F.col("section"), F.repeat(F.lit("="), F.length("section")), F.lit(",".join(columns)))
    heads = first.select("section", "__first", F.posexplode(head).alias("at", "line"))
    lines = heads.select("__first", F.lit(0).alias("part"), F.col("at").cast("bigint").alias("at"), "line").unionByName(
        rows.join(first, "section").select("__first", F.lit(1).alias("part"), F.col("__at").alias("at"), "line")
    )
    lines.repartition(1).sortWithinPartitions("__first", "part", "at").select("line").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """CSV folder with a header; arrays and maps as JSON text."""
    flat = df.select(
        *[
            F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    flat.write.mode("overwrite").partitionBy(*partition_by).csv(path, header=True)


def write_index_report(report: IndexReport, path: str) -> None:
    """The four tables of an index report, each in its own folder."""
    for suffix, df in (
        ("ind", report.indexes), ("ops", report.per_shard), ("col", report.collections), ("db", report.databases)
    ):
        write_csv(df, f"{path}.{suffix}.csv")


def write_index_exports(sizes: DataFrame, merged: DataFrame, path: str) -> None:
    """The size and merged index tables under their export names."""
    write_csv(nested_paths(sizes, SIZE_PATHS), f"{path}_indexsizes.csv")
    write_csv(nested_paths(merged, MERGED_PATHS), f"{path}_merged.csv")


def _epoch(time: str) -> Column:
    return F.unix_seconds(F.col(time).cast("timestamp")).alias("Time")


def series_table(series: DataFrame, metrics: Sequence[Metric], section: str) -> DataFrame:
    """Epoch seconds and one decorated column per metric."""
    titles = {m.var: f"{m.name}#units={m.unit};section={section}" for m in metrics}
    return series.select(_epoch("Time"), *[F.col(v).alias(t) for v, t in titles.items()]).orderBy("Time")


def crosstab_table(wide: DataFrame, name: str, unit: str, section: str) -> DataFrame:
    """Epoch seconds and one decorated column per item."""
    items = [c for c in wide.columns if c != "Time"]
    return wide.select(
        _epoch("Time"), *[F.col(f"`{i}`").alias(f"{i} {name}#units={unit};section={section}") for i in items]
    ).orderBy("Time")


def parameter_lines(params: DataFrame) -> DataFrame:
    """Parameters of a sample as one CSV line, by shape."""
    return params.select("shape_id", F.array_join("params", ",").alias("line"))


def write_parameters(params: DataFrame, path: str) -> None:
    """One folder of parameter lines per shape."""
    parameter_lines(params).write.mode("overwrite").partitionBy("shape_id").text(path)


def profile_table(profile: DataFrame, style: str = "percent", temperature: bool = False) -> DataFrame:
    """A profile as one row per time and one captioned column per node.

    Nodes become columns, so their number is bounded by the session's pivot limit.
    """
    spark = profile.sparkSession
    limit = int(spark.conf.get("spark.sql.pivotMaxValues", "10000"))
    nodes = profile.filter(F.col("depth") > 0).select("node", "depth", "order_key").distinct()
    listed = nodes.orderBy("order_key").limit(limit + 1).select("node", "depth").collect()
    if len(listed) > limit:
        raise ValueError(f"more than {limit} nodes: use the long profile")
    kinds = ["cold", "hot", "total"] if temperature else ["total"]
    order = spark.createDataFrame(
        [(r["node"], r["depth"] - 1, i * len(kinds)) for i, r in enumerate(listed)], "node array<string>, level int, at int"
    )
    value = {"cold": F.col("value") - F.col("hot"), "hot": F.col("hot"), "total": F.col("value")}
    # Chart colours of the three temperature columns.
    colour = {"cold": 0, "hot": 1, "total": 5}

    def title(i: int, kind: str) -> Column:
        extra = F.lit(f"distinctName={kind};color={colour[kind]}") if temperature else None
        return caption(F.col("at") + i, F.element_at("node", -1), F.col("level"), style, extra)

    cells = F.explode(F.array(*[F.struct(title(i, k).alias("caption"), value[k].alias("cell")) for i, k in enumerate(kinds)]))
    rows = profile.join(F.broadcast(order), "node").select("ts", cells.alias("c")).select("ts", "c.*")
    names = [r["caption"] for r in order.select(F.explode(F.array(*[title(i, k) for i, k in enumerate(kinds)])).alias("caption")).orderBy("caption").collect()]
    return rows.groupBy(F.col("ts").alias("time")).pivot("caption", names).agg(F.sum("cell")).fillna(0).orderBy("time")


def stack_lines(samples: DataFrame, thread: Column | None = None) -> DataFrame:
    """Stack samples as text lines under their format directive."""
    stack = F.array_join("stack", ";")
    parts = [F.col("ts").cast("string")] + ([thread] if thread is not None else []) + [stack]
    return samples.filter(F.size("stack") > 0).select(F.concat_ws(";", *parts).alias("value"))


def write_stacks(samples: DataFrame, path: str, thread: Column | None = None) -> None:
    """Stack text; the folder's first file holds the format line."""
    head = samples.sparkSession.createDataFrame([("#format timestamp;stack",)], "value string").coalesce(1)
    head.unionByName(stack_lines(samples, thread)).write.mode("overwrite").text(path)


def write_schema(schema: DataFrame, path: str) -> None:
    """The validator document as one text file."""
    schema.select("schema").coalesce(1).write.mode("overwrite").text(path)
