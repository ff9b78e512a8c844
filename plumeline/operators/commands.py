"""Re-normalise stored command strings and extract load-test parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumeline.functions.jsonpath import any_match
from plumeline.functions.relaxed import relaxed_to_json, stored_to_json
from plumeline.functions.shape import has_operator, query_shape, shallow_shape
from plumeline.functions.text import literal_text
from plumeline.functions.times import iso_duration
from plumeline.operators.lookups import join_with_fallback
from plumeline.session import staged

# Commands with a write concern, and the one assumed.
WRITE_COMMANDS = ("insert", "update", "remove", "findAndModify")
DEFAULT_CONCERN = '{"w":"default"}'

def ratio(docs: Column, returned: Column, mode: str = "double") -> Column:
    """Documents examined per document returned.

    ``double``: NULL when nothing was returned.  ``integer``: whole division with
    a floor of one returned document, NULL for 0.
    """
    if mode == "double":
        return F.try_divide(docs.cast("double"), returned.cast("double"))
    if mode == "integer":
        value = F.floor(docs / F.greatest(returned, F.lit(1))).cast("double")
        return F.when(value != 0, value)
    raise ValueError(f"unknown ratio mode {mode!r}")


def normalise_commands(df: DataFrame, ratio_mode: str = "integer") -> tuple[DataFrame, DataFrame]:
    """Stored ``Command`` strings to shapes and options.

    Input: ``id, Command, originatingCommand, docsExamined, nreturned``.
    Returns the rows that could be read and the rejected ones with a reason.
    """
    name = F.regexp_extract("Command", r"^\s*(\w+)", 1)
    has_origin = F.coalesce(F.col("originatingCommand") != "", F.lit(False))
    body = F.when(name == "getMore", F.when(has_origin, F.col("originatingCommand"))).otherwise(
        F.regexp_extract("Command", r"(?s)^[^{]*(\{.*)$", 1)
    )
    rows = (
        df.filter(F.col("Command").isNotNull())
        .withColumns({"cmd_type": name, "__body": body})
        .filter(F.col("__body").isNotNull())
        .withColumn("__doc", stored_to_json(F.col("__body")))
    )
    # Parsed once: the good and the rejected rows read it.
    rows = staged(rows, "commands")
    rejects = rows.filter(F.col("__doc").isNull()).select(
        "id", F.col("__body").alias("raw"), F.lit("not a document").alias("error")
    )

    def get(path: str) -> Column:
        return F.get_json_object("__doc", f"$.{path}")

    kind = F.col("cmd_type")
    filter_text = (
        F.when(kind == "find", get("filter"))
        .when(kind.isin("count", "findAndModify", "distinct"), get("query"))
        .when(kind == "aggregate", any_match(get("pipeline")))
    )
    concern = F.coalesce(get("writeConcern"), F.when(kind.isin(*WRITE_COMMANDS), F.lit(DEFAULT_CONCERN)))
    limit = F.when(
        (kind == "find") & get("limit").isNotNull(), F.coalesce(get("limit").try_cast("int"), F.lit(1))
    )
    good = rows.filter(F.col("__doc").isNotNull() & (kind != "getMore"))
    shaped = good.withColumns({"__filter": filter_text, "writeConcern": concern, "limit": limit}).withColumns(
        {
            "__shape": query_shape("__filter"),
            "sort": F.when(kind == "find", shallow_shape(get("sort"))),
            "hint": F.when(kind == "find", shallow_shape(get("hint"))),
            "Ratio": ratio(F.col("docsExamined"), F.col("nreturned"), ratio_mode),
            "hasNE": has_operator(F.col("__filter"), "$ne"),
            "hasNIN": has_operator(F.col("__filter"), "$nin"),
        }
    )
    return (
        shaped.select(
            "id", "cmd_type",
            F.when(F.col("__filter").isNotNull(), F.col("__shape.shape")).alias("filter"),
            F.when(F.col("__filter").isNotNull(), F.col("__shape.params")).alias("filter_params"),
            "Ratio", "sort", "hint", "limit", "writeConcern", "hasNE", "hasNIN",
        ),
        rejects,
    )


def normalise_updates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored ``Update`` and ``Query`` strings to filter, set and insert shapes."""
    rows = df.filter(F.col("Update").isNotNull()).withColumns(
        {
            "__doc": stored_to_json(F.col("Update")),
            "__filter": stored_to_json(F.col("Query")),
        }
    )
    rows = staged(rows, "updates")
    rejects = rows.filter(F.col("__doc").isNull()).select(
        "id", F.col("Update").alias("raw"), F.lit("not a document").alias("error")
    )
    parts = {
        "filter": F.col("__filter"),
        "soi": F.get_json_object("__doc", "$.$setOnInsert"),
        "set": F.get_json_object("__doc", "$.$set"),
    }
    good = rows.filter(F.col("__doc").isNotNull()).withColumns({f"__{n}_json": c for n, c in parts.items()})
    good = good.withColumns({f"__{n}_shape": query_shape(f"__{n}_json") for n in parts})

    def both_have(op: str) -> Column:
        out = F.lit(False)
        for n in parts:
            out = out | has_operator(F.col(f"__{n}_json"), op)
        return out

    columns = []
    for n in parts:
        there = F.col(f"__{n}_json").isNotNull()
        columns.append(F.when(there, F.col(f"__{n}_shape.shape")).alias(n))
        columns.append(F.when(there, F.col(f"__{n}_shape.params")).alias(f"{n}_params"))
    return (
        good.select(
            "id", F.get_json_object("__doc", "$.upsert").try_cast("boolean").alias("upsert"), *columns,
            both_have("$ne").alias("hasNE"), both_have("$nin").alias("hasNIN"),
        ),
        rejects,
    )


def normalise_test_queries(df: DataFrame) -> DataFrame:
    """Columns of stored test queries: namespace, count flag, limit and filter shape."""
    shaped = df.filter(F.col("query").isNotNull()).withColumn("__json", relaxed_to_json(F.col("query")))
    shaped = shaped.withColumn("__shape", query_shape("__json"))
    there = F.col("__json").isNotNull()
    return shaped.select(
        "id",
        F.concat_ws(".", "db", "collection").alias("ns"),
        F.coalesce(F.col("doCount") == "TRUE", F.lit(False)).alias("hasCount"),
        F.coalesce("limit", F.lit(0)).alias("limit"),
        F.when(there, F.col("__shape.shape")).alias("filter"),
        F.when(there, F.col("__shape.params")).alias("filter_params"),
    )


def last_changes(changes: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """One change for each key, as if they were made one after the other: the last value of every column.

    ``order`` sorts the changes of a key; without it the columns do, in turn.
    """
    names = [c for c in changes.columns if c != key]
    place = F.struct(*names) if order is None else F.struct(order.alias("at"), *names)
    row = F.max_by(F.struct(*names), place)
    return changes.groupBy(key).agg(row.alias("__last")).select(key, *[F.col(f"__last.{c}").alias(c) for c in names])


def update_by_key(table: DataFrame, changes: DataFrame, key: str = "id", order: Column | None = None) -> DataFrame:
    """``table`` with the columns of ``changes`` set where the key has a change; of several the last by ``order`` counts."""
    changes = last_changes(changes, key, order)
    names = [c for c in changes.columns if c != key]
    renamed = changes.select(key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in names])
    joined = table.join(renamed, key, "left")
    have = set(table.columns)
    new = {
        c: (F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) if c in have else F.col(f"__new_{c}"))
        for c in names
    }
    return joined.withColumns(new).select(*table.columns, *[c for c in names if c not in have])


def update_stored(spark: SparkSession, path: str, changes: DataFrame, key: str, partition: str, order: Column | None = None) -> int:
    """Apply changes to a Parquet table partitioned by ``partition``; returns the number of partitions written anew.

    Only partitions that hold a changed key are read as a whole and replaced; the result does not depend on how often it
    is run.  ``partition`` itself can't be changed.
    """
    changes = last_changes(changes, key, order)
    if partition in changes.columns:
        raise ValueError(f"{partition} places the rows and can't be changed")
    table = spark.read.parquet(path)
    touched = table.join(changes.select(key), key, "left_semi").select(partition).distinct()
    values = [r[0] for r in touched.collect()]  # names of folders
    if not values:
        return 0
    known = [v for v in values if v is not None]
    there = F.col(partition).isin(known) | (F.col(partition).isNull() if len(known) < len(values) else F.lit(False))
    # Written aside first: a table can't be replaced while it is read.
    fresh = staged(update_by_key(table.filter(there), changes, key), "updated")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return len(values)


def extract_parameters(ranked: DataFrame, samples: DataFrame, run_time) -> tuple[DataFrame, DataFrame]:
    """One row of literal parameters per sample of a ranked shape.

    ``ranked``: ``ns, filter, stage_rank, prd_rank``; ``samples``: ``id, object,
    collection, filter_shape, filter_params``.  A shape without samples is tried
    with ``[ N ]`` read as ``[ 1 ]`` against the collection column.  Dates become
    the distance to ``run_time``.  Rows are in order of ``prd_rank``.  Second
    result: ranked shapes without data.
    """
    wanted = ranked.filter(F.col("stage_rank").isNotNull()).withColumn("shape_id", F.xxhash64("ns", "filter"))
    single = F.replace("filter", F.lit("[ N ]"), F.lit("[ 1 ]"))
    rows = join_with_fallback(
        wanted, samples, [("filter", "filter_shape"), ("ns", "object")], [(single, "filter_shape"), (F.col("ns"), "collection")]
    )
    at = F.lit(run_time).cast("timestamp")
    values = F.transform(
        "filter_params",
        lambda p: F.when(
            p["type"] == "date",
            F.struct(
                F.lit("shift").alias("kind"),
                iso_duration(
                    F.coalesce(
                        F.timestamp_millis(p["value"].try_cast("bigint")),
                        F.try_to_timestamp(p["value"]),
                    ),
                    at,
                ).alias("text"),
            ),
        ).otherwise(F.struct(p["type"].alias("kind"), literal_text(p["type"], p["value"]).alias("text"))),
    )
    literals = F.filter(values, lambda v: v["kind"] != "shift")
    shifts = F.filter(values, lambda v: v["kind"] == "shift")
    params = rows.select(
        "shape_id", "ns", "filter", "prd_rank", F.col("id").alias("sample_id"), "match",
        F.transform(literals, lambda v: v["text"]).alias("params"),
        F.transform(shifts, lambda v: v["text"]).alias("shifts"),
    )
    missing = wanted.join(params.select("shape_id").distinct(), "shape_id", "left_anti").select("ns", "filter", "prd_rank")
    return params.orderBy("prd_rank", "ns", "filter", "sample_id"), missing.orderBy("prd_rank", "ns", "filter")
