"""Stack samples and schema-analysis exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumeline.functions.flatten import walk_json
from plumeline.functions.text import clean_function_name
from plumeline.operators.lookups import with_dictionary
from plumeline.operators.running import LastValue, with_running
from plumeline.sources.lines import UTF8, number_lines, read_lines

# Directives and field names of a stack file.
FORMAT, DICTIONARY = "#format", "#stack"
FIELDS = ("timestamp", "time", "count", "stack", "stack-id")
DEFAULT_FORMAT = "stack"


def read_stacks(
    spark: SparkSession, paths: Sequence[str], sanitize: Callable[[Column], Column] | None = clean_function_name
) -> tuple[DataFrame, DataFrame]:
    """``file, ts, stack, weight, is_time`` and the lines with too few fields.

    A ``#format`` line holds until the next one; lines ahead of the first are stacks.
    """
    lines = number_lines(read_lines(spark, paths, UTF8)).withColumn("value", F.rtrim("value"))
    directive = F.col("value").startswith("#")
    given = F.when(F.col("value").startswith(FORMAT), F.split(F.regexp_extract("value", r"^#format\s+(.*)$", 1), ";"))
    lines = with_running(lines, ["infile"], ["lineno"], F.col("block"), [LastValue(given, "fmt")])
    names = r"^#stack\s+(\S+)\s+(.*)$"
    dictionary = lines.filter(F.col("value").rlike(names)).select(
        "infile",
        F.regexp_extract("value", names, 1).alias("stack_id"),
        F.split(F.regexp_extract("value", names, 2), ";").alias("frames"),
    )
    rows = (
        lines.filter(~directive & (F.col("value") != ""))
        .withColumns({"fmt": F.coalesce("fmt", F.array(F.lit(DEFAULT_FORMAT))), "f": F.split("value", ";")})
    )
    rejects = rows.filter(F.size("f") < F.size("fmt")).select(
        "infile", F.col("value").alias("raw"), F.lit("too few fields").alias("error")
    )

    def field(name: str) -> Column:
        at = F.array_position("fmt", name)
        return F.when(at > 0, F.get("f", (at - 1).cast("int")))

    at_stack = F.array_position("fmt", "stack").cast("int")
    weight = F.coalesce(field("count").try_cast("double"), field("time").try_cast("double"), F.lit(1.0))
    good = rows.filter(F.size("f") >= F.size("fmt")).select(
        "infile",
        F.coalesce(field("timestamp").try_cast("double"), F.lit(0.0)).alias("ts"),
        field("stack-id").alias("stack_id"),
        F.when(at_stack > 0, F.slice("f", F.greatest(at_stack, F.lit(1)), F.size("f"))).alias("stack"),
        weight.alias("weight"),
        (F.array_position("fmt", "time") > 0).alias("is_time"),
    )
    by_id = with_dictionary(good.filter(F.col("stack_id").isNotNull()), dictionary.withColumnRenamed("infile", "dict_file"), "stack_id").filter(
        F.col("infile") == F.col("dict_file")
    )
    out = good.filter(F.col("stack_id").isNull()).select("infile", "ts", "stack", "weight", "is_time").unionByName(
        by_id.select("infile", "ts", F.col("frames").alias("stack"), "weight", "is_time")
    )
    if sanitize is not None:
        out = out.withColumn("stack", F.transform("stack", sanitize))
    return out.select(F.col("infile").alias("file"), "ts", "stack", "weight", "is_time"), rejects


# Names in a schema-analysis export.
ARRAY, DOCUMENT, ITEMS = "Array", "Document", "[]"


_EXPORT = T.StructType(
    [
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("level", T.IntegerType()),
        T.StructField("count", T.DoubleType()),
        T.StructField("probability", T.DoubleType()),
        T.StructField("types", T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("percent", T.DoubleType())]))),
        T.StructField("has_duplicates", T.BooleanType()),
    ]
)


def _number(value) -> float | None:
    return None if value is None or isinstance(value, (dict, list, bool)) else float(value)


def _export_fields(document) -> Iterator[tuple]:
    """A row for every field of an analysis export, at any depth."""
    waiting = [((), document.get("fields"))] if isinstance(document, dict) else []
    while waiting:
        above, fields = waiting.pop(0)
        for field in fields or []:
            kinds = field.get("types") or []
            name, count = field.get("name"), _number(field.get("count"))
            path = (*above, ITEMS if name == ARRAY else name)
            is_array = bool(kinds) and kinds[0].get("name") == ARRAY
            if not kinds:
                types = [{"type": "Undefined", "percent": 100.0}]
            elif is_array:
                types = [{"type": ARRAY, "percent": 100.0}]
            else:
                share = lambda k: _number(k.get("count")) * 100 / count if count and k.get("count") is not None else None
                types = [{"type": k.get("name"), "percent": share(k)} for k in kinds]
            yield list(path), len(path), count, _number(field.get("probability")), types, field.get("has_duplicates") is True
            inner = kinds if is_array else next((k.get("fields") for k in kinds if k.get("name") == DOCUMENT), None)
            if inner:
                waiting.append((path, inner))


def read_schema_export(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, path, level, count, probability, types, has_duplicates`` of analysis exports, down to the last level."""
    docs = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return walk_json(docs, "value", ["file"], _export_fields, _EXPORT)
