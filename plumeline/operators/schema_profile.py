"""Field statistics of a document table and the JSON schema made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumeline.functions.flatten import flatten_json
from plumeline.session import staged

# Profile type names, and the schema type each stands for.
PROFILE_TYPES = {
    "object": "Document",
    "array": "Array",
    "string": "String",
    "Integer64": "Long",
    "number": "Double",
    "boolean": "Boolean",
    "null": "Null",
    "date": "Date",
    "binary": "Binary",
}
BSON_TYPES = {
    "Double": "double",
    "String": "string",
    "Object": "object",
    "Document": "object",
    "Array": "array",
    "Binary": "binData",
    "Undefined": "undefined",
    "ObjectID": "objectId",
    "Boolean": "bool",
    "Date": "date",
    "Null": "null",
    "Regular": "regex",
    "DBPointer": "dbPointer",
    "JavaScript": "javascript",
    "JavaScriptWithScope": "javascriptWithScope",
    "Symbol": "symbol",
    "Int32": "int",
    "Timestamp": "timestamp",
    "Long": "long",
    "Decimal128": "decimal",
}


def _mapped(column: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), column)


def profile_schema(df: DataFrame, body: str = "body", row_key: str = "id") -> DataFrame:
    """``path, level, count, probability, types, has_duplicates`` per field.

    ``count`` is the number of values, ``probability`` the share of readable
    documents that hold the field.  A value is known by 128 bits of hashes, so
    no text is shuffled; values are counted first, so a hot field is spread
    over many reducers.
    """
    flat = flatten_json(df, body, [row_key], containers=True, positions=False).select(
        row_key, "path", _mapped(F.col("type"), PROFILE_TYPES).alias("type"), "value"
    )
    scalar = ~F.col("type").isin("Document", "Array") & F.col("value").isNotNull()
    hashes = [F.when(scalar, F.xxhash64(F.lit(seed), "value")).alias(f"h{seed}") for seed in (1, 2)]
    by_value = flat.groupBy("path", "type", *hashes).agg(F.count("*").alias("n"))
    by_type = by_value.groupBy("path", "type").agg(
        F.sum("n").alias("n"), F.max(F.when(F.col("h1").isNotNull(), F.col("n"))).alias("most")
    )
    by_path = staged(
        by_type.groupBy("path").agg(
            F.sum("n").alias("count"),
            F.coalesce(F.max("most") > 1, F.lit(False)).alias("has_duplicates"),
            F.array_sort(F.collect_list(F.struct("type", "n"))).alias("__types"),
        ),
        "profile",
    )
    # Every readable document has one root.
    total = by_path.filter(F.size("path") == 0).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("docs"))
    docs = F.lit(total.first()["docs"])
    # A path outside arrays occurs once per document, so its values count its
    # documents; only paths inside arrays need the distinct documents.
    inside = by_path.filter(F.array_contains("path", "[]")).limit(1).count()
    out = by_path.filter(F.size("path") > 0)
    if inside:
        holders = (
            flat.filter(F.array_contains("path", "[]"))
            .groupBy("path", row_key)
            .agg(F.lit(1).alias("one"))
            .groupBy("path")
            .agg(F.count("*").alias("holders"))
        )
        out = out.join(holders, "path", "left")
    else:
        out = out.withColumn("holders", F.lit(None).cast("bigint"))
    return out.select(
        "path",
        F.size("path").alias("level"),
        "count",
        (F.coalesce("holders", "count") / docs).alias("probability"),
        F.transform(
            "__types", lambda t: F.struct(t["type"].alias("type"), (t["n"] * 100 / F.col("count")).alias("percent"))
        ).alias("types"),
        "has_duplicates",
    )


def dominant_type(profile: DataFrame) -> DataFrame:
    """One type per field: the most frequent, NULL values left out when others exist."""
    real = F.filter("types", lambda t: t.type != "Null")
    pool = F.when(F.size(real) > 0, real).otherwise(F.col("types"))
    best = F.element_at(F.array_sort(F.transform(pool, lambda t: F.struct(-t.percent, t.type.alias("type")))), 1)
    return profile.withColumn("type", best["type"])


def to_json_schema(
    choice: DataFrame,
    title: str = "Auto Generated Schema",
    description: str = "Fill this here",
    required_from: float = 1.0,
    level: str = "moderate",
    action: str = "warn",
) -> DataFrame:
    """One row with the validator document as JSON text.

    ``choice`` holds ``path, type`` and, when known, ``probability`` and
    ``description``.  Levels are folded bottom-up: every round groups the fields
    of one depth under their parents.
    """
    cols = set(choice.columns)
    nodes = choice.select(
        "path",
        F.col("type"),
        (F.col("probability") >= required_from if "probability" in cols else F.lit(False)).alias("required"),
        (F.col("description") if "description" in cols else F.lit(None).cast("string")).alias("description"),
    ).withColumn("depth", F.size("path"))
    # One row per field, read once per level.
    nodes = staged(nodes, "schema-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    empty = "path array<string>, props string, req array<string>, items string"
    below = choice.sparkSession.createDataFrame([], empty)
    for depth in range(deepest, 0, -1):
        here = nodes.filter(F.col("depth") == depth).join(below, "path", "left")
        body = F.concat_ws(
            ",",
            F.concat(F.lit('"bsonType":"'), _mapped(F.col("type"), BSON_TYPES), F.lit('"')),
            F.when(F.col("description").isNotNull(), F.concat(F.lit('"description":'), _quoted(F.col("description")))),
            F.when(F.col("type") == "Array", F.concat(F.lit('"items":'), "items")),
            F.when(F.col("type").isin("Document", "Object") & F.col("props").isNotNull(), _properties()),
        )
        node = here.select(
            F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0))).alias("path"),
            F.element_at("path", -1).alias("name"),
            F.concat(F.lit("{"), body, F.lit("}")).alias("node"),
            "required",
        )
        is_item = F.col("name") == "[]"
        field = F.when(~is_item, F.struct("name", F.concat(_quoted(F.col("name")), F.lit(":"), "node").alias("text")))
        below = node.groupBy("path").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(field)), lambda f: f.text), ",").alias("props"),
            F.array_sort(F.collect_list(F.when(~is_item & F.col("required"), F.col("name")))).alias("req"),
            F.max(F.when(is_item, F.col("node"))).alias("items"),
        )
        below = below.withColumn("props", F.when(F.col("props") != "", F.col("props")))
    head = ",".join(
        f'"{k}":{v}' for k, v in (("title", _json(title)), ("description", _json(description)), ("bsonType", '"object"'))
    )
    schema = F.concat(F.lit("{" + head), F.when(F.col("props").isNotNull(), F.concat(F.lit(","), _properties())).otherwise(""), F.lit("}"))
    return below.filter(F.size("path") == 0).select(
        F.concat(
            F.lit('{"validator":{"$jsonSchema":'),
            schema,
            F.lit(f'}},"validationLevel":{_json(level)},"validationAction":{_json(action)}}}'),
        ).alias("schema")
    )


def _properties() -> Column:
    required = F.when(F.size("req") > 0, F.concat(F.lit(',"required":'), F.to_json("req"))).otherwise("")
    return F.concat(F.lit('"properties":{'), "props", F.lit("}"), required)


def _quoted(text: Column) -> Column:
    # to_json of a one-element array escapes the text; drop the brackets.
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def _json(text: str) -> str:
    import json

    return json.dumps(text)
