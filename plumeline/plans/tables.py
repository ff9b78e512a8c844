"""The given tables seen as logs, snapshots, samples and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows in even parts, for work that costs far more than reading them: a table may be one row group, and that one task."""
    return rows.repartition(key)


def prop_k() -> F.col:
    """The number in ``events.props``."""
    return F.get_json_object("props", "$.k").cast("bigint")


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as slow operations: user = collection, type = command and shape."""
    return read(spark, sf_dir, "events").select(
        "ts",
        F.lit("events").alias("infile"),
        F.col("event_id").alias("lineno"),
        F.col("event_type").alias("command"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("object"),
        F.lit(None).cast("string").alias("query_hash"),
        F.concat(F.lit("{"), F.col("event_type"), F.lit(": 1}")).alias("filter_shape"),
        F.when(F.col("event_type") == "error", "COLLSCAN").otherwise("IXSCAN").alias("plan_summary"),
        F.floor(F.col("value") * 100).cast("bigint").alias("duration_millis"),
        F.floor(F.col("value") * 10).cast("bigint").alias("docs_examined"),
        prop_k().alias("nreturned"),
        F.try_divide(F.floor(F.col("value") * 10).cast("double"), prop_k().cast("double")).alias("ratio"),
        F.when(prop_k() > 50, F.lit(True)).alias("has_sort_stage"),
        F.col("props").alias("attr"),
        F.lit(None).cast("string").alias("originating_command"),
    )


def line_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as router operations: part = collection, line number = shards."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("ts"),
        F.lit("lineitem").alias("infile"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lineno"),
        F.lit("find").alias("command"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("object"),
        F.lit(None).cast("string").alias("query_hash"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("filter_shape"),
        F.col("l_linestatus").alias("plan_summary"),
        F.floor(F.col("l_extendedprice")).cast("bigint").alias("duration_millis"),
        F.floor(F.col("l_extendedprice")).cast("bigint").alias("docs_examined"),
        F.floor(F.col("l_quantity")).cast("bigint").alias("nreturned"),
        F.try_divide(F.floor(F.col("l_extendedprice")).cast("double"), F.floor(F.col("l_quantity")).cast("double")).alias("ratio"),
        F.lit(None).cast("boolean").alias("has_sort_stage"),
        F.col("l_linenumber").cast("bigint").alias("n_shards"),
        F.lit(None).cast("string").alias("attr"),
        F.lit(None).cast("string").alias("originating_command"),
    )


def part_collection() -> F.col:
    """Collection of a part: its type and a block of 64 part keys, so no collection grows with the table."""
    return F.concat_ws("-", "p_type", F.floor(F.col("p_partkey") / 64).cast("string"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and their line items as collection-stats snapshots.

    Server ``s``, database = brand, collection = ``part_collection``, index = part
    name, host = return flag; index ops are line items, the first ship date is
    ``since``.
    """
    part = read(spark, sf_dir, "part").withColumn("coll", part_collection())
    line = read(spark, sf_dir, "lineitem")
    ns = ["p_brand", "coll"]
    sizes = part.groupBy(*ns, "p_name").agg(F.sum("p_size").cast("bigint").alias("bytes"))
    size_map = sizes.groupBy(*ns).agg(
        F.map_from_entries(F.collect_list(F.struct("p_name", "bytes"))).alias("indexSizes"),
        F.sum("bytes").alias("totalIndexSize"),
    )
    docs = part.groupBy(*ns).agg(
        F.count("*").alias("count"), F.sum(F.floor("p_retailprice")).cast("bigint").alias("size")
    )
    # Line items are added up per part before the part columns are joined on.
    per_part = line.groupBy("l_partkey", "l_returnflag").agg(
        F.sum(F.when(F.col("l_quantity") > 45, 1).otherwise(0)).cast("bigint").alias("ops"),
        F.min("l_shipdate").alias("since"),
        F.min("l_suppkey").alias("supp"),
    )
    use = (
        per_part.join(part.select("p_partkey", *ns, "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(*ns, "p_name", "l_returnflag")
        .agg(F.sum("ops").alias("ops"), F.min("since").alias("since"), F.min("supp").alias("supp"))
    )
    expire = F.when(F.col("p_name").startswith("red") & (F.col("supp") < 5), F.lit(3600).cast("bigint"))
    stats = use.groupBy(*ns).agg(
        F.collect_list(
            F.struct(
                F.col("p_name").alias("name"),
                F.concat(F.lit('{"'), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit('":1}')).alias("key"),
                F.col("l_returnflag").alias("host"),
                F.when(F.col("l_returnflag") == "A", "s0").otherwise("s1").alias("shard"),
                F.when(F.col("ops") > 2, 2).otherwise(1).alias("v"),
                F.struct(F.col("ops"), F.col("since")).alias("accesses"),
                F.struct(F.lit(2).alias("v"), F.lit("").alias("key"), F.col("p_name").alias("name"), expire.alias("expireAfterSeconds")).alias("spec"),
            )
        ).alias("indexStats")
    )
    at = F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    return (
        size_map.join(docs, ns)
        .join(stats, ns, "left")
        .select(
            F.struct(F.lit("s").alias("Server"), F.col("p_brand").alias("DB"), F.col("coll").alias("Collection")).alias("_id"),
            at.alias("runTime"),
            at.alias("collectedAt"),
            "totalIndexSize",
            "size",
            "count",
            "indexSizes",
            "indexStats",
        )
    )


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as stack samples: ship year, then flag, status and line number."""
    return read(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").cast("double").alias("ts"),
        F.array(
            F.concat(F.lit("flag_"), F.col("l_returnflag")),
            F.concat(F.lit("status_"), F.col("l_linestatus")),
            F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")),
        ).alias("stack"),
        F.col("l_quantity").alias("weight"),
    )


def order_documents(spark: SparkSession, sf_dir: str, altered: bool) -> DataFrame:
    """Orders as JSON documents; the altered side changes, retypes, drops and adds fields."""
    orders = read(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    price = F.floor("o_totalprice").cast("bigint")
    if not altered:
        body = F.struct(
            F.col("o_custkey").alias("cust"),
            F.struct(status.alias("status"), price.alias("price")).alias("state"),
            F.col("o_orderpriority").alias("priority"),
        )
        return orders.select(F.col("o_orderkey").alias("id"), F.to_json(body).alias("body"))
    cust = F.when(status == "F", F.concat(F.lit('"'), F.col("o_custkey").cast("string"), F.lit('"'))).otherwise(
        F.col("o_custkey").cast("string")
    )
    text = F.concat(
        F.lit('{"cust":'), cust,
        F.lit(',"state":{"status":"'), status,
        F.lit('","price":'), F.when(status == "O", price + 1).otherwise(price).cast("string"), F.lit("}"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(',"rush":true')).otherwise(
            F.concat(F.lit(',"priority":"'), F.col("o_orderpriority"), F.lit('"'))
        ),
        F.lit("}"),
    )
    return orders.select(F.col("o_orderkey").alias("id"), text.alias("body"))
