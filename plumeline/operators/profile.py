"""Call-tree profiles from stack samples, nodes as rows keyed by stack prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumeline.session import staged

# Prune threshold, hot marker, root of reversed stacks.
PRUNE = 0.01
HOT_MARK = ":hot"
LEAF_ROOT = "LEAF"


def weights(samples: DataFrame) -> DataFrame:
    """Weight of every (ts, stack)."""
    return samples.filter(F.size("stack") > 0).groupBy("ts", "stack").agg(F.sum("weight").alias("weight"))


def tree_rollup(samples: DataFrame, reverse: bool = False, temperature: bool = False) -> DataFrame:
    """``ts, node, depth, weight, hot`` for every stack prefix; depth 0 is the root.

    Equal stacks are added up before prefixes multiply the rows by their depth.
    """
    stack = F.col("stack")
    marked = F.element_at(stack, -1).startswith(":") if temperature else F.lit(False)
    hot = F.when(marked & (F.element_at(stack, -1) == HOT_MARK), F.col("weight")).otherwise(F.lit(0.0))
    body = F.when(marked, F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack)
    rows = weights(samples).select("ts", body.alias("stack"), "weight", hot.alias("hot"))
    if reverse:
        rows = rows.withColumn("stack", F.concat(F.array(F.lit(LEAF_ROOT)), F.reverse("stack")))
    depths = F.explode(F.sequence(F.lit(0), F.size("stack"))).alias("depth")
    return (
        rows.select("ts", "stack", "weight", "hot", depths)
        .groupBy("ts", F.slice("stack", F.lit(1), F.col("depth")).alias("node"), "depth")
        .agg(F.sum("weight").alias("weight"), F.sum("hot").alias("hot"))
    )


def node_totals(tree: DataFrame) -> DataFrame:
    """Weight of every node over all times."""
    return tree.groupBy("node", "depth").agg(F.sum("weight").alias("total"))


def with_share(tree: DataFrame) -> DataFrame:
    """Weight and hot part as share of the root at the same time."""
    root = tree.filter(F.col("depth") == 0).select("ts", F.col("weight").alias("__root"))
    return tree.join(root, "ts").select(
        *tree.columns,
        F.try_divide("weight", "__root").alias("share"),
        F.try_divide("hot", "__root").alias("hot_share"),
    )


def prune(shares: DataFrame, threshold: float = PRUNE) -> DataFrame:
    """Nodes that reach the threshold at any time, with all their times."""
    kept = shares.groupBy("node").agg(F.max("share").alias("m")).filter(F.col("m") >= threshold).select("node")
    return shares.join(kept, "node", "left_semi")


def with_order_key(nodes: DataFrame) -> DataFrame:
    """Depth-first sort key of every node: siblings by total descending, then name.

    ``nodes`` holds ``node, depth, total``.  The key of a node is the array of
    the keys of its ancestors and itself, so sorting on it walks the tree.
    """
    below = nodes.filter(F.col("depth") > 0)
    steps = below.select(
        "node",
        "depth",
        "total",
        F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("level"),
    ).withColumn("ancestor", F.slice("node", F.lit(1), F.col("level")))
    totals = nodes.select(F.col("node").alias("ancestor"), F.col("total").alias("ancestor_total"))
    part = F.struct(
        F.col("level"), (-F.col("ancestor_total")).alias("neg_total"), F.element_at("ancestor", -1).alias("name")
    )
    keyed = steps.join(totals, "ancestor").groupBy("node", "depth", "total").agg(
        F.array_sort(F.collect_list(part)).alias("__parts")
    )
    return keyed.select(
        "node", "depth", "total", F.transform("__parts", lambda p: F.struct(p["neg_total"], p["name"])).alias("order_key")
    )


def tree_order(nodes: DataFrame) -> DataFrame:
    """Position of every node in the depth-first walk, from 0.

    Sorted by range partitions; each partition numbers its own rows and a table
    with one row per partition gives the offset.
    """
    keyed = with_order_key(nodes)
    numbered = staged(
        keyed.orderBy("order_key").withColumns(
            {"__row": F.monotonically_increasing_id(), "__part": F.spark_partition_id()}
        ),
        "tree-order",
    )
    parts = numbered.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return numbered.join(offsets, "__part").select(
        "node", "depth", "total", (F.col("offset") + F.col("__row") - F.col("first")).alias("position")
    )


def profile_tree(
    samples: DataFrame,
    style: str = "percent",
    reverse: bool = False,
    temperature: bool = False,
    threshold: float = PRUNE,
) -> DataFrame:
    """``ts, node, depth, value, hot, order_key`` of every node that is kept.

    Style ``percent`` shows shares of the root and prunes, ``threads`` shows weights.
    """
    if style not in ("percent", "threads"):
        raise ValueError(f"unknown style {style!r}")
    # Far smaller than the samples, and read for totals, shares and pruning.
    tree = staged(tree_rollup(samples, reverse, temperature), "tree")
    keys = with_order_key(node_totals(tree)).select("node", "order_key")
    if style == "percent":
        rows = prune(with_share(tree), threshold).withColumns({"value": F.col("share"), "hot": F.col("hot_share")})
    else:
        rows = tree.withColumn("value", F.col("weight"))
    return rows.select("ts", "node", "depth", "value", "hot").join(keys, "node")


def caption(order: Column, name: Column, level: Column, style: str = "percent", extra: Column | None = None) -> Column:
    """Column caption with the display metadata of a chart tool."""
    # Metadata of the two styles.
    meta = {
        "percent": "units=%;scale=0.01;yMax=100;section=CPU profile",
        "threads": "rate=true;units=threads;scale=1000000;logMin=0.1;section=Thread profile;scaleGroup=thread profile",
    }[style]
    parts = [F.lit(meta), F.concat(F.lit("name="), name), F.concat(F.lit("treeLevel="), level.cast("string"))]
    if extra is not None:
        parts.insert(0, extra)
    return F.concat(F.lpad(order.cast("string"), 6, "0"), F.lit("#"), F.concat_ws(";", *parts))
