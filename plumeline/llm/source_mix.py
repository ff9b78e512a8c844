"""Mixing sources to target weights by hash-random keys, range sort and distributed prefix sums.

Sources in code point order (null last) have weights 1, 2, 3, repeating, and share all words.  A source gives at most
``repeats`` times its words; what it can't give is shared by weight among the others.  In every source documents are
ordered by a hash key.  Whole epochs take all documents; the rest of the budget is taken from the start of the order,
and the document at the cut gives just the words that are missing.

The order of a source is cut into equal key ranges (about ``RANGE_ROWS`` rows each): a window runs inside one range,
and one row per range carries the sums on, so a hot source is shared by many tasks.  Rows that are equal in id and
text have equal keys and follow each other in any order; each of them counts.  The key is a hash of id and text only,
so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumeline.llm import words as W
from plumeline.session import staged

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 20_000


def n_words(column: str = "text"):
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def _key(seed: int):
    """60 bits of a digest of seed, id and text, as a number from 0."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)`` with a row per source.

    The shared level L gives target = min(repeats * size, L * weight).  Sources in order of size / weight are full one
    after the other; the level is the first at which the next one isn't.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    total = Window.partitionBy(F.lit(0))
    full = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    w = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", w[(F.col("rank") % len(weights)).cast("int")].cast("double")
    )
    level = (
        ranked.withColumn("cap", F.col("source_size") * repeats)
        .withColumn("all", F.sum("source_size").over(total))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("cap").over(full), F.lit(0)))
        .withColumn("open", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
        .withColumn("level", F.when(F.col("cap") / F.col("weight") >= F.col("left") / F.col("open"), F.col("left") / F.col("open")))
        .withColumn("level", F.max("level").over(total))
    )
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return level.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key, source, size, source_size, target, taken.

    ``taken`` is the number of words that the mix takes, repeats counted.  An empty table gives no rows; a source
    without words has target 0.
    """
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.md5(F.col("text").cast("string")), F.lit("")).alias("text_key"),
        n_words().alias("size"),
    ).withColumn("key", _key(seed))
    rows = staged(rows, "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    # Ranges of a source follow its rows: a power of two cuts the keys evenly.
    shift = 60 - F.ceil(F.log2(F.greatest(F.col("n_rows") / RANGE_ROWS, F.lit(2.0)))).cast("int")
    targets = source_targets(per_source, weights, repeats)
    plan = targets.join(per_source.select(F.col("source").alias("s"), shift.alias("shift")), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    r, p = rows.alias("r"), plan.withColumnRenamed("source", "s").alias("p")
    ranged = r.join(p, F.col("s").eqNullSafe(F.col("r.source")), "left").drop("s").withColumn("range", F.expr("shiftright(key, shift)"))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        F.col("source").alias("s"), F.col("range").alias("g"), F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("carried")
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(carried, F.col("s").eqNullSafe(F.col("source")) & (F.col("g") == F.col("range")))
        .withColumn("start", F.col("local") + F.col("carried"))
    )
    budget = F.round("target").cast("bigint")
    epochs = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0)).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(rest - F.col("start"), F.lit(0)))
    return placed.select(
        "doc_id", "text_key", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("bigint").alias("taken")
    )


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, seed: int = 0) -> DataFrame:
    """The documents of the mix as rows of ``docs``, one row for each time that a document is taken.

    The document at a source's cut is taken whole.  Documents without words have no weight and are not taken.
    """
    # Equal rows share a key: what they give together is dealt to them evenly.
    plan = mix_sources(docs, weights, repeats, seed)
    times = plan.groupBy("doc_id", "source", "text_key").agg(
        F.sum(F.ceil(F.try_divide("taken", "size"))).cast("bigint").alias("n_times"), F.count("*").alias("n_equal")
    )
    key, id_, source, text_key, n_times, copy = W.free_names(docs.columns, "mix_key", "mix_id", "mix_source", "mix_text", "mix_times", "mix_copy")
    keyed = docs.withColumn(key, F.coalesce(F.md5(F.col("text").cast("string")), F.lit("")))
    one = times.select(
        F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("text_key").alias(text_key),
        F.ceil(F.col("n_times") / F.col("n_equal")).cast("int").alias(n_times),
    ).filter(F.col(n_times) > 0)
    met = keyed.join(
        one,
        F.col(id_).eqNullSafe(keyed["doc_id"].cast("bigint")) & F.col(source).eqNullSafe(keyed["source"].cast("string")) & (F.col(text_key) == keyed[key]),
    )
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n_times)))).select(*docs.columns)
