"""Compare whole tables of documents path by path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from plumeline.functions.flatten import REJECT, dotted, leaves, parse
from plumeline.operators.running import RunningSum, with_running
from plumeline.session import staged

#: Unequal documents of one key that one task may put in order.
HOT_DOCUMENTS = 100_000

_DIFF = T.StructType(
    [T.StructField("path", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.StringType()) for n in ("change", "left_type", "left_value", "right_type", "right_value")]
)


def _differences(left: dict, right: dict) -> Iterator[tuple]:
    """Differences of two documents given as path to (type, value)."""
    for path in [*left, *(p for p in right if p not in left)]:
        a, b = left.get(path), right.get(path)
        if a != b:
            change = "only_left" if b is None else "only_right" if a is None else "type" if a[0] != b[0] else "value"
            yield (list(path), change, *(a or (None, None)), *(b or (None, None)))


def _unequal_pairs(left: DataFrame, right: DataFrame, key: str, body: str) -> DataFrame:
    """``key, __pair, __left, __right`` of the documents that have no equal one on the other side.

    Equal texts of a key cancel, copy by copy; of what is left, the first on one side meets the first on the other, in the
    order of their digests, and so on.  A side without a document is NULL.
    """
    sides = [d.select(F.col(key).alias("__id"), F.col(body).alias("__body"), F.lit(s).alias("__side")) for d, s in ((left, 1), (right, -1))]
    net = sides[0].unionByName(sides[1]).groupBy("__id", "__body").agg(F.sum("__side").alias("__net")).filter("__net <> 0")
    net = staged(net, "unequal_documents")
    copies = net.select(
        "__id", "__body", F.coalesce(F.md5("__body"), F.lit("")).alias("__hash"), F.signum("__net").cast("int").alias("__side"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("__net"))).alias("__copy"),
    )
    # Ranks of a key with very many documents are counted in chunks.
    hot = net.groupBy("__id").agg(F.sum(F.abs("__net")).alias("n")).filter(F.col("n") > HOT_DOCUMENTS).limit(1).count()
    keys, order = ["__id", "__side"], ["__hash", "__body", "__copy"]
    if hot:
        ranked = with_running(copies, keys, order, F.substring("__hash", 1, 2), [RunningSum(F.lit(1), "__pair")])
    else:
        ranked = copies.withColumn("__pair", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    a, b = (
        ranked.filter(F.col("__side") == s).select(F.col("__id").alias(f"__id{n}"), F.col("__pair").alias(f"__pair{n}"), F.col("__body").alias(n))
        for s, n in ((1, "__left"), (-1, "__right"))
    )
    same = F.col("__id__left").eqNullSafe(F.col("__id__right")) & (F.col("__pair__left") == F.col("__pair__right"))
    return a.join(b, same, "full_outer").select(
        F.coalesce("__id__left", "__id__right").alias(key), F.coalesce("__pair__left", "__pair__right").alias("__pair"), "__left", "__right"
    )


def diff_documents(left: DataFrame, right: DataFrame, key: str = "id", body: str = "body", pairs: bool = False) -> DataFrame:
    """One row per difference: ``key, path, change, left_type, left_value, right_type, right_value``.

    ``change`` is ``only_left``, ``only_right``, ``type`` or ``value``.  Keys may repeat: equal texts cancel by their number
    and the others pair up in a fixed order, ``pair`` in the result if asked for.  Only documents that differ are opened,
    each pair in one place.  A text that is no JSON is one value of type ``reject``.
    """
    unequal = _unequal_pairs(left, right, key, body)
    if pairs:
        unequal = unequal.withColumn(key, F.struct(F.col(key).alias("key"), F.col("__pair").alias("pair")))
    schema = T.StructType([unequal.schema[key], *_DIFF.fields])
    names = schema.names

    def opened(text: str | None) -> dict:
        if text is None:
            return {}
        try:
            return {path: (kind, value) for path, kind, value in leaves(parse(text))}
        except ValueError:
            return {(): (REJECT, text)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.string()), *[pa.string()] * 5]
        for batch in batches:
            at, found = [], []
            for i, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                rows = list(_differences(opened(a), opened(b)))
                at += [i] * len(rows)
                found += rows
            made = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *made], names)

    out = unequal.select(key, "__left", "__right").mapInArrow(run, schema)
    return out.select(F.col(f"{key}.key").alias(key), F.col(f"{key}.pair").alias("pair"), *names[1:]) if pairs else out


def diff_lines(diff: DataFrame, key: str = "id") -> DataFrame:
    """The differences as ``<`` and ``>`` text lines, indented by depth."""
    indent = F.repeat(F.lit("   "), F.size("path"))
    name = dotted(F.col("path"))
    by_type = F.col("change") == "type"

    def line(mark: str, side: str):
        shown = F.when(by_type, F.col(f"{side}_type")).otherwise(F.coalesce(f"{side}_value", F.lit("null")))
        return F.when(
            F.col(f"{side}_type").isNotNull(), F.concat(F.lit(mark), indent, name, F.lit(":"), shown)
        )

    lines = F.array_compact(F.array(line("<", "left"), line(">", "right")))
    return diff.select(key, "path", F.posexplode(lines).alias("line_no", "line"))


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side that has them."""
    a = left.select(*keys).distinct().withColumn("in_left", F.lit(True))
    b = right.select(*keys).distinct().withColumn("in_right", F.lit(True))
    both = a.join(b, keys, "full_outer")
    return both.filter(F.col("in_left").isNull() | F.col("in_right").isNull()).select(
        *keys, F.when(F.col("in_left").isNotNull(), "left").otherwise("right").alias("side")
    )
