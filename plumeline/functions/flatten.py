"""Flatten JSON documents to one row per leaf path."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumeline.functions.pull import Real, Whole, load as parse

# Names of leaf types.
OBJECT, ARRAY, NULL, BOOLEAN, LONG, NUMBER, STRING = "object", "array", "null", "boolean", "Integer64", "number", "string"
#: Type of a text that is no JSON.
REJECT = "reject"

_LEAF = T.StructType(
    [T.StructField("path", T.ArrayType(T.StringType())), T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]
)


def _real_text(value: Real) -> tuple[str, str]:
    if "e" not in value and "E" not in value:
        text = value.rstrip("0").rstrip(".")
        return NUMBER, "0" if text in ("-0", "") else text
    return NUMBER, repr(float(value))


def _scalar(value) -> tuple[str, str | None]:
    """Type and text of a leaf."""
    if value is None:
        return NULL, None
    if value is True or value is False:
        return BOOLEAN, "true" if value else "false"
    if isinstance(value, int):
        return (LONG if -(1 << 63) <= value < 1 << 63 else NUMBER), str(value)
    if isinstance(value, Real):
        return _real_text(value)
    if isinstance(value, Whole):
        return NUMBER, str(value)
    if isinstance(value, str):
        return STRING, value
    return (OBJECT, "{}") if isinstance(value, dict) else (ARRAY, "[]")


def leaves(
    document, skip_parts: tuple[str, ...] = (), containers: bool = False, positions: bool = True
) -> Iterator[tuple[tuple[str, ...], str, str | None]]:
    """``(path, type, value)`` of every leaf, in document order, at any depth."""
    waiting = [((), document)]
    while waiting:
        path, value = waiting.pop()
        if isinstance(value, dict) and value:
            if containers:
                yield path, OBJECT, None
            waiting += [(path if k in skip_parts else (*path, k), v) for k, v in reversed(value.items())]
        elif isinstance(value, list) and value:
            if containers:
                yield path, ARRAY, None
            at = range(len(value) - 1, -1, -1)
            waiting += [((*path, f"[{i}]"), value[i]) for i in at] if positions else [((*path, "[]"), value[i]) for i in at]
        else:
            yield (path, *_scalar(value))


def walk_json(df: DataFrame, json_col: str, keep: list[str], walk: Callable, columns: T.StructType) -> DataFrame:
    """``keep`` and the ``columns`` of the rows that ``walk(document)`` yields as tuples; one narrow pass.

    Text that is no JSON gives no rows; ``json_rejects`` has it.
    """
    kinds = [T.StructField(f.name, f.dataType) for f in df.select(*keep).schema]
    schema = T.StructType([*kinds, *columns.fields])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(f.dataType) for f in columns]
        for batch in batches:
            texts = batch.column(len(keep))
            at, found = [], []
            for i, text in enumerate(texts.to_pylist()):
                try:
                    rows = list(walk(parse(text)))
                except ValueError:
                    continue
                at += [i] * len(rows)
                found += rows
            made = [pa.array([r[k] for r in found], kind) for k, kind in enumerate(arrow)]
            kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *made], names)

    return df.select(*keep, F.col(json_col).alias("__json")).mapInArrow(run, schema)


def flatten_json(
    df: DataFrame, json_col: str, keep: list[str], containers: bool = False, skip_parts: tuple[str, ...] = (), positions: bool = True,
    rejects: bool = False,
) -> DataFrame:
    """``keep`` columns plus ``path ARRAY<STRING>``, ``type`` and ``value``.

    An array element adds the path part ``[i]``, or ``[]`` without ``positions``.
    Empty containers are leaves.  With ``containers`` every other object and
    array gets a row of its own, without a value.  Parts named in ``skip_parts``
    are left out of the path.  Containers are opened until none is left, and
    numbers keep all digits; nothing is shuffled.  With ``rejects`` a text that
    is no JSON is a row of type ``reject`` without path, its value the text.
    """
    kinds = [T.StructField(f.name, f.dataType) for f in df.select(*keep).schema]
    schema = T.StructType([*kinds, *_LEAF.fields])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Documents of a table share their paths: each is made once a batch.
            known: dict[tuple, int] = {}
            at, places, values = [], [], []
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                try:
                    found = parse(text)
                except ValueError:
                    if rejects:
                        at.append(i)
                        places.append(known.setdefault((None, REJECT), len(known)))
                        values.append(text)
                    continue
                for path, kind, value in leaves(found, skip_parts, containers, positions):
                    at.append(i)
                    places.append(known.setdefault((path, kind), len(known)))
                    values.append(value)
            place = pa.array(places, pa.int32())
            paths = pa.array([None if path is None else list(path) for path, _ in known], pa.list_(pa.string())).take(place)
            types = pa.array([kind for _, kind in known], pa.string()).take(place)
            rows = pa.array(at, pa.int32())
            kept = [batch.column(k).take(rows) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, paths, types, pa.array(values, pa.string())], names)

    return df.select(*keep, F.col(json_col).alias("__json")).mapInArrow(run, schema)


def json_rejects(df: DataFrame, json_col: str, keep: list[str]) -> DataFrame:
    """``keep``, ``raw`` and ``error`` of the rows whose text is no JSON; a missing text is none either."""
    kinds = [T.StructField(f.name, f.dataType) for f in df.select(*keep).schema]
    schema = T.StructType([*kinds, T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            at, errors = [], []
            for i, text in enumerate(texts.to_pylist()):
                try:
                    parse(text)
                except ValueError as problem:
                    at.append(i)
                    errors.append(str(problem))
            rows = pa.array(at, pa.int32())
            kept = [batch.column(k).take(rows) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, texts.take(rows), pa.array(errors, pa.string())], schema.names)

    return df.select(*keep, F.col(json_col).alias("__json")).mapInArrow(run, schema)


def dotted(path: Column) -> Column:
    """Path parts joined by dots."""
    return F.array_join(path, ".")
