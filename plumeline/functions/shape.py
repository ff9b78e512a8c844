"""Query shape and positional parameters of a filter document.

Runs as one Arrow batch function over the raw JSON text, because the shape
keeps the key order of the document, which VARIANT does not.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from plumeline.functions.pull import Whole, dump, load

# Wrapper keys that stand for one scalar, with their type tag.
SCALAR_WRAPPERS = {
    "$oid": "objectid",
    "$date": "date",
    "$numberInt": "int",
    "$numberLong": "long",
    "$numberDouble": "double",
    "$numberDecimal": "decimal",
    "$binary": "binary",
    "$uuid": "binary",
    "$regex": "regex",
    "$regularExpression": "regex",
    "$timestamp": "timestamp",
    "$symbol": "string",
    "$code": "code",
    "$undefined": "null",
    "$minKey": "minkey",
    "$maxKey": "maxkey",
    "$ref": "dbref",
    "$dbPointer": "dbref",
}

PARAMS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))
SHAPE = T.StructType([T.StructField("shape", T.StringType()), T.StructField("params", PARAMS)])


def _scalar(value):
    """(type, text) of a scalar or a scalar wrapper, None for a container."""
    if isinstance(value, dict):
        tag = SCALAR_WRAPPERS.get(next(iter(value), ""))
        if tag is None:
            return None
        inner = next(iter(value.values()))
        if tag == "regex" and not isinstance(inner, dict):
            return tag, f"/{inner}/{value.get('$options', '')}"
        return tag, inner if isinstance(inner, str) else dump(inner)
    if isinstance(value, list):
        return None
    if value is None:
        return "null", None
    if isinstance(value, bool):
        return "bool", "true" if value else "false"
    if isinstance(value, int):
        return ("int" if -(2**31) <= value < 2**31 else "long"), str(value)
    if isinstance(value, float):
        return "double", repr(value)
    if isinstance(value, Whole):
        return "long", str(value)
    return "string", value


class _Open:
    """A container whose shape is being written."""

    def __init__(self, value):
        self.is_list, self.name, self.parts, self.scalars = isinstance(value, list), None, [], 0
        self.items = ((None, v) for v in value) if self.is_list else ((k[1:] if k.startswith("_$") else k, v) for k, v in value.items())

    def add(self, text: str) -> None:
        self.parts.append(text if self.is_list else f"{self.name}: {text}")

    def text(self) -> str:
        if not self.is_list:
            return "{" + ",".join(self.parts) + "}"
        if self.scalars:
            self.parts.append("1" if self.scalars == 1 else "N")
        return "[ " + ",".join(self.parts) + " ]"


def _shape(value, params):
    """Shape text of any value, at any depth; scalars are appended to ``params``."""
    scalar = _scalar(value)
    if scalar is not None:
        params.append(scalar)
        return "1"
    open_ = [_Open(value)]
    while True:
        top = open_[-1]
        for top.name, inner in top.items:
            scalar = _scalar(inner)
            if scalar is None:
                open_.append(_Open(inner))
                break
            params.append(scalar)
            if top.is_list:
                top.scalars += 1
            else:
                top.add("1")
        else:
            open_.pop()
            if not open_:
                return top.text()
            open_[-1].add(top.text())


def _shallow(value):
    """Shape of a sort or hint: only the first operator of each sub-document."""

    def field(v):
        if not isinstance(v, dict) or not v or _scalar(v) is not None:
            return "1"
        op, inner = next(iter(v.items()))
        if isinstance(inner, list):
            return f"{{{op}: [{len(inner)}]}}"
        return f"{{{op}: {{}}}}" if _scalar(inner) is None else f"{{{op}: 1}}"

    return "{" + ",".join(f"{k}: {field(v)}" for k, v in value.items()) + "}"


def _load(text):
    try:
        return load(text, float)
    except ValueError:
        return None


@F.pandas_udf(SHAPE)
def query_shape(filters: pd.Series) -> pd.DataFrame:
    """``struct<shape, params>``; text that is no document comes back as its own shape."""
    shapes, values = [], []
    for text in filters:
        doc = _load(text)
        if isinstance(doc, list) and doc and isinstance(doc[0], dict):
            doc = doc[0].get("$match", doc[0].get("_$match"))
        params: list = []
        shapes.append(_shape(doc, params) if isinstance(doc, dict) and _scalar(doc) is None else text)
        values.append([{"type": t, "value": v} for t, v in params])
    return pd.DataFrame({"shape": shapes, "params": values})


@F.pandas_udf(T.StringType())
def shallow_shape(documents: pd.Series) -> pd.Series:
    """Shape without parameters; NULL for anything but a document."""
    docs = (_load(t) for t in documents)
    return pd.Series([_shallow(d) if isinstance(d, dict) else None for d in docs], dtype=object)


def has_operator(filter_json: Column, operator: str) -> Column:
    """Whether a document uses an operator such as ``$ne``, in any case."""
    names = F.regexp_extract_all(F.lower(filter_json), F.lit(r'"(\$\w+)"\s*:'), F.lit(1))
    return F.coalesce(F.array_contains(names, operator.lower()), F.lit(False))
