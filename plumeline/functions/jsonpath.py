"""Columns taken from command documents kept as raw JSON text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from plumeline.functions.pull import load

# Where each command keeps its filter.
FILTER_LOCATIONS = {
    "update": "q",
    "count": "query",
    "find": "filter",
    "aggregate": "pipeline",
    "delete": "deletes.q",
    "findAndModify": "query",
    "command": "q",
    "remove": "q",
}
# Counters that measure waiting.
WAIT_KEYS = ("timeReadingMicros", "timeWritingMicros", "timeWaitingMicros")
# Stages that may stand ahead of the filter of a pipeline.
SKIPPED_STAGES = ("$addFields", "$set")

WAITS = T.StructType(
    [T.StructField("total_micros", T.LongType()), T.StructField("locks", T.ArrayType(T.StringType()))]
)


def head(json_text: Column) -> Column:
    """First element of a list, any other value as it is."""
    first = F.get_json_object(json_text, "$[0]")
    return F.when(json_text.startswith("["), first).otherwise(json_text)


def first_key(document: Column) -> Column:
    """First key of a document, which names its operation."""
    return F.get(F.json_object_keys(document), F.lit(0))


def filter_of(command: Column, document: Column) -> Column:
    """Filter text of a command document; a list counts as its first element."""
    parts = sorted({path.split(".")[0] for path in FILTER_LOCATIONS.values()})
    parsed = F.from_json(document, ", ".join(f"{p} string" for p in parts))
    out = None
    for name, path in FILTER_LOCATIONS.items():
        first, *rest = path.split(".")
        value = head(parsed[first])
        for part in rest:
            value = head(F.get_json_object(value, f"$.{part}"))
        out = F.when(command == name, value) if out is None else out.when(command == name, value)
    return out


def _stages(pipeline: Column) -> Column:
    return F.from_json(pipeline, "array<string>")


def leading_match(pipeline: Column) -> Column:
    """Filter of the first ``$match`` with only field-adding stages ahead of it."""
    rest = F.filter(_stages(pipeline), lambda s: ~first_key(s).isin(*SKIPPED_STAGES))
    return F.get_json_object(F.get(rest, F.lit(0)), "$.$match")


def any_match(pipeline: Column) -> Column:
    """Filter of the first ``$match`` anywhere in the pipeline."""
    matches = F.filter(_stages(pipeline), lambda s: first_key(s) == "$match")
    return F.get_json_object(F.get(matches, F.lit(0)), "$.$match")


def getmore_filter(originating: Column) -> Column:
    """Filter of the command that opened the cursor."""
    return F.coalesce(
        F.get_json_object(originating, "$.filter"), leading_match(F.get_json_object(originating, "$.pipeline"))
    )


def session_id(attr: Column) -> Column:
    """Session id of a command or of its parameters."""
    return F.coalesce(F.get_json_object(attr, "$.parameters.lsid.id"), F.get_json_object(attr, "$.lsid.id"))


def txn_number(attr: Column) -> Column:
    """Transaction number of a command or of its parameters."""
    return F.coalesce(
        F.get_json_object(attr, "$.parameters.txnNumber"), F.get_json_object(attr, "$.txnNumber")
    ).try_cast("bigint")


def _wait_leaves(document, root: str) -> Iterator[tuple[str, int]]:
    """(name, micros) of every wait counter below a document, each counted once, in document order."""
    waiting = [(root, document)]
    while waiting:
        path, value = waiting.pop()
        if isinstance(value, tuple):
            yield path, int(value[0])
            continue
        below: list = []
        for key, inner in value.items():
            if key not in WAIT_KEYS:
                if isinstance(inner, dict):
                    below.append((f"{path}.{key}", inner))
            elif isinstance(inner, dict):
                below += [(f"{path}.{lock}.{key}", (micros,)) for lock, micros in inner.items()]
            else:
                below.append((f"{path}.{key}", (inner,)))
        waiting += reversed(below)


def _found_waits(text: str | None, root: str) -> list[tuple[str, int]] | None:
    """The counters of one document; None if it is damaged."""
    if text is None:
        return []
    try:
        document = load(text, float)
        return list(_wait_leaves(document, root)) if isinstance(document, dict) else None
    except (TypeError, ValueError, OverflowError):
        return None


@F.arrow_udf(WAITS)
def _sum_waits(locks: pa.Array, storage: pa.Array) -> pa.Array:
    # Operations of one kind often wait in the same way: a text of a batch is opened once.
    known: tuple[dict, dict] = ({}, {})
    totals, names, ends, valid = [], [], [0], []
    for texts in zip(locks.to_pylist(), storage.to_pylist(), strict=True):
        found = []
        for seen, root, text in zip(known, ("locks", "storage"), texts, strict=True):
            if text not in seen:
                seen[text] = _found_waits(text, root)
            found.append(seen[text])
        good = None not in found
        total = sum(micros for _, micros in found[0] + found[1]) if good else 0
        good = good and -(1 << 63) <= total < 1 << 63
        totals.append(total if good else 0)
        names += [name for name, _ in found[0] + found[1]] if good else []
        ends.append(len(names))
        valid.append(good)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()))
    return pa.StructArray.from_arrays([pa.array(totals, pa.int64()), lists], ["total_micros", "locks"], mask=pa.array([not v for v in valid]))


def waits(locks: Column, storage: Column) -> Column:
    """``struct<total_micros, locks>`` over lock and storage counters, NULL without any and for damaged documents.

    The search inside the JVM spares documents without counters the trip to Python.
    """
    named = "|".join(WAIT_KEYS)
    relevant = [F.when(doc.rlike(f'"(?:{named})"'), doc) for doc in (locks, storage)]
    return F.when(relevant[0].isNotNull() | relevant[1].isNotNull(), _sum_waits(*relevant))


def key_values(text: Column, pattern: str) -> Column:
    """Map of the ``key=value`` pairs a two-group pattern finds; the last of a key wins."""
    keys = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(
        pairs,
        lambda p, i: F.array_position(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), p["k"]) == 0,
    )
    plain = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(plain, F.map_from_arrays(keys, values)).otherwise(F.map_from_entries(last))


def oversize_number(text: Column) -> Column:
    """A whole number of any size up to 38 digits."""
    return text.try_cast("decimal(38,0)")


def connection_id(text: Column) -> Column:
    """Number of a connection context such as ``conn12`` or ``[conn12]``."""
    return F.nullif(F.regexp_extract(text, r"conn([0-9]+)", 1), F.lit(""))


def ip_address(text: Column) -> Column:
    """Address part of ``ip:port``."""
    return F.nullif(F.regexp_extract(text, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+):([0-9]*)", 1), F.lit(""))


def ip_port(text: Column) -> Column:
    """Port part of ``ip:port``."""
    return F.regexp_extract(text, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+):([0-9]*)", 2).try_cast("int")
