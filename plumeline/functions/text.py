"""Cell, literal, number and name helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

def cell(values: Column, default: str = "") -> Column:
    """One element as itself, none as empty text, more as a JSON list."""
    return (
        F.when(values.isNull(), F.lit(default))
        .when(F.size(values) == 0, F.lit(""))
        .when(F.size(values) == 1, F.element_at(values, 1).cast("string"))
        .otherwise(F.to_json(values))
    )


def to_number(token: Column) -> Column:
    """Integer or float reading of a token as a double, NULL for other text."""
    return F.coalesce(token.try_cast("bigint").cast("double"), token.try_cast("double"))


def token_kind(token: Column) -> Column:
    """``int``, ``double`` or ``string``: the first reading that fits."""
    return (
        F.when(token.try_cast("bigint").isNotNull(), "int")
        .when(token.try_cast("double").isNotNull(), "double")
        .otherwise("string")
    )


def rename_dollar_keys(json_text: Column) -> Column:
    """Keys ``$x`` as ``_$x``, at any depth."""
    return F.regexp_replace(json_text, r'([{,]\s*)"\$([^"]+)"\s*:', r'$1"_\$$2":')


def _runs(text: Column, left: str, right: str) -> Column:
    """A text cut into its brackets and what stands between them, so that a fold has few steps however long the text is."""
    marks = re.escape(left) + re.escape(right)
    return F.regexp_extract_all(text, F.lit(f"[{marks}]|[^{marks}]+"), F.lit(0))


def strip_nested(name: Column, left: str, right: str, replacement: str = "") -> Column:
    """Text outside all ``left…right`` groups, ``replacement`` where an outermost group opens.

    One pass over the brackets counts the depth, so any nesting is followed.
    Only text at depth 0 stays: nothing is kept behind a bracket that is never
    closed, nor between a closing bracket without partner and the next opening.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(state: Column, run: Column) -> Column:
        opens, closes = run == left, run == right
        depth = state["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        added = F.when(opens, F.lit(replacement)).when(closes, F.lit("")).otherwise(run)
        return F.struct(depth.alias("depth"), F.when(state["depth"] == 0, F.concat(state["out"], added)).otherwise(state["out"]).alias("out"))

    text = F.trim(name)
    walked = F.aggregate(_runs(text, left, right), start, step)["out"]
    return F.when(text.contains(left) | text.contains(right), walked).otherwise(text)


def outer_groups(text: Column, left: str, right: str) -> Column:
    """The outermost ``left…right`` groups of a text, with all that is in them."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("group"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, run: Column) -> Column:
        depth = state["depth"] + F.when(run == left, 1).when((run == right) & (state["depth"] > 0), -1).otherwise(0)
        group = F.when((state["depth"] > 0) | (depth > 0), F.concat(state["group"], run)).otherwise(F.lit(""))
        closed = (state["depth"] > 0) & (depth == 0)
        found = F.when(closed, F.array_append(state["found"], group)).otherwise(state["found"])
        return F.struct(depth.alias("depth"), F.when(closed, F.lit("")).otherwise(group).alias("group"), found.alias("found"))

    return F.when(text.contains(left), F.aggregate(_runs(text, left, right), start, step)["found"])


def clean_function_name(name: Column) -> Column:
    """Function name without namespaces, template arguments and parameter lists."""
    out = F.replace(F.trim(name), F.lit("(anonymous namespace)::"), F.lit(""))
    out = F.regexp_replace(out, r"\{[^}]*\}::", "")
    out = strip_nested(out, "<", ">", "<...>")
    out = strip_nested(out, "(", ")")
    out = strip_nested(out, "[", "]")
    return F.replace(out, F.lit(" const"), F.lit(""))


def literal_text(kind: Column, value: Column) -> Column:
    """A parameter as it is written in a test file, by its type tag."""
    quoted = F.when(value.contains("'"), F.concat(F.lit('"'), value, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), value, F.lit("'"))
    )
    return (
        F.when(kind == "string", quoted)
        .when(kind.isin("int", "long", "double", "decimal", "bool", "regex"), value)
        .when(kind == "objectid", F.concat(F.lit("ObjectId('"), value, F.lit("')")))
        .when(kind == "null", F.lit("null"))
    )
