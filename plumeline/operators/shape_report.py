"""Most expensive query shapes: grouping, ranking and the report sections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumeline.functions.text import cell
from plumeline.functions.times import between_strict
from plumeline.session import staged

# Report thresholds and section titles.
SLOW_MILLIS = 1000
TOP_DEFAULT = 20
COLLSCAN = "COLLSCAN"
TITLES = {
    "overall": "Overall Cost",
    "collscan": "Collection Scans",
    "long": "Long Running",
    "sort": "Has Sort Stage",
    "multi_shard": "Multi Shard",
    "multi_shard_gt1": "Multi Shard > 1",
}

# A ranked list below this many rows may travel to every executor.
BROADCAST_TOP = 10_000

_RANKINGS = {
    "cost": ["cost"],
    "max_time": ["max_time"],
    "shards": ["max_shards", "min_shards"],
}


def selection(files: Sequence[str] | None = None, start=None, end=None) -> Column:
    """File list and strict date range as one predicate that reaches the scan."""
    cond = between_strict(F.col("ts"), start, end)
    return cond & F.col("infile").isin(list(files)) if files else cond


def with_shape_columns(ops: DataFrame) -> DataFrame:
    """``shape``, ``sort``, ``limit``, ``col_name`` and ``tms`` of each slow operation."""

    def either(field: str) -> Column:
        return F.coalesce(*[F.get_json_object(c, f"$.{field}") for c in ("attr", "originating_command") if c in ops.columns])

    have = set(ops.columns)
    millis = [F.col(c) for c in ("time", "duration_millis") if c in have]
    derived = {
        "shape": F.coalesce(F.col("query_hash"), F.col("filter_shape")),
        "tms": F.coalesce(*millis, F.lit(-1)).cast("bigint"),
        "col_name": F.when(F.col("command") == "getMore", F.get_json_object("attr", "$.collection")).otherwise(
            F.col("object")
        ),
        "sort": F.col("sort") if "sort" in have else either("sort"),
        "limit": (F.col("limit") if "limit" in have else either("limit")).cast("bigint"),
    }
    return ops.withColumns(derived)


def sample_filter(ops: DataFrame) -> Column:
    """The filter text shown for a sample row."""
    attr = F.col("attr")

    def first_of(text: Column) -> Column:
        return F.coalesce(F.get_json_object(text, "$[0]"), text)

    origin = F.col("originating_command")
    from_attr = F.coalesce(
        *[F.get_json_object(attr, f"$.{k}") for k in ("filter", "q", "query", "pipeline")],
        F.get_json_object(first_of(F.get_json_object(attr, "$.updates")), "$.q"),
    )
    from_origin = F.coalesce(F.get_json_object(origin, "$.filter"), F.get_json_object(origin, "$.pipeline"))
    return F.when(F.col("command") == "getMore", from_origin).otherwise(from_attr)


def _numbers(only: Column | None = None) -> list[Column]:
    """Counts and sums of a group, of the rows for which ``only`` holds."""

    def of(value: Column) -> Column:
        return value if only is None else F.when(only, value)

    return [
        F.count(of(F.lit(1))).alias("cnt"),
        F.coalesce(F.sum(of(F.col("tms"))), F.lit(0)).alias("cost"),
        F.avg(of(F.col("ratio"))).alias("ratio"),
        F.min(of(F.col("tms"))).alias("min_time"),
        F.max(of(F.col("tms"))).alias("max_time"),
        F.coalesce(F.sum(of(F.col("docs_examined"))), F.lit(0)).alias("total_read"),
        F.coalesce(F.sum(of(F.col("nreturned"))), F.lit(0)).alias("total_ret"),
    ]


def _gathered(rows: DataFrame, sample: bool) -> list[Column]:
    """Sets of a group and its earliest row."""
    sets = [
        F.array_sort(F.collect_set(c)).alias(a)
        for c, a in (("filter_shape", "filters"), ("command", "operations"), ("sort", "sorts"), ("plan_summary", "plans"))
    ]
    if sample:
        first = F.struct("ts", "infile", "lineno")
        sets.append(F.min_by(F.struct("infile", "lineno", sample_filter(rows).alias("filter")), first).alias("sample"))
    return sets


def _order(rank_by: str) -> list[Column]:
    # Ties are broken by the group key so the list is the same on every run.
    return [F.desc_nulls_last(c) for c in _RANKINGS[rank_by]] + [F.asc("col"), F.asc("shape")]


def rank_shapes(
    rows: DataFrame,
    key: str = "col_name",
    rank_by: str = "cost",
    top: int | None = TOP_DEFAULT,
    router: bool = False,
    limit: bool = True,
    having: Column | None = None,
    sample: bool = True,
) -> DataFrame:
    """Group by (``key``, ``shape``), rank, keep ``top`` groups.

    Counts and sums are a hash aggregate over primitive buffers.  With ``top``,
    sets and the sample row are only gathered for the groups that made the list,
    in a second pass over the pruned columns.
    """
    numbers = _numbers()
    if limit:
        numbers.append(F.max("limit").alias("limit"))
    if router:
        numbers += [F.min("n_shards").alias("min_shards"), F.max("n_shards").alias("max_shards")]
    sets, order = _gathered(rows, sample), _order(rank_by)
    if top is None:
        # Every group is on the list: one aggregate has it all.
        every = rows.groupBy(F.col(key).alias("col"), "shape").agg(*numbers, *sets)
        return (every if having is None else every.filter(having)).orderBy(*order)
    grouped = rows.groupBy(F.col(key).alias("col"), "shape").agg(*numbers)
    if having is not None:
        grouped = grouped.filter(having)
    ranked = grouped.orderBy(*order).limit(top)

    names = [c for c in ranked.columns if c not in ("col", "shape")]
    keys = ranked.select(F.struct("col", "shape", *names).alias("g"))
    if top <= BROADCAST_TOP:
        keys = F.broadcast(keys)
    members = rows.join(
        keys, rows[key].eqNullSafe(F.col("g.col")) & rows["shape"].eqNullSafe(F.col("g.shape"))
    )
    gathered = ["filters", "operations", "sorts", "plans"] + (["sample"] if sample else [])
    detailed = members.groupBy("g").agg(*sets).select("g.*", *gathered)
    return detailed.orderBy(*order)


def section_rows(section: str, all_queries: bool = False) -> tuple[Column, str]:
    """Which rows a section of the slow-query report has, and what it ranks by."""
    if section == "overall":
        return (F.lit(True) if all_queries else F.col("ratio") > 1), "cost"
    if section == "collscan":
        return F.col("plan_summary") == COLLSCAN, "cost"
    if section == "long":
        return F.col("tms") > SLOW_MILLIS, "max_time"
    if section == "sort":
        return F.col("has_sort_stage").isNotNull(), "cost"
    raise ValueError(f"unknown section {section!r}")


def shape_report(
    ops: DataFrame,
    section: str = "overall",
    top: int | None = TOP_DEFAULT,
    all_queries: bool = False,
    multi_tenant: bool = False,
    where: Column | None = None,
    sample: bool = True,
) -> DataFrame:
    """One section of the slow-query report."""
    rows = with_shape_columns(ops)
    if where is not None:
        rows = rows.filter(where)
    of_section, rank_by = section_rows(section, all_queries)
    return rank_shapes(rows.filter(of_section), rank_by=rank_by, top=top, limit=not multi_tenant, sample=sample)


def shape_sections(
    ops: DataFrame,
    sections: Sequence[str] = ("overall", "collscan", "long", "sort"),
    top: int = TOP_DEFAULT,
    all_queries: bool = False,
    multi_tenant: bool = False,
    where: Column | None = None,
    sample: bool = True,
) -> dict[str, DataFrame]:
    """Several sections of the slow-query report by name, from two passes over the log.

    The first pass has the numbers of every group for all sections; the second
    gathers sets for the groups on any list.
    """
    rows = with_shape_columns(ops)
    if where is not None:
        rows = rows.filter(where)
    rules = {s: section_rows(s, all_queries) for s in sections}
    per_section = []
    for name, (only, _) in rules.items():
        numbers = _numbers(only) + ([] if multi_tenant else [F.max(F.when(only, F.col("limit"))).alias("limit")])
        per_section.append(F.struct(*numbers).alias(name))
    groups = staged(rows.groupBy(F.col("col_name").alias("col"), "shape").agg(*per_section), "shape-groups")
    listed = []
    for name, (_, rank_by) in rules.items():
        one = groups.filter(F.col(name)["cnt"] > 0).select("col", "shape", f"{name}.*")
        listed.append(one.orderBy(*_order(rank_by)).limit(top).select(F.lit(name).alias("section"), F.struct(*one.columns).alias("g")))
    keys = reduce(lambda a, b: a.unionByName(b), listed)
    if top * len(rules) <= BROADCAST_TOP:
        keys = F.broadcast(keys)
    wanted = reduce(lambda a, b: a | b, [(F.col("section") == name) & only for name, (only, _) in rules.items()])
    members = rows.join(keys, rows["col_name"].eqNullSafe(F.col("g.col")) & rows["shape"].eqNullSafe(F.col("g.shape")) & wanted)
    gathered = ["filters", "operations", "sorts", "plans"] + (["sample"] if sample else [])
    detailed = staged(members.groupBy("section", "g").agg(*_gathered(rows, sample)), "shape-sections")
    return {
        name: detailed.filter(F.col("section") == name).select("g.*", *gathered).orderBy(*_order(rank_by))
        for name, (_, rank_by) in rules.items()
    }


def router_report(
    ops: DataFrame,
    section: str = "overall",
    top: int | None = TOP_DEFAULT,
    where: Column | None = None,
    mode: str = "shards",
    sample: bool = True,
) -> DataFrame:
    """One section of the report over router logs.

    ``multi_shard_gt1`` keeps groups that touched more than one shard; with
    ``mode='compat'`` it keeps groups seen more than once instead.
    """
    rows = with_shape_columns(ops)
    if where is not None:
        rows = rows.filter(where)
    rank_by, having = "cost", None
    if section == "long":
        rows, rank_by = rows.filter(F.col("tms") > SLOW_MILLIS), "max_time"
    elif section in ("multi_shard", "multi_shard_gt1"):
        rank_by = "shards"
        if section == "multi_shard_gt1":
            having = F.col("cnt") > 1 if mode == "compat" else F.col("max_shards") > 1
    elif section != "overall":
        raise ValueError(f"unknown section {section!r}")
    return rank_shapes(
        rows, key="object", rank_by=rank_by, top=top, router=True, limit=False, having=having, sample=sample
    )


def report_cells(ranked: DataFrame, section: str) -> DataFrame:
    """The ranked groups as printable cells with the report defaults."""
    router = "max_shards" in ranked.columns

    def default(name: str, value) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(str(value))).alias(name)

    cells = [
        F.lit(TITLES[section]).alias("section"),
        F.coalesce("shape", F.lit("")).alias("hash"),
        F.coalesce("col", F.lit("")).alias("collection"),
        cell(F.col("operations")).alias("operation"),
        cell(F.col("filters")).alias("filter"),
        cell(F.col("sorts")).alias("sort"),
        (default("limit", "") if "limit" in ranked.columns else F.lit("").alias("limit")),
        default("cnt", 0),
        default("cost", 0),
        default("ratio", 1),
        default("min_time", 1),
        default("max_time", 1),
        default("total_read", -1),
        default("total_ret", -1),
        (default("min_shards", 1) if router else F.lit("").alias("min_shards")),
        (default("max_shards", 1) if router else F.lit("").alias("max_shards")),
        cell(F.col("plans")).alias("plans"),
    ]
    if "sample" in ranked.columns:
        cells += [
            F.concat_ws(":", "sample.infile", "sample.lineno").alias("sample_id"),
            F.coalesce("sample.filter", F.lit("")).alias("sample_filter"),
        ]
    return ranked.select(*cells)


def union_sections(sections: Sequence[DataFrame]) -> DataFrame:
    """All sections in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sections)


def full_report(ops: DataFrame, top: int = TOP_DEFAULT, all_queries: bool = False, multi_tenant: bool = False,
                where: Column | None = None) -> DataFrame:
    """The default report: overall, collection scans, long running, sorts."""
    found = shape_sections(ops, top=top, all_queries=all_queries, multi_tenant=multi_tenant, where=where)
    return union_sections([report_cells(ranked, name) for name, ranked in found.items()])


def full_router_report(ops: DataFrame, top: int = TOP_DEFAULT, where: Column | None = None, mode: str = "shards") -> DataFrame:
    """The report over router logs."""
    return union_sections(
        [
            report_cells(router_report(ops, s, top, where, mode), s)
            for s in ("overall", "long", "multi_shard", "multi_shard_gt1")
        ]
    )
