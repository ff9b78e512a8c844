"""Secret scan with an incremental blob ledger.

Every historical version of a path is content-addressed: its blob is the SHA-256 of its text.  The ledger is a
Parquet folder with a row per scanned blob: the rule versions that were run and the spans found.  A scan reads the
ledger, picks blobs for which some current rule version is missing, runs just the missing rules on each of them once,
appends the rows, and joins findings back to every path.  A text that many paths share is scanned once.

All of it is DataFrame work.  A rule is a regular expression that can match wherever its matched text occurs (no look-
around, anchors or word borders): then a match found by ``regexp_extract_all`` is the first occurrence of its text
behind the match before it, and ``locate`` gives its place in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPAN = "struct<rule:string,start:bigint,stop:bigint>"
_LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:bigint,stop:bigint>>"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count if their ``group`` has ``least`` characters or more."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Longest runs of these characters: shorter ones fail as a whole, so the least length can stand in the pattern.
    Rule("hex", r"[0-9a-f]{32,}"),
)

#: Formats of published credentials and key files.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hosting_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"://[^\s:/@]+:[^\s:/@]{3,}@"),
)


def spans_of(rule: Rule, text: str = "text") -> Column:
    """All spans of ``rule`` in a text column, in order, as ``array<struct<rule, start, stop>>``; ``rule`` has the version."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
    if rule.group:
        groups = F.regexp_extract_all(F.col(text), pattern, F.lit(rule.group))
        found = F.zip_with(matches, groups, lambda m, g: F.struct(m.alias("match"), F.length(g).alias("size")))
    else:
        found = F.transform(matches, lambda m: F.struct(m.alias("match"), F.length(m).alias("size")))
    start = F.struct(F.lit(1).alias("at"), F.lit(None).cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, hit: Column) -> Column:
        # A lambda variable can only reach locate() through its call by name.
        at = F.call_function("locate", hit["match"], F.col(text), state["at"])
        stop = at + F.length(hit["match"])
        span = F.struct(F.lit(rule.key).alias("rule"), (at - 1).cast("bigint").alias("start"), (stop - 1).cast("bigint").alias("stop"))
        spans = F.when(hit["size"] >= rule.least, F.concat(F.coalesce(state["spans"], F.array().cast(f"array<{SPAN}>")), F.array(span))).otherwise(state["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    return F.coalesce(F.aggregate(found, start, step)["spans"], F.array().cast(f"array<{SPAN}>"))


def blob_of(text: Column) -> Column:
    """The content address of a text; null is the empty text."""
    return F.sha2(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), 256)


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger at ``path``, empty if nothing was ever written there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(_LEDGER).parquet(path)
    return spark.createDataFrame([], _LEDGER)


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(blob, missing, text)``: every blob once that lacks a current rule version, and which it lacks."""
    current = F.array(*[F.lit(r.key) for r in rules])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Copies of a text are one row before any text moves; first() combines in the tasks that read.
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("done"))
    lacks = F.array_except(current, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob", "left").select("blob", lacks.alias("missing"), "text").filter(F.size("missing") > 0)


def scan(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows for ``(blob, missing, text)``."""
    found = [F.when(F.array_contains("missing", r.key), spans_of(r)).otherwise(F.array().cast(f"array<{SPAN}>")) for r in rules]
    return blobs.select("blob", F.col("missing").alias("rules"), F.concat(*found).alias("spans"))


def update_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it and return the whole ledger.

    A job that is lost before its commit leaves the ledger as it was; a blob that two jobs scan has two equal rows.
    """
    spark = versions.sparkSession
    scan(unseen(versions, read_ledger(spark, path), rules), rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """All columns of ``versions`` but the text, with ``blob`` and the ``spans`` of the current rules in order.

    What an older version of a rule found does not count.  Spans are ordered by start, then by the order of ``rules``.  A null or empty text has no spans.
    """
    keys, names = F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.lit(r.name) for r in rules])
    rank = F.array_position(keys, F.col("s.rule"))
    hits = (
        ledger.filter(F.size("spans") > 0)
        .select("blob", F.explode("spans").alias("s"))
        .filter(F.array_contains(keys, F.col("s.rule")))
        .select("blob", F.struct(F.col("s.start").alias("start"), rank.alias("rank"), F.get(names, rank.cast("int") - 1).alias("rule"), F.col("s.stop").alias("stop")).alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set("s")).alias("spans"))
    )
    rows = versions.withColumn("blob", blob_of(F.col("text"))).drop("text")
    empty = F.array().cast("array<struct<start:bigint,rank:bigint,rule:string,stop:bigint>>")
    return rows.join(hits, "blob", "left").withColumn("spans", F.coalesce("spans", empty))


def span_list(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and the list of all spans."""
    base = F.filter("spans", lambda s: s["rule"].isin(*[r.name for r in BASE_RULES]))
    rules = F.transform("spans", lambda s: s["rule"])
    counts = [(F.size("spans") - F.size(F.array_remove(rules, r.name))).cast("bigint").alias(f"n_{r.name}") for r in BASE_RULES]
    return found.select(
        "doc_id", *counts, F.sha2(F.encode(span_list(base), "UTF-8"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"), "blob"
    )
