"""SQL twins of the table queries, for comparison on another engine."""

from __future__ import annotations

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

_EVENT_OPS = f"""
ops AS (
  SELECT ts, event_id AS lineno, event_type AS command, 'user' || CAST(user_id AS VARCHAR) AS obj,
         '{{' || event_type || ': 1}}' AS shape,
         CASE WHEN event_type = 'error' THEN 'COLLSCAN' ELSE 'IXSCAN' END AS plan,
         CAST(floor(value * 100) AS BIGINT) AS tms,
         CAST(floor(value * 10) AS BIGINT) AS docs,
         {_K} AS nret,
         CASE WHEN {_K} <> 0 THEN CAST(floor(value * 10) AS DOUBLE) / CAST({_K} AS DOUBLE) END AS ratio,
         props
  FROM events
)"""


def _shape_sql(where: str, order: str, limit: str = "LIMIT 20", sample: bool = True) -> str:
    extra = ", min_by(lineno, ts) AS sample_line, CAST(NULL AS VARCHAR) AS sample_filter" if sample else ""
    return f"""
WITH {_EVENT_OPS}
SELECT obj AS col, shape, count(*) AS cnt, CAST(sum(tms) AS BIGINT) AS cost, round(avg(ratio), 6) AS ratio,
       min(tms) AS min_time, max(tms) AS max_time, CAST(sum(docs) AS BIGINT) AS total_read,
       CAST(sum(nret) AS BIGINT) AS total_ret, CAST(NULL AS BIGINT) AS "limit",
       shape AS filters, min(command) AS operations, '' AS sorts, min(plan) AS plans{extra}
FROM ops WHERE {where} GROUP BY obj, shape
ORDER BY {order} {limit}"""


_LINE_OPS = """
ops AS (
  SELECT 'part' || CAST(l_partkey AS VARCHAR) AS obj, l_returnflag || '-' || l_linestatus AS shape,
         l_linestatus AS plan, CAST(floor(l_extendedprice) AS BIGINT) AS tms,
         CAST(floor(l_quantity) AS BIGINT) AS nret, CAST(l_linenumber AS BIGINT) AS shards
  FROM lineitem
), ops2 AS (SELECT *, CASE WHEN nret <> 0 THEN CAST(tms AS DOUBLE) / nret END AS ratio FROM ops)"""


def _line_sql(key: str, having: str, order: str, router: bool) -> str:
    extra = "min(shards) AS min_shards, max(shards) AS max_shards, " if router else ""
    return f"""
WITH {_LINE_OPS}
SELECT {key} AS col, shape, count(*) AS cnt, CAST(sum(tms) AS BIGINT) AS cost, round(avg(ratio), 6) AS ratio,
       min(tms) AS min_time, max(tms) AS max_time, CAST(sum(tms) AS BIGINT) AS total_read,
       CAST(sum(nret) AS BIGINT) AS total_ret, {extra}
       shape AS filters, 'find' AS operations, '' AS sorts, string_agg(DISTINCT plan, '|' ORDER BY plan) AS plans
FROM ops2 GROUP BY {key}, shape {having} ORDER BY {order} LIMIT 20"""


def _cells(title: str, where: str, order: str) -> str:
    return f"""SELECT * FROM (SELECT '{title}' AS section, shape AS hash, obj AS collection, min(command) AS operation,
       shape AS filter, '' AS sort, '' AS "limit", CAST(count(*) AS VARCHAR) AS cnt,
       CAST(CAST(sum(tms) AS BIGINT) AS VARCHAR) AS cost, CAST(min(tms) AS VARCHAR) AS min_time,
       CAST(max(tms) AS VARCHAR) AS max_time, CAST(CAST(sum(docs) AS BIGINT) AS VARCHAR) AS total_read,
       CAST(CAST(sum(nret) AS BIGINT) AS VARCHAR) AS total_ret, '' AS min_shards, '' AS max_shards, min(plan) AS plans
FROM ops WHERE {where} GROUP BY obj, shape ORDER BY {order} LIMIT 20)"""


_COLL = "p_type || '-' || CAST(p_partkey // 64 AS VARCHAR)"

_SIZES = f"""
sizes AS (
  SELECT p_brand AS db, {_COLL} AS coll, p_name AS idx, CAST(sum(p_size) AS BIGINT) AS bytes
  FROM part GROUP BY ALL
), docs AS (
  SELECT p_brand AS db, {_COLL} AS coll, count(*) AS docs, CAST(sum(floor(p_retailprice)) AS BIGINT) AS datasize
  FROM part GROUP BY ALL
)"""

_USAGE = f"""{_SIZES}, hosts AS (
  SELECT p_brand AS db, {_COLL} AS coll, p_name AS idx, l_returnflag AS host,
         CASE WHEN l_returnflag = 'A' THEN 's0' ELSE 's1' END AS shard,
         CAST(sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS BIGINT) AS ops,
         min(l_shipdate) AS since, min(l_suppkey) AS supp
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), rates AS (
  SELECT *, CAST(date_diff('microsecond', since, TIMESTAMP '2002-01-01 00:00:00') AS DOUBLE) / 1e6 AS period,
         CASE WHEN ops > 2 THEN 2 ELSE 1 END AS v, idx LIKE 'red%' AND supp < 5 AS ttl
  FROM hosts
), rated AS (SELECT *, CASE WHEN ops = 0 THEN 0.0 WHEN period <> 0 THEN ops / period END AS ops_ps FROM rates)"""

_INDEX = f"""{_USAGE}, usage AS (
  SELECT db, coll, idx, sum(ops_ps) AS total_ops, min(period) AS period,
         CASE WHEN bool_and(ttl) <> bool_or(ttl) THEN 'mixed' WHEN bool_or(ttl) THEN 'TRUE' ELSE 'FALSE' END AS is_ttl,
         count(DISTINCT shard) AS n_shards, '{{"' || split_part(idx, ' ', 1) || '":1}}' AS key
  FROM rated GROUP BY db, coll, idx
)"""

_SERIES = """
s AS (SELECT user_id, ts, CAST(floor(value * 100) AS BIGINT) AS value FROM events),
inc AS (
  SELECT *, coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 0) AS inc FROM s
)"""

_TREE = """
leaf AS MATERIALIZED (
  SELECT CAST(year(l_shipdate) AS DOUBLE) AS ts, 'flag_' || l_returnflag AS a, 'status_' || l_linestatus AS b,
         'line_' || CAST(l_linenumber AS VARCHAR) AS c, sum(l_quantity) AS w
  FROM lineitem GROUP BY ALL
), tree AS MATERIALIZED (
  SELECT ts, '' AS node, 0 AS depth, sum(w) AS weight FROM leaf GROUP BY ts
  UNION ALL SELECT ts, a, 1, sum(w) FROM leaf GROUP BY ts, a
  UNION ALL SELECT ts, a || '/' || b, 2, sum(w) FROM leaf GROUP BY ts, a, b
  UNION ALL SELECT ts, a || '/' || b || '/' || c, 3, sum(w) FROM leaf GROUP BY ts, a, b, c
)"""

_DOCS = """
a AS (
  SELECT o_orderkey AS id, o_custkey AS cust, o_orderstatus AS status,
         CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderpriority AS pri FROM orders
), d AS (
  SELECT id, 'cust' AS path, 'type' AS change, 'Integer64' AS left_type, CAST(cust AS VARCHAR) AS left_value,
         'string' AS right_type, CAST(cust AS VARCHAR) AS right_value FROM a WHERE status = 'F'
  UNION ALL
  SELECT id, 'state.price', 'value', 'Integer64', CAST(price AS VARCHAR), 'Integer64', CAST(price + 1 AS VARCHAR)
  FROM a WHERE status = 'O'
  UNION ALL
  SELECT id, 'priority', 'only_left', 'string', pri, NULL, NULL FROM a WHERE pri = '1-URGENT'
  UNION ALL
  SELECT id, 'rush', 'only_right', NULL, NULL, 'boolean', 'true' FROM a WHERE pri = '1-URGENT'
)"""

_TOKENS = """
tok AS (SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+')) AS t FROM documents),
counted AS (
  SELECT 'string' AS kind, replace(t, '.', '_') AS token, count(*) AS count FROM tok WHERE t <> '' GROUP BY ALL
)"""

_COUNTS = ", ".join(
    f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("view", "signup", "purchase", "click", "error")
)
_ZEROS = ", ".join(f"coalesce({t}, 0) AS {t}" for t in ("view", "signup", "purchase", "click", "error"))

_LISTED = ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("view", "signup", "purchase")) + """,
       count(*) FILTER (event_type IS NULL OR event_type NOT IN ('view', 'signup', 'purchase')) AS other"""
_LISTED_ZEROS = ", ".join(f"coalesce({t}, 0) AS {t}" for t in ("view", "signup", "purchase")) + ', coalesce(other, 0) AS "Other"'


def _spine(unit: str, inner: str, columns: str) -> str:
    return f"""
WITH b AS (SELECT date_trunc('{unit}', ts) AS "Time", {inner} FROM events GROUP BY 1),
lim AS (SELECT min("Time") AS lo, max("Time") AS hi FROM b),
spine AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 {unit})) AS "Time" FROM lim)
SELECT spine."Time", {columns} FROM spine LEFT JOIN b ON b."Time" = spine."Time" """


SQL: dict[str, str] = {
    "ts_hourly_metrics": _spine(
        "hour",
        "sum(CAST(value AS DECIMAL(18,2))) AS cost, max(value) AS slowest, min(value) AS fastest, count(*) AS total",
        'CAST(coalesce(cost, 0) AS DOUBLE) AS cost, coalesce(slowest, 0) AS slowest, coalesce(fastest, 0) AS fastest, coalesce(total, 0) AS "Total"',
    ),
    "ts_minute_metrics": """
SELECT date_trunc('minute', ts) AS "Time", first(event_id ORDER BY ts, event_id) AS first_id, last(event_id ORDER BY ts, event_id) AS last_id,
       string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(*) AS "Total"
FROM events GROUP BY 1""",
    "ts_second_totals": """
SELECT date_trunc('second', ts) AS "Time", count(*) AS "Total" FROM events WHERE event_type = 'error' GROUP BY 1""",
    "ts_minute_filled": _spine("minute", "count(*) AS n", 'coalesce(n, 0) AS "Total"'),
    "crosstab_day_type": _spine("day", _COUNTS, _ZEROS),
    "crosstab_other": """
SELECT date_trunc('hour', ts) AS "Time", coalesce(CASE WHEN value > 10 THEN event_type END, 'Other') AS "Item",
       count(*) AS "Total" FROM events GROUP BY 1, 2""",
    "crosstab_minute_filled": _spine("minute", _LISTED, _LISTED_ZEROS),
    "shape_overall_cost": _shape_sql("ratio > 1", "cost DESC, col, shape"),
    "shape_collscan": _shape_sql("plan = 'COLLSCAN'", "cost DESC, col, shape"),
    "shape_long_running": _shape_sql("tms > 1000", "max_time DESC, col, shape"),
    "shape_has_field": _shape_sql("nret > 50", "cost DESC, col, shape"),
    "shape_all_groups": _shape_sql("true", "1", "", sample=False),
    "shape_multi_tenant": _line_sql("plan", "", "cost DESC, col, shape", False),
    "router_overall": _line_sql("obj", "", "cost DESC, col, shape", True),
    "router_multi_shard": _line_sql(
        "obj", "HAVING max(shards) > 1", "max_shards DESC, min_shards DESC, col, shape", True
    ),
    "report_union": f"""WITH {_EVENT_OPS}
{_cells('Overall Cost', 'ratio > 1', 'sum(tms) DESC, obj, shape')} UNION ALL
{_cells('Collection Scans', "plan = 'COLLSCAN'", 'sum(tms) DESC, obj, shape')} UNION ALL
{_cells('Long Running', 'tms > 1000', 'max(tms) DESC, obj, shape')} UNION ALL
{_cells('Has Sort Stage', 'nret > 50', 'sum(tms) DESC, obj, shape')}""",
    "date_range_strict": """
SELECT event_id, ts, event_type FROM events
WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-10 12:00:00'""",
    "file_in": """
SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents
WHERE source IN ('src1', 'src2', 'src3') GROUP BY source""",
    "range_stop_per_group": """
WITH n AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS pos FROM events),
stop AS (SELECT user_id, min(pos) AS pos FROM n WHERE ts > TIMESTAMP '2024-01-25 00:00:00' GROUP BY user_id)
SELECT n.user_id, n.event_id, n.ts FROM n LEFT JOIN stop ON n.user_id = stop.user_id
WHERE stop.pos IS NULL OR n.pos < stop.pos""",
    "ratio_modes": """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice) AS d, floor(l_quantity - 5) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n <> 0 THEN d / n END AS ratio_double,
       nullif(floor(d / greatest(n, 1)), 0) AS ratio_integer FROM r""",
    "start_ts": """
SELECT event_id, ts - to_milliseconds(CAST(floor(value * 100) AS BIGINT)) AS start_ts FROM events""",
    "wait_sum": """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(2 * floor(l_quantity) + l_linenumber AS BIGINT) AS total_micros,
       'locks.Global.' || l_returnflag || '.timeWaitingMicros|storage.data.timeReadingMicros|storage.timeWritingMicros' AS locks
FROM lineitem""",
    "topn_user_value": """
SELECT 'c' || CAST(o_custkey AS VARCHAR) AS col, o_orderpriority AS shape, count(*) AS cnt,
       CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS cost, max(CAST(floor(o_totalprice) AS BIGINT)) AS max_time,
       string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS operations
FROM orders GROUP BY ALL ORDER BY cost DESC, col, shape LIMIT 50""",
    "index_sizes_rollup": f"""WITH {_SIZES}
SELECT 's' AS server, db, db || '.' || coll AS collection, CAST(sum(bytes) AS BIGINT) AS total_size, count(*) AS index_count
FROM sizes GROUP BY db, coll""",
    "index_usage": f"""WITH {_USAGE}
SELECT 's' AS server, db || '.' || coll || '.' || idx AS name, max(ops) = 0 AS unused, false AS is_id,
       round(avg(CASE WHEN period <> 0 THEN ops / period END) * 1e6, 6) AS ops, min(period / 86400) AS days,
       count(*) AS n_shards, string_agg(DISTINCT CAST(v AS VARCHAR), ',' ORDER BY CAST(v AS VARCHAR)) AS index_versions
FROM rated GROUP BY db, coll, idx""",
    "index_merge_lookup": f"""WITH {_USAGE}, usage AS (
  SELECT db, coll, idx, max(ops) = 0 AS unused, min(period / 86400) AS days, count(*) AS n_shards FROM rated GROUP BY db, coll, idx)
SELECT 's' AS server, s.db || '.' || s.coll || '.' || s.idx AS name, s.idx AS index, s.bytes AS size, s.db AS db,
       s.coll AS collection, u.unused, CASE WHEN u.idx IS NOT NULL THEN false END AS is_id, u.days, u.n_shards
FROM sizes s LEFT JOIN usage u ON s.db = u.db AND s.coll = u.coll AND s.idx = u.idx""",
    "index_report_indexes": f"""WITH {_INDEX}, keys AS (
  SELECT p_brand AS db, {_COLL} AS coll, '{{"' || split_part(min(p_name), ' ', 1) || '":1}}' AS shard_key FROM part
  GROUP BY ALL)
SELECT s.coll || '.' || s.idx AS name, 's' AS server, s.db AS db, s.coll AS collection, s.idx AS index_name,
       s.bytes AS size, d.docs AS docs, round(u.total_ops * 1e6, 6) AS total_ops,
       round(CASE WHEN u.idx IS NULL THEN -1 WHEN d.docs > 0 THEN s.bytes / CAST(d.docs AS DOUBLE) ELSE 0 END, 6) AS key_size,
       u.key AS key, false AS is_id, u.is_ttl AS is_ttl,
       coalesce(u.total_ops = 0 AND u.is_ttl = 'FALSE', false) AS unused,
       coalesce(u.period < 604800, false) AS new_index,
       coalesce(u.key = coalesce(k.shard_key, 'No Shard Key'), false) AS shard_key, u.n_shards AS n_shards
FROM sizes s JOIN docs d ON s.db = d.db AND s.coll = d.coll
LEFT JOIN usage u ON s.db = u.db AND s.coll = u.coll AND s.idx = u.idx
LEFT JOIN keys k ON s.db = k.db AND s.coll = k.coll
WHERE EXISTS (SELECT 1 FROM hosts h WHERE h.db = s.db AND h.coll = s.coll)""",
    "index_report_per_shard": f"""WITH {_USAGE}
SELECT 's' AS server, db, coll AS collection, idx AS index_name, shard, round(sum(ops_ps) * 1e6, 6) AS shard_ops
FROM rated GROUP BY db, coll, idx, shard""",
    "db_rollup": f"""WITH {_INDEX}, per AS (
  SELECT s.db, s.coll, sum(s.bytes) AS index_size,
         coalesce(sum(CASE WHEN u.total_ops > 0 OR u.is_ttl <> 'FALSE' THEN s.bytes END), 0) AS used, max(u.n_shards) AS n
  FROM sizes s LEFT JOIN usage u ON s.db = u.db AND s.coll = u.coll AND s.idx = u.idx GROUP BY s.db, s.coll)
SELECT p.db AS db, count(*) AS collections, CAST(sum(d.datasize) AS BIGINT) AS data_size,
       CAST(sum(p.index_size) AS BIGINT) AS index_size, CAST(sum(p.used) AS BIGINT) AS used_index_size,
       greatest(max(p.n), 1) AS n_shards
FROM per p JOIN docs d ON p.db = d.db AND p.coll = d.coll
WHERE EXISTS (SELECT 1 FROM hosts h WHERE h.db = p.db AND h.coll = p.coll) GROUP BY p.db""",
    "collection_rollup": f"""WITH {_USAGE}
SELECT coll AS collection, count(DISTINCT db) AS databases FROM hosts GROUP BY coll""",
    "host_shard_map": f"""WITH {_USAGE} SELECT host, min(shard) AS shard FROM hosts GROUP BY host""",
    "shard_key_lookup": """
SELECT CAST(n_regionkey AS VARCHAR) AS db, n_name AS collection, coalesce(r_name, 'No Shard Key') AS shard_key
FROM nation LEFT JOIN (SELECT * FROM region WHERE r_name LIKE 'A%') ON r_regionkey = n_regionkey""",
    "span_hours": """
SELECT event_type AS server, date_diff('microsecond', min(ts), max(ts)) / 1e6 / 3600 AS headroom_hours
FROM events GROUP BY event_type""",
    "nested_export": f"""WITH {_USAGE}, f AS (SELECT *, row_number() OVER (PARTITION BY db, coll ORDER BY idx, host) AS rn FROM hosts)
SELECT 's' AS server, d.db AS db, d.coll AS coll, f.idx AS first_index, f.ops AS first_ops
FROM docs d LEFT JOIN f ON d.db = f.db AND d.coll = f.coll AND f.rn = 1""",
    "range_join_chunk": """
WITH pts AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS k FROM orders),
bands AS (SELECT DISTINCT k - k % w AS lo, k - k % w + w AS hi FROM pts, (SELECT unnest([500, 3000, 70000, 1000000]::BIGINT[]) AS w))
SELECT o_orderkey, k, lo, hi FROM pts JOIN bands ON k >= lo AND k < hi""",
    "range_join_composite": """
WITH cuts AS (
  SELECT o_orderpriority AS ns, o_custkey AS c, min(o_orderkey) AS o, o_custkey // 50 AS b FROM orders GROUP BY ALL),
chunks AS (
  SELECT *, coalesce(lead(c) OVER w, (b + 1) * 50) AS hc, coalesce(lead(o) OVER w, 0) AS ho
  FROM cuts WINDOW w AS (PARTITION BY ns, b ORDER BY c, o))
SELECT p.o_orderkey, p.o_orderpriority AS ns, c AS lo_cust, o AS lo_order FROM orders p JOIN chunks
  ON p.o_orderpriority = ns AND (p.o_custkey, p.o_orderkey) >= (c, o) AND (p.o_custkey, p.o_orderkey) < (hc, ho)""",
    "chunk_owners": """
WITH bounds AS (
  SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS ns, o_custkey AS c, o_orderkey AS o, o_custkey * 1000000000000 + o_orderkey AS low FROM orders),
points AS (
  SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 5 + 1 AS INT) AS ns, l_suppkey AS c, l_suppkey * 1000000000000 + l_orderkey AS key FROM lineitem)
SELECT l_orderkey, l_linenumber, p.ns AS ns, CASE WHEN b.o IS NULL THEN -1 WHEN b.o % 2 = 0 OR b.c = p.c THEN b.o END AS owner
FROM points p ASOF LEFT JOIN bounds b ON p.ns = b.ns AND p.key >= b.low""",
    "semi_has_data": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "anti_no_data": """
SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "param_join_fallback": """
WITH ranked AS (SELECT p_brand, p_size AS size, count(*) AS parts FROM part GROUP BY ALL),
samples AS (SELECT p_brand AS brand, p_size - p_size % 2 AS psize, min(p_partkey) AS sample, count(*) AS n FROM part GROUP BY ALL),
first AS (SELECT r.*, s.sample, s.n, 'exact' AS match FROM ranked r JOIN samples s ON r.p_brand = s.brand AND r.size = s.psize),
rest AS (SELECT * FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE r.p_brand = s.brand AND r.size = s.psize))
SELECT * FROM first UNION ALL
SELECT r.*, s.sample, s.n, 'fallback' FROM rest r JOIN samples s ON r.p_brand = s.brand AND s.psize = 2""",
    "dictionary_lookup": """
SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "carry_forward": """
SELECT user_id, ts, event_id, event_type,
       last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (
         PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_signup
FROM events""",
    "restart_sessions": """
WITH n AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (
             PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM events)
SELECT user_id, CAST(r AS BIGINT) AS restart_id, min(ts) AS ts,
       max(CASE WHEN event_type = 'error' THEN event_id END) AS last_error,
       max(CASE WHEN event_type = 'click' THEN event_id END) AS last_click
FROM n WHERE r > 0 GROUP BY user_id, r""",
    "stitch_by_start": """
WITH n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (
             PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM conversations)
SELECT conv_id, CAST(e AS BIGINT) AS entry_id, min(turn) AS first_line, max(turn) AS last_line, count(*) AS n_lines,
       string_agg(text, '' ORDER BY turn, text) AS entry FROM n GROUP BY conv_id, e""",
    "stitch_by_end": """
WITH n AS (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (
             PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             - CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS e FROM conversations)
SELECT conv_id, CAST(e AS BIGINT) AS entry_id, min(turn) AS first_line, max(turn) AS last_line, count(*) AS n_lines,
       string_agg(text, '\\n' ORDER BY turn, text) AS entry FROM n GROUP BY conv_id, e""",
    "increments": f"WITH {_SERIES} SELECT user_id, ts, value, inc FROM inc",
    "increments_per_chunk": """
SELECT user_id, ts, coalesce(CAST(floor(value * 100) AS BIGINT)
       - lag(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts), 0) AS inc
FROM events""",
    "max_increment": f"""WITH {_SERIES}, top AS (SELECT user_id, max(inc) AS m FROM inc WHERE inc > 0 GROUP BY user_id)
SELECT i.user_id AS user_id, i.inc AS max_inc, max(i.ts) AS max_ts FROM inc i JOIN top t ON i.user_id = t.user_id AND i.inc = t.m
GROUP BY i.user_id, i.inc""",
    "record_highs": f"""WITH {_SERIES}, h AS (SELECT *, max(inc) OVER (
  PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM inc)
SELECT user_id, ts, inc FROM h WHERE inc > 0 AND inc >= coalesce(before, 0)""",
    "delta_decode": f"WITH {_SERIES} SELECT user_id, ts, value FROM s",
    "first_n_per_group": """
SELECT doc_id, lang, source FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5""",
    "field_name_search": """
SELECT 'orders' AS ns, field, count(*) AS documents FROM (
  SELECT 'state' AS field FROM orders UNION ALL SELECT 'state.status' FROM orders UNION ALL SELECT 'state.price' FROM orders
  UNION ALL SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'rush' ELSE 'priority' END FROM orders)
GROUP BY field""",
    "schema_profile": """
WITH f AS (
  SELECT 'cust' AS path, 1 AS level, CASE WHEN o_orderstatus = 'F' THEN 'String' ELSE 'Long' END AS type, CAST(o_custkey AS VARCHAR) AS v FROM orders
  UNION ALL SELECT 'state', 1, 'Document', NULL FROM orders
  UNION ALL SELECT 'state.status', 2, 'String', o_orderstatus FROM orders
  UNION ALL SELECT 'state.price', 2, 'Long', CAST(CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS VARCHAR) FROM orders
  UNION ALL SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'rush' ELSE 'priority' END, 1,
                   CASE WHEN o_orderpriority = '1-URGENT' THEN 'Boolean' ELSE 'String' END,
                   CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE o_orderpriority END FROM orders),
tot AS (SELECT path, level, count(*) AS n FROM f GROUP BY ALL),
typ AS (SELECT path, type, count(*) AS n FROM f GROUP BY ALL),
dup AS (SELECT path, coalesce(max(n) > 1, false) AS d FROM (SELECT path, type, v, count(v) AS n FROM f GROUP BY path, type, v) GROUP BY path)
SELECT tot.path AS path, tot.level AS level, tot.n AS count, round(tot.n / CAST((SELECT count(*) FROM orders) AS DOUBLE), 9) AS probability,
       string_agg(typ.type || ':' || CAST(CAST(round(typ.n * 100 / CAST(tot.n AS DOUBLE), 4) AS DECIMAL(18,4)) AS VARCHAR), ',' ORDER BY typ.type) AS types,
       any_value(dup.d) AS has_duplicates
FROM tot JOIN typ ON tot.path = typ.path JOIN dup ON tot.path = dup.path GROUP BY tot.path, tot.level, tot.n""",
    "doc_diff": f"WITH {_DOCS} SELECT * FROM d",
    "doc_diff_lines": f"""WITH {_DOCS}, l AS (
  SELECT id, repeat('   ', len(path) - len(replace(path, '.', '')) + 1) || path || ':' AS p, d.* EXCLUDE (id, path) FROM d)
SELECT id, 0 AS line_no, CASE WHEN change = 'only_right' THEN '>' || p || right_value
       WHEN change = 'type' THEN '<' || p || left_type ELSE '<' || p || left_value END AS line FROM l
UNION ALL
SELECT id, 1, CASE WHEN change = 'type' THEN '>' || p || right_type ELSE '>' || p || right_value END FROM l
WHERE change IN ('type', 'value')""",
    "doc_diff_repeats": """
WITH side AS (
  SELECT o_custkey AS id, o_orderpriority AS p, o_orderstatus AS s, 1 AS side FROM orders WHERE o_orderkey % 11 <> 3
  UNION ALL SELECT o_custkey, o_orderpriority, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END, -1 FROM orders WHERE o_orderkey % 13 <> 4),
net AS (SELECT id, p, s, CAST(sum(side) AS BIGINT) AS net, md5('{"p":"' || p || '","s":"' || s || '"}') AS h FROM side GROUP BY id, p, s HAVING sum(side) <> 0),
copies AS (SELECT id, p, s, h, sign(net) AS side, unnest(range(abs(net))) AS copy FROM net),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY h, copy) AS pair FROM copies),
met AS (
  SELECT coalesce(a.id, b.id) AS id, coalesce(a.pair, b.pair) AS pair, a.p AS lp, a.s AS ls, b.p AS rp, b.s AS rs
  FROM (FROM ranked WHERE side = 1) a FULL JOIN (FROM ranked WHERE side = -1) b ON a.id = b.id AND a.pair = b.pair)
SELECT id, pair, path, CASE WHEN r IS NULL THEN 'only_left' WHEN l IS NULL THEN 'only_right' ELSE 'value' END AS change, l AS left_value, r AS right_value
FROM (SELECT id, pair, 'p' AS path, lp AS l, rp AS r FROM met UNION ALL SELECT id, pair, 's', ls, rs FROM met) WHERE l IS DISTINCT FROM r""",
    "flatten_deep": """
WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CAST(CASE WHEN event_id % 500 = 0 THEN 4000 ELSE event_id % 7 + 1 END AS INT) AS depth,
  CASE WHEN event_id % 500 = 1 THEN 'number' ELSE 'Integer64' END AS type,
  CASE WHEN event_id % 500 = 1 THEN repeat('9', 5000) ELSE CAST(k AS VARCHAR) END AS value FROM e""",
    "json_rejected": """
SELECT event_id, CASE event_id % 8 WHEN 1 THEN left(props, len(props) - 1) WHEN 2 THEN props || 'x' END AS raw FROM events WHERE event_id % 8 IN (1, 2, 3)""",
    "key_difference_sides": """
WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT DISTINCT vec_id AS doc_id FROM embeddings)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right' ELSE 'left' END AS side
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""",
    "array_key_count": """
WITH k AS (SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS key, min_by(role, turn) AS type FROM conversations GROUP BY conv_id)
SELECT key, min(type) AS type, count(*) AS count FROM k GROUP BY key""",
    "flatten_paths": f"""
SELECT event_id, 'k' AS path, 'Integer64' AS type, json_extract_string(props, '$.k') AS value FROM events""",
    "token_frequency": f"WITH {_TOKENS.replace('documents', 'conversations')} SELECT * FROM counted",
    "token_counts_all": f"WITH {_TOKENS} SELECT * FROM counted",
    "command_counts": """
SELECT 'command' AS kind, coalesce(CASE WHEN value > 5 THEN event_type || '_x' END, 'Missing') AS token, count(*) AS count
FROM events GROUP BY 2""",
    "driver_counts": """
SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS ip, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS driver,
       count(*) AS count FROM pages GROUP BY ALL""",
    "event_time_by_key": """
SELECT event_type AS key, count(*) AS count, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total_time
FROM events GROUP BY event_type""",
    "key_value_config": """
WITH q AS (SELECT page_id, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
p AS (SELECT page_id, unnest(string_split(q, '&')) AS kv FROM q WHERE q <> '')
SELECT page_id, split_part(kv, '=', 1) AS name, split_part(kv, '=', 2) AS value FROM p""",
    "name_cleanup": "SELECT p_partkey, p_name || '<...>::run ' AS name FROM part",
    "dollar_keys": f"""
SELECT event_id, '{{"_$match":{{"k":{{"_$gt":' || CAST({_K} AS VARCHAR) || '}}}}}}' AS body FROM events""",
    "token_coercion": f"""
SELECT event_id, CASE event_type WHEN 'view' THEN 'int' WHEN 'click' THEN 'double' ELSE 'string' END AS kind,
       CASE event_type WHEN 'view' THEN CAST({_K} AS DOUBLE) WHEN 'click' THEN value END AS number FROM events""",
    "replay_offset": """
WITH s AS (SELECT event_id, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-02-01 00:00:00') AS s FROM events),
p AS (SELECT event_id, s // 3600 AS h, (s % 3600) // 60 AS m, s % 60 AS x FROM s)
SELECT event_id, 'PT' || CASE WHEN h <> 0 THEN CAST(h AS VARCHAR) || 'H' ELSE '' END
       || CASE WHEN m <> 0 THEN CAST(m AS VARCHAR) || 'M' ELSE '' END
       || CASE WHEN x <> 0 THEN CAST(x AS VARCHAR) || 'S' ELSE '' END AS shift FROM p""",
    "param_literals": """
SELECT event_id, CASE event_type WHEN 'view' THEN json_extract_string(props, '$.k')
       WHEN 'click' THEN 'ObjectId(''' || json_extract_string(props, '$.k') || ''')' WHEN 'error' THEN 'null'
       ELSE '''' || json_extract_string(props, '$.k') || '''' END AS literal FROM events""",
    "query_shape": f"""
WITH s AS (SELECT CASE event_type WHEN 'view' THEN '{{k: 1}}' WHEN 'click' THEN '{{k: {{$in: [ N ]}}}}'
             WHEN 'error' THEN '{{$or: [ {{k: 1}},{{u: {{$ne: 1}}}} ]}}' ELSE '{{k: {{$gte: 1}},at: 1}}' END AS shape,
             event_type = 'error' AS has_ne, CASE event_type WHEN 'view' THEN 1 ELSE 2 END AS n, {_K} AS k FROM events)
SELECT shape, has_ne, count(*) AS cnt, CAST(sum(n) AS BIGINT) AS n_params, CAST(sum(k) AS BIGINT) AS first_sum FROM s GROUP BY ALL""",
    "sort_shape": """
SELECT '{a: 1,b: {$in: [3]},c: {$x: {}},d: {$meta: 1}}' AS shape, count(*) AS cnt FROM events""",
    "tree_rollup": f"WITH {_TREE} SELECT * FROM tree",
    # The root's weight by a window: no join has to be planned.
    "tree_share": f"""WITH {_TREE}
SELECT ts, node, round(weight / max(CASE WHEN depth = 0 THEN weight END) OVER (PARTITION BY ts), 9) AS share FROM tree""",
    "tree_prune": f"""WITH {_TREE}, rev AS MATERIALIZED (
  SELECT ts, '' AS node, sum(w) AS weight FROM leaf GROUP BY ts
  UNION ALL SELECT ts, 'LEAF', sum(w) FROM leaf GROUP BY ts
  UNION ALL SELECT ts, 'LEAF/' || c, sum(w) FROM leaf GROUP BY ts, c
  UNION ALL SELECT ts, 'LEAF/' || c || '/' || b, sum(w) FROM leaf GROUP BY ts, b, c
  UNION ALL SELECT ts, 'LEAF/' || c || '/' || b || '/' || a, sum(w) FROM leaf GROUP BY ts, a, b, c),
shares AS (SELECT *, weight / max(CASE WHEN node = '' THEN weight END) OVER (PARTITION BY ts) AS share FROM rev)
SELECT ts, node, weight FROM shares QUALIFY max(share) OVER (PARTITION BY node) >= 0.08""",
    "tree_order": f"""WITH {_TREE}, nodes AS (SELECT node, depth, sum(weight) AS total FROM tree GROUP BY node, depth),
k AS (SELECT n.*, split_part(node, '/', 1) AS a, split_part(node, '/', 1) || '/' || split_part(node, '/', 2) AS ab FROM nodes n WHERE depth > 0),
j AS (SELECT k.node, k.depth, k.total, na.total AS ta, k.a AS a, nb.total AS tb, k.ab AS ab FROM k JOIN nodes na ON na.node = k.a
      LEFT JOIN nodes nb ON k.depth >= 2 AND nb.node = k.ab)
SELECT node, depth, total, row_number() OVER (ORDER BY ta DESC, a, CASE WHEN depth < 2 THEN 0 ELSE 1 END, tb DESC, ab,
       CASE WHEN depth < 3 THEN 0 ELSE 1 END, total DESC, node) - 1 AS position FROM j""",
}
