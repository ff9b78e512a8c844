"""SQL twins of the queries in ``log_tables``: what the rendered entries must give, computed from the source columns."""

from __future__ import annotations

from plumeline.plans.table_sql import SQL as _TABLE_SQL

_EVENTS = """
e AS (
  SELECT *, event_id AS n, user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(floor(value * 100) AS BIGINT) AS ms, CAST(floor(value * 10) AS BIGINT) AS d, user_id % 7 AS h,
         'node' || CAST(event_id % 3 AS VARCHAR) || '.log' AS infile, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS stamp,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS iso, date_trunc('milliseconds', ts) AS milli
  FROM events)"""

_ORDERS = """
o AS (
  SELECT o_orderkey AS n, o_custkey AS c, substr(o_orderpriority, 1, 1) AS p, CAST(floor(o_totalprice) AS BIGINT) AS v,
         'node' || CAST(o_orderkey % 3 AS VARCHAR) || '.log' AS infile,
         strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S.%g') AS stamp, o_totalprice, o_orderdate
  FROM orders)"""


def _when(number: str, cases: dict[int, str]) -> str:
    return f"CASE {number} " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + " END"


def _j(cases: dict[int, str]) -> str:
    return _when("n % 8", cases)


def _t(cases: dict[int, str]) -> str:
    return _when("n % 9", cases)


SQL: dict[str, str] = {
    "json_log_events": f"""WITH {_EVENTS}
SELECT infile, n AS lineno, {_j({0: "'COMMAND'", 1: "'COMMAND'", 2: "'WRITE'", 3: "'NETWORK'", 4: "'REPL'", 5: "'TXN'", 6: "'NETWORK'"})} AS type, stamp AS ts,
  {_j({3: "'accept'"})} AS operation, {_j({0: "'conn' || u", 1: "'conn' || u", 2: "'conn' || u", 3: "'conn' || n", 5: "'conn' || u"})} AS connection,
  {_j({3: "k"})} AS connection_count, {_j({3: "'10.0.0.' || h"})} AS ip_addr, {_j({4: "'repl-' || h", 6: "'conn' || u"})} AS thread, {_j({4: "'CRUD' || h"})} AS applied_op,
  {_j({0: "'find'", 1: "'getMore'", 2: "'update'"})} AS command, {_j({0: "'u' || u", 1: "'u' || u", 2: "'u' || u"})} AS object, {_j({0: "'app' || h"})} AS application,
  {_j({1: "CAST(n AS VARCHAR)"})} AS cursor, {_j({0: "k"})} AS batch_size,
  {_j({0: "'{k: 1,u: {$in: [ N ]}}'", 1: "'{k: {$gt: 1}}'", 2: "'{_id: 1}'"})} AS filter_shape,
  {_j({0: "'int:' || k || '|int:' || u || '|int:' || k", 1: "'int:' || k", 2: "'objectid:a' || k"})} AS params,
  {_j({0: "'H' || h"})} AS query_hash, {_j({0: "'P' || h"})} AS plan_cache_key, {_j({0: "'IXSCAN { k: 1 }'"})} AS plan_summary,
  {_j({0: "d", 1: "d"})} AS docs_examined, {_j({0: "k", 1: "0"})} AS nreturned, {_j({0: "h"})} AS n_shards,
  {_j({0: "ms", 1: "ms", 2: "ms"})} AS duration_millis, {_j({0: "true"})} AS has_sort_stage,
  {_j({0: "CASE WHEN k <> 0 THEN round(d / CAST(k AS DOUBLE), 6) END"})} AS ratio,
  {_j({i: "strftime(milli - to_milliseconds(ms), '%Y-%m-%d %H:%M:%S.%g')" for i in (0, 1, 2)})} AS start_ts,
  {_j({0: "k + d + ms"})} AS wait_micros, {_j({0: "'locks.Global.r.timeWaitingMicros|storage.data.timeReadingMicros|storage.cache.timeWaitingMicros'"})} AS wait_names,
  {_j({0: "'s' || u", 5: "'s' || u"})} AS session_id, {_j({0: "n", 5: "n"})} AS txn_number
FROM e WHERE n % 8 <> 7""",
    "oversize_messages": f"WITH {_EVENTS} SELECT infile, n AS lineno, '18446744073709551' || k AS msg_len FROM e WHERE n % 8 = 6",
    "log_headers": f"""WITH {_EVENTS},
r AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY infile ORDER BY n) AS r FROM e WHERE event_type <> 'error')
SELECT infile, CAST(r AS BIGINT) AS restart_id, min(stamp) AS ts, min(n) AS lineno, max(CASE WHEN event_type = 'signup' THEN 'h' || u END) AS host,
  max(CASE WHEN event_type = 'signup' THEN '{{"pid":' || n || ',"host":"h' || u || '"}}' END) AS process,
  '{{"version":"v' || arg_max(k, n) FILTER (event_type = 'purchase') || '"}}' AS build,
  '{{"name":"os' || arg_max(k, n) FILTER (event_type = 'view') || '"}}' AS os,
  '{{"opts":' || arg_max(k, n) FILTER (event_type = 'click') || '}}' AS cmd_line
FROM r WHERE r > 0 GROUP BY infile, r""",
    "text_log_events": f"""WITH {_ORDERS}
SELECT infile, n AS lineno,
  {_t({0: "'COMMAND'", 1: "'COMMAND'", 2: "'NETWORK'", 3: "'REPL'", 4: "'SHARDING'", 5: "'ACCESS'", 6: "'COMMAND'"})} AS type, stamp AS ts,
  {_t({2: "'accept'"})} AS operation, {_t({0: "CAST(c AS VARCHAR)", 1: "CAST(c AS VARCHAR)", 2: "CAST(n AS VARCHAR)", 5: "CAST(c AS VARCHAR)", 6: "CAST(c AS VARCHAR)"})} AS connection,
  {_t({2: "'10.0.0.' || p"})} AS ip_addr, {_t({5: "'u' || c"})} AS user, {_t({3: "'repl-' || p"})} AS thread, {_t({3: "'CRUD'"})} AS applied_op,
  {_t({4: "'startMig'"})} AS shard_op, {_t({4: "'shop.c' || c"})} AS collection, {_t({4: "'{ k: ' || c || ' }'"})} AS range_min, {_t({4: "'{ k: ' || v || ' }'"})} AS range_max,
  {_t({4: "'Balancer'"})} AS module, {_t({0: "'find'", 1: "'getMore'", 6: "'setParam'"})} AS command, {_t({0: "'shop.c' || c", 1: "'shop.c' || c"})} AS object,
  {_t({0: "'web ' || p"})} AS application, {_t({1: "CAST(n AS VARCHAR)"})} AS cursor,
  {_t({0: "'{a: 1,at: {$gt: 1},n.x: 1}'", 1: "'{b: {$in: [ N ]}}'"})} AS filter_shape,
  {_t({0: "'int:' || v || '|date:' || v || '000|string:it'", 1: "'int:' || c || '|int:2'"})} AS params,
  {_t({0: "'H' || p"})} AS query_hash, {_t({0: "'P' || p"})} AS plan_cache_key, {_t({0: "'IXSCAN { a: 1 }'", 1: "'COLLSCAN'"})} AS plan_summary,
  {_t({0: "v", 1: "9"})} AS docs_examined, {_t({0: "c", 1: "0"})} AS keys_examined, {_t({0: "c", 1: "3"})} AS nreturned, {_t({0: "v", 1: "10"})} AS reslen,
  {_t({0: "v", 1: "v"})} AS duration_millis, {_t({0: "true"})} AS has_sort_stage,
  {_t({0: "CASE WHEN c <> 0 THEN round(v / CAST(c AS DOUBLE), 6) END", 1: "3.0"})} AS ratio, {_t({0: "c"})} AS wait_micros, {_t({6: "p"})} AS new_value
FROM o WHERE n % 9 NOT IN (7, 8)""",
    "sharding_messages": f"""WITH {_EVENTS},
kinds AS (SELECT * FROM (VALUES
  (0, 'status', NULL, NULL), (1, 'spltLookup', 6, NULL),
  (2, 'updMeta', 4, [['newCollection', '15'], ['newShard', '18'], ['oldCollection', '8'], ['oldShard', '11']]),
  (3, 'succeeded', NULL, [['newCollection', '7']]), (4, 'entered critical', NULL, NULL), (5, 'log', NULL, NULL),
  (6, 'autosplit', 1, [['lastmod', '6'], ['maxChunkSize', '13'], ['nParts', '10'], ['shard', '4']]),
  (7, 'findAuto', 6, [['numSplits', '12'], ['time', '15']]), (8, 'noDoc', 6, NULL), (9, 'waitRepl', NULL, NULL), (10, 'waitMaj', 8, NULL),
  (11, 'migComm', 7, NULL), (12, 'finDel', 4, NULL), (13, 'finDel', 2, NULL), (14, 'findAuto', 3, NULL), (15, 'startMig', 4, NULL),
  (16, 'queryPoss', 4, NULL), (17, 'schedDef', 4, NULL), (18, 'delSched', 2, NULL), (19, 'findAuto', 3, NULL), (20, 'repSucc', NULL, NULL),
  (21, 'schedDel', 6, NULL), (22, 'startRec', 12, [['epoch', '17'], ['source', '14']]), (23, 'updConfigSet', NULL, [['cluster', '6']]),
  (24, 'Somenewkind', NULL, NULL)) x(kind, op, place, marks))
SELECT infile, n AS lineno, op AS shard_op, 't' || place || 'x' || u AS collection,
  CASE WHEN kind = 0 THEN 'docsLeft=' || n || ';memUsed=' || k
       ELSE array_to_string(list_transform(marks, lambda m: m[1] || '=t' || m[2] || 'x' || u), ';') END AS stats
FROM e JOIN kinds ON n % 25 = kind""",
    "log_rejects": f"""WITH {_EVENTS}, {_ORDERS}
SELECT infile, n AS lineno, 'unreadable json entry' AS error FROM e WHERE n % 8 = 7
UNION ALL SELECT infile, n, 'unreadable document' FROM o WHERE n % 9 = 7
UNION ALL SELECT infile, n, 'unreadable text entry' FROM o WHERE n % 9 = 8""",
    "syslog_events": f"""WITH {_EVENTS}
SELECT infile, n AS lineno, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000' AS ts, 'host' || h AS host, CAST(u AS VARCHAR) AS connection, 'count' AS command,
  'shop.u' || u AS object, '{{a: 1}}' AS filter_shape, 'int:' || k AS params, d AS docs_examined, k AS nreturned, ms AS duration_millis FROM e""",
    "audit_events": f"""WITH {_EVENTS}
SELECT infile, n AS lineno, event_type AS type, stamp AS ts,
  '{{ "atype" : "' || event_type || '", "ts" : ' || CASE WHEN n % 2 = 0 THEN '{{ "$date" : "' || iso || 'Z" }}' ELSE '"' || iso || 'Z"' END
    || ', "param" : {{ "user" : "u' || u || '" }} }}' AS raw,
  strftime(ts, '%Y-%m-%d') AS log_date FROM e""",
    "search_events": f"""WITH {_EVENTS}
SELECT infile, n AS lineno, 'MONGOT' AS type, stamp AS ts, CASE WHEN n % 3 = 0 THEN 'conf' ELSE 'idx' END || h AS module,
  CASE WHEN n % 3 = 0 THEN 'INFO' ELSE 'WARN' END AS severity, CASE WHEN n % 3 = 0 THEN 'ConfCallResponse' ELSE 'plain ' || k END AS message,
  CASE WHEN n % 3 <> 0 THEN '{{"u":' || u || '}}' END AS attr, CASE WHEN n % 3 = 0 THEN CAST(n AS VARCHAR) END AS config_id,
  CASE WHEN n % 3 = 0 THEN CAST(k AS VARCHAR) END AS config_version, CASE WHEN n % 3 = 0 THEN 'a' || u END AS config_analyzer FROM e""",
    "normalise_commands": f"""WITH {_ORDERS}
SELECT n AS id, {_when("n % 6", {0: "'find'", 1: "'aggregate'", 2: "'count'", 3: "'insert'"})} AS cmd_type,
  {_when("n % 6", {0: "'{a.b: 1,t: 1,bin: 1}'", 1: "'{k: {$ne: 1},s: 1}'", 2: "'{k: {$nin: [ N ]}}'"})} AS filter,
  {_when("n % 6", {0: "'int:' || v || '|string:Timestamp(' || c || ', 1)|string:0AFF'", 1: "'int:' || c || '|string:it is'", 2: "'int:' || c || '|int:' || v"})} AS params,
  CASE WHEN n % 6 < 4 THEN nullif(CAST(v // greatest(c, 1) AS DOUBLE), 0) END AS ratio, {_when("n % 6", {0: "'{a: 1}'"})} AS sort, {_when("n % 6", {0: "'{a: 1}'"})} AS hint,
  {_when("n % 6", {0: "CAST(c AS INT)"})} AS "limit", {_when("n % 6", {3: """'{"w":"default"}'"""})} AS concern,
  CASE WHEN n % 6 < 4 THEN n % 6 = 1 END AS has_ne, CASE WHEN n % 6 < 4 THEN n % 6 = 2 END AS has_nin, CASE WHEN n % 6 = 4 THEN 'not a document' END AS error
FROM o WHERE n % 6 < 5""",
    "normalise_updates": f"""WITH {_ORDERS}
SELECT n AS id, CASE WHEN n % 3 = 0 THEN true END AS upsert, CASE WHEN n % 3 < 2 THEN '{{_id: 1,k: {{$nin: [ 1 ]}}}}' END AS filter,
  CASE WHEN n % 3 < 2 THEN 'string:ObjectId(''' || c || ''')|int:' || c END AS params, CASE WHEN n % 3 = 0 THEN '{{n: {{$ne: 1}}}}' END AS soi,
  {_when("n % 3", {0: "'{a.b: 1,c d: 1}'", 1: "'{e: 1}'"})} AS changes, {_when("n % 3", {0: "'int:' || v || '|string:x'", 1: "'double:1500.0'"})} AS set_params,
  CASE WHEN n % 3 < 2 THEN n % 3 = 0 END AS has_ne, CASE WHEN n % 3 < 2 THEN true END AS has_nin, CASE WHEN n % 3 = 2 THEN 'not a document' END AS error
FROM o""",
    "extract_parameters": f"""WITH {_ORDERS}, s AS (
  SELECT n, 'c' || (c % 10) AS ns, n % 3 AS kind, CAST(c AS VARCHAR) AS lit,
    date_diff('hour', o_orderdate, TIMESTAMP '2024-02-01 00:00:00') AS hours FROM o),
ranked AS (SELECT 'c' || (c % 10) AS ns, CAST(sum(v) AS BIGINT) AS prd_rank FROM o GROUP BY 1),
shapes AS (SELECT * FROM (VALUES (0, '{{a: 1}}', 'exact'), (1, '{{a: {{$in: [ N ]}}}}', 'fallback'), (2, '{{d: 1}}', 'exact')) x(kind, filter, match))
SELECT r.ns AS ns, f.filter AS filter, prd_rank, s.n AS sample_id, f.match AS match, CASE WHEN s.kind < 2 THEN lit ELSE '' END AS params,
  CASE WHEN s.kind = 2 THEN 'PT' || hours || 'H' ELSE '' END AS shifts
FROM ranked r JOIN s ON r.ns = s.ns JOIN shapes f ON f.kind = s.kind WHERE r.ns <> 'c3'
UNION ALL SELECT ns, '{{none: 1}}', prd_rank, NULL, NULL, NULL, NULL FROM ranked WHERE ns <> 'c3'""",
    "update_by_key": """
WITH ch AS (SELECT l_orderkey AS k, max(l_returnflag) AS f, count(*) AS lines FROM lineitem GROUP BY 1 HAVING count(*) > 3)
SELECT o_orderkey, coalesce(f, o_orderstatus) AS o_orderstatus, o_custkey, lines FROM orders LEFT JOIN ch ON k = o_orderkey""",
    "profile_tree": """
WITH leaf AS (
  SELECT CAST(year(l_shipdate) AS DOUBLE) AS ts, 'line_' || l_linenumber AS a, 'status_' || l_linestatus AS b,
         CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag_' || l_returnflag END AS c, l_quantity AS w, l_returnflag = 'A' AS is_hot
  FROM lineitem),
tree AS (
  SELECT ts, '' AS node, 0 AS depth, w, is_hot FROM leaf UNION ALL SELECT ts, a, 1, w, is_hot FROM leaf
  UNION ALL SELECT ts, a || '/' || b, 2, w, is_hot FROM leaf UNION ALL SELECT ts, a || '/' || b || '/' || c, 3, w, is_hot FROM leaf WHERE c IS NOT NULL)
SELECT ts, node, depth, sum(w) AS weight, coalesce(sum(w) FILTER (is_hot), 0) AS hot FROM tree GROUP BY ts, node, depth""",
    "update_repeated": """
WITH ch AS (SELECT l_orderkey AS k, arg_max(l_returnflag, (l_linenumber, l_returnflag)) AS f, max(l_linenumber) AS line FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(f, o_orderstatus) AS o_orderstatus, o_custkey, line FROM orders LEFT JOIN ch ON k = o_orderkey""",
    "update_stored": """
WITH ch AS (SELECT l_orderkey AS k, max(l_returnflag) AS f FROM lineitem WHERE l_quantity >= 49 GROUP BY 1)
SELECT o_orderkey, coalesce(f, o_orderstatus) AS o_orderstatus, o_custkey, o_orderpriority FROM orders LEFT JOIN ch ON k = o_orderkey""",
    "sample_documents": """
SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY md5('0:' || doc_id), doc_id) <= 3""",
    "dominant_types": _TABLE_SQL["schema_profile"].rsplit("SELECT tot.path", 1)[0]
    + "SELECT path, arg_min(type, (-n, type)) AS type FROM typ GROUP BY path",
    "schema_document": r"""
WITH f AS (
  SELECT * FROM (VALUES ('cust', CASE WHEN (SELECT 2 * count(*) FILTER (o_orderstatus = 'F') > count(*) FROM orders) THEN 'string' ELSE 'long' END, 1.0),
    ('priority', 'string', (SELECT avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END) FROM orders)),
    ('rush', 'bool', (SELECT avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) FROM orders))) x(name, type, share)
  WHERE share > 0),
inner_doc AS (SELECT '{"bsonType":"object","properties":{"price":{"bsonType":"long"},"status":{"bsonType":"string"}},"required":["price","status"]}' AS node),
fields AS (
  SELECT name, '{"bsonType":"' || type || '"}' AS node, share FROM f UNION ALL SELECT 'state', node, 1.0 FROM inner_doc)
SELECT '{"validator":{"$jsonSchema":{"title":"orders","description":"all orders","bsonType":"object","properties":{'
  || string_agg('"' || name || '":' || node, ',' ORDER BY name) || '},"required":['
  || string_agg('"' || name || '"', ',' ORDER BY name) FILTER (share >= 1) || ']}},"validationLevel":"moderate","validationAction":"warn"}' AS schema
FROM fields""",
}
