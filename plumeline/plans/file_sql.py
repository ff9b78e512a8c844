"""SQL twins of the queries in ``file_queries``, computed from the source columns."""

from __future__ import annotations

from plumeline.plans.log_sql import _EVENTS, _ORDERS, _when


def _i(cases: dict[int, str]) -> str:
    return _when("n % 8", cases)


_LOGS = f"""{_EVENTS},
lines AS (
  SELECT *, n // 20000 AS file,
    CAST(sum(CASE WHEN n % 8 = 1 THEN 3 ELSE 1 END) OVER (PARTITION BY n // 20000 ORDER BY n) AS BIGINT) AS lineno,
    last_value(CASE WHEN n % 8 = 2 THEN 'h' || u END IGNORE NULLS) OVER (PARTITION BY n // 20000 ORDER BY n) AS in_force
  FROM e)"""

_ENDS = f"""{_ORDERS},
entries AS (
  SELECT n, n // 20000 AS file, CASE WHEN c % 4 = 0 THEN 1 ELSE c % 4 + 2 END AS n_lines,
    strftime(o_orderdate + to_seconds(n % 86400), '%Y-%m-%dT%H:%M:%S.%g') || '-0000 I COMMAND  [conn' || c || '] command shop.c' || c || ' planSummary: COLLSCAN'
      || CASE WHEN c % 4 = 0 THEN '' ELSE array_to_string(list_transform(range(0, c % 4 + 1), lambda i: chr(10) || '  part ' || i), '') END
      || ' docsExamined:1 ' || v || 'ms' AS entry
  FROM o),
placed AS (SELECT *, CAST(sum(n_lines) OVER (PARTITION BY file ORDER BY n) AS BIGINT) AS lineno FROM entries)"""

_SAMPLES = f"""{_EVENTS},
s AS (
  SELECT *, strftime(ts, '%Y-%m-%d') AS file, hour(ts) AS hour, epoch_us(ts) // 1000 AS millis FROM e),
placed AS (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY file ORDER BY hour) AS INT) AS chunk_no,
    CAST(row_number() OVER (PARTITION BY file, hour ORDER BY millis, n) - 1 AS INT) AS sample_no
  FROM s),
samples AS (
  SELECT file, chunk_no, sample_no, stamp AS ts, x.path AS path, x.value AS value
  FROM (SELECT *, unnest([
    {{'path': 'start', 'value': millis}}, {{'path': 'event.id', 'value': n}}, {{'path': 'event.user', 'value': u}},
    {{'path': 'cents', 'value': ms}}, {{'path': 'event.k', 'value': k}}]) AS x FROM placed))"""

SQL: dict[str, str] = {
    "ingest_events": f"""WITH {_LOGS}
SELECT file, lineno, {_i({0: "'COMMAND'", 1: "'COMMAND'", 3: "'login' || h", 4: "'MONGOT'", 6: "'WRITE'", 7: "'NETWORK'"})} AS type, stamp AS ts,
  {_i({0: "in_force", 4: "in_force"})} AS host, {_i({0: "'find'", 1: "'find'", 6: "'update'"})} AS command,
  {_i({0: "'u' || u", 1: "'shop.c' || u", 6: "'shop.c' || u"})} AS object,
  {_i({0: "'{k: 1,u: {$in: [ N ]}}'", 1: "'{a: 1,b: {$gt: 1}}'", 6: "'{_id: 1}'"})} AS filter_shape,
  {_i({0: "d", 1: "d", 6: "1"})} AS docs_examined, {_i({0: "ms", 1: "ms", 6: "ms"})} AS duration_millis,
  {_i({4: "'idx' || h"})} AS module, {_i({7: "'10.0.0.' || h"})} AS ip_addr, strftime(ts, '%Y-%m-%d') AS log_date, CAST(2 AS BIGINT) AS copies
FROM lines WHERE n % 8 NOT IN (2, 5)""",
    "ingest_headers": f"""WITH {_LOGS}
SELECT file, row_number() OVER (PARTITION BY file ORDER BY n) AS restart_id, lineno, 'h' || u AS host, stamp AS ts, CAST(2 AS BIGINT) AS copies
FROM lines WHERE n % 8 = 2""",
    "ingest_rejects": f"""WITH {_LOGS}
SELECT file, lineno, 'unreadable json entry' AS error, CAST(len('{{"t":{{"$date":"' || iso || '+00:00"}},"s":"I","c":"COMMAND","id":51803,"ctx":"conn' || u || '","msg":"Slow qu') AS INT) AS raw_length, CAST(2 AS BIGINT) AS copies
FROM lines WHERE n % 8 = 5""",
    "stitched_by_end": f"WITH {_ENDS} SELECT file, lineno, CAST(n_lines AS BIGINT) AS n_lines, 'text' AS format, md5(entry) AS entry FROM placed",
    "numbered_lines": f"""WITH {_ENDS}
SELECT file, lineno - n_lines + i AS lineno, md5(string_split(entry, chr(10))[i]) AS value
FROM (SELECT *, unnest(range(1, n_lines + 1)) AS i FROM placed)""",
    "archive_samples": f"WITH {_SAMPLES} SELECT file, chunk_no, sample_no, path, ts, value FROM samples",
    "archive_metadata": f"WITH {_SAMPLES} SELECT file, CAST(0 AS INT) AS chunk_no, count(*) AS events FROM placed GROUP BY file",
    "archive_metric_keys": f"WITH {_SAMPLES} SELECT DISTINCT path FROM samples",
    "archive_first_samples": f"WITH {_SAMPLES} SELECT file, chunk_no, path, value FROM samples WHERE sample_no = 0",
    "archive_increments": f"""WITH {_SAMPLES},
steps AS (SELECT *, value - lag(value) OVER (PARTITION BY file, chunk_no, path ORDER BY sample_no) AS inc FROM samples)
SELECT file, path, max(inc) AS max_inc, max(ts) FILTER (inc = most) AS max_ts
FROM (SELECT *, max(inc) OVER (PARTITION BY file, path) AS most FROM steps) WHERE inc > 0 GROUP BY file, path""",
    "stack_samples": f"""WITH {_EVENTS}
SELECT n // 20000 AS file, CAST(n AS DOUBLE) AS ts, CASE WHEN n % 1000 = 500 THEN 'main/dict/seven' ELSE 'main/' || event_type || '/u' || u END AS stack,
  CAST(k AS DOUBLE) AS weight, n % 1000 = 500 AS is_time FROM e""",
    "status_samples": f"""WITH {_EVENTS},
placed AS (SELECT *, n // 20000 AS file, row_number() OVER (PARTITION BY n // 20000 ORDER BY n) - 1 AS i FROM e)
SELECT file, CAST(i // 100 AS INT) AS chunk_no, CAST(i % 100 AS INT) AS sample_no, x.path AS path, stamp AS ts, x.value AS value
FROM (SELECT *, unnest([
  {{'path': 'serverStatus.a.b', 'value': k}}, {{'path': 'serverStatus.a.c', 'value': d}}, {{'path': 'serverStatus.up', 'value': 1}}]) AS x FROM placed)""",
}
