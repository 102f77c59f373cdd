"""The registered queries in SQL (DuckDB), over the same tables."""

from __future__ import annotations

HITS = """hits AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS TIMESTAMP) AS hit_ts, event_type AS service_name,
    '/' || event_type || '/' || CAST(k % 10 AS VARCHAR) AS endpoint,
    CASE WHEN k % 10 < 5 THEN 'GET' WHEN k % 10 < 7 THEN 'POST' WHEN k % 10 = 7 THEN 'PUT'
      WHEN k % 10 = 8 THEN 'PATCH' ELSE 'DELETE' END AS method,
    CASE WHEN event_type = 'error' THEN 500 WHEN k % 20 = 0 THEN 404 ELSE 200 END AS status_code,
    CAST(value AS DECIMAL(10,3)) AS latency_ms,
    lpad(CAST(user_id % 25 AS VARCHAR), 24, '0') AS client_id,
    'apim_' || CAST(user_id % 120 AS VARCHAR) AS key_value,
    '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS ip
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""

CLIENTS = """clients AS (
  SELECT lpad(CAST(n_nationkey AS VARCHAR), 24, '0') AS client_id, n_name AS name,
    lower(replace(n_name, ' ', '-')) AS slug, lower(n_name) || '@example.com' AS email, '' AS description,
    n_nationkey % 7 <> 6 AS is_active, CASE WHEN n_nationkey % 9 = 3 THEN 5 ELSE 30 END AS retention_days,
    CASE WHEN n_nationkey % 8 <> 5 THEN lpad(CAST(n_nationkey AS VARCHAR), 24, 'b') END AS created_by,
    TIMESTAMP '2023-01-01 00:00:00' + INTERVAL 1 DAY * n_nationkey AS created_at
  FROM nation)"""

KEYS = """api_keys AS (
  SELECT lpad(CAST(s_suppkey AS VARCHAR), 24, 'a') AS api_key_id, 'key-' || CAST(s_suppkey AS VARCHAR) AS key_id,
    'apim_' || CAST(s_suppkey AS VARCHAR) AS key_value, lpad(CAST(s_nationkey AS VARCHAR), 24, '0') AS client_id,
    s_name AS name, CASE WHEN s_suppkey % 13 = 5 THEN 'sandbox' ELSE 'production' END AS environment,
    s_acctbal >= 0 AS is_active, s_suppkey % 10 <> 3 AS can_ingest,
    '10.1.' || CAST(s_suppkey % 256 AS VARCHAR) || CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE '.0/16' END AS allowed_ip,
    CASE s_suppkey % 8 WHEN 0 THEN '*' WHEN 1 THEN 'ftp://example.com' ELSE 'https://example.com' END AS allowed_origin,
    repeat('t', CAST(s_suppkey % 60 AS BIGINT)) AS tag,
    lpad(CAST(s_suppkey * 20 AS VARCHAR), 24, 'b') AS created_by,
    TIMESTAMP '2023-06-01 00:00:00' + INTERVAL 1 DAY * CAST(s_suppkey AS INT) AS created_at,
    CASE WHEN s_suppkey % 5 = 1 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2025-01-01 00:00:00' END AS expires_at
  FROM supplier)"""

USERS = """users AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 24, 'b') AS user_id, lower(replace(c_name, '#', '_')) AS username,
    lower(replace(c_name, '#', '_')) || '@example.com' AS email,
    CASE WHEN c_custkey % 50 = 0 THEN 'super_admin' WHEN c_custkey % 5 = 0 THEN 'client_admin' ELSE 'client_viewer' END AS role,
    CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE lpad(CAST(c_nationkey AS VARCHAR), 24, '0') END AS client_id,
    c_custkey % 11 <> 0 AS can_view_analytics, c_acctbal >= 0 AS is_active
  FROM customer)"""

RAW_HITS = """raw_hits AS (
  SELECT event_id, CASE WHEN f = 5 THEN NULL ELSE service_name END AS service_name,
    CASE WHEN f = 9 THEN '' ELSE endpoint END AS endpoint,
    CASE f WHEN 0 THEN '' WHEN 6 THEN 'FETCH' WHEN 7 THEN lower(method) WHEN 9 THEN NULL ELSE method END AS method,
    CASE f WHEN 1 THEN 'abc' WHEN 2 THEN '99' WHEN 3 THEN '600' WHEN 10 THEN ' 200 ' WHEN 11 THEN '200d'
      ELSE CAST(status_code AS VARCHAR) END AS status_code,
    CASE f WHEN 4 THEN '-1' WHEN 8 THEN '' WHEN 12 THEN '1e2' ELSE CAST(latency_ms AS VARCHAR) END AS latency_ms,
    client_id, key_value, ip, hit_ts AS received_at
  FROM (SELECT *, CAST(event_id AS BIGINT) % 40 AS f FROM hits))"""

NUMBER = r"""CASE WHEN regexp_full_match({c}, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')
  THEN TRY_CAST(trim({c}) AS DOUBLE) END"""

VALIDATED = f"""validated AS (
  SELECT *, CASE
    WHEN absent <> '' THEN 'Missing required fields: ' || absent
    WHEN upper(method) NOT IN ('GET','POST','PUT','PATCH','DELETE','OPTIONS','HEAD')
      THEN 'Invalid HTTP methods: ' || method || ' '
    WHEN coalesce(NOT (status_no BETWEEN 100 AND 599), true) THEN 'Invalid Status code : ' || status_code || ' '
    WHEN coalesce(latency_no < 0, true) THEN 'Invalid latency : ' || latency_ms || ' ' END AS error
  FROM (SELECT *, concat_ws(',',
      CASE WHEN coalesce(service_name, '') = '' THEN 'serviceName' END,
      CASE WHEN coalesce(endpoint, '') = '' THEN 'endpoint' END,
      CASE WHEN coalesce(method, '') = '' THEN 'method' END,
      CASE WHEN coalesce(status_code, '') = '' THEN 'statusCode' END,
      CASE WHEN coalesce(latency_ms, '') = '' THEN 'latencyMs' END,
      CASE WHEN coalesce(client_id, '') = '' THEN 'clientId' END) AS absent,
    {NUMBER.format(c='status_code')} AS status_no, {NUMBER.format(c='latency_ms')} AS latency_no
    FROM raw_hits))"""

ENVELOPES = """envelopes AS (
  SELECT CASE WHEN n % 50 = 0 THEN '{bad'
      ELSE '{"type":"' || CASE WHEN n % 50 = 1 THEN 'OTHER' ELSE 'API_HIT' END || '","data":' ||
        CASE WHEN n % 50 = 2 THEN '[]' ELSE
        '{"eventId":"' || event_id || '","timestamp":"' || replace(CAST(hit_ts AS VARCHAR), ' ', 'T') ||
        'Z","serviceName":"' || service_name || '","endpoint":"' || endpoint || '","method":"' ||
        CASE WHEN n % 50 = 5 THEN lower(method) ELSE method END || '","statusCode":' || CAST(status_code AS VARCHAR) ||
        ',"latencyMs":' || CAST(latency_ms AS VARCHAR) || ',"clientId":"' ||
        CASE WHEN n % 50 = 4 THEN 'zzz' ELSE client_id END || '"' ||
        CASE WHEN n % 50 = 3 THEN '' ELSE ',"apiKeyId":"' || lpad(event_id, 24, 'c') || '"' END ||
        ',"ip":"' || ip || '","userAgent":""}' END || ',"attempt":' || CAST(attempt AS VARCHAR) || '}' END AS value,
    CASE WHEN n % 50 = 6 THEN NULL ELSE event_id END AS message_id,
    CASE WHEN n % 50 = 8 THEN 3 ELSE 0 END AS retry_count, n, attempt
  FROM (SELECT h.*, CAST(event_id AS BIGINT) AS n, 1 AS attempt FROM hits h
        UNION ALL
        SELECT h.*, CAST(event_id AS BIGINT) AS n, 2 AS attempt FROM hits h WHERE CAST(event_id AS BIGINT) % 50 = 7))"""

# A message parses when it is JSON, its type is the known one and its data an object.
PARSED = """typed AS (
  SELECT *, json_type(doc, '$.data') AS data_type, json_type(doc, '$.type') AS type_type,
    json_extract_string(doc, '$.type') AS type_text, json_extract(doc, '$.data') AS data
  FROM (SELECT *, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS doc FROM envelopes)),
parsed AS (
  SELECT *, CASE WHEN doc IS NULL THEN 'Message parsing failed: invalid JSON'
      WHEN issues <> '' THEN 'Message parsing failed: Schema validation failed: ' || issues END AS parse_error
  FROM (SELECT *, concat_ws(', ',
      CASE WHEN type_type IS NULL THEN 'Required'
        WHEN type_text <> 'API_HIT' THEN 'Invalid enum value. Expected ''API_HIT'', received ''' || type_text || '''' END,
      CASE WHEN data_type IS NULL THEN 'Required'
        WHEN data_type = 'ARRAY' THEN 'Expected object, received array'
        WHEN data_type <> 'OBJECT' THEN 'Expected object, received ' || lower(data_type) END) AS issues
    FROM typed)),
checked AS (
  SELECT n, attempt, value, retry_count, parse_error, coalesce(message_id, event_id) AS message_id, event_id, hit_ts,
    service_name, endpoint, method, status_code, latency_ms, client_id, api_key_id, ip, user_agent,
    CASE WHEN parse_error IS NULL AND problems <> '' THEN 'Storage check failed: ' || problems END AS store_error
  FROM (SELECT *, concat_ws(', ',
      CASE WHEN coalesce(event_id, '') = '' THEN 'eventId is required' END,
      CASE WHEN hit_ts IS NULL THEN 'timestamp is required' END,
      CASE WHEN coalesce(service_name, '') = '' THEN 'serviceName is required' END,
      CASE WHEN coalesce(endpoint, '') = '' THEN 'endpoint is required' END,
      CASE WHEN coalesce(method, '') = '' THEN 'method is required'
        WHEN method NOT IN ('GET','POST','PUT','PATCH','DELETE','OPTIONS','HEAD') THEN 'method is invalid' END,
      CASE WHEN status_code IS NULL THEN 'statusCode is required' END,
      CASE WHEN latency_ms IS NULL THEN 'latencyMs is required' END,
      CASE WHEN coalesce(client_id, '') = '' THEN 'clientId is required'
        WHEN NOT regexp_full_match(client_id, '[0-9a-fA-F]{24}') THEN 'clientId is invalid' END,
      CASE WHEN coalesce(api_key_id, '') = '' THEN 'apiKeyId is required'
        WHEN NOT regexp_full_match(api_key_id, '[0-9a-fA-F]{24}') THEN 'apiKeyId is invalid' END,
      CASE WHEN coalesce(ip, '') = '' THEN 'ip is required' END) AS problems
    FROM (SELECT n, attempt, value, retry_count, parse_error, message_id,
        CASE WHEN parse_error IS NULL THEN json_extract_string(data, '$.eventId') END AS event_id,
        CASE WHEN parse_error IS NULL THEN CAST(replace(replace(json_extract_string(data, '$.timestamp'), 'T', ' '), 'Z', '') AS TIMESTAMP) END AS hit_ts,
        CASE WHEN parse_error IS NULL THEN json_extract_string(data, '$.serviceName') END AS service_name,
        CASE WHEN parse_error IS NULL THEN json_extract_string(data, '$.endpoint') END AS endpoint,
        CASE WHEN parse_error IS NULL THEN json_extract_string(data, '$.method') END AS method,
        CASE WHEN parse_error IS NULL THEN CAST(json_extract_string(data, '$.statusCode') AS DOUBLE) END AS status_code,
        CASE WHEN parse_error IS NULL THEN CAST(json_extract_string(data, '$.latencyMs') AS DOUBLE) END AS latency_ms,
        CASE WHEN parse_error IS NULL THEN json_extract_string(data, '$.clientId') END AS client_id,
        CASE WHEN parse_error IS NULL THEN json_extract_string(data, '$.apiKeyId') END AS api_key_id,
        CASE WHEN parse_error IS NULL THEN json_extract_string(data, '$.ip') END AS ip,
        CASE WHEN parse_error IS NULL THEN coalesce(json_extract_string(data, '$.userAgent'), '') END AS user_agent
      FROM parsed)))"""

FIRST_SOUND = """first_sound AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY attempt, value) AS rank
    FROM checked WHERE parse_error IS NULL AND store_error IS NULL) WHERE rank = 1)"""

FAILURES = """failures AS (
  SELECT CAST(event_id AS VARCHAR) AS message_id,
    CASE event_id % 13 WHEN 0 THEN 'Channel closed by server' WHEN 1 THEN 'Connection closed: CONNECTION_FORCED'
      WHEN 2 THEN 'read ECONNRESET' WHEN 3 THEN 'connect failed' WHEN 4 THEN 'socket hang up'
      WHEN 5 THEN 'Buffer full, waiting for drain' WHEN 6 THEN 'Heartbeat timeout' WHEN 7 THEN 'Service not available'
      WHEN 8 THEN 'Server connection closed' WHEN 9 THEN 'getaddrinfo failed' WHEN 10 THEN 'E11000 duplicate key'
      WHEN 11 THEN 'Validation failed' END AS error_message,
    CASE event_id % 13 WHEN 2 THEN 'ECONNRESET' WHEN 3 THEN 'ECONNREFUSED' WHEN 4 THEN 'etimedout'
      WHEN 9 THEN 'ENOTFOUND' WHEN 10 THEN '11000' END AS error_code,
    CAST(user_id % 5 AS INT) AS retry_count, props AS value
  FROM events),
triaged AS (
  SELECT *, coalesce(upper(error_code) = 'ENOTFOUND', false)
      OR coalesce(regexp_matches(lower(error_message), 'channel closed|connection closed|econnreset|econnrefused|etimedout|buffer full|heartbeat timeout|not available'), false)
      OR coalesce(regexp_matches(upper(error_code), 'CHANNEL CLOSED|CONNECTION CLOSED|ECONNRESET|ECONNREFUSED|ETIMEDOUT|BUFFER FULL|HEARTBEAT TIMEOUT|NOT AVAILABLE'), false) AS transient
  FROM failures)"""


def half_up(numerator: str, denominator: str) -> str:
    """Two decimals from a quotient of whole numbers in hundredths, rounded half away from zero."""
    n, d = f"CAST({numerator} AS BIGINT)", f"CAST({denominator} AS BIGINT)"
    return f"(sign({n}) * ((abs({n}) * 2 + {d}) // ({d} * 2)) / 100.0)"


US = "CAST(latency_ms * 1000 AS BIGINT)"


def folded(grain: str = "hour", source: str = "hits", us: str = US) -> str:
    return f"""rollup AS (
  SELECT client_id, service_name, endpoint, method, date_trunc('{grain}', hit_ts) AS time_bucket,
    count(*) AS total_hits, CAST(sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS error_hits,
    CAST(sum({us}) AS BIGINT) AS latency_us, min({us}) AS min_us, max({us}) AS max_us
  FROM {source} GROUP BY ALL)"""


PRESENT = """SELECT client_id, service_name, endpoint, method, time_bucket, total_hits, error_hits,
  CAST(latency_us AS DOUBLE) / total_hits / 1000 AS avg_latency,
  min_us / 1000.0 AS min_latency, max_us / 1000.0 AS max_latency FROM rollup"""

SUMS = """CAST(coalesce(sum(total_hits), 0) AS BIGINT) AS total_hits,
  CAST(coalesce(sum(error_hits), 0) AS BIGINT) AS error_hits,
  CAST(coalesce(sum(total_hits) - sum(error_hits), 0) AS BIGINT) AS success_hits"""


def stats(where: str, start: str, end: str) -> str:
    return f"""SELECT {SUMS},
  CASE WHEN sum(total_hits) > 0 THEN {half_up('sum(error_hits) * 10000', 'sum(total_hits)')} ELSE 0.0 END AS error_rate,
  coalesce(CAST(sum(latency_us) AS DOUBLE) / CAST(sum(total_hits) AS DOUBLE) / 1000, 0.0) AS avg_latency,
  count(DISTINCT service_name) AS unique_services, count(DISTINCT endpoint) AS unique_endpoints,
  TIMESTAMP '{start}' AS range_start, TIMESTAMP '{end}' AS range_end
FROM rollup WHERE {where}"""


JANUARY = "time_bucket >= TIMESTAMP '2024-01-01 00:30:00' AND time_bucket <= TIMESTAMP '2024-01-31 00:00:00'"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def top(limit: int, where: str = "true") -> str:
    return f"""SELECT service_name, endpoint, method, CAST(sum(total_hits) AS BIGINT) AS total_hits,
  {half_up('sum(latency_us)', 'sum(total_hits) * 10')} AS avg_latency, CAST(sum(error_hits) AS BIGINT) AS error_hits,
  {half_up('sum(error_hits) * 10000', 'sum(total_hits)')} AS error_rate
FROM rollup WHERE {where} GROUP BY service_name, endpoint, method
ORDER BY 4 DESC, service_name, endpoint, method LIMIT {limit}"""


def series(limit: int, offset: int = 0, where: str = JANUARY) -> str:
    return f"""SELECT service_name, endpoint, method, CAST(sum(total_hits) AS BIGINT) AS total_hits,
  CAST(sum(error_hits) AS BIGINT) AS error_hits, {half_up('sum(latency_us)', 'sum(total_hits) * 10')} AS avg_latency,
  {half_up('min(min_us)', '10')} AS min_latency, {half_up('max(max_us)', '10')} AS max_latency, time_bucket
FROM rollup WHERE {where} GROUP BY service_name, endpoint, method, time_bucket
ORDER BY time_bucket DESC, service_name, endpoint, method LIMIT {limit} OFFSET {offset}"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


DASHBOARD = f"""SELECT s.*,
  (SELECT string_agg(service_name || ' ' || endpoint || ' ' || method || ' ' || CAST(total_hits AS VARCHAR) || ' ' ||
      printf('%.2f', avg_latency) || ' ' || CAST(error_hits AS VARCHAR) || ' ' || printf('%.2f', error_rate),
      '; ' ORDER BY total_hits DESC, service_name, endpoint, method)
   FROM ({top(5, "time_bucket >= TIMESTAMP '2024-01-01 00:30:00'")})) AS top_endpoints,
  (SELECT string_agg(service_name || ' ' || endpoint || ' ' || method || ' ' || CAST(total_hits AS VARCHAR) || ' ' ||
      CAST(error_hits AS VARCHAR) || ' ' || printf('%.2f', avg_latency) || ' ' || printf('%.2f', min_latency) || ' ' ||
      printf('%.2f', max_latency) || ' ' || strftime(time_bucket, '%Y-%m-%d %H:%M'),
      '; ' ORDER BY time_bucket DESC, service_name, endpoint, method)
   FROM ({series(24)})) AS recent_activity
FROM ({stats(JANUARY, '2024-01-01 00:30:00', '2024-01-31 00:00:00')}) s"""

SCOPED = """scoped AS (
  SELECT user_id, CASE
      WHEN role = 'super_admin' THEN NULL
      WHEN NOT can_view_analytics THEN 'Insufficient permissions to view analytics'
      WHEN u.client_id IS NULL THEN 'Access denied - no client association'
      WHEN NOT regexp_full_match(u.client_id, '[0-9a-fA-F]{24}') THEN 'Invalid client association'
      WHEN c.client_id IS NULL THEN 'Client not found' END AS scope_error,
    CASE WHEN role = 'super_admin' THEN '*' ELSE u.client_id END AS wanted
  FROM users u LEFT JOIN clients c ON u.client_id = c.client_id)"""

ENTITLED = f"""per_scope AS (
  SELECT scope, CAST(sum(total_hits) AS BIGINT) AS total_hits, CAST(sum(error_hits) AS BIGINT) AS error_hits,
    CAST(sum(latency_us) AS BIGINT) AS latency_us, count(DISTINCT service_name) AS unique_services,
    count(DISTINCT endpoint) AS unique_endpoints
  FROM (SELECT client_id AS scope, * FROM rollup UNION ALL SELECT '*' AS scope, * FROM rollup) WHERE {JANUARY}
  GROUP BY scope)
SELECT user_id, wanted AS scope, coalesce(total_hits, 0) AS total_hits, coalesce(error_hits, 0) AS error_hits,
  coalesce(total_hits - error_hits, 0) AS success_hits,
  coalesce({half_up('error_hits * 10000', 'total_hits')}, 0.0) AS error_rate,
  coalesce(CAST(latency_us AS DOUBLE) / total_hits / 1000, 0.0) AS avg_latency,
  coalesce(unique_services, 0) AS unique_services, coalesce(unique_endpoints, 0) AS unique_endpoints
FROM scoped LEFT JOIN per_scope ON scope = wanted WHERE scope_error IS NULL"""

ADMITTED = """SELECT h.event_id, k.client_id, k.api_key_id,
  CASE WHEN coalesce(h.key_value, '') = '' THEN 'API key is required'
    WHEN k.api_key_id IS NULL OR c.client_id IS NULL OR k.expires_at < h.received_at THEN 'Invalid API key'
    WHEN NOT c.is_active THEN 'Client account is inactive'
    WHEN NOT k.can_ingest THEN 'API key does not have ingest permissions' END AS reject_reason
FROM {source} h LEFT JOIN (SELECT * FROM api_keys WHERE is_active) k ON h.key_value = k.key_value
  LEFT JOIN clients c ON k.client_id = c.client_id"""

# Six-hour windows aligned to the epoch, two requests each.
WINDOW = "epoch_us({ts}) // 21600000000"


def runs_sql(keys: str, order: str, time: str, source: str) -> str:
    return f"""SELECT {keys}, count(*) AS failures, min({time}) AS started_at, max({time}) AS ended_at,
  count(*) >= 10 AS poison
FROM (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY {order}
    ROWS UNBOUNDED PRECEDING) AS island FROM ({source}))
WHERE failed GROUP BY {keys}, island"""


def audit_rules(table: str, row_id: str, rules: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, {row_id} AS row_id, '{rule}' AS rule FROM {table} WHERE {condition}"
        for rule, condition in rules.items())


AUDIT = "\nUNION ALL\n".join([
    audit_rules("clients", "client_id", {
        "name is required": "coalesce(name, '') = ''",
        "name length must be 3 to 100": "length(trim(name)) NOT BETWEEN 3 AND 100",
        "slug is required": "coalesce(slug, '') = ''",
        "slug has an invalid format": "NOT regexp_matches(slug, '^[a-z0-9-]+$')",
        "email is required": "coalesce(email, '') = ''",
        "created_by is required": "coalesce(created_by, '') = ''",
        "description is longer than 500": "length(description) > 500",
        "retention must be 7 to 365 days": "retention_days NOT BETWEEN 7 AND 365",
    }),
    audit_rules("api_keys", "api_key_id", {
        "name is required": "coalesce(name, '') = ''",
        "name is longer than 100": "length(name) > 100",
        "environment is unknown": "environment NOT IN ('production','staging','development','testing')",
        "allowed address has an invalid format":
            r"NOT regexp_matches(allowed_ip, '^(\d{1,3}\.){3}\d{1,3}(/\d{1,2})?$')",
        "allowed origin has an invalid format":
            r"NOT (regexp_matches(allowed_origin, '^https?://\S+$') OR allowed_origin = '*')",
        "tag is longer than 50": "length(tag) > 50",
    }),
    audit_rules("users", "user_id", {
        "username is shorter than 3": "length(trim(username)) < 3",
        "username has an invalid format": "NOT regexp_matches(username, '^[a-zA-Z0-9_.-]+$')",
        "email has an invalid format": r"NOT regexp_matches(email, '^[^\s@]+@[^\s@]+\.[^\s@]+$')",
        "role is unknown": "role NOT IN ('super_admin','client_admin','client_viewer')",
        "role needs a client": "role <> 'super_admin' AND client_id IS NULL",
    }),
])

DUPLICATES = "\nUNION ALL\n".join(
    f"SELECT '{table}' AS table_name, '{field}' AS field, {shown} AS value, count(*) AS copies "
    f"FROM {source} GROUP BY {column} HAVING count(*) > 1"
    for table, field, shown, column, source in [
        ("clients", "slug", "lower(c_mktsegment)", "lower(c_mktsegment)", "customer"),
        ("api_keys", "key_id", "p_brand || '/' || p_type", "p_brand || '/' || p_type", "part"),
        ("users", "username", "'user_' || CAST(user_id AS VARCHAR)", "'user_' || CAST(user_id AS VARCHAR)", "events"),
        ("users", "email", "event_type || '@example.com'", "event_type || '@example.com'", "events"),
    ])

SLUG = r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(
  lower(' - ' || p_name || '  & ' || p_brand || ' (' || p_type || ') -'),
  '[^a-z0-9\s-]', '', 'g'), '[\s-]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part"""

STORED_COLUMNS = """event_id, hit_ts, service_name, endpoint, method, status_code, latency_ms, client_id, api_key_id,
  ip, user_agent"""


def statements() -> dict[str, str]:
    hourly = (HITS, folded())
    messages = (HITS, ENVELOPES, PARSED)
    sound = (*messages, FIRST_SOUND)
    # Latency comes back from JSON as a double.
    stored_us = "CAST(round(latency_ms * 1000) AS BIGINT)"
    dead_reason = """CASE WHEN parse_error IS NULL AND retry_count >= 3 THEN 'MAX_RETRIES_EXCEEDED'
    ELSE 'NON_RETRYABLE' END"""
    return {
        "top_endpoints": with_(*hourly, select=top(10)),
        "overall_stats": with_(*hourly, select=stats(JANUARY, "2024-01-01 00:30:00", "2024-01-31 00:00:00")),
        "overall_stats_last_day": with_(*hourly, select=stats(
            "time_bucket >= TIMESTAMP '2024-01-30 00:00:00' AND time_bucket <= TIMESTAMP '2024-01-31 00:00:00'",
            "2024-01-30 00:00:00", "2024-01-31 00:00:00")),
        "time_series": with_(*hourly, select=series(24, 5)),
        "time_series_endpoint": with_(*hourly, select=series(1000, where=JANUARY + (
            " AND client_id = '000000000000000000000008' AND service_name = 'error' AND endpoint = '/error/9'"))),
        "dashboard": with_(*hourly, select=DASHBOARD),
        "settled_dashboard": with_(*hourly, select=f"""SELECT * EXCLUDE (recent_activity), CAST(NULL AS VARCHAR) AS recent_activity,
  'recent_activity' AS failed FROM ({DASHBOARD})"""),
        "entitled_stats": with_(HITS, folded(), USERS, CLIENTS, SCOPED, ENTITLED.split("\nSELECT user_id", 1)[0],
                                select="SELECT user_id" + ENTITLED.split("\nSELECT user_id", 1)[1]),
        "tenant_scope": with_(USERS, CLIENTS, SCOPED, select="""SELECT user_id,
  CASE WHEN scope_error IS NULL THEN wanted END AS scope, scope_error FROM scoped"""),
        "rollup_minute": with_(HITS, folded("minute"), select=PRESENT),
        "rollup_hour": with_(*hourly, select=PRESENT),
        "rollup_day": with_(HITS, folded("day"), select=PRESENT),
        "rollup_merge": with_(*hourly, select=PRESENT),
        "rollup_rejects": """SELECT CAST(doc_id AS VARCHAR) AS event_id, concat_ws(', ',
    CASE WHEN length(source) > 255 THEN 'service_name is longer than 255' END,
    CASE WHEN length(text) > 500 THEN 'endpoint is longer than 500' END,
    CASE WHEN length(lang) > 24 THEN 'client_id is longer than 24' END,
    CASE WHEN n_chars * 2000 >= 10000000 THEN 'latency_ms is out of range' END) AS reject_reason
FROM documents WHERE length(source) > 255 OR length(text) > 500 OR length(lang) > 24 OR n_chars * 2000 >= 10000000""",
        "admit_hits": with_(HITS, CLIENTS, KEYS, "received AS (SELECT *, hit_ts AS received_at FROM hits)",
                            select=ADMITTED.format(source="received")),
        "validate_hits": with_(HITS, RAW_HITS, VALIDATED, select="SELECT event_id, error FROM validated"),
        "normalise_hits": with_(HITS, RAW_HITS, VALIDATED, select="""SELECT event_id, received_at AS hit_ts, service_name,
  endpoint, upper(method) AS method, status_no AS status_code, latency_no AS latency_ms, client_id, ip,
  '' AS user_agent FROM validated WHERE error IS NULL"""),
        "quota_flags": with_(HITS, select=f"""SELECT event_id, ip, row_number() OVER (
  PARTITION BY ip, {WINDOW.format(ts='hit_ts')} ORDER BY hit_ts, event_id) > 2 AS over_quota FROM hits"""),
        "admission_outcomes": with_(
            HITS, RAW_HITS, VALIDATED, CLIENTS, KEYS,
            f"admitted AS ({ADMITTED.format(source='raw_hits')})",
            f"""ranked AS (SELECT h.event_id, row_number() OVER (
    PARTITION BY ip, {WINDOW.format(ts='received_at')} ORDER BY received_at, h.event_id) AS rank
  FROM raw_hits h JOIN admitted a ON h.event_id = a.event_id WHERE a.reject_reason IS NULL)""",
            select="""SELECT a.event_id, CASE WHEN a.reject_reason IS NOT NULL THEN a.reject_reason
    WHEN r.rank > 2 THEN 'Too many requests, please try again later' ELSE v.error END AS reject_reason
FROM admitted a LEFT JOIN ranked r ON a.event_id = r.event_id JOIN validated v ON a.event_id = v.event_id"""),
        "publish_messages": with_(HITS, select="""SELECT event_id, hit_ts, service_name, endpoint, method,
  CAST(status_code AS DOUBLE) AS status_code, CAST(latency_ms AS DOUBLE) AS latency_ms, client_id,
  lpad(event_id, 24, 'c') AS api_key_id, ip, '' AS user_agent, 'STORE' AS outcome FROM hits"""),
        "parse_envelope": with_(*messages, select="SELECT n, attempt, message_id, parse_error FROM checked"),
        "store_check": with_(*messages, select="""SELECT n, attempt, event_id, hit_ts, store_error FROM checked
WHERE parse_error IS NULL"""),
        "dedup_hits": with_(*sound, select="""SELECT event_id, n, attempt FROM first_sound WHERE event_id NOT IN (
  SELECT event_id FROM hits WHERE hit_ts < TIMESTAMP '2024-01-10 00:00:00')"""),
        "raw_store": with_(*sound, select=f"SELECT {STORED_COLUMNS} FROM first_sound"),
        "dead_letters": with_(*messages, select=f"""SELECT value, message_id, retry_count,
  CAST(NULL AS VARCHAR) AS error_message, CAST(NULL AS VARCHAR) AS error_code, {dead_reason} AS dead_reason,
  coalesce(parse_error, store_error) AS dead_error, {NOW} AS dead_at, 'api_hits' AS original_queue
FROM checked WHERE coalesce(parse_error, store_error) IS NOT NULL"""),
        "triage_failures": with_(FAILURES, select="""SELECT message_id,
  CASE WHEN transient AND retry_count < 3 THEN 'RETRY' ELSE 'DLQ' END AS outcome,
  CASE WHEN retry_count >= 3 THEN 'MAX_RETRIES_EXCEEDED' WHEN NOT transient THEN 'NON_RETRYABLE' END AS dead_reason
FROM triaged"""),
        "retry_queue": with_(FAILURES, select=f"""SELECT value, message_id, retry_count + 1 AS retry_count,
  {NOW} AS retry_at, {NOW} + INTERVAL 1 MILLISECOND * CAST(least(1000 * 2 ** retry_count, 30000) AS BIGINT) AS due_at,
  'api_hits' AS original_queue FROM triaged WHERE transient AND retry_count < 3"""),
        "batch_outcomes": with_(*sound, select="""SELECT (SELECT count(*) FROM first_sound) AS processed,
  count(*) FILTER (WHERE coalesce(parse_error, store_error) IS NULL) - (SELECT count(*) FROM first_sound) AS duplicates,
  count(*) FILTER (WHERE coalesce(parse_error, store_error) IS NOT NULL) AS failed, CAST(0 AS BIGINT) AS retried,
  count(*) FILTER (WHERE coalesce(parse_error, store_error) IS NOT NULL) AS dead_lettered,
  (SELECT max(hit_ts) FROM first_sound) AS last_hit FROM checked"""),
        "stream_ingest": with_(*sound, folded(source="first_sound", us=stored_us), select=PRESENT),
        "upkeep": with_(*sound, select="""SELECT strftime(hit_ts, '%Y-%m-%d') AS day,
  count(*) FILTER (WHERE hit_ts >= TIMESTAMP '2024-01-16 00:00:00') AS raw_hits, count(*) AS rollup_hits
FROM first_sound GROUP BY 1"""),
        "ingest_batches": with_(*sound, select="""SELECT strftime(hit_ts, '%Y-%m-%d') AS day,
  count(*) FILTER (WHERE hit_ts >= TIMESTAMP '2024-01-16 00:00:00') AS raw_hits, count(*) AS rollup_hits
FROM first_sound GROUP BY 1"""),
        "rerun_batches": with_(*sound, select="""SELECT strftime(hit_ts, '%Y-%m-%d') AS day, count(*) AS raw_hits,
  count(*) AS rollup_hits FROM first_sound GROUP BY 1"""),
        "batch_runs": with_(*sound, select=runs_sql(
            "client_id, service_name, endpoint", "hit_ts, event_id", "hit_ts",
            "SELECT *, status_code >= 400 AS failed FROM first_sound")),
        "number_texts": """SELECT CAST(event_id AS VARCHAR) AS event_id,
  CASE WHEN event_id % 50 = 0 THEN 2305843009213693952.0 ELSE CAST(event_id AS DOUBLE) END AS number FROM events""",
        "epoch_numbers": "SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_ms(event_id % 10000) AS hit_ts FROM events",
        "failure_runs": with_(HITS, select=runs_sql(
            "client_id, service_name, endpoint", "hit_ts, event_id", "hit_ts",
            "SELECT *, status_code >= 400 AS failed FROM hits")),
        "poison_runs": with_(*messages, select=runs_sql(
            "event_type", "n, attempt", "n",
            """SELECT *, coalesce(parse_error, store_error) IS NOT NULL AS failed,
      CASE WHEN parse_error IS NULL THEN 'API_HIT' ELSE 'unknown' END AS event_type FROM checked""")),
        "raw_find": with_(HITS, select="""SELECT * FROM hits WHERE status_code >= 400
ORDER BY hit_ts DESC, event_id LIMIT 100 OFFSET 10"""),
        "raw_count": with_(HITS, select="SELECT count(*) AS hits FROM hits WHERE status_code >= 400"),
        "retention_keep": with_(HITS, select="""SELECT event_id, hit_ts FROM hits
WHERE hit_ts >= TIMESTAMP '2024-01-16 00:00:00'"""),
        "retention_count": with_(HITS, select="""SELECT count(*) AS hits FROM hits
WHERE hit_ts < TIMESTAMP '2024-01-16 00:00:00'"""),
        "clients_list": with_(CLIENTS, select="""SELECT * FROM clients WHERE is_active
ORDER BY created_at DESC, client_id LIMIT 50"""),
        "client_by_slug": with_(CLIENTS, select="SELECT * FROM clients WHERE slug = 'nation_7'"),
        "key_owners": with_(HITS, KEYS, select="""SELECT api_key_id, client_id, name FROM api_keys
WHERE key_value IN (SELECT key_value FROM hits)"""),
        "users_active": with_(USERS, select="SELECT * FROM users WHERE is_active"),
        "keys_with_creator": with_(KEYS, USERS, select="""SELECT api_key_id, key_id, k.client_id, name, environment,
  k.is_active, created_at, coalesce(user_id, '') AS creator_id, coalesce(username, '') AS creator_name,
  coalesce(email, '') AS creator_email FROM api_keys k LEFT JOIN users u ON k.created_by = u.user_id"""),
        "keys_per_client": with_(CLIENTS, KEYS, select="""SELECT c.client_id, count(k.api_key_id) AS keys,
  count(*) FILTER (WHERE k.is_active) AS active_keys
FROM clients c LEFT JOIN api_keys k ON c.client_id = k.client_id GROUP BY c.client_id"""),
        "registry_counts": """SELECT 'clients' AS collection, count(*) AS documents FROM nation
UNION ALL SELECT 'api_keys', count(*) FROM supplier UNION ALL SELECT 'users', count(*) FROM customer""",
        "keys_live": with_(KEYS, select=f"SELECT api_key_id, key_id, expires_at FROM api_keys WHERE expires_at > {NOW}"),
        "key_expiry": with_(KEYS, select="""SELECT api_key_id, created_at + INTERVAL 365 DAY AS expires_at,
  created_at + INTERVAL 365 DAY < TIMESTAMP '2024-06-15 00:00:00' AS expired FROM api_keys"""),
        "role_permissions": with_(USERS, select="""SELECT user_id, role, role <> 'client_viewer' AS can_create_api_keys,
  role <> 'client_viewer' AS can_manage_users, true AS can_view_analytics, role <> 'client_viewer' AS can_export_data
FROM users"""),
        "slugs": SLUG,
        "registry_audit": with_(CLIENTS, KEYS, USERS, select=AUDIT),
        "registry_duplicates": DUPLICATES,
        "catalog_search": """SELECT doc_id, source AS author, lang, n_chars FROM documents
WHERE contains(lower(source), 'src1') AND contains(lower(text), 'the')
  AND len(list_filter(string_split(text, ' '), lambda t: contains(lower(t), 'the'))) > 0
ORDER BY doc_id LIMIT 10""",
        "parent_child_counts": """SELECT coalesce(o_orderkey, l_orderkey) AS post_id, count(l_orderkey) AS children,
  CASE WHEN o_orderkey IS NULL THEN 'Post not found' END AS error
FROM orders FULL JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, l_orderkey""",
        "parent_children": """SELECT o_orderkey AS post_id, l_linenumber AS comment_id, l_returnflag AS content,
  o_orderpriority AS title, count(*) OVER (PARTITION BY l_orderkey) AS total
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    }
