"""Declared schemas; nothing is inferred."""

from pyspark.sql import types as T

# Contract constants of the data model.
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD"]
ENVIRONMENTS = ["production", "staging", "development", "testing"]
SUPER_ADMIN, CLIENT_ADMIN, CLIENT_VIEWER = "super_admin", "client_admin", "client_viewer"
ROLES = [SUPER_ADMIN, CLIENT_ADMIN, CLIENT_VIEWER]
EVENT_TYPE = "API_HIT"
DEFAULT_QUEUE = "api_hits"
MAX_RETRIES = 3
RETENTION_DAYS = 30
KEY_EXPIRY_DAYS = 365
QUOTA_REQUESTS = 1000
QUOTA_WINDOW_SECONDS = 900
POISON_THRESHOLD = 10
RETRY_BASE_MS, RETRY_CAP_MS = 1000, 30_000
LAST_EPOCH_MS = 8_640_000_000_000_000  # last instant of the date type of the message producers
OBJECT_ID = "^[0-9a-fA-F]{24}$"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_S, _L, _I, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType())

# A request report as it arrives: numbers may be text, so everything is text.
RAW_HIT = _struct(
    service_name=_S, endpoint=_S, method=_S, status_code=_S, latency_ms=_S,
    key_value=_S, ip=_S, user_agent=_S, received_at=_TS, event_id=_S)

# A queue message: the body plus its broker properties. `error_*` carry a delivery failure
# reported for an earlier attempt.
MESSAGE = _struct(
    value=_S, message_id=_S, retry_count=_I, error_message=_S, error_code=_S)

HIT = _struct(
    event_id=_S, hit_ts=_TS, service_name=_S, endpoint=_S, method=_S, status_code=_D,
    latency_ms=_D, client_id=_S, api_key_id=_S, ip=_S, user_agent=_S)

STORED_HIT = T.StructType(HIT.fields + _struct(stored_at=_TS, hit_date=T.DateType()).fields)

ROLLUP_KEY = ["client_id", "service_name", "endpoint", "method", "time_bucket"]

# Latency is kept in whole microseconds (three decimals of a millisecond): sums stay exact, whatever
# the order of merging.
ROLLUP = _struct(
    client_id=_S, service_name=_S, endpoint=_S, method=_S, time_bucket=_TS,
    total_hits=_L, error_hits=_L, latency_us=_L, min_latency_us=_L, max_latency_us=_L)

STORED_ROLLUP = T.StructType(ROLLUP.fields + _struct(updated_at=_TS, bucket_date=T.DateType()).fields)

ROLLUP_REJECT = T.StructType(HIT.fields + _struct(reject_reason=_S).fields)

DEAD_LETTER = T.StructType(MESSAGE.fields + _struct(
    dead_reason=_S, dead_error=_S, dead_at=_TS, original_queue=_S).fields)

RETRY = T.StructType(MESSAGE.fields + _struct(retry_at=_TS, due_at=_TS, original_queue=_S).fields)

# Everything a batch makes of its messages, by outcome: stored hits, retries and dead letters.
OUTCOME = T.StructType(
    HIT.fields + _struct(stored_at=_TS, reject_reason=_S).fields + MESSAGE.fields
    + _struct(dead_reason=_S, dead_error=_S, dead_at=_TS, retry_at=_TS, due_at=_TS, original_queue=_S).fields
    + _struct(batch_id=_L, outcome=_S, hit_date=T.DateType()).fields)

BATCH_STATS = _struct(
    processed=_L, duplicates=_L, failed=_L, retried=_L, dead_lettered=_L, rollup_rejected=_L, expired=_L,
    last_processed_at=_TS, batch_id=_L)

# One maximal stretch of failures inside one chunk of a key's timeline.
RUN_SEGMENT = _struct(
    client_id=_S, service_name=_S, endpoint=_S, chunk=_L, island=_L, closed=_B,
    failures=_L, started_at=_TS, ended_at=_TS, batch_id=_L)
