"""Queue messages: building, parsing, checking and routing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times, values
from ..functions.staging import computed_once
from ..schema import EVENT_TYPE, HTTP_METHODS, MAX_RETRIES, RETRY_BASE_MS, RETRY_CAP_MS

STORE, RETRY, DEAD = "STORE", "RETRY", "DLQ"
EXHAUSTED, NON_RETRYABLE = "MAX_RETRIES_EXCEEDED", "NON_RETRYABLE"

# Texts that mark a failure as transient.
TRANSIENT = [
    "channel closed",
    "connection closed",
    "ECONNRESET",
    "ECONNREFUSED",
    "ETIMEDOUT",
    "buffer full",
    "heartbeat timeout",
    "not available",
    "server connection closed",
]


def to_messages(hits: DataFrame, published_at: Column | None = None, attempt: int = 1) -> DataFrame:
    """Queue messages for typed hits; the message id is the event id."""
    def iso(c: Column) -> Column:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    data = F.struct(
        F.col("event_id").alias("eventId"), iso(F.col("hit_ts")).alias("timestamp"),
        F.col("service_name").alias("serviceName"), "endpoint", "method",
        F.col("status_code").alias("statusCode"), F.col("latency_ms").alias("latencyMs"),
        F.col("client_id").alias("clientId"), F.col("api_key_id").alias("apiKeyId"),
        "ip", F.col("user_agent").alias("userAgent"))
    body = F.struct(
        F.lit(EVENT_TYPE).alias("type"), data.alias("data"),
        iso(F.col("hit_ts") if published_at is None else published_at).alias("publishedAt"),
        F.lit(attempt).alias("attempt"))
    return hits.select(
        F.to_json(body).alias("value"), F.col("event_id").alias("message_id"), F.lit(0).alias("retry_count"))


# Event field of each hit column.
EVENT_FIELDS = {
    "event_id": "eventId",
    "hit_ts": "timestamp",
    "service_name": "serviceName",
    "endpoint": "endpoint",
    "method": "method",
    "status_code": "statusCode",
    "latency_ms": "latencyMs",
    "client_id": "clientId",
    "api_key_id": "apiKeyId",
    "ip": "ip",
    "user_agent": "userAgent",
}

# Texts of all fields come from one pass over the message. Where the JSON type matters, the field is a variant.
_EVENT = ", ".join(f"{name}: STRING" for name in EVENT_FIELDS.values())
_BODY = (
    f"type VARIANT, data STRUCT<{_EVENT}>, messageId VARIANT, timestamp VARIANT, publishedAt STRING, attempt STRING, "
    "_corrupt_record STRING")
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def _stands_alone(text: Column) -> Column:
    """Whether nothing follows the first JSON value of the text.

    JSON readers stop after the first value. The text's own hash, appended as a second array element, is found in its
    place only if the text is one value.
    """
    mark = F.xxhash64(text).cast("string")
    pair = F.concat(F.lit("["), text, F.lit(","), mark, F.lit("]"))
    return F.coalesce(F.get_json_object(pair, "$[1]") == mark, F.lit(False))


def _part(doc: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(doc, path, as_type)


def _shape(doc: Column, path: str) -> Column:
    return F.schema_of_variant(_part(doc, path))


def json_type(shape: Column) -> Column:
    """Script-style type name (object, array, string, number, boolean, null) of a variant's schema text."""
    return (
        F.when(shape.startswith("OBJECT<"), "object")
        .when(shape.startswith("ARRAY<"), "array")
        .when(shape == "STRING", "string")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "VOID", "null")
        .when(shape.isNotNull(), "number")
    )


def _schema_issues() -> Column:
    """Joined issue texts of the envelope schema, in field order; empty when it fits."""
    type_text, kind, data = F.col("_type"), F.col("_type_kind"), F.col("_data_kind")
    issues = F.concat_ws(
        ", ",
        F.when(kind.isNull(), "Required")
        .when(kind != "string", F.concat(F.lit(f"Expected '{EVENT_TYPE}', received "), kind))
        .when(type_text != EVENT_TYPE,
              F.concat(F.lit(f"Invalid enum value. Expected '{EVENT_TYPE}', received '"), type_text, F.lit("'"))),
        F.when(data.isNull(), "Required").when(data != "object", F.concat(F.lit("Expected object, received "), data)),
        F.when(F.col("_id_kind") != "string", F.concat(F.lit("Expected string, received "), "_id_kind")),
        F.when(~F.col("_time_kind").isin("string", "number"), "Invalid input"),
    )
    top = F.col("_doc_kind")
    return F.when(top != "object", F.concat(F.lit("Expected object, received "), top)).otherwise(issues)


def _sound() -> Column:
    """Whether a message fits the envelope schema, from its one-pass reading."""
    body = F.col("_body")

    def absent_or(field: str, *shapes: str) -> Column:
        return F.when(body[field].isNull(), True).otherwise(
            F.schema_of_variant(body[field]).rlike(f"^({'|'.join(shapes)})"))

    fits = (
        F.col("_alone") & body["_corrupt_record"].isNull() & body["data"].isNotNull()
        & (F.try_variant_get(body["type"], "$", "string") == EVENT_TYPE)
        & absent_or("messageId", "STRING")
        & absent_or("timestamp", "STRING", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"))
    return F.coalesce(fits, F.lit(False))


def parse(messages: DataFrame) -> DataFrame:
    """Adds `data` (struct of the event's texts), `publish_order` (published_at, attempt), `parse_error` and a resolved
    `message_id`, which falls back to the body's, then to the event id.

    Only messages that do not fit the schema are looked at again for the reason.
    """
    value, body, doc = F.col("value"), F.col("_body"), F.col("_doc")
    read = computed_once(messages, {"_body": F.from_json(value, _BODY, _STRICT), "_alone": _stands_alone(value)})
    judged = computed_once(read, {"_sound": _sound()})
    documents = computed_once(judged, {
        "_doc": F.when(F.col("_sound"), F.lit(None)).when(F.col("_alone"), F.try_parse_json(value))})
    kinds = computed_once(documents, {
        "_type": _part(doc, "$.type", "string"),
        "_doc_kind": json_type(F.schema_of_variant(doc)),
        "_type_kind": json_type(_shape(doc, "$.type")),
        "_data_kind": json_type(_shape(doc, "$.data")),
        "_id_kind": json_type(_shape(doc, "$.messageId")),
        "_time_kind": json_type(_shape(doc, "$.timestamp")),
    })
    error = F.when(~F.col("_sound"), F.when(doc.isNull(), "Message parsing failed: invalid JSON").otherwise(
        F.concat(F.lit("Message parsing failed: Schema validation failed: "), _schema_issues())))
    parsed = computed_once(kinds, {
        "parse_error": error,
        "data": F.when(F.col("_sound"), body["data"]),
        "_resolved_id": F.coalesce(
            "message_id",
            F.when(F.col("_sound"), F.coalesce(
                F.try_variant_get(body["messageId"], "$", "string"), body["data"]["eventId"]))),
        "publish_order": F.struct(
            times.instant_from_text(body["publishedAt"]).alias("published_at"),
            body["attempt"].try_cast("int").alias("attempt")),
    })
    return parsed.select(
        *[F.col("_resolved_id").alias("message_id") if c == "message_id" else F.col(c) for c in messages.columns],
        "parse_error", "data", "publish_order")


def _typed() -> dict[str, Column]:
    """Hit columns from the event fields' texts; values that do not fit are null."""
    def field(column: str) -> Column:
        return F.col("data")[EVENT_FIELDS[column]]

    def json_shape(column: str) -> Column:
        return _shape(F.try_parse_json("value"), f"$.data.{EVENT_FIELDS[column]}")

    def text(column: str) -> Column:
        # Objects and arrays come as JSON text; only a text that looks like one is asked for its type.
        t = field(column)
        looks_nested = t.startswith("{") | t.startswith("[")
        return F.when(looks_nested, F.when(~json_shape(column).rlike("^(OBJECT|ARRAY)<"), t)).otherwise(t)

    def number(column: str) -> Column:
        return F.when(field(column) != "", values.to_number(field(column)))

    # A text of digits is no date: epoch milliseconds must be a JSON number.
    stamp = field("hit_ts")
    epoch = F.when(json_shape("hit_ts") != "STRING", times.instant_from_epoch_ms(stamp.try_cast("double")))
    return {
        "event_id": text("event_id"),
        "hit_ts": F.when(stamp.rlike("^[0-9]{4}$"), F.coalesce(epoch, times.instant_from_text(stamp)))
        .when(stamp.rlike(times.ISO_START), times.instant_from_text(stamp))
        .when(stamp.rlike(r"^-?[0-9]"), epoch),
        "service_name": text("service_name"),
        "endpoint": text("endpoint"),
        "method": text("method"),
        "status_code": number("status_code"),
        "latency_ms": number("latency_ms"),
        "client_id": text("client_id"),
        "api_key_id": text("api_key_id"),
        "ip": text("ip"),
        "user_agent": F.coalesce(text("user_agent"), F.lit("")),
    }


def _storage_problems() -> Column:
    """What keeps a typed event out of the raw table; empty when it can be stored."""
    def problem(column: str, bad: Column | None = None) -> Column:
        name, c = EVENT_FIELDS[column], F.col(column)
        absent = c.isNull() if column in ("hit_ts", "status_code", "latency_ms") else values.missing(c)
        required = F.when(absent, F.lit(f"{name} is required"))
        return required if bad is None else required.when(bad, F.lit(f"{name} is invalid"))

    return F.concat_ws(
        ", ",
        problem("event_id"),
        problem("hit_ts"),
        problem("service_name"),
        problem("endpoint"),
        problem("method", ~F.col("method").isin(HTTP_METHODS)),
        problem("status_code"),
        problem("latency_ms"),
        problem("client_id", ~values.is_object_id(F.col("client_id"))),
        problem("api_key_id", ~values.is_object_id(F.col("api_key_id"))),
        problem("ip"),
    )


def check_storage(parsed: DataFrame) -> DataFrame:
    """Adds the typed hit columns and `store_error` for messages that parsed."""
    typed = computed_once(parsed, _typed()).drop("data")
    judged = computed_once(typed, {"_problems": _storage_problems()})
    broken = F.col("parse_error").isNull() & (F.col("_problems") != "")
    return judged.withColumn(
        "store_error", F.when(broken, F.concat(F.lit("Storage check failed: "), "_problems"))).drop("_problems")


def is_transient(message: Column, code: Column) -> Column:
    """Whether a failure text or code names a transient condition."""
    any_of = "|".join(TRANSIENT)
    matches = message.rlike(f"(?i)({any_of})") | code.rlike(f"(?i)({any_of})") | (F.upper(code) == "ENOTFOUND")
    # An absent text matches nothing; a match on the other side still counts.
    return F.coalesce(matches, F.lit(False))


def triage(failures: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Adds `outcome` (RETRY or DLQ) and `dead_reason` for rows with error_message, error_code, retry_count."""
    budget = F.coalesce("retry_count", F.lit(0)) < max_retries
    retry = is_transient(F.col("error_message"), F.col("error_code")) & budget
    return (
        failures.withColumn("outcome", F.when(retry, RETRY).otherwise(DEAD))
        .withColumn("dead_reason", F.when(~retry, F.when(budget, NON_RETRYABLE).otherwise(EXHAUSTED)))
    )


def route(messages: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Parses, checks and routes messages in one pass.

    Adds the typed hit columns, `error`, `outcome` (STORE, RETRY, DLQ) and `dead_reason`. A failure reported in
    the message's `error_message`/`error_code` counts when the message itself is sound. Messages that do not
    parse count as never retried.
    """
    for header in ("error_message", "error_code"):
        if header not in messages.columns:
            messages = messages.withColumn(header, F.lit(None).cast("string"))
    checked = check_storage(parse(messages))
    own = F.coalesce("parse_error", "store_error")
    error = F.coalesce(own, "error_message")
    reported = F.when(own.isNull(), F.col("error_code"))
    budget = F.when(F.col("parse_error").isNotNull(), True).otherwise(
        F.coalesce("retry_count", F.lit(0)) < max_retries)
    retry = budget & is_transient(error, reported)
    sound = F.coalesce(error, reported).isNull()
    return computed_once(checked, {
        "error": error,
        "outcome": F.when(sound, STORE).when(retry, RETRY).otherwise(DEAD),
        "dead_reason": F.when(sound, None).when(retry, None).when(budget, NON_RETRYABLE).otherwise(EXHAUSTED),
    }).drop("parse_error", "store_error")


def dead_letters(routed: DataFrame, queue: str, now: Column) -> DataFrame:
    """Dead messages with their original body and headers, the reason and the error."""
    return routed.where(F.col("outcome") == DEAD).select(
        "value", "message_id", "retry_count", "error_message", "error_code",
        "dead_reason", F.coalesce("error", F.lit("Unknown error")).alias("dead_error"),
        now.alias("dead_at"), F.lit(queue).alias("original_queue"))


def due_at(now: Column, retry_count: Column, base_ms: int = RETRY_BASE_MS, cap_ms: int = RETRY_CAP_MS) -> Column:
    """When a message is due again: the delay doubles with every retry it has had, up to `cap_ms`."""
    doublings = F.least(F.coalesce(retry_count, F.lit(0)), F.lit(30))
    delay = F.least(F.lit(base_ms) * F.pow(F.lit(2.0), doublings), F.lit(float(cap_ms))).cast("long")
    return F.timestamp_micros(F.unix_micros(now) + delay * 1000)


def retries(routed: DataFrame, queue: str, now: Column) -> DataFrame:
    """Messages to be queued again: the same body, one more retry, the failure cleared, and when they are due."""
    return routed.where(F.col("outcome") == RETRY).select(
        "value", "message_id", (F.coalesce("retry_count", F.lit(0)) + 1).alias("retry_count"),
        F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("string").alias("error_code"),
        now.alias("retry_at"), due_at(now, F.col("retry_count")).alias("due_at"), F.lit(queue).alias("original_queue"))
