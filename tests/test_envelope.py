import json

from hitlytics.operators import dedupe, envelope
from pyspark.sql import functions as F

from helpers import hex_id, rows

GOOD = {
    "eventId": "e1", "timestamp": "2024-01-01T10:00:00.250Z", "serviceName": "s", "endpoint": "/e?x=1", "method": "GET",
    "statusCode": 200, "latencyMs": 12.5, "clientId": hex_id(1), "apiKeyId": hex_id(2), "ip": "1.1.1.1"}
MESSAGE = "value string, message_id string, retry_count int"


def body(type_="API_HIT", data=None, **top):
    return json.dumps({"type": type_, "data": GOOD if data is None else data, **top})


def event(**changes):
    return body(data={k: v for k, v in {**GOOD, **changes}.items() if v is not ...})


def messages(spark, values, retry_count=0):
    return spark.createDataFrame([(v, f"m{i:02d}", retry_count) for i, v in enumerate(values)], MESSAGE)


def by_message(df, column):
    return [v for _, v in rows(df, "message_id", column)]


def test_parse_errors(spark):
    prefix = "Message parsing failed: "
    schema = prefix + "Schema validation failed: "
    cases = {
        body(): None,
        "  " + body() + "\n": None,
        "{bad": prefix + "invalid JSON",
        "": prefix + "invalid JSON",
        body() + " junk": prefix + "invalid JSON",
        body() + "],[{}": prefix + "invalid JSON",
        body() + ", 1],[2": prefix + "invalid JSON",
        body().replace('"', "'"): prefix + "invalid JSON",
        body().replace("12.5", "NaN"): prefix + "invalid JSON",
        "[]": schema + "Expected object, received array",
        "null": schema + "Expected object, received null",
        "7": schema + "Expected object, received number",
        '"x"': schema + "Expected object, received string",
        "{}": schema + "Required, Required",
        body("OTHER"): schema + "Invalid enum value. Expected 'API_HIT', received 'OTHER'",
        body(5, data=[]): schema + "Expected 'API_HIT', received number, Expected object, received array",
        body(data="text"): schema + "Expected object, received string",
        body(messageId=5): schema + "Expected string, received number",
        body(messageId=None): schema + "Expected string, received null",
        body(timestamp={}): schema + "Invalid input",
        body(timestamp=True): schema + "Invalid input",
        body(timestamp=5, messageId="x"): None,
        body(extra=[1]): None,
        # The last of repeated fields counts.
        '{"type":"OTHER",' + body()[1:]: None,
    }
    parsed = envelope.parse(messages(spark, list(cases)))
    assert by_message(parsed, "parse_error") == list(cases.values())


def test_message_id_falls_back(spark):
    values = [(body(messageId="own"), "broker", 0), (body(messageId="own"), None, 0), (body(), None, 0),
              ("{bad", None, 0)]
    parsed = envelope.parse(spark.createDataFrame(values, MESSAGE))
    assert {r["message_id"] for r in parsed.collect()} == {"broker", "own", "e1", None}


def test_storage_checks(spark):
    prefix = "Storage check failed: "
    cases = {
        event(): None,
        event(timestamp=1704103200250): None,
        event(statusCode="404", latencyMs="1e1"): None,
        event(serviceName=5, userAgent=...): None,
        event(endpoint="{id}"): None,
        event(endpoint={"a": 1}): prefix + "endpoint is required",
        event(timestamp="1704103200250"): prefix + "timestamp is required",
        event(timestamp=..., ip=""): prefix + "timestamp is required, ip is required",
        event(method="get"): prefix + "method is invalid",
        event(clientId="zzz", apiKeyId=...): prefix + "clientId is invalid, apiKeyId is required",
        event(statusCode=None, latencyMs=""): prefix + "statusCode is required, latencyMs is required",
        event(eventId="", serviceName=None): prefix + "eventId is required, serviceName is required",
    }
    checked = envelope.check_storage(envelope.parse(messages(spark, list(cases))))
    assert by_message(checked, "store_error") == list(cases.values())
    typed = {r["message_id"]: r for r in checked.collect()}
    assert str(typed["m01"]["hit_ts"]) == str(typed["m00"]["hit_ts"])
    assert (typed["m02"]["status_code"], typed["m02"]["latency_ms"]) == (404.0, 10.0)
    assert (typed["m03"]["service_name"], typed["m03"]["user_agent"]) == ("5", "")


def test_transient_failures(spark):
    texts = [(t.upper(), None) for t in envelope.TRANSIENT] + [
        ("x", "enotfound"), (None, "XECONNRESETX"), ("Buffer not full", None), (None, None), ("", ""),
        ("ENOTFOUND", None)]
    df = spark.createDataFrame([(i, m, c) for i, (m, c) in enumerate(texts)], "i int, m string, c string")
    got = [v for _, v in rows(df.select("i", envelope.is_transient(F.col("m"), F.col("c"))))]
    assert got == [True] * len(envelope.TRANSIENT) + [True, True, False, False, False, False]


def test_triage_uses_the_retry_budget(spark):
    cases = [("Channel closed", 0), ("Channel closed", 2), ("Channel closed", 3), ("Bad data", 0), ("Bad data", 3),
             ("Channel closed", None)]
    df = spark.createDataFrame(
        [(f"m{i}", m, None, n) for i, (m, n) in enumerate(cases)],
        "message_id string, error_message string, error_code string, retry_count int")
    assert [r[1:] for r in rows(envelope.triage(df), "message_id", "outcome", "dead_reason")] == [
        ("RETRY", None), ("RETRY", None), ("DLQ", "MAX_RETRIES_EXCEEDED"), ("DLQ", "NON_RETRYABLE"),
        ("DLQ", "MAX_RETRIES_EXCEEDED"), ("RETRY", None)]


def test_routing(spark):
    sent = spark.createDataFrame([
        (event(), "ok", 0, None, None),
        (event(), "again", 1, "Connection closed", None),
        (event(), "spent", 3, "Connection closed", None),
        (event(), "code", 0, None, "ECONNRESET"),
        (event(), "fatal", 0, "duplicate key", "11000"),
        ("{bad", "broken", 9, None, None),
        (event(method="x"), "invalid", 3, None, None),
    ], MESSAGE + ", error_message string, error_code string")
    routed = envelope.route(sent)
    assert rows(routed, "message_id", "outcome", "dead_reason") == sorted([
        ("ok", "STORE", None), ("again", "RETRY", None), ("spent", "DLQ", "MAX_RETRIES_EXCEEDED"),
        ("code", "RETRY", None), ("fatal", "DLQ", "NON_RETRYABLE"), ("broken", "DLQ", "NON_RETRYABLE"),
        ("invalid", "DLQ", "MAX_RETRIES_EXCEEDED")])
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert rows(envelope.retries(routed, "q", now), "message_id", "retry_count", "error_message") == [
        ("again", 2, None), ("code", 1, None)]
    dead = {r["message_id"]: r for r in envelope.dead_letters(routed, "q", now).collect()}
    assert dead["broken"]["value"] == "{bad" and dead["fatal"]["dead_error"] == "duplicate key"
    assert {r["original_queue"] for r in dead.values()} == {"q"}


def test_messages_round_trip(spark):
    first = envelope.route(messages(spark, [event()]))
    again = envelope.route(envelope.to_messages(first))
    columns = ["event_id", "hit_ts", "service_name", "endpoint", "method", "status_code", "latency_ms", "client_id",
               "api_key_id", "ip", "user_agent", "outcome"]
    assert rows(again, *columns) == rows(first, *columns)


def test_first_copy_wins(spark):
    copies = [body(publishedAt="2024-01-01T10:00:02Z", attempt=2), body(publishedAt="2024-01-01T10:00:01Z", attempt=3),
              body(publishedAt="2024-01-01T10:00:01Z", attempt=1)]
    kept = dedupe.first_copies(envelope.route(messages(spark, copies * 50)))
    assert [r["publish_order"]["attempt"] for r in kept.collect()] == [1]


def test_stored_events_are_skipped(spark):
    events = envelope.route(messages(spark, [
        event(), event(eventId="e2"), event(eventId="e3", timestamp="2024-01-02T00:00:00Z")]))
    stored = spark.sql("select 'e1' event_id, date'2024-01-01' hit_date union all select 'e3', date'2023-12-31'")
    assert rows(dedupe.unseen(events, stored), "event_id") == [("e2",), ("e3",)]
    assert rows(dedupe.unseen(events, stored, same_day=False), "event_id") == [("e2",)]
