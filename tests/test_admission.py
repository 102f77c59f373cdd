import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hitlytics.operators import admission, quota
from hitlytics.operators.quota import flag_over_quota

from helpers import at, hex_id, plan_of, rows

PAYLOAD = ("event_id string, service_name string, endpoint string, method string, status_code string, "
           "latency_ms string, client_id string, key_value string, ip string, received_at timestamp")


def payload(event_id="e", service="s", endpoint="/e", method="GET", status="200", latency="1", client=hex_id(9),
            key="good", ip="1.1.1.1", second=0):
    return (event_id, service, endpoint, method, status, latency, client, key, ip, at(second))


@pytest.fixture
def registry(spark):
    keys = spark.createDataFrame([
        (hex_id(101), "good", hex_id(1), True, True, at(1000)),
        (hex_id(102), "forever", hex_id(1), True, True, None),
        (hex_id(103), "off", hex_id(1), False, True, None),
        (hex_id(104), "orphan", hex_id(99), True, True, None),
        (hex_id(105), "idle client", hex_id(2), True, True, None),
        (hex_id(106), "read only", hex_id(1), True, False, None),
        (hex_id(107), "unset", hex_id(1), True, None, None),
    ], "api_key_id string, key_value string, client_id string, is_active boolean, can_ingest boolean, "
       "expires_at timestamp")
    clients = spark.createDataFrame([(hex_id(1), True), (hex_id(2), False)], "client_id string, is_active boolean")
    return keys, clients


def test_key_check_order_and_overwriting_of_claims(spark, registry):
    cases = {
        "good": None, "forever": None, "off": "Invalid API key", "orphan": "Invalid API key",
        "idle client": "Client account is inactive", "read only": "API key does not have ingest permissions",
        "unset": "API key does not have ingest permissions", "unknown": "Invalid API key",
        "": "API key is required", None: "API key is required"}
    hits = spark.createDataFrame([payload(f"e{i}", key=k) for i, k in enumerate(cases)], PAYLOAD)
    got = {r["key_value"]: r for r in admission.check_keys(hits, *registry).collect()}
    assert {k: r["reject_reason"] for k, r in got.items()} == cases
    assert (got["good"]["client_id"], got["good"]["api_key_id"]) == (hex_id(1), hex_id(101))
    assert got["unknown"]["client_id"] is None  # the payload's own claim does not survive


def test_expiry_compares_with_receipt(spark, registry):
    hits = spark.createDataFrame([payload("a", second=1000), payload("b", second=1001)], PAYLOAD)
    assert rows(admission.check_keys(hits, *registry), "event_id", "reject_reason") == [
        ("a", None), ("b", "Invalid API key")]


def test_validation_reports_the_first_failure(spark):
    cases = [
        (payload("0", service=None, endpoint="", method="", status="", latency=None, client=""),
         "Missing required fields: serviceName,endpoint,method,statusCode,latencyMs,clientId"),
        (payload("1", method="FETCH", status="9"), "Invalid HTTP methods: FETCH "),
        (payload("2", status="99", latency="-1"), "Invalid Status code : 99 "),
        (payload("3", status="600"), "Invalid Status code : 600 "),
        (payload("4", status="abc"), "Invalid Status code : abc "),
        (payload("5", latency="-0.5"), "Invalid latency : -0.5 "),
        (payload("6", latency="1ms"), "Invalid latency : 1ms "),
        (payload("7", method="get", status=" 200 ", latency="1e2"), None),
        (payload("8", status="599.0", latency="0"), None),
    ]
    hits = spark.createDataFrame([c for c, _ in cases], PAYLOAD)
    assert [e for _, e in rows(admission.validate(hits), "event_id", "error")] == [e for _, e in cases]


def test_normalised_hits(spark):
    hit = spark.createDataFrame([payload("1", method="post", status=" 200 ", latency="1e2", ip="")], PAYLOAD)
    row = admission.normalise(hit).first()
    assert (row["method"], row["status_code"], row["latency_ms"], row["ip"], row["user_agent"]) == (
        "POST", 200.0, 100.0, "unknown", "")


def test_stamped_payloads_keep_their_ids(spark):
    stamped = admission.stamp(spark.range(5).withColumn("event_id", F.when(F.col("id") < 2, F.lit("mine"))))
    first, second = rows(stamped, "id", "event_id"), rows(stamped, "id", "event_id")
    assert first == second and len({e for _, e in first}) == 4
    assert stamped.where("received_at is null").count() == 0


def brute_force_over_quota(hits, limit, seconds):
    groups = defaultdict(list)
    for event_id, ip, ts in hits:
        groups[ip or "unknown", int(ts.timestamp()) // seconds].append((ts, event_id))
    return {e for members in groups.values() for _, e in sorted(members)[limit:]}


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_quota_with_a_hot_address(spark, broadcast):
    rng = random.Random(7)
    hits = [(f"h{i}", "hot" if i % 3 else rng.choice(["a", "b", "", None]), at(rng.randrange(0, 400)))
            for i in range(900)]
    df = spark.createDataFrame(hits, "event_id string, ip string, received_at timestamp").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        flagged = quota.flag_over_quota(df, 40, 100)
        assert flagged.count() == len(hits)
        got = {r["event_id"] for r in flagged.where("over_quota").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == brute_force_over_quota(hits, 40, 100)


def test_quota_counts_bad_payloads_but_not_bad_keys(spark, registry):
    hits = spark.createDataFrame([
        payload("1", key="unknown", second=1), payload("2", status="abc", second=2), payload("3", second=3),
        payload("4", second=4)], PAYLOAD)
    got = dict(rows(admission.admit(hits, *registry, quota=2, window_seconds=900), "event_id", "reject_reason"))
    assert got == {
        "1": "Invalid API key", "2": "Invalid Status code : abc ", "3": None,
        "4": "Too many requests, please try again later"}
    admitted = admission.admit(hits, *registry, quota=2, window_seconds=900)
    assert rows(admission.accepted(admitted), "event_id", "client_id") == [("3", hex_id(1))]


def test_large_lookups_are_joined_plainly(spark, registry):
    hits = spark.createDataFrame([payload("1")], PAYLOAD)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(admission.check_keys(hits, *registry))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan and "Generate" not in plan


def test_quota_of_a_hot_address(spark):
    """More than 100 000 requests of one address, the limit inside a crowded second."""
    hits = spark.range(150_000).select(
        F.format_string("%06d", "id").alias("event_id"), F.lit("1.1.1.1").alias("ip"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.floor(F.col("id") / 40_000)).alias("received_at"))
    flagged = flag_over_quota(hits, 110_000, 900)
    assert flagged.where("over_quota").agg(F.count("*"), F.min("event_id")).first() == (40_000, "110000")
    assert flag_over_quota(hits, 0, 900).where("over_quota").count() == 150_000
    assert flag_over_quota(hits, 150_000, 900).where("over_quota").count() == 0
