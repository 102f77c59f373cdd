"""Scalar rules, checked value by value."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from hitlytics.functions import names, times, values
from hitlytics.operators.catalog import parse_limit
from hitlytics.session import shared_path


def column(spark, items, fn, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {dtype}")
    return [r["x"] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_numbers_from_text(spark):
    texts = ["200", " 200 ", "1e2", "+5", ".5", "5.", "200d", "abc", "", "  ", "0x10", "0b11", "0o17", "Infinity",
             "NaN", "1_0", None, "-1", "1e400"]
    assert column(spark, texts, values.to_number) == [
        200.0, 200.0, 100.0, 5.0, 0.5, 5.0, None, None, 0.0, 0.0, 16.0, 3.0, 15.0, float("inf"),
        None, None, None, -1.0, float("inf")]


def test_methods(spark):
    assert column(spark, ["get", "Post", "FETCH", "", None], values.http_method) == ["GET", "POST", None, None, None]


def test_object_ids(spark):
    ids = ["0123456789abcdefABCDEF00", "0123456789abcdefABCDEF0", "zzz", "", None, "0123456789abcdefABCDEF00\n1"]
    assert column(spark, ids, values.is_object_id) == [True, False, False, False, False, False]


def test_text_defaults(spark):
    assert column(spark, ["1.2.3.4", "", None], lambda c: values.default_text(c, "unknown")) == [
        "1.2.3.4", "unknown", "unknown"]


def test_microseconds_round_like_a_three_decimal_column(spark):
    latencies = [12.3455, 1.0005, 0.0004, 9999999.999, 9999999.9996, 10000000.0, -1.5, float("inf"), float("nan")]
    assert column(spark, latencies, values.microseconds, "double") == [
        12346, 1001, 0, 9999999999, None, None, -1500, None, None]


def test_two_decimals_round_half_up_exactly(spark):
    us = [9425, 9424, 1005000, 5, 4, 0, None, -9425]
    assert column(spark, us, lambda c: values.mean_ms_2dp(c, F.lit(1)), "long") == [
        9.43, 9.42, 1005.0, 0.01, 0.0, 0.0, None, -9.43]
    assert column(spark, [1, 2, 0], lambda c: values.rate_percent(c, F.lit(3)), "long") == [33.33, 66.67, 0.0]
    assert column(spark, [0], lambda c: values.rate_percent(c, F.lit(0)), "long") == [0.0]
    assert column(spark, [0.13, 2.5], values.fixed_2dp, "double") == ["0.13", "2.50"]


def test_buckets(spark):
    stamps = ["2024-01-05 13:45:59.999"]
    for grain, want in {
        "minute": "2024-01-05 13:45:00", "hour": "2024-01-05 13:00:00", "day": "2024-01-05 00:00:00",
        "week": "2024-01-05 13:00:00"}.items():
        got = column(spark, stamps, lambda c: times.time_bucket(c.cast("timestamp"), grain).cast("string"))
        assert got == [want]


def test_instants(spark):
    texts = ["2024-01-01T00:00:00.5Z", "2024-01-01T02:00:00+02:00", "2024-01-01", "2024", "12:30", "noon", None]
    got = column(spark, texts, lambda c: times.instant_from_text(c).cast("string"))
    assert got == ["2024-01-01 00:00:00.5", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00",
                   None, None, None]
    got = column(spark, [2026.0, 9e15], lambda c: times.instant_from_epoch_ms(c).cast("string"), "double")
    assert got == ["1970-01-01 00:00:02.026", None]


def test_expiry_is_strict_and_optional(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    stamps = ["2023-12-31 23:59:59", "2024-01-01 00:00:00", None]
    assert column(spark, stamps, lambda c: times.is_expired(c.cast("timestamp"), now)) == [True, False, False]


def test_time_ranges():
    assert times.epoch_ms("2026") == 2026
    assert times.epoch_ms("2024-01-01T00:00:00Z") == 1704067200000
    assert times.epoch_ms(datetime(2024, 1, 1, tzinfo=timezone.utc)) == 1704067200000
    assert times.epoch_ms("") is None and times.epoch_ms(None) is None
    with pytest.raises(ValueError, match="Invalid time format"):
        times.epoch_ms("soon")
    with pytest.raises(ValueError, match="start > end"):
        times.time_range("2024-01-02", "2024-01-01")
    assert times.time_range("2024-01-02", None).end is None
    now = times.epoch_ms("2024-01-31")
    assert times.time_range(0, None).last_day_if_open(now) == times.TimeRange(now - times.DAY_MS, now)


def test_slugs(spark):
    titles = ["  Acme Corp. ", "a - b", "--x__y--", "Ünïcode 9", ""]
    assert column(spark, titles, names.slug) == ["acme-corp", "a-b", "xy", "ncode-9", ""]


def test_role_permissions(spark):
    got = column(spark, ["super_admin", "client_admin", "client_viewer", "root"], names.role_permissions)
    assert [None if p is None else tuple(p) for p in got] == [
        (True, True, True, True), (True, True, True, True), (False, False, True, False), None]


def test_contains_ignores_case(spark):
    assert column(spark, ["Maya Chen", "Li"], lambda c: values.contains_ignoring_case(c, "MAYA")) == [True, False]
    tags = [["Monitoring", "x"], [], ["y"]]
    assert column(spark, tags, lambda c: values.any_contains_ignoring_case(c, "MON"), "array<string>") == [
        True, False, False]


def test_limits_fall_back():
    assert [parse_limit(v) for v in (None, "", "abc", "0", "-3", "2", "7x", 4)] == [10, 10, 10, 10, 10, 2, 7, 4]


class Session:
    """Stands in for a session with the given settings."""

    def __init__(self, **settings):
        self.conf = {f"spark.{k}": v for k, v in settings.items()}


def test_shared_folder():
    assert shared_path(Session(**{"checkpoint.dir": "hdfs:///x/"}), "t").startswith("hdfs:///x/hitlytics/t-")
    assert shared_path(Session(master="local[2]"), "t") != shared_path(Session(master="local[2]"), "t")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(Session(master="yarn"), "t")


def test_radix_texts_of_any_length(spark):
    texts = ["0xC8", "0x00000000000000000C8", "0x1FFFFFFFFFFFFFFF", "0x0", "0x", "0b" + "1" * 100, "0o" + "7" * 40, "0x" + "f" * 300, "0xg", " 0B101 "]
    want = [200.0, 200.0, float(0x1FFFFFFFFFFFFFFF), 0.0, None, float(2 ** 100 - 1), float(8 ** 40 - 1), float("inf"), None, 5.0]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in frame.select("i", values.to_number(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got == want
