"""Folding, merging and reading the roll-up, against plain Python."""

import random
from collections import defaultdict
from datetime import timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hitlytics.functions.times import DAY_MS, TimeRange, epoch_ms, time_range
from hitlytics.operators import rollup
from hitlytics.plans import analytics
from hitlytics.schema import ROLLUP, ROLLUP_KEY

from helpers import EPOCH, at, hex_id, plan_of, rows

HIT = ("event_id string, hit_ts timestamp, service_name string, endpoint string, method string, status_code double, "
       "latency_ms double, client_id string")
NOW = epoch_ms(EPOCH) + 3 * DAY_MS


def some_hits(n=400, seed=3):
    rng = random.Random(seed)
    return [(f"e{i}", at(rng.randrange(0, 3 * 86400)), rng.choice("ab"), f"/{rng.randrange(4)}", rng.choice(["GET", "PUT"]),
             float(rng.choice([200, 201, 404, 500])), rng.randrange(0, 500000) / 1000, hex_id(rng.randrange(3)))
            for i in range(n)]


@pytest.fixture(scope="module")
def hits():
    return some_hits()


@pytest.fixture(scope="module")
def hourly(spark, hits):
    return rollup.fold(spark.createDataFrame(hits, HIT)).cache()


def in_window(hits, start, end):
    for h in hits:
        bucket = epoch_ms(h[1].replace(minute=0, second=0, microsecond=0))
        if start <= bucket <= end:
            yield h, bucket


def test_fold_matches_a_plain_loop(spark, hits, hourly):
    want = defaultdict(lambda: [0, 0, 0, 10**12, -1])
    for _, ts, service, endpoint, method, status, latency, client in hits:
        cell = want[client, service, endpoint, method, ts.replace(minute=0, second=0)]
        us = round(latency * 1000)
        cell[:] = [cell[0] + 1, cell[1] + (status >= 400), cell[2] + us, min(cell[3], us), max(cell[4], us)]
    got = {(*r[:4], r[4].astimezone(timezone.utc)): list(r[5:]) for r in hourly.select(*ROLLUP.names).collect()}
    assert got == dict(want)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cuts=st.lists(st.integers(0, 400), min_size=1, max_size=3), seed=st.integers(0, 1000))
def test_any_split_into_batches_merges_to_the_same(spark, hits, hourly, cuts, seed):
    shuffled = random.Random(seed).sample(hits, len(hits))
    bounds = [0, *sorted(cuts), len(hits)]
    parts = [rollup.fold(spark.createDataFrame(shuffled[a:b], HIT)) for a, b in zip(bounds, bounds[1:]) if a < b]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    assert rows(rollup.merge(union), *ROLLUP.names) == rows(hourly, *ROLLUP.names)


def test_rejected_hits_are_kept_apart(spark):
    good = ("1", at(0), "s", "/", "GET", 200.0, 1.0, hex_id(1))
    bad = [
        ("2", at(0), "s" * 256, "/", "GET", 200.0, 1.0, hex_id(1)),
        ("3", at(0), "s", "/" * 501, "GET", 200.0, 1.0, hex_id(1)),
        ("4", at(0), "s", "/", "G" * 11, 200.0, 1e7, hex_id(1)),
        ("5", at(0), "s", "/", "GET", 200.0, 1.0, hex_id(1) + "0"),
    ]
    fits, rejects = rollup.split_rejects(spark.createDataFrame([good, *bad], HIT))
    assert rows(fits, "event_id") == [("1",)]
    assert [r for _, r in rows(rejects, "event_id", "reject_reason")] == [
        "service_name is longer than 255", "endpoint is longer than 500",
        "method is longer than 10, latency_ms is out of range", "client_id is longer than 24"]


def test_overall_stats(spark, hits, hourly):
    start, end = epoch_ms(at(1800)), epoch_ms(at(86400))
    seen = [h for h, _ in in_window(hits, start, end)]
    got = analytics.overall_stats(hourly, NOW, bounds=TimeRange(start, end)).collect()
    assert len(got) == 1
    row, errors = got[0], sum(h[5] >= 400 for h in seen)
    assert (row["total_hits"], row["error_hits"], row["success_hits"]) == (len(seen), errors, len(seen) - errors)
    assert row["error_rate"] == pytest.approx(errors * 100 / len(seen), abs=0.0051)
    assert row["avg_latency"] == pytest.approx(sum(h[6] for h in seen) / len(seen))
    assert (row["unique_services"], row["unique_endpoints"]) == (len({h[2] for h in seen}), len({h[3] for h in seen}))


def test_empty_scope_gives_one_row_of_zeros(spark, hourly):
    row = analytics.overall_stats(hourly, NOW, client_id=hex_id(77)).first()
    assert row[:7] == (0, 0, 0, 0.0, 0.0, 0, 0)
    page = analytics.dashboard(hourly, NOW, client_id=hex_id(77)).first()
    assert (page["stats"]["total_hits"], page["top_endpoints"], page["recent_activity"]) == (0, [], [])


def test_default_range_is_the_last_day(spark, hits, hourly):
    seen = [h for h, _ in in_window(hits, NOW - DAY_MS, NOW)]
    assert analytics.overall_stats(hourly, NOW).first()["total_hits"] == len(seen)
    assert analytics.overall_stats(hourly, NOW, bounds=time_range(0, 0)).first()["total_hits"] == len(seen)
    everything = analytics.top_endpoints(hourly, limit=1000)
    assert everything.agg(F.sum("total_hits")).first()[0] == len(hits)


def test_top_endpoints_scope_limit_and_ties(spark, hits, hourly):
    counts = defaultdict(int)
    for h in hits:
        if h[7] == hex_id(1):
            counts[h[2], h[3], h[4]] += 1
    want = sorted(((-n, k) for k, n in counts.items()))
    got = analytics.top_endpoints(hourly, client_id=hex_id(1), limit=3).collect()
    assert [(-r["total_hits"], (r["service_name"], r["endpoint"], r["method"])) for r in got] == want[:3]
    assert analytics.top_endpoints(hourly, limit=-5).count() == 1
    assert analytics.page_size(5000) == 1000


def test_series_pages(spark, hits, hourly):
    bounds = TimeRange(epoch_ms(at(0)), NOW)

    def page(**options):
        return [tuple(r) for r in analytics.time_series(hourly, NOW, bounds=bounds, **options).collect()]

    whole = page(limit=1000)
    assert len(whole) == len({(h[2], h[3], h[4], b) for h, b in in_window(hits, bounds.start, NOW)})
    assert [r[-1] for r in whole] == sorted((r[-1] for r in whole), reverse=True)
    assert page(limit=10, offset=7) == whole[7:17]
    assert page(limit=10, offset=-3) == whole[:10]
    last = whole[16]
    follow = analytics.after(epoch_ms(last[-1].astimezone(timezone.utc)), *last[:3])
    assert page(limit=10, page_after=follow) == whole[17:27]
    only = page(limit=1000, service_name="a", endpoint="/1")
    assert only == [r for r in whole if r[:2] == ("a", "/1")]
    assert page(limit=1000, client_id="", service_name="") == whole


def test_dashboard_parts_agree_with_the_single_reports(spark, hourly):
    bounds = TimeRange(epoch_ms(at(3600)), epoch_ms(at(100000)))
    page = analytics.dashboard(hourly, NOW, bounds=bounds).first()
    assert page["stats"] == analytics.overall_stats(hourly, NOW, bounds=bounds).first()
    assert [tuple(r) for r in page["top_endpoints"]] == [
        tuple(r) for r in analytics.top_endpoints(hourly, start=bounds.start, limit=5).collect()]
    assert [tuple(r) for r in page["recent_activity"]] == [
        tuple(r) for r in analytics.time_series(hourly, NOW, bounds=bounds, limit=24).collect()]
    assert "CartesianProduct" not in plan_of(analytics.dashboard(hourly, NOW))
    assert "NestedLoop" not in plan_of(analytics.dashboard(hourly, NOW))


def test_keys_are_complete():
    assert ROLLUP.names[:5] == ROLLUP_KEY
