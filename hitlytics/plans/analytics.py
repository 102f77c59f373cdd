"""Reports over the roll-up: overall statistics, top endpoints, time series, dashboard.

Every reader takes roll-up rows or unmerged partials alike: all of them add up again.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values
from ..functions.times import TimeRange, at
from ..operators.rollup import totals
from .scope import ALL_CLIENTS

MAX_ROWS = 1000
DEFAULT_SERIES, DEFAULT_TOP = 100, 10
DASHBOARD_SERIES, DASHBOARD_TOP = 24, 5


def page_size(limit: int) -> int:
    return min(max(1, limit), MAX_ROWS)


def scoped(
    rollup: DataFrame,
    client_id: str | None = None,
    start: int | None = None,
    end: int | None = None,
    service_name: str | None = None,
    endpoint: str | None = None,
) -> DataFrame:
    """Only the given predicates. Times are compared with the bucket's start, both ends included.

    On a stored roll-up the matching day partitions are pruned as well.
    """
    for column, value in (("client_id", client_id), ("service_name", service_name), ("endpoint", endpoint)):
        if value:
            rollup = rollup.where(F.col(column) == F.lit(value))
    dated = "bucket_date" in rollup.columns
    if start:
        rollup = rollup.where(F.col("time_bucket") >= at(start))
        rollup = rollup.where(F.col("bucket_date") >= F.to_date(at(start))) if dated else rollup
    if end:
        rollup = rollup.where(F.col("time_bucket") <= at(end))
        rollup = rollup.where(F.col("bucket_date") <= F.to_date(at(end))) if dated else rollup
    return rollup


def _sums() -> list[Column]:
    return totals()[:3]


def _summary(by_endpoint: DataFrame, *scope: str) -> DataFrame:
    """Statistics from rows already added up per (service, endpoint), so that the two distinct counts expand
    that small result and not the roll-up."""
    return by_endpoint.groupBy(*scope).agg(
        *_sums(),
        F.count_distinct("service_name").alias("unique_services"),
        F.count_distinct("endpoint").alias("unique_endpoints"))


def _statistics() -> list[Column]:
    hits, errors = F.coalesce("total_hits", F.lit(0)), F.coalesce("error_hits", F.lit(0))
    return [
        hits.alias("total_hits"),
        errors.alias("error_hits"),
        (hits - errors).alias("success_hits"),
        values.rate_percent(errors, hits).alias("error_rate"),
        values.mean_ms(F.col("latency_us"), F.col("total_hits")).alias("avg_latency"),
        F.coalesce("unique_services", F.lit(0)).alias("unique_services"),
        F.coalesce("unique_endpoints", F.lit(0)).alias("unique_endpoints"),
    ]


def overall_stats(
    rollup: DataFrame, now_ms: int, client_id: str | None = None, bounds: TimeRange = TimeRange()
) -> DataFrame:
    """Exactly one row. Without bounds: the 24 hours before `now`."""
    window = bounds.last_day_if_open(now_ms)
    rows = scoped(rollup, client_id, window.start, window.end)
    by_endpoint = rows.groupBy("service_name", "endpoint").agg(*_sums())
    return _summary(by_endpoint).select(
        *_statistics(), at(window.start).alias("range_start"), at(window.end).alias("range_end"))


def top_endpoints(
    rollup: DataFrame, client_id: str | None = None, start: int | None = None, limit: int = DEFAULT_TOP
) -> DataFrame:
    """Busiest endpoints. There is no end bound, and without a start all times count."""
    grouped = scoped(rollup, client_id, start).groupBy("service_name", "endpoint", "method").agg(*_sums())
    return (
        grouped.orderBy(F.col("total_hits").desc(), "service_name", "endpoint", "method")
        .limit(page_size(limit))
        .select(
            "service_name", "endpoint", "method", "total_hits",
            values.mean_ms_2dp(F.col("latency_us"), F.col("total_hits")).alias("avg_latency"),
            "error_hits",
            values.rate_percent(F.col("error_hits"), F.col("total_hits")).alias("error_rate"))
    )


SERIES_ORDER = ["time_bucket", "service_name", "endpoint", "method"]


def after(time_bucket_ms: int, service_name: str, endpoint: str, method: str) -> Column:
    """Series rows that follow the given one; pages of any depth without an offset."""
    bucket = at(time_bucket_ms)
    key = F.struct("service_name", "endpoint", "method")
    last = F.struct(
        F.lit(service_name).alias("service_name"), F.lit(endpoint).alias("endpoint"), F.lit(method).alias("method"))
    return (F.col("time_bucket") < bucket) | ((F.col("time_bucket") == bucket) & (key > last))


def time_series(
    rollup: DataFrame,
    now_ms: int,
    client_id: str | None = None,
    bounds: TimeRange = TimeRange(),
    service_name: str | None = None,
    endpoint: str | None = None,
    limit: int = DEFAULT_SERIES,
    offset: int = 0,
    page_after: Column | None = None,
) -> DataFrame:
    """Metrics per endpoint and bucket, newest bucket first; `limit` counts rows, not buckets."""
    window = bounds.last_day_if_open(now_ms)
    rows = scoped(rollup, client_id, window.start, window.end, service_name, endpoint)
    if page_after is not None:
        rows = rows.where(page_after)
    grouped = rows.groupBy(*SERIES_ORDER).agg(*totals())
    newest_first = [F.col("time_bucket").desc(), *SERIES_ORDER[1:]]
    return (
        grouped.orderBy(*newest_first).offset(max(0, offset)).limit(page_size(limit))
        .select(
            "service_name", "endpoint", "method", "total_hits", "error_hits",
            values.mean_ms_2dp(F.col("latency_us"), F.col("total_hits")).alias("avg_latency"),
            values.ms_2dp(F.col("min_latency_us")).alias("min_latency"),
            values.ms_2dp(F.col("max_latency_us")).alias("max_latency"),
            "time_bucket")
    )


PARTS = {"stats": "stats", "top": "top_endpoints", "series": "recent_activity"}


def _dashboard_parts(
    rollup: DataFrame, now_ms: int, client_id: str | None, bounds: TimeRange
) -> dict[str, Callable[[], DataFrame]]:
    """The statistics, the five top endpoints (ignoring the end bound) and the last 24 series rows."""
    return {
        "stats": lambda: overall_stats(rollup, now_ms, client_id, bounds),
        "top": lambda: top_endpoints(rollup, client_id, bounds.start, DASHBOARD_TOP),
        "series": lambda: time_series(rollup, now_ms, client_id, bounds, limit=DASHBOARD_SERIES),
    }


def _combined(parts: dict[str, DataFrame]) -> DataFrame:
    """One row of the given parts; at most 1 + 5 + 24 rows meet here."""
    tagged = [df.select(F.struct(*df.columns).alias(name)) for name, df in parts.items()]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)

    def in_order(rows: Column, *order: Column) -> Column:
        # The sort key leads the struct; the row follows and is taken out again.
        return F.transform(F.sort_array(F.collect_list(F.when(rows.isNotNull(), F.struct(
            *[c.alias(f"k{i}") for i, c in enumerate(order)], rows.alias("row"))))), lambda e: e["row"])

    made = {
        "stats": lambda: F.first("stats", ignorenulls=True),
        "top": lambda: in_order(
            F.col("top"), -F.col("top.total_hits"), F.col("top.service_name"), F.col("top.endpoint"), F.col("top.method")),
        "series": lambda: in_order(
            F.col("series"), -F.unix_micros(F.col("series.time_bucket")), F.col("series.service_name"),
            F.col("series.endpoint"), F.col("series.method")),
    }
    return rows.agg(*[made[name]().alias(PARTS[name]) for name in parts])


def dashboard(
    rollup: DataFrame, now_ms: int, client_id: str | None = None, bounds: TimeRange = TimeRange()
) -> DataFrame:
    """One row: `stats`, `top_endpoints` and `recent_activity`, as one query; a part that fails, fails it."""
    return _combined({name: make() for name, make in _dashboard_parts(rollup, now_ms, client_id, bounds).items()})


def settled_dashboard(
    rollup: DataFrame, now_ms: int, client_id: str | None = None, bounds: TimeRange = TimeRange(),
    parts: dict[str, Callable[[], DataFrame]] | None = None,
) -> DataFrame:
    """The dashboard's row, each part computed by an action of its own: one that fails is null, and `errors` says why.

    The actions run side by side and bring at most 1 + 5 + 24 rows to the driver. `parts` replaces parts by name (stats, top,
    series), as when one of them reads another store.
    """
    spark = rollup.sparkSession
    makers = _dashboard_parts(rollup, now_ms, client_id, bounds) | (parts or {})

    def settle(name: str) -> tuple[DataFrame | None, str | None]:
        try:
            df = makers[name]()
            return spark.createDataFrame(df.collect(), df.schema), None
        except Exception as error:  # whatever a part raises is its own affair
            return None, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"

    with ThreadPoolExecutor(len(makers)) as pool:
        settled = dict(zip(makers, pool.map(settle, makers)))
    sound = {name: df for name, (df, _) in settled.items() if df is not None}
    row = _combined(sound) if sound else spark.range(1).select()
    failed = [F.struct(F.lit(PARTS[name]), F.lit(error)) for name, (_, error) in settled.items() if error is not None]
    errors = F.map_from_entries(F.array(*failed)) if failed else F.lit(None).cast("map<string,string>")
    return row.select(*[F.col(c) if c in row.columns else F.lit(None).cast("string").alias(c) for c in PARTS.values()], errors.alias("errors"))


def _line(e: Column, *fields: Column) -> Column:
    return F.concat_ws(" ", e["service_name"], e["endpoint"], e["method"], *fields)


def top_text() -> Column:
    """The top endpoints as text, two-decimal numbers in fixed form."""
    return F.array_join(F.transform("top_endpoints", lambda e: _line(
        e, e["total_hits"].cast("string"), values.fixed_2dp(e["avg_latency"]), e["error_hits"].cast("string"),
        values.fixed_2dp(e["error_rate"]))), "; ")


def recent_text() -> Column:
    """The last series rows as text, two-decimal numbers in fixed form."""
    return F.array_join(F.transform("recent_activity", lambda e: _line(
        e, e["total_hits"].cast("string"), e["error_hits"].cast("string"), values.fixed_2dp(e["avg_latency"]),
        values.fixed_2dp(e["min_latency"]), values.fixed_2dp(e["max_latency"]),
        F.date_format(e["time_bucket"], "yyyy-MM-dd HH:mm"))), "; ")


def dashboard_text(dashboard_row: DataFrame) -> DataFrame:
    """The dashboard with its lists as text."""
    return dashboard_row.select("stats.*", top_text().alias("top_endpoints"), recent_text().alias("recent_activity"))


def entitled_stats(
    rollup: DataFrame, scopes: DataFrame, now_ms: int, bounds: TimeRange = TimeRange()
) -> DataFrame:
    """Overall statistics of every user who may see any, each within the user's scope.

    `scopes` is the result of `scope.resolve`. The roll-up is added up once per (client, service, endpoint);
    the client rows and the one global row come from that result, and users look their row up.
    """
    window = bounds.last_day_if_open(now_ms)
    by_endpoint = scoped(rollup, None, window.start, window.end).groupBy(
        "client_id", "service_name", "endpoint").agg(*_sums())
    per_scope = by_endpoint.withColumn("scope", F.explode(F.array("client_id", F.lit(ALL_CLIENTS))))
    per_scope = per_scope.groupBy("scope", "service_name", "endpoint").agg(*_sums())
    summary = _summary(per_scope, "scope")
    entitled = scopes.where(F.col("scope").isNotNull()).select("user_id", "scope")
    return entitled.join(summary, "scope", "left").select("user_id", "scope", *_statistics())
