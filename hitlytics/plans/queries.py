"""The registered queries: every operator over the benchmark tables.

Each takes (spark, sf_dir). `oracle.py` has the same queries in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, times, values
from ..functions.times import at, time_range
from ..operators import admission, catalog, dedupe, envelope, quota, raw_hits, registry, rollup, runs
from ..schema import HIT
from ..session import shared_path, written
from ..sources import fixtures as fx
from ..sources.tables import RUN_KEYS, HitTables
from ..streaming import ingest
from . import analytics, batch, scope

# The benchmark's events span January 2024; the start is off the hour on purpose.
NOW = fx.NOW_MS
JANUARY = time_range("2024-01-01T00:30:00Z", "2024-01-31T00:00:00Z")
HISTORY_END = "2024-01-10T00:00:00Z"
RETENTION = 15
QUOTA, QUOTA_SECONDS = 2, 6 * 3600

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.fold(fx.hits(spark, sf_dir))


# -- reports -------------------------------------------------------------------------------------------------


@register
def top_endpoints(spark, sf_dir):
    return analytics.top_endpoints(_hourly(spark, sf_dir))


@register
def overall_stats(spark, sf_dir):
    return analytics.overall_stats(_hourly(spark, sf_dir), NOW, bounds=JANUARY)


@register
def overall_stats_last_day(spark, sf_dir):
    return analytics.overall_stats(_hourly(spark, sf_dir), NOW)


@register
def time_series(spark, sf_dir):
    return analytics.time_series(_hourly(spark, sf_dir), NOW, bounds=JANUARY, limit=24, offset=5)


@register
def time_series_endpoint(spark, sf_dir):
    return analytics.time_series(
        _hourly(spark, sf_dir), NOW, client_id="0" * 23 + "8", bounds=JANUARY, service_name="error",
        endpoint="/error/9", limit=5000)


@register
def dashboard(spark, sf_dir):
    # Its three parts read a stored roll-up, as they do in production; the hits are folded once.
    stored = written(_hourly(spark, sf_dir), "rollup")
    return analytics.dashboard_text(analytics.dashboard(stored, NOW, bounds=JANUARY))


@register
def settled_dashboard(spark, sf_dir):
    """The dashboard while its series cannot be computed: the other parts are there, and the reason is named."""
    stored = written(_hourly(spark, sf_dir), "rollup")
    unreadable = {"series": lambda: analytics.time_series(stored.drop("max_latency_us"), NOW, bounds=JANUARY)}
    row = analytics.settled_dashboard(stored, NOW, bounds=JANUARY, parts=unreadable)
    return row.select(
        "stats.*", analytics.top_text().alias("top_endpoints"), "recent_activity", F.array_join(F.map_keys("errors"), ",").alias("failed"))


@register
def entitled_stats(spark, sf_dir):
    scopes = scope.resolve(fx.users(spark, sf_dir), fx.clients(spark, sf_dir))
    return analytics.entitled_stats(_hourly(spark, sf_dir), scopes, NOW, JANUARY)


@register
def tenant_scope(spark, sf_dir):
    return scope.resolve(fx.users(spark, sf_dir), fx.clients(spark, sf_dir)).select("user_id", "scope", "scope_error")


# -- roll-up -------------------------------------------------------------------------------------------------


@register
def rollup_minute(spark, sf_dir):
    return rollup.present(rollup.fold(fx.hits(spark, sf_dir), "minute"))


@register
def rollup_hour(spark, sf_dir):
    return rollup.present(_hourly(spark, sf_dir))


@register
def rollup_day(spark, sf_dir):
    return rollup.present(rollup.fold(fx.hits(spark, sf_dir), "day"))


@register
def rollup_merge(spark, sf_dir):
    partials = rollup.fold(fx.hits(spark, sf_dir), "minute")
    return rollup.present(rollup.merge(
        partials.withColumn("time_bucket", times.time_bucket(F.col("time_bucket"), "hour"))))


@register
def rollup_rejects(spark, sf_dir):
    """Hits whose document text serves as an over-long endpoint, or whose latency exceeds the roll-up's range."""
    documents = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("event_id"), F.col("source").alias("service_name"),
        F.col("text").alias("endpoint"), F.lit("GET").alias("method"), F.col("lang").alias("client_id"),
        (F.col("n_chars") * 2000).cast("double").alias("latency_ms"))
    _, rejected = rollup.split_rejects(documents)
    return rejected.select("event_id", "reject_reason")


# -- admission -----------------------------------------------------------------------------------------------


@register
def admit_hits(spark, sf_dir):
    hits = fx.hits(spark, sf_dir).withColumnRenamed("hit_ts", "received_at")
    checked = admission.check_keys(hits, fx.api_keys(spark, sf_dir), fx.clients(spark, sf_dir))
    return checked.select("event_id", "client_id", "api_key_id", "reject_reason")


@register
def validate_hits(spark, sf_dir):
    return admission.validate(fx.raw_hits(spark, sf_dir)).select("event_id", "error")


@register
def normalise_hits(spark, sf_dir):
    checked = admission.validate(fx.raw_hits(spark, sf_dir))
    return admission.normalise(checked.where(F.col("error").isNull())).drop("api_key_id")


@register
def number_texts(spark, sf_dir):
    """Numbers of events written with leading zeros in several bases, and one that is too long for a whole number."""
    n = F.col("event_id")
    text = (
        F.when(n % 50 == 0, "0x0001FFFFFFFFFFFFFFF")
        .when(n % 4 == 0, F.concat(F.lit("0x"), F.lpad(F.hex(n), 40, "0")))
        .when(n % 4 == 1, F.concat(F.lit("0b"), F.lpad(F.bin(n), 90, "0")))
        .when(n % 4 == 2, F.concat(F.lit(" 0O"), F.conv(n.cast("string"), 10, 8), F.lit(" ")))
        .otherwise(n.cast("string")))
    events = fx.table(spark, sf_dir, "events").select(n.cast("string").alias("event_id"), text.alias("text"))
    return events.select("event_id", values.to_number(F.col("text")).alias("number"))


@register
def epoch_numbers(spark, sf_dir):
    """Messages whose time is a JSON number of up to four digits: milliseconds, not a year."""
    n = F.col("event_id")
    value = F.format_string(
        '{"type":"API_HIT","data":{"eventId":"%d","timestamp":%d,"serviceName":"s"}}', n, n % 10000)
    messages = fx.table(spark, sf_dir, "events").select(
        value.alias("value"), n.cast("string").alias("message_id"), F.lit(0).alias("retry_count"),
        F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("string").alias("error_code"))
    return envelope.check_storage(envelope.parse(messages)).select("event_id", "hit_ts")


@register
def quota_flags(spark, sf_dir):
    hits = fx.hits(spark, sf_dir).select("event_id", "ip", F.col("hit_ts").alias("received_at"))
    return quota.flag_over_quota(hits, QUOTA, QUOTA_SECONDS).select("event_id", "ip", "over_quota")


@register
def admission_outcomes(spark, sf_dir):
    admitted = admission.admit(
        fx.raw_hits(spark, sf_dir), fx.api_keys(spark, sf_dir), fx.clients(spark, sf_dir), QUOTA, QUOTA_SECONDS)
    return admitted.select("event_id", "reject_reason")


# -- queue ---------------------------------------------------------------------------------------------------


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.route(fx.envelopes(spark, sf_dir))


def _sound(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("outcome") == envelope.STORE)


def _first_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_copies(_sound(_routed(spark, sf_dir)))


@register
def publish_messages(spark, sf_dir):
    """Typed hits turned into messages and read back."""
    messages = envelope.to_messages(fx.stored_hits(spark, sf_dir))
    return envelope.route(messages).select(
        "event_id", "hit_ts", "service_name", "endpoint", "method", "status_code", "latency_ms", "client_id",
        "api_key_id", "ip", "user_agent", "outcome")


@register
def parse_envelope(spark, sf_dir):
    return envelope.parse(fx.envelopes(spark, sf_dir)).select("n", "attempt", "message_id", "parse_error")


@register
def store_check(spark, sf_dir):
    checked = envelope.check_storage(envelope.parse(fx.envelopes(spark, sf_dir)))
    return checked.where(F.col("parse_error").isNull()).select("n", "attempt", "event_id", "hit_ts", "store_error")


@register
def dedup_hits(spark, sf_dir):
    """First copies of the sound messages that are not among the hits stored up to the tenth."""
    stored = fx.stored_hits(spark, sf_dir).withColumn("hit_date", F.to_date("hit_ts")).where(
        F.col("hit_ts") < at(times.epoch_ms(HISTORY_END)))
    sound = written(_sound(_routed(spark, sf_dir)).select(*HIT.names, "publish_order", "n", "attempt"), "sound")
    return dedupe.unseen(dedupe.first_copies(sound), stored, days_of=sound).select("event_id", "n", "attempt")


@register
def raw_store(spark, sf_dir):
    return _first_sound(spark, sf_dir).select(
        "event_id", "hit_ts", "service_name", "endpoint", "method", "status_code", "latency_ms", "client_id",
        "api_key_id", "ip", "user_agent")


@register
def dead_letters(spark, sf_dir):
    return envelope.dead_letters(_routed(spark, sf_dir), "api_hits", at(NOW))


@register
def triage_failures(spark, sf_dir):
    return envelope.triage(fx.failures(spark, sf_dir)).select("message_id", "outcome", "dead_reason")


@register
def retry_queue(spark, sf_dir):
    """Messages to be queued again, of all messages with a reported failure."""
    triaged = envelope.triage(fx.failures(spark, sf_dir)).withColumn("error", F.col("error_message"))
    return envelope.retries(triaged, "api_hits", at(NOW)).select(
        "value", "message_id", "retry_count", "retry_at", "due_at", "original_queue")


@register
def batch_outcomes(spark, sf_dir):
    routed = written(_routed(spark, sf_dir).select(*HIT.names, "publish_order", "outcome"), "routed")
    return batch.outcome_counts(routed, dedupe.first_copies(_sound(routed))).drop("rollup_rejected")


@register
def stream_ingest(spark, sf_dir):
    """All messages as a file stream into fresh tables; the resulting roll-up."""
    folder = shared_path(spark, "stream")
    fx.envelopes(spark, sf_dir).drop("n", "attempt").write.parquet(f"{folder}/queue")
    tables = ingest.run(spark, f"{folder}/queue", f"{folder}/tables", f"{folder}/checkpoint", clock=lambda: NOW)
    return rollup.present(tables.endpoint_metrics())


@register
def upkeep(spark, sf_dir):
    """All messages as one batch, then compaction and expiry: hits per day that stay, and hits in the roll-up."""
    tables = HitTables(spark, shared_path(spark, "upkeep")).create()
    batch.ingest_batch(tables, fx.envelopes(spark, sf_dir).drop("n", "attempt"), 0, NOW)
    tables.compact()
    tables.expire(NOW, RETENTION)
    return _hits_by_day(tables)


def _hits_by_day(tables: HitTables) -> DataFrame:
    kept = tables.raw().groupBy(F.to_date("hit_ts").cast("string").alias("day")).agg(F.count("*").alias("raw_hits"))
    folded = tables.rollup().groupBy(F.to_date("time_bucket").cast("string").alias("day")).agg(
        F.sum("total_hits").alias("rollup_hits"))
    return folded.join(kept, "day", "left").select("day", F.coalesce("raw_hits", F.lit(0)).alias("raw_hits"), "rollup_hits")


class _Interrupted(HitTables):
    """Tables whose roll-up cannot be written, as when a batch is lost half way."""

    def write(self, df, name, *args):
        if name == "endpoint_metrics":
            raise InterruptedError(name)
        super().write(df, name, *args)


@register
def ingest_batches(spark, sf_dir):
    """Three batches with copies across them: the second fails, the third and a compaction come first, then it is run
    again; then expiry, also with an earlier cutoff. Hits per day that stay, and hits in the roll-up."""
    root = shared_path(spark, "batches")
    tables = HitTables(spark, root).create()
    messages = written(fx.envelopes(spark, sf_dir), "messages")
    parts = [messages.where((F.col("n") + F.col("attempt")) % 3 == i).drop("n", "attempt") for i in range(3)]
    batch.ingest_batch(tables, parts[0], 0, NOW)
    try:
        batch.ingest_batch(_Interrupted(spark, root), parts[1], 1, NOW)
    except InterruptedError:
        pass
    batch.ingest_batch(tables, parts[2], 2, NOW)
    tables.compact()
    batch.ingest_batch(tables, parts[1], 1, NOW)
    tables.compact()
    tables.clean(ingest.wall_clock_ms(), grace_ms=-times.DAY_MS)  # nobody else reads these tables
    tables.expire(NOW, RETENTION)
    tables.expire(NOW, 2 * RETENTION)
    return _hits_by_day(tables)


def _messages_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages with the day of their event, null where it has none."""
    return written(fx.envelopes(spark, sf_dir).withColumn("day", F.get_json_object("value", "$.data.timestamp").cast("timestamp").cast("date")), "messages")


def _ingest(tables: HitTables, messages: DataFrame, batch_id: int) -> None:
    batch.ingest_batch(tables, messages.drop("n", "attempt", "day"), batch_id, NOW)


@register
def rerun_batches(spark, sf_dir):
    """A batch of two days fails ahead of its roll-up, another one brings the events of one of them, then the first is run
    again: raw hits and hits in the roll-up per day, as many as there are events."""
    root = shared_path(spark, "rerun")
    tables = HitTables(spark, root).create()
    messages = _messages_by_day(spark, sf_dir)
    day = F.coalesce(F.dayofmonth("day"), F.lit(0))
    twice = messages.where(day.isin(11, 12))
    _ingest(tables, messages.where((day < 11) & (F.col("n") % 3 == 0)), 0)
    try:
        _ingest(_Interrupted(spark, root), twice, 1)
    except InterruptedError:
        pass
    _ingest(tables, messages.where(day != 12), 2)
    _ingest(tables, twice, 1)
    tables.compact()
    return _hits_by_day(tables)


@register
def batch_runs(spark, sf_dir):
    """Failure runs across four batches that follow each other in time, of which the first three are merged on the way."""
    tables = HitTables(spark, shared_path(spark, "runs")).create()
    messages = _messages_by_day(spark, sf_dir)
    day = F.coalesce(F.dayofmonth("day"), F.lit(0))
    for number, (first, last) in enumerate([(0, 8), (9, 16), (17, 23), (24, 31)]):
        _ingest(tables, messages.where(day.between(first, last)), number)
        if number in (1, 2):
            tables.compact()
    return tables.failure_runs()


@register
def failure_runs(spark, sf_dir):
    hits = fx.hits(spark, sf_dir)
    return runs.failure_runs(hits, RUN_KEYS, ["hit_ts", "event_id"], values.is_error(F.col("status_code")))


@register
def poison_runs(spark, sf_dir):
    """Runs of messages that fail, per event type; what does not parse counts as unknown."""
    routed = _routed(spark, sf_dir)
    event_type = F.when(F.col("error").startswith("Message parsing failed"), "unknown").otherwise("API_HIT")
    # Range partitioning reads its input twice (once for the bounds): parse once, into a narrow table.
    outcomes = written(routed.select(event_type.alias("event_type"), "n", "attempt", "outcome"), "outcomes")
    return runs.failure_runs(outcomes, ["event_type"], ["n", "attempt"], F.col("outcome") != envelope.STORE)


# -- raw hits ------------------------------------------------------------------------------------------------


@register
def raw_find(spark, sf_dir):
    return raw_hits.find(fx.hits(spark, sf_dir), F.col("status_code") >= 400, skip=10)


@register
def raw_count(spark, sf_dir):
    return raw_hits.count(fx.hits(spark, sf_dir), F.col("status_code") >= 400)


@register
def retention_keep(spark, sf_dir):
    return raw_hits.kept(fx.hits(spark, sf_dir), raw_hits.cutoff_ms(NOW, RETENTION)).select("event_id", "hit_ts")


@register
def retention_count(spark, sf_dir):
    return raw_hits.expired_count(fx.hits(spark, sf_dir), raw_hits.cutoff_ms(NOW, RETENTION))


# -- registry ------------------------------------------------------------------------------------------------


@register
def clients_list(spark, sf_dir):
    return registry.list_clients(fx.clients(spark, sf_dir), F.col("is_active"))


@register
def client_by_slug(spark, sf_dir):
    return registry.find_by(fx.clients(spark, sf_dir), "slug", "nation_7")


@register
def key_owners(spark, sf_dir):
    """Bulk look-up: the keys that hits were reported with."""
    wanted = fx.hits(spark, sf_dir)
    return registry.public(registry.find_all_by(fx.api_keys(spark, sf_dir), "key_value", wanted)).select(
        "api_key_id", "client_id", "name")


@register
def users_active(spark, sf_dir):
    return registry.active_users(fx.users(spark, sf_dir))


@register
def keys_with_creator(spark, sf_dir):
    return registry.keys_with_creator(fx.api_keys(spark, sf_dir), fx.users(spark, sf_dir)).select(
        "api_key_id", "key_id", "client_id", "name", "environment", "is_active", "created_at", "creator_id",
        "creator_name", "creator_email")


@register
def keys_per_client(spark, sf_dir):
    return registry.keys_per_client(fx.api_keys(spark, sf_dir), fx.clients(spark, sf_dir))


@register
def registry_counts(spark, sf_dir):
    return registry.counts(fx.clients(spark, sf_dir), fx.api_keys(spark, sf_dir), fx.users(spark, sf_dir))


@register
def keys_live(spark, sf_dir):
    return registry.public(registry.live_keys(fx.api_keys(spark, sf_dir), at(NOW))).select(
        "api_key_id", "key_id", "expires_at")


@register
def key_expiry(spark, sf_dir):
    """Expiry of keys that were stored without one, and whether it has passed."""
    expires = times.key_expiry(F.lit(None).cast("timestamp"), F.col("created_at"))
    return fx.api_keys(spark, sf_dir).select("api_key_id", expires.alias("expires_at")).withColumn(
        "expired", times.is_expired(F.col("expires_at"), F.lit("2024-06-15 00:00:00").cast("timestamp")))


@register
def role_permissions(spark, sf_dir):
    return registry.effective_permissions(fx.users(spark, sf_dir))


@register
def slugs(spark, sf_dir):
    title = F.concat(F.lit(" - "), F.initcap("p_name"), F.lit("  & "), "p_brand", F.lit(" ("), "p_type", F.lit(") -"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", names.slug(title).alias("slug"))


@register
def registry_audit(spark, sf_dir):
    return registry.audit(fx.clients(spark, sf_dir), fx.api_keys(spark, sf_dir), fx.users(spark, sf_dir))


@register
def registry_duplicates(spark, sf_dir):
    """Unique columns of registry tables made of tables that repeat values."""
    clients = fx.table(spark, sf_dir, "customer").select(names.slug(F.col("c_mktsegment")).alias("slug"))
    keys = fx.table(spark, sf_dir, "part").select(
        F.concat("p_brand", F.lit("/"), "p_type").alias("key_id"), F.col("p_partkey").cast("string").alias("key_value"))
    users = fx.table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        F.concat("event_type", F.lit("@example.com")).alias("email"))
    return registry.duplicates(clients, keys, users)


# -- catalogue -----------------------------------------------------------------------------------------------


@register
def catalog_search(spark, sf_dir):
    return catalog.search(fx.posts(spark, sf_dir), F.col("doc_id"), author="SRC1", tag="The").select(
        "doc_id", "author", "lang", "n_chars")


@register
def parent_child_counts(spark, sf_dir):
    parents = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"))
    children = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("post_id"))
    return catalog.child_counts(parents, children, "post_id")


@register
def parent_children(spark, sf_dir):
    parents = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("post_id"), F.col("o_orderpriority").alias("title"))
    children = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("post_id"), F.col("l_linenumber").alias("comment_id"),
        F.col("l_returnflag").alias("content"))
    return catalog.with_children(parents, children, "post_id", "title")
