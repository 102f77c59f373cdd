"""Representative inputs derived from the benchmark tables: hits, registry and queue messages.

`FIXTURES.md` defines the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import epoch_ms
from ..session import configure

NOW_MS = epoch_ms("2024-01-31T00:00:00Z")


SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_returnflag STRING, "
                "l_linestatus STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spreads an input of fewer splits than cores, ahead of costly work per row; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.select(key)._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores, key) if splits < cores else df


def _hex_id(number: Column, pad: str) -> Column:
    return F.lpad(number.cast("string"), 24, pad)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits_of(table(spark, sf_dir, "events"))


def _hits_of(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    last = F.col("k") % 10
    method = (
        F.when(last < 5, "GET").when(last < 7, "POST").when(last == 7, "PUT").when(last == 8, "PATCH")
        .otherwise("DELETE"))
    status = F.when(F.col("event_type") == "error", 500).when(F.col("k") % 20 == 0, 404).otherwise(200)
    return events.withColumn("k", k).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("hit_ts"),
        F.col("event_type").alias("service_name"),
        F.concat(F.lit("/"), "event_type", F.lit("/"), last.cast("string")).alias("endpoint"),
        method.alias("method"),
        status.alias("status_code"),
        F.col("value").cast("decimal(10,3)").alias("latency_ms"),
        _hex_id(F.col("user_id") % 25, "0").alias("client_id"),
        F.concat(F.lit("apim_"), (F.col("user_id") % 120).cast("string")).alias("key_value"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("ip"))


def stored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits as the raw table would hold them."""
    return hits(spark, sf_dir).select(
        "event_id", "hit_ts", "service_name", "endpoint", "method",
        F.col("status_code").cast("double").alias("status_code"),
        F.col("latency_ms").cast("double").alias("latency_ms"),
        "client_id", F.lpad("event_id", 24, "c").alias("api_key_id"), "ip", F.lit("").alias("user_agent"))


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        _hex_id(key, "0").alias("client_id"),
        F.col("n_name").alias("name"),
        F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))).alias("slug"),
        F.concat(F.lower("n_name"), F.lit("@example.com")).alias("email"),
        F.lit("").alias("description"),
        (key % 7 != 6).alias("is_active"),
        F.when(key % 9 == 3, 5).otherwise(30).alias("retention_days"),
        F.when(key % 8 != 5, _hex_id(key, "b")).alias("created_by"),
        (F.lit("2023-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(key)).alias("created_at"))


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    text = key.cast("string")
    return table(spark, sf_dir, "supplier").select(
        _hex_id(key, "a").alias("api_key_id"),
        F.concat(F.lit("key-"), text).alias("key_id"),
        F.concat(F.lit("apim_"), text).alias("key_value"),
        _hex_id(F.col("s_nationkey"), "0").alias("client_id"),
        F.col("s_name").alias("name"),
        F.lit("").alias("description"),
        F.when(key % 13 == 5, "sandbox").otherwise("production").alias("environment"),
        (F.col("s_acctbal") >= 0).alias("is_active"),
        (key % 10 != 3).alias("can_ingest"),
        F.array(F.concat(F.lit("10.1."), (key % 256).cast("string"),
                         F.when(key % 6 == 0, "").otherwise(".0/16"))).alias("allowed_ips"),
        F.array(F.when(key % 8 == 0, "*").when(key % 8 == 1, "ftp://example.com")
                .otherwise("https://example.com")).alias("allowed_origins"),
        F.lit("").alias("purpose"),
        F.array(F.repeat(F.lit("t"), (key % 60).cast("int"))).alias("tags"),
        _hex_id(key * 20, "b").alias("created_by"),
        (F.lit("2023-06-01 00:00:00").cast("timestamp") + F.make_dt_interval(key.cast("int"))).alias("created_at"),
        F.when(key % 5 == 1, F.lit("2024-01-15 00:00:00").cast("timestamp"))
        .otherwise(F.lit("2025-01-01 00:00:00").cast("timestamp")).alias("expires_at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    username = F.lower(F.replace("c_name", F.lit("#"), F.lit("_")))
    admin = key % 50 == 0
    return table(spark, sf_dir, "customer").select(
        _hex_id(key, "b").alias("user_id"),
        username.alias("username"),
        F.concat(username, F.lit("@example.com")).alias("email"),
        F.concat(F.lit("$2a$10$"), key.cast("string")).alias("password"),
        F.when(admin, "super_admin").when(key % 5 == 0, "client_admin").otherwise("client_viewer").alias("role"),
        F.when(~admin, _hex_id(F.col("c_nationkey"), "0")).alias("client_id"),
        (key % 11 != 0).alias("can_view_analytics"),
        (F.col("c_acctbal") >= 0).alias("is_active"))


def raw_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty payloads, all text."""
    case = F.col("event_id").cast("long") % 40

    def spoiled(column: str, faults: dict[int, str | None]) -> Column:
        value = F.col(column).cast("string")
        branches = None
        for number, fault in faults.items():
            bad = F.lit(fault).cast("string")
            branches = F.when(case == number, bad) if branches is None else branches.when(case == number, bad)
        return branches.otherwise(value).alias(column)

    method = (
        F.when(case == 0, "").when(case == 6, "FETCH").when(case == 7, F.lower("method"))
        .when(case == 9, F.lit(None).cast("string")).otherwise(F.col("method")))
    return hits(spark, sf_dir).select(
        "event_id",
        spoiled("service_name", {5: None}),
        spoiled("endpoint", {9: ""}),
        method.alias("method"),
        spoiled("status_code", {1: "abc", 2: "99", 3: "600", 10: " 200 ", 11: "200d"}),
        spoiled("latency_ms", {4: "-1", 8: "", 12: "1e2"}),
        "client_id", "key_value", "ip", F.col("hit_ts").alias("received_at"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue messages with faults: broken, mistyped, incomplete, repeated and retried ones."""
    events = spread(table(spark, sf_dir, "events"), "event_id")
    source = _hits_of(events).withColumn("n", F.col("event_id").cast("long"))
    fault = F.col("n") % 50
    copies = source.withColumn("attempt", F.explode(
        F.when(fault == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    # The date-time text drops trailing zeros of the fraction, as a cast does.
    stamp = F.concat(F.replace(F.col("hit_ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    data = F.concat(
        F.lit('{"eventId":"'), "event_id", F.lit('","timestamp":"'), stamp,
        F.lit('","serviceName":"'), "service_name", F.lit('","endpoint":"'), "endpoint",
        F.lit('","method":"'), F.when(fault == 5, F.lower("method")).otherwise(F.col("method")),
        F.lit('","statusCode":'), F.col("status_code").cast("string"),
        F.lit(',"latencyMs":'), F.col("latency_ms").cast("string"),
        F.lit(',"clientId":"'), F.when(fault == 4, "zzz").otherwise(F.col("client_id")), F.lit('"'),
        F.when(fault == 3, "").otherwise(
            F.concat(F.lit(',"apiKeyId":"'), F.lpad("event_id", 24, "c"), F.lit('"'))),
        F.lit(',"ip":"'), "ip", F.lit('","userAgent":""}'))
    body = F.concat(
        F.lit('{"type":"'), F.when(fault == 1, "OTHER").otherwise("API_HIT"), F.lit('","data":'),
        F.when(fault == 2, "[]").otherwise(data), F.lit(',"attempt":'), F.col("attempt").cast("string"), F.lit("}"))
    return copies.select(
        F.when(fault == 0, "{bad").otherwise(body).alias("value"),
        F.when(fault != 6, F.col("event_id")).alias("message_id"),
        F.when(fault == 8, 3).otherwise(0).alias("retry_count"),
        "n", "attempt")


# Failure texts and codes a delivery attempt may report.
FAILURES = [
    ("Channel closed by server", None),
    ("Connection closed: CONNECTION_FORCED", None),
    ("read ECONNRESET", "ECONNRESET"),
    ("connect failed", "ECONNREFUSED"),
    ("socket hang up", "etimedout"),
    ("Buffer full, waiting for drain", None),
    ("Heartbeat timeout", None),
    ("Service not available", None),
    ("Server connection closed", None),
    ("getaddrinfo failed", "ENOTFOUND"),
    ("E11000 duplicate key", "11000"),
    ("Validation failed", None),
    (None, None),
]


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with the failure its delivery reported."""
    texts = F.array(*[F.lit(m).cast("string") for m, _ in FAILURES])
    codes = F.array(*[F.lit(c).cast("string") for _, c in FAILURES])
    case = (F.col("event_id") % len(FAILURES)).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("message_id"),
        F.get(texts, case).alias("error_message"),
        F.get(codes, case).alias("error_code"),
        (F.col("user_id") % 5).cast("int").alias("retry_count"),
        F.col("props").alias("value"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("author"), F.split("text", " ").alias("tags"), "lang", "n_chars")
