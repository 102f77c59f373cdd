"""Admission of reported hits: key check, quota, validation, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times, values
from ..functions.staging import computed_once
from ..schema import QUOTA_REQUESTS, QUOTA_WINDOW_SECONDS
from ..session import written
from .lookup import one_per
from .quota import QUOTA_MESSAGE, flag_over_quota

# Refusal texts of the service.
NO_KEY = "API key is required"
BAD_KEY = "Invalid API key"
INACTIVE_CLIENT = "Client account is inactive"
NO_INGEST = "API key does not have ingest permissions"

# Required payload fields, in reporting order: column -> public name.
REQUIRED = {
    "service_name": "serviceName",
    "endpoint": "endpoint",
    "method": "method",
    "status_code": "statusCode",
    "latency_ms": "latencyMs",
    "client_id": "clientId",
}


def key_directory(keys: DataFrame, clients: DataFrame) -> DataFrame:
    """Active keys with the state of their client: one row per key value."""
    active = one_per(
        keys.where("is_active").select("key_value", "api_key_id", "client_id", "can_ingest", "expires_at"),
        ["key_value"], ["api_key_id"])
    owners = clients.select("client_id", F.lit(True).alias("_known"), F.col("is_active").alias("_client_active"))
    return active.join(owners, "client_id", "left")


def check_keys(hits: DataFrame, keys: DataFrame, clients: DataFrame) -> DataFrame:
    """Resolves each hit's API key; adds `reject_reason` (null when accepted).

    The payload's own `client_id` and `api_key_id` are replaced by those of the key. Expiry is judged at the
    time the hit was received.
    """
    claims = [c for c in ("client_id", "api_key_id") if c in hits.columns]
    joined = hits.drop(*claims).join(key_directory(keys, clients), "key_value", "left")
    expired = times.is_expired(F.col("expires_at"), F.col("received_at"))
    reason = (
        F.when(values.missing(F.col("key_value")), NO_KEY)
        .when(F.col("_known").isNull() | expired, BAD_KEY)
        .when(~F.coalesce("_client_active", F.lit(False)), INACTIVE_CLIENT)
        .when(~F.coalesce("can_ingest", F.lit(False)), NO_INGEST)
    )
    return joined.withColumn("reject_reason", reason).drop("can_ingest", "expires_at", "_known", "_client_active")


def validate(hits: DataFrame) -> DataFrame:
    """Adds `error`: the first failed payload check as text, null for a valid payload."""
    absent = F.concat_ws(",", *[
        F.when(values.missing(F.col(column)), F.lit(name)) for column, name in REQUIRED.items()])
    status, latency = F.col("_status"), F.col("_latency")
    error = (
        F.when(absent != "", F.concat(F.lit("Missing required fields: "), absent))
        .when(values.http_method(F.col("method")).isNull(),
              F.concat(F.lit("Invalid HTTP methods: "), "method", F.lit(" ")))
        .when(F.coalesce(~status.between(100, 599), F.lit(True)),
              F.concat(F.lit("Invalid Status code : "), "status_code", F.lit(" ")))
        .when(F.coalesce(latency < 0, F.lit(True)),
              F.concat(F.lit("Invalid latency : "), "latency_ms", F.lit(" ")))
    )
    numbers = {
        "_status": values.to_number(F.col("status_code")), "_latency": values.to_number(F.col("latency_ms"))}
    return computed_once(hits, numbers).withColumn("error", error).drop(*numbers)


def stamp(payloads: DataFrame) -> DataFrame:
    """Gives payloads without an id or a receipt time both of them, and writes the result.

    Random ids change when a plan runs again, so they are fixed in a table before anything uses them.
    """
    columns = {"event_id": values.new_event_id(), "received_at": F.current_timestamp()}
    stamped = payloads.withColumns({
        name: F.coalesce(F.col(name), fresh) if name in payloads.columns else fresh
        for name, fresh in columns.items()})
    return written(stamped, "stamped-payloads")


def normalise(valid: DataFrame) -> DataFrame:
    """Typed hit of a valid payload; id and time are those of its admission."""
    def given(name: str) -> Column:
        return F.col(name) if name in valid.columns else F.lit(None).cast("string")

    return valid.select(
        "event_id",
        F.col("received_at").alias("hit_ts"),
        "service_name", "endpoint",
        values.http_method(F.col("method")).alias("method"),
        values.to_number(F.col("status_code")).alias("status_code"),
        values.to_number(F.col("latency_ms")).alias("latency_ms"),
        "client_id",
        given("api_key_id").alias("api_key_id"),
        values.default_text(given("ip"), "unknown").alias("ip"),
        values.default_text(given("user_agent"), "").alias("user_agent"),
    )


def admit(
    payloads: DataFrame,
    keys: DataFrame,
    clients: DataFrame,
    quota: int = QUOTA_REQUESTS,
    window_seconds: int = QUOTA_WINDOW_SECONDS,
) -> DataFrame:
    """All checks in service order: key, then quota (bad payloads use it up, bad keys do not), then payload.

    Adds `reject_reason`, null for accepted payloads.
    """
    checked = check_keys(payloads, keys, clients)
    limited = flag_over_quota(checked, quota, window_seconds, eligible=F.col("reject_reason").isNull())
    return validate(limited).withColumn(
        "reject_reason",
        F.coalesce("reject_reason", F.when(F.col("over_quota"), QUOTA_MESSAGE), "error"),
    ).drop("over_quota", "error")


def accepted(admitted: DataFrame) -> DataFrame:
    return normalise(admitted.where(F.col("reject_reason").isNull()))
