"""Whose metrics a user may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_object_id, missing
from ..schema import SUPER_ADMIN

ALL_CLIENTS = "*"

# Refusal texts of the service.
FORBIDDEN = "Insufficient permissions to view analytics"
NO_CLIENT = "Access denied - no client association"
BAD_CLIENT = "Invalid client association"
UNKNOWN_CLIENT = "Client not found"
BAD_CLIENT_ID = "Invalid clientId format"


def resolve(users: DataFrame, clients: DataFrame) -> DataFrame:
    """Scope of every user: adds `scope` (`*` or a client id) or `scope_error`.

    Super administrators see everything, or the client named in an optional `requested_client_id` column.
    Others need the analytics permission and see their own client, which must exist.
    """
    if "requested_client_id" not in users.columns:
        users = users.withColumn("requested_client_id", F.lit(None).cast("string"))
    is_admin = F.col("role") == SUPER_ADMIN
    wanted = F.when(is_admin, F.nullif("requested_client_id", F.lit(""))).otherwise(F.col("client_id"))
    known = clients.select(F.col("client_id").alias("_wanted"), F.lit(True).alias("_known"))
    joined = users.withColumn("_wanted", wanted).join(known, "_wanted", "left")
    error = (
        F.when(is_admin & F.col("_wanted").isNull(), F.lit(None).cast("string"))
        .when(is_admin & ~is_object_id(F.col("_wanted")), BAD_CLIENT_ID)
        .when(~is_admin & ~F.coalesce("can_view_analytics", F.lit(False)), FORBIDDEN)
        .when(missing(F.col("_wanted")), NO_CLIENT)
        .when(~is_object_id(F.col("_wanted")), BAD_CLIENT)
        .when(F.col("_known").isNull(), UNKNOWN_CLIENT)
    )
    return (
        joined.withColumn("scope_error", error)
        .withColumn("scope", F.when(F.col("scope_error").isNull(), F.coalesce("_wanted", F.lit(ALL_CLIENTS))))
        .drop("_wanted", "_known", "requested_client_id")
    )
