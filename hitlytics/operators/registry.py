"""Clients, API keys and users: listings, look-ups, counts and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, values
from ..schema import CLIENT_VIEWER, ENVIRONMENTS, ROLES, SUPER_ADMIN

SECRETS = ["password", "key_value"]
CLIENT_PAGE = 50


def public(df: DataFrame) -> DataFrame:
    """Without secrets."""
    return df.drop(*SECRETS)


def list_clients(clients: DataFrame, *predicates: Column, limit: int = CLIENT_PAGE, skip: int = 0) -> DataFrame:
    """Newest clients first."""
    for predicate in predicates:
        clients = clients.where(predicate)
    return clients.orderBy(F.col("created_at").desc(), "client_id").offset(skip).limit(limit)


def find_by(df: DataFrame, column: str, value: str) -> DataFrame:
    """The row with an exact value in a unique column."""
    return df.where(F.col(column) == value).limit(1)


def find_all_by(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Bulk look-up: the rows whose unique column occurs in `wanted`."""
    return df.join(wanted.select(column).distinct(), column, "left_semi")


def active_users(users: DataFrame) -> DataFrame:
    return public(users.where("is_active"))


def keys_with_creator(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Keys without their secret, with the creator's name and address (empty when unknown), newest first."""
    creators = users.select(
        F.col("user_id").alias("created_by"), F.col("username").alias("creator_name"),
        F.col("email").alias("creator_email"))
    joined = public(keys).join(creators, "created_by", "left")
    return joined.withColumns({
        "creator_id": F.when(F.col("creator_name").isNull(), "").otherwise(F.col("created_by")),
        "creator_name": F.coalesce("creator_name", F.lit("")),
        "creator_email": F.coalesce("creator_email", F.lit("")),
    }).drop("created_by").orderBy(F.col("created_at").desc(), "api_key_id")


def keys_per_client(keys: DataFrame, clients: DataFrame) -> DataFrame:
    """Number of keys and of active keys of every client, zero included."""
    counted = keys.groupBy("client_id").agg(
        F.count("*").alias("keys"), F.count_if("is_active").alias("active_keys"))
    return clients.select("client_id").join(counted, "client_id", "left").na.fill(0, ["keys", "active_keys"])


def counts(clients: DataFrame, keys: DataFrame, users: DataFrame) -> DataFrame:
    """Rows per registry table."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("documents")).select(F.lit(name).alias("collection"), "documents")

    return counted(clients, "clients").unionByName(counted(keys, "api_keys")).unionByName(counted(users, "users"))


def live_keys(keys: DataFrame, now: Column) -> DataFrame:
    """Keys that have not run out; those without an expiry stay."""
    return keys.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def effective_permissions(users: DataFrame) -> DataFrame:
    """What each user's role allows; users without a role are viewers."""
    role = F.coalesce("role", F.lit(CLIENT_VIEWER))
    return users.select("user_id", role.alias("role"), names.role_permissions(role).alias("_p")).select(
        "user_id", "role", "_p.*")


def _too_long(c: str, limit: int) -> Column:
    return F.length(F.col(c)) > limit


def _out_of_pattern(c: str, pattern: str) -> Column:
    return ~F.col(c).rlike(pattern)


def _absent(c: str) -> Column:
    return values.missing(F.col(c).cast("string"))


# Fields that must be given.
REQUIRED = {
    "clients": ["name", "slug", "email", "is_active", "created_by"],
    "api_keys": ["key_id", "key_value", "client_id", "name", "created_by"],
    "users": ["username", "email", "password"],
}

CLIENT_RULES = {
    "name length must be 3 to 100": lambda: ~F.length(F.trim("name")).between(3, 100),
    "slug has an invalid format": lambda: _out_of_pattern("slug", names.SLUG),
    "description is longer than 500": lambda: _too_long("description", 500),
    "retention must be 7 to 365 days": lambda: ~F.col("retention_days").between(7, 365),
}

KEY_RULES = {
    "name is longer than 100": lambda: _too_long("name", 100),
    "description is longer than 500": lambda: _too_long("description", 500),
    "environment is unknown": lambda: ~F.col("environment").isin(ENVIRONMENTS),
    "allowed address has an invalid format": lambda: ~F.forall(
        "allowed_ips", lambda v: v.rlike(names.IP_OR_RANGE)),
    "allowed origin has an invalid format": lambda: ~F.forall(
        "allowed_origins", lambda v: v.rlike(names.ORIGIN) | (v == "*")),
    "purpose is longer than 200": lambda: _too_long("purpose", 200),
    "tag is longer than 50": lambda: F.exists("tags", lambda v: F.length(F.trim(v)) > 50),
}

USER_RULES = {
    "username is shorter than 3": lambda: F.length(F.trim("username")) < 3,
    "username has an invalid format": lambda: _out_of_pattern("username", names.USERNAME),
    "email has an invalid format": lambda: _out_of_pattern("email", names.EMAIL),
    "role is unknown": lambda: ~F.col("role").isin(ROLES),
    "role needs a client": lambda: (F.coalesce("role", F.lit(CLIENT_VIEWER)) != SUPER_ADMIN) & F.col("client_id").isNull(),
}


def _violations(df: DataFrame, table: str, id_column: str, rules: dict) -> DataFrame:
    # A column that is not there at all is absent in every row.
    absent = [F.when(_absent(c) if c in df.columns else F.lit(True), F.lit(f"{c} is required")) for c in REQUIRED[table]]
    broken = F.array_compact(F.array(*absent, *[F.when(rule(), F.lit(text)) for text, rule in rules.items()]))
    return df.select(
        F.lit(table).alias("table_name"), F.col(id_column).alias("row_id"), F.explode(broken).alias("rule"))


def audit(clients: DataFrame, keys: DataFrame, users: DataFrame) -> DataFrame:
    """One row per broken rule; one pass over each table."""
    return (
        _violations(clients, "clients", "client_id", CLIENT_RULES)
        .unionByName(_violations(keys, "api_keys", "api_key_id", KEY_RULES))
        .unionByName(_violations(users, "users", "user_id", USER_RULES))
    )


def duplicates(clients: DataFrame, keys: DataFrame, users: DataFrame) -> DataFrame:
    """Values that occur more than once in a unique column.

    Key values are secret: they are reported by their digest.
    """
    def repeated(df: DataFrame, table: str, column: str) -> DataFrame:
        shown = F.sha2(column, 256) if column in SECRETS else F.col(column)
        return (
            df.groupBy(column).agg(F.count("*").alias("copies")).where("copies > 1")
            .select(F.lit(table).alias("table_name"), F.lit(column).alias("field"), shown.alias("value"), "copies")
        )

    return (
        repeated(clients, "clients", "slug")
        .unionByName(repeated(keys, "api_keys", "key_id"))
        .unionByName(repeated(keys, "api_keys", "key_value"))
        .unionByName(repeated(users, "users", "username"))
        .unionByName(repeated(users, "users", "email"))
    )
