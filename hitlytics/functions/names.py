"""Slugs, roles and registry patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLIENT_ADMIN, ROLES, SUPER_ADMIN

# Formats the registry accepts.
SLUG = "^[a-z0-9-]+$"
IP_OR_RANGE = r"^([0-9]{1,3}\.){3}[0-9]{1,3}(/[0-9]{1,2})?$"
ORIGIN = r"^https?://[^\s]+$"
USERNAME = "^[a-zA-Z0-9_.-]+$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def slug(name: Column) -> Column:
    """Lower-case words joined by single hyphens."""
    kept = F.regexp_replace(F.lower(name), r"[^a-z0-9\s-]", "")
    hyphens = F.regexp_replace(kept, r"[\s-]+", "-")
    return F.regexp_replace(hyphens, "^-|-$", "")


def role_permissions(role: Column) -> Column:
    """What a role may do when no explicit grant is stored; null for unknown roles."""
    full = role.isin(SUPER_ADMIN, CLIENT_ADMIN)
    return F.when(role.isin(ROLES), F.struct(
        full.alias("can_create_api_keys"),
        full.alias("can_manage_users"),
        F.lit(True).alias("can_view_analytics"),
        full.alias("can_export_data"),
    ))
