"""Small frames and their plans."""

import contextlib
import io
from datetime import datetime, timedelta, timezone

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return EPOCH + timedelta(seconds=seconds)


def hex_id(n: int) -> str:
    return f"{n:024x}"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()
