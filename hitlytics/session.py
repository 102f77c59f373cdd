"""Session settings and shared-folder paths."""

from __future__ import annotations

import re
import tempfile
from functools import cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Runtime settings the results depend on (time zone, JSON duplicates: last one wins) and the feature the plans count on,
# adaptive execution. Cluster sizing is left to the deployment.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Readers skip row groups by time.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="hitlytics-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share.

    Only a local session without the setting, as in tests, gets a folder of its own.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master")):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that every executor can reach")
        base = _own_folder()
    return f"{base.rstrip('/')}/hitlytics/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage through a table in the shared folder; its files give the optimizer a real size."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
