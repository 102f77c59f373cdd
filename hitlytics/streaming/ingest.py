"""Streaming ingestion: queue messages into the tables, each event effectively once.

Spark's checkpoint delivers every message at least once; batches write idempotently, and events already in the raw
table are skipped. There is no watermark: a late hit of any age still reaches its bucket.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import envelope
from ..plans.batch import ingest_routed
from ..schema import DEFAULT_QUEUE, MAX_RETRIES
from ..session import configure
from ..sources import queue
from ..sources.tables import HitTables
from . import counters


def wall_clock_ms() -> int:
    return int(time.time() * 1000)


def start(
    spark: SparkSession,
    queue_path: str,
    root: str,
    checkpoint: str,
    fmt: str = "parquet",
    max_bytes: int = queue.MAX_BYTES,
    max_files: int | None = None,
    trigger: dict | None = None,
    with_retries: bool = False,
    max_retries: int = MAX_RETRIES,
    queue_name: str = DEFAULT_QUEUE,
    clock: Callable[[], int] = wall_clock_ms,
) -> StreamingQuery:
    """Starts the stream. One root belongs to one checkpoint: batch numbers must not start again.

    `max_bytes` of queue files make a micro-batch, or `max_files` if given. Progress reports carry the outcomes of each
    batch under `counters.NAME`. `with_retries` has retried messages come round again once they are due (parquet queues only):
    those due when the stream starts and after each of its batches; an idle stream needs `release_due` to be called.
    """
    configure(spark)
    tables = HitTables(spark, root).create()
    if with_retries:
        tables.release_due(clock())
    paths = [queue_path, tables.path("released")] if with_retries else [queue_path]
    messages = queue.read_stream(spark, *paths, fmt=fmt, max_bytes=max_bytes, max_files=max_files)
    routed = counters.observed(envelope.route(messages, max_retries))

    def process(batch: DataFrame, batch_id: int) -> None:
        own = HitTables(batch.sparkSession, root)
        ingest_routed(own, batch, batch_id, clock(), queue_name)
        if with_retries:
            own.release_due(clock())

    return (
        routed.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run(spark: SparkSession, *args, **options) -> HitTables:
    """Takes in everything that is in the queue now, then returns the tables."""
    query = start(spark, *args, **options)
    query.awaitTermination()
    return HitTables(spark, args[1] if len(args) > 1 else options["root"])
