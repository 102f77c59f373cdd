"""Counters of a running stream: what each micro-batch made of its messages, and the totals since the listener was added."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import envelope

NAME = "outcomes"
FIELDS = ["messages", "sound", "failed", "retried", "dead_lettered"]


def observed(routed: DataFrame) -> DataFrame:
    """The routed messages, counted by outcome as they pass: no pass of their own.

    An executor that is lost in mid-batch may have its messages counted again; `batch_stats` holds the exact numbers.
    """
    def of(*outcomes: str) -> Column:
        return F.count_if(F.col("outcome").isin(*outcomes))

    return routed.observe(
        NAME, F.count("*").alias("messages"), of(envelope.STORE).alias("sound"), of(envelope.RETRY, envelope.DEAD).alias("failed"),
        of(envelope.RETRY).alias("retried"), of(envelope.DEAD).alias("dead_lettered"))


class OutcomeListener(StreamingQueryListener):
    """Adds up the counters of all streams of the session; add it with `spark.streams.addListener`."""

    def __init__(self):
        self._lock = Lock()
        self._totals = dict.fromkeys(FIELDS, 0)
        self._last: dict | None = None

    def totals(self) -> dict[str, int]:
        with self._lock:
            return dict(self._totals)

    def last_batch(self) -> dict | None:
        """Counters of the newest batch with messages, with its number and time; None before the first."""
        with self._lock:
            return dict(self._last) if self._last else None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is None or not row["messages"]:
            return
        counts = {f: row[f] for f in FIELDS}
        with self._lock:
            for f, n in counts.items():
                self._totals[f] += n
            self._last = counts | {"batch_id": event.progress.batchId, "at": event.progress.timestamp}

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
