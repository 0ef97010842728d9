"""Progress of streams as rows of the metrics table."""

from __future__ import annotations

import threading
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from gaugelake.operators.monitor import write_metrics

ROWS = "ts timestamp, name string, labels map<string,string>, series string, value double"


class MetricsListener(StreamingQueryListener):
    """Writes one sample of each metric after every micro-batch of every query of the session.

    Counters (``…_total``) add up what batches observed and start from zero with the listener, as a
    process's counters do; gauges are as the batch left them:

        messages_consumed_total, messages_failed_total   counters that ``start_ingest`` observes
        last_message_time                                epoch seconds
        open_state_rows, open_state_bytes                rows and memory of all stateful operators
        batch_rows, batch_seconds, batch_id              of the last batch

    A failed write must not end the stream: the batch's samples are lost and ``failed`` counts them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.failed = spark, path, 0
        self.totals: dict[tuple[str, str], float] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        try:
            with self.lock:
                write_metrics(self.rows(event.progress), self.path)
        except Exception:  # whatever storage or the session answers
            self.failed += 1

    def rows(self, progress) -> DataFrame:
        query = progress.name or str(progress.id)
        values: dict[str, float] = {}
        for observed in (progress.observedMetrics or {}).values():
            for name, value in observed.asDict().items():
                if name == "last_message_time":
                    if value is not None:
                        values[name] = value.replace(tzinfo=value.tzinfo or timezone.utc).timestamp()
                elif isinstance(value, (int, float)):
                    key = (query, f"{name}_total")
                    self.totals[key] = self.totals.get(key, 0.0) + value
                    values[key[1]] = self.totals[key]
        values |= {
            "open_state_rows": sum(s.numRowsTotal for s in progress.stateOperators),
            "open_state_bytes": sum(s.memoryUsedBytes for s in progress.stateOperators),
            "batch_rows": progress.numInputRows, "batch_seconds": progress.batchDuration / 1000, "batch_id": progress.batchId,
        }
        at = datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00"))
        return self.spark.createDataFrame(
            [(at, name, {"query": query}, f"query={query}", float(value)) for name, value in sorted(values.items())], ROWS).coalesce(1)


def record_progress(spark: SparkSession, path: str) -> MetricsListener:
    """Add a listener that writes to the metrics table at ``path``; ``spark.streams.removeListener`` ends it."""
    listener = MetricsListener(spark, path)
    spark.streams.addListener(listener)
    return listener
