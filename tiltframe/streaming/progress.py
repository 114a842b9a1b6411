"""Progress sink of a streaming run: one row per micro-batch with input
rows (``StreamingQueryListener.onQueryProgress``), plus the running total."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class ProgressListener(StreamingQueryListener):
    """Collects (query name, batch id, input rows) of every progress event.
    Register with ``spark.streams.addListener``; rows are few (one per
    trigger)."""

    def __init__(self):
        self._rows: list[tuple[str, int, int]] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        with self._lock:
            self._rows.append((p.name or str(p.id), int(p.batchId), int(p.numInputRows)))

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """``query, batch_id, n_batch, n_total`` (running total per query)."""
        with self._lock:
            rows = sorted(self._rows, key=lambda r: (r[0], r[1]))
        out, run = [], {}
        for q, b, n in rows:
            run[q] = run.get(q, 0) + n
            out.append((q, b, n, run[q]))
        return spark.createDataFrame(out, "query string, batch_id bigint, n_batch bigint, n_total bigint")
