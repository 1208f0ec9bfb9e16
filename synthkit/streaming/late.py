"""Late rows of a streaming query over all its batches and restarts.

The engine reports each batch once it is complete.  :class:`LateRows` listens to these reports and keeps one small file
for each batch that dropped rows, named by the batch, in a folder beside the checkpoint.  The query's id is part of the
checkpoint, so a restarted query goes on counting, and a batch that is run again replaces its own number.
"""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


class LateRows(StreamingQueryListener):
    """Counts rows dropped behind the watermark, for every query that runs inside ``with LateRows(spark, folder) as late``.

    ``folder`` is beside the checkpoint, in shared storage.  Counted where the state store sees them: for a windowed
    aggregate that is one row per late (window, key) partial aggregate; for dedup, input rows.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()
        self._failed: Exception | None = None

    def __enter__(self):
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_):
        self.spark.streams.removeListener(self)

    def _end(self, run_id) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        dropped = sum(op.numRowsDroppedByWatermark or 0 for op in p.stateOperators)
        if dropped:
            try:
                _write_text(self.spark, f"{self.folder}/{p.id}/batch-{p.batchId}", str(dropped))
            except Exception as e:  # reported by total(): the listener's own thread would only log it
                self._failed = e

    def onQueryTerminated(self, event):
        self._end(event.runId).set()

    def total(self, q: StreamingQuery, timeout: float = 60.0) -> int:
        """Late rows of the query since its first start.  Reports arrive in order and end with the query's end, which
        is waited for when the query has stopped."""
        if not q.isActive and not self._end(q.runId).wait(timeout):
            raise TimeoutError("the query's last reports have not arrived")
        if self._failed:
            raise RuntimeError("a batch's late rows could not be written") from self._failed
        path = f"{self.folder}/{q.id}"
        if not path_exists(self.spark, path):
            return 0
        return self.spark.read.text(path).agg(F.sum(F.col("value").cast("bigint"))).first()[0] or 0
