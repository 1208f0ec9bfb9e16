"""Streaming profiles, sessions, dedup, drift and PII.

Event time must be ``timestamp`` for watermarks (``timestamp_ntz`` is
rejected), so :func:`events_stream` casts it (the session time zone is UTC in
our sessions) and outputs cast back.  Results are written by a file sink in
append mode, or batch by batch into a folder per batch id; with the same
folders a restarted query resumes exactly once.  :func:`run_to_table` drains
the available input (``availableNow``) and returns the sink as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from synthkit.operators.validate import PII_PATTERNS
from synthkit.session import folders_named, scratch_dir
from synthkit.streaming.late import path_exists


def events_stream(spark: SparkSession, path: str, schema: str, ts: str = "ts", glob: str | None = None,
                  max_files: int | None = None) -> DataFrame:
    """File stream (the tested stand-in for Kafka) with event time cast to ``timestamp``.

    ``glob`` names files in ``path``, or folders in it: these are read with all their files.
    """
    r = spark.readStream.schema(schema).format("parquet")
    if glob and folders_named(spark, path, glob):
        path = path.rstrip("/") + "/" + glob
    elif glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    sdf = r.load(path)
    return sdf.withColumn(ts, F.col(ts).cast("timestamp")) if ts else sdf


def run_to_table(sdf: DataFrame, name: str = "stream", mode: str = "append", process=None, keys: list[str] | None = None,
                 out: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Drain the stream into parquet; returns (result, finished query).

    ``out`` and ``checkpoint`` are the caller's folders, so a later call goes on
    where this one stopped; without them both are new under the scratch dir.
    ``process(batch_df, batch_id) -> DataFrame`` uses ``foreachBatch``.  With
    ``keys`` the query runs in update mode and the result holds the newest row of
    each key, so windows that the watermark has not closed are delivered too.
    Both write one folder per batch id and overwrite it, so a batch that is
    replayed after a failure is not written twice.
    """
    spark = sdf.sparkSession
    out = out or scratch_dir(spark, name + "-out")
    w = sdf.writeStream.option("checkpointLocation", checkpoint or scratch_dir(spark, name + "-ckpt")).trigger(availableNow=True)
    if process is None and keys is None:
        q = w.outputMode(mode).format("parquet").option("path", out).start()
    else:
        def sink(batch, batch_id):
            rows = process(batch, batch_id) if process else batch
            rows.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")
        q = w.outputMode("update" if keys else mode).foreachBatch(sink).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    if not path_exists(spark, out):  # nothing has arrived: no batch has run
        if process:
            raise ValueError("no input, so the result's columns are not known")
        return spark.createDataFrame([], sdf.schema), q
    if process is None and keys is None:
        return spark.read.schema(sdf.schema).parquet(out), q
    rows = spark.read.option("basePath", out).parquet(f"{out}/_batch=*")
    if keys:
        names = [c for c in rows.columns if c != "_batch"]
        newest = F.max_by(F.struct(*names), "_batch")
        rows = rows.groupBy(*[F.col(k).alias("_k" + k) for k in keys]).agg(newest.alias("r")).select("r.*")
    return rows.drop("_batch"), q


def _ntz(c):
    return F.col(c).cast("timestamp_ntz")


def stream_profile(sdf: DataFrame, ts: str, by: str, value: str, size: str = "1 day",
                   delay: str = "2 days", slide: str | None = None) -> DataFrame:
    """Per event-time window and ``by``: count, mean, min, max of ``value`` (append on watermark)."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    agg = (sdf.withWatermark(ts, delay).groupBy(win.alias("w"), by)
           .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"),
                F.max(value).alias("max")))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("w.end").cast("timestamp_ntz").alias("window_end"), by, "n", "mean", "min", "max")


def stream_sliding(sdf: DataFrame, ts: str, by: str, value: str, size: str = "2 days", slide: str = "1 day",
                   delay: str = "2 days") -> DataFrame:
    return stream_profile(sdf, ts, by, value, size, delay, slide)


def stream_sessions(sdf: DataFrame, ts: str, user: str, gap: str = "6 hours", delay: str = "1 day") -> DataFrame:
    """Activity sessions per user: a session closes after ``gap`` without events."""
    s = (sdf.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), user)
         .agg(F.count(F.lit(1)).alias("n")))
    return s.select(user, F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "n")


def open_sessions(closed: DataFrame, checkpoint: str, user: str) -> DataFrame:
    """Sessions of a :func:`stream_sessions` query that the watermark has not closed, from its last committed state."""
    spark = closed.sparkSession
    if not path_exists(spark, checkpoint + "/state"):  # no batch has run
        return closed.limit(0)
    s = spark.read.format("statestore").load(checkpoint).select("value.*")
    return s.select(user, F.col("session_window.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("session_window.end").cast("timestamp_ntz").alias("session_end"), F.col("count").alias("n"))


def sessions_so_far(sdf: DataFrame, ts: str, user: str, gap: str = "6 hours", delay: str = "1 day", out: str | None = None,
                    checkpoint: str | None = None) -> tuple[DataFrame, StreamingQuery]:
    """Drain the stream; every session so far, with ``open`` true for those that later events may still extend.

    Closed sessions are appended to ``out`` (session windows have no update mode); open ones are read from the
    state of the last batch, which holds a session exactly until it is delivered.
    """
    spark = sdf.sparkSession
    checkpoint = checkpoint or scratch_dir(spark, "sessions-ckpt")
    closed, q = run_to_table(stream_sessions(sdf, ts, user, gap, delay), "sessions", out=out, checkpoint=checkpoint)
    still = open_sessions(closed, checkpoint, user)
    return closed.withColumn("open", F.lit(False)).unionByName(still.withColumn("open", F.lit(True))), q


def stream_dedup(sdf: DataFrame, keys: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Drop repeats of ``keys`` seen within the watermark delay (state is bounded by the delay)."""
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_pii(sdf: DataFrame, text_cols: list[str]) -> DataFrame:
    """Stateless: rows whose text holds personal data, with the kinds found."""
    kinds = F.array_compact(F.array(*[F.when(F.col(c).rlike(p), F.lit(k))
                                      for c in text_cols for k, p in PII_PATTERNS.items()]))
    return sdf.withColumn("pii", F.array_join(F.array_distinct(kinds), ",")).filter(F.size(kinds) > 0)


def stream_drift(sdf: DataFrame, ts: str, value: str, edges: list[float], size: str = "30 days", delay: str = "2 days") -> DataFrame:
    """Rows per (event-time window, baseline bin), in any number of batches; :func:`drift_of` turns them into PSI.

    ``edges`` are the baseline's inner quantile edges (bin = edges below x).
    """
    arr = F.array(*[F.lit(float(e)) for e in edges])
    x = F.col(value).cast("double")
    rows = sdf.where(x.isNotNull()).withColumn("bin", F.size(F.filter(arr, lambda e: e < x)))
    counts = rows.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), "bin").agg(F.count(F.lit(1)).alias("c"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "bin", "c")


def drift_of(counts: DataFrame, base_shares: list[float], eps: float = 1e-4) -> DataFrame:
    """(window_start, psi, rows): PSI of each window against the baseline's share per bin (a literal)."""
    base = F.array(*[F.lit(float(s)) for s in base_shares])
    per = counts.groupBy("window_start").agg(F.sum("c").alias("rows"), F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"))
    bins = F.sequence(F.lit(0), F.lit(len(base_shares) - 1))

    def term(b):
        p = F.greatest(F.get(base, b), F.lit(eps))
        q = F.greatest(F.coalesce(F.element_at("m", b), F.lit(0)) / F.col("rows"), F.lit(eps))
        return (q - p) * F.log(q / p)
    psi = F.aggregate(F.transform(bins, term), F.lit(0.0), lambda a, x: a + x)
    return per.select("window_start", psi.alias("psi"), F.col("rows").cast("bigint").alias("rows"))
