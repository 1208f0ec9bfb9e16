"""Global order without a single-task window.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one task.
Two distributed replacements:

* :func:`with_running_sums` — running sums over a column whose values are
  distinct within each group (value-count tables).  Rows are dealt by ranges
  of (group, x) and written once; totals by partition give the offsets of the
  partitions, and a window inside each partition finishes the sum.  A hot
  value is already one row because callers aggregate by value first.
* :func:`with_position` — a dense position for any (composite, unique) sort
  key: ``orderBy`` range-partitions and sorts, each row is tagged with its
  partition id and ``monotonically_increasing_id`` and the result is
  ``checkpoint()``-ed (fixed partitioning, stable tags across retries), then
  per-partition counts give broadcast offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthkit.session import scratch_dir

_PID, _MID = "_sk_pid", "_sk_mid"


def with_running_sums(df: DataFrame, x: str, sums: dict[str, Column], groups: list[str] | None = None,
                      total_prefix: str | None = None) -> DataFrame:
    """Add inclusive running sums of ``sums`` over ascending ``x`` within each group.

    ``x`` must be unique within a group.  ``total_prefix`` adds the group
    totals as ``<prefix><name>``.  The input is computed once: it is dealt by
    ranges of (group, x), written to the shared folder with its partition
    number, and read back for the totals and the running sums.
    """
    groups = list(groups or [])
    spark = df.sparkSession
    base = df
    for name, c in sums.items():
        base = base.withColumn("_sk_v_" + name, c)
    ranged = base.repartitionByRange(*groups, x).withColumn(_PID, F.spark_partition_id())
    path = scratch_dir(spark, "running")
    ranged.write.parquet(path)
    base = spark.read.schema(ranged.schema).parquet(path)
    keys = groups + [_PID]
    tot = base.groupBy(*keys).agg(*[F.sum("_sk_v_" + n).alias("_sk_t_" + n) for n in sums])
    w_off = Window.partitionBy(*groups).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*groups)
    off = tot.select(*keys, *[F.coalesce(F.sum("_sk_t_" + n).over(w_off), F.lit(0)).alias("_sk_o_" + n) for n in sums],
                     *([F.sum("_sk_t_" + n).over(w_all).alias(total_prefix + n) for n in sums] if total_prefix else []))
    w_in = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    out = base.join(F.broadcast(off), keys)  # at most (groups + partitions) rows
    for n in sums:
        out = out.withColumn(n, F.col("_sk_o_" + n) + F.sum("_sk_v_" + n).over(w_in))
    return out.drop(_PID, *[p + n for n in sums for p in ("_sk_v_", "_sk_o_")])


def _sorted_checkpoint(df: DataFrame, order_cols: list) -> DataFrame:
    scratch_dir(df.sparkSession)  # makes sure a checkpoint dir is set
    tagged = (df.orderBy(*order_cols)
              .withColumn(_PID, F.spark_partition_id())
              .withColumn(_MID, F.monotonically_increasing_id()))
    return tagged.checkpoint(eager=True)


def with_position(df: DataFrame, order_cols: list, name: str = "position", start: int = 1) -> DataFrame:
    """Dense position in the global order (``start``-based), no window, no single task."""
    srt = _sorted_checkpoint(df, order_cols)
    counts = srt.groupBy(_PID).agg(F.count(F.lit(1)).alias("_sk_n"))
    w_off = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: this single-task window is bounded by the partition count
    offsets = counts.select(_PID, F.coalesce(F.sum("_sk_n").over(w_off), F.lit(0)).alias("_sk_off"))
    local = F.col(_MID) - F.shiftleft(F.col(_PID).cast("bigint"), 33)
    return (srt.join(F.broadcast(offsets), _PID)
            .withColumn(name, F.col("_sk_off") + local + F.lit(start))
            .drop(_PID, _MID, "_sk_off"))


def written(df: DataFrame, tag: str) -> DataFrame:
    """The table written once to the shared folder and read back: lineage is cut and nothing is computed twice."""
    path = scratch_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
