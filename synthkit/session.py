"""Session helpers: a tuned local session for tests/bench and the shared scratch dir."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "synthkit") -> SparkSession:
    """Session used by tests and bench.  On a cluster the submitter's session is used instead."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_dir(spark)
    return spark


def _checkpoint_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; on a cluster it must name a shared folder")
    # Local runs (tests, bench) without the setting: a folder of the session's warehouse.
    local = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_dir(spark: SparkSession, name: str | None = None) -> str:
    """A fresh folder under the session's checkpoint dir (shared on a cluster)."""
    root = _checkpoint_root(spark)
    sub = f"{name or 'scratch'}-{uuid.uuid4().hex[:12]}"
    return root.rstrip("/") + "/" + sub


def folders_named(spark: SparkSession, path: str, glob: str) -> list[str]:
    """The folders directly in ``path`` whose names fit ``glob`` (a table may be one file or a folder of files)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/" + glob)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []  # null: nothing there
    return sorted(f.getPath().toString() for f in found if f.isDirectory() and f.getPath().getName()[0] not in "._")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, absolute; an empty authority (``file:///``) is left out (``file:/``)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    return re.sub("^([A-Za-z0-9+.-]+):///", r"\1:/", whole).rstrip("/")
