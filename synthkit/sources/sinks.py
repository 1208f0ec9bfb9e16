"""Sinks: CSV (the product's download), Parquet/JSON tables and an export manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.observation import Observation

from synthkit.functions.text import format_bytes


def _csv_ready(df: DataFrame) -> DataFrame:
    """CSV cannot hold arrays, maps or structs: write them as JSON text."""
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
                       for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, single: bool = False, mode: str = "overwrite") -> None:
    """Header CSV.  ``single=True`` writes one file (coalesce(1)) — only for small outputs."""
    out = _csv_ready(df)
    if single:
        out = out.coalesce(1)
    out.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def export_manifest(df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """Write ``df`` and describe it like the product's card: rows, format and size.

    The row count is observed during the write (no second pass); the size is
    the sum of the written files from a ``binaryFile`` listing (no content).
    """
    obs = Observation("export")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    if fmt == "csv":
        write_csv(observed, path)
    else:
        write_table(observed, path, fmt)
    rows = obs.get["rows"]
    spark = df.sparkSession
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
             .agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")))
    text = F.format_string("%s rows · %s · %s", F.format_number(F.lit(rows), 0), F.lit(fmt.upper()),
                           format_bytes(F.col("bytes")))
    return files.select(F.lit(rows).cast("bigint").alias("rows"), F.lit(fmt).alias("format"), "files", "bytes",
                        text.alias("summary"))
