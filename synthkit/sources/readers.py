"""Readers.  Every reader returns a DataFrame; nothing is read on the driver."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.functions.text import format_bytes
from synthkit.session import folders_named, qualified
from synthkit.sources.xlsx import workbook_rows


def read_csv(spark: SparkSession, paths, schema: str | T.StructType | None = None, header: bool = True,
             **options) -> DataFrame:
    """CSV with a header.  Without a schema every column is text (no second inference scan);
    :func:`synthkit.operators.profile.infer_types` types it afterwards."""
    r = spark.read.option("header", header).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(paths)


def read_parquet(spark: SparkSession, paths) -> DataFrame:
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def read_files(spark: SparkSession, uri: str, fmt: str = "parquet", **options) -> DataFrame:
    """Object stores and drives (``s3a://``, ``gs://``, ``abfss://``, local): the Hadoop path decides."""
    return spark.read.format(fmt).options(**options).load(uri)


def read_xlsx(spark: SparkSession, paths: str, sheet: int | str = 0, header: bool = True,
              glob: str = "*.xlsx") -> DataFrame:
    """Many workbooks → one table of text columns named by the header row.

    ``binaryFile`` lists and loads the workbooks (any Hadoop path); parsing
    runs in ``mapInPandas`` on the executors, one workbook at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)

    def parse(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for row_no, cells in workbook_rows(bytes(content), sheet):
                    out.append((path, row_no, cells))
            yield pd.DataFrame(out, columns=["path", "row_no", "cells"])
    cells = files.select("path", "content").mapInPandas(parse, "path string, row_no int, cells array<string>")
    if not header:
        return cells
    first = cells.filter(F.col("row_no") == cells.groupBy().agg(F.min("row_no")).scalar())
    names = first.select("cells").limit(1).collect()  # the header: one row of names
    if not names:
        return cells
    cols = [c or f"_c{i}" for i, c in enumerate(names[0]["cells"])]
    heads = cells.groupBy("path").agg(F.min("row_no").alias("_h"))
    body = cells.join(heads, "path").filter(F.col("row_no") > F.col("_h"))
    return body.select("path", "row_no", *[F.col("cells")[i].alias(c) for i, c in enumerate(cols)])


def read_jdbc(spark: SparkSession, url: str, table: str, partition_col: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
              **options) -> DataFrame:
    """Parallel JDBC read (PostgreSQL, MySQL, ...): ``num_partitions`` range slices of ``partition_col``."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_col:
        if lower is None or upper is None:
            raise ValueError("partitioned JDBC reads need lower and upper bounds")
        r = (r.option("partitionColumn", partition_col).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    return r.load()


# Connector format names and the options each one cannot do without.
VENDORS = {
    "snowflake": ("snowflake", ["sfUrl", "sfUser", "sfDatabase", "sfSchema", "dbtable"]),
    "bigquery": ("bigquery", ["table"]),
    "mongodb": ("mongodb", ["connection.uri", "database", "collection"]),
    "redis": ("org.apache.spark.sql.redis", ["table"]),
    "elasticsearch": ("org.elasticsearch.spark.sql", ["es.nodes", "es.resource"]),
    "databricks": ("jdbc", ["url", "dbtable"]),
    "postgresql": ("jdbc", ["url", "dbtable"]),
    "mysql": ("jdbc", ["url", "dbtable"]),
}


def vendor_reader(spark: SparkSession, kind: str, options: dict):
    """The configured ``DataFrameReader`` (fails early on a missing option; loading needs the jar)."""
    if kind not in VENDORS:
        raise ValueError(f"unknown source {kind!r}; known: {sorted(VENDORS)}")
    fmt, required = VENDORS[kind]
    missing = [o for o in required if o not in options]
    if missing:
        raise ValueError(f"{kind}: missing options {missing}")
    return spark.read.format(fmt).options(**options)


def read_vendor(spark: SparkSession, kind: str, options: dict) -> DataFrame:
    return vendor_reader(spark, kind, options).load()


def read_stream(spark: SparkSession, cfg: dict) -> DataFrame:
    """Streaming source: ``{"kind": "kafka", "servers", "topic", "schema"}`` (JSON values) or
    ``{"kind": "files", "path", "format", "schema"}``."""
    kind = cfg.get("kind", "files")
    if kind == "kafka":
        raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", cfg["servers"])
               .option("subscribe", cfg["topic"]).option("startingOffsets", cfg.get("starting", "latest")).load())
        return raw.select(F.from_json(F.col("value").cast("string"), cfg["schema"]).alias("v")).select("v.*")
    r = spark.readStream.format(cfg.get("format", "parquet")).schema(cfg["schema"])
    for k, v in cfg.get("options", {}).items():
        r = r.option(k, v)
    return r.load(cfg["path"])


# Export kinds and the canonical table each one becomes.
EXPORTS = {
    "chat": "conversations (conv_id, turn, role, text)",
    "wiki": "pages (page_id, url, title, text)",
    "drive": "documents (doc_id, text, lang, source, n_chars)",
}


def html_to_text(html) -> "F.Column":
    """Visible text of an HTML page: drop script/style/comments, tags → space, collapse blanks."""
    h = F.col(html) if isinstance(html, str) else html
    h = F.regexp_replace(h, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    h = F.regexp_replace(h, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(h, r"\s+", " "))


def read_export(spark: SparkSession, kind: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Landed exports → one canonical table per kind (see ``EXPORTS``)."""
    df = spark.read.format(fmt).load(path)
    if kind == "wiki":
        return df.select("page_id", "url",
                         F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
                         html_to_text("html").alias("text"))
    if kind == "chat":
        return df.select("conv_id", "turn", "role", "text")
    if kind == "drive":
        return df.select("doc_id", "text", "lang", "source", "n_chars")
    raise ValueError(f"unknown export kind {kind!r}; known: {sorted(EXPORTS)}")


def scan_sources(spark: SparkSession, profile: list[dict], path_col: str | None = "_file_path") -> dict[str, DataFrame]:
    """Enabled sources of a profile → {name: DataFrame}.  Entries: ``{name, path, format, enabled, recursive, glob, options}``.

    Folders are read with all their subfolders; ``recursive: False`` reads one level and takes ``key=value``
    subfolders as partition columns instead.  Every row keeps the file it came from in ``path_col`` (None: left out).
    ``glob`` names files, or folders directly in ``path``: such a folder is read whole, whatever its files are called.
    """
    out = {}
    for s in profile:
        if not s.get("enabled", True):
            continue
        glob = s.get("glob")
        folders = folders_named(spark, s["path"], glob) if glob else []

        def load(paths, **options):
            df = spark.read.format(s.get("format", "parquet")).option("recursiveFileLookup", s.get("recursive", True)) \
                .options(**options, **s.get("options", {})).load(paths)
            return df, F.col("_metadata.file_path")

        def outside(path):
            return reduce(lambda a, b: a & b, [_below(path, spark, f).isNull() for f in folders], F.lit(True))
        parts = []
        if folders:
            listed = spark.read.format("binaryFile").option("recursiveFileLookup", s.get("recursive", True)).option("pathGlobFilter", glob)
            parts.append(load(folders))
        if not folders or not listed.load(s["path"]).select(F.col("_metadata.file_path").alias("p")).where(outside(F.col("p"))).isEmpty():
            df, path = load(s["path"], **({"pathGlobFilter": glob} if glob else {}))
            parts.append((df.where(outside(path)) if folders else df, path))
        found = [df.withColumn(path_col, path) if path_col else df for df, path in parts]
        out[s["name"]] = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    return out


def _below(path: F.Column, spark: SparkSession, folder: str) -> F.Column:
    """What a file's path adds to its ``folder`` (from the slash on); null for files elsewhere."""
    whole, start = F.regexp_replace(path, "^([A-Za-z0-9+.-]+):///", "$1:/"), qualified(spark, folder)
    return F.when(whole.startswith(start + "/"), F.substring(whole, F.lit(len(start) + 1), F.length(whole)))


def file_counts(sources: dict[str, DataFrame], path_col: str = "_file_path", root: str | None = None) -> DataFrame:
    """(source, file, rows) of the sources that :func:`scan_sources` gave: the file's path and its rows.

    With ``root``, the folder that was scanned, ``file`` is the file or folder in it that holds the rows.
    """
    def of(df):
        path = F.col(path_col)
        if root is None:
            return path
        return F.split_part(_below(path, df.sparkSession, root), F.lit("/"), F.lit(2))
    parts = [df.groupBy(of(df).alias("file")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("source"), "file", "rows")
             for n, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def source_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """(source, rows) for every source — one plan, one scan per source (counts read footers only)."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("source"), "rows")
             for n, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def file_inventory(spark: SparkSession, path: str, glob: str = "*", grounding: tuple[str, ...] = (
        ".csv", ".parquet", ".xlsx", ".xls", ".json")) -> DataFrame:
    """(name, size, size_text, badge) per file; content is pruned from the binaryFile scan."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    is_grounding = reduce(lambda a, b: a | b, [F.lower(name).endswith(x) for x in grounding])
    return files.select(name.alias("name"), F.col("length").alias("size"), format_bytes("length").alias("size_text"),
                        F.when(is_grounding, "Grounding").otherwise("Context").alias("badge"))
