"""Readers (files, workbooks, exports, JDBC/vendor option wrappers, streams) and sinks."""

from synthkit.sources.readers import (
    file_inventory, read_csv, read_export, read_files, read_jdbc, read_parquet, read_stream, read_vendor,
    read_xlsx, scan_sources,
)
from synthkit.sources.sinks import export_manifest, write_csv, write_table

__all__ = ["read_csv", "read_parquet", "read_xlsx", "read_jdbc", "read_files", "read_stream", "read_vendor",
           "read_export", "scan_sources", "file_inventory", "write_csv", "write_table", "export_manifest"]
