"""Token ids in Arrow files of equal-length sequences, with zero-copy random access.

``write_sequences`` sorts documents by id over many tasks; each task writes one Arrow file whose
record batches hold ``batch_rows`` sequences of exactly ``seq_len`` ids (fixed-size lists) and their
masks (false: padding, only in a file's last sequence).  Beside it stands ``<name>.docs.arrow``: each
document's id, its first token in the file and its number of tokens.  Every batch but the last has
``batch_rows`` rows, so sequence i of a file is row ``i % batch_rows`` of batch ``i // batch_rows``:
a memory-mapped reader gets it without copying (:class:`SequenceFile`).

A task writes to a name of its own and renames when done, so a task that runs twice leaves the same
file.  Files go through ``pyarrow.fs``, so the folder may be any URI it knows (file, hdfs, s3, gs).

Defined results: null text is empty text (the end id only); rows with equal ids are all kept, ordered
by a hash of their text; null ids come first; an empty table makes no file and an empty result.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.llm.tokens import END_ID, encoder
from synthkit.session import scratch_dir

_MANIFEST = T.StructType([T.StructField(n, t) for n, t in (
    ("file", T.StringType()), ("part", T.LongType()), ("n_docs", T.LongType()), ("n_tokens", T.LongType()))])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class SequenceWriter:
    """Cuts a stream of ids into sequences of one file; holds at most one batch of sequences."""

    def __init__(self, sink, seq_len: int, dtype, batch_rows: int):
        self.seq_len, self.dtype, self.room = seq_len, np.dtype(dtype), seq_len * batch_rows
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))],
                                metadata={"seq_len": str(seq_len), "batch_rows": str(batch_rows)})
        self.out = pa.ipc.new_file(sink, self.schema)
        self.buffer, self.filled, self.tokens = np.zeros(self.room, self.dtype), 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.tokens += len(ids)
        while len(ids):
            n = min(self.room - self.filled, len(ids))
            self.buffer[self.filled:self.filled + n] = ids[:n]
            self.filled, ids = self.filled + n, ids[n:]
            if self.filled == self.room:
                self._flush()

    def _flush(self) -> None:
        rows = -(-self.filled // self.seq_len)
        if rows:
            ids = self.buffer[:rows * self.seq_len].copy()
            ids[self.filled:] = 0
            mask = np.arange(rows * self.seq_len) < self.filled
            self.out.write_batch(pa.record_batch(
                [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)], schema=self.schema))
            self.filled = 0

    def close(self) -> None:
        self._flush()
        self.out.close()


class SequenceFile:
    """Random access to one file: ``ids(i)`` and ``mask(i)`` are views of the mapped file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        meta = self.file.schema.metadata
        self.seq_len, self.batch_rows = int(meta[b"seq_len"]), int(meta[b"batch_rows"])

    def batch(self, k: int) -> pa.RecordBatch:
        return self.file.get_batch(k)

    def ids(self, i: int) -> np.ndarray:
        return self._row(i, 0).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.Array:
        return self._row(i, 1)

    def _row(self, i: int, column: int) -> pa.Array:
        k, row = divmod(i, self.batch_rows)
        return self.batch(k).column(column)[row].values

    def tokens(self, start: int, n: int):
        """The ids from ``start`` on, as views of one batch after the other."""
        room = self.seq_len * self.batch_rows
        while n > 0:
            k, at = divmod(start, room)
            m = min(n, room - at)
            yield self.batch(k).column(0).flatten().to_numpy(zero_copy_only=True)[at:at + m]
            start, n = start + m, n - m


def write_sequences(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 1024,
                    batch_rows: int = 256, end_id: int = END_ID, tokenizer: str | None = None, dtype: str = "uint16",
                    files: int | None = None) -> list[dict]:
    """Write all documents in ascending id order; returns one manifest entry per file (file, n_docs, n_tokens, start).

    ``dtype`` must hold the largest id (``uint16``: vocabularies of up to 65,536).  The order is dealt by
    ranges of (id, hash of the text), so even a single repeated id spreads over tasks.  ``files`` is
    the number of files (the session's shuffle partitions by default).
    """
    spark = docs.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    order = [F.col("id"), F.xxhash64("text"), F.col("text")]
    ordered = src.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order)
    from pyspark.sql.pandas.types import to_arrow_type
    id_arrow, limit = to_arrow_type(id_type), np.iinfo(dtype).max
    docs_schema = pa.schema([("id", id_arrow), ("start", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches):
        part = TaskContext.get().partitionId()
        fs, base = filesystem(folder)
        enc, writer, own, n_docs = None, None, uuid.uuid4().hex, 0
        temp = f"{base}/_writing-{part:06d}-{own}"
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                fs.create_dir(base)
                enc = encoder(tokenizer)
                sinks = [fs.open_output_stream(temp + x) for x in ("", ".docs")]
                writer = SequenceWriter(sinks[0], seq_len, dtype, batch_rows)
                index = pa.ipc.new_file(sinks[1], docs_schema)
            starts, counts = [], []
            for text in b.column(1):
                ids = np.frombuffer(enc.encode(text.as_py()), "<u4")
                if len(ids) and ids.max() > limit:
                    raise ValueError(f"token id {ids.max()} does not fit {dtype}")
                starts.append(writer.tokens)
                counts.append(len(ids) + 1)
                writer.add(ids.astype(dtype))
                writer.add(np.array([end_id], dtype))
            n_docs += b.num_rows
            index.write_batch(pa.record_batch([b.column(0).cast(id_arrow), pa.array(starts, pa.int64()),
                                               pa.array(counts, pa.int64())], schema=docs_schema))
        if writer is not None:
            writer.close()
            index.close()
            for s in sinks:
                s.close()
            name = f"part-{part:06d}.arrow"
            fs.move(temp + ".docs", f"{base}/{name}.docs.arrow")
            fs.move(temp, f"{base}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": name, "part": part, "n_docs": n_docs, "n_tokens": writer.tokens}],
                                             schema=pa.schema([("file", pa.string()), ("part", pa.int64()),
                                                               ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    done = sorted((r.asDict() for r in ordered.mapInArrow(write, _MANIFEST).collect()), key=lambda r: r["part"])
    start = 0
    for r in done:
        r["start"] = start
        start += r["n_tokens"]
    return done


def read_documents(spark: SparkSession, folder: str, manifest: list[dict], id_type: T.DataType = T.LongType()) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32 (little-endian 32-bit ids)."""
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))])
    listed = spark.createDataFrame([(r["file"], r["start"]) for r in manifest], "file string, start long")
    if manifest:
        listed = listed.repartition(len(manifest), "file")

    def read(batches):
        for b in batches:
            for entry in b.to_pylist():
                data = SequenceFile(f"{folder}/{entry['file']}")
                fs, path = filesystem(f"{folder}/{entry['file']}.docs.arrow")
                with fs.open_input_file(path) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        rows = index.get_batch(k)
                        crcs = []
                        for at, n in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                            crc = 0
                            for ids in data.tokens(at, n):
                                crc = zlib.crc32(ids.astype("<u4"), crc)
                            crcs.append(crc)
                        starts = pa.array(rows.column(1).to_numpy() + entry["start"], pa.int64())
                        yield pa.RecordBatch.from_arrays([rows.column(0), starts, rows.column(2), pa.array(crcs, pa.int64())],
                                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, schema)


def token_files(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", **options) -> DataFrame:
    """Write the files (to a new folder under the shared folder by default) and read every document back."""
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "sequences")
    manifest = write_sequences(docs, folder, id_col=id_col, **options)
    return read_documents(spark, folder, manifest, docs.schema[id_col].dataType)
