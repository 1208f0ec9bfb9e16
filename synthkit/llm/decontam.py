"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training windows.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z.  A window is ``size``
consecutive words of a benchmark item (an item with fewer words is one window).  Each worker holds
the windows as a table of 64-bit hashes; a document's windows are hashed with numpy, looked up, and
every hit is verified word by word.

Defined results: null or empty text has no words and no hits; an empty benchmark hits nothing;
repeated rows are judged each for itself; items with equal windows are all reported; null item texts
give no window; null item ids give none either, or with ``null_ids`` (the query and the pipeline) windows that
count as hits without a listed id, as in the SQL.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.llm.common import free_name, materialize, scan, worker_table

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WINDOW_ROWS = 400_000  # windows (of some 100 bytes) broadcast at a time; more are handled in further slices
_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_MULT = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall(text.lower()) if text else []


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                      size: int = 10, null_ids: bool = False) -> DataFrame:
    """Distinct (window, item): the normalised words joined by a space."""
    if not 1 <= size <= len(_MULT):
        raise ValueError(f"window size must be 1 to {len(_MULT)}")
    src = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text"))
    src = src if null_ids else src.where("item is not null")

    def windows(column):
        out = []
        for text in column.to_pylist():
            w = words(text)
            n = min(size, len(w))
            out.append([b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if n else [])
        return [pa.array(out, pa.list_(pa.binary()))]

    found = scan(src, [T.StructField("windows", T.ArrayType(T.BinaryType()))], "text", windows, keep=["item"])
    return found.select("item", F.explode("windows").alias("window")).distinct()


class WindowSet:
    """Windows of one slice as numpy tables; ``find`` gives the verified (start, length, row) hits of a text."""

    def __init__(self, rows):
        items: dict[tuple[bytes, ...], list] = {}
        for window, item in rows:
            items.setdefault(tuple(window.split(b" ")), []).extend([] if item is None else [item])
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list] = {}
        for w in items:
            by_length.setdefault(len(w), []).append(w)
            for word in w:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.tables = []
        for n, windows in sorted(by_length.items()):
            ids = np.array([[self.vocabulary[x] for x in w] for w in windows], np.uint64)
            h = (ids * _MULT[:n]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(h, kind="stable")
            bits = max(12, int(len(h)).bit_length() + 4)
            shift = np.uint64(64 - bits)
            seen = np.zeros(1 << bits, bool)
            seen[(h >> shift).astype(np.int64)] = True
            self.tables.append((n, h[order], ids[order], [items[windows[k]] for k in order], seen, shift))

    def find(self, found: list[bytes]) -> list[tuple[int, int, list]]:
        if not self.vocabulary:
            return []
        known = self.vocabulary
        ids = np.array([known.get(w, 0) for w in found], np.uint64)
        hits = []
        for n, hashes, rows, items, seen, shift in self.tables:
            m = len(ids) - n + 1
            if m < 1:
                continue
            h = np.zeros(m, np.uint64)
            for j in range(n):
                h += ids[j:j + m] * _MULT[j]
            at = np.flatnonzero(seen[(h >> shift).astype(np.int64)])
            if not len(at):
                continue
            row = np.searchsorted(hashes, h[at])
            for i, r in zip(at.tolist(), row.tolist()):
                while r < len(hashes) and hashes[r] == h[i]:
                    if (rows[r] == ids[i:i + n]).all():
                        hits.append((i, n, items[r]))
                    r += 1
        return hits


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                       bench_text_col: str = "text", size: int = 10, window_rows: int = WINDOW_ROWS, null_ids: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``n_words``, ``n_hit``, ``items`` (sorted ids) and ``spans`` of hit words.

    ``spans`` are code-point ranges, one for each run of hit words.  Up to ``window_rows`` windows are broadcast
    and the documents are not shuffled.  Of more windows, the driver and the workers hold one slice (of about so
    many, by hash) at a time: its hits are written to the shared folder by row number, the slice is released,
    and the hits of all slices are joined to the documents.
    """
    sc = docs.sparkSession.sparkContext
    item_type = benchmark.schema[item_col].dataType
    hit, items = free_name(docs, "hit_words"), free_name(docs, "hit_items")
    ranges = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    kept = list(docs.columns)
    bundle, row = free_name(docs, "found"), free_name(docs, "row")

    def none(df):
        return df.withColumn(hit, F.array().cast(ranges)).withColumn(items, F.array().cast(T.ArrayType(item_type)))

    windows = materialize(benchmark_windows(benchmark, item_col, bench_text_col, size, null_ids), "windows")
    n_slices = max(1, -(-windows.count() // window_rows))
    if n_slices == 1:
        return _add_slice(none(docs), text_col, hit, items, bundle, sc.broadcast(_collected(windows)), ranges, item_type, kept, True)
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    part, hits = F.pmod(F.xxhash64("window", "item"), F.lit(n_slices)), []
    for i in range(n_slices):
        shared = sc.broadcast(_collected(windows.where(part == i)))
        some = _add_slice(none(docs.select(row, F.col(f"`{text_col}`"))), text_col, hit, items, bundle, shared, ranges, item_type, [row], False)
        hits.append(materialize(some.where(F.size(hit) > 0), "hits"))
        shared.destroy()
    found = reduce(DataFrame.unionByName, hits).groupBy(row).agg(
        F.flatten(F.collect_list(hit)).alias(hit), F.array_distinct(F.flatten(F.collect_list(items))).alias(items))
    out = docs.join(found, row, "left")
    return _add_slice(out, text_col, hit, items, bundle, sc.broadcast([]), ranges, item_type, kept, True)


def _collected(windows: DataFrame) -> list[tuple[bytes, object]]:
    return [(bytes(r["window"]), r["item"]) for r in windows.collect()]


def _set_of(shared) -> WindowSet:
    return worker_table(shared.id, lambda: WindowSet(shared.value))


class _Shared:
    """A broadcast with the key under which its table is kept in a worker."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, ("windows", broadcast._jbroadcast.id())

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _add_slice(df, text_col, hit, items, bundle, broadcast, ranges, item_type, kept, last):
    shared = _Shared(broadcast)
    text = F.col(f"`{text_col}`").cast("binary")
    df = df.withColumn(bundle, F.struct(text.alias("text"), F.col(hit).alias("hit"), F.col(items).alias("items")))
    fields = [T.StructField("_hit", ranges), T.StructField("_items", T.ArrayType(item_type))]
    if last:
        fields += [T.StructField("_n", T.LongType()), T.StructField("_hits", T.LongType()), T.StructField("_spans", _SPAN)]
    item_arrow = pa.list_(arrow_type(item_type))
    span_arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    range_arrow = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def add(column):
        table = _set_of(shared)
        hits, ids, n_words, n_hits, spans = [], [], [], [], []
        for text, old, old_items in zip(*(column.field(i) for i in range(3))):
            text = text.as_py()
            found = words(text)
            mask = np.zeros(len(found), bool)
            got = set(old_items.as_py() or ())
            for r in old.as_py() or ():
                mask[r["a"]:r["b"]] = True
            for i, n, its in table.find(found):
                mask[i:i + n] = True
                got.update(its)
            runs = _runs(mask)
            hits.append([{"a": a, "b": b} for a, b in runs])
            ids.append(sorted(got, key=str))
            n_words.append(len(found))
            n_hits.append(int(mask.sum()))
            spans.append(_char_spans(text, runs) if last and runs else [])
        out = [pa.array(hits, range_arrow), pa.array(ids, item_arrow)]
        if last:
            out += [pa.array(n_words, pa.int64()), pa.array(n_hits, pa.int64()), pa.array(spans, span_arrow)]
        return out

    names = {c: f"`{c}`" for c in kept}
    done = scan(df.select(*names.values(), bundle), _free(fields, kept), bundle, add, keep=kept, table=shared.id)
    got = done.columns[len(kept):]
    if not last:
        return done.withColumnsRenamed({got[0]: hit, got[1]: items})
    final = {"n_words": got[2], "n_hit": got[3], "items": got[1], "spans": got[4]}
    return done.select(*names.values(), *[F.col(v).alias(free_name(df.select(*names.values()), k)) for k, v in final.items()])


def _free(fields, kept):
    taken = {c.lower() for c in kept}
    out = []
    for f in fields:
        name = f.name
        while name.lower() in taken:
            name += "_"
        out.append(T.StructField(name, f.dataType))
    return out


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def _char_spans(text: bytes, runs) -> list[dict]:
    """Code-point ranges of runs of words."""
    at = [m.span() for m in WORD.finditer(text.lower())]
    out, chars, byte = [], 0, 0
    for a, b in runs:
        start, end = at[a][0], at[b - 1][1]
        chars += len(text[byte:start].decode("utf-8", "replace"))
        begin = chars
        chars += len(text[start:end].decode("utf-8", "replace"))
        byte = end
        out.append({"start": begin, "end": chars})
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", max_share: float = 0.0,
                  text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` without what the benchmark also holds, same columns.

    ``mode="documents"`` removes a document whose share of hit words is above ``max_share`` (0: any
    hit); ``mode="spans"`` cuts the hit words out of the text (``length_col`` is updated if present).
    """
    found = find_contamination(docs, benchmark, text_col=text_col, **{"null_ids": True, **options})
    n_words, n_hit, _, spans = found.columns[len(docs.columns):]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if mode == "documents":
        return found.where(F.col(n_hit) <= F.col(n_words) * F.lit(float(max_share))).select(*columns)
    if mode != "spans":
        raise ValueError(f"unknown mode {mode!r}; use 'documents' or 'spans'")
    return cut_spans(found, text_col, spans, "").select(*_with_length(docs, text_col, length_col))


def _with_length(docs: DataFrame, text_col: str, length_col: str | None):
    return [F.char_length(F.col(f"`{text_col}`")).cast(docs.schema[c].dataType).alias(c)
            if c == length_col else F.col(f"`{c}`") for c in docs.columns]


def cut_spans(df: DataFrame, text_col: str, span_col: str, put: str) -> DataFrame:
    """Replace code-point ranges (sorted structs of start, end) of a text by ``put``; other rows stay as they are."""
    text, spans = F.col(f"`{text_col}`"), F.col(span_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(
        spans, start,
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(put)).alias("out"),
            s["end"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return df.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text))
