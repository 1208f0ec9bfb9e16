"""Vector codes: equal parts, each by its nearest entry of a codebook, found by equal-average search.

Vectors become integers floor(scale * x) and are cut into ``parts`` equal consecutive parts.  A part position's
codebook starts as that part of the first ``entries`` vectors by id; each round assigns every part to its
nearest entry (squared Euclidean distance, ties to the lower index) and replaces each entry by the floored mean
of its parts; unused entries stay.

Equal-average search: for parts of d components with component sums s and t, the squared distance is at least
(s - t)^2 / d.  Entries are sorted by component sum.  Each part starts where its own sum stands and the search
expands outward, upwards and downwards; a side ends once (s - t)^2 / d strictly exceeds the best distance so
far (strictly, as an entry at equal distance may have the lower index).  Parts of near sums are searched
together in a tile, so that each step is one small matrix product; a part leaves the tile when both its sides
have ended.  All values are whole numbers held exactly: doubles while the squares stay below 2^45, Python
integers beyond.

Each round is one scan: tasks add up their parts by entry, and at most parts * entries sums a task are
shuffled.  The codebooks (parts * entries rows) go to the tasks with the function; nothing else is collected.

Defined results: rows whose vector is null or empty or holds null or non-finite components are dropped, and so
are vectors of another length than the first kept one by id (its length must be a multiple of ``parts``); ids
may repeat (equal ids are ordered by vector), null ids come last; an empty table gives an empty result; other
columns pass through unless named like a result.  An error beyond 64 bits (components over some 10^6) is null.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.llm.common import free_name, materialize, scan

TILE, STEP = 128, 16  # parts searched together; entries looked at on each side in a step
MOST_LABELS = 100_000  # label sums broadcast up to so many; beyond, they are joined with salted keys
_INF = float("inf")


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, parts: int) -> DataFrame:
    """Rows with a finite vector as long as the first one by id."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(_INF)))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & finite)
    first = rows.orderBy(F.col(f"`{id_col}`").asc_nulls_last(), v).select(F.size(v).alias("n")).first()
    if first is None:
        return rows
    if first.n % parts:
        raise ValueError(f"vectors of {first.n} components cannot be cut into {parts} equal parts")
    return rows.where(F.size(v) == first.n)


def whole_numbers(column: pa.Array, scale: float) -> np.ndarray:
    """(rows, components) of floor(scale * x): doubles, or Python integers where squares would not be exact."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x = np.floor(flat * scale)
    if x.size and np.abs(x).max() * 2 * np.sqrt(x.shape[1]) >= 2.0 ** 22:
        return np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    return x


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry by equal-average search."""
    if x.dtype != book.dtype:
        x, book = x.astype(object), book.astype(object)  # a float that is a whole number compares the same
        x, book = np.vectorize(int, otypes=[object])(x), np.vectorize(int, otypes=[object])(book)
    n, d, size = len(x), x.shape[1], len(book)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    sums = book.sum(axis=1)
    by_sum = np.argsort(sums, kind="stable")
    t, entries, square = sums[by_sum], book[by_sum], (book * book).sum(axis=1)[by_sum]
    s, own = x.sum(axis=1), (x * x).sum(axis=1)
    order = np.argsort(s, kind="stable")
    best = np.full(n, -1, x.dtype)  # distance * size + index: the least is the nearest, ties to the lower index
    big = (int(own.max()) + int(square.max()) + 1) * 4 * size
    best[:] = big
    for at in range(0, n, TILE):
        rows = order[at:at + TILE]
        left = right = int(np.searchsorted(t, s[rows[len(rows) // 2]]))
        up = down = rows
        while len(up) or len(down):
            if right >= size:
                up = up[:0]
            if left <= 0:
                down = down[:0]
            if len(up):
                _look(x, own, best, up, entries, square, by_sum, right, min(size, right + STEP))
                right = min(size, right + STEP)
            if len(down):
                _look(x, own, best, down, entries, square, by_sum, max(0, left - STEP), left)
                left = max(0, left - STEP)
            # entries not looked at yet have sums of at least t[right] or at most t[left - 1]
            if right < size and len(up):
                gap = t[right] - s[up]
                up = up[(gap <= 0) | (gap * gap <= d * (best[up] // size))]
            if left > 0 and len(down):
                gap = s[down] - t[left - 1]
                down = down[(gap <= 0) | (gap * gap <= d * (best[down] // size))]
    return (best % size).astype(np.int64), best // size


def _look(x, own, best, rows, entries, square, by_sum, a, b):
    """Compare some rows with entries a..b of the sorted codebook."""
    distance = own[rows][:, None] + square[a:b][None, :] - 2 * (x[rows] @ entries[a:b].T)
    best[rows] = np.minimum(best[rows], (distance * len(by_sum) + by_sum[a:b][None, :]).min(axis=1))


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), both (rows, parts)."""
    d = x.shape[1] // len(books)
    found = [nearest_entries(x[:, p * d:(p + 1) * d], book) for p, book in enumerate(books)]
    return np.stack([c for c, _ in found], axis=1), np.stack([e for _, e in found], axis=1)


def _sums(rows: DataFrame, vector_col: str, books: list[np.ndarray], scale: float):
    """(slot, count, sums) of every used entry; slot = part * entries + entry.  Sums are decimal texts: exact at any size."""
    parts, size = len(books), len(books[0])

    def add(batches):
        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = whole_numbers(b.column(0), scale)
            codes, _ = assign(x, books)
            d = x.shape[1] // parts
            for p in range(parts):
                part, code = x[:, p * d:(p + 1) * d], codes[:, p]
                order = np.argsort(code, kind="stable")
                first = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) != 0)))
                sums, counts = np.add.reduceat(part[order], first, axis=0), np.diff(np.append(first, len(code)))
                for c, n, v in zip(code[order][first].tolist(), counts.tolist(), sums):
                    _merge(total, p * size + c, n, [int(y) for y in v])
        yield _slots(total)

    def join(batches):
        total: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            for slot, n, v in zip(*(c.to_pylist() for c in b.columns)):
                _merge(total, slot, n, [int(y) for y in v])
        yield _slots(total)

    kind = "slot int, n long, sums array<string>"
    return rows.select(f"`{vector_col}`").mapInArrow(add, kind).repartition("slot").mapInArrow(join, kind).collect()


def _merge(total, slot, n, v):
    if slot in total:
        m, w = total[slot]
        n, v = n + m, [a + b for a, b in zip(v, w)]
    total[slot] = n, v


def _slots(total):
    slots = sorted(total)
    return pa.RecordBatch.from_arrays(
        [pa.array(slots, pa.int32()), pa.array([total[s][0] for s in slots], pa.int64()),
         pa.array([[str(y) for y in total[s][1]] for s in slots], pa.list_(pa.string()))], names=["slot", "n", "sums"])


def _book(rows: list[list[int]]) -> np.ndarray:
    book = np.array(rows, object)
    small = all(abs(v) * 2 * len(r) ** 0.5 < 2.0 ** 22 for r in rows for v in r)
    return book.astype(np.float64) if small else book


def train_codebooks(rows: DataFrame, id_col: str, vector_col: str, parts: int = 4, entries: int = 256, rounds: int = 4,
                    scale: float = 1024.0) -> list[np.ndarray]:
    """One (entries, components) table of whole numbers for each part; ``rows`` as ``kept_vectors`` gives them."""
    v = F.col(f"`{vector_col}`")
    seed = rows.orderBy(F.col(f"`{id_col}`").asc_nulls_last(), v).limit(entries).select(v.alias("v")).toArrow()
    if not seed.num_rows:
        return []
    x = whole_numbers(seed.column(0).combine_chunks(), scale)
    d = x.shape[1] // parts
    books = [_book([[int(y) for y in r[p * d:(p + 1) * d]] for r in x]) for p in range(parts)]
    for _ in range(rounds):
        values = [[[int(y) for y in r] for r in book] for book in books]
        for r in _sums(rows, vector_col, books, scale):
            part, entry = divmod(r.slot, len(x))
            values[part][entry] = [int(y) // r.n for y in r.sums]
        books = [_book(v) for v in values]
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
                   parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ``code`` (two hex digits a part), ``error``, ``label_error``
    (the error summed over equal labels, nulls together) and ``codebooks_sha256``."""
    if not 1 <= entries <= 256:
        raise ValueError("codes of two hex digits hold up to 256 entries")
    results = ["code", "error", "label_error", "codebooks_sha256"]
    keep = [c for c in (vectors.columns if keep is None else keep) if c.lower() not in results]
    label = free_name(vectors, "label_")
    rows = kept_vectors(vectors, id_col, vector_col, parts).withColumn(label, F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int"))
    books = train_codebooks(rows, id_col, vector_col, parts, entries, rounds, scale)

    def run(column):
        if not len(column):
            return [pa.array([], pa.string()), pa.array([], pa.int64())]
        codes, errors = assign(whole_numbers(column, scale), books)
        total = [sum(int(e) for e in r) for r in errors]
        return [pa.array([bytes(r).hex() for r in codes.astype(np.uint8)]), pa.array([e if e < 1 << 63 else None for e in total], pa.int64())]

    fields = [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    coded = materialize(scan(rows, fields, vector_col, run, keep=[*keep, label]), "codes")
    sums = materialize(coded.groupBy(F.col(label).alias("label_of")).agg(F.sum("error").alias("label_error")), "label-errors")
    same = F.col(label).eqNullSafe(F.col("label_of"))
    if sums.count() <= MOST_LABELS:
        named = coded.join(F.broadcast(sums), same)
    else:  # a label may hold a third of the rows: its sum is joined in sixteen places
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in keep], "code"), F.lit(16))
        wide = sums.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<long>")))
        named = coded.withColumn(free_name(coded, "salt_"), salt)
        named = named.join(wide, same & (F.col(named.columns[-1]) == F.col("salt_of")))
    return named.select(*[F.col(f"`{c}`") for c in keep], "code", "error", "label_error",
                        F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
