"""Best-fit packing by linear grouping: documents into as few sequences of ``capacity`` tokens as it can.

The plan is made from the histogram of piece lengths alone (at most ``capacity`` numbers, whatever
the table's size), as lengths are integers up to ``capacity`` and pieces of equal length can stand for
each other:

1. Lengths above a cut (a few cuts are tried) are sorted, cut into groups of equal cardinality and rounded up to the
   group's largest, which leaves few sizes.
2. The best mix of configurations (multisets of these sizes that fit) comes from the configuration
   linear programme by column generation (a knapsack finds the next column); counts are rounded down.
3. Actual lengths take the places of their group, longest first; what the rounding gave away is room again.
4. The rest (small pieces and the few large ones left over) goes in by best fit, longest first.

The plan is a table of ranges: pieces of a length with ranks r..r+n-1 go to sequences b, b+1, ... at an
offset.  Its size depends on ``capacity`` only, so it is broadcast.  Ranks come from a count by
(length, salt), so a length that holds a third of all rows spreads over all tasks.

Defined results: null text is empty (one piece: the end id); repeated rows are packed each; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.llm.common import materialize, scan
from synthkit.llm.tokens import END_ID, encoder

_PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                       T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
                 end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ``ids`` if asked for)."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = T.StructType([*_PIECE.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    arrow = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                                *([("ids", pa.list_(pa.int32()))] if with_ids else [])]))
    end = np.array([end_id], "<u4").tobytes()

    def pieces(column):
        enc, out = encoder(tokenizer), []
        for text in column:
            data = enc.encode(text.as_py()) + end
            row = []
            for k, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                part = data[4 * start:4 * (start + length)]
                row.append({"piece": k, "start": start, "length": length, "ids_crc32": zlib.crc32(part),
                            **({"ids": np.frombuffer(part, "<u4").astype(np.int32)} if with_ids else {})})
            out.append(row)
        return [pa.array(out, arrow)]

    found = scan(src, [T.StructField("pieces", T.ArrayType(kind))], "text", pieces, keep=["doc_id"], table=("encoder", tokenizer))
    return found.select("doc_id", F.inline("pieces"))


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[tuple[int, ...], float]]:
    """Mix of configurations (how many of each size) for the demand: column generation on the linear programme."""
    k = len(sizes)
    basis = np.zeros((k, k))
    np.fill_diagonal(basis, [capacity // s for s in sizes])
    need = np.array(demand, float)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        value, column = _best_configuration(sizes, price, capacity)
        if value <= 1 + 1e-7:
            break
        x, step = np.linalg.solve(basis, np.stack([need, column], axis=1)).T
        ratio = np.where(step > 1e-9, np.maximum(x, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, need)
    return [(tuple(int(round(v)) for v in basis[:, j]), float(x[j])) for j in range(k) if x[j] > 1e-9]


def _best_configuration(sizes, price, capacity):
    """Knapsack: the configuration of the highest total price."""
    best, taken = np.zeros(capacity + 1), []
    for s, p in zip(sizes, price):
        choice = np.zeros(capacity + 1, np.int16)
        if p > 0:
            new = best.copy()
            for m in range(1, capacity // s + 1):
                with_m = best[:capacity + 1 - m * s] + m * p
                better = with_m > new[m * s:] + 1e-12
                new[m * s:][better] = with_m[better]
                choice[m * s:][better] = m
            best = new
        taken.append(choice)
    column, room = np.zeros(len(sizes)), capacity
    for g in range(len(sizes) - 1, -1, -1):
        column[g] = taken[g][room]
        room -= int(column[g]) * sizes[g]
    return best[capacity], column


#: Shares of the capacity above which a length counts as large: each is tried, the fewest sequences win.
CUTS = (1 / 2, 5 / 12, 1 / 3, 1 / 4)


def plan(histogram: dict[int, int], capacity: int = 1024, groups: int = 96,
         cuts: tuple[float, ...] = CUTS) -> tuple[list[tuple], int]:
    """The plan of fewest sequences over the cuts between large and small lengths (see :func:`plan_at`)."""
    return min((plan_at(histogram, capacity, int(capacity * c), groups) for c in cuts), key=lambda p: p[1])


def plan_at(histogram: dict[int, int], capacity: int, small: int, groups: int) -> tuple[list[tuple], int]:
    """Ranges (length, rank, n_bins, times, bin, offset) and the number of sequences.

    Pieces of ``length`` with ranks ``rank`` to ``rank + n_bins * times - 1`` go, ``times`` to a sequence one
    behind the other, to the ``n_bins`` sequences from ``bin`` on at ``offset``.
    """
    left = {n: c for n, c in histogram.items() if c}
    bins: list[tuple[int, int, list[tuple[int, int]]]] = []  # first bin, number of bins, contents (length, times)
    n_bins = left.get(capacity, 0)
    if n_bins:
        bins.append((0, n_bins, [(capacity, 1)]))
        del left[capacity]
    large = sorted((n for n in left if n > small), reverse=True)
    if large:
        total, runs = sum(left[n] for n in large), {}
        sizes, seen, per = [], 0, -(-sum(left[n] for n in large) // min(groups, len(large)))
        for n in large:  # each length's pieces belong to the groups that their ranks fall into
            rest = left[n]
            while rest:
                g = seen // per
                take = min(rest, (g + 1) * per - seen)
                if g not in runs:
                    runs[g] = []
                runs[g].append([n, take])
                seen, rest = seen + take, rest - take
        by_size: dict[int, list[list[int]]] = {}  # groups with equal largest length are one size
        for g in sorted(runs):
            by_size.setdefault(runs[g][0][0], []).extend(runs[g])
        assert seen == total
        sizes = sorted(by_size, reverse=True)
        demand = [sum(c for _, c in by_size[s]) for s in sizes]
        for config, x in configurations(sizes, demand, capacity):
            count = int(x + 1e-6)
            places = [s for s, m in zip(sizes, config) for _ in range(m)]
            count = min([count, *(sum(c for _, c in by_size[s]) // m for s, m in zip(sizes, config) if m)])
            if count < 1 or not places:
                continue
            rows = [_take(by_size[s], count) for s in places]
            at = sorted({0, *(e for r in rows for e in np.cumsum([c for _, c in r]).tolist())})
            for a, b in zip(at, at[1:]):
                bins.append((n_bins + a, b - a, [(_length_at(r, a), 1) for r in rows]))
            n_bins += count
        left = {n: c for n, c in left.items() if n <= small}
        for runs_of in by_size.values():
            for n, c in runs_of:
                if c:
                    left[n] = left.get(n, 0) + c
    bins, n_bins = _best_fit(bins, n_bins, left, capacity)
    rank: dict[int, int] = {}
    out = []
    for first, n, contents in bins:
        offset = 0
        for length, times in contents:
            out.append((length, rank.get(length, 0), n, times, first, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += length * times
    assert rank == {n: c for n, c in histogram.items() if c}
    return out, n_bins


def _take(runs: list[list[int]], count: int) -> list[tuple[int, int]]:
    """Take ``count`` pieces from the front of (length, count) runs."""
    out = []
    for run in runs:
        n = min(run[1], count)
        if n:
            out.append((run[0], n))
            run[1] -= n
            count -= n
        if not count:
            break
    return out


def _length_at(runs, at):
    for n, c in runs:
        if at < c:
            return n
        at -= c
    raise IndexError(at)


def _best_fit(bins, n_bins, left, capacity):
    """Pieces, longest first, into the sequences with the least room that is enough; new sequences only if none has."""
    rooms: dict[int, list] = {}
    for b in bins:
        rooms.setdefault(capacity - sum(n * t for n, t in b[2]), []).append(b)
    keys = sorted(rooms)

    def put(room, b):
        if room not in rooms:
            rooms[room] = []
            insort(keys, room)
        rooms[room].append(b)

    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            k = bisect_left(keys, length)
            if k == len(keys):
                per = capacity // length
                n, odd = divmod(count, per)
                if n:
                    put(capacity - per * length, (n_bins, n, [(length, per)]))
                if odd:
                    put(capacity - odd * length, (n_bins + n, 1, [(length, odd)]))
                n_bins += n + bool(odd)
                break
            room = keys[k]
            first, n, contents = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(k)
            per = room // length  # with one more piece it is again the fullest that fits
            full, odd = min(n, count // per), 0
            if full:
                put(room - per * length, (first, full, [*contents, (length, per)]))
            if full < n and (odd := count - full * per):
                put(room - odd * length, (first + full, 1, [*contents, (length, odd)]))
            if full + bool(odd) < n:
                put(room, (first + full + bool(odd), n - full - bool(odd), contents))
            count -= full * per + odd
    return [b for r in rooms.values() for b in r], n_bins


def pack(pieces: DataFrame, capacity: int = 1024, groups: int = 96) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces (column ``length``, 1 to ``capacity``).

    ``pieces`` is read three times, so pass a table, not a long plan.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges, _ = plan(histogram, capacity, groups=groups)
    schema = "length long, first long, n_bins long, times long, bin long, at long"
    plan_rows = spark.createDataFrame(ranges, schema)  # bounded by capacity, not by the table
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = pieces.columns
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (salted.withColumn("_row", F.row_number().over(within)).join(counts, ["length", "_salt"])
              .withColumn("_rank", F.col("_before") + F.col("_row") - 1))
    at = F.col("_rank") - F.col("first")
    placed = ranked.join(F.broadcast(plan_rows), "length").where((at >= 0) & (at < F.col("n_bins") * F.col("times")))
    return placed.select(*[F.col(f"`{c}`") for c in names],
                         (F.col("bin") + F.floor(at / F.col("times"))).cast("long").alias("sequence_id"),
                         (F.col("at") + F.pmod(at, F.col("times")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
                   with_ids: bool = False, **options) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and offset (``with_ids``: and its ids)."""
    pieces = token_pieces(docs, id_col, text_col, capacity, with_ids=with_ids, **options)
    return pack(materialize(pieces, "pieces"), capacity)
