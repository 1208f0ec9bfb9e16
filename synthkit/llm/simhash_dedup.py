"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints: words are runs without ASCII white space after lower-casing A-Z; shingles of ``size``
words (repeats included; fewer words: the whole sequence) are hashed by XXH64 with seed 42; a bit is
set where over half of the hashes have it.  No words: fingerprint 0, linked like any other.

Links: two fingerprints at ``radius`` or fewer differing bits.  The 64 bits are cut into ``blocks``
blocks; such a pair agrees on ``blocks - radius`` of them, so every choice of that many blocks keys one
table of buckets.  Tasks read their buckets in key order.  64 fingerprints in a row are stored as bit
planes (word b holds bit b of all 64); a fingerprint is compared with 64 others at once by XOR of its
bits with the planes, and carry-save counters (``ones``, ``twos`` and a sticky overflow) update the 64
distances.  After every eight planes, blocks in which all distances exceed the radius are abandoned.

Buckets of over ``bucket`` distinct fingerprints (large groups of near copies) are left out of the
tables and handled exactly in another way: for a radius of 2, two fingerprints are within the radius
just when some number is within one bit of both, so each of these fingerprints is written under its 65
neighbours and tied to the smallest fingerprint of each neighbour.  A neighbour has 65 fingerprints at
most, so this stays linear however large the group is.

Components: fingerprints (not documents) are joined to the smallest one they reach, by alternating
large-star and small-star steps over the links until nothing changes.

Defined results: null text is empty text; repeated rows and ids are judged each (equal texts have
equal fingerprints); a null id is never a component's id unless the component has no other; an empty
table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.llm.common import free_name, materialize, scan

SEED = 42
MOST_BROADCAST = 2_000_000  # row numbers, some 16 MB
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_SHIFTS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split() if text else []  # bytes: lowers A-Z only, splits at ASCII white space only
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    h = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65536):
        hashes = np.array([h(s, SEED) for s in shingles[at:at + 65536]], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(shingles), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text_col: str = "text", size: int = 3, name: str = "fingerprint",
                     keep: list[str] | None = None) -> DataFrame:
    """``docs`` plus the fingerprint as a signed bigint; no shuffle."""
    keep = docs.columns if keep is None else keep
    data = free_name(docs, "data")

    def run(column):
        prints = np.array([fingerprint(t.as_py(), size) for t in column], np.uint64)
        return [pa.array(prints.view(np.int64))]

    src = docs.withColumn(data, F.col(f"`{text_col}`").cast("binary")).select(*[F.col(f"`{c}`") for c in keep], data)
    return scan(src, [T.StructField(name, T.LongType())], data, run, keep=keep)


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(blocks, 64): word b of a block holds bit b of its 64 fingerprints; the last block is filled with its last one."""
    blocks = -(-len(prints) // 64)
    full = np.concatenate([prints, np.full(blocks * 64 - len(prints), prints[-1], np.uint64)]).reshape(blocks, 64)
    planes = np.empty((blocks, 64), np.uint64)
    for b in range(64):
        planes[:, b] = (((full >> np.uint64(b)) & _ONE) << _SHIFTS).sum(axis=1, dtype=np.uint64)
    return planes


def compare(prints: np.ndarray, planes: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (query, other) of all pairs within the radius (up to 3), for lists of (query, block) pairs."""
    if not 0 <= radius <= 3:
        raise ValueError("two-bit counters hold distances of up to 3")
    q, p = prints[query], planes[block]
    ones, twos, over = (np.zeros(len(query), np.uint64) for _ in range(3))
    for b in range(64):
        differ = p[:, b] ^ (_ALL * ((q >> np.uint64(b)) & _ONE))
        carry = ones & differ
        ones ^= differ
        over |= twos & carry
        twos ^= carry
        if b % 8 == 7:
            beyond = over | _beyond(ones, twos, radius)
            alive = beyond != _ALL
            if not alive.all():
                query, block, q, p = query[alive], block[alive], q[alive], p[alive]
                ones, twos, over = ones[alive], twos[alive], over[alive]
                if not len(query):
                    break
    near = ~(over | _beyond(ones, twos, radius))
    pair, bit = np.nonzero((near[:, None] >> _SHIFTS) & _ONE)
    other = block[pair] * 64 + bit
    inside = other < len(prints)
    return query[pair][inside], other[inside]


def _beyond(ones, twos, radius):
    """Bits whose count, as held by the two counters, is over the radius."""
    return {0: ones | twos, 1: twos, 2: ones & twos, 3: np.zeros_like(ones)}[radius]


def bucket_links(keys: np.ndarray, prints: np.ndarray, radius: int, chunk: int = 1 << 15):
    """Pairs (a, b) of fingerprints within the radius that share a key; both arrays are sorted by key."""
    if len(prints) < 2:
        return
    planes = bit_planes(prints)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    first, last = np.repeat(edge[:-1], np.diff(edge)), np.repeat(edge[1:], np.diff(edge)) - 1
    index = np.arange(len(prints))
    busy = index < last  # each pair is looked at from its first member
    index, upto = index[busy], last[busy] // 64
    begin = index // 64
    counts = upto - begin + 1
    ends = np.cumsum(counts)
    at = 0
    while at < len(index):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, "right")))
        n = counts[at:stop]
        query = np.repeat(index[at:stop], n)
        block = np.repeat(begin[at:stop], n) + np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
        a, b = compare(prints, planes, query, block, radius)
        keep = (a < b) & (keys[a] == keys[b])
        if keep.any():
            yield prints[a[keep]], prints[b[keep]]
        at = stop


def _tables(radius: int, blocks: int) -> list[int]:
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(m) for m in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = 2, blocks: int = 4, bucket: int = 2048) -> DataFrame:
    """Links (a, b) among the distinct bigint ``fingerprint`` values; enough for every pair within the radius to be joined.

    Pairs that share a bucket of up to ``bucket`` fingerprints are all given; in larger ones, links to
    the smallest fingerprint of each shared neighbour stand for the pairs.
    """
    if not 0 <= radius < blocks:
        raise ValueError("need 0 <= radius < blocks")
    keys = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("k"))
                     for t, m in enumerate(_tables(radius, blocks))])
    keyed = prints.select("fingerprint", F.explode(keys).alias("key")).select("key.t", "key.k", "fingerprint")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["t", "k"])  # lone fingerprints go no further
    fits = F.col("n") <= bucket if radius <= 2 else F.lit(True)
    small = (shared.where(fits).select("t", "k", "fingerprint")
             .repartition("t", "k").sortWithinPartitions("t", "k"))

    def run(batches):
        rest = None
        for b in batches:
            t, k, p = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            key = np.stack([t.astype(np.int64), k], axis=1)
            if rest is not None:
                key, p = np.concatenate([rest[0], key]), np.concatenate([rest[1], p])
            if not len(p):
                continue
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1  # the last bucket may go on in the next batch
            cut = int(new[-1]) if len(new) else 0
            rest = key[cut:], p[cut:]
            yield from emit(key[:cut], p[:cut])
        if rest is not None:
            yield from emit(*rest)

    def emit(key, p):
        if len(p) < 2:
            return
        number = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).any(axis=1))))
        for a, b in bucket_links(number, p.view(np.uint64), radius):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    found = small.mapInArrow(run, "a long, b long")
    if radius > 2:
        return found  # neighbours of one bit meet up to a distance of two only, so large buckets are compared like the others
    large = shared.where(F.col("n") > bucket).select("fingerprint").distinct()
    flips = [F.col("fingerprint"), *[F.col("fingerprint").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)]]
    near = large.select("fingerprint", F.explode(F.array(*flips)).alias("near"))
    least = near.withColumn("least", F.min("fingerprint").over(Window.partitionBy("near")))
    if radius == 2:
        tied = least.where("least <> fingerprint").select(F.col("least").alias("a"), F.col("fingerprint").alias("b"))
    else:  # one bit apart or equal: the neighbour is one of the two
        tied = near.join(large.withColumnRenamed("fingerprint", "other"), F.col("near") == F.col("other")).where(
            "other < fingerprint").select(F.col("other").alias("a"), F.col("fingerprint").alias("b"))
    return found.unionByName(tied)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node reaches; nodes without edges are left out.

    Edges are pairs (a, b) of bigints.  Each round writes its edges to the shared folder; it ends when a
    round changes nothing.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, before = materialize(pairs, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        # large star: larger neighbours go to the smallest of the node's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = now.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours, and the node itself, go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialize(star.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2,
                    blocks: int = 4, bucket: int = 2048, keep: list[str] | None = None, root: str | None = None) -> DataFrame:
    """``doc_id``, ``fingerprint`` (bigint) and ``component_id`` of every row, plus the ``keep`` columns."""
    keep = keep or []
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{c}`") for c in keep if c != id_col], F.col(f"`{text_col}`").alias(free_name(docs, "text_")))
    rows = materialize(with_fingerprint(src, src.columns[-1], size, keep=src.columns[:-1]), "fingerprints")
    return assign_components(rows, radius, blocks, bucket, root)


def assign_components(rows: DataFrame, radius: int = 2, blocks: int = 4, bucket: int = 2048, root: str | None = None) -> DataFrame:
    """Add ``component_id`` to a table with ``doc_id`` and ``fingerprint`` (and the component's smallest fingerprint as ``root``)."""
    prints = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "prints")
    roots = materialize(components(links(prints.select("fingerprint"), radius, blocks, bucket)), "roots")
    rooted = prints.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fingerprint", "component_id", *([F.col("root").alias(root)] if root else []))
    return rows.join(named, "fingerprint")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component (the one of smallest id; of rows with that id, one), same columns.

    Rows are numbered, so that of repeated rows just one stays.  Just the numbers of the rows that go are put
    together: up to ``MOST_BROADCAST`` of them are broadcast, and no text is shuffled; more are joined.
    """
    row = free_name(docs, "row_")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    found = near_duplicates(numbered.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), row), id_col, text_col, keep=[row], root="root", **options)
    found = materialize(found.select("root", "doc_id", row), "components")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("r"))
    several = found.groupBy("root").agg(F.min(order).alias("x"), F.count("*").alias("n")).where("n > 1")
    gone = materialize(found.join(several, "root").where(F.col(row) != F.col("x.r")).select(row), "gone")
    if gone.count() <= MOST_BROADCAST:
        gone = F.broadcast(gone)
    return numbered.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
