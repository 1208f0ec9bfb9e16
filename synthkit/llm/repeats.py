"""Repeated passages by an enhanced suffix array: its common-prefix interval tree gives the maximal repeats.

Texts are UTF-8 bytes; a repeat is a string of at least ``least`` bytes (a window) that occurs twice or more.

Which suffixes must meet: the smallest hash of the ``gram``-byte substrings of a window (its minimizer) is the
same wherever the window occurs.  A stretch is a run of windows with one minimizer, which is its key; so all
suffixes that share ``least`` bytes are in one key's suffix array, and no suffix array of all texts is needed.  Equal stretches under a key (a class; 128 bits of hash) are one leaf
with many occurrences: copies collapse before the shuffle, a block of documents at a time.

One key's suffix array: the suffixes at the starts of the windows of its classes are sorted, with the common
prefix lengths of neighbours.  A stack scan builds the tree of common-prefix intervals from the bottom up.  An
interval whose suffixes are preceded by different bytes (or start a stretch, whose left part another key may
have) cannot be extended to the left, and its prefix cannot be extended to the right: it is a maximal repeat
of the stretches, and all suffixes of the interval are its occurrences.  A passage longer than a stretch comes
as a chain of repeats whose occurrences overlap.  (Only where a text repeats itself within ``least`` bytes can a
stretch pass ``LONGEST`` windows; it is cut there, and a group holds the occurrences that no cut divides.)

``remove_repeats`` removes every occurrence of a repeat in a document with a larger id than the repeat's
smallest.  Each interval carries its smallest id and the suffixes that are not yet known to have a smaller one,
so the scan is linear.  ``maximal_repeats`` lists all groups with all occurrences.

Keys with over ``most`` classes (a frequent line within as many different texts) are split by their windows:
the smallest id of every window, aggregated before the shuffle, decides its occurrences (exact).

Defined results: a null text is empty; a text shorter than ``least`` holds no repeat; ids are compared as
numbers, a null id counts as the largest; rows with one id never remove each other's text, but a row may lose
what an earlier id has; repeated rows get equal results; an empty table gives an empty result.  Kept columns
named like a result are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.llm.common import free_name, materialize

BLOCK = 1 << 20  # bytes hashed at a time
MERGE = 16 << 20  # bytes of documents whose equal stretches collapse before the shuffle
LONGEST = 64  # windows in a stretch; longer runs of one minimizer are cut
MOST = 20_000  # classes of a key in one suffix array
_LAST = (1 << 63) - 1
_RNG = np.random.default_rng(29)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int):
    """Powers of the hash base and of its inverse modulo 2^64, for blocks of up to n bytes."""
    size = 1 << max(20, (n + 1).bit_length())
    if size not in _POWERS:
        def run(x):
            steps = np.full(size, x % 2**64, np.uint64)
            steps[0] = 1
            return np.multiply.accumulate(steps)
        _POWERS.clear()  # one table at a time
        _POWERS[size] = run(_BASE), run(pow(_BASE, -1, 2**64))
    return _POWERS[size]


def _hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Mixed hash of every substring of ``length`` bytes."""
    up, down = _powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * up[:len(data)], dtype=np.uint64)))
    x = (total[length:] - total[:-length]) * down[:len(data) - length + 1]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    return x if size == width else np.minimum(x[:size - width], x[width - size:])


def stretches(texts: list[bytes], least: int, gram: int):
    """(text number, start, windows, key, class) arrays of all stretches of some texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = b"".join(texts)
    if len(data) < least:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    ends = np.cumsum(sizes)
    low = _sliding_min(_hashes(np.frombuffer(data, np.uint8), gram), least - gram + 1)
    number = np.repeat(np.arange(len(texts)), np.maximum(sizes - least + 1, 0))
    begin = ends - sizes
    windows = np.maximum(sizes - least + 1, 0)
    at = np.arange(len(number)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[number]
    key = low[at]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (number[1:] != number[:-1]))) if len(at) else np.zeros(0, bool)
    run = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    first = np.flatnonzero(place % LONGEST == 0)
    count = np.diff(np.append(first, len(at)))
    number, start, key = number[first], at[first], key[first]
    digest = xxhash.xxh3_64_intdigest
    cls = np.fromiter((digest(data[a:b]) for a, b in zip(start.tolist(), (start + count + least - 1).tolist())), np.uint64, len(start))
    return number, start - begin[number], count, key, cls


def _blocks(texts, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _all_stretches(texts, least, gram):
    parts = []
    for a, b in _blocks(texts, BLOCK):
        number, *rest = stretches(texts[a:b], least, gram)
        parts.append((number + a, *rest))
    return [np.concatenate(c) for c in zip(*parts)]


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, text): ``doc`` is a number of the id and text, so equal rows share it."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    number = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST))
    return docs.select(number.alias("id"), F.xxhash64(number, text).alias("doc"), text.alias("text"))


def _gram(least: int) -> int:
    if least < 2:
        raise ValueError("least must be at least 2 bytes")
    return min(16, max(1, least // 3))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_FOUND = "key long, class long, id long, doc long, start int, n int"


def _found_rows(docs: DataFrame, least: int) -> DataFrame:
    """Stretches of a block's smallest id for each class (key, class, id, doc, start, windows), and the ranges
    (doc as key, no class, start, bytes) of those that a smaller id of the same block has too."""
    gram = _gram(least)

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            ids, docs_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in _blocks(texts, MERGE):
                number, start, n, key, cls = _all_stretches(texts[a:b], least, gram)
                if len(key):
                    yield from _collapse(ids[a:b][number], docs_[a:b][number], start, n, key, cls, least)

    return docs.mapInArrow(run, _FOUND)


def _collapse(ids, docs, start, n, key, cls, least):
    order = np.lexsort((start, docs, ids, cls, key))
    ids, docs, start, n, key, cls = (c[order] for c in (ids, docs, start, n, key, cls))
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])))
    smallest = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
    stay = ids == smallest
    again = np.concatenate(([False], ~new[1:] & (docs[1:] == docs[:-1]) & (start[1:] == start[:-1])))
    stay_once = stay & ~again
    yield pa.RecordBatch.from_arrays(
        [_signed(key[stay_once]), _signed(cls[stay_once]), pa.array(ids[stay_once]), pa.array(docs[stay_once]),
         pa.array(start[stay_once].astype(np.int32)), pa.array(n[stay_once].astype(np.int32))], names=_names(_FOUND))
    doc, a, b = merge_ranges(docs[~stay], start[~stay], start[~stay] + n[~stay] + least - 1)
    if len(doc):
        none = pa.nulls(len(doc), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(doc), none, none, pa.array(doc), pa.array(a.astype(np.int32)),
                                          pa.array((b - a).astype(np.int32))], names=_names(_FOUND))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def merge_ranges(doc, a, b):
    """Overlapping or touching ranges [a, b) of each doc joined."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    group = np.concatenate(([True], doc[1:] != doc[:-1]))
    if len(doc) > 1:  # the running end within a doc, by shifting every doc above the ones before
        shift = (np.cumsum(group) - 1) * (int(b.max()) + 1)
        reach = np.maximum.accumulate(b + shift) - shift
        group[1:] |= a[1:] > reach[:-1]
    first = np.flatnonzero(group)
    return doc[first], a[first], np.maximum.reduceat(b, first)


_SORTED = "kind byte, key long, id long, doc long, start int, n int"


def _by_class(found: DataFrame, least: int) -> DataFrame:
    """Kind 0: ranges (doc, start, bytes) to remove, as their class has a smaller id.  Kind 1: stretches of the
    smallest id of their class, where the key has other classes."""
    rows = found.repartition("key").sortWithinPartitions("key", "class", "id", "doc", "start")

    def run(batches):
        held = None  # smallest stretches of the last key while it has one class
        last, many = None, None  # (key, class, smallest id) of the last row; the last key if it has several classes
        for b in batches:
            done = np.asarray(b.column(1).is_null())
            if done.any():
                c = [x.to_numpy(zero_copy_only=False) for x in b.filter(pa.array(done)).select(["doc", "start", "n"]).columns]
                yield out(0, None, None, *c)
                b = b.filter(pa.array(~done))
            if not b.num_rows:
                continue
            key, cls, ids, doc, start, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            new = np.concatenate(([last is None or (key[0], cls[0]) != last[:2]], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])))
            at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            smallest = np.where(at < 0, last[2] if last else 0, ids[at])
            gone = ids > smallest
            if gone.any():
                yield out(0, None, None, doc[gone], start[gone], n[gone] + least - 1)
            last = key[-1], cls[-1], smallest[-1]
            stay = ~gone
            rows = [c[stay] for c in (key, cls, ids, doc, start, n)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            held = None
            key, cls, ids, doc, start, n = rows
            if not len(key):
                continue
            first = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.cumsum(first) - 1
            classes = np.bincount(group, first | np.concatenate(([True], cls[1:] != cls[:-1])))
            several = (classes > 1) | (key[np.flatnonzero(first)] == many if many is not None else False)
            send = several[group]
            if send.any():
                yield out(1, key[send], ids[send], doc[send], start[send], n[send])
            if several[-1]:
                many = key[-1]
            else:
                many, tail = None, group == group[-1]
                held = [c[tail] for c in rows]

    def out(kind, key, ids, doc, start, n):
        none = pa.nulls(len(doc), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(doc), kind, np.int8)), none if key is None else pa.array(key), none if ids is None else pa.array(ids),
             pa.array(doc), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=_names(_SORTED))

    return rows.mapInArrow(run, _SORTED)


_LEAF = "key long, id long, doc long, start int, copies int, content binary"


def _leaves(wanted: DataFrame, source: DataFrame, least: int) -> DataFrame:
    """The bytes of stretches (key, doc, start, n, copies): one row a stretch."""
    asked = wanted.groupBy("doc").agg(F.collect_set(F.struct("key", "start", "n", "copies")).alias("asked"))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def run(batches):
        seen, rows = set(), []  # repeated rows are read once
        for b in batches:
            for number, doc, text, asked in zip(*b.columns):
                if doc.as_py() in seen:
                    continue
                seen.add(doc.as_py())
                number, doc, text = number.as_py(), doc.as_py(), text.as_py()
                rows += [(s["key"], number, doc, s["start"], s["copies"], text[s["start"]:s["start"] + s["n"] + least - 1])
                         for s in asked.as_py()]
                if len(rows) >= 1 << 15:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=_names(_LEAF))

    return source.join(asked, "doc").select("id", "doc", "text", "asked").mapInArrow(run, _LEAF)


def suffix_array(group: np.ndarray, content: list[bytes], least: int):
    """(leaf, offset, left byte, common prefix with the next) of the suffixes that share ``least`` bytes with a
    neighbour, sorted within each group.  The left byte of a stretch's first suffix counts as unlike any other."""
    size = np.array([len(c) for c in content], np.int64)
    data = np.frombuffer(b"".join(content), np.uint8)
    n = size - least + 1
    leaf = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum(size) - size
    at = begin[leaf] + offset
    # only windows that occur twice in their group can share a prefix of that length
    window = _hashes(data, least)[at] ^ (group[leaf].astype(np.uint64) * np.uint64(_BASE))
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    leaf, offset, at = leaf[twice], offset[twice], at[twice]
    if not len(at):
        return leaf, offset, np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = size[leaf] - offset
    width = int(length.max())
    keys = np.zeros((len(at), 8 + width), np.uint8)  # group, bytes, length: a suffix comes before longer ones that go on with zeros
    keys[:, :4] = group[leaf].astype(">u4").view(np.uint8).reshape(-1, 4)
    padded = np.concatenate((data, np.zeros(width, np.uint8)))
    keys[:, 4:-4] = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
    keys[:, 4:-4][np.arange(width)[None, :] >= length[:, None]] = 0
    keys[:, -4:] = length.astype(">u4").view(np.uint8).reshape(-1, 4)
    order = np.argsort(keys.view(f"S{8 + width}").ravel(), kind="stable")
    keys, leaf, offset, length = keys[order], leaf[order], offset[order], length[order]
    differ = keys[1:, :-4] != keys[:-1, :-4]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), 4 + width) - 4
    common = np.append(np.minimum(common, np.minimum(length[1:], length[:-1])), 0)
    before = np.where(offset > 0, data[begin[leaf] + np.maximum(offset, 1) - 1].astype(np.int64), -1)
    return leaf, offset, before, common


def interval_tree(common, ids, least: int):
    """Stack scan: (length, first, last, smallest id, members with a smaller id here but in no deeper interval)
    of each common-prefix interval of at least ``least`` bytes, children before parents."""
    stack: list[list] = []  # length, first, smallest id, its suffixes, suffixes with a smaller id
    for i, (depth, number) in enumerate(zip(common, ids)):
        node = [0, i, number, [i], []]
        while stack and stack[-1][0] > depth:
            top = stack.pop()
            _join(top, node)
            yield top[0], top[1], i, top[2], top[4]
            node = top
        if depth < least:
            continue
        if stack and stack[-1][0] == depth:
            _join(stack[-1], node)
        else:
            stack.append([depth, node[1], node[2], node[3], []])


def _join(node, child):
    """Take a child into a node: suffixes of the larger smallest id have a smaller one from here on."""
    if child[2] < node[2]:
        node[4].extend(node[3])
        node[2], node[3] = child[2], child[3]
    elif child[2] > node[2]:
        node[4].extend(child[3])
    else:
        small, large = sorted((node[3], child[3]), key=len)
        large.extend(small)
        node[3] = large


def _by_key(leaves: DataFrame, schema: str, fn) -> DataFrame:
    """``fn(group, columns)`` over runs of whole keys; a run holds the keys of one batch."""
    rows = leaves.repartition("key").sortWithinPartitions("key")

    def run(batches):
        rest = None
        for b in batches:
            b = pa.Table.from_batches([b])
            if rest is not None:
                b = pa.concat_tables([rest, b])
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            rest = b.slice(cut)
            if cut:
                yield from fn(key[:cut], b.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from fn(rest.column("key").to_numpy(), rest)

    return rows.mapInArrow(run, schema)


def _tree(key, rows: pa.Table, least: int):
    """(row, offset) of the sorted suffixes of a run of keys, and the left-diverse intervals of their tree.  A
    stretch with several copies counts as two leaves, so that it is an interval too."""
    row = np.repeat(np.arange(len(key)), np.minimum(rows.column("copies").to_numpy(), 2))
    group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))[row]
    content = rows.column("content").to_pylist()
    leaf, offset, before, common = suffix_array(group, [content[i] for i in row.tolist()], least)
    row = row[leaf]
    change = np.append(0, np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0)))
    found = (x for x in interval_tree(common.tolist(), rows.column("id").to_numpy()[row].tolist(), least)
             if before[x[1]] < 0 or change[x[2]] > change[x[1]])  # left-extension diversity
    return row, offset, found


def _removed_by_tree(leaves: DataFrame, least: int) -> DataFrame:
    def run(key, rows):
        row, offset, found = _tree(key, rows, least)
        who, size = [], []
        for length, _, _, _, members in found:
            who += members
            size += [length] * len(members)
        who = np.array(who, np.int64)
        doc, start = rows.column("doc").to_numpy()[row[who]], rows.column("start").to_numpy()[row[who]] + offset[who]
        doc, a, b = merge_ranges(doc, start, start + np.array(size, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(a.astype(np.int32)), pa.array((b - a).astype(np.int32))], names=["doc", "start", "n"])

    return _by_key(leaves, "doc long, start int, n int", run)


def _windows(leaves: DataFrame, least: int) -> DataFrame:
    """Every window of some stretches."""
    return leaves.select("*", F.explode(F.sequence(F.lit(0), F.length("content") - F.lit(least))).alias("at")).select(
        "key", "id", "doc", "start", "at", "copies", F.substring("content", F.col("at") + 1, F.lit(least)).alias("window"))


def _removed_by_window(leaves: DataFrame, least: int) -> DataFrame:
    """The exact way for keys with very many classes: the smallest id of each window decides."""
    rows = _windows(leaves, least)
    smallest = rows.groupBy("window").agg(F.min("id").alias("smallest"))
    return rows.join(smallest, "window").where("id > smallest").select(
        "doc", (F.col("start") + F.col("at")).alias("start"), F.lit(least).alias("n"))


def _split(wanted: DataFrame, source: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Leaves of the keys for one suffix array each, and those of keys with over ``most`` classes (None: there are none)."""
    heavy = materialize(wanted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"), "heavy")
    leaves = _leaves(wanted, source, least)
    if heavy.isEmpty():
        return leaves, None
    leaves = materialize(leaves, "leaves")  # as many keys as rows / most: a join, not a broadcast
    return leaves.join(heavy, "key", "left_anti").select(*leaves.columns), leaves.join(heavy, "key", "left_semi")


def repeat_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, most: int = MOST) -> DataFrame:
    """(doc, ranges): the byte ranges to remove from each row, as numbered by ``_source``; they may overlap."""
    source = _source(docs, id_col, text_col)
    rows = materialize(_by_class(_found_rows(source, least), least), "classes")
    light, heavy = _split(rows.where("kind = 1").withColumn("copies", F.lit(1)), source, least, most)
    found = [_removed_by_tree(light, least)]
    if heavy is not None:
        found.append(_removed_by_window(heavy, least))
    rows = rows.where("kind = 0").select("doc", "start", "n")
    for part in found:
        rows = rows.unionByName(part)
    return rows.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, most: int = MOST,
                   keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ``n_bytes``, ``n_removed``, ``n_spans``, the removed byte
    ``spans`` (start, end) and ``kept_bytes``, what is left of the text (binary, as a cut may split a character)."""
    results = ["n_bytes", "n_removed", "n_spans", "spans", "kept_bytes"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    ranges = materialize(repeat_ranges(docs, id_col, text_col, least, most), "ranges")
    number = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST))
    data, doc, where = (free_name(docs, x) for x in ("data_", "doc_", "ranges_"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(number, text).alias(doc), text.alias(data))
    rows = rows.join(ranges.select(F.col("doc").alias(doc), F.col("ranges").alias(where)), doc, "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], data, where)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
              T.StructField("spans", span), T.StructField("kept_bytes", T.BinaryType())]
    schema = T.StructType([*(rows.schema[c] for c in keep), *fields])
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            size, gone, spans, left = [], [], [], []
            for text, ranges in zip(b.column(len(keep)), b.column(len(keep) + 1)):
                text = text.as_py()
                cut = np.array([(r["start"], r["n"]) for r in ranges.as_py() or ()], np.int64).reshape(-1, 2)
                _, s, e = merge_ranges(np.zeros(len(cut), np.int64), cut[:, 0], cut[:, 0] + cut[:, 1])
                s, e = s.tolist(), e.tolist()
                size.append(len(text))
                gone.append(sum(e) - sum(s))
                spans.append([{"start": x, "end": y} for x, y in zip(s, e)])
                left.append(b"".join(text[x:y] for x, y in zip([0, *e], [*s, len(text)])))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, arrow_span), pa.array(left, pa.binary())],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, most: int = MOST) -> DataFrame:
    """All maximal repeat groups with all occurrences: ``repeat_id``, ``length`` (bytes), ``smallest_id`` and, one
    row for each occurrence, ``id``, ``doc`` (number of the row's id and text) and ``start`` (byte).

    Repeats within one text count.  The classes of a key meet in one suffix array; their occurrences are joined
    afterwards, so copies do not meet.  Keys with over ``most`` classes give all their repeated windows.
    """
    source, gram = _source(docs, id_col, text_col), _gram(least)

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            ids, docs_ = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for x, y in _blocks(texts, MERGE):
                number, start, n, key, cls = _all_stretches(texts[x:y], least, gram)
                yield pa.RecordBatch.from_arrays([_signed(key), _signed(cls), pa.array(ids[x:y][number]), pa.array(docs_[x:y][number]),
                                                  pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=_names(_FOUND))

    every = materialize(source.mapInArrow(run, _FOUND).distinct(), "stretches")
    classes = every.groupBy("key", "class").agg(F.min(F.struct("id", "doc", "start", "n")).alias("x"), F.count("*").cast("int").alias("copies"))
    shared = classes.groupBy("key").agg(F.sum("copies").alias("all")).where("all > 1").select("key")
    wanted = materialize(classes.join(shared, "key").select("key", "class", "x.*", "copies"), "shared")
    light, heavy = _split(wanted, source, least, most)
    kind = "key long, serial long, length int, doc long, start int, offset int"

    def groups(key, rows):
        row, offset, found = _tree(key, rows, least)
        doc, start = rows.column("doc").to_numpy(), rows.column("start").to_numpy()
        out = [(int(key[row[first]]), serial, length, int(doc[row[i]]), int(start[row[i]]), int(offset[i]))
               for serial, (length, first, last, _, _) in enumerate(found) for i in range(first, last + 1)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=_names(kind))

    members = _by_key(light, kind, groups)
    if heavy is not None:
        windows = _windows(heavy, least).withColumn("serial", F.xxhash64("window"))
        shared = windows.groupBy("key", "serial").agg(F.sum("copies").alias("n")).where("n > 1")
        members = members.unionByName(windows.join(shared, ["key", "serial"]).select(
            "key", "serial", F.lit(least).alias("length"), "doc", "start", F.col("at").alias("offset")))
    # from the first occurrence of a class to all of them
    members = members.join(wanted.select("key", "class", "doc", "start"), ["key", "doc", "start"]).drop("doc", "start")
    placed = members.join(every, ["key", "class"]).select(
        F.xxhash64("key", "serial").alias("repeat_id"), "length", "id", "doc", (F.col("start") + F.col("offset")).alias("start")).distinct()
    smallest = placed.groupBy("repeat_id").agg(F.min("id").alias("smallest_id"))
    return placed.join(smallest, "repeat_id")
