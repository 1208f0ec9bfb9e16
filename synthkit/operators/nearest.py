"""Exact nearest neighbours over any number of columns: a quantile split tree and branch and bound by boxes.

The tree is built level by level over the distinct points.  Each node of over ``cell`` points is split along the
column in which its box is widest, at some sixteen quantiles from a mergeable sketch (plus its least and greatest
value, so that every split makes progress whatever the ties); a level is two aggregates by node.  Dense regions
just get more cells: every cell holds ``cell`` points at most.

A query walks down by the cuts of its nodes' columns, which ends in a cell.  The queries and points of a cell meet in one
task, which halves the points down to leaves of ``leaf`` points and searches these by branch and bound, all queries at
once.  Where the distance found stays inside the cell's box, nothing else can be nearer.  The other queries walk
again, to all boxes nearer than that bound, and the cells they reach decide.  So a query meets a few leaves
whatever the number of points, their density and their clusters.  Many queries of one cell are dealt to several tasks.

The tree's tables grow with the points (one row a node); they are joined by node and never collected.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthkit.operators.ordering import written

CELL = 16_384  # points of a cell at most
PART = 65_536  # queries of a cell in one task, about
_CHUNK = 4096  # queries, or meetings of a query and a leaf, at a time
_ROOT = "0"
_WRITTEN_OUT = 16  # columns up to which distances are written out
_CUTS = [i / 16 for i in range(1, 16)]


def _box_distance(x: Column, lo: Column, hi: Column, dims: int) -> Column:
    """Squared distance of a point from a box (0 inside); written out for few columns, as nested functions of arrays cost far more."""
    if dims <= _WRITTEN_OUT:
        return reduce(add, [F.pow(F.greatest(lo[i] - x[i], x[i] - hi[i], F.lit(0.0)), F.lit(2.0)) for i in range(dims)])
    below = F.zip_with(x, lo, lambda a, b: F.greatest(b - a, F.lit(0.0)))
    above = F.zip_with(x, hi, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return F.aggregate(F.zip_with(below, above, lambda p, q: p * p + q * q), F.lit(0.0), lambda s, v: s + v)


def _distance(x: Column, y: Column, dims: int) -> Column:
    if dims <= _WRITTEN_OUT:
        return reduce(add, [F.pow(x[i] - y[i], F.lit(2.0)) for i in range(dims)])
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def _side() -> Column:
    """The number of ``cuts`` below ``x`` along ``axis``."""
    return F.size(F.filter("cuts", lambda v: F.element_at("x", F.col("axis")) > v))


def split_tree(points: DataFrame, dims: int, cell: int = CELL) -> tuple[list[DataFrame], DataFrame]:
    """(levels, cells) of the distinct points ``x`` (array of doubles, not empty, no null).

    A level has one row for each split node: ``node``, ``children`` (node, lo, hi), and the ``way`` (the child for each side of
    the ``cuts`` along ``axis``).  Cells: ``node``, ``x``.
    """
    rows = written(points.select("x").distinct().withColumn("node", F.lit(_ROOT)), "tree")
    levels, cells = [], []
    first, last = (F.array(*[f(F.col("x")[i]) for i in range(dims)]) for f in (F.min, F.max))
    while True:
        boxes = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), first.alias("lo"), last.alias("hi")), "boxes")
        if levels:  # the children of the level above
            parent = F.regexp_replace("node", r"\.[0-9]+$", "")
            sides = F.transform("children", lambda c: F.regexp_extract(c["node"], "[0-9]+$", 0).cast("int"))
            child = lambda i: F.concat_ws(".", "node", F.array_max(F.filter(sides, lambda s: s <= i)).cast("string"))  # noqa: E731  a side may be empty
            levels[-1] = written(boxes.groupBy(parent.alias("node")).agg(
                F.sort_array(F.collect_list(F.struct(F.col("node"), "lo", "hi"))).alias("children")).join(cuts, "node").withColumn(
                "way", F.transform(F.sequence(F.lit(0), F.size("cuts")), child)), "level")
        large = boxes.where(F.col("n") > cell)
        if large.isEmpty():
            cells.append(rows)
            break
        cells.append(rows.join(boxes.where(F.col("n") <= cell).select("node"), "node").select("x", "node"))
        wide = F.zip_with("hi", "lo", lambda a, b: a - b)
        large = large.select("node", F.array_position(wide, F.array_max(wide)).cast("int").alias("axis"), "lo", "hi")
        inside = rows.join(large, "node")
        value, low, high = F.element_at("x", F.col("axis")), F.element_at("lo", F.col("axis")), F.element_at("hi", F.col("axis"))
        cuts = inside.groupBy("node").agg(F.percentile_approx(value, _CUTS, 400).alias("q"), F.first("axis").alias("axis"),
                                          F.first(low).alias("low"), F.first(high).alias("high"))
        just_below = F.col("high") - F.greatest((F.col("high") - F.col("low")) * 1e-15, F.abs("high") * 2e-16)
        cuts = written(cuts.select("node", "axis", F.filter(F.sort_array(F.array_distinct(F.concat("q", F.array("low", just_below)))),
                                                            lambda v: v < F.col("high")).alias("cuts")), "cuts")
        rows = written(rows.join(cuts, "node").select("x", F.concat_ws(".", "node", _side().cast("string")).alias("node")), "tree")
        levels.append(None)
    return levels, reduce(DataFrame.unionByName, cells)


def _box_gaps(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (np.maximum(np.maximum(lo - x, x - hi), 0.0) ** 2).sum(axis=1)


def search(queries: np.ndarray, points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``queries``: its nearest row of ``points`` and how many of these it was compared with.

    The points are halved, along the column in which a node's box is widest, down to leaves of up to ``leaf`` points.
    """
    n, dims = points.shape
    depth = max(0, int(np.ceil(np.log2(n / leaf))))
    size = -(-n // 2 ** depth)
    order = np.arange(size << depth)  # numbers from n on stand for the last point: they fill the leaves
    for level in range(depth):
        blocks = order.reshape(1 << level, -1)
        at = points[np.minimum(blocks, n - 1)]
        axis = (at.max(axis=1) - at.min(axis=1)).argmax(axis=1)
        value = np.take_along_axis(at, axis[:, None, None], axis=2)[:, :, 0]
        order = np.take_along_axis(blocks, np.argpartition(value, blocks.shape[1] // 2 - 1, axis=1), axis=1).reshape(-1)
    members = points[np.minimum(order, n - 1)].reshape(1 << depth, size, dims)
    held = (order < n).reshape(1 << depth, size).sum(axis=1)
    boxes = [(members.min(axis=1), members.max(axis=1))]  # by level, the root's first
    for _ in range(depth):
        lo, hi = boxes[0]
        boxes.insert(0, (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2])))

    def meet(x, who, leaves):  # the nearest place in a leaf and its squared distance, for each query and leaf that meet
        place, gap = np.empty(len(who), np.int64), np.empty(len(who))
        for i in range(0, len(who), _CHUNK):
            at = leaves[i:i + _CHUNK]
            d = ((members[at] - x[who[i:i + _CHUNK], None]) ** 2).sum(axis=2)
            best = d.argmin(axis=1)
            place[i:i + _CHUNK], gap[i:i + _CHUNK] = at * size + best, d[np.arange(len(at)), best]
        return place, gap

    found, compared = np.empty(len(queries), np.int64), np.empty(len(queries), np.int64)
    for i in range(0, len(queries), _CHUNK):
        x = queries[i:i + _CHUNK]
        every, home = np.arange(len(x)), np.zeros(len(x), np.int64)
        for lo, hi in boxes[1:]:
            home = 2 * home + (_box_gaps(x, lo[2 * home + 1], hi[2 * home + 1]) < _box_gaps(x, lo[2 * home], hi[2 * home]))
        place, bound = meet(x, every, home)
        who, node = every, np.zeros(len(x), np.int64)
        for lo, hi in boxes[1:]:
            who, node = np.repeat(who, 2), (2 * node[:, None] + np.arange(2)).reshape(-1)
            inside = _box_gaps(x[who], lo[node], hi[node]) < bound[who]
            who, node = who[inside], node[inside]
        who, node = who[node != home[who]], node[node != home[who]]
        other, gap = meet(x, who, node)
        better = np.lexsort((-gap, who))  # of a query's leaves, the nearest comes last and stays
        better = better[gap[better] < bound[who[better]]]
        place[who[better]] = other[better]
        found[i:i + _CHUNK] = np.minimum(order[place], n - 1)
        compared[i:i + _CHUNK] = held[home] + np.bincount(who, held[node], len(x)).astype(np.int64)
    return found, compared


def _met(queries: DataFrame, cells: DataFrame, dims: int, leaf: int) -> DataFrame:
    """The queries (key, x, node), each with the nearest point ``y`` of its cell, the number ``n`` of points compared, and how far
    the query lies inside the box of the cell's points (``margin``; under 0: outside)."""
    many = written(queries.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).alias("parts")).where("parts > 1"), "parts")
    schema = queries.select("key", "x", "node", F.col("x").alias("y"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("margin")).schema
    keys = ["node"]
    if not many.isEmpty():  # the points of such a cell come once for each part of its queries
        parts = F.coalesce("parts", F.lit(1))
        queries = queries.join(many, "node", "left").select("key", "x", "node", F.pmod(F.xxhash64("key", "x"), parts).alias("part"))
        cells = cells.join(many, "node", "left").select("x", "node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        keys = ["node", "part"]

    def rows(table: pa.Table) -> np.ndarray:
        return table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        x, points = rows(left), rows(right)
        at, n = search(x, points, leaf) if len(x) else (np.zeros(0, np.int64),) * 2
        margin = np.minimum(x - points.min(axis=0), points.max(axis=0) - x).min(axis=1)
        y = pa.ListArray.from_arrays(np.arange(0, x.size + 1, dims, dtype=np.int32), points[at].reshape(-1))
        return pa.table({"key": left["key"], "x": left["x"], "node": left["node"], "y": y, "n": n, "margin": margin})

    return queries.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(one, schema)


def nearest(queries: DataFrame, levels: list[DataFrame], cells: DataFrame, dims: int, leaf: int = 32) -> DataFrame:
    """(key, distance, compared) of queries (key, x), ``x`` of ``dims`` columns: the exact distance to the nearest point of the tree,
    and how many points it was compared with."""
    bound = _distance(F.col("x"), F.col("y"), dims).alias("bound")
    walk = queries.select("key", "x", F.lit(_ROOT).alias("node"))
    for level in levels:  # a cell ends the walk early: it has no cuts
        walk = walk.join(level.drop("children"), "node", "left").select(
            "key", "x", F.coalesce(F.element_at("way", _side() + 1), "node").alias("node"))
    first = written(_met(written(walk, "homes"), cells, dims, leaf).select("key", "x", F.col("node").alias("home"), bound, "n", "margin"), "bounds")
    inside = (F.col("margin") >= 0) & (F.col("bound") <= F.col("margin") * F.col("margin"))
    crossing = first.where(~inside)
    walk = crossing.select("x", "bound", "home", F.lit(_ROOT).alias("node")).distinct()
    for level in levels:
        inner = F.filter("children", lambda c: _box_distance(F.col("x"), c["lo"], c["hi"], dims) < F.col("bound"))
        nodes = F.when(F.col("children").isNull(), F.array("node")).otherwise(F.transform(inner, lambda c: c["node"]))
        walk = walk.join(level.select("node", "children"), "node", "left").select("x", "bound", "home", F.explode(nodes).alias("node"))
    other = written(walk.where(F.col("node") != F.col("home")).select(F.lit(0).alias("key"), "x", "node"), "others")
    more = _met(other, cells, dims, leaf).select("x", bound, "n").groupBy("x").agg(F.min("bound").alias("near"), F.sum("n").alias("more"))
    decided = crossing.join(more, "x", "left").select("key", F.least("bound", "near").alias("bound"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    return first.where(inside).select("key", "bound", "n").unionByName(decided).select("key", F.sqrt("bound").alias("distance"), F.col("n").alias("compared"))
