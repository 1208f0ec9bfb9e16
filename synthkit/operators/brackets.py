"""Exact quantiles from two scans: a sketch brackets every wanted rank, the second scan counts and selects inside.

The first scan builds one KLL sketch a column (about 100 KB, mergeable).  Its quantiles a margin below and above a
wanted rank enclose that rank with near certainty.  The second scan counts the values between the brackets as one
number each and keeps value counts only inside them, so a small share of the values is shuffled and ordered.  The
counts are exact, so they prove whether a rank lies in its bracket; a column where one does not is scanned again with
a margin eight times as wide, at last with all its values.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthkit.operators.ordering import with_running_sums

SKETCH_K = 4096
PLAIN = 16  # brackets of a column up to which a value is compared with each of them
MARGIN = 0.002  # of the rank; the sketch's error is about half of it (99 of 100 cases)


def _usable(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def ranks_of(n: int, probs: list[float]) -> list[tuple[float, float, int, int]]:
    """(prob, place, lower rank, upper rank) with ranks from 0."""
    out = []
    for p in probs:
        h = float(p) * (n - 1)
        out.append((float(p), h, int(h // 1), int(-(-h // 1))))
    return out


def joined(ends: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint brackets in ascending order."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(ends):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def bracket_counts(df: DataFrame, values: dict[str, Column], brackets: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """``(column, at struct<region, x>, cnt)``: value counts inside brackets (odd regions), one row for each gap (x null)."""
    def entry(name):
        x = _usable(values[name])
        lows, highs = ([F.lit(b[side]) for b in brackets[name]] for side in (0, 1))
        if len(lows) <= PLAIN:  # comparisons are compiled, functions of arrays are not
            region = reduce(add, [(e <= x).cast("int") for e in lows] + [(e < x).cast("int") for e in highs])
        else:
            region = F.size(F.filter(F.array(*lows), lambda e: e <= x)) + F.size(F.filter(F.array(*highs), lambda e: e < x))
        return F.struct(F.lit(name).alias("column"), x.alias("x"), region.alias("region"))

    rows = df.select(F.explode(F.array(*[entry(c) for c in brackets])).alias("e")).select("e.*").where("x IS NOT NULL")
    inside = rows.select("column", "region", F.when(F.col("region") % 2 == 1, F.col("x")).alias("x"))
    counts = inside.groupBy("column", "region", "x").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select("column", F.struct("region", "x").alias("at"), "cnt")


def exact_quantiles(df: DataFrame, values: dict[str, Column], probs: list[float], k: int = SKETCH_K, margin: float = MARGIN) -> list[tuple]:
    """(column, prob, value) by linear interpolation between the two values around rank ``prob * (n - 1)``."""
    spark = df.sparkSession
    names = list(values)
    aggs = [c for i, name in enumerate(names) for c in (
        F.count(_usable(values[name])).alias(f"n{i}"), F.kll_sketch_agg_double(_usable(values[name]), F.lit(k)).alias(f"s{i}"))]
    row = df.agg(*aggs).first()
    wanted = [(name, ranks_of(row[f"n{i}"], probs), row[f"s{i}"]) for i, name in enumerate(names) if row[f"n{i}"]]
    found = []
    while wanted:
        brackets = _brackets(spark, wanted, margin)
        counts = bracket_counts(df, values, brackets)
        cum = with_running_sums(counts, "at", {"hi": F.col("cnt")}, ["column"])
        cum = cum.select("column", "at.x", (F.col("hi") - F.col("cnt")).alias("lo"), "hi")  # ranks [lo, hi) hold x
        targets = spark.createDataFrame([(name, i, side, r[2 + side]) for name, ranks, _ in wanted for i, r in enumerate(ranks) for side in (0, 1)],
                                        "_c string, i int, side int, r long")  # columns x probs rows
        hit = cum.join(F.broadcast(targets), (F.col("_c") == F.col("column")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
        at = {(r.column, r.i, r.side): r.x for r in hit.select("column", "i", "side", "x").collect()}
        again = []
        for name, ranks, sketch in wanted:
            both = [(at.get((name, i, 0)), at.get((name, i, 1))) for i in range(len(ranks))]
            if any(x is None for pair in both for x in pair):
                again.append((name, ranks, sketch))
                continue
            found += [(name, p, x0 + (h - r0) * (x1 - x0) if r1 > r0 else x0) for (p, h, r0, r1), (x0, x1) in zip(ranks, both)]
        if margin > 1 and again:
            raise ValueError(f"values of {[a[0] for a in again]} changed between two scans")
        wanted, margin = again, margin * 8
    return found


def _brackets(spark, wanted: list[tuple], margin: float) -> dict[str, list[tuple[float, float]]]:
    """The values a margin around every wanted rank, as the sketches give them (no scan)."""
    if margin >= 1:
        return {name: [(float("-inf"), float("inf"))] for name, _, _ in wanted}
    ends = spark.createDataFrame([(name, sketch) for name, _, sketch in wanted], "name string, s binary")
    for side, move in (("low", -margin), ("high", margin)):
        at = F.array(*[F.lit(min(max(r[0] + move, 0.0), 1.0)) for r in wanted[0][1]])  # the same probs for every column
        ends = ends.withColumn(side, F.kll_sketch_get_quantile_double("s", at))
    return {r.name: joined(list(zip(r.low, r.high))) for r in ends.select("name", "low", "high").collect()}
