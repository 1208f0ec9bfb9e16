"""Similarity links among sets that share a prefix gram, without all pairs of a gram that many sets hold.

What a caller needs of the links is which sets they connect, and whether a set has a link to a smaller one.  A
pair can be left unverified where neither can change: both are connected already, and the larger one has a link to
a smaller set.  So the members of a hot gram first meet its smallest member only (a star: as many pairs as
members).  Near copies of one text are settled by that.  Members that are still apart give the next stars, and
what remains after some rounds meets every member, less the pairs that the distances to the first pivot exclude
(the Jaccard distance is a metric).  Nothing is capped: the last step is exact whatever is left.

What a round makes is written and read back.  A checkpoint would keep the plan's estimated size, which a join multiplies:
over some rounds its digits alone fill the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthkit.operators.ordering import written

HOT = 256  # members of a gram from which on they meet as stars
ROUNDS = 6
PER_MEMBER = 32  # remaining pairs for each member that are verified without further stars
_EPS = 1e-9


def may_link(threshold: float, na: Column, nb: Column, ia: Column, ib: Column) -> Column:
    """Length and position filter: sizes ``n`` and places ``i`` (from 1) of a shared gram in two ordered sets.

    At most ``least(ia, ib)`` shared grams come up to this one, and no more than the shorter rest after it.
    """
    need = F.lit(threshold / (1 + threshold)) * (na + nb) - _EPS
    return (F.least(na, nb) >= F.lit(threshold) * F.greatest(na, nb) - _EPS) & (F.least(ia, ib) + F.least(na - ia, nb - ib) >= need)


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, sim) for pairs (a, b) of keys of ``sets`` (c, sh).

    Arrays are planned as if they held one value, so whole sets could pass for a small table: they are never broadcast.
    """
    both = (pairs.join(sets.select(F.col("c").alias("a"), F.col("sh").alias("sa")).hint("merge"), "a")
            .join(sets.select(F.col("c").alias("b"), F.col("sh").alias("sb")).hint("merge"), "b"))
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (inter / (F.size("sa") + F.size("sb") - inter)).alias("sim"))


def spread_labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(c, rep): the smallest key that each key reaches over ``links`` (a, b)."""
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = written(classes.select("c", F.col("c").alias("rep")), "labels")
    while True:  # each round: the smallest label of the neighbours, then the label's own label
        seen = edges.join(label, F.col("b") == F.col("c")).groupBy("a").agg(F.min("rep").alias("m"))
        low = label.join(seen, F.col("c") == F.col("a"), "left").select("c", F.least("rep", "m").alias("rep"))
        up = label.select(F.col("c").alias("rep"), F.col("rep").alias("up"))
        new = written(low.join(up, "rep").select("c", F.least("rep", "up").alias("rep")), "labels")
        changed = new.join(label.withColumnRenamed("rep", "old"), "c").where("rep < old").limit(1).count()
        label = new
        if not changed:
            return label


def _pairs(left: DataFrame, right: DataFrame, threshold: float, more: Column | None = None) -> DataFrame:
    """Distinct candidate pairs (a < b) of members (g, c, n, i) that meet at a gram."""
    x, y = left.alias("x"), right.alias("y")
    ok = may_link(threshold, F.col("x.n"), F.col("y.n"), F.col("x.i"), F.col("y.i")) & (F.col("x.c") != F.col("y.c"))
    ok = ok if more is None else ok & more
    return x.join(y, F.col("x.g") == F.col("y.g")).where(ok).select(
        F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()


def _sets_of(members: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets (c, sh) of ``members``."""
    return written(sets.hint("merge").join(members.select("c").distinct().hint("merge"), "c", "left_semi"), "sets")


def links(members: DataFrame, sets: DataFrame, threshold: float, hot: int = HOT, rounds: int = ROUNDS) -> DataFrame:
    """Verified links (a < b) that connect the same sets, and give the same sets a smaller neighbour, as all links.

    ``members`` (g, c, n, i): set ``c`` of ``n`` grams holds gram ``g`` at place ``i``; a pair within the threshold
    must meet at some gram.  ``sets``: (c, sh) with the distinct grams.
    """
    members = written(members, "members")
    many = written(members.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("g"), "hot")
    near = F.col("sim") >= F.lit(threshold) - _EPS
    few = members.join(many, "g", "left_anti").hint("merge")
    held = _sets_of(members, sets)  # the other sets meet none
    found = written(similarities(_pairs(few, few, threshold, F.col("x.c") < F.col("y.c")), held).where(near).select("a", "b"), "links")
    crowd = written(members.join(many, "g", "left_semi"), "crowd")
    total = crowd.count()
    if not total:
        return found
    held = _sets_of(crowd, held)

    pivots = written(crowd.groupBy("g").agg(F.min_by(F.struct("c", "n", "i"), "c").alias("p")).select("g", "p.*"), "pivots")
    used, first = pivots.select("g", "c"), pivots.select("g", F.col("c").alias("p"))
    for turn in range(rounds + 1):
        sims = written(similarities(_pairs(pivots, crowd, threshold), held), "sims")
        if turn == 0:  # the distance of each member to its gram's first pivot
            to_pivot = sims.select(F.col("a").alias("p"), F.col("b").alias("c"), (1 - F.col("sim")).alias("d"))
            crowd = written(crowd.join(first, "g").join(to_pivot, ["p", "c"], "left").drop("p"), "crowd")
        found = written(found.unionByName(sims.where(near).select("a", "b")), "links")
        label = spread_labels(sets, found)
        state = label.join(found.select(F.col("b").alias("c")).distinct().withColumn("down", F.lit(True)), "c", "left")
        placed = written(crowd.join(state, "c"), "placed")
        most = placed.groupBy("g", "rep").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("low")).groupBy("g").agg(
            F.sum("m").alias("m"), F.max_by("rep", F.struct("m", "rep")).alias("main"), F.min("low").alias("low"))
        # the smallest member of a gram can have no link to a smaller one within it
        apart = (F.col("rep") != F.col("main")) | (F.col("down").isNull() & (F.col("c") != F.col("low")))
        left = written(placed.join(most, "g").where(apart).join(used, ["g", "c"], "left_anti"), "left")
        pairs = left.agg(F.sum("m")).first()[0] or 0
        if not pairs:
            return found
        if pairs <= PER_MEMBER * total or turn == rounds:
            break
        pivots = written(left.groupBy("g").agg(F.min_by(F.struct("c", "n", "i"), "c").alias("p")).select("g", "p.*"), "pivots")
        used = used.unionByName(pivots.select("g", "c"))

    larger = F.when(F.col("x.c") > F.col("y.c"), F.col("x.down")).otherwise(F.col("y.down"))
    changes = (F.col("x.rep") != F.col("y.rep")) | larger.isNull()
    apart_by = F.coalesce(F.abs(F.col("x.d") - F.col("y.d")), F.lit(0.0))
    rest = _pairs(left, placed, threshold, changes & (apart_by <= F.lit(1 - threshold) + _EPS))
    return written(found.unionByName(similarities(rest, held).where(near).select("a", "b")).distinct(), "links")
