"""Links of hot grams by stars: the same classes as all pairs, and pairs that grow with the members."""

import random

import pytest
from pyspark.sql import functions as F

from synthkit.operators import stars, validate


def sets_of(text, k=5):
    words = text.lower().split()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(texts, threshold=0.8):
    """id -> (smallest id reached over links, has a link to a smaller id)."""
    sets = {i: sets_of(t) for i, t in texts.items()}
    ids = sorted(sets)
    near = {i: [j for j in ids if j != i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in ids}
    rep = {}
    for i in ids:
        todo = [] if i in rep else [i]
        while todo:
            x = todo.pop()
            if x not in rep:
                rep[x] = i
                todo += near[x]
    return {i: (rep[i], any(j < i for j in near[i])) for i in ids}


@pytest.fixture
def counted(monkeypatch):
    """The number of verified pairs of each step."""
    seen, plain = [], stars.similarities
    def count(pairs, sets):
        seen.append(pairs.count())
        return plain(pairs, sets)
    monkeypatch.setattr(stars, "similarities", count)
    return seen


def run(spark, texts, kind="long"):
    df = spark.createDataFrame(list(texts.items()), "id long, t string").select(F.col("id").cast(kind), "t")
    return {r.id: (r.rep, r.near_dup) for r in validate.near_duplicates(df, "id", "t").collect()}


def test_near_copies_of_one_text_meet_as_a_star(spark, counted, monkeypatch):
    monkeypatch.setattr(stars.links, "__defaults__", (64, stars.ROUNDS))
    base = [f"w{i}" for i in range(100)]
    n = 2000
    texts = {i: " ".join(f"x{i}" if j == i % 100 else w for j, w in enumerate(base)) for i in range(n)}
    got = run(spark, texts)
    assert {r for r, _ in got.values()} == {0} and [i for i, (_, d) in got.items() if not d] == [0]
    assert sum(counted) < 20 * n  # all pairs: 1,000 x n


@pytest.mark.parametrize("rounds", [0, 2])
def test_stars_find_the_classes_of_all_pairs(spark, monkeypatch, rounds):
    monkeypatch.setattr(stars.links, "__defaults__", (3, rounds))
    monkeypatch.setattr(stars, "PER_MEMBER", 1)
    rng = random.Random(rounds)
    texts = {}
    for family in range(6):  # drifting copies: links, chains and pairs on both sides of the threshold
        base = [f"f{family % 4}w{i}" for i in range(60)]
        for _ in range(25):
            text = list(base)
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(60)] = f"n{rng.randrange(200)}"
            if rng.random() < 0.4:
                base = text
            texts[rng.randrange(10 ** 6)] = " ".join(text)
    assert run(spark, texts) == brute(texts)


def test_position_filter_keeps_every_pair_within_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        whole = list(range(30))
        a = sorted(rng.sample(whole, rng.randrange(15, 30)))
        b = sorted(set(a) - set(rng.sample(a, rng.randrange(0, 4))) | set(rng.sample(whole, rng.randrange(0, 4))))
        if len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)):
            rows += [(len(a), len(b), a.index(x) + 1, b.index(x) + 1) for x in set(a) & set(b)]
    df = spark.createDataFrame(rows, "na int, nb int, ia int, ib int")
    assert len(rows) > 500 and df.where(~stars.may_link(0.8, *map(F.col, df.columns))).count() == 0


def test_text_keys(spark, monkeypatch):
    monkeypatch.setattr(stars.links, "__defaults__", (3, 2))
    texts = {10 + i: " ".join(f"x{i}" if j == i else f"w{j}" for j in range(60)) for i in range(12)}
    assert {r for r, _ in run(spark, texts, "string").values()} == {"10"}


def test_whole_sets_and_grams_are_not_broadcast(spark):
    docs = spark.range(40).select(F.col("id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: i + F.col("id") * 100)).alias("t"))
    found = validate.near_duplicates(docs, "id", "t")
    sets = spark.createDataFrame([(i, [i, i + 1]) for i in range(9)], "c long, sh array<long>")
    pairs = spark.createDataFrame([(1, 2), (3, 8)], "a long, b long")
    assert {(r.a, r.b, round(r.sim, 6)) for r in stars.similarities(pairs, sets).collect()} == {(1, 2, 0.333333), (3, 8, 0.0)}
    for df in (found, stars.similarities(pairs, sets)):  # the plan before adaptive execution: made from estimates
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "sh#" in plan and not [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "LeftOuter" not in x]


def test_estimated_sizes_do_not_multiply_over_the_rounds(spark, monkeypatch):
    """A join multiplies the estimates of its sides: kept over the rounds, their digits alone filled the driver."""
    monkeypatch.setattr(stars.links, "__defaults__", (3, 3))
    monkeypatch.setattr(stars, "PER_MEMBER", 0)
    bits = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    sets = spark.range(40).select(F.col("id").alias("c"), F.sequence(3 * F.col("id"), 3 * F.col("id") + 39).alias("sh"))  # a chain
    members = sets.select(F.explode("sh").alias("g"), "c", F.lit(40).alias("n"), F.lit(1).alias("i"))
    links = stars.links(members, sets, 0.8)
    label = stars.spread_labels(sets, links)
    assert label.groupBy("rep").count().count() == 1 and links.count() >= 39
    assert bits(label) < 40 and bits(links) < 40
