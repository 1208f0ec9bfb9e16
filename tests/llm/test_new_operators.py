"""Resampling, vector codes and repeats against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthkit.llm import repeats, resampling, vector_codes
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- resampling

def plain_resample(docs, target, ngram, buckets, percent, min_words, seed="2024"):
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]
    rows = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for x in target for b in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in s}
    out = []
    for d, n, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = Counter()
    for place, r in enumerate(order[:percent * len(order) // 100], 1):
        drawn[(r[0], r[2], r[3], r[4], place)] += 1
    rest = Counter((r[0], r[2], r[3], r[4]) for r in out)
    rest.subtract(Counter(k[:4] for k in drawn.elements()))
    return sorted([*drawn.elements(), *((*k, None) for k in rest.elements())], key=repr)


@pytest.mark.parametrize("ngram,buckets,percent,min_words", [(1, 10_000, 10, 20), (3, 70_000, 35, 2), (2, 7, 100, 0), (1, 50, 1, 5)])
def test_resampling_is_exact(spark, documents, edge, nothing, ngram, buckets, percent, min_words):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [r.text for r in target.collect()]
    for docs in (documents.limit(60), edge, nothing):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        got = resampling.importance_resample(spark.createDataFrame(rows, "doc_id long, text string") if rows else docs, target, ngram=ngram,
                                             buckets=buckets, percent=percent, min_words=min_words, keep=["doc_id"]).drop("n_words")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(rows, items, ngram, buckets, percent, min_words)


def test_resampling_keeps_texts_and_needs_no_target(spark, edge, nothing):
    got = resampling.importance_resample(edge.withColumn("score", F.lit("clash")), nothing, percent=50, min_words=1)
    assert got.columns == [*(c for c in edge.columns if c != "n_words"), "n_words", "n_features", "weight", "score", "rank"] and got.count() == edge.count()
    assert sorted(r.rank for r in got.where("rank is not null").collect()) == [1, 2, 3, 4, 5]


def test_bracket_is_widened_until_it_holds_the_cutoff(spark):
    rows = spark.range(20_000).select((F.col("id") % 900 - F.when(F.col("id") < 12_000, F.lit(0)).otherwise(F.col("id") % 7 * 1000)).alias("score"))
    values = sorted((r.score for r in rows.collect()), reverse=True)
    for take in (1, 2, 199, 5_000, 12_345, 20_000):
        for accuracy in (8, 400):
            lo, hi, above = resampling.bracket(rows, "score", take, 20_000, accuracy=accuracy, margin=1e-6)
            assert lo <= values[take - 1] <= hi and above == sum(v > hi for v in values) < take


# --- vector codes

def plain_codes(vectors, parts, entries, rounds):
    """vectors: (id, label, list of floats)."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    d = len(kept[0][2]) // parts
    books = [[r[2][p * d:(p + 1) * d] for r in kept[:entries]] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, y)), e) for e, y in enumerate(book))
    for turn in range(rounds + 1):
        found = [[nearest(r[2][p * d:(p + 1) * d], books[p]) for p in range(parts)] for r in kept]
        if turn < rounds:
            for p in range(parts):
                members = defaultdict(list)
                for r, f in zip(kept, found):
                    members[f[p][1]].append(r[2][p * d:(p + 1) * d])
                for e, m in members.items():
                    books[p][e] = [sum(c) // len(m) for c in zip(*m)]
    errors = [sum(e for e, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(kept, errors):
        by_label[r[1]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for _, c in f), e, by_label[r[1]]) for r, f, e in zip(kept, found, errors)), key=repr), digest


def vector_rows(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 1, 2, None]), [rng.gauss(0, spread) for _ in range(dims)]) for i in range(n)]
    rows += [(3, 1, rows[3][2]), (3, 1, rows[4][2]), (None, None, rows[5][2]), (n, 0, None), (n + 1, 0, []), (n + 2, 0, [None] * dims),
             (n + 3, 0, [float("nan")] * dims), (n + 4, 0, [float("inf")] * dims), (n + 5, 2, [0.0] * (dims - 1)), *[(n + 6, 1, [0.25] * dims)] * 40]
    return [(i, lab, v and [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]


@pytest.mark.parametrize("dims,parts,entries,spread", [(16, 4, 40, 1.0), (8, 2, 256, 0.01), (12, 3, 7, 30.0), (8, 4, 16, 3e9)])
def test_vector_codes_are_exact(spark, monkeypatch, dims, parts, entries, spread):
    rows = vector_rows(150, dims, dims + entries, spread)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    want, digest = plain_codes(rows, parts, entries, 4)
    for most in (vector_codes.MOST_LABELS, 0):
        monkeypatch.setattr(vector_codes, "MOST_LABELS", most)
        got = vector_codes.encode_vectors(df, parts=parts, entries=entries, keep=["vec_id"]).collect()
        if spread < 1e9:
            assert sorted((tuple(r[:4]) for r in got), key=repr) == want
        else:  # errors beyond 64 bits are null
            assert sorted(((r.vec_id, r.code) for r in got), key=repr) == sorted((w[:2] for w in want), key=repr)
        assert {r.codebooks_sha256 for r in got} == {digest}


def test_equal_average_search_finds_ties_and_far_entries():
    rng = np.random.default_rng(5)
    for n, size, d in ((300, 256, 6), (1, 1, 1), (200, 17, 2), (64, 40, 3)):
        x, book = (rng.integers(-4, 5, (k, d)).astype(float) for k in (n, size))
        index, distance = vector_codes.nearest_entries(x, book)
        every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_vector_codes_of_nothing_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2, [0.5] * 8, "x", "y")], "vec_id long, label int, embedding array<float>, code string, label_ string")
    got = vector_codes.encode_vectors(df)
    assert got.columns == ["vec_id", "label", "embedding", "label_", "code", "error", "label_error", "codebooks_sha256"]
    assert [(r.code, r.error, r.label_) for r in got.collect()] == [("00000000", 0, "y")]
    assert vector_codes.encode_vectors(df.limit(0)).count() == 0 == vector_codes.encode_vectors(df.withColumn("embedding", F.lit(None).cast("array<float>"))).count()


# --- repeats

def plain_removal(rows, least):
    """rows: (id, bytes); a null id is the largest."""
    big = 1 << 63
    smallest = {}
    for i, t in rows:
        for p in range(len(t) - least + 1):
            w, n = t[p:p + least], big if i is None else i
            smallest[w] = min(smallest.get(w, n), n)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if smallest[t[p:p + least]] < (big if i is None else i):
                gone[p:p + least] = b"\1" * least
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out, key=repr)


def repeat_rows(seed):
    """Near copies, passages shared by many, runs of one character, periodic texts, several rows of one id."""
    rng = random.Random(seed)
    def words(n):
        return " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice(["é", "日本", "x", ""]) for _ in range(n))
    base, passage = words(60), words(12)
    rows = []
    for i in range(40):
        t = words(rng.randint(0, 25))
        if rng.random() < 0.4:
            t += passage + words(5)
        if rng.random() < 0.4:
            w = base.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = words(1)
            t = " ".join(w)
        if rng.random() < 0.1:
            t += "a" * rng.randint(10, 300)
        if rng.random() < 0.1:
            t += "ab cd " * rng.randint(2, 40)
        rows.append((rng.choice([i, i, i, 7, None]), t))
    return rows + [(1000, base), (1000, base), (999, base), (5, ""), (6, "\x00" * 30 + "tail"), (2, "\x00" * 25)]


@pytest.mark.parametrize("least,most", [(9, 20_000), (9, 3), (20, 20_000), (2, 5), (50, 20_000), (50, 1)])
def test_removal_is_exact(spark, least, most):
    rows = repeat_rows(least + most)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = repeats.remove_repeats(df, least=least, most=most)
    want = plain_removal([(i, t.encode()) for i, t in rows], least)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got.collect()), key=repr) == want
    assert sum(w[2] for w in want)


def test_removal_on_tables(spark, monkeypatch, documents, edge, nothing):
    monkeypatch.setattr(repeats, "BLOCK", 5000)
    monkeypatch.setattr(repeats, "MERGE", 20_000)
    for docs in (documents, edge):
        want = plain_removal([(r.doc_id, (r.text or "").encode()) for r in docs.collect()], 50)
        got = repeats.remove_repeats(docs)
        assert got.columns[:len(docs.columns) - ("spans" in docs.columns)] == [c for c in docs.columns if c != "spans"]
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in got.collect()), key=repr) == want
    assert repeats.remove_repeats(nothing).count() == 0 == repeats.maximal_repeats(nothing).count()


def test_interval_tree_gives_all_maximal_repeats_of_one_array():
    text = b"abcdxabcdyabcdzbcdq" * 2
    leaf, offset, before, common = repeats.suffix_array(np.zeros(1, np.int64), [text], 3)
    found = {(text[offset[a]:offset[a] + n], tuple(sorted(offset[a:b + 1].tolist())))
             for n, a, b, _, _ in repeats.interval_tree(common.tolist(), leaf.tolist(), 3)
             if before[a:b + 1].min() < 0 or len(set(before[a:b + 1].tolist())) > 1}
    want = set()
    for i in range(len(text)):
        for j in range(i + 3, len(text) + 1):
            at = [p for p in range(len(text)) if text.startswith(text[i:j], p)]
            left, right = {text[p - 1:p] or None for p in at}, {text[p + j - i:p + j - i + 1] or None for p in at}
            if len(at) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
                want.add((text[i:j], tuple(at)))
    assert found == want


@pytest.mark.parametrize("most", [20_000, 4])
def test_groups_hold_all_occurrences(spark, most):
    rows = [(i, t) for n, (i, t) in enumerate(repeat_rows(3)) if i is not None]
    least = 12
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {(r.doc_id, r.doc): r.text.encode() for r in repeats._source(df, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
             .withColumnRenamed("id", "doc_id").collect()}
    cut = {k for k, t in texts.items() if (repeats.stretches([t], least, 4)[2] == repeats.LONGEST).any()}  # texts that repeat themselves
    assert 0 < len(cut) < 10
    groups = defaultdict(set)
    for r in repeats.maximal_repeats(df, least=least, most=most).collect():
        groups[r.repeat_id, r.length, r.smallest_id].add((r.id, r.doc, r.start))
    covered = {k: bytearray(len(t)) for k, t in texts.items()}
    for (_, length, smallest), places in groups.items():
        strings = {texts[i, d][s:s + length] for i, d, s in places}
        assert len(places) > 1 and len(strings) == 1 and length >= least and min(i for i, _, _ in places) == smallest
        string, spread = strings.pop(), places
        assert places <= {(i, d, p) for (i, d), t in texts.items() for p in range(len(t)) if t.startswith(string, p)}
        places = {x for x in places if x[:2] not in cut}
        assert places == {(i, d, p) for (i, d), t in texts.items() if (i, d) not in cut for p in range(len(t)) if t.startswith(string, p)}
        for i, d, s in spread:
            covered[i, d][s:s + length] = b"\1" * length
    count = Counter(t[p:p + least] for t in texts.values() for p in range(len(t) - least + 1))
    for k, t in texts.items():  # every byte of a repeated window is in a group
        want = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if count[t[p:p + least]] > 1:
                want[p:p + least] = b"\1" * least
        assert covered[k] == want
