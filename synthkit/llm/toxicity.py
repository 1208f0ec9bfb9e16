"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is the mean of hashed embeddings of the word, its beginnings (3 to 6 letters) and its
last four letters, so unseen forms share what their stems have.  Filters of several widths run over the
words of the whole text; each filter's maximum over all places goes to a logistic unit.  Only labels and
texts are learned from; buckets that few training texts hold stay zero.

All labelled documents are learned from, whole.  A fifth of them, by a hash of the id, is held back to calibrate; the
others are dealt by another hash into shards of some ``SHARD`` rows.  Each round every shard trains one copy of the
network in a task, from the same start, and the copies are averaged (a bucket's row over the shards whose texts hold
it); a single shard trains in one round.  Sums of the copies are made by Spark: the driver sees one network a round,
whatever the number of shards.  The calibration is a logistic fit of the score at the labels' real shares, and per
language the threshold of the best F1 (the common one where a language has fewer than 20 toxic rows; 0.3 where all
have), from the counts of all held-back rows by output, rounded to a hundredth.
Scoring reads every whole text.  As filters are linear, each word's contributions to all filters are
computed once per worker and only added up afterwards.

Defined results: null and empty texts get the score of a text without words; rows with a null language
use the common threshold; repeated rows are scored each; null labels and labels without a document are not
learned from, repeated labels count once (toxic if any is); without labels of both classes the score is the
labels' overall share (0.0 without any) and nothing is rejected.
"""

from __future__ import annotations

import copy
import re
import zlib
from array import array
from collections import defaultdict
from dataclasses import dataclass, field, replace
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.llm.common import free_name, materialize, release, scan, worker_table

BUCKETS, DIM = 1 << 15, 16
WIDTHS, FILTERS = (1, 2, 3), 10
_WORD = re.compile(r"\w+")
_FEATURES = 6
SHARD = 4000  # training texts of a shard, about
SEEN = 3  # training texts in which a hash bucket must occur
PASSES, LEAST_PASSES = 12_000, 2  # texts seen in training, repeats included; passes over all of them at least
BATCH, RATE = 16, 0.7
PARTS = 32  # a network travels in so many pieces
ENOUGH, USUAL = 20, 0.3  # toxic rows needed to calibrate a threshold; the threshold without them


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[int]:
    """Hash buckets of a word, its beginnings and endings."""
    w, n = "^" + word + "$", len(word)
    b = w.encode()
    if len(b) == n + 2:  # ASCII: cut as bytes
        parts = [b, *[b[:k + 1] for k in range(3, min(7, n))]]
        if n > 4:
            parts.append(b[-5:])
    else:
        parts = [b, *[w[:k + 1].encode() for k in range(3, min(7, n))], *([w[-5:].encode()] if n > 4 else [])]
    return [zlib.crc32(p) & (BUCKETS - 1) for p in parts]


def feature_table(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(words, _FEATURES) bucket numbers, filled with the empty bucket, and 1 / count."""
    empty = [[BUCKETS] * (_FEATURES - n) for n in range(_FEATURES + 1)]
    flat, counts = array("i"), array("b")
    for w in vocabulary:
        f = features(w)
        flat.extend(f + empty[len(f)])
        counts.append(len(f))
    ids = np.frombuffer(flat, np.int32) if vocabulary else np.zeros(0, np.int32)
    n = np.frombuffer(counts, np.int8) if vocabulary else np.zeros(0, np.int8)
    return ids.reshape(-1, _FEATURES).copy(), (1 / n.astype(np.float64)).astype(np.float32)[:, None]


def embedded(embedding: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Sum of the embeddings of each row of bucket numbers, a feature at a time."""
    total = embedding.take(ids[:, 0], axis=0)
    for j in range(1, _FEATURES):
        total += embedding.take(ids[:, j], axis=0)
    return total


@dataclass
class Network:
    embedding: np.ndarray  # (BUCKETS + 1, DIM); the last row stays zero
    filters: list[np.ndarray]  # per width (width * DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)  # logistic calibration of the output
    thresholds: dict[str, float] = field(default_factory=dict)  # by language
    threshold: float = 0.5
    constant: float | None = None  # the score where nothing could be learned

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.3, (BUCKETS + 1, DIM)).astype(np.float32)
        emb[BUCKETS] = 0
        return cls(emb, [rng.normal(0, 0.5 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
                   [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0)

    def projections(self, vocabulary: list[str]) -> np.ndarray:
        """(words, sum(WIDTHS) * FILTERS): what a word adds to each filter at each of its offsets."""
        ids, share = feature_table(vocabulary)
        e = embedded(self.embedding, ids) * share
        return np.concatenate([e @ f[j * DIM:(j + 1) * DIM] for w, f in zip(WIDTHS, self.filters) for j in range(w)], axis=1)

    def output(self, rows: np.ndarray) -> float:
        """The raw output (log odds) from the projections of a text's words in order."""
        n = len(rows)
        m = max(n, 1)
        full = np.zeros((rows.shape[1], m + max(WIDTHS) - 1), np.float32)  # texts end in empty words
        full[:, :n] = rows.T  # a row for each filter and offset: sums and maxima run along the text
        pooled, at = [], 0
        for w, b in zip(WIDTHS, self.bias):
            total = full[at:at + FILTERS, :m]
            for j in range(1, w):
                total = total + full[at + j * FILTERS:at + (j + 1) * FILTERS, j:j + m]
            pooled.append(np.maximum(total.max(axis=1) + b, 0))
            at += w * FILTERS
        return float(np.concatenate(pooled) @ self.out) + self.out_bias

    def score(self, rows: np.ndarray) -> float:
        return self.calibrated(self.output(rows))

    def calibrated(self, z):
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -40, 40)))


@dataclass
class State:
    """A network in training, with Adagrad's sums of squared gradients."""
    net: Network
    squares: list[np.ndarray]
    bias_square: float = 1e-3

    @classmethod
    def new(cls, rare: np.ndarray, seed: int = 7) -> State:
        net = Network.new(seed)
        net.embedding[rare] = 0  # buckets of fewer than SEEN texts stay zero: they could only memorise single texts
        return cls(net, [np.full_like(p, 1e-3) for p in (net.embedding, *net.filters, *net.bias, net.out)])

    def params(self) -> list[np.ndarray]:
        return [self.net.embedding, *self.net.filters, *self.net.bias, self.net.out]

    def table(self) -> np.ndarray:
        """(BUCKETS + 1, 2 * DIM): the embeddings and their squares."""
        return np.concatenate([self.net.embedding, self.squares[0]], axis=1).astype(np.float64)

    def dense(self) -> np.ndarray:
        """All other numbers in one row."""
        rest = [x.ravel() for x in (*self.params()[1:], *self.squares[1:])]
        return np.concatenate([*rest, [self.net.out_bias, self.bias_square]]).astype(np.float64)

    def put(self, table: np.ndarray, dense: np.ndarray) -> None:
        self.net.embedding[:], self.squares[0][:] = table[:, :DIM], table[:, DIM:]
        at = 0
        for x in (*self.params()[1:], *self.squares[1:]):
            x[:] = dense[at:at + x.size].reshape(x.shape)
            at += x.size
        self.net.out_bias, self.bias_square = float(dense[at]), float(dense[at + 1])


def numbered() -> defaultdict:
    """A dictionary that gives each new key the next number."""
    index: defaultdict[str, int] = defaultdict()
    index.default_factory = index.__len__
    return index


def indexed(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers of each text, feature table of the words, 1 / count of features, texts that hold each bucket)."""
    index = numbered()
    end = np.zeros(max(WIDTHS), np.int32 if sum(map(len, texts)) < 2**31 else np.int64)
    number, docs = index.__getitem__, []
    number("")
    for t in texts:
        found = words(t)
        seq = np.fromiter(map(number, found), end.dtype, len(found))
        docs.append(np.concatenate([seq, end[:max(WIDTHS) - 1 + (not t)]]))
    ids, share = feature_table(list(index))
    ids[0], share[0] = BUCKETS, 0
    seen = np.zeros(BUCKETS + 1, np.int64)
    for seq in docs:
        held = np.zeros(BUCKETS + 1, bool)
        held[ids[seq]] = True
        seen += held
    return docs, ids, share, seen


def fit(state: State, texts: list[str], labels: list[int], rare: np.ndarray, class_weight: tuple[float, float], epochs: int, seed: int) -> np.ndarray:
    """Train ``state`` in place by Adagrad on the logistic loss; gradients flow through each filter's best place only.

    Returns how many of the texts hold each bucket.
    """
    net, squares, rng = state.net, state.squares, np.random.default_rng(seed)
    docs, ids, share, seen = indexed(texts)
    ids[rare[ids]] = BUCKETS
    params, bias_square = state.params(), state.bias_square
    k, y = len(WIDTHS), np.array(labels, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for start in range(0, len(order), BATCH):
            chosen = order[start:start + BATCH]
            grads = [np.zeros_like(p) for p in params[1:]]
            g_bias, rows_at, rows_grad = 0.0, [], []
            for d in chosen:
                seq = docs[d]
                m = len(seq) - max(WIDTHS) + 1
                e = embedded(net.embedding, ids.take(seq, axis=0)) * share[seq]
                best, best_at = [], []
                for w, f, b in zip(WIDTHS, net.filters, net.bias):
                    total = e[:m] @ f[:DIM]
                    for j in range(1, w):
                        total += e[j:j + m] @ f[j * DIM:(j + 1) * DIM]
                    at = total.argmax(axis=0)
                    best_at.append(at)
                    best.append(np.maximum(total[at, np.arange(FILTERS)] + b, 0))
                pooled = np.concatenate(best)
                g = float(1 / (1 + np.exp(-np.clip(pooled @ net.out + net.out_bias, -40, 40))) - y[d]) * class_weight[int(y[d])]
                grads[-1] += g * pooled
                g_bias += g
                back = (g * net.out * (pooled > 0)).reshape(k, FILTERS)
                for i, (w, f, at) in enumerate(zip(WIDTHS, net.filters, best_at)):
                    grads[k + i] += back[i]
                    for j in range(w):
                        grads[i][j * DIM:(j + 1) * DIM] += e[at + j].T * back[i]
                        word = seq[at + j]
                        rows_at.append(ids[word].ravel())
                        rows_grad.append(np.repeat((f[j * DIM:(j + 1) * DIM] * back[i]).T * share[word], _FEATURES, axis=0))
            step = RATE / np.sqrt(len(chosen))
            for p, s, gr in zip(params[1:], squares[1:], grads):
                s += gr * gr
                p -= step * gr / np.sqrt(s)
            at, inverse = np.unique(np.concatenate(rows_at), return_inverse=True)
            total = np.zeros((len(at), DIM), np.float32)
            np.add.at(total, inverse, np.concatenate(rows_grad))
            squares[0][at] += total * total
            net.embedding[at] -= step * total / np.sqrt(squares[0][at])
            net.embedding[BUCKETS] = 0
            bias_square += g_bias * g_bias
            net.out_bias -= step * g_bias / np.sqrt(bias_square)
    state.bias_square = bias_square
    return seen


class Scorer:
    """Scores texts with a table of word projections that is kept and bounded."""

    def __init__(self, net: Network, most: int = 250_000):
        self.net, self.most = net, most
        self.index = numbered()
        self.rows = np.zeros((most, sum(WIDTHS) * FILTERS), np.float32)

    def __call__(self, text: str | None) -> float:
        return self.net.constant if self.net.constant is not None else float(self.net.calibrated(self.output(text)))

    def output(self, text: str | None) -> float:
        found = words(text)
        if not found:
            return self.net.output(self.rows[:0])
        index, known = self.index, len(self.index)
        at = list(map(index.__getitem__, found))
        if len(index) > self.most:
            index.clear()
            known, at = 0, list(map(index.__getitem__, found))
            if len(index) > self.most:  # a text with more distinct words than the table holds
                index.clear()
                return self.net.output(self.net.projections(found))
        if len(index) > known:
            new = list(islice(reversed(index), len(index) - known))[::-1]
            self.rows[known:len(index)] = self.net.projections(new)
        return self.net.output(self.rows.take(at, axis=0))


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of the labels on the raw output (Newton steps, slightly ridged)."""
    x = np.stack([z, np.ones_like(z)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * (beta - [1.0, 0.0])), -2, 2)
    return max(float(beta[0]), 1e-3), float(beta[1])


def _best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray, start: float = USUAL) -> float:
    """Middle of the gap that gives the best weighted F1; of equally good ones the nearest to ``start``."""
    order = np.unique(score)
    cuts = np.concatenate([[start], (order[1:] + order[:-1]) / 2]) if len(order) > 1 else np.array([start])
    by = np.argsort(score, kind="stable")
    first = np.searchsorted(score[by], cuts)  # rows from here on are hits

    def above(v):
        return np.concatenate([np.cumsum(v[by][::-1])[::-1], [0.0]])[first]
    f1 = np.round(2 * above(weight * y) / np.maximum(1e-9, (weight * y).sum() + above(weight)), 6)
    return float(max(zip(f1, -np.abs(cuts - start), cuts))[2])


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
                  label_col: str = "toxic") -> tuple[DataFrame, dict[int, int]]:
    """(one row of id, y, text, lang, held for each labelled document; number of labels by class)."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(
        "id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.struct(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), lang.alias("lang")).alias("d"))
    rows = texts.join(known, "id").groupBy("id", "y").agg(F.min("d").alias("d"))  # of repeated ids the least text
    return materialize(rows.select("id", "y", "d.*", (F.pmod(F.xxhash64("id", F.lit("held")), F.lit(5)) == 0).alias("held")), "labelled"), shares


def _sums(pieces: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the arrays (``body``: doubles) of each ``part``, over the shards in order."""
    def add(batches):
        release()
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[part] = total.get(part, 0.0) + np.frombuffer(body)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["part", "body"])

    dealt = pieces.repartition(PARTS, "part").sortWithinPartitions("part", "shard").select("part", "body")
    return {r["part"]: np.frombuffer(r["body"]) for r in dealt.mapInArrow(add, "part int, body binary").collect()}  # one network


def _by_shard(rows: DataFrame, shards: int, run) -> DataFrame:
    """(part, shard, body) of the arrays that ``run(shard, texts, labels)`` gives for each shard's rows, by order of a hash."""
    def of(key, pdf):
        release()  # training needs the room of what an earlier step left in the worker
        pdf = pdf.assign(order=[zlib.crc32(str(i).encode(), 1) for i in pdf["id"]]).sort_values(["order", "id"])
        arrays = run(int(key[0]), list(pdf["text"]), [int(v) for v in pdf["y"]])
        return pd.DataFrame({"part": list(arrays), "shard": int(key[0]), "body": [v.astype(np.float64).tobytes() for v in arrays.values()]})
    dealt = rows.select("id", "y", "text", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInPandas(of, "part int, shard int, body binary")


def _fit_all(rows: DataFrame, n: dict[int, int], epochs: int | None) -> Network:
    """The network of all training rows: rounds of training by shard and averaging."""
    size = sum(n.values())
    shards = max(1, round(size / SHARD))
    epochs = epochs or min(40, max(LEAST_PASSES, PASSES // size))
    weight = size / (2 * max(1, n.get(0, 0))), size / (2 * max(1, n.get(1, 0)))  # both classes weigh the same
    seen = _sums(_by_shard(rows, shards, lambda s, texts, labels: {0: indexed(texts)[3]}))[0]
    rare = seen < SEEN
    state, context = State.new(rare), rows.sparkSession.sparkContext
    cut = [len(x) for x in np.array_split(np.arange(BUCKETS + 1), PARTS)]
    for turn in range(1 if shards == 1 else epochs):
        start = context.broadcast((state, rare))

        def run(shard, texts, labels):
            own, rare = start.value
            own = copy.deepcopy(own)
            held = fit(own, texts, labels, rare, weight, epochs if shards == 1 else 1, seed=7 + shard + 100_003 * turn)
            times = np.concatenate([held[:, None] * own.table(), held[:, None]], axis=1)
            pieces = dict(enumerate(x.ravel() for x in np.array_split(times, PARTS)))
            return {**pieces, PARTS: np.append(own.dense() * len(texts), len(texts))}
        total = _sums(_by_shard(rows, shards, run))
        table = np.concatenate([total[i].reshape(cut[i], -1) for i in range(PARTS)])
        held = table[:, -1:] > 0
        state.put(np.where(held, table[:, :-1] / np.maximum(table[:, -1:], 1), state.table()), total[PARTS][:-1] / total[PARTS][-1])
        state.net.embedding[BUCKETS] = 0
        start.unpersist()
    return state.net


def _outputs(rows: DataFrame, net: Network) -> list[tuple]:
    """(z, y, lang, n): rows by raw output, rounded to a hundredth within -60 to 60."""
    shared = rows.sparkSession.sparkContext.broadcast(net)
    number = "outputs", shared._jbroadcast.id()

    def run(texts):
        scorer = worker_table(number, lambda: Scorer(shared.value))
        return [pa.array([round(100 * min(60.0, max(-60.0, scorer.output(t.as_py())))) for t in texts], pa.int32())]
    found = scan(rows.select("text", "y", "lang"), [T.StructField("z", T.IntegerType())], "text", run, keep=["y", "lang"], table=number)
    return [tuple(r) for r in found.groupBy("z", "y", "lang").agg(F.count("*").alias("n")).orderBy("z", "y", "lang").collect()]


def train(docs: DataFrame, labels: DataFrame, epochs: int | None = None, **options) -> Network:
    """Fit and calibrate a network on all labelled documents."""
    rows, shares = labelled_rows(docs, labels, **options)
    total = sum(shares.values())
    counts = {(r["held"], r["y"]): r["n"] for r in rows.groupBy("held", "y").agg(F.count("*").alias("n")).collect()}
    if len({y for _, y in counts}) < 2:
        return replace(Network.new(), constant=shares.get(1, 0) / total if total else 0.0, threshold=2.0)
    apart = len(counts) == 4  # too few rows to hold some of each class back: all serve for both
    fitted, kept = (rows.where("NOT held"), rows.where("held")) if apart else (rows, rows)
    n = {y: sum(c for (h, v), c in counts.items() if v == y and not (apart and h)) for y in (0, 1)}
    net = _fit_all(fitted, n, epochs)
    found = _outputs(kept, net)
    z, y, times = np.array([r[0] for r in found]) / 100, np.array([r[1] for r in found], float), np.array([r[3] for r in found], float)
    toxic = times * y
    weight = times * np.where(y == 1, shares[1] / toxic.sum(), shares[0] / (times - toxic).sum()) * times.sum() / total
    net.scale = _calibrate(z, y, weight)
    score = net.calibrated(z)
    net.threshold = _best_threshold(score, y, weight) if toxic.sum() >= ENOUGH else USUAL
    for lang in sorted({r[2] for r in found if r[2] is not None}):
        own = np.array([r[2] == lang for r in found])
        if toxic[own].sum() >= ENOUGH:
            net.thresholds[lang] = _best_threshold(score[own], y[own], weight[own])
    return net


def score_texts(docs: DataFrame, net: Network, text_col: str = "text", lang_col: str | None = "lang",
                keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) plus ``toxicity`` (0 to 1) and ``toxic`` (by the language's threshold)."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    shared = spark.sparkContext.broadcast(net)
    number = "toxicity", shared._jbroadcast.id()
    both, score, flag = (free_name(docs, n) for n in ("_both", "toxicity", "toxic"))
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")

    def run(column):
        scorer = worker_table(number, lambda: Scorer(shared.value))
        scores = [scorer(t.as_py()) for t in column.field(0)]
        least = [scorer.net.thresholds.get(x, scorer.net.threshold) for x in column.field(1).to_pylist()]
        return [pa.array(scores, pa.float64()), pa.array([s >= t for s, t in zip(scores, least)], pa.bool_())]

    src = docs.withColumn(both, F.struct(F.col(f"`{text_col}`").alias("t"), lang.alias("l")))
    return scan(src, [T.StructField(score, T.DoubleType()), T.StructField(flag, T.BooleanType())], both, run, keep=keep, table=number)


def reject_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without those that the classifier calls toxic, same columns."""
    net = train(docs, labels, **options)
    scored = score_texts(docs, net)
    return scored.where(~F.col(scored.columns[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])
