"""Importance resampling towards a target: array-scored weights, then a cutoff found by quantile-sketch bracketing.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z; features are all runs of 1 to
``ngram`` words joined by a space, each in bucket crc32 modulo ``buckets``.  A document is an array of bucket
numbers, written once: the corpus counts are sums over these arrays (one array of counts a task before the
shuffle), and weights are look-ups of the same arrays in the array of gains, a fixed-size table.

    gain = floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B))))   weight = floor(mean gain), 0 without features
    score = weight + floor(-1000 ln(-ln((h + 0.5) / 2^32))),   h: 8 hex digits of sha256("<seed>:<id>")

Of the N rows with ``min_words`` words, the floor(percent * N / 100) highest scores are drawn (Gumbel top-k:
sampling without replacement by exp(weight / 1000)), ties to smaller ids.  The cutoff: a mergeable quantile
sketch gives a bracket of scores around it; exact counts above and from the bracket on prove that the cutoff
lies inside, or else the bracket is widened; just the rows inside the bracket are sorted to find the cutoff.
Rows above it are drawn as they are, and sorted for their rank.

Defined results: a null text has no words; a null id is hashed as the empty text and comes last in ties;
repeated rows are all kept, and of equal rows at the cutoff just as many are drawn as fit; an empty target or
corpus has no counts; an empty table gives an empty result.  A kept column named like a result is left out.
"""

from __future__ import annotations

import math
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.llm.common import free_name, materialize, scan
from synthkit.operators.ordering import with_position

RESULTS = ["n_words", "n_features", "weight", "score", "rank"]
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def feature_buckets(text: bytes | None, ngram: int = 1, buckets: int = 10_000) -> tuple[int, np.ndarray]:
    """(number of words, bucket of every feature)."""
    words = text.translate(_WORD_BYTES).split() if text else []
    longer = (b" ".join(words[i:i + n]) for n in range(2, ngram + 1) for i in range(len(words) - n + 1))
    return len(words), np.fromiter(map(crc32, chain(words, longer)), np.int64) % buckets


def with_buckets(docs: DataFrame, text_col: str, keep: list[str], ngram: int, buckets: int, names: tuple[str, str]) -> DataFrame:
    """``keep`` plus the number of words and the array of bucket numbers (little-endian, 2 or 4 bytes each)."""
    kind = _kind(buckets)
    data = free_name(docs, "data")

    def run(column):
        found = [feature_buckets(t.as_py(), ngram, buckets) for t in column]
        return [pa.array([n for n, _ in found], pa.int64()), pa.array([b.astype(kind).tobytes() for _, b in found], pa.binary())]

    src = docs.withColumn(data, F.col(f"`{text_col}`").cast("binary"))
    return scan(src, [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.BinaryType())], data, run, keep=keep)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(rows: DataFrame, column: str, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket; each task adds up its arrays before anything is shuffled."""
    kind = _kind(buckets)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets) if x.is_valid and x.as_buffer().size else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in rows.select(column).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n  # at most ``buckets`` rows
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
                      ngram: int = 1, buckets: int = 10_000, seed: str = "2024", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    if ngram < 1 or buckets < 1:
        raise ValueError("need ngram and buckets of at least 1")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS or c == id_col]
    data = free_name(docs, "buckets")
    rows = materialize(with_buckets(docs, text_col, [*keep, *([] if id_col in keep else [id_col])], ngram, buckets, ("n_words", data)), "buckets")
    wanted = with_buckets(target, target_text, [], ngram, buckets, ("n_words", "buckets"))
    gain = gains(bucket_counts(rows, data, buckets), bucket_counts(wanted, "buckets", buckets))
    kind = _kind(buckets)

    def weigh(column):
        sums = [(len(a), int(gain[a].sum())) for a in (np.frombuffer(x.as_buffer(), kind) if x.as_buffer().size else np.zeros(0, kind) for x in column)]
        return [pa.array([n for n, _ in sums], pa.int64()), pa.array([s // n if n else 0 for n, s in sums], pa.int64())]

    fields = [T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())]
    weighed = scan(rows, fields, data, weigh, keep=rows.columns[:-1])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def bracket(rows: DataFrame, score: str, take: int, total: int, accuracy: int = 400, margin: float = 0.01) -> tuple[int, int, int]:
    """(lo, hi, rows above hi) with the ``take``-th highest score in [lo, hi]; 1 <= take <= total.

    The sketch holds some ``accuracy`` values whatever the number of rows.  The counts outside are exact: a
    bracket that does not hold the cutoff is widened, up to all scores.
    """
    sketch = rows.agg(F.kll_sketch_agg_bigint(score, F.lit(accuracy)).alias("k"), F.min(score).alias("least"), F.max(score).alias("most"))
    kept = sketch.first()
    at = 1 - take / total
    while True:
        if margin >= 1:
            lo, hi = kept.least, kept.most
        else:
            ends = [F.kll_sketch_get_quantile_bigint(F.lit(kept.k), F.lit(float(x))) for x in (max(0.0, at - margin), min(1.0, at + margin))]
            lo, hi = rows.sparkSession.range(1).select(*ends).first()
        above, upto = rows.agg(F.count_if(F.col(score) > hi), F.count_if(F.col(score) >= lo)).first()
        if above < take <= upto:
            return lo, hi, above
        margin *= 4


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", percent: int = 10, min_words: int = 20,
                        **options) -> DataFrame:
    """Every row of ``importance_scores`` with its ``rank`` among the drawn ones (1, 2, ...; null: not drawn)."""
    scored = importance_scores(docs, target, id_col, **options)
    row = free_name(scored, "row_")
    scored = materialize(scored.withColumn(row, F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= min_words
    rows = scored.where(enough)
    total = rows.count()
    take = percent * total // 100
    out = scored.columns[:-1]
    if not take:
        return scored.select(*[F.col(f"`{c}`") for c in out], F.lit(None).cast("long").alias("rank"))
    lo, hi, above = bracket(rows, "score", take, total)
    # equal rows are told apart by their row number, so a hot repeated row is spread over the ranges of the sort
    order = [F.col("score").desc(), F.col(f"`{id_col}`").asc_nulls_last(), F.col("n_features"), F.col(row)]
    inside = with_position(rows.where(F.col("score").between(lo, hi)), order, "rank", start=above + 1)
    inside = inside.withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    first = with_position(rows.where(F.col("score") > hi), order, "rank")
    rest = scored.where(~enough | (F.col("score") < lo)).withColumn("rank", F.lit(None).cast("long"))
    return first.unionByName(inside).unionByName(rest).select(*[F.col(f"`{c}`") for c in out], "rank")
