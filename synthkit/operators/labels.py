"""Multi-label values with the source's label shares and lengths: conditional Bernoulli sampling.

A row first draws its number of labels.  Given that number, a set of labels has a probability in proportion to the
product of its labels' weights; elementary symmetric sums of the weights turn this into one yes/no draw a label, going
through the labels in order.  The weights are fitted so that the label shares over all lengths are the wanted ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from synthkit.functions.random import uniform

_TINY = 1e-12


def take_chances(log_w: np.ndarray, most: int) -> np.ndarray:
    """[i, k]: chance to take label i when k labels are still wanted from i and its successors."""
    m = len(log_w)
    sums = np.full((m + 1, most + 1), -np.inf)  # log elementary symmetric sums of the weights from i on
    sums[:, 0] = 0.0
    chances = np.zeros((m, most + 1))
    for i in range(m - 1, -1, -1):
        taken = log_w[i] + sums[i + 1, :-1]
        sums[i, 1:] = np.logaddexp(sums[i + 1, 1:], taken)
        can = np.isfinite(sums[i, 1:])
        chances[i, 1:][can] = np.exp(taken[can] - sums[i, 1:][can])
    return chances


def expected_shares(chances: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Share of rows that hold each label, with ``lengths[k]`` the share of rows of k labels."""
    left, out = lengths.copy(), np.zeros(len(chances))
    for i, p in enumerate(chances):
        taken = left * p
        out[i] = taken.sum()
        left = left - taken
        left[:-1] += taken[1:]
    return out


def fit_chances(shares: list[float], lengths: list[tuple[int, float]], rounds: int = 2000, close: float = 1e-6) -> np.ndarray:
    """The take chances whose expected label shares are the given ones."""
    p = np.clip(np.asarray(shares, float), _TINY, 1 - _TINY)
    most = max([k for k, _ in lengths], default=0)
    if most > len(p):
        raise ValueError(f"rows of {most} labels cannot be drawn from {len(p)} labels")
    hist = np.zeros(most + 1)
    for k, share in lengths:
        hist[k] += share
    hist /= hist.sum()
    log_w = np.log(p) - np.log1p(-p)
    chances = take_chances(log_w, most)
    for _ in range(rounds):
        found = np.maximum(expected_shares(chances, hist), _TINY)
        if np.abs(found - p).max() < close:
            break
        log_w = log_w + np.log(p / found)
        log_w -= log_w.mean()  # a common factor changes nothing
        chances = take_chances(log_w, most)
    return chances


def gen_label_sets(seed: int, name: str, shares: list[tuple[str, float]], lengths: list[tuple[int, float]], mode: str = "md5",
                   key: Column | None = None) -> Column:
    """A set of labels a row, in the order of ``shares``: lengths as ``lengths``, label shares as ``shares``.

    One uniform for the length (inverse distribution, ascending) and one for each label; no labels or only the
    length 0 give the empty array.
    """
    key = key if key is not None else F.col("id")
    none = F.array().cast("array<string>")
    lengths = sorted((int(k), float(s)) for k, s in lengths if s > 0)
    if not shares or not lengths:
        return none
    chances = fit_chances([s for _, s in shares], lengths)
    total = sum(s for _, s in lengths)
    ends = np.cumsum([s / total for _, s in lengths])[:-1]
    u = uniform(seed, f"{name}:#", key, mode)
    place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in ends]).cast("array<double>"), lambda e: e <= u))
    wanted = F.get(F.array(*[F.lit(k) for k, _ in lengths]), place)
    draws = F.array(*[F.struct(uniform(seed, f"{name}:{lab}", key, mode).alias("u"), F.lit(lab).alias("label"),
                               F.array(*[F.lit(float(c)) for c in chances[i]]).alias("p")) for i, (lab, _) in enumerate(shares)])

    def step(state, draw):
        take = draw["u"] < F.get(draw["p"], state["left"])
        return F.struct((state["left"] - take.cast("int")).alias("left"),
                        F.when(take, F.concat(state["got"], F.array(draw["label"]))).otherwise(state["got"]).alias("got"))

    return F.aggregate(draws, F.struct(wanted.alias("left"), none.alias("got")), step, lambda s: s["got"])
