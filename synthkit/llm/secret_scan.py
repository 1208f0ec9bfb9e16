"""Secret scan: three base patterns plus a battery of randomness tests with false-discovery control.

Base kinds (leftmost, non-overlapping per kind): ``assign`` (a keyword, a separator and a value of 6 or
more characters), ``access`` (``AKIA`` and capitals or digits, 20 or more), ``hex`` (24 or more).

The battery looks at runs of ``[A-Za-z0-9+/_-]`` of 16 or more characters with the padding behind them, and
at their parts of 16 or more between any of ``/``, ``_`` and ``-`` (a token may be joined to a label or a
path).  Of picked runs that lie within each other the longest is the span.  The encoding is inferred as the
smallest alphabet that holds the run (digits, hex, letters of one case, base32, base36, letters, base62,
base64, url-safe base64).  Three tests ask whether the symbols could be random: chi-squared uniformity
over the alphabet, runs above and below the alphabet's middle, and lag-1 serial correlation; a run that
fails one (Bonferroni over the three) is no secret.  The p-value is that of natural text: its likelihood as
a chain of the encoding's symbols, each after the one before it, over its likelihood as uniform symbols of the encoding (at
most p of natural runs come below p, whatever the length or alphabet).  The chain is measured on all shorter
words of the corpus, with a fixed one for rare contexts.  Benjamini-Hochberg at rate ``q`` then runs over all
candidates, apart for each encoding and band of lengths, on a histogram of p-values, so nothing is collected
but the pairs of symbols and (encodings x bands x bins) counts.  What passes is a span of kind ``random``,
unless a base span overlaps it.

Defined results: null and empty texts have no spans; every row is scanned for itself (repeated rows
and ids do not matter); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import string
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from synthkit.llm.common import free_name, materialize, release, scan

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # greedy: the same as AKIA[A-Z0-9]+ of 20 or more
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "api")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?")  # "=" is padding at the end only
#: Cuts of a run into parts: at each choice of the three joining symbols.
_PARTS = tuple((cut, re.compile(f"[^{cut}]{{16,}}")) for cut in ("/", "_", "\\-", "/_", "/\\-", "_\\-", "/_\\-"))

#: Alphabets in the order of inference; the last two are equal but for two symbols.
ALPHABETS = tuple((name, symbols) for name, symbols in (
    ("digits", string.digits), ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"),
    ("lower", string.ascii_lowercase), ("upper", string.ascii_uppercase), ("base32", string.ascii_uppercase + "234567"),
    ("base36", string.digits + string.ascii_lowercase), ("BASE36", string.digits + string.ascii_uppercase),
    ("letters", string.ascii_letters), ("base62", string.digits + string.ascii_letters),
    ("base64", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
    ("base64url", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_")))
_TABLES = [(name, len(s), {c: i for i, c in enumerate(s)}) for name, s in ALPHABETS]

_ORDER = string.ascii_lowercase + string.ascii_uppercase + string.digits + "-_/+"  # symbols of the chain
_PLACE = {c: i for i, c in enumerate(_ORDER, 1)}  # 0 stands for the beginning of a word
_CODES = np.zeros(256, np.uint8)
_CODES[np.frombuffer(_ORDER.encode(), np.uint8)] = np.arange(1, len(_ORDER) + 1)
#: The fixed chain: from class to class (lower, upper, digit, joint) after the beginning or a class, and shares within them.
_LETTERS = np.array([8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.5, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.3, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.4, 2.0, 0.4])
_NEXT = np.array([[.70, .20, .09, .01], [.93, .01, .02, .04], [.55, .40, .02, .03], [.03, .02, .85, .10], [.60, .20, .18, .02]])
_SHARES = [_LETTERS / _LETTERS.sum(), _LETTERS / _LETTERS.sum(), np.full(10, 0.1), np.array([0.4, 0.35, 0.2, 0.05])]
_CLASS = np.repeat([1, 2, 3, 4], [26, 26, 10, 4])
_FIXED = np.stack([np.concatenate([n * s for n, s in zip(_NEXT[c], _SHARES)]) for c in (0, *_CLASS)])
_WEIGHT = 100.0  # pairs that the fixed chain counts for in each context
BANDS = (24, 32, 48, 96)  # lengths from which a new band of false-discovery control starts
ALPHA = 0.001  # level of the three randomness tests together
Q = 0.01  # false-discovery rate
_STEP, _TOP = 0.05, 60.0  # histogram of -log10 p

_BASE = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()),
                                  T.StructField("end", T.IntegerType())]))
_RUNS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("encoding", T.StringType()), T.StructField("band", T.IntegerType()),
                                  T.StructField("random", T.BooleanType()), T.StructField("bin", T.IntegerType())]))
_BASE_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_RUNS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()),
                                  ("band", pa.int32()), ("random", pa.bool_()), ("bin", pa.int32())]))


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    for start, word in _long_words(text, 20):
        if "AKIA" in word:
            out += [(start + m.start(), 1, start + m.end()) for m in _ACCESS.finditer(word)]
        out += [(start + m.start(), 2, start + m.end()) for m in _HEX.finditer(word)]
    return sorted(out)


def _long_words(text: str, least: int):
    """(start, word) of the runs between white space with at least so many characters."""
    at = 0
    for word in text.split():
        if len(word) >= least:
            at = text.index(word, at)
            yield at, word
            at += len(word)


def infer_encoding(run: str) -> tuple[str, int, np.ndarray] | None:
    """Name, alphabet size and symbol numbers of the smallest alphabet that holds the run (padding cut off)."""
    body = run.rstrip("=")
    for name, k, table in _TABLES:
        try:
            return name, k, np.array([table[c] for c in body])
        except KeyError:
            continue
    return None


def battery(symbols: np.ndarray, k: int) -> tuple[bool, float]:
    """(passes as random, least p-value of the three tests) of a run over an alphabet of ``k``."""
    n = len(symbols)
    counts = np.bincount(symbols, minlength=k)
    chi = k / n * float((counts.astype(float) ** 2).sum()) - n
    df = k - 1
    z = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson-Hilferty
    p_uniform = _upper_tail(z)
    above = symbols * 2 >= k
    n1 = int(above.sum())
    n0 = n - n1
    if n1 and n0:
        runs = 1 + int((above[1:] != above[:-1]).sum())
        mean = 2 * n1 * n0 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _upper_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    centred = symbols - symbols.mean()
    power = float((centred ** 2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p_serial = 2 * _upper_tail(abs(serial + 1 / n) * math.sqrt(n))
    least = min(p_uniform, p_runs, p_serial)
    return 3 * least >= ALPHA, least


def pair_counts(texts: list[str]) -> np.ndarray:
    """How often each symbol follows another (or begins) in the words and word parts of under 16 symbols."""
    side = len(_ORDER) + 1
    out = np.zeros(side * side, np.int64)
    for i in range(0, len(texts), 64):
        codes = _CODES[np.frombuffer(("\n" + "\n".join(texts[i:i + 64]) + "\n").encode("utf-8", "replace"), np.uint8)]
        ends = np.flatnonzero(codes == 0)
        long = np.flatnonzero(np.diff(ends) > 16)
        codes = codes.astype(np.int32)
        pairs = np.where(codes[1:] > 0, codes[:-1] * side + codes[1:], 0)
        for a, b in zip(ends[long].tolist(), ends[long + 1].tolist()):
            pairs[a:b] = 0
        out += np.bincount(pairs, minlength=side * side)
    out[0] = 0
    return out


def natural_chains(docs: DataFrame, text_col: str = "text") -> dict[str, np.ndarray]:
    """Encoding -> log10 of the chance of each symbol after each (row 0: at the beginning) among the encoding's,
    measured over the whole corpus."""
    side = len(_ORDER) + 1

    def count(batches):
        release()
        for b in batches:
            n = pair_counts([t for t in b.column(0).to_pylist() if t])
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["pair", "pairs"])

    found = docs.select(F.col(f"`{text_col}`")).mapInArrow(count, "pair int, pairs bigint")
    table = np.zeros(side * side)
    for r in found.groupBy("pair").agg(F.sum("pairs").alias("n")).collect():  # at most one row per pair of symbols
        table[r["pair"]] = r["n"]
    table = table.reshape(side, side)[:, 1:]
    chance = (table + _WEIGHT * _FIXED) / (table.sum(axis=1, keepdims=True) + _WEIGHT)
    return {name: np.log10(chance / chance[:, [_PLACE[c] - 1 for c in symbols]].sum(axis=1, keepdims=True)) for name, symbols in ALPHABETS}


def natural_level(run: str, k: int, chain: np.ndarray) -> float:
    """-log10 of the p-value of a run over an alphabet of ``k`` with the chain of its encoding (0 at least)."""
    at = np.array([_PLACE[c] for c in run.rstrip("=")])
    return max(0.0, -float(chain[np.append(0, at[:-1]), at - 1].sum()) - len(at) * math.log10(k))


def candidates(word: str) -> list[tuple[int, int]]:
    """(start, end) of the runs of a word and of their parts, each once."""
    out = {}
    for m in _RUN.finditer(word):
        out[m.span()] = None
        if not m[0].isalnum():
            for cut, part in _PARTS:
                if any(c in m[0] for c in cut):
                    out.update(dict.fromkeys(x.span() for x in part.finditer(word, *m.span())))
    return list(out)


def random_runs(text: str, chains: dict[str, np.ndarray]) -> list[dict]:
    out = []
    for start, word in _long_words(text, 16):
        for a, b in candidates(word):
            if (found := infer_encoding(word[a:b])) is None or len(found[2]) < 16:
                continue
            name, k, symbols = found
            level = min(_TOP, natural_level(word[a:b], k, chains[name]))
            out.append({"start": start + a, "end": start + b, "encoding": name, "random": battery(symbols, k)[0],
                        "band": sum(len(symbols) >= n for n in BANDS), "bin": int(level / _STEP)})
    return out


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, q: float = Q) -> DataFrame:
    """The ``keep`` columns (all by default) plus ``base`` and ``spans``: sorted structs (start, kind, end)."""
    keep = docs.columns if keep is None else keep
    found, base, runs, least = _candidates(docs, text_col, keep, q)
    both, spans = free_name(found, "both"), free_name(docs, "spans")

    def pick(column):
        return [pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in merged_spans(x, y, least)]
                          for x, y in zip(column.field(0).to_pylist(), column.field(1).to_pylist())], _BASE_ARROW)]

    picked = found.withColumn(both, F.struct(F.col(base), F.col(runs)))
    return scan(picked, [T.StructField(spans, _BASE)], both, pick, keep=[*keep, base])


def _candidates(docs: DataFrame, text_col: str, keep: list[str], q: float) -> tuple[DataFrame, str, str, dict[tuple[str, int], int]]:
    """(``keep`` columns with the base spans and the candidate runs, the names of these two, the thresholds).

    One scan of the texts for the natural chains; one for the candidates, written to the shared folder; then
    the counts by (encoding, band, bin) of all candidates give the threshold of each encoding and band.
    """
    base, runs = free_name(docs, "base"), free_name(docs, "runs")
    chains = natural_chains(docs, text_col)

    def find(column):
        texts = ["" if t is None else t for t in column.to_pylist()]
        found = [base_spans(t) for t in texts]
        return [pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in found], _BASE_ARROW),
                pa.array([random_runs(t, chains) for t in texts], _RUNS_ARROW)]

    found = materialize(scan(docs, [T.StructField(base, _BASE), T.StructField(runs, _RUNS)], text_col, find, keep), "secrets")
    return found, base, runs, thresholds(found.select(F.inline(runs)), q)


def merged_spans(base: list[dict], runs: list[dict], least: dict[tuple[str, int], int]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans and of the runs that pass, sorted: of runs within others just the widest,
    and none that overlaps a base span.  One pass over sorted spans."""
    base = sorted((b["start"], b["kind"], b["end"]) for b in base or ())
    starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    out, top = [], -1
    picked = [(r["start"], -r["end"]) for r in runs or () if r["random"] and r["bin"] >= least.get((r["encoding"], r["band"]), math.inf)]
    for start, end in sorted(picked):
        before = bisect_left(starts, -end)  # base spans that start before the run's end
        if (not before or reach[before - 1] <= start) and -end > top:
            out.append((start, len(KINDS) - 1, -end))
            top = -end
    return sorted(base + out)


def thresholds(runs: DataFrame, q: float = Q) -> dict[tuple[str, int], int]:
    """(encoding, band) -> smallest histogram bin of -log10 p that Benjamini-Hochberg still rejects at rate ``q``."""
    counts: dict[tuple[str, int], dict[int, int]] = {}
    for r in runs.groupBy("encoding", "band", "bin").agg(F.count("*").alias("n")).collect():  # encodings x bands x bins rows at most
        counts.setdefault((r["encoding"], r["band"]), {})[r["bin"]] = r["n"]
    out = {}
    for group, by_bin in counts.items():
        total, above, best = sum(by_bin.values()), 0, None
        for b in sorted(by_bin, reverse=True):
            above += by_bin[b]
            if 10 ** (-b * _STEP) * total <= q * above:  # p of the bin's lower edge: on the safe side
                best = b
        if best is not None:
            out[group] = best
    return out


def spans_text(spans) -> F.Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", put: str = "[SECRET]", q: float = Q) -> DataFrame:
    """``docs`` with every span replaced by ``put``, same columns (``length_col`` follows the new text).

    The spans are picked and cut in one scan: of two in a row each task would hold two Python workers.
    """
    found, base, runs, least = _candidates(docs, text_col, docs.columns, q)

    def cut(column):
        out = []
        for text, x, y in zip(column.field(0), column.field(1), column.field(2)):
            where, at, parts = merged_spans(x.as_py(), y.as_py(), least), 0, []
            text = text.as_py() if where else None
            for start, _, end in where:
                if end > at:
                    parts += [text[at:start], put] if start >= at else []
                    at = end
            out.append("".join([*parts, text[at:]]) if where else None)
        return [pa.array(out, pa.string())]

    both, new = free_name(found, "both"), free_name(found, "redacted")
    some = (F.size(F.col(base)) > 0) | (F.size(F.col(runs)) > 0)
    found = found.withColumn(both, F.struct(F.when(some, F.col(f"`{text_col}`")), F.col(base), F.col(runs)))
    done = scan(found, [T.StructField(new, T.StringType())], both, cut, keep=docs.columns)
    hit = F.col(new).isNotNull()
    text = F.coalesce(F.col(new), F.col(f"`{text_col}`"))
    return done.select(*[text.alias(c) if c == text_col else
                         F.when(hit, F.char_length(text).cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c)
                         if c == length_col else F.col(f"`{c}`") for c in docs.columns])
