"""Document fingerprints by SimHash, DataFrame functions only, and search within a Hamming radius.

Terms are pairs of consecutive words (runs of ASCII letters, digits and non-ASCII characters,
lower-cased; a single word is a term by itself).  Each occurrence votes with the term's weight, its
number of characters up to 32, so that pairs of short function words count little: +weight on the bits
set in the term's 64-bit hash, -weight on the others.  A fingerprint bit is set where the sum is positive.

The votes are summed two bits to a 64-bit number (32 sums; a lane holds up to 2^31, some 67 million terms
of full weight in one document), so a document is one small row after the map side: only that row is
shuffled.  Weights need no corpus statistics, so a document's fingerprint never depends on the others.

:func:`near_fingerprints` finds all fingerprints within ``radius`` of the queries.  The 64 bits are cut
into ``blocks`` blocks; two fingerprints within the radius agree on at least ``blocks - radius`` of them,
so a table for each choice of that many blocks (the permuted tables) finds every one of them.  It works on
distinct fingerprints; each found pair comes from the first table that holds it and is checked by its
exact distance.

Defined results: null and empty texts, and texts without words, have the fingerprint of the empty term
list (all zero bits); equal texts have equal fingerprints; repeated rows give one row each.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64
_LANES = 0x0000000100000001


def vote_sums(h: Column, weight: Column | None = None) -> list[Column]:
    """32 aggregate columns: lane sums of the weight where bit i (low lane) and bit i + 32 (high lane) are set."""
    out = []
    for i in range(32):
        lanes = F.shiftright(h, i).bitwiseAND(F.lit(_LANES)) if i else h.bitwiseAND(F.lit(_LANES))
        out.append(F.sum(lanes if weight is None else lanes * weight).alias(f"_v{i}"))
    return out


def majority(total: Column) -> Column:
    """The 64-bit number whose bits are set where the lane sum is over half of ``total``."""
    low = [F.when(F.col(f"_v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > total, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(32)]
    high = [F.when(F.shiftrightunsigned(F.col(f"_v{i}"), 32) * 2 > total, F.lit((1 << (i + 32)) - (1 << 64 if i == 31 else 0)))
            .otherwise(F.lit(0)) for i in range(32)]
    return reduce(lambda a, b: a.bitwiseOR(b), [c.cast("bigint") for c in low + high])


MOST_WEIGHT = 32
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Pairs of consecutive words; a single word is one term; no words, no terms."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SEPARATOR), lambda w: w != "")
    # the array of one array gives the words a name, so they are split once
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) < 2, w).otherwise(
        F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))), F.lit(0))


def fingerprints(rows: DataFrame, row_id: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row_id`` (must be unique), the ``keep`` columns and ``fingerprint`` (64 bits as a bigint).

    Texts without terms have no votes and fingerprint 0.
    """
    keep = keep or []
    votes = rows.select(row_id, *keep, F.explode_outer(terms(F.col(text_col))).alias("_term")).select(
        row_id, *keep, F.xxhash64("_term").alias("_h"),
        F.when(F.col("_term").isNull(), 0).otherwise(F.least(F.char_length("_term"), F.lit(MOST_WEIGHT))).cast("bigint").alias("_w"))
    sums = votes.groupBy(row_id, *keep).agg(F.sum("_w").alias("_total"), *vote_sums(F.col("_h"), F.col("_w")))
    return sums.select(row_id, *keep, majority(F.col("_total")).alias("fingerprint"))


def hex64(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the angle that the share of differing bits estimates; 0 from half the bits on."""
    return F.when(distance(a, b) >= BITS // 2, 0.0).otherwise(F.cos(distance(a, b) * F.lit(3.141592653589793 / BITS)))


def _masks(blocks: int) -> list[int]:
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def near_fingerprints(queries: DataFrame, base: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (query, fingerprint, distance) of distinct fingerprints within ``radius``, themselves included.

    Both frames need a bigint column ``fingerprint``.  More blocks make more tables with longer keys
    (6 blocks, radius 3: 20 tables keyed by some 32 bits).
    """
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("need 0 <= radius < blocks")
    parts = _masks(blocks)
    masks = [sum(m) - (1 << 64 if sum(m) >> 63 else 0) for m in combinations(parts, blocks - radius)]

    def keyed(df, name):
        keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])
        one = df.select("fingerprint").where("fingerprint is not null").distinct()
        return one.select(F.col("fingerprint").alias(name), F.explode(keys).alias("key")).select(name, "key.*")

    q, b = keyed(queries, "query"), keyed(base, "fingerprint")
    differ = F.col("query").bitwiseXOR(F.col("fingerprint"))
    table = reduce(lambda rest, tm: F.when(differ.bitwiseAND(F.lit(tm[1])) == 0, F.lit(tm[0])).otherwise(rest),
                   reversed(list(enumerate(masks))), F.lit(-1))
    # both sides grow with the rows, but a written table of fingerprints looks small: joined by shuffles, never broadcast
    met = (q["t"] == b["t"]) & (q["k"] == b["k"]) & (F.bit_count(differ) <= radius) & (table == q["t"])
    return q.hint("merge").join(b.hint("merge"), met).select("query", "fingerprint", F.bit_count(differ).cast("int").alias("distance"))


def _range_of(order: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at or below ``order`` (binary search, once per document)."""
    if not cuts:
        return F.lit(0)
    array, steps = F.array(*[F.lit(c).cast("bigint") for c in cuts]), len(cuts).bit_length()
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(array, middle) <= order
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(open_ & ~below, middle).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), state, halve, lambda s: s["lo"])


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text (of the next document by ascending id; after the last comes the first).

    Ids (integers) are cut into ranges at their approximate quantiles; the first document of each range
    is copied behind the range before it, so the only shuffle deals whole texts by range.  The result
    keeps ``_range``, ``_tail`` (true: such a copy), ``_order`` and ``_hash``.  Rows with equal ids follow
    each other by a hash of their text; a null id comes first.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-2 ** 63))
    ranges = 8 * max(24, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = docs.select(order.alias("_order"))
    cuts = ids.agg(F.percentile_approx("_order", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    firsts = dict(ids.groupBy(_range_of(F.col("_order"), cuts).alias("r")).agg(F.min("_order")).collect())  # one row a range
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), order.alias("_order"))
    rows = rows.withColumn("_range", _range_of(F.col("_order"), cuts)).withColumn("_tail", F.lit(False))
    filled = sorted(firsts)
    copies = rows.where(F.col("_order").isin(list(firsts.values()))).withColumn("_tail", F.lit(True))
    if filled:
        before = F.create_map(*[F.lit(x) for r, p in zip(filled, [filled[-1], *filled[:-1]]) for x in (r, p)])
        copies = copies.withColumn("_range", F.element_at(before, F.col("_range")))
    w = Window.partitionBy("_range").orderBy("_tail", "_order", "_hash")
    both = rows.unionByName(copies).withColumn("_hash", F.xxhash64("text"))
    return both.withColumn("next_text", F.lead("text").over(w))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 4) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last ``1/share`` comes from the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (bigint), near_edited, near_next.
    All steps after the shuffle of :func:`with_next_text` stay inside a range.
    """
    n = F.char_length("text")
    part = F.floor(n / share).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), part))
    numbered = with_next_text(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    texts = numbered.select(
        "_range", "_row", "doc_id", "_tail", "_order", "_hash", F.explode(F.array(F.struct(F.lit(False).alias("edited"), F.col("text").alias("text")),
                          F.struct(F.lit(True).alias("edited"), edited.alias("text")))).alias("v"))
    keep = ["_row", "doc_id", "_tail", "_order", "_hash", "_edited", "_n", "_sha"]
    texts = texts.select("_range", "_row", "doc_id", "_tail", "_order", "_hash", F.col("v.edited").alias("_edited"), F.col("v.text").alias("text"),
                         F.char_length("v.text").cast("bigint").alias("_n"), F.when(F.col("v.edited"), F.sha2("v.text", 256)).alias("_sha"))
    both = fingerprints(texts, "_range", "text", keep)
    own, new = ~F.col("_edited"), F.col("_edited")
    rows = both.groupBy("_range", "_row", "doc_id", "_tail", "_order", "_hash").agg(
        F.max(F.when(own, F.col("_n"))).alias("n_chars"), F.max("_sha").alias("edited_sha256"),
        F.max(F.when(own, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(new, F.col("fingerprint"))).alias("edited_fingerprint"))
    w = Window.partitionBy("_range").orderBy("_tail", "_order", "_hash")
    return rows.withColumn("_next", F.lead("fingerprint").over(w)).where("NOT _tail").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"))
