"""Sharding by sampled splitters: range partitions of near-equal size (law ``bytes``), DataFrame functions only.

The order is (hash of the group value, hash of the id, id): documents with equal text stand together.

1. A size-weighted sample of group hashes is drawn (each row by a hash of its id, with a chance in
   proportion to its size; ``per_range`` rows a range are expected, whatever the table's size).
2. Its quantiles are the splitters of ``ranges`` ranges; a hash that two quantiles hit is heavy and
   gets a range of its own.  Splitters are looked up by the hash's top bits (a table of at most a few
   times ``ranges`` rows), then compared.
3. A range with over twice its share of bytes is subdivided by the id's hash.
4. Exact bytes by part give every record its place in the running total; a record's shard is that of its
   place.  Groups of up to ``whole`` of a shard's size move as one, larger ones are spread.

No window or sort sees more than one part.  ``ranges`` grows with the table (``rows_per_range``).

Defined results: size is UTF-8 bytes plus 1 (null text: 1); repeated rows are records of their own;
null ids sort first; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synthkit.llm.common import materialize

_TOP = 2.0 ** 64


def _unit(h):
    """A 64-bit hash as a number from 0 to 1, in the order of the signed hash."""
    return (h.cast("double") + F.lit(_TOP / 2)) / F.lit(_TOP)


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
                   per_range: int = 32, rows_per_range: int = 1_000_000, whole: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard)."""
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    records = materialize(docs.select(
        ident.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"), F.xxhash64(ident, F.lit(7)).alias("_id")), "records")
    total, rows = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = max(16 * shards, -(-rows // rows_per_range))
    cells = _splitters(records, total, ranges, per_range)
    # the range: splitters in the cells before, and those of this cell up to the key
    placed = (records.withColumn("_cell", F.floor(_unit(F.col("_key")) * ranges).cast("int"))
              .join(F.broadcast(cells), "_cell", "left")
              .withColumn("_range", F.coalesce(F.col("_base"), F.lit(0)) + F.coalesce(
                  F.size(F.filter("_keys", lambda k: k <= F.col("_key"))), F.lit(0))))
    share = F.lit(max(1.0, total / ranges))
    sizes = placed.groupBy("_range").agg(F.sum("size").alias("_bytes"))
    fine = sizes.select("_range", F.when(F.col("_bytes") > 2 * share, F.ceil(F.col("_bytes") / share)).otherwise(1).alias("_parts"))
    parted = materialize(placed.join(F.broadcast(fine), "_range").select(
        "doc_id", "size", "text_crc32", "_key", "_id", "_range",
        F.least(F.floor(_unit(F.col("_id")) * F.col("_parts")), F.col("_parts") - 1).cast("bigint").alias("_sub")), "parts")

    # running bytes before each part: at most about 3 x ranges rows
    parts = parted.groupBy("_range", "_sub").agg(F.sum("size").alias("_bytes"))
    before = Window.orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_range", "_sub", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_offset"))
    part = Window.partitionBy("_range", "_sub").orderBy("_key", "_id", "doc_id", "text_crc32")
    group = Window.partitionBy("_range", "_sub", "_key")
    end = F.sum("size").over(part.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = (parted.withColumn("_end", end).withColumn("_group", F.sum("size").over(group))
           .withColumn("_group_end", F.max("_end").over(group)).join(F.broadcast(offsets), ["_range", "_sub"]))
    middle = F.col("_offset") + F.when(F.col("_group") <= F.lit(whole * total / shards), F.col("_group_end") - F.col("_group") / 2) \
        .otherwise(F.col("_end") - F.col("size") / 2)
    sharded = run.withColumn("shard", F.least(F.floor(middle * F.lit(shards / max(1, total))), F.lit(shards - 1)).cast("int"))

    # slots: rows of the shard in earlier parts, then the place within the part (at most a row for each part and shard)
    counts = sharded.groupBy("_range", "_sub", "shard").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_range", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_range", "_sub", "shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    place = Window.partitionBy("_range", "_sub", "shard").orderBy("_key", "_id", "doc_id", "text_crc32")
    return (sharded.withColumn("_row", F.row_number().over(place)).join(F.broadcast(first), ["_range", "_sub", "shard"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_first") + F.col("_row") - 1).alias("slot")))


def _splitters(records: DataFrame, total: int, ranges: int, per_range: int) -> DataFrame:
    """Cell -> number of splitters in the cells before it and the sorted splitters inside it."""
    chance = F.col("size") * F.lit(per_range * ranges / max(1, total))
    sample = records.where(_unit(F.xxhash64("_id", F.lit(13))) < chance).select("_key")
    # the sample has ranges x per_range rows, so one task sorts it
    step = F.ntile(ranges).over(Window.orderBy("_key"))
    first = sample.withColumn("_tile", step).groupBy("_tile").agg(F.min("_key").alias("_key"))
    hits = first.groupBy("_key").agg(F.count("*").alias("_hits"))
    heavy = hits.where("_hits > 1").select((F.col("_key") + 1).alias("_key"))  # closes a heavy hash's own range
    splitters = hits.select("_key").union(heavy).distinct()
    cells = (splitters.withColumn("_cell", F.floor(_unit(F.col("_key")) * ranges).cast("int"))
             .groupBy("_cell").agg(F.sort_array(F.collect_list("_key")).alias("_keys")))
    every = records.sparkSession.range(ranges + 1).select(F.col("id").cast("int").alias("_cell"))
    base = F.sum(F.coalesce(F.size("_keys"), F.lit(0))).over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    return every.join(cells, "_cell", "left").select("_cell", F.coalesce(base, F.lit(0)).alias("_base"), "_keys")
