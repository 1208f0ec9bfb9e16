"""Row operations on lists of records (sources, profiles, stages, messages).

Each is a narrow or single-shuffle DataFrame plan; none collects rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synthkit.functions.text import format_bytes as _format_bytes
from synthkit.functions.text import not_blank, slugify as _slugify
from synthkit.operators.ordering import with_position

# The phrase used when a list is empty.
EMPTY_LIST_PHRASE = "connected sources"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def select_enabled(df: DataFrame, flag, cols: list[str]) -> DataFrame:
    """Keep rows whose flag is true and project ``cols`` (pushed into the scan)."""
    return df.filter(_col(flag)).select(*cols)


def search_rows(df: DataFrame, col: str, term: str | None) -> DataFrame:
    """Case-insensitive literal substring search; an empty term keeps every row."""
    if not term:
        return df
    return df.filter(F.lower(F.col(col)).contains(term.lower()))


def ranked_sort_keys(flag, order, tie) -> list[Column]:
    """Sort keys: flagged rows first, flagged by ``order`` (null as 0), then ``tie``."""
    flag, order, tie = _col(flag), _col(order), _col(tie)
    return [flag.desc(), F.when(flag, F.coalesce(order, F.lit(0))).asc_nulls_last(), tie.asc()]


def ranked_sort(df: DataFrame, flag, order, tie, position: str | None = None) -> DataFrame:
    """Distributed sort by :func:`ranked_sort_keys`; optionally add a 1-based position.

    DataFrames have no input order, so the unflagged rows keep the order of
    ``tie`` (a stable sort over a list keeps its index order).
    """
    keys = ranked_sort_keys(flag, order, tie)
    if position:
        return with_position(df, keys, position)
    return df.orderBy(*keys)


def list_summary(df: DataFrame, by: list[str] | str, col: str, k: int = 2,
                 order: str | None = None, salt_buckets: int = 64, groups: DataFrame | None = None) -> DataFrame:
    """Per group: ``"a, b +n more"`` from the first ``k`` values; 1 value → itself.

    ``groups`` lists the groups to report (its distinct ``by`` columns, null included): those without rows have
    ``n`` 0 and the fixed phrase, and groups it does not list are left out.  Without it the rows' own groups.

    Groups may be huge and one may hold most rows, so whole groups are never
    collected: rows are salted into ``salt_buckets`` sub-groups, each keeps its
    first ``k`` (window on (group, salt)), and only ``k * salt_buckets``
    candidates per group meet in the final aggregate.  Counts use a partial
    (map-side) aggregate.
    """
    by = [by] if isinstance(by, str) else list(by)
    order = order or col
    salt = F.pmod(F.xxhash64(F.col(col), F.col(order)), F.lit(salt_buckets))
    cand = (df.select(*by, col, order if order != col else F.col(col).alias("_sk_ord"))
            .withColumn("_sk_salt", salt))
    ord_name = order if order != col else "_sk_ord"
    w = Window.partitionBy(*by, "_sk_salt").orderBy(F.col(ord_name).asc_nulls_last(),
                                                     F.col(col).asc_nulls_last())
    top = (cand.withColumn("_sk_rn", F.row_number().over(w)).filter(F.col("_sk_rn") <= k)
           .groupBy(*by)
           .agg(F.slice(F.sort_array(F.collect_list(F.struct(F.col(ord_name), F.col(col)))), 1, k)
                .alias("_sk_top")))
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    shown = F.array_join(F.transform(F.col("_sk_top"), lambda s: s[col].cast("string")), ", ")
    summary = (F.when(F.col("n") == 0, F.lit(EMPTY_LIST_PHRASE))
               .when(F.col("n") > k, F.concat(shown, F.lit(" +"), (F.col("n") - k).cast("string"),
                                              F.lit(" more")))
               .otherwise(shown))
    found = counts.join(top, by)
    if groups is None:
        return found.select(*by, "n", summary.alias("summary"))
    wanted = groups.select(*[F.col(b).alias("_sk_g_" + b) for b in by]).distinct()
    same = [F.col("_sk_g_" + b).eqNullSafe(F.col(b)) for b in by]
    listed = counts.join(top, [counts[b].eqNullSafe(top[b]) for b in by]).select(*[counts[b] for b in by], "n", "_sk_top")
    return (wanted.join(listed, same, "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
            .select(*[F.col("_sk_g_" + b).alias(b) for b in by], "n", summary.alias("summary")))


def lookup_or_first(keys: DataFrame, df: DataFrame, key: str, order: str,
                    key_in_keys: str | None = None) -> DataFrame:
    """For each key row: the matching ``df`` row, else the first ``df`` row by ``order``.

    The fallback is one row (``min_by``), so broadcasting it is bounded; the
    main lookup is a left join that Catalyst/AQE plans by size.
    """
    key_in_keys = key_in_keys or key
    cols = [c for c in df.columns]
    # the fallback row is a scalar subquery: evaluated once, one row whatever the data size
    first = df.agg(F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order))).scalar()
    right = df.select(*[F.col(c).alias("_sk_r_" + c) for c in cols])
    out = keys.join(right, keys[key_in_keys] == F.col("_sk_r_" + key), "left")
    hit = F.col("_sk_r_" + key).isNotNull()
    sel = [F.col(c) for c in keys.columns]
    for c in cols:
        name = c if c not in keys.columns else f"{c}_found"
        sel.append(F.when(hit, F.col("_sk_r_" + c)).otherwise(first[c]).alias(name))
    return out.select(*sel)


def patch_rows(df: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Replace the fields given in ``patch`` (null = keep) of the rows with the same key.

    ``patch`` holds at most one row per key.
    """
    pcols = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias("_sk_p_" + c) for c in pcols])
    j = df.join(p, key, "left")
    return j.select(*[F.coalesce(F.col("_sk_p_" + c), F.col(c)).alias(c) if c in pcols else F.col(c)
                      for c in df.columns])


def stage_status(log: DataFrame, job: str, stage: str, seq: list[str]) -> DataFrame:
    """Stage states from a log of "stage X is running" notices.

    The last notice per job (by ``seq``) names the running stage; stages whose
    id sorts before it (as strings) are done, later ones queued.  Returns one
    row per (job, stage) with ``status``, the job's ``current`` stage,
    ``n_done`` and ``all_done``.
    """
    last = log.groupBy(job).agg(
        F.max_by(F.col(stage).cast("string"), F.struct(*[F.col(c) for c in seq])).alias("current"))
    stages = log.select(job, F.col(stage).cast("string").alias("stage")).distinct()
    st = stages.join(last, job)
    status = (F.when(F.col("stage") < F.col("current"), "done")
              .when(F.col("stage") == F.col("current"), "running").otherwise("queued"))
    st = st.withColumn("status", status)
    w = Window.partitionBy(job)
    return st.select(
        job, "stage", "status", "current",
        F.count_if(F.col("status") == "done").over(w).alias("n_done"),
        F.bool_and(F.col("status") == "done").over(w).alias("all_done"),
    )


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Add ``b`` after ``a`` by column name; columns missing on one side become null."""
    return a.unionByName(b, allowMissingColumns=True)


def format_bytes(df: DataFrame, col: str, out: str = "size_text") -> DataFrame:
    return df.withColumn(out, _format_bytes(col))


def slugify(df: DataFrame, col: str, out: str = "slug", default: str = "profile") -> DataFrame:
    return df.withColumn(out, _slugify(col, default))


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose text is null or only whitespace."""
    return df.filter(not_blank(col))
