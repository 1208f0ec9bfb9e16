"""Registered queries of this package: one ``opN_<name>`` per operator, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
             FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT row, dw.n, i, item_id FROM dw JOIN bw USING (n, win)),
covered AS (SELECT row, count(DISTINCT p) AS n_hit
            FROM (SELECT row, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT row, n, i FROM hits)) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (row) LEFT JOIN items USING (row)
"""


@register("op6_decontaminate", OP6_SQL)
def op6_decontaminate(spark, sf_dir):
    from synthkit.llm.decontam import find_contamination
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), null_ids=True)
    items = F.transform("items", lambda x: x.cast("string"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


@register("op8_token_files")
def op8_token_files(spark, sf_dir):
    from synthkit.llm.token_file import token_files
    return token_files(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op10_pack")
def op10_pack(spark, sf_dir):
    from synthkit.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register("op9_secrets")
def op9_secrets(spark, sf_dir):
    from synthkit.llm.secret_scan import scan_secrets, spans_text
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    def of(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
                        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


@register("op4_shards")
def op4_shards(spark, sf_dir):
    from synthkit.llm.sharding import shard_by_bytes
    return shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op3_fingerprints")
def op3_fingerprints(spark, sf_dir):
    from synthkit.llm.simhash import edited_fingerprints, hex64
    found = edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_chars", "edited_sha256", hex64(F.col("fingerprint")).alias("fingerprint"),
                        hex64(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


@register("fingerprint_search")
def fingerprint_search(spark, sf_dir):
    """Documents within 3 bits of each document whose id is divisible by 50 (itself included)."""
    from synthkit.llm.common import materialize
    from synthkit.llm.simhash import fingerprints, hex64, near_fingerprints
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = materialize(fingerprints(docs, "row", "text", ["doc_id"]), "fingerprints")
    queries = found.where(F.col("doc_id") % 50 == 0)
    counts = found.groupBy("fingerprint").agg(F.count("*").alias("n"))
    near = near_fingerprints(queries, found).hint("merge").join(counts.hint("merge"), "fingerprint").groupBy("query").agg(F.sum("n").alias("n_near"))
    return queries.hint("merge").join(near.hint("merge"), F.col("fingerprint") == F.col("query")).select(
        "doc_id", hex64(F.col("fingerprint")).alias("fingerprint"), "n_near")


@register("op7_near_duplicates")
def op7_near_duplicates(spark, sf_dir):
    from synthkit.llm.simhash import hex64
    from synthkit.llm.simhash_dedup import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


@register("op5_pseudonyms")
def op5_pseudonyms(spark, sf_dir):
    """Every document with its private values replaced, and how many of each kind."""
    from synthkit.llm.pseudonyms import KINDS, pseudonymize
    done = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key="corpus-key-1")

    def of(kind):
        return F.size(F.filter("kinds", lambda x: x == kind)).cast("bigint").alias(f"n_{kind}")
    return done.select("doc_id", "text", F.size("kinds").cast("bigint").alias("n_private"), *[of(k) for k in KINDS])


URL_RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


@register("op1_url_filter")
def op1_url_filter(spark, sf_dir):
    from synthkit.llm.url_filter import judge_with_rules
    found = judge_with_rules(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "block_probability")


def learnable(labels: DataFrame) -> DataFrame:
    """Labels of the documents that may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


@register("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    from synthkit.llm.toxicity import score_texts, train
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs, learnable(table(spark, sf_dir, "labels")))
    scored = score_texts(docs, net, keep=["doc_id"])
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), "toxic")


OP11_SQL = r"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) AS r(i))),
d AS (SELECT row_number() OVER () AS row, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(w) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (
          SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY ALL),
vocabulary AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
bucketed AS MATERIALIZED (SELECT word, xor(list_reduce(list_transform(range(length(x) // 2), lambda j: CAST('0x' || substr(x, CAST(2 * j + 1 AS INT), 2) AS BIGINT)),
                                          lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
             FROM vocabulary, tab),
s AS (SELECT bucket, sum(n) AS n FROM dw JOIN bucketed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM bw JOIN bucketed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) AS DOUBLE)
                                        / CAST((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000) AS DOUBLE))) AS gain
         FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT row, floor(sum(dw.n * gain) / sum(dw.n)) AS weight FROM dw JOIN bucketed USING (word) JOIN gain USING (bucket) GROUP BY row),
scored AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
           FROM d LEFT JOIN weights USING (row)),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (row)
"""


@register("op11_resample", OP11_SQL)
def op11_resample(spark, sf_dir):
    from synthkit.llm.resampling import importance_resample
    drawn = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_OP12_NEAREST = """
near{i} AS MATERIALIZED (SELECT row, p, min_by(e, d * 256 + e) AS e, min(d) AS d FROM (
    SELECT row, p, e, list_dot_product(x, x) + list_dot_product(y, y) - 2 * list_dot_product(x, y) AS d FROM part JOIN book{i} USING (p)) GROUP BY row, p)"""

_OP12_ROUND = """
sums{i} AS (SELECT p, e, k, floor(sum(x[k]) / count(*)) AS m
            FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS k FROM near{i} JOIN part USING (row, p)) GROUP BY p, e, k),
book{j} AS MATERIALIZED (SELECT p, e, coalesce(m, y) AS y FROM book{i} LEFT JOIN (SELECT p, e, list(m ORDER BY k) AS m FROM sums{i} GROUP BY p, e) USING (p, e))"""

OP12_SQL = """
WITH kept AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda v: floor(1024 * CAST(v AS DOUBLE))) AS v, embedding
              FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v)))),
part AS MATERIALIZED (SELECT row, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS r(p)),
book0 AS MATERIALIZED (SELECT p, e, x AS y FROM part JOIN (
    SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS e FROM kept QUALIFY e < 256) USING (row)),
""" + ",".join(_OP12_NEAREST.format(i=i) + "," + _OP12_ROUND.format(i=i, j=i + 1) for i in range(4)) + "," + _OP12_NEAREST.format(i=4) + """,
coded AS (SELECT vec_id, label, code, error FROM kept JOIN (
    SELECT row, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near4 GROUP BY row) USING (row))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) FROM book4) AS codebooks_sha256
FROM coded
"""


@register("op12_vector_codes", OP12_SQL)
def op12_vector_codes(spark, sf_dir):
    from synthkit.llm.vector_codes import encode_vectors
    return encode_vectors(table(spark, sf_dir, "embeddings"), keep=["vec_id"])


@register("op13_repeats")
def op13_repeats(spark, sf_dir):
    from synthkit.llm.repeats import remove_repeats
    cut = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
