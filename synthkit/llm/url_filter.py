"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

DataFrame functions and ``pyspark.ml`` only.  Features of a url: length, host length, path depth, digit
ratio, character entropy, numbers of parameters, host labels, hyphens and digits of the host, longest
host label, and suffix statistics: how often the labelled urls under the same last label and the same
last two labels are blocked (smoothed towards the overall rate).

The trees are fitted on at most ``MOST_LABELLED`` labelled urls, those of the smallest hash of the url, so
the same urls are taken however the table is partitioned; suffix statistics come from the same rows and
are at most as many.  Every url is judged.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; the trees
judge it like any other (all lengths 0).  Repeated rows are judged each; labels that are null are not
learned from; without labelled urls of both classes the verdict of the trees is ``allow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthkit.llm.common import ascii_lower, free_name, materialize

MOST_LABELLED = 8_000
SMOOTH = 20.0  # labelled urls' worth of the overall rate in a suffix's statistics
FOLDS = 5
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "host_digits",
            "longest_label", "rate_last", "rate_two")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule: str) -> Column:
    """``host/path-prefix``: the host or a subdomain of it, and a path that starts with the prefix."""
    name, _, prefix = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits (of equally long ones the first by name), or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r), r), reverse=True):
        out = F.when(fits(host, path, rule), F.lit(rule)).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits."""
    n = F.char_length(text)
    chars = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    share = F.transform(chars, lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def _share(part: Column, whole: Column) -> Column:
    return F.when(F.char_length(whole) > 0, F.char_length(part) / F.char_length(whole)).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Feature name -> expression, but for the suffix statistics."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    out = {
        "length": F.char_length(text), "host_length": F.char_length(host),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": _share(F.regexp_replace(text, "[^0-9]", ""), text),
        "entropy": entropy(text),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "labels": F.when(host == "", 0).otherwise(F.size(labels)),
        "hyphens": F.char_length(F.regexp_replace(host, "[^-]", "")),
        "host_digits": F.char_length(F.regexp_replace(host, "[^0-9]", "")),
        "longest_label": F.array_max(F.transform(labels, F.char_length)),
    }
    return {k: c.cast("double") for k, c in out.items()}


def _suffixes(host: Column) -> tuple[Column, Column]:
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


class UrlModel:
    """Trees and suffix statistics; ``probability`` adds the chance that a url is to be blocked."""

    def __init__(self, model, rates: dict[str, DataFrame], overall: float):
        self.model, self.rates, self.overall = model, rates, overall

    def features(self, df: DataFrame, url: str, host: str, path: str) -> DataFrame:
        """``df`` plus one column per feature (their names must be free)."""
        df = df.withColumns(lexical(F.col(url), F.col(host), F.col(path)))
        for name, suffix in zip(("rate_last", "rate_two"), _suffixes(F.col(host))):
            # at most as many rows as labelled urls, which are bounded
            df = (df.withColumn("_suffix", suffix).join(F.broadcast(self.rates[name]), "_suffix", "left")
                  .withColumn(name, F.coalesce(name, F.lit(self.overall))).drop("_suffix"))
        return df

    def probability(self, df: DataFrame, url: str, host: str, path: str) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(self.features(df, url, host, path))
        if self.model is None:
            return rows.withColumn("block_probability", F.lit(self.overall))
        return self.model.transform(rows).withColumn("block_probability", vector_to_array("_probability")[1])


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", most: int = MOST_LABELLED,
          trees: int = 10, depth: int = 3, seed: int = 1) -> UrlModel:
    """Fit the trees on a bounded sample of distinct labelled urls (label 1: block, 0: allow)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    url = F.col(url_col)
    sample = labelled.select(url.alias("_url"), F.col(label_col).cast("double").alias("_label")).where("_label IN (0, 1)").distinct()
    sample = sample.orderBy(F.xxhash64("_url"), "_url", "_label").limit(most)
    sample = materialize(sample.select("_url", "_label", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path")), "labelled")
    n, blocked = sample.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0.0))).first()
    overall = blocked / n if n else 0.0
    rates, folded = {}, sample.withColumn("_fold", F.pmod(F.xxhash64("_url", F.lit(5)), F.lit(FOLDS)))
    for name, suffix in zip(("rate_last", "rate_two"), _suffixes(F.col("_host"))):
        by_fold = folded.groupBy(suffix.alias("_suffix"), "_fold").agg(F.sum("_label").alias("_s"), F.count("*").alias("_c"))
        whole = by_fold.groupBy("_suffix").agg(F.sum("_s").alias("_all_s"), F.sum("_c").alias("_all_c"))
        rates[name] = whole.select("_suffix", ((F.col("_all_s") + SMOOTH * overall) / (F.col("_all_c") + SMOOTH)).alias(name))
        # a training url's statistics leave out its own fold, or they would give its label away
        other = by_fold.join(whole, "_suffix").select("_suffix", "_fold", (
            (F.col("_all_s") - F.col("_s") + SMOOTH * overall) / (F.col("_all_c") - F.col("_c") + SMOOTH)).alias(name))
        folded = folded.withColumn("_suffix", suffix).join(other, ["_suffix", "_fold"]).drop("_suffix")
    model = UrlModel(None, rates, overall)
    if 0 < blocked < n:
        rows = folded.withColumns(lexical(F.col("_url"), F.col("_host"), F.col("_path")))
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(rows)
        rows = rows.withColumn("_weight", F.when(F.col("_label") == 1, n / (2 * blocked)).otherwise(n / (2 * (n - blocked))))
        boosted = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_prediction",
                                weightCol="_weight", maxIter=trees, maxDepth=depth, maxBins=32, seed=seed)
        model.model = boosted.setProbabilityCol("_probability").setRawPredictionCol("_raw").fit(materialize(rows.select("_features", "_label", "_weight").coalesce(4), "features"))
    return model


def judge(pages: DataFrame, rules: dict[str, str], model: UrlModel, url_col: str = "url", least: float = 0.5) -> DataFrame:
    """``pages`` plus host, path, rule, verdict (allow or block) and the trees' block_probability."""
    added = {n: free_name(pages, n) for n in ("host", "path", "rule", "verdict", "block_probability")}
    src = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"), F.col(f"`{url_col}`").alias("_url"))
    src = src.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    src = src.withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    scored = model.probability(src, "_url", "_host", "_path")
    verdict = F.when(F.col("block_probability") >= least, "block").otherwise("allow")
    for rule, what in rules.items():
        verdict = F.when(F.col("_rule") == rule, what).otherwise(verdict)
    return scored.select("_row.*", F.col("_host").alias(added["host"]), F.col("_path").alias(added["path"]), F.col("_rule").alias(added["rule"]),
                         verdict.alias(added["verdict"]), F.col("block_probability").alias(added["block_probability"]))


def labels_from_rules(pages: DataFrame, rules: dict[str, str], url_col: str = "url") -> DataFrame:
    """The urls that a rule decides, labelled 1 (block) or 0 (allow)."""
    url = F.col(f"`{url_col}`")
    rule = rule_of(host_of(url), path_of(url), rules)
    blocked = F.lit(False)
    for name, what in rules.items():
        if what == "block":
            blocked = blocked | (rule == name)
    return pages.select(url.alias("url"), F.when(rule.isNotNull(), F.when(blocked, 1).otherwise(0)).alias("label")).where("label IS NOT NULL")


def judge_with_rules(pages: DataFrame, rules: dict[str, str], url_col: str = "url", **options) -> DataFrame:
    """Judge all ``pages``; the urls that rules decide are the labelled ones from which the trees learn."""
    model = train(labels_from_rules(pages, rules, url_col), **options)
    return judge(pages, rules, model, url_col)
