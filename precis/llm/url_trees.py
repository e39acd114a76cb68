"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

* A rule ``host/path`` fits its host and all its subdomains if the URL's path starts with the rule's path; the longest
  rule that fits decides. Rules are a short list, matched by a chain of column expressions.
* URLs that rules decide are the labelled ones. On a bounded sample of them (``FIT_URLS``, smallest hash first) Spark
  MLlib's gradient-boosted trees learn to block from lexical features: lengths, depth, digit and letter shares, entropy,
  parameter counts, separators and suffix statistics (smoothed share of blocked URLs among labelled ones with the same
  last label and the same last two labels, over all labelled URLs and every suffix; a port is no part of it). Suffixes stay a table that is joined:
  the ``HOT_SUFFIXES`` most frequent by broadcast, the others, if any, by a salted join.
* Every other URL gets the trees' verdict. Without labelled URLs: allow; with one label only: that one.

Null URLs or URLs without ``://``: host and path empty, features of the text as it is. Very long URLs are read whole.
Repeated rows get equal verdicts. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import cut
from precis.llm.page_diff import host_of, path_of

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FIT_URLS = 20_000
HOT_SUFFIXES = 20_000
SALTS = 32
TREES = 20
DEPTH = 4
PRIOR_WEIGHT = 20.0
FEATURES = ("length", "host length", "path length", "depth", "labels of host", "digit share", "letter share", "entropy",
            "parameters", "separators of host", "digits of host", "longest label", "fragment", "share blocked by last label",
            "share blocked by last two labels")


def rule_of(host, path, rules=RULES):
    """(rule, verdict) columns of the longest rule that fits, else null."""
    chain = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        chain.append((fits, rule, verdict))
    rule_col, verdict_col = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fits, rule, verdict in reversed(chain):
        rule_col = F.when(fits, F.lit(rule)).otherwise(rule_col)
        verdict_col = F.when(fits, F.lit(verdict)).otherwise(verdict_col)
    return rule_col, verdict_col


def features(url: str | None, host: str, path: str, share_last: float, share_two: float) -> list[float]:
    url = url or ""
    n = len(url)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values()) if n else 0.0
    query = url.partition("?")[2].partition("#")[0]
    return [float(n), float(len(host)), float(len(path)), float(path.count("/")), float(host.count(".") + bool(host)),
            sum(map(str.isdigit, url)) / max(n, 1), sum(map(str.isalpha, url)) / max(n, 1), entropy,
            float(query.count("&") + bool(query)), float(host.count("-") + host.count("_")), float(sum(map(str.isdigit, host))),
            float(max(map(len, host.split(".")))), float("#" in url), share_last, share_two]


def suffix_of(labels: int):
    """The last labels of the host, without its port."""
    return F.substring_index(F.regexp_replace("host", ":[0-9]*$", ""), ".", -labels)


def with_shares(rows: DataFrame, shares: DataFrame, n_shares: int, prior: float) -> DataFrame:
    """``rows`` with share_last and share_two: of the host's last label and last two labels in ``shares(suffix, n, share)``."""
    hot = shares if n_shares <= HOT_SUFFIXES else cut(shares.orderBy(F.desc("n"), "suffix").limit(HOT_SUFFIXES))
    rest = None if n_shares <= HOT_SUFFIXES else (
        shares.join(hot.select("suffix"), "suffix", "left_anti").select("suffix", F.col("share").alias("rest"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    for labels, name in ((1, "share_last"), (2, "share_two")):
        rows = rows.withColumn("suffix", suffix_of(labels))
        rows = rows.join(F.broadcast(hot.select("suffix", F.col("share").alias(name))), "suffix", "left")
        if rest is not None:
            salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
            rows = (rows.withColumn("salt", salt).join(rest, ["suffix", "salt"], "left")
                    .withColumn(name, F.coalesce(name, "rest")).drop("rest", "salt"))
        rows = rows.withColumn(name, F.coalesce(name, F.lit(prior))).drop("suffix")
    return rows


def judge(pages: DataFrame, rules=RULES, seed: int = 42) -> DataFrame:
    """Per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": ruled})
    labelled = rows.where("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    whole = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")).first()
    if whole.blocked in (0.0, float(whole.n)):                       # one label only, or none
        default = "block" if whole.n and whole.blocked else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))

    prior = whole.blocked / whole.n
    counted = (labelled.select(F.explode(F.array_distinct(F.array(suffix_of(1), suffix_of(2)))).alias("suffix"), "label")
               .groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("blocked")))
    shares = cut(counted.select("suffix", "n", ((F.col("blocked") + PRIOR_WEIGHT * prior) / (F.col("n") + PRIOR_WEIGHT)).alias("share")))
    n_shares = shares.count()

    @F.arrow_udf("array<double>")
    def lexical(url: pa.Array, host: pa.Array, path: pa.Array, share_last: pa.Array, share_two: pa.Array) -> pa.Array:
        return pa.array([features(*r) for r in zip(url.to_pylist(), host.to_pylist(), path.to_pylist(), share_last.to_pylist(),
                                                   share_two.to_pylist())], pa.list_(pa.float64()))

    vector = array_to_vector(lexical("url", "host", "path", "share_last", "share_two")).alias("features")
    sample = cut(labelled.orderBy(F.xxhash64(F.lit(seed), "url", "page_id"), "page_id").limit(FIT_URLS)
                 .select("page_id", "url", "host", "path", "label"))
    fit = cut(with_shares(sample, shares, n_shares, prior).coalesce(1)
              .sortWithinPartitions(F.xxhash64(F.lit(seed), "url", "page_id"), "page_id").select(vector, "label"))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=seed).fit(fit)
    judged = model.transform(with_shares(rows, shares, n_shares, prior).select("page_id", "host", "path", "rule", "ruled", vector))
    learned = F.when(F.col("prediction") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"))
