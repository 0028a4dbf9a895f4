"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Features are computed by Spark expressions, trees are scored in Arrow batches; only the
fit, on a bounded sample of labelled urls, is numpy on the driver.

Features: lengths of url, host and path; depth (path segments), number of host labels,
digit ratio, character entropy of the host, hyphens, number of query parameters, length
of the longest host label, ``https``, and suffix statistics: the smoothed share of
blocked urls among labelled ones with the same last host label, and with the same last
path suffix (the letters after the last dot); for a labelled url its own row is left out.

Defined results: a null url, or one without ``://``, has empty host and path; no rule
fits it and it is judged by the trees on its features. Without labelled urls of both
kinds every judgement is the kind there is (none: allow). Repeated rows get equal rows;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, semi

#: fixed values: rules of the filter, (host and path prefix, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "hyphens", "parameters", "longest_label", "https", "suffix_stat", "ending_stat")
#: most labelled urls that a fit reads
FIT_ROWS = 20_000
SMOOTHING = 20.0


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: str | Column = "url") -> tuple[Column, Column]:
    """(host, path); both empty without ``://``. A newline is a character like others."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(after, r"^([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: len(r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host, path, suffix, ending and the lexical features that need no labels."""
    host, path = url_parts(url)
    df = df.withColumns({"host": host, "path": path})
    h, p, u = F.col("host"), F.col("path"), F.coalesce(F.col(url), F.lit(""))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    n = F.length(h)
    #: entropy by removing one character after another from the host: at most 40 kinds
    letters = F.array_distinct(F.filter(F.split(h, ""), lambda c: c != ""))
    share = lambda c: (n - F.length(F.replace(h, c, F.lit("")))) / n
    entropy = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return df.withColumns({
        "suffix": F.substring_index(h, ".", -1),
        "ending": F.regexp_extract(p, r"\.([A-Za-z]+)$", 1),
        "url_length": F.length(u).cast("double"), "host_length": n.cast("double"), "path_length": F.length(p).cast("double"),
        "depth": F.regexp_count(p, F.lit("/[^/]")).cast("double"), "labels": F.size(F.split(h, r"\.")).cast("double"),
        "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / F.greatest(F.length(u), F.lit(1)), "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "hyphens": F.regexp_count(h, F.lit("-")).cast("double"), "parameters": F.regexp_count(query, F.lit("[^&]+")).cast("double"),
        "longest_label": F.array_max(F.transform(F.split(h, r"\."), F.length)).cast("double"), "https": u.startswith("https:").cast("double"),
    })


def fit_trees(x: np.ndarray, y: np.ndarray, count: np.ndarray | None = None, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, leaf: int = 20, ridge: float = 1.0) -> tuple[float, list[list]]:
    """Gradient-boosted trees for log loss: (bias, trees), a tree being a list of nodes
    (feature, threshold, left, right) or (value,). Histograms over quantile bins; both
    labels weigh alike, so that their shares among the labelled urls don't decide."""
    if not len(y) or y.min() == y.max():
        return (float(np.sign(y.mean() - 0.5) * 4) if len(y) else -4.0), []
    bias = 0.0
    count = np.ones(len(y)) if count is None else count
    share = (y * count).sum() / count.sum()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) * count * len(y) / count.sum()
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    score, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h, tree = weight * (y - p), weight * p * (1 - p), []

        def grow(rows: np.ndarray, left: int) -> int:
            me = len(tree)
            tree.append(None)
            G, H = g[rows].sum(), h[rows].sum()
            best = (1e-9, 0, 0)
            if left and len(rows) >= 2 * leaf:
                for f, c in enumerate(cuts):
                    size = len(c) + 1
                    gl = np.cumsum(np.bincount(code[rows, f], g[rows], size))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, f], h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(code[rows, f], minlength=size))[:-1]
                    gain = gl**2 / (hl + ridge) + (G - gl) ** 2 / (H - hl + ridge) - G**2 / (H + ridge)
                    gain[(nl < leaf) | (len(rows) - nl < leaf)] = -1
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[0] <= 1e-9:
                value = rate * G / (H + ridge)
                score[rows] += value
                tree[me] = (float(value),)
                return me
            _, f, b = best
            low = code[rows, f] <= b
            tree[me] = (f, float(cuts[f][b]), grow(rows[low], left - 1), grow(rows[~low], left - 1))
            return me

        grow(np.arange(len(y)), depth)
        trees.append(tree)
    return bias, trees


def tree_scores(x: np.ndarray, bias: float, trees: list[list]) -> np.ndarray:
    """Probabilities of label 1 for the rows of x."""
    total = np.full(len(x), bias)
    for tree in trees:
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            if len(tree[at]) == 1:
                total[rows] += tree[at][0]
                continue
            f, cut, low, high = tree[at]
            below = x[rows, f] <= cut
            stack += [(low, rows[below]), (high, rows[~below])]
    return 1 / (1 + np.exp(-total))


def _counts(labelled: DataFrame, key: str) -> DataFrame:
    """(key, key_bad, key_good): labelled urls of either kind by key; few rows, one a suffix."""
    return labelled.groupBy(key).agg(F.sum(F.col("y") * F.col("n")).alias(f"{key}_bad"), F.sum((1 - F.col("y")) * F.col("n")).alias(f"{key}_good"))


def _rate(key: str, bad: float, good: float, without: bool) -> Column:
    """Smoothed share of blocked urls at the key, both kinds weighing alike; for a labelled url
    without its own row, so that its label is not among its features."""
    b, g = F.coalesce(f"{key}_bad", F.lit(0.0)), F.coalesce(f"{key}_good", F.lit(0.0))
    if without:
        b, g = b - F.col("y") * F.col("n"), g - (1 - F.col("y")) * F.col("n")
    scale = (bad + good) / 2
    b, g = b * scale / max(bad, 1.0), g * scale / max(good, 1.0)
    return (b + SMOOTHING / 2) / (b + g + SMOOTHING)


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    labelled: (url, y), y 1 for a url to block. By default the urls that the rules judge.
    The fit reads at most FIT_ROWS distinct ones, chosen by a hash of the url; the suffix
    statistics are counted over all labelled urls.
    """
    base = pages.select("page_id", "url")
    if labelled is None:
        host, path = url_parts()
        labelled = base.select("url", F.when(rule_for(host, path, rules)[1] == "block", 1.0).when(rule_for(host, path, rules)[1] == "allow", 0.0).alias("y")).where("y is not null")
    #: a url counts once with each label, however often it occurs, and weighs as often
    distinct = labelled.groupBy("url", "y").agg(F.count("*").cast("double").alias("n"))
    known = materialize(lexical_features(distinct))
    total = known.agg(F.coalesce(F.sum(F.col("y") * F.col("n")), F.lit(0.0)).alias("bad"), F.coalesce(F.sum((1 - F.col("y")) * F.col("n")), F.lit(0.0)).alias("good")).first()
    counts = {k: materialize(_counts(known, k), 1) for k in ("suffix", "ending")}

    def full(df: DataFrame, without: bool) -> DataFrame:
        for key, table in counts.items():
            table = table.withColumnRenamed(key, f"{key}_key")
            df = semi(df, table, F.col(key) == F.col(f"{key}_key"), "left").withColumn(f"{key}_stat", _rate(key, total.bad, total.good, without))
        return df

    sample = full(known.orderBy(F.xxhash64("url"), "url", "y").limit(FIT_ROWS), True).select(*FEATURES, "y", "n").toPandas()  # FIT_ROWS rows
    bias, trees = fit_trees(sample[list(FEATURES)].to_numpy(float), sample["y"].to_numpy(float), sample["n"].to_numpy(float))
    scored = full(lexical_features(base), False)

    @F.pandas_udf("double")
    def score(features: pd.DataFrame) -> pd.Series:
        return pd.Series(tree_scores(features.to_numpy(float), bias, trees))

    scored = scored.withColumn("score", score(F.struct(*FEATURES)))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score")
