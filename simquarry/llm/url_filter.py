"""URL filtering with DataFrame functions and Spark ML: rules first, boosted trees for the rest.

URLs that a rule covers are the labelled ones. Gradient-boosted trees learn from their lexical
features (length, depth, digit ratio, entropy, parameter counts, suffix statistics) and judge
the URLs that no rule covers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, without

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled URLs that train the trees, at most (about: the sample is by hash). Also bounds the
#: suffix table that is broadcast.
TRAIN_ROWS = 20_000
FEATURES = ("f_len", "f_host_len", "f_path_len", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_query_len", "f_marks", "f_hyphens", "f_secure", "f_fragment", "f_suffix", "f_suffix2")
#: Folds of the training URLs, and the suffixes with their features.
FOLDS = 5
_SUFFIXES = (("s1", "f_suffix"), ("s2", "f_suffix2"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first "://" up to "/", "?", "#" or the end, A-Z
    lowered; the path from there up to "?", "#" or the end. Null or no "://": both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule host/path fits its host
    and all subdomains where the URL's path starts with the rule's path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame, url: Column, host: Column, path: Column) -> DataFrame:
    """`df` with the lexical features of a URL, but for the suffix statistics."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    tail = F.regexp_extract(u, r"\?([^#]*)", 1)
    # Shannon entropy of the characters: - sum p log2 p over the distinct ones.
    shares = F.transform(F.array_distinct(F.split(u, "")), lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return df.withColumns({
        "f_len": F.length(u).cast("double"), "f_host_len": F.length(host).cast("double"), "f_path_len": F.length(path).cast("double"),
        "f_depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "f_labels": F.size(F.split(host, r"\.")).cast("double"),
        "f_digits": F.regexp_count(u, F.lit("[0-9]")) / n, "f_entropy": entropy,
        "f_params": F.when(tail == "", 0).otherwise(F.size(F.split(tail, "[&;]"))).cast("double"),
        "f_query_len": F.length(tail).cast("double"), "f_marks": F.regexp_count(u, F.lit("[^0-9A-Za-z]")) / n,
        "f_hyphens": F.regexp_count(u, F.lit("[-_%]")).cast("double"), "f_secure": u.startswith("https:").cast("double"),
        "f_fragment": u.contains("#").cast("double"),
    })


class Filter:
    """The trees that judge URLs without a rule, with the suffix statistics they read.

    A suffix's statistic is its smoothed share of blocked training URLs. For the training URLs
    themselves it is taken out of fold (from the other FOLDS - 1 folds), so the trees don't see a
    URL's own label in its features."""

    def __init__(self, train: DataFrame, prior: float, seed: int):
        self.prior, self.stats = prior, []
        folded = train.withColumn("fold", F.pmod(F.xxhash64("u", F.lit(seed + 1)), F.lit(FOLDS)).cast("int"))
        for k, f in _SUFFIXES:
            each = materialise(folded.groupBy(k, "fold").agg(F.sum("label").alias("bad"), F.count("*").alias("n")), "url-folds")
            total = each.groupBy(F.col(k).alias(f"k_{k}")).agg(F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"))
            share = lambda bad, n: (bad + 5 * prior) / (n + 5)
            self.stats.append(materialise(total.select(f"k_{k}", share(F.col("all_bad"), F.col("all_n")).alias(f)), "url-suffix"))
            own = each.join(total, F.col(k) == F.col(f"k_{k}")).select(f"k_{k}", F.col("fold").alias("of_fold"), share(F.col("all_bad") - F.col("bad"), F.col("all_n") - F.col("n")).alias(f))
            # At most one short row for each training URL: a bounded broadcast.
            folded = folded.join(F.broadcast(own), (F.col(k) == F.col(f"k_{k}")) & (F.col("fold") == F.col("of_fold"))).drop(f"k_{k}", "of_fold")
        # One bounded partition, so that sums, and with them the trees, do not depend on task order.
        rows = _assembled(folded).select("v", "label", "u").coalesce(1).sortWithinPartitions("u").select("v", "label")
        self.model = GBTClassifier(featuresCol="v", labelCol="label", maxIter=12, maxDepth=4, maxBins=32, stepSize=0.2, seed=seed).fit(rows)

    def score(self, df: DataFrame) -> DataFrame:
        """`df` with `score`, the probability of "block"."""
        for own, (k, f) in zip(self.stats, _SUFFIXES, strict=True):
            # At most one short row for each training URL: a bounded broadcast.
            df = df.join(F.broadcast(own), F.col(k) == F.col(f"k_{k}"), "left").drop(f"k_{k}").withColumn(f, F.coalesce(f, F.lit(self.prior)))
        return self.model.transform(_assembled(df)).withColumn("score", vector_to_array("probability")[1])


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="v").transform(df)


def described(pages: DataFrame, rules: Sequence[tuple[str, str]], url_col: str = "url") -> DataFrame:
    """r (the page's columns), u (its URL), host, path, rule, ruled (a rule's verdict), the suffixes
    and the lexical features."""
    raw = F.col(f"`{url_col}`").cast("string")
    host, path = split_url(raw)
    keyed = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("r"), raw.alias("u"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    keyed = keyed.withColumns({"rule": rule, "ruled": verdict})
    suffix = lambda k: F.substring_index("host", ".", -k)
    return lexical(keyed, F.col("u"), F.col("host"), F.col("path")).withColumns({"s1": suffix(1), "s2": suffix(2)})


def train_filter(full: DataFrame, counts: dict[str, int], train_rows: int = TRAIN_ROWS, seed: int = 3) -> Filter:
    """The trees, from at most about `train_rows` of the URLs that a rule covers."""
    total = sum(counts.values())
    # A sample by hash keeps the same rows under any partitioning.
    cut = int(min(1.0, train_rows / total) * 2**62)
    sample = full.where(F.col("ruled").isNotNull() & (F.shiftrightunsigned(F.xxhash64("u", F.lit(seed)), 2) < F.lit(cut)))
    train = materialise(sample.select("s1", "s2", "u", (F.col("ruled") == "block").cast("double").alias("label"), *FEATURES[:-2]).distinct(), "url-train")
    return Filter(train, counts.get("block", 0) / total, seed)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, train_rows: int = TRAIN_ROWS, url_col: str = "url", seed: int = 3) -> DataFrame:
    """`pages` with host, path, rule (null where none fits), score (the trees' probability
    of "block"; null where a rule decides) and verdict.

    Null and malformed URLs have an empty host and path and are judged by the trees. Where no
    rule covers any URL the verdict is "allow"; where all covered ones agree it is theirs. A score
    of exactly a half allows. Input columns with the names of the added ones are replaced."""
    pages = without(pages, "host", "path", "rule", "score", "verdict")
    full = described(pages, rules, url_col)
    counts = {r["ruled"]: r["count"] for r in full.where("ruled is not null").groupBy("ruled").count().collect()}
    if len(counts) < 2:
        only = next(iter(counts), "allow")
        return full.select("r.*", "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.coalesce("ruled", F.lit(only)).alias("verdict"))
    trees = train_filter(full, counts, train_rows, seed)
    # Only URLs that no rule covers go through the trees.
    ruled = full.where("ruled is not null").select("r.*", "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.col("ruled").alias("verdict"))
    free = trees.score(full.where("ruled is null"))
    free = free.select("r.*", "host", "path", "rule", "score", F.when(F.col("score") > 0.5, "block").otherwise("allow").alias("verdict"))
    return ruled.unionByName(free)
