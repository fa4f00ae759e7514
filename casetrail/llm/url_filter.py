"""URL filter: host rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = (
    "url_length host_length path_length query_length depth digit_ratio entropy n_params n_hyphens "
    "n_labels longest_word has_fragment suffix_pages suffix_hosts suffix_depth"
).split()


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with all its subdomains, under a path prefix."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(rules: list[Rule], part) -> Column:
    """``part`` of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    host, path = F.col("host"), F.col("path")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        own = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        found = F.when(own & F.startswith(path, F.lit(rule.path)), F.lit(part(rule))).otherwise(found)
    return found


def with_features(pages: DataFrame) -> DataFrame:
    """Add the lexical features of ``url``, ``host`` and ``path``. Suffix statistics are counts
    over all pages: pages, hosts and mean depth of the last two labels of a host."""
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(url, ""))
    share = F.transform(chars, lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size)
    entropy = F.aggregate(
        F.filter(share, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p)
    )
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda of, what: (F.length(of) - F.length(F.replace(of, F.lit(what), F.lit("")))).cast("double")
    words = F.transform(F.split(url, "[^A-Za-z0-9]+"), lambda w: F.length(w))
    shaped = pages.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "query_length": F.length(query).cast("double"),
            "depth": count(F.col("path"), "/"),
            "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / size,
            "entropy": entropy,
            "n_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
            "n_hyphens": count(url, "-"),
            "n_labels": count(F.col("host"), ".") + 1,
            "longest_word": F.coalesce(F.array_max(words), F.lit(0)).cast("double"),
            "has_fragment": F.contains(url, F.lit("#")).cast("double"),
            "suffix": F.array_join(F.slice(F.reverse(F.split("host", r"\.")), 1, 2), "."),
        }
    )
    hosts = shaped.groupBy("suffix", "host").agg(F.count("*").alias("n"), F.sum("depth").alias("d"))
    statistics = hosts.groupBy("suffix").agg(
        F.log1p(F.sum("n")).alias("suffix_pages"),
        F.log1p(F.count("*")).alias("suffix_hosts"),
        (F.sum("d") / F.sum("n")).alias("suffix_depth"),
    )
    return shaped.join(statistics, "suffix")


def train(labelled: DataFrame, per_label: int, trees: int, depth: int):
    """Boosted trees on a bounded sample of each label, chosen by hash; none for one label only."""
    order = Window.partitionBy("label").orderBy(F.xxhash64("url"), "url")
    picked = (
        labelled.select("url", "label", *FEATURES)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= per_label)
        .drop("place")
        .coalesce(8)  # a bounded sample: the many short jobs of the trees need few tasks
        .persist()
    )
    try:
        if picked.select("label").distinct().count() < 2:
            return None
        stages = [
            VectorAssembler(inputCols=FEATURES, outputCol="features"),
            GBTClassifier(
                labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, seed=17
            ),
        ]
        return Pipeline(stages=stages).fit(picked)
    finally:
        picked.unpersist()


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    per_label: int = 20_000,
    trees: int = 20,
    depth: int = 4,
    threshold: float = 0.5,
) -> DataFrame:
    """Judge every URL.

    One row per row of ``pages``: ``page_id, host, path, rule`` (the longest rule that fits, else
    null), ``score`` (the trees' probability of ``block``; null where they were not trained) and
    ``verdict`` (``allow`` or ``block``: the rule's, else the trees').

    The URLs that a rule decides are the labelled ones. At most ``per_label`` of each verdict,
    chosen by hash, train the trees; the features' suffix statistics count all pages.

    Null URLs and those without ``://`` have an empty host and path, fit no rule and go to the
    trees. If the labelled URLs have one verdict only, or there are none, pages without a rule are
    allowed. Repeated rows are judged one by one. Only the named columns are read.
    """
    source = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"))
    host, path = host_and_path(F.col("url"))
    source = source.select("page_id", "url", host.alias("host"), path.alias("path"))
    source = source.withColumns(
        {"rule": best_rule(rules, lambda r: r.name), "ruled": best_rule(rules, lambda r: r.verdict)}
    )
    shaped = with_features(source)
    labelled = shaped.filter("ruled IS NOT NULL").withColumn(
        "label", (F.col("ruled") == "block").cast("double")
    )
    model = train(labelled, per_label, trees, depth)
    if model is None:
        scored = source.withColumn("score", F.lit(None).cast("double"))
    else:
        scored = model.transform(shaped).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", "score", F.coalesce("ruled", own).alias("verdict")
    )
