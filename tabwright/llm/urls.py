"""URL filter: rules by host and path, and gradient-boosted trees on lexical features
for the URLs that no rule fits, trained from the URLs that a rule labels.

Null URLs and those without "://" have an empty host and path; no rule fits them, and
the trees judge their features like any other's. A rule's host fits itself and its
subdomains; its path is a beginning of the URL's. Without labelled URLs of both kinds
everything is allowed that no rule blocks. Repeated rows are rows of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import FIT_ROWS, saved

#: Rule and verdict.
RULES = {
    "net/": "block",
    "example.net/en/": "allow",
    "example.com/de/": "block",
    "org/fr/": "allow",
}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Labelled URLs that a statistic of a suffix or folder must rest on.
SUPPORT = 5
LEXICAL = (
    "url_length",
    "host_length",
    "host_labels",
    "depth",
    "digit_ratio",
    "host_digits",
    "hyphens",
    "entropy",
    "parameters",
    "secure",
    "suffix_blocked",
    "folder_blocked",
)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """The frame with ``host`` and ``path``."""
    text = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(text, _PARTS, 1), _UPPER, _UPPER.lower()),
            "path": F.regexp_extract(text, _PARTS, 2),
        }
    )


def rule_of(rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col(
            "path"
        ).startswith(f"/{path}")
        name = F.when(fits, rule).otherwise(name)
        verdict = F.when(fits, rules[rule]).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    chars = F.array_distinct(F.array_remove(F.split(text, ""), ""))
    return F.aggregate(chars, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))


def with_features(pages: DataFrame, url: str = "url") -> DataFrame:
    """The frame (with host and path) with the lexical features, but the statistics."""
    text = F.coalesce(F.col(url), F.lit(""))
    digits = F.length(F.regexp_replace(text, "[^0-9]+", ""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    size = F.greatest(F.length(text), F.lit(1))
    return pages.withColumns(
        {
            "suffix": F.regexp_extract("host", r"([^.]*)$", 1),
            "folder": F.regexp_extract("path", r"^/([^/]*)/", 1),
            "url_length": F.length(text).cast("double"),
            "host_length": F.length("host").cast("double"),
            "host_labels": F.size(F.split("host", r"\.")).cast("double"),
            "depth": F.size(F.array_remove(F.split("path", "/"), "")).cast("double"),
            "digit_ratio": digits / size,
            "host_digits": F.length(F.regexp_replace("host", "[^0-9]+", "")).cast("double"),
            "hyphens": F.length(F.regexp_replace("host", "[^-]+", "")).cast("double"),
            "entropy": F.coalesce(entropy(text), F.lit(0.0)),
            "parameters": F.size(F.array_remove(F.split(query, "&"), "")).cast("double"),
            "secure": text.startswith("https:").cast("double"),
        }
    )


@dataclass(frozen=True)
class UrlModel:
    """Trees, and the smoothed share of blocked URLs by suffix and by first folder;
    both tables come from the bounded sample, so they are small."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    folders: DataFrame | None
    prior: float

    def with_statistics(self, pages: DataFrame) -> DataFrame:
        joined = pages.join(F.broadcast(self.suffixes), "suffix", "left").join(
            F.broadcast(self.folders), "folder", "left"
        )
        return joined.fillna(self.prior, ["suffix_blocked", "folder_blocked"])


def _shares(rows: DataFrame, by: str, prior: float) -> DataFrame:
    share = (F.sum("label") + 2 * prior) / (F.count(F.lit(1)) + 2)
    return saved(
        rows.groupBy(by)
        .agg(share.alias(f"{by}_blocked"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= SUPPORT)
        .select(by, f"{by}_blocked"),
        by,
    )


def _assembled(pages: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(LEXICAL), outputCol="features").transform(pages)


def train(labelled: DataFrame, bound: int = FIT_ROWS) -> UrlModel:
    """From (page_id, url, host, path, label), label 1 for blocked: at most ``bound``
    rows in the order of a seeded hash."""
    sample = labelled.orderBy(F.xxhash64(F.lit(5), "page_id", "url"), "page_id", "url").limit(bound)
    rows = saved(with_features(sample.where("label is not null")), "url_sample")
    n, mean = rows.agg(F.count(F.lit(1)), F.avg("label")).first()
    if not n or mean in (0.0, 1.0):
        return UrlModel(None, None, None, 0.0)
    bare = UrlModel(None, _shares(rows, "suffix", mean), _shares(rows, "folder", mean), mean)
    training = saved(
        _assembled(bare.with_statistics(rows))
        .select("features", F.col("label").cast("double").alias("label"))
        .repartition(4),
        "url_features",
    )
    trees = GBTClassifier(maxIter=15, maxDepth=4, seed=7).fit(training)
    return UrlModel(trees, bare.suffixes, bare.folders, mean)


def with_probability(pages: DataFrame, model: UrlModel) -> DataFrame:
    """The frame with ``p_block``; zero without a model."""
    if model.trees is None:
        return pages.withColumn("p_block", F.lit(0.0))
    ready = _assembled(model.with_statistics(with_features(pages)))
    scored = model.trees.transform(ready)
    return scored.withColumn("p_block", vector_to_array("probability")[1])


def judged(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) of every page."""
    rule, ruled = rule_of(rules)
    parts = with_parts(pages.select("page_id", "url")).withColumns({"rule": rule, "ruled": ruled})
    labelled = parts.where("rule is not null").withColumn(
        "label", (F.col("ruled") == "block").cast("int")
    )
    scored = with_probability(parts, train(labelled))
    own = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "p_block"
    )
