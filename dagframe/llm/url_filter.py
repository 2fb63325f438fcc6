"""URL filters: longest-match allow and block rules, and boosted trees for what no rule fits.

The trees look at the URL's letters alone: lengths, depth, digit and mark ratios, entropy,
parameter counts and statistics of the host's suffixes, its first label and the path's first
directory: the share of their labelled URLs that is blocked, shrunk towards none, so that a part
without labelled URLs is no reason to block. Labelled URLs are those that a rule decides,
or any table of URLs with labels. The trees are fitted to a bounded sample of distinct labelled
URLs, chosen by hash; everything else covers all rows. DataFrame functions and Spark's tree
learner only.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule fits it
and the trees judge it by the URL's text (null: empty); with no labelled URLs the verdict is
``allow``, with a single class that class; a URL of any length is read whole; null keys and repeated
rows come back as often as they occur; an empty table
gives an empty table; only the key and URL columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagframe.llm.common import Scratch, attach, table

#: (verdict, host and path); a rule fits its host and subdomains where the path starts with the rule's.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Labelled URLs that the trees are fitted to, at most about.
SAMPLE = 20_000
TREES, DEPTH, SEED = 20, 4, 7
#: Labelled URLs that count as allowed beside each part's own.
PRIOR = 5.0
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("f_length", "f_host", "f_path", "f_labels", "f_depth", "f_digits", "f_host_digits", "f_marks", "f_entropy", "f_params", "f_query", "f_longest_label", "f_extension", "f_suffix_rate", "f_domain_rate", "f_lead_rate", "f_segment_rate")
#: Parts of a URL whose labelled URLs are counted: the host's last label, its last two, its first, and the path's first directory.
COUNTED = ("suffix", "domain", "lead", "segment")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Of a URL; both empty without ``://``. The host's A-Z is lower-cased."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. The rules are a list in the code, so they are tried one by one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_features(df: DataFrame) -> DataFrame:
    """Add the lexical features of columns url, host and path, and the parts of COUNTED."""
    url = F.lower(F.coalesce("url", F.lit("")))
    size = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    counts = F.transform(F.array(*[F.lit(c) for c in ALPHABET]), lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, n: a + F.when(n > 0, n / size * F.log2(size / n)).otherwise(0.0))
    return df.withColumns({
        "f_length": F.length(url),
        "f_host": F.length("host"),
        "f_path": F.length("path"),
        "f_labels": F.size(labels),
        "f_depth": _count(F.col("path"), "/"),
        "f_digits": _count(url, "[0-9]") / size,
        "f_host_digits": _count(F.col("host"), "[0-9]"),
        "f_marks": _count(url, "[^a-z0-9]") / size,
        "f_entropy": entropy,
        "f_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "f_query": F.length(query),
        "f_longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))),
        "f_extension": F.length(F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)$", 1)),
        "suffix": F.element_at(labels, -1),
        "lead": labels[0],
        "segment": F.regexp_extract("path", "^/([^/]*)/", 1),
        "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
    })


class UrlModel:
    """Boosted trees and the statistics of URL parts that they were fitted with, whose sizes in bytes were counted."""

    def __init__(self, rates: dict[str, DataFrame], sizes: dict[str, int], trees, constant: str):
        self.rates, self.sizes, self.trees, self.constant = rates, sizes, trees, constant

    def verdicts(self, df: DataFrame) -> DataFrame:
        """Add model_block (probability) and model_verdict to a table with url, host and path."""
        if self.trees is None:
            return df.withColumns({"model_block": F.lit(1.0 if self.constant == "block" else 0.0), "model_verdict": F.lit(self.constant)})
        scored = self.trees.transform(_assembled(df, self.rates, self.sizes))
        block = vector_to_array("probability")[1]
        return scored.withColumns({"model_block": block, "model_verdict": F.when(block > 0.5, "block").otherwise("allow")}).select(*df.columns, "model_block", "model_verdict")


def _assembled(df: DataFrame, rates: dict[str, DataFrame], sizes: dict[str, int]) -> DataFrame:
    out = with_features(df)
    for part in COUNTED:
        out = attach(out, rates[part], [part], sizes[part])
    out = out.fillna(0.0, [f"f_{part}_rate" for part in COUNTED])
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(out)


def _rates(labelled: DataFrame, by: str, name: str) -> DataFrame:
    n, blocked = F.count(F.lit(1)), F.sum("label")
    return labelled.groupBy(by).agg((blocked / (n + PRIOR)).alias(f"f_{name}_rate"))


def _bytes(rates: DataFrame, part: str) -> int:
    return rates.agg(F.coalesce(F.sum(F.octet_length(part) + 64), F.lit(0))).first()[0]


def fit_url_model(labelled: DataFrame, scratch: Scratch, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> UrlModel:
    """labelled has url, host, path and label (1.0: block). The statistics cover all its distinct URLs; the trees are fitted to about ``sample`` of them, chosen by hash."""
    whole = scratch.save(with_features(labelled.dropDuplicates(["url"])).select("url", "host", "path", "label", *COUNTED), "labelled")
    share = max(1, min(1_000_000, 1_000_000 * sample // max(whole.count(), 1)))
    chosen = whole.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < share).select("url", "host", "path", "label")
    chosen = scratch.save(chosen.coalesce(4), "sample")
    classes = {r.label: r.n for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        return UrlModel({}, {}, None, "block" if 1.0 in classes else "allow")
    rates = {part: scratch.save(_rates(whole, part, part), part) for part in COUNTED}
    sizes = {part: _bytes(rates[part], part) for part in COUNTED}
    scratch.only(*COUNTED, "sample")
    features = scratch.save(_assembled(chosen, rates, sizes).select("features", "label").coalesce(4), "features")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label").fit(features)
    scratch.only(*COUNTED)
    return UrlModel(rates, sizes, model, "allow")


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str]] = RULES, sample: int = SAMPLE) -> DataFrame:
    """key, host, path, rule, verdict and model_block (the trees' probability), one row per input row."""
    scratch = Scratch(pages.sparkSession, "urls")
    own = pages.select(F.col(key).alias("id"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    own = own.withColumns({"host": host, "path": path}).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    labelled = own.where("fit is not null").select("url", "host", "path", (F.col("fit.verdict") == "block").cast("double").alias("label"))
    judged = fit_url_model(labelled, scratch, sample).verdicts(own)
    return judged.select(F.col("id").alias(key), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "model_verdict").alias("verdict"), "model_block")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return filter_urls(table(spark, sf_dir, "pages")).drop("model_block")
