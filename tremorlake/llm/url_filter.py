"""URL filters: allow and block rules, then gradient-boosted trees on lexical features of the URL.

DataFrame functions and Spark's own GBT only.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.llm.common import let, salted_join

#: (rule, verdict); a rule is a host, then the beginning of a path.
RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]
#: Rules become one CASE expression, so their number is bounded.
MAX_RULES = 1000
#: The trees are fitted on at most so many distinct labelled URLs, those with the smallest hashes.
MAX_TRAINING_ROWS = 10_000
#: Statistics of more suffixes are joined by salted keys, not broadcast.
MAX_BROADCAST_SUFFIXES = 10_000
TREES, DEPTH = 12, 4
#: Prior weight of the overall block rate in a suffix's block rate.
SUFFIX_PRIOR = 5.0
FEATURES = ["length", "host_length", "depth", "host_depth", "digit_ratio", "entropy", "n_params", "query_length", "n_dashes", "suffix_block_rate", "suffix_log_count"]


def host_path(url: Column) -> Column:
    """Struct of host and path. Null urls and urls without ``://`` give empty strings."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")

    def parts(r: Column) -> Column:
        host = F.regexp_extract(r, r"^[^/?#]*", 0)
        path = F.regexp_extract(F.substring(r, F.length(host) + 1, F.length(r)), r"^[^?#]*", 0)
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return F.struct(F.translate(host, upper, upper.lower()).alias("host"), path.alias("path"))

    return let(F.coalesce(rest, F.lit("")), parts)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a parent domain and begins the path; else null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are applied as one expression")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the text's characters."""
    n = F.length(text)
    chars = F.array_sort(F.split(text, ""))
    # Sorted, a character's count is the run's length: sum of c*log2(c) over runs by distinct characters.
    part = lambda a: F.aggregate(F.array_distinct(a), F.lit(0.0), lambda t, c: t + let(F.size(F.filter(a, lambda x: x == c)).cast("double"), lambda k: k * F.log2(k)))
    return F.when(n > 0, F.log2(n.cast("double")) - let(chars, part) / n).otherwise(0.0)


def suffix(host: Column) -> Column:
    """The host's last label."""
    return F.substring_index(host, ".", -1)


def with_features(urls: DataFrame) -> DataFrame:
    """Adds the lexical features to rows with url, host and path; null urls count as empty."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda c, what: (F.length(c) - F.length(F.replace(c, F.lit(what)))).cast("double")
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    return urls.withColumns(
        {
            "length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "depth": count(F.col("path"), "/"),
            "host_depth": count(F.col("host"), "."),
            "digit_ratio": F.when(F.length(url) > 0, digits / F.length(url)).otherwise(0.0),
            "entropy": _entropy(url),
            "n_params": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
            "query_length": F.length(query).cast("double"),
            "n_dashes": count(url, "-"),
            "suffix": suffix(F.col("host")),
        }
    )


class UrlModel:
    """Trees with the suffix statistics of all labelled rows; without both labels among the
    distinct URLs of the sample, the label of most rows (or allow)."""

    def __init__(self, labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS):
        """``labelled``: url, host, path, label (1 block, 0 allow)."""
        rows = labelled.select("url", "host", "path", F.col("label").cast("double")).dropna(subset=["label"])
        stats = rows.groupBy(suffix(F.col("host")).alias("suffix")).agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).cache()
        n, blocked, self.n_suffixes = stats.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0.0)), F.count("*")).first()
        self.rate = blocked / n if n else 0.0
        rate = (F.col("blocked") + SUFFIX_PRIOR * self.rate) / (F.col("n") + SUFFIX_PRIOR)
        self.suffixes = stats.select("suffix", rate.alias("suffix_block_rate"), F.log1p("n").alias("suffix_log_count"))
        # Each URL once, with the label that most of its rows have, so that copies do not fill the sample.
        urls = rows.groupBy("url", "host", "path").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
        sample = with_features(urls.orderBy(F.xxhash64("url"), "url").limit(max_rows)).cache()
        kinds = sample.agg(F.count_distinct("label")).first()[0]
        self.trees: GBTClassificationModel | None = None
        if kinds == 2:
            rows = self._assembled(sample).select("features", "label").coalesce(4)
            self.trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32).fit(rows)
        sample.unpersist()

    def _assembled(self, urls: DataFrame) -> DataFrame:
        if self.n_suffixes <= MAX_BROADCAST_SUFFIXES:
            known = urls.join(F.broadcast(self.suffixes), "suffix", "left")
        else:
            known = salted_join(urls, self.suffixes, ["suffix"], F.struct(*urls.columns), how="left")
        known = known.fillna({"suffix_block_rate": self.rate, "suffix_log_count": 0.0})
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(known)

    def blocked(self, urls: DataFrame) -> DataFrame:
        """Adds method_verdict to rows with url, host and path."""
        if self.trees is None:
            return urls.withColumn("method_verdict", F.lit("block" if self.rate > 0.5 else "allow"))
        scored = self.trees.transform(self._assembled(with_features(urls)))
        verdict = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
        return scored.withColumn("method_verdict", verdict).select(*urls.columns, "method_verdict")


def held_out_scores(labelled: DataFrame) -> DataFrame:
    """One row: n, accuracy, share of the more frequent label, blocked and caught, over the held-out fifth of distinct
    URLs (by crc32), after training on the others. ``labelled``: url, label (1 block, 0 allow)."""
    rows = labelled.select("url", host_path(F.col("url")).alias("p"), F.col("label").cast("double").alias("label")).select("url", "p.host", "p.path", "label").dropna(subset=["url", "label"])
    out = F.crc32(F.encode("url", "utf-8")) % 5 == 0
    tested = rows.where(out).groupBy("url", "host", "path").agg((F.avg("label") >= 0.5).alias("blocked"))
    judged = UrlModel(rows.where(~out)).blocked(tested).withColumn("caught", F.col("method_verdict") == "block")
    right = F.avg((F.col("blocked") == F.col("caught")).cast("double"))
    share = F.avg(F.col("blocked").cast("double"))
    return judged.agg(F.count("*").alias("n"), right.alias("accuracy"), F.greatest(share, 1 - share).alias("majority"), F.count_if("blocked").alias("blocked"), F.count_if(F.col("blocked") & F.col("caught")).alias("caught"))


def ruled(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """url, label of the rows that a rule decides: the labelled URLs where no others are given."""
    parsed = pages.select("url", host_path(F.col("url")).alias("p"))
    return parsed.select("url", rule_of(F.col("p.host"), F.col("p.path"), rules)["verdict"].alias("v")).where("v IS NOT NULL").select("url", (F.col("v") == "block").cast("double").alias("label"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Verdict of every row of ``pages`` (page_id, url; other columns are ignored).

    ``labelled`` (url, label with 1 for block) trains the trees; without it, the URLs that a rule decides do, and the
    trees carry the rules' verdicts over to URLs of like form. Other columns are ignored. Very long urls are read whole.
    Null urls, and urls without ``://``, have an empty host and path and are judged by the trees. Repeated rows
    repeat the verdict. An empty table gives an empty result; labels of one kind only give that verdict.
    """
    parsed = pages.select("page_id", "url", host_path(F.col("url")).alias("p")).select("page_id", "url", "p.host", "p.path")
    ruled = parsed.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "r.rule", F.col("r.verdict").alias("rule_verdict"))
    if labelled is None:
        known = ruled.where("rule IS NOT NULL").select("url", "host", "path", (F.col("rule_verdict") == "block").cast("double").alias("label"))
    else:
        known = labelled.select("url", host_path(F.col("url")).alias("p"), "label").select("url", "p.host", "p.path", "label")
    judged = UrlModel(known).blocked(ruled)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "method_verdict").alias("verdict"))
