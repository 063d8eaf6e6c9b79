"""URL filters by association rules.

Fixed host and path rules decide first, and teach: each URL that they judge is a labelled basket of
its tokens (host labels and suffixes, path segments, query keys), beside URLs that have a label of
their own. FP-growth mines token combinations that go with a block label. Rules under a minimum
support, confidence or lift over the share of blocked baskets are dropped, and so are rules that
contain a smaller one unless they are surer by a minimum gain. Each kept rule is indexed by its rarest token; a
URL meets only the rules indexed by one of its tokens, and must hold all of a rule's tokens. Of the
rules that a URL holds, the surest decides (then the one of more support, then the first by tokens).

Defined cases: null url or one without `://`: empty host and path, no tokens, allow. No labels,
or no rule over the bounds: allow wherever no fixed rule fits. Labels of one url that differ are
labels each. Rows that repeat get equal verdicts. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table, written

# Fixed values of the contract: (verdict, rule).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
BAD, GOOD = "label=block", "label=allow"
#: Rules this many at most are broadcast; more are shuffled.
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest fixed rule that fits, else null."""
    out = None
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at = rule.index("/")
        own, start = rule[:at], rule[at:]
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out


def verdict_of(rule: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for v, r in rules for x in (r, v)]), rule)


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url: its host's labels and suffixes, path segments, query keys. Bare numbers are left out."""
    host, path = F.split(host_of(url), r"\."), F.split(path_of(url), "/")
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), "&")
    labels = F.transform(host, lambda x: F.concat(F.lit("h:"), x))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(host)), lambda i: F.concat(F.lit("s:"), F.array_join(F.slice(host, i, F.size(host)), ".")))
    segments = F.transform(F.filter(path, lambda x: ~x.rlike(r"^\d*(\.\w+)?$")), lambda x: F.concat(F.lit("p:"), x))
    keys = F.transform(F.filter(query, lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.when(host_of(url) != "", F.array_distinct(F.concat(labels, suffixes, segments, keys))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float = 2.0, min_gain: float = 0.05) -> DataFrame:
    """rule_tokens, confidence, support of the rules for blocking; labelled has tokens and bad."""
    baskets = labelled.filter(F.size("tokens") > 0).select(F.array_append("tokens", F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD))).alias("items"))
    if not baskets.head(1):
        return labelled.sparkSession.createDataFrame([], "rule_tokens array<string>, confidence double, support double")
    rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    rules = rules.filter((F.element_at("consequent", 1) == BAD) & (F.col("lift") >= min_lift)).select(F.array_sort("antecedent").alias("rule_tokens"), "confidence", "support")
    # A rule goes if one that lacks some of its tokens is as sure but for the gain: it is found by the rules' own tokens, not by comparing all with all.
    a = rules.select("rule_tokens", "confidence", F.explode("rule_tokens").alias("t"))
    b = rules.select(F.col("rule_tokens").alias("small"), F.col("confidence").alias("small_c"), F.element_at("rule_tokens", 1).alias("t"))
    covered = a.join(b, "t").filter((F.size("small") < F.size("rule_tokens")) & (F.size(F.array_except("small", "rule_tokens")) == 0) & (F.col("small_c") > F.col("confidence") - min_gain))
    return rules.join(covered.select("rule_tokens").distinct(), "rule_tokens", "left_anti")


def matched(urls: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Of urls (url, tokens), those that hold all tokens of a rule, with the surest rule and its confidence."""
    rarest = F.min_by("t", F.struct("n", "t"))
    index = rules.select("rule_tokens", "confidence", "support", F.explode("rule_tokens").alias("t")).join(counts, "t").groupBy("rule_tokens", "confidence", "support").agg(rarest.alias("t"))
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    met = urls.select("url", "tokens", F.explode("tokens").alias("t")).join(index, "t").filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = F.min_by(F.struct("rule_tokens", "confidence"), F.struct(-F.col("confidence"), -F.col("support"), F.col("rule_tokens")))
    return met.groupBy("url").agg(best.alias("b")).select("url", F.col("b.rule_tokens").alias("mined"), "b.confidence")


def judge(pages: DataFrame, labels: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, closed: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict, and mined (the tokens of the mined rule that blocks) and its confidence, of
    pages (page_id, url); labels (page_id, bad) teach beside the fixed rules. If closed, URLs without rule and label
    teach as allowed ones, so that a rule must hold against all URLs."""
    url = F.col("url")
    out = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("rule", fixed_rule(F.col("host"), F.col("path")))
    ruled = out.filter("rule IS NOT NULL").select("url", (verdict_of(F.col("rule")) == "block").alias("bad"))
    own = out.filter("rule IS NULL").select("page_id", "url").join(labels.select("page_id", "bad"), "page_id", "left")
    own = own.select("url", F.coalesce("bad", F.lit(False)).alias("bad") if closed else "bad").filter("bad IS NOT NULL")
    labelled = written(ruled.unionByName(own).select(tokens_of(url).alias("tokens"), "bad"), "labelled-urls")
    rules = written(mine(labelled, min_support, min_confidence), "url-rules")
    counts = labelled.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    open_urls = out.filter("rule IS NULL AND url IS NOT NULL").select("url").distinct().withColumn("tokens", tokens_of(url))
    out = out.join(matched(open_urls, rules, counts), "url", "left")
    learned = F.when(F.col("rule").isNull() & F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    decided = F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence")
    return out.select("page_id", "host", "path", "rule", F.coalesce(verdict_of(F.col("rule")), learned).alias("verdict"), *decided)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url. The fixed rules' own verdicts are the labels; the table `labels` is of documents, not of pages, and teaches nothing here."""
    none = spark.createDataFrame([], "page_id long, bad boolean")
    return judge(table(spark, sf_dir, "pages"), none, min_confidence=0.6, closed=True)
