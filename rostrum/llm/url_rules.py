"""URL filters from association rules.

Spark's FP-growth mines combinations of URL tokens that go with a bad label; rules are
pruned by support, confidence and lift, and dropped where a shorter rule is as sure. A
rule is indexed under its rarest token: the tokens of a URL look up candidates there and
the other tokens confirm. Listed host and path rules come first, the longest that fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.common import register, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"
# The list of the registered query.
LISTED = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for a null url or one without ``://``."""
    pattern, u = r"(?s)^.*?://([^/?#]*)([^?#]*)", F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def listed(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule that fits host or a parent domain and the start of the path; else null."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits.append(F.when(F.concat(F.lit("."), host).endswith(f".{h}") & path.startswith(slash + p),
                           F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: str, host: str, path: str) -> Column:
    """Distinct tokens: host labels and ends, path words with digits folded, names of query fields, scheme, fragment."""
    u = F.coalesce(F.col(url), F.lit(""))
    labels = F.split(F.col(host), r"\.")
    words = F.transform(F.regexp_extract_all(F.lower(F.col(path)), F.lit(r"([^/._\-]+)"), 1), lambda w: F.regexp_replace(w, "[0-9]+", "#"))
    fields = F.regexp_extract_all(u, F.lit(r"[?&]([^=&#]+)"), 1)
    mark = lambda kind: lambda x: F.concat(F.lit(kind), x)
    every = F.concat(F.transform(labels, mark("host:")), F.array(F.concat(F.lit("site:"), F.col(host))),
                     F.flatten(F.transform(labels, lambda x: F.transform(F.split(x, "-"), mark("word:")))),
                     F.transform(words, mark("path:")), F.transform(fields, mark("field:")),
                     F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(u, "^([A-Za-z]+)://", 1))),
                             F.when(u.contains("#"), F.lit("fragment:"))))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & ~x.endswith(":")))


def url_tokens(pages: DataFrame, url: str) -> DataFrame:
    """One row per different url, with its tokens."""
    host, path = host_and_path("_url")
    return (pages.select(F.col(url).alias("_url")).where("_url IS NOT NULL").distinct()
            .select("_url", host.alias("_host"), path.alias("_path")).select("_url", tokens("_url", "_host", "_path").alias("tokens")))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_count: int = 20) -> DataFrame:
    """Rules from rows of ``tokens`` and boolean ``bad``: antecedent, confidence, support, and the rarest token to index by.

    No labelled row, or none bad, gives no rule. The number of rules is bounded by the support, not by the data.
    """
    spark = labelled.sparkSession
    baskets = stored(labelled.select(F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens")).alias("items")))
    n = baskets.count()
    empty = "antecedent array<string>, confidence double, support double, key string"
    if not n:
        return spark.createDataFrame([], empty)
    support = max(min_support, min_count / n)
    if support > 1:
        return spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence,
                     numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(baskets)
    rules = (model.associationRules.where(F.array_contains("consequent", BAD) & (F.col("lift") > 1))
             .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))
    rules = stored(rules)
    long, short = rules.alias("l"), rules.alias("s")
    # A rule whose part is at least as sure says nothing new; parts share a token, so the join is on tokens.
    parts = (long.withColumn("token", F.explode("antecedent")).alias("l").join(
        short.withColumn("token", F.explode("antecedent")).alias("s"), "token")
        .where((F.size("s.antecedent") < F.size("l.antecedent")) & (F.col("s.confidence") >= F.col("l.confidence"))
               & (F.size(F.array_except("s.antecedent", "l.antecedent")) == 0))
        .select(F.col("l.antecedent").alias("antecedent")).distinct())
    rules = rules.join(parts, "antecedent", "left_anti")
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq"))
    keyed = (rules.withColumn("token", F.explode("antecedent")).join(single, "token")
             .groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("key")))
    return rules.join(keyed, "antecedent")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Confidence of the surest rule per url that any rule fits."""
    looked_up = urls.select("_url", "tokens", F.explode("tokens").alias("key")).join(rules, "key")
    return (looked_up.where(F.size(F.array_except("antecedent", "tokens")) == 0)
            .groupBy("_url").agg(F.max("confidence").alias("confidence")))


def filter_urls(pages: DataFrame, rules: DataFrame, allow_block: Sequence[tuple[str, str]] = (), url: str = "url",
                keep: list[str] | None = None) -> DataFrame:
    """Append ``host, path, rule, verdict, confidence`` (of the surest mined rule, else null).

    Listed rules decide, then mined ones block, else the url is allowed; so a null url is.
    Equal urls agree; columns with the names of results are replaced.
    """
    names = pages.columns if keep is None else keep
    host, path = host_and_path(url)
    new = {"host", "path", "rule", "verdict", "confidence"}
    found = matches(url_tokens(pages, url), rules)
    df = pages.select(*dict.fromkeys([*names, url])).select(
        *[c for c in names if c.lower() not in new], F.col(url).alias("_own_url"), host.alias("_h"), path.alias("_p"))
    df = df.withColumn("_listed", listed(F.col("_h"), F.col("_p"), allow_block))
    df = df.join(found, df["_own_url"] == found["_url"], "left")
    verdict = F.coalesce("_listed.verdict", F.when(F.col("confidence").isNotNull(), "block"), F.lit("allow"))
    return df.select(*[c for c in names if c.lower() not in new], F.col("_h").alias("host"), F.col("_p").alias("path"),
                     F.col("_listed.rule").alias("rule"), verdict.alias("verdict"), "confidence")


@register("op1_url_rules")
def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; a page takes the label of the document with its id, bad if of low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = (table(spark, sf_dir, "labels").groupBy("doc_id")
              .agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad")))
    labelled = (pages.where("url IS NOT NULL").join(labels, F.col("page_id") == F.col("doc_id"))
                .select(F.col("url").alias("_url"), "bad"))
    host, path = host_and_path("_url")
    labelled = labelled.select("_url", "bad", host.alias("_host"), path.alias("_path")).select(
        tokens("_url", "_host", "_path").alias("tokens"), "bad")
    return filter_urls(pages, mine(labelled), LISTED, keep=["page_id"])
