"""URL filters: hosts and path prefixes of a url against a table of allow and block rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

# The rules of the query as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a url; both empty for null or where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _folder(path: Column) -> Column:
    """A path cut after its last slash."""
    return F.regexp_extract(path, r"^(.*/)?", 0)


def _expression(host: Column, folder: Column) -> tuple[Column, Column]:
    digest = F.sha2(F.concat(host, F.lit("\n"), folder), 256)
    return F.substring(digest, 1, 8), digest


def expand(urls: DataFrame, max_labels: Column, max_folders: Column) -> DataFrame:
    """Each url (url, host, path) once per host suffix and folder prefix: short (start of the hash), digest.

    A url has labels x folders expressions; those with more labels or folders than any rule has cannot
    meet a rule and are not made.
    """
    labels = F.split("host", r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, max_labels)), lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    slashes = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/")))
    deep = F.least(slashes, max_folders)
    folders = F.when(deep == 0, F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.greatest(deep, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(F.split("path", "/"), 1, k), "/"), F.lit("/"))))
    )
    each = urls.withColumn("suffix", F.explode(hosts)).withColumn("folder", F.explode(folders))
    short, digest = _expression(F.col("suffix"), F.col("folder"))
    return each.select("url", "path", short.alias("short"), digest.alias("digest"))


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """Per row of pages: key, host, path, rule (host and path of the rule that won, or null), verdict.

    rules: verdict, host, path. A rule fits its host and all subdomains if the url's path starts with its
    path; the longest wins (host and path together, then the longer host, then block). Rules are matched on
    the folder of their path and confirmed on the full digest and the whole path, so a path may end
    anywhere. Without a rule a url is allowed if it has a host, else blocked: null, empty and broken urls are
    blocked. Repeated urls are judged once and joined back, so every row of pages returns.
    """
    host, path = url_parts(F.col("url"))
    folder = _folder(F.col("path"))
    short, digest = _expression(ascii_lower(F.col("host")), folder)
    ruled = rules.select(
        F.col("verdict").alias("said"), ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), short.alias("short"), digest.alias("rule_digest")
    )
    most = ruled.agg(
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1)), F.coalesce(F.max(F.length("rule_path") - F.length(F.replace(F.col("rule_path"), F.lit("/")))), F.lit(0))
    ).first()
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct().select("url", host.alias("host"), path.alias("path"))
    met = expand(urls, F.lit(most[0]), F.lit(most[1])).join(ruled, "short")
    fits = met.where((F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path")))
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("length"), F.length("rule_host").alias("host"), (F.col("said") == "block").alias("block"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("said").alias("said"),
    )
    best = fits.groupBy(F.col("url").alias("judged")).agg(F.max(rank).alias("best"))
    rows = pages.select(F.col(key), F.col("url"))
    return rows.join(best, rows["url"] == best["judged"], "left").select(
        key, host.alias("host"), path.alias("path"), F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.said"), F.when(host == "", F.lit("block")).otherwise("allow")).alias("verdict"),
    )
