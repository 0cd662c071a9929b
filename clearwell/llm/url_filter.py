"""URL filters by expressions of host suffix and path prefix.

A rule is a host and a path; it fits that host and its subdomains where the
URL's path starts with the rule's.  Each distinct URL is expanded into every
pair of a host suffix and a path prefix that a rule could be (suffixes of no
more labels than rules have, prefixes only of the lengths that rules have); the pairs meet the rules in an equi-join on the
first PREFIX_BYTES bytes of their SHA-256, then full digests are compared.  Of
the rules that fit, the longest wins; of equally long ones the one with the
longer host, then blocking.

Edge cases: a null URL and one without "://" have an empty host and path, fit
no rule and get the default verdict; a host keeps its port and user part as
they stand; an empty path does not start with "/"; repeated rows stay repeated;
very long URLs are read whole, and a host of very many labels gives no more pairs than one of few; other columns
are kept, and those named host, path, rule or verdict are replaced by the result's; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: (verdict, rule) of the query; a rule is a host and, from its first slash, a path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
PREFIX_BYTES = 4
#: Rules up to this number are sent to every task; more are joined by shuffle.
BROADCAST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url"):
    """Columns host (A-Z lower-cased) and path."""
    whole = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def rules_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    rows = [(v, r[: r.find("/")] if "/" in r else r, r[r.find("/") :] if "/" in r else "", r) for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string, rule string")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict."""
    best = Window.partitionBy("host", "path").orderBy(F.when(F.col("verdict") == "block", 0).otherwise(1), "rule")
    rules = rules.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    rules = rules.select("verdict", "rule", F.length("rule").alias("size"), F.length("host").alias("host_size"), F.length("path").alias("path_size"), F.size(F.split("host", r"\.")).alias("labels"), F.sha2(F.concat_ws("\n", F.translate("host", _UPPER, _LOWER), "path"), 256).alias("digest"))
    lengths = [r[0] for r in rules.select("path_size").distinct().collect()]  # lengths of rules' paths: few
    longest = rules.agg(F.max("labels")).first()[0] or 1
    known = rules.limit(BROADCAST_RULES + 1).count()
    rules = rules.withColumn("key", F.substring("digest", 1, 2 * PREFIX_BYTES))
    if known <= BROADCAST_RULES:
        rules = F.broadcast(rules)

    host, path = host_and_path()
    urls = pages.select("url").distinct().withColumns({"host": host, "path": path})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - longest + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in lengths))) if lengths else F.array().cast("array<string>")
    pairs = urls.where("host <> ''").select("url", F.explode(suffixes).alias("h"), prefixes.alias("p")).select("url", "h", F.explode("p").alias("p"))
    pairs = pairs.withColumn("full", F.sha2(F.concat_ws("\n", "h", "p"), 256)).withColumn("key", F.substring("full", 1, 2 * PREFIX_BYTES))
    fits = pairs.join(rules, "key").where("full = digest")
    order = F.struct("size", "host_size", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"), "rule", "verdict")
    won = fits.groupBy("url").agg(F.max(order).alias("r")).select(F.col("url").alias("__url"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    out = out.join(won, F.col("url") == F.col("__url"), "left").drop("__url")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
