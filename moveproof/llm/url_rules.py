"""URL filter: allow and block rules for hosts, their subdomains and path prefixes.

Each distinct (host, path) is expanded into the host's suffixes at label
borders and the path's prefixes, only of the lengths that occur in rules. The
digest of an expression is looked up by its first `digits` hex digits, an
equi-join; the full digest and the expression itself confirm a hit. Of all
rules that fit, the longest wins, then the one with the longer host, then a
block before an allow.

DataFrame functions only; nothing but the rules' label counts and path lengths,
a handful of integers, reaches the driver. A null url or one without "://" has
an empty host and path, and only a rule with an empty host fits it. A null id is
kept, repeated rows stay repeated, no rules or no pages give the default or
nothing. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIGITS = 8


def url_parts(url: Column) -> dict[str, Column]:
    """host: after the first "://" to "/", "?", "#" or the end; path: from there to "?", "#" or the end."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return {"host": F.translate(host, UPPER, LOWER),
            "path": F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)}


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _expressions(sites: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """host, path, suffix, prefix: what a rule could fit, for the sizes that rules have."""
    n_labels = F.size(F.split("host", r"\."))
    suffixes = F.filter(F.array(*[
        F.when(n_labels >= n, F.substring_index("host", ".", -n)) for n in labels
    ]), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[
        F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths
    ]), lambda x: x.isNotNull())
    return sites.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("_p")).select(
        "host", "path", "suffix", F.explode("_p").alias("prefix"))


def filter_urls(
    pages: DataFrame, rules: DataFrame, default: str = "allow", digits: int = DIGITS,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict for each page; rules: host, path, verdict."""
    parts = url_parts(F.col(f"`{url_col}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"),
                        *[c.alias(n) for n, c in parts.items()])
    sizes = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
                      F.collect_set(F.length("path")).alias("lengths")).first()
    if not sizes["labels"]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit(default).alias("verdict"))
    digest = _digest(F.col("rule_host"), F.col("rule_path"))
    known = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"),
        "verdict").withColumn("rule_digest", digest).withColumn(
        "short", F.substring("rule_digest", 1, digits))
    asked = _expressions(rows.select("host", "path").distinct(), sorted(sizes["labels"]),
                         sorted(sizes["lengths"]))
    asked = asked.withColumn("digest", _digest(F.col("suffix"), F.col("prefix"))).withColumn(
        "short", F.substring("digest", 1, digits))
    fits = asked.join(known, "short").filter(
        (F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host"))
        & (F.col("prefix") == F.col("rule_path")))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"),
                    F.col("verdict") == "block")
    best = fits.groupBy("host", "path").agg(F.max_by(
        F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
