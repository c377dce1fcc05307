"""Allow and block rules for URLs, matched by hashed host and path expressions.

Every URL is expanded into expressions: each suffix of its host at a label border,
each combined with each prefix of its path that ends in ``/`` (and the empty one).
A rule has exactly one such expression: its host and its path up to the last ``/``.
Expressions and rules meet in an equi-join on the first eight hex digits of a
SHA-256 digest; the full digest and the rest of the rule's path are compared after
the join, and the longest rule that is left decides.

No expression is left out that a rule could have: the expansion stops at the largest
number of labels and of path segments that occur in the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
_AUTHORITY = r"://([^/?#]*)"
_PATH = r"://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, with A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?" + _AUTHORITY, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #``; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?" + _PATH, 1)


def _folder(path: Column) -> Column:
    """The path up to its last ``/``, which is part of it."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Rules ``(verdict, host, path)`` with their digest; equal rules become one.

    Rules with a null in any column are ignored. Two rules of the same host and path
    are one rule that blocks.
    """
    host, path = F.lower(F.col("host")), F.col("path")
    return (
        rules.select(F.col("verdict"), host.alias("host"), path.alias("path"))
        .dropna()
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("rule_verdict"))
        .withColumn("digest", _digest(F.col("host"), _folder(F.col("path"))))
        .select(
            F.substring("digest", 1, 8).alias("short"),
            F.col("digest").alias("rule_digest"),
            F.col("path").alias("rule_path"),
            F.concat("host", "path").alias("rule"),
            "rule_verdict",
            F.size(F.split("host", r"\.")).alias("labels"),
            (F.size(F.split("path", "/")) - 1).alias("slashes"),
        )
    )


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = ALLOW,
) -> DataFrame:
    """One row per row of ``pages``: id, ``host``, ``path``, ``rule`` and ``verdict``.

    Of several fitting rules the one with the longest text wins, then the one with the
    longer host, then the one that blocks. Defined results: a null URL or one without
    ``://`` has an empty host and path and gets the default, and so does every URL if
    there are no rules; repeated rows are judged one by one and null ids are kept; other
    columns of ``pages`` are ignored. Distinct host and path pairs are judged once, so a
    host or URL that holds a third of all rows is matched once as well.
    """
    urls = pages.select(
        F.col(id_col).alias("page_id"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    known = prepared_rules(rules)
    # One row: how deep rules go at most.
    depth = known.agg(
        F.coalesce(F.max("labels"), F.lit(0)).alias("labels"),
        F.coalesce(F.max("slashes"), F.lit(0)).alias("slashes"),
    ).first()
    labels, slashes = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, depth["labels"])))),
        lambda n: F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n)),
    )
    folders = F.transform(
        F.sequence(F.lit(0), F.least(F.size(slashes) - 1, F.lit(depth["slashes"]))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(
            F.concat(F.concat_ws("/", F.slice(slashes, 1, n)), F.lit("/"))
        ),
    )
    expressions = (
        urls.filter("host != ''")
        .select("host", "path")
        .distinct()
        .withColumn("suffix", F.explode(suffixes))
        .withColumn("folder", F.explode(folders))
        .withColumn("full", _digest(F.col("suffix"), F.col("folder")))
        .select("host", "path", "full", F.substring("full", 1, 8).alias("short"))
    )
    precedence = F.struct(
        F.length("rule").alias("length"),
        (F.length("rule") - F.length("rule_path")).alias("host_length"),
        (F.col("rule_verdict") == BLOCK).alias("blocks"),
        F.col("rule").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    decided = (
        expressions.join(known, "short")
        .filter("full = rule_digest and startswith(path, rule_path)")
        .groupBy("host", "path")
        .agg(F.max(precedence).alias("best"))
    )
    return urls.join(decided, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
