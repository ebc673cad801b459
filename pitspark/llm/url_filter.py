"""Allow and block rules over URLs: hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .text import lower_ascii, repeated

PREFIX_DIGITS = 8
SALTS = 16


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(_part(url, 1))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    found = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)([^?#]*)", group)
    return F.coalesce(found, F.lit(""))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as rows: rule (host and path), verdict, path length, digest and its prefix."""
    rows = [(r.host, r.path, r.verdict) for r in rules]
    digest = F.sha2(F.concat("host", "path"), 256)
    return spark.createDataFrame(rows, "host string, path string, verdict string").select(
        F.concat("host", "path").alias("rule"), "verdict",
        F.length("path").alias("path_length"), digest.alias("rule_digest"),
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url",
    default: str = "allow",
) -> DataFrame:
    """The longest rule that fits each URL: (id, host, path, rule, verdict).

    A URL is expanded into every suffix of its host at a dot, joined with every
    prefix of its path that has the length of some rule's path. Expressions meet
    rules on the first digits of a SHA-256 digest; the full digest then confirms
    the rule. Among confirmed rules the longest wins, then the lesser text, then
    the lesser verdict. Without one the verdict is ``default`` and the rule null.

    The lengths of rule paths come to the driver: their number is at most the
    longest rule path, whatever the number of rules or pages. Hosts and paths
    are expanded without any limit on labels or length. Rules are repeated over
    salts and expressions choose one by id, so that a rule that fits a third of
    all pages (a whole top-level domain) spreads over ``SALTS`` keys. Rows with
    the same id and URL are folded with a count first and unfolded at the end.

    A null URL or one without ``://`` has an empty host and path and fits no
    rule; a null id stays null; an empty table gives an empty result; further
    columns, whatever their names, are not read.
    """
    lengths = sorted(r[0] for r in rules.select("path_length").distinct().collect())
    folded = pages.select(
        F.col(id_column).alias("id"), F.col(url_column).alias("url"),
    ).groupBy("id", "url").agg(F.count("*").alias("copies"))
    parsed = folded.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]),
        lambda p: p.isNotNull(),
    ) if lengths else F.array().cast("array<string>")
    expressions = F.flatten(
        F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))
    )
    expanded = parsed.select(
        "id", "url", "host", "path", "copies", F.explode_outer(expressions).alias("expression"),
    ).select(
        "id", "url", "host", "path", "copies", F.sha2("expression", 256).alias("digest"),
        F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int").alias("salt"),
    ).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    salted = rules.select(
        "rule", "verdict", "rule_digest",
        F.substring("rule_digest", 1, PREFIX_DIGITS).alias("rule_prefix"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("rule_salt"),
    )
    hits = expanded.join(
        salted,
        (F.col("prefix") == F.col("rule_prefix")) & (F.col("salt") == F.col("rule_salt")), "left",
    ).withColumn(
        "length", F.when(F.col("digest") == F.col("rule_digest"), F.length("rule")),
    )
    best = hits.groupBy("id", "url").agg(
        F.first("host").alias("host"), F.first("path").alias("path"), F.first("copies").alias("copies"),
        F.min(
            F.when(F.col("length").isNotNull(), F.struct(
                (-F.col("length")).alias("shorter"), F.col("rule").alias("rule"),
                F.col("verdict").alias("verdict"),
            ))
        ).alias("best"),
    )
    return repeated(best, F.col("copies"), "copy").select(
        F.col("id").alias(id_column), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
