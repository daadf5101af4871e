"""URL allow and block lists by host-suffix and path-prefix expressions.

Each URL is expanded into (host suffix, path prefix) expressions.  A short
prefix of an expression's digest is the equi-join key against the rules; the
full digest confirms, and what a rule's path has after its last slash is
compared on the few rows that are left.  The longest fitting rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this many may be broadcast; beyond it the join shuffles.
BROADCAST_RULES = 100_000
#: Hex digits of the digest that make the join key.
KEY_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url_, instr(url_, '://') + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def _to_last_slash(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge ``pages(page_id, url, ...)`` by ``rules(host, path, verdict)``.

    Returns ``page_id, host, path, rule, verdict``, a row per input row.
    ``rule`` is ``host + path`` of the winner, null if none fits; then the
    verdict is ``default``.  A rule fits its host and all subdomains where the
    URL's path starts with the rule's.  The longest rule wins, then the longer
    host, then block before allow.  Null or scheme-less URLs have empty host
    and path and fit no rule.  A URL is expanded into as many suffixes and prefixes
    as the deepest rule has labels and slashes, however many it has itself.  Repeated rows are judged one by one; other
    columns are ignored, whatever their names.
    """
    rules = rules.select(
        F.lower("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).filter("r_host is not null and r_path is not null and r_host <> ''")
    rules = rules.withColumn("r_digest", _digest(F.col("r_host"), _to_last_slash(F.col("r_path"))))
    rules = rules.withColumn("r_key", F.substring("r_digest", 1, KEY_DIGITS))

    url_host, url_path = host_and_path(F.col("url_"))
    judged = (
        pages.select("page_id", F.col("url").alias("url_"))
        .select("page_id", url_host.alias("host"), url_path.alias("path"))
    )
    # No rule has more labels or slashes than these: longer suffixes and prefixes fit none.
    slashes = F.size(F.split("r_path", "/", -1)) - 1
    most = rules.agg(F.max(F.size(F.split("r_host", r"\.", -1))).alias("labels"), F.max(slashes).alias("slashes")).first()
    if most.labels is None:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # Equal (host, path) pairs are expanded and joined once.
    distinct = judged.filter("host <> ''").select("host", "path").distinct()
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(most.labels)), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    suffixes = F.array_distinct(suffixes)  # a host with fewer labels is its own suffix
    parts = F.split("path", "/", most.slashes + 1)
    prefixes = F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))),
    ).otherwise(F.array().cast("array<string>"))
    # A rule whose path has no slash (or none at all) is keyed by the empty prefix.
    prefixes = F.concat(F.array(F.lit("")), prefixes)
    expanded = (
        distinct.withColumn("suffix", F.explode(suffixes))
        .withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        .select("host", "path", "digest", F.substring("digest", 1, KEY_DIGITS).alias("key"))
    )
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    found = expanded.join(
        F.broadcast(rules) if small else rules,
        (F.col("key") == F.col("r_key")) & (F.col("digest") == F.col("r_digest"))
        & F.startswith(F.col("path"), F.col("r_path")),
    )
    best = found.groupBy("host", "path").agg(
        F.max(
            F.struct(
                (F.length("r_host") + F.length("r_path")).alias("size"),
                F.length("r_host").alias("host_size"),
                (F.col("r_verdict") == "block").alias("blocks"),
                F.concat("r_host", "r_path").alias("rule"),
                F.col("r_verdict").alias("verdict"),
            )
        ).alias("best")
    )
    # Pages without a host are one key; they fit no rule and need no join.
    found = judged.filter("host <> ''").join(best, ["host", "path"], "left")
    rest = judged.filter("host = ''").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    return found.select(*rest.columns).unionByName(rest).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
