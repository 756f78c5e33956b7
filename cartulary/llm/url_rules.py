"""URL filters: hashed host-suffix and path-prefix expressions.

Each URL is expanded into its host's suffixes times its path's prefixes (of lengths that rules
have). Expressions meet rules in an equi-join on a short prefix of their SHA-256; the full
digest confirms a hit. Of all rules that fit, the longest wins (host and path together; then the
longer host; then block before allow).

A null URL, or one without "://", has an empty host and path and fits no rule. Repeated rows are
judged alike and all kept. An empty table gives none. Extra columns are ignored unless kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.common import col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join goes by.
SHORT = 8
#: Rules up to which every executor gets them all; more are joined by a shuffle.
MOST_SENT = 200_000


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end; A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """host, path and verdict of each rule, as a DataFrame."""
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def digest_of(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def judge(df: DataFrame, rules: DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",), otherwise: str = "allow") -> DataFrame:
    """Columns `keep`, host, path, rule (host and path of the rule that won, else null) and verdict (the rule's, else `otherwise`).

    keep: columns that can be grouped by; those whose names are those of results give way.
    """
    keep = [k for k in keep if k.lower() not in ("host", "path", "rule", "verdict")]
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct().withColumn("digest", digest_of(F.col("r_host"), F.col("r_path")))
    rules = rules.withColumn("short", F.left("digest", F.lit(SHORT)))
    # the shapes of rules: as many as there are lengths, not as there are rules
    n, labels = rules.agg(F.count("*"), F.max(F.size(F.split("r_host", r"\.")))).first()
    lengths = [r[0] for r in rules.select(F.length("r_path")).distinct().collect()]
    rows = df.select(*(col(k).alias(f"k{i}") for i, k in enumerate(keep)), col(url).cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, labels or 1)))), lambda k: F.concat_ws(".", F.slice(parts, F.size(parts) - k + 1, k)))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths or [0])), lambda m: m <= F.length("path")), lambda m: F.substring(F.col("path"), F.lit(1), m))
    hashed = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: digest_of(h, p))))
    # the null stands for the row itself: it fits nothing, and counts repeated rows
    rows = rows.select(*(f"k{i}" for i in range(len(keep))), "url", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.when(F.col("url").contains("://"), hashed).otherwise(F.array().cast("array<string>")))).alias("expression"))
    rows = rows.withColumn("short", F.left("expression", F.lit(SHORT)))
    met = rows.join(F.broadcast(rules) if n <= MOST_SENT else rules, (rows.short == rules.short) & (rows.expression == rules.digest), "left")
    rank = F.when(F.col("r_host").isNotNull(), F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), (F.col("r_verdict") == "block").alias("blocks"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")))
    keys = [f"k{i}" for i in range(len(keep))]
    best = met.groupBy(*keys, "url").agg(F.max(rank).alias("best"), F.count(F.when(F.col("expression").isNull(), 1)).alias("times"))
    best = best.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return best.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
