"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is what brings its size (code points over all its documents) to its
target share of the whole. Each document's count is the Poisson quantile, at that rate, of a
uniform number hashed from a seed and its id: the same for any order, partitioning or retry.
Each document is exploded by its count, and all copies are sorted by a hash of seed, id and
copy: a global shuffle.

A null source is a source of its own. A null text has size 0 and is replicated like others of its
source. Null ids hash as an empty string; repeated ids get equal counts and stand in an order that their other columns decide. A source whose texts are
all empty keeps each document once. An empty table gives none. Texts are not looked into, however long.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from cartulary.llm.common import col, free_name, kept

#: Sources up to which the rates go to every executor; more are joined by a shuffle, whose hot keys AQE splits.
MOST_SENT = 50_000
#: Hex digits of a hash that make a uniform number.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.conv(F.left(F.md5(F.concat_ws(":", *parts)), F.lit(DIGITS)), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def poisson_steps(rate: Column) -> Column:
    """The distribution function at 0, 1, 2 ... as far as a uniform number of 52 bits can tell it from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    grown = lambda acc, k: F.struct((acc["log"] + F.log(rate) - F.log(k.cast("double"))).alias("log"), F.concat(acc["steps"], F.array(F.element_at(acc["steps"], -1) + F.exp(acc["log"] + F.log(rate) - F.log(k.cast("double"))))).alias("steps"))
    first = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("steps"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), first, grown)["steps"]).otherwise(F.array(F.lit(1.0)))


def target_rates(df: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0, text: str = "text", source: str = "source") -> DataFrame:
    """source, size and mean repetition rate of each source; the weights of those present are scaled to sum to 1."""
    sizes = df.groupBy(col(source).alias("source")).agg(F.sum(F.length(F.coalesce(col(text).cast("string"), F.lit("")))).alias("size"))
    weight = F.lit(float(default_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    # one row of totals over the sources
    totals = sizes.agg(F.sum("size").alias("whole"), F.sum("weight").alias("weights"))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.lit(float(epochs)) * F.col("weight") / F.col("weights") * F.col("whole") / F.col("size"))
    return sizes.join(F.broadcast(totals)).select("source", "size", rate.alias("rate"))


def replicate(df: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: str = "mix", ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """All columns of df for each copy of each document, copy (from 1) and shuffle_key, sorted by shuffle_key. Columns of df of these two names give way."""
    df = df.drop(*(c for c in df.columns if c.lower() in ("copy", "shuffle_key")))
    of, steps, times = (free_name(df, x) for x in ("rate_source", "rate_steps", "times"))
    rates = target_rates(df, weights, default_weight, epochs, text, source).select(F.col("source").alias(of), poisson_steps(F.col("rate")).alias(steps))
    # a row a source, computed once
    rates = kept(rates, "rates")
    if rates.count() <= MOST_SENT:
        rates = F.broadcast(rates)
    key = F.coalesce(col(ident).cast("string"), F.lit(""))
    rows = df.join(rates, col(source).eqNullSafe(F.col(of)))
    u = uniform(F.lit(seed), key)
    rows = rows.withColumn(times, F.size(F.filter(steps, lambda step: step <= u))).filter(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(times))))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), key, F.col("copy").cast("string"))))
    rows = rows.drop(of, steps, times)
    # copies of rows that repeat an id have one key: what else they hold puts them in order
    rest = F.xxhash64(*(F.to_json(col(c)) if isinstance(f.dataType, MapType) else col(c) for c, f in zip(rows.columns, rows.schema, strict=True)))
    return rows.orderBy("shuffle_key", rest)
