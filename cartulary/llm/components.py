"""Connected components by contraction, in rounds of joins; no link or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import discard, stored


def connected(links: DataFrame) -> tuple[DataFrame, str]:
    """node and root (the smallest node of its component) for each node of links (a, b), and the path of that table.

    Each round, a node takes its smallest neighbour, if that is smaller, as its parent; parents are
    followed four steps up; links are redrawn between what was reached. Parents are
    smaller, so there is no cycle; each round at least halves the paths that are left.
    """
    spark, old, steps = links.sparkSession, [], []
    edges, at = stored(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    while True:
        parents, parents_at = stored(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("up")), "parents")
        higher = parents.select(F.col("a").alias("up"), F.col("up").alias("higher"))
        twice = parents.join(higher, "up").select("a", F.col("higher").alias("up"))
        highest = twice.select(F.col("a").alias("up"), F.col("up").alias("higher"))
        step, step_at = stored(twice.join(highest, "up").select("a", F.col("higher").alias("up")), "steps")
        steps.append(step)
        left = step.select("a", F.col("up").alias("ra"))
        right = step.select(F.col("a").alias("b"), F.col("up").alias("rb"))
        redrawn = edges.join(left, "a").join(right, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        old += [at, parents_at, step_at]
        edges, at = stored(redrawn, "links")
        if not edges.head(1):
            break
    mapping = steps[0].select(F.col("a").alias("node"), F.col("up").alias("root"))
    for step in steps[1:]:
        mapping = mapping.join(step.select(F.col("a").alias("root"), "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    mapping, mapping_at = stored(mapping, "roots")
    discard(spark, at, *old)
    return mapping, mapping_at
