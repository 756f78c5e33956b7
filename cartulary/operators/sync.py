"""Highlights and annotations against the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.geometry import overlaps

KEY = ("doc_id", "node_id", "page", "x", "y", "w", "h")


def highlight_diff(wanted: DataFrame, present: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """The key columns, color and action (add, remove, keep, recolour) that turn the present highlights into the wanted ones.

    pages: doc_id, n; wanted highlights beyond a document's pages are left out.
    """
    if pages is not None:
        wanted = wanted.join(pages.select("doc_id", "n"), "doc_id").filter(F.col("page") < F.col("n")).drop("n")
    a = wanted.groupBy(*KEY).agg(F.min("color").alias("want"), F.lit(True).alias("wanted"))
    b = present.groupBy(*KEY).agg(F.min("color").alias("have"), F.lit(True).alias("present"))
    action = F.when(F.col("present").isNull(), "add").when(F.col("wanted").isNull(), "remove").when(F.col("want").eqNullSafe(F.col("have")), "keep").otherwise("recolour")
    return a.join(b, list(KEY), "full_outer").select(*KEY, F.coalesce("want", "have").alias("color"), action.alias("action"))


def highlighted(nodes: DataFrame, anchors: DataFrame, highlights: DataFrame) -> DataFrame:
    """Nodes with those under a new highlight (doc_id, page, bbox) read as highlighted and pinned. Boxes have to overlap by an area."""
    met = anchors.alias("a").join(highlights.alias("h"), ["doc_id", "page"]).filter(overlaps(F.col("a.bbox"), F.col("h.bbox"))).select("node_id").distinct().withColumn("met", F.lit(True))
    out = nodes.join(met, "node_id", "left")
    return out.withColumns({"reading_state": F.when(F.col("met"), "highlighted").otherwise(F.col("reading_state")), "is_pinned": F.coalesce("met", "is_pinned")}).select(*nodes.columns)


def annotated(nodes: DataFrame, anchors: DataFrame, annotations: DataFrame) -> DataFrame:
    """Nodes with those on an annotated page (doc_id, page) read as annotated."""
    met = anchors.join(annotations.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi").select("node_id").distinct().withColumn("met", F.lit(True))
    return nodes.join(met, "node_id", "left").withColumn("reading_state", F.when(F.col("met"), "annotated").otherwise(F.col("reading_state"))).select(*nodes.columns)
