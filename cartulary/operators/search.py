"""Search in nodes, anchors and lists."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.functions.text import holds, ordered_join
from cartulary.schema import edge_name, type_name


def map_filter(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label, summary or type's name holds the query."""
    q = F.lit(query)
    return nodes.filter(holds(F.col("label"), q) | holds(F.col("summary"), q) | holds(type_name(F.col("type")), q))


def map_search(nodes: DataFrame, anchors: DataFrame, query: str) -> DataFrame:
    """Nodes whose label, summary or any anchor's snippet holds the query."""
    q = F.lit(query)
    quoted = anchors.filter(holds(F.col("snippet"), q)).select("node_id").distinct().withColumn("quoted", F.lit(True))
    return nodes.join(quoted, "node_id", "left").filter(holds(F.col("label"), q) | holds(F.col("summary"), q) | F.coalesce("quoted", F.lit(False))).drop("quoted")


def command_palette(nodes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """kind, title, target: nodes whose label holds the query, by label, then a page if it is a number; the first `limit` of all."""
    found = nodes.filter(holds(F.col("label"), F.lit(query))).orderBy("label", "node_id").limit(limit).select(F.lit("node").alias("kind"), F.col("label").alias("title"), F.col("node_id").alias("target"))
    if not query.strip().lstrip("+-").isdigit():
        return found
    page = found.sparkSession.range(1).select(F.lit("page").alias("kind"), F.lit(f"Page {int(query)}").alias("title"), F.lit(str(int(query) - 1)).alias("target"))
    return found.withColumn("o", F.lit(0)).unionByName(page.withColumn("o", F.lit(1))).orderBy("o", "title", "target").limit(limit).drop("o")


def citation_anchors(citations: DataFrame, anchors: DataFrame, same_document: bool = False) -> DataFrame:
    """citation_id, node_id, ord of the best anchor on the citation's page: one whose text holds the citation's or is held by it, else the first.

    citations: citation_id, text, page (null finds nothing), and doc_id where the document has to be the same.
    """
    on = ["page", "doc_id"] if same_document else ["page"]
    # what is asked for and what is quoted in the same words meets once, whatever its number of copies
    wanted = citations.filter("page is not null").select("citation_id", *on, F.lower("text").alias("said"))
    quoted = anchors.groupBy(*on, F.lower("snippet").alias("quote")).agg(F.min(F.struct("node_id", "ord")).alias("first"))
    asked = wanted.select(*on, "said").distinct()
    met = asked.join(quoted, on)
    match = holds(F.col("quote"), F.col("said")) | holds(F.col("said"), F.col("quote"))
    found = met.groupBy(*on, "said").agg(F.min(F.struct(F.when(match, 0).otherwise(1).alias("miss"), "first.node_id", "first.ord")).alias("best"))
    same = [wanted[c] == found[c] for c in on]
    each = wanted.join(found, reduce(and_, [*same, wanted["said"].eqNullSafe(found["said"])])).groupBy("citation_id").agg(F.min("best").alias("best"))
    return each.select("citation_id", "best.node_id", "best.ord", (F.col("best.miss") == 0).alias("matched"))


def navigation_anchors(anchors: DataFrame, current_doc: str) -> DataFrame:
    """Each node's anchor to go to: the first in the current document, else the first."""
    best = F.min(F.struct((F.col("doc_id") != current_doc).alias("away"), "ord", "doc_id", "page"))
    return anchors.groupBy("node_id").agg(best.alias("b")).select("node_id", "b.doc_id", "b.page", "b.ord")


def active_nodes(visits: DataFrame, anchors: DataFrame) -> DataFrame:
    """visit rows with the active node: the first on the page, else the first within a page of it, else null.

    visits: doc_id, visit_id, page. The pages around are rows, so the join is by equal keys; of a page's nodes
    only the first can win, so a page is one row before it is met.
    """
    first = anchors.groupBy("doc_id", "page").agg(F.min("node_id").alias("node_id"))
    near = visits.withColumn("at", F.explode(F.array(*(F.struct((F.col("page") + d).alias("page"), F.lit(abs(d)).alias("off")) for d in (-1, 0, 1)))))
    met = near.select("doc_id", "visit_id", F.col("at.page").alias("page"), "at.off").join(first, ["doc_id", "page"])
    best = met.groupBy("doc_id", "visit_id").agg(F.min(F.struct("off", "node_id")).alias("b")).select("doc_id", "visit_id", F.col("b.node_id").alias("active"))
    return visits.join(best, ["doc_id", "visit_id"], "left")


def active_changes(active: DataFrame) -> DataFrame:
    """Rows of active_nodes() where the active node differs from the one before, in order of visit_id."""
    order = Window.partitionBy("doc_id").orderBy("visit_id")
    before = F.lag("active").over(order)
    return active.withColumn("before", before).filter(~F.col("active").eqNullSafe(F.col("before"))).drop("before")


def question_context(nodes: DataFrame, edges: DataFrame, page_text: str = "") -> DataFrame:
    """The one text that a question is asked with: nodes by label, relations by label, and the page at hand."""
    bullets = nodes.select(F.lit(0).alias("part"), "label", F.concat(F.lit("- "), "label", F.concat(F.lit(" ("), type_name(F.col("type")), F.lit(")")), F.coalesce(F.concat(F.lit(": "), "summary"), F.lit(""))).alias("line"), F.col("node_id").alias("id"))
    src, tgt = nodes.select(F.col("node_id").alias("src"), F.col("label").alias("a")), nodes.select(F.col("node_id").alias("tgt"), F.col("label").alias("b"))
    related = edges.join(src, "src").join(tgt, "tgt").select(F.lit(1).alias("part"), F.col("a").alias("label"), F.concat(F.lit("- "), "a", F.lit(" -> "), edge_name(F.col("type")), F.lit(" -> "), "b").alias("line"), F.col("edge_id").alias("id"))
    text = ordered_join(F.struct("part", "label", "id"), F.col("line"), "\n")
    return bullets.unionByName(related).agg(F.concat(text, F.lit("\n\n" + page_text)).alias("context"))


def pending_proposals(proposals: DataFrame, processed: DataFrame) -> DataFrame:
    """Proposals not processed, and whether a bulk accept takes them."""
    return proposals.join(processed.select("proposal_id"), "proposal_id", "left_anti").withColumn("bulk", F.col("similarity") > 0.9)


def named_files(files: DataFrame, query: str) -> DataFrame:
    """Files whose name or path holds the query."""
    return files.filter(holds(F.col("name"), F.lit(query)) | holds(F.col("path"), F.lit(query)))


def hit(layout: DataFrame, x: float, y: float, w: float = 140.0, h: float = 40.0) -> DataFrame:
    """The first node whose box holds the point."""
    return layout.filter((F.abs(F.col("x") - x) <= w / 2) & (F.abs(F.col("y") - y) <= h / 2)).orderBy("node_id").limit(1)
