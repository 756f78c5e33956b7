"""Pages, blocks, windows and batches of text.

pages: doc_id, page, text. A page's lines are blocks; positions are given with them or absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.functions.text import ordered_join, trimmed

PAGES_A_BATCH = 5


def read_pages(pages: DataFrame, low: int, high: int) -> DataFrame:
    """Pages low to high - 1, as far as the document has them."""
    return pages.filter(F.col("page").between(max(0, low), high - 1))


def lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, line_no and trimmed text of each line that isn't blank."""
    split = pages.select("doc_id", "page", F.posexplode(F.split("text", r"\R")).alias("line_no", "line"))
    return split.select("doc_id", "page", "line_no", trimmed(F.col("line")).alias("text")).filter("text <> ''")


def text_blocks(pages: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Blocks of each page: lines with the box of the first line on the page that has their text.

    boxes: doc_id, page, line_no, bbox. Blocks without area go; a page of which nothing is left gives
    its whole text as one block of type body, line_no -1.
    """
    found = lines(pages)
    if boxes is None:
        found = found.withColumn("bbox", F.lit(None).cast("struct<x:double,y:double,w:double,h:double>"))
    else:
        first = Window.partitionBy("doc_id", "page", "text").orderBy("line_no")
        found = found.join(boxes, ["doc_id", "page", "line_no"], "left").withColumn("bbox", F.first("bbox").over(first))
        found = found.filter((F.col("bbox.w") > 0) & (F.col("bbox.h") > 0))
    found = found.withColumn("block_type", F.lit(None).cast("string"))
    rest = pages.join(found.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    whole = rest.select("doc_id", "page", F.lit(-1).alias("line_no"), "text", F.lit(None).cast(found.schema["bbox"].dataType).alias("bbox"), F.lit("body").alias("block_type"))
    return found.select(*whole.columns).unionByName(whole)


def median_heights(blocks: DataFrame) -> DataFrame:
    """doc_id, page and the upper median of the line heights (column h)."""
    ranked = F.sort_array(F.collect_list("h"))
    return blocks.groupBy("doc_id", "page").agg(F.element_at(ranked, F.floor(F.count("h") / 2).cast("int") + 1).alias("median_h"))


def context_windows(pages: DataFrame, centers: DataFrame, around: int = 2) -> DataFrame:
    """Each centre's pages, `around` before to `around` after, as one text with page marks (from 1)."""
    near = pages.join(centers.select("doc_id", "center"), "doc_id").filter(F.abs(F.col("page") - F.col("center")) <= around)
    marked = F.concat(F.lit("--- Page "), (F.col("page") + 1).cast("string"), F.lit(" ---\n"), F.col("text"))
    return near.groupBy("doc_id", "center").agg(ordered_join(F.col("page"), marked, "\n\n").alias("context"))


def batches(pages: DataFrame, size: int = PAGES_A_BATCH) -> DataFrame:
    """doc_id, batch, page_lo, page_hi (exclusive), center, chars, avg_chars, scanned and needs_ocr of each batch of pages."""
    count = pages.groupBy("doc_id").agg((F.max("page") + 1).alias("n"))
    grouped = pages.groupBy("doc_id", F.floor(F.col("page") / size).cast("int").alias("batch")).agg(F.sum(F.length("text")).alias("chars"))
    rows = grouped.join(count, "doc_id").withColumn("page_lo", F.col("batch") * size).withColumn("page_hi", F.least(F.col("batch") * size + size, F.col("n")))
    chars = F.coalesce("chars", F.lit(0))
    average = F.expr("chars div greatest(1, page_hi - page_lo)")
    return rows.select("doc_id", "batch", "page_lo", "page_hi", F.floor((F.col("page_lo") + F.col("page_hi")) / 2).cast("int").alias("center"), chars.cast("long").alias("chars"), average.alias("avg_chars"), (average < 10).alias("scanned"), (chars == 0).alias("needs_ocr"))


def text_chunks(pages: DataFrame, size: int = PAGES_A_BATCH) -> DataFrame:
    """doc_id, page_lo, page_hi and text of each batch with any text but white space."""
    batch = F.floor(F.col("page") / size).cast("int")
    joined = pages.groupBy("doc_id", batch.alias("batch")).agg(ordered_join(F.col("page"), F.col("text"), "\n\n").alias("text"), F.max("page").alias("last"))
    return joined.filter(trimmed(F.col("text")) != "").select("doc_id", (F.col("batch") * size).alias("page_lo"), (F.col("last") + 1).alias("page_hi"), "text")


def search_hits(blocks: DataFrame, query: str, limit: int = 200) -> DataFrame:
    """The first `limit` lines in order of page and line that hold the query, then sorted by page, the highest y first.

    blocks: doc_id, page, line_no, text, y.
    """
    hits = blocks.filter(F.contains(F.lower("text"), F.lit(query.lower())))
    return hits.orderBy("doc_id", "page", "line_no").limit(limit).orderBy("doc_id", "page", F.col("y").desc(), "line_no")


def annotations(pages: DataFrame, kind: Column | None = None) -> DataFrame:
    """doc_id, page and each annotation of pages that have an array of them, widgets aside."""
    each = pages.select("doc_id", "page", F.posexplode("annotations").alias("ord", "annotation"))
    return each.filter(F.coalesce(F.col("annotation.type"), F.lit("")) != "Widget")
