"""Filters, adjacency and statistics of the graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.schema import CONTAINMENT_TYPES, is_containment


def nodes_of_document(nodes: DataFrame, anchors: DataFrame, doc: str) -> DataFrame:
    return nodes.join(anchors.filter(F.col("doc_id") == doc).select("node_id"), "node_id", "left_semi")


def nodes_on_page(nodes: DataFrame, anchors: DataFrame, doc: str, page: int) -> DataFrame:
    """One anchor has to be in the document and on the page."""
    return nodes.join(anchors.filter((F.col("doc_id") == doc) & (F.col("page") == page)).select("node_id"), "node_id", "left_semi")


def with_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.filter(F.lower("label") == label.lower())


def incident(edges: DataFrame) -> DataFrame:
    """node_id, edge_id, other, type, outward: each edge at both its ends, a loop once."""
    out = edges.select(F.col("src").alias("node_id"), "edge_id", F.col("tgt").alias("other"), "type", F.lit(True).alias("outward"))
    back = edges.filter("src <> tgt").select(F.col("tgt").alias("node_id"), "edge_id", F.col("src").alias("other"), "type", F.lit(False).alias("outward"))
    return out.unionByName(back)


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id and each neighbour with its label; parallel edges give a neighbour again."""
    return incident(edges).select("node_id", F.col("other").alias("neighbour")).join(nodes.select(F.col("node_id").alias("neighbour"), F.col("label").alias("neighbour_label")), "neighbour")


def contained(edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """parent and child by one type of containment, or any."""
    kept = edges.filter(F.col("type") == edge_type) if edge_type else edges.filter(is_containment(F.col("type")))
    return kept.select(F.col("src").alias("parent"), F.col("tgt").alias("child"))


def having_children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(contained(edges).select(F.col("parent").alias("node_id")), "node_id", "left_semi")


def first_parent(edges: DataFrame, edge_type: str) -> DataFrame:
    """child and the parent of its first edge, by edge id."""
    kept = edges.filter(F.col("type") == edge_type)
    return kept.groupBy(F.col("tgt").alias("child")).agg(F.min_by("src", "edge_id").alias("parent"))


def degrees(edges: DataFrame) -> DataFrame:
    """node_id and its number of incident edges."""
    return incident(edges).groupBy("node_id").agg(F.count_distinct("edge_id").alias("degree"))


def entity_counts(edges: DataFrame) -> DataFrame:
    return edges.filter("type = 'containsEntity'").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("entities"))


def multi_document(anchors: DataFrame) -> DataFrame:
    """Nodes anchored in more documents than one, and in how many."""
    return anchors.groupBy("node_id").agg(F.count_distinct("doc_id").alias("documents")).filter("documents > 1")


def concept_counts(anchors: DataFrame) -> DataFrame:
    """Nodes of any level anchored in each document."""
    return anchors.groupBy("doc_id").agg(F.count_distinct("node_id").alias("concepts"))


def unprocessed(documents: DataFrame, states: DataFrame) -> DataFrame:
    """Documents without a state, or unprocessed or failed."""
    return documents.join(states, "doc_id", "left").filter(F.coalesce("state", F.lit("unprocessed")).isin("unprocessed", "failed")).select("doc_id")


def chapter_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between chapters that the relations of their concepts call for and that aren't there yet.

    src, tgt, type, confidence 0.7 and label "aggregated". Run again over its own result it gives none.
    The pairs of chapters are made distinct before they meet the edges that exist.
    """
    concepts = nodes.filter("level = 'concept'").select("node_id")
    chapters = nodes.filter("level = 'chapter'").select(F.col("node_id").alias("chapter"))
    parents = edges.filter("type = 'containsConcept'").select(F.col("src").alias("chapter"), F.col("tgt").alias("node_id")).join(chapters, "chapter", "left_semi").join(concepts, "node_id", "left_semi").distinct()
    relations = edges.filter(~is_containment(F.col("type"))).select("src", "tgt", "type").distinct()
    up = relations.join(parents.select(F.col("node_id").alias("src"), F.col("chapter").alias("a")), "src").join(parents.select(F.col("node_id").alias("tgt"), F.col("chapter").alias("b")), "tgt")
    wanted = up.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("tgt"), "type").distinct()
    return wanted.join(edges.select("src", "tgt", "type"), ["src", "tgt", "type"], "left_anti").withColumns({"confidence": F.lit(0.7), "label": F.lit("aggregated")})


#: Chapters that begin and that end the edges of one task, about, where pairs of chapters are not shuffled; rows handed on at once.
FROM, TO, ROWS = 2048, 16384, 1 << 16


def _lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a column's lists, one after another, and where each list begins."""
    return column.flatten(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])


def _places(values: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each value stands among others, -1 where it doesn't."""
    return pc.index_in(values, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False)


def _reached(targets: np.ndarray, above: list[np.ndarray], n: int) -> np.ndarray | None:
    """Of n chapters, those above any of the targets: their places, or a mark for each where they are many; null if none."""
    found = [above[t] for t in targets]
    if not found:
        return None
    places = np.concatenate(found)
    if len(places) <= max(64, n // 32):
        return places
    marks = np.zeros(n, bool)
    marks[places] = True
    return marks


def _edges_of_two(begins: pa.StructArray, ends: pa.StructArray) -> Iterator[tuple[str, str, pa.Array]]:
    """src, type and all tgt of two blocks: what a block's chapters hold, relate and have (kind, name, type, others), and concepts with the chapters above them."""
    held, at = _lists(ends.field("chapters"))
    coded = held.dictionary_encode()
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    above, n = [codes[lo:hi] for lo, hi in zip(at, at[1:], strict=False)], len(names)
    of = lambda kind: begins.filter(pc.equal(begins.field("kind"), kind))
    chapters, related, known = of("holds"), of("relates"), of("has")
    concepts, first = _lists(chapters.field("others"))
    own = _places(chapters.field("name"), names)
    there, bounds = _lists(known.field("others"))
    there = _places(there, names)
    taken = {(src, kind): there[lo:hi] for src, kind, lo, hi in zip(known.field("name").to_pylist(), known.field("type").to_pylist(), bounds, bounds[1:], strict=False)}
    for kind in pc.unique(related.field("type")).to_pylist():
        mine = related.filter(pc.equal(related.field("type"), kind))
        targets, begin = _lists(mine.field("others"))
        targets = _places(targets, ends.field("node_id"))
        reach = [_reached((t := targets[lo:hi])[t >= 0], above, n) for lo, hi in zip(begin, begin[1:], strict=False)]
        met = _places(concepts, mine.field("name"))
        for k, src in enumerate(chapters.field("name").to_pylist()):
            sets = [r for c in met[first[k] : first[k + 1]] if c >= 0 and (r := reach[c]) is not None]
            if not sets:
                continue
            wanted = np.zeros(n, bool)
            for r in sets:
                if r.dtype == bool:
                    wanted |= r
                else:
                    wanted[r] = True
            for gone in (own[k : k + 1], taken.get((src, kind), own[:0])):
                wanted[gone[gone >= 0]] = False
            if wanted.any():
                yield src, kind, names.take(pa.array(np.flatnonzero(wanted)))


def _block_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """src, tgt, type of each pair of blocks (begins, ends)."""

    def batch(out: list[tuple[str, str, pa.Array]]) -> pa.RecordBatch:
        n = [len(t) for _, _, t in out]
        spread = lambda k: pa.array([o[k] for o in out], pa.string()).take(pa.array(np.repeat(np.arange(len(out)), n)))
        return pa.RecordBatch.from_arrays([spread(0), pa.concat_arrays([t for _, _, t in out]), spread(1)], ["src", "tgt", "type"])

    for b in batches:
        for begins, ends in zip(b["begins"], b["ends"], strict=True):
            out, size = [], 0
            for found in _edges_of_two(begins.values, ends.values):
                out.append(found)
                size += len(found[2])
                if size >= ROWS:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)


def chapter_edges_in_blocks(nodes: DataFrame, edges: DataFrame, chapters: int) -> DataFrame:
    """chapter_edges() where chapters (about so many) are many and most pairs are wanted: no pair is shuffled.

    Chapters with their concepts are packed in blocks, and each block gets the relations of its concepts once; concepts with the
    chapters above them are packed in others. Each block meets each, and a task makes all pairs of two, each once.
    """
    concepts = nodes.filter("level = 'concept'").select("node_id")
    named = nodes.filter("level = 'chapter'").select(F.col("node_id").alias("chapter")).distinct()
    parents = edges.filter("type = 'containsConcept'").select(F.col("src").alias("chapter"), F.col("tgt").alias("node_id")).join(named, "chapter", "left_semi").join(concepts, "node_id", "left_semi").distinct()
    relations = edges.filter(~is_containment(F.col("type"))).select("src", "tgt", "type").distinct()
    blocks = lambda size: -(-max(1, chapters) // size)
    of = lambda c, size: F.pmod(F.xxhash64(c), F.lit(blocks(size))).cast("int")
    row = lambda rows, kind, name, type_, other: rows.groupBy("from", F.lit(kind).alias("kind"), F.col(name).alias("name"), type_.alias("type")).agg(F.collect_list(other).alias("others"))
    # what a concept relates to is the same in all chapters of a block
    inside = parents.withColumn("from", of("chapter", FROM))
    related = relations.groupBy("src", "type").agg(F.collect_list("tgt").alias("others"))
    asked = inside.select("from", F.col("node_id").alias("src")).distinct().join(related, "src").select("from", F.lit("relates").alias("kind"), F.col("src").alias("name"), "type", "others")
    have = relations.join(named.select(F.col("chapter").alias("src")), "src", "left_semi").withColumn("from", of("src", FROM))
    rows = row(inside, "holds", "chapter", F.lit(None).cast("string"), "node_id").unionByName(asked).unionByName(row(have, "has", "src", F.col("type"), "tgt"))
    # blocks are small and their pairs many, so partitions of them are not put together
    begins = rows.repartition(2 * blocks(FROM), "from").groupBy("from").agg(F.collect_list(F.struct("kind", "name", "type", "others")).alias("begins"))
    above = parents.groupBy(of("chapter", TO).alias("to"), "node_id").agg(F.collect_list("chapter").alias("chapters"))
    ends = above.repartition(blocks(TO), "to").groupBy("to").agg(F.collect_list(F.struct("node_id", "chapters")).alias("ends"))
    met = begins.crossJoin(ends).select("begins", "ends")
    return met.mapInArrow(_block_edges, "src string, tgt string, type string").withColumns({"confidence": F.lit(0.7), "label": F.lit("aggregated")})


def analysis_queue(documents: DataFrame, states: DataFrame) -> DataFrame:
    """Documents (doc_id) to analyse, with their place (from 1) in the queue, in order of id: one after another."""
    return unprocessed(documents, states).withColumn("place", F.row_number().over(Window.orderBy("doc_id")))


def document_pairs(documents: DataFrame, anchors: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_a, doc_b, shared (nodes anchored in both) and edge_counts (map by type) of each pair of documents.

    An edge counts once for a pair when its ends are anchored in the two, either way round; pairs without any
    stay. The table of pairs grows with the square of the documents: that is its result.
    """
    docs = documents.select("doc_id").distinct()
    pairs = docs.select(F.col("doc_id").alias("doc_a")).join(docs.select(F.col("doc_id").alias("doc_b")), F.col("doc_a") < F.col("doc_b"))
    at = anchors.select("node_id", "doc_id").distinct().join(docs, "doc_id", "left_semi")
    sides = at.select("node_id", F.col("doc_id").alias("doc_a")).join(at.select("node_id", F.col("doc_id").alias("doc_b")), "node_id").filter("doc_a < doc_b")
    shared = sides.groupBy("doc_a", "doc_b").agg(F.count("*").alias("shared"))
    ends = edges.select("edge_id", "src", "tgt", "type").join(at.select(F.col("node_id").alias("src"), F.col("doc_id").alias("x")), "src").join(at.select(F.col("node_id").alias("tgt"), F.col("doc_id").alias("y")), "tgt").filter("x <> y")
    met = ends.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "edge_id", "type").distinct()
    counts = met.groupBy("doc_a", "doc_b", "type").agg(F.count("*").alias("n")).groupBy("doc_a", "doc_b").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("edge_counts"))
    out = pairs.join(shared, ["doc_a", "doc_b"], "left").join(counts, ["doc_a", "doc_b"], "left")
    return out.select("doc_a", "doc_b", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("edge_counts", F.create_map().cast("map<string,bigint>")).alias("edge_counts"))


def shared_summary(pairs: DataFrame) -> DataFrame:
    """doc_id, other, shared of each document's pairs that share nodes."""
    both = pairs.select(F.col("doc_a").alias("doc_id"), F.col("doc_b").alias("other"), "shared").unionByName(pairs.select(F.col("doc_b").alias("doc_id"), F.col("doc_a").alias("other"), "shared"))
    return both.filter("shared > 0").orderBy("doc_id", F.col("shared").desc(), "other")


def top_by_degree(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, k: int = 8) -> DataFrame:
    """Each document's k concepts of the highest degree, with a bullet for each; ties by id."""
    ranked = nodes.filter("level = 'concept'").join(degrees(edges), "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    ranked = ranked.join(anchors.select("node_id", "doc_id").distinct(), "node_id")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("degree").desc(), "node_id"))
    bullet = F.concat(F.lit("- "), "label", F.coalesce(F.concat(F.lit(": "), "summary"), F.lit("")))
    return ranked.withColumn("place", place).filter(F.col("place") <= k).select("doc_id", "place", "node_id", "degree", bullet.alias("bullet"))


def node_details(node: str, nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """A node's first 3 anchors, 5 relations and 5 containments: kind, place, text, direction."""
    top = lambda rows, n: rows.orderBy("place").limit(n)
    first = top(anchors.filter(F.col("node_id") == node).select(F.lit("anchor").alias("kind"), F.col("ord").alias("place"), F.concat_ws(" p. ", "doc_id", (F.col("page") + 1).cast("string")).alias("text"), F.lit(None).cast("string").alias("direction")), 3)
    mine = incident(edges.filter((F.col("src") == node) | (F.col("tgt") == node))).filter(F.col("node_id") == node).join(nodes.select(F.col("node_id").alias("other"), "label"), "other")
    mine = mine.withColumn("holds", F.col("type").isin(*CONTAINMENT_TYPES))
    place = F.row_number().over(Window.partitionBy("holds").orderBy("edge_id"))
    met = mine.withColumn("place", place).filter("place <= 5")
    kind, direction = F.when(F.col("holds"), "containment").otherwise("relation"), F.when(F.col("holds"), F.when(F.col("outward"), "Contains").otherwise("In")).otherwise(F.when(F.col("outward"), "to").otherwise("from"))
    return first.unionByName(met.select(kind.alias("kind"), "place", F.col("label").alias("text"), direction.alias("direction")))
