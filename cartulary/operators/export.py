"""Exports of a graph as Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import ordered_join, percent
from cartulary.operators.graph import incident
from cartulary.schema import edge_name, type_name


def _edge_lines(nodes: DataFrame, edges: DataFrame, link: tuple[str, str]) -> DataFrame:
    """node_id and its incident edges as lines, by edge id."""
    met = incident(edges).join(nodes.select(F.col("node_id").alias("other"), "label"), "other")
    line = F.concat(F.lit("- "), edge_name(F.col("type")), F.lit(": " + link[0]), "label", F.lit(link[1]))
    return met.groupBy("node_id").agg(ordered_join(F.col("edge_id"), line, "\n").alias("edge_lines"))


def markdown_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, label and the section of each node."""
    met = nodes.join(_edge_lines(nodes, edges, ("", "")), "node_id", "left")
    head = F.concat(F.lit("### "), "label", F.lit("\n"), type_name(F.col("type")), F.lit(" | Confidence: "), percent(F.col("confidence")).cast("string"), F.lit("%\n"))
    return met.select("node_id", "label", F.concat(head, F.coalesce(F.concat("summary", F.lit("\n")), F.lit("")), F.coalesce("edge_lines", F.lit(""))).alias("section"))


def markdown(nodes: DataFrame, edges: DataFrame, title: str) -> DataFrame:
    """The whole export as one text: counts, then the sections by label. For graphs of a size that one text can hold."""
    sections = markdown_nodes(nodes, edges).agg(ordered_join(F.struct("label", "node_id"), F.col("section"), "\n\n").alias("body"), F.count("*").alias("n"))
    count = edges.agg(F.count("*").alias("m"))
    return sections.join(count).select(F.concat(F.lit(f"# {title}\n"), F.col("n").cast("string"), F.lit(" nodes, "), F.col("m").cast("string"), F.lit(" edges\n\n"), "body").alias("document"))


def linked_notes(nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """type, label, node_id and the note of each node, with double-bracket links and places; to be written by type and label."""
    places = anchors.groupBy("node_id").agg(ordered_join(F.col("ord"), F.concat(F.lit("- "), F.element_at(F.split("doc_id", "/"), -1), F.lit(", page "), (F.col("page") + 1).cast("string")), "\n").alias("places"))
    met = nodes.join(_edge_lines(nodes, edges, ("[[", "]]")), "node_id", "left").join(places, "node_id", "left")
    parts = F.filter(F.array(F.concat(F.lit("## "), "label"), F.col("summary"), F.col("edge_lines"), F.col("places")), lambda p: p.isNotNull())
    return met.select("type", "label", "node_id", F.array_join(parts, "\n").alias("note"))


def type_groups(nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """type and the text of its notes, by label: what is written as one file for each type."""
    return linked_notes(nodes, edges, anchors).groupBy("type").agg(ordered_join(F.struct("label", "node_id"), F.col("note"), "\n\n").alias("text"))
