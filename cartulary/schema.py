"""Tables of the knowledge graph and their closed domains.

nodes, edges and anchors are flat tables; a node's anchors are rows with an ordinal, so that a
filter on a document prunes and joins. Every choice of a first row has an order that ends in an id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "node_id string, label string, type string, summary string, reading_state string, expansion_state string, confidence double, is_pinned boolean, pos struct<x:double,y:double>, level string, color_index int, last_modified timestamp"
EDGES = "edge_id string, src string, tgt string, type string, confidence double, label string"
ANCHORS = "node_id string, ord int, doc_id string, page int, bbox struct<x:double,y:double,w:double,h:double>, snippet string"
DOC_STATES = "doc_id string, state string"

# Closed domains of the data model.
LEVELS = ("document", "chapter", "concept", "entity")
CONCEPT_TYPES = ("concept", "definition", "theorem", "example", "claim", "person", "dataset", "method", "result", "equation")
CONCEPT_LEVEL_TYPES = ("concept", "theorem", "method", "claim")
RELATION_TYPES = ("dependsOn", "contradicts", "exampleOf", "defines", "extends", "cites", "sameTopic", "partOf", "uses")
CONTAINMENT_TYPES = ("containsChapter", "containsConcept", "containsEntity")
EDGE_TYPES = RELATION_TYPES + CONTAINMENT_TYPES
EDGE_NAMES = {"dependsOn": "Depends On", "contradicts": "Contradicts", "exampleOf": "Example Of", "defines": "Defines", "extends": "Extends", "cites": "Cites", "sameTopic": "Same Topic", "partOf": "Part Of", "uses": "Uses"} | dict.fromkeys(CONTAINMENT_TYPES, "Contains")
READING_STATES = ("unseen", "visited", "highlighted", "annotated")
EXPANSION_STATES = ("collapsed", "expanded", "autoCollapsed")
PROCESSING_STATES = ("unprocessed", "processing", "partial", "complete", "failed")
MERGE_TYPES = ("exactMatch", "semanticEquivalent", "partialOverlap")
PALETTE_SIZE = 12


def is_containment(edge_type: Column) -> Column:
    return edge_type.isin(*CONTAINMENT_TYPES)


def edge_name(edge_type: Column) -> Column:
    return reduce(lambda acc, kv: F.when(edge_type == kv[0], F.lit(kv[1])).otherwise(acc), EDGE_NAMES.items(), edge_type)


def type_name(node_type: Column) -> Column:
    """The display name of a node type: its name capitalised."""
    return F.initcap(node_type)


def default_level(node_type: Column) -> Column:
    return F.when(node_type.isin(*CONCEPT_LEVEL_TYPES), F.lit("concept")).otherwise(F.lit("entity"))


def lenient(value: Column, domain: tuple[str, ...], default: str) -> Column:
    """value where it is in the domain, by exact case; else the default."""
    return F.when(value.isin(*domain), value).otherwise(F.lit(default))


def node_identity(level: Column, doc: Column, label: Column) -> Column:
    """The same node gets the same id in any run."""
    return F.left(F.sha2(F.concat_ws("|", level, doc, F.lower(label)), 256), F.lit(32))


def one_level(nodes: DataFrame, level: str) -> DataFrame:
    return nodes.filter(F.col("level") == level)
