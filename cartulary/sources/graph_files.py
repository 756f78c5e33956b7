"""Graph files: envelopes, staleness, lossy decoding, scoped writing, sweeping, cached responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.text import sha_prefix
from cartulary.schema import EDGE_TYPES

NODE_JSON = "struct<node_id:string,label:string,type:string,summary:string,reading_state:string,expansion_state:string,confidence:double,is_pinned:boolean,level:string,color_index:int,last_modified:timestamp>"
EDGE_JSON = "struct<edge_id:string,src:string,tgt:string,type:string,confidence:double,label:string>"
GRAPH_JSON = f"struct<nodes:array<{NODE_JSON}>,edges:array<{EDGE_JSON}>,documentProcessingState:map<string,string>>"
#: Seconds that a file's time may differ from the envelope's.
DRIFT = 1.0


def file_of(url: Column) -> Column:
    return F.concat(sha_prefix(url), F.lit(".json"))


def fresh_payloads(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Stored payloads whose document is as it was: url, payload.

    stored: url, mtime, size, payload; files: url, file_mtime, file_size. Either side null: that check is skipped.
    """
    met = stored.join(files, "url", "left")
    moved = F.coalesce(F.abs(F.col("mtime") - F.col("file_mtime")) > DRIFT, F.lit(False))
    resized = F.coalesce(F.col("size") != F.col("file_size"), F.lit(False))
    return met.filter(~moved & ~resized).select("url", "payload")


def read_graph_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of one graph each: path, payload. An envelope's payload is base64; a file without envelope is the payload itself."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    envelope = F.from_json("value", "mtime double, size bigint, payload string")
    return raw.withColumn("e", envelope).select("file", "e.mtime", "e.size", F.coalesce(F.unbase64("e.payload").cast("string"), F.col("value")).alias("payload"))


def _whole_edge(e: Column) -> Column:
    return e["edge_id"].isNotNull() & e["src"].isNotNull() & e["tgt"].isNotNull() & e["confidence"].isNotNull() & F.coalesce(e["type"].isin(*EDGE_TYPES), F.lit(False))


def decoded(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and states of payload files (key, payload). A file with a bad node goes whole; bad edges go one by one."""
    parsed = payloads.select("key", F.from_json("payload", GRAPH_JSON).alias("g")).filter("g.nodes is not null")
    whole = F.forall("g.nodes", lambda x: x["node_id"].isNotNull() & x["label"].isNotNull() & x["type"].isNotNull() & x["level"].isNotNull() & x["confidence"].isNotNull())
    good = parsed.filter(whole)
    nodes = good.select("key", F.explode("g.nodes").alias("x")).select("key", "x.*").withColumn("last_modified", F.coalesce("last_modified", F.current_timestamp()))
    edges = good.select("key", F.explode(F.filter("g.edges", _whole_edge)).alias("x")).select("key", "x.*")
    states = good.select("key", F.explode("g.documentProcessingState").alias("doc_id", "state"))
    return nodes, edges, states


def scoped(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, doc: Column | str) -> tuple[DataFrame, DataFrame]:
    """Nodes anchored in a document, and the edges with both ends among them."""
    mine = anchors.filter(F.col("doc_id") == doc).select("node_id").distinct()
    kept = nodes.join(mine, "node_id", "left_semi")
    return kept, induced(kept, edges)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    src, tgt = nodes.select(F.col("node_id").alias("src")), nodes.select(F.col("node_id").alias("tgt"))
    return edges.join(src, "src", "left_semi").join(tgt, "tgt", "left_semi")


def scoped_all(nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document's nodes and edges in one pass, with doc_id: what a write partitioned by doc_id takes."""
    mine = anchors.select("doc_id", "node_id").distinct()
    kept = mine.join(nodes, "node_id")
    src, tgt = mine.select("doc_id", F.col("node_id").alias("src")), mine.select("doc_id", F.col("node_id").alias("tgt"))
    return kept, edges.join(src, "src").join(tgt, ["doc_id", "tgt"], "left_semi")


def write_scoped(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, path: str) -> None:
    """One folder for each document."""
    kept, met = scoped_all(nodes, edges, anchors)
    kept.write.partitionBy("doc_id").mode("overwrite").parquet(f"{path}/nodes")
    met.write.partitionBy("doc_id").mode("overwrite").parquet(f"{path}/edges")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The whole graph as one JSON text: nodes and edges by id. For graphs of a size that one text can hold."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("node_id", *[c for c in nodes.columns if c != "node_id"]))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("edge_id", *[c for c in edges.columns if c != "edge_id"]))).alias("edges"))
    return n.join(e).select(F.to_json(F.struct("edges", "nodes")).alias("json"))


def orphans(files: DataFrame, alive: DataFrame) -> DataFrame:
    """Graph files (column file) of no URL that is alive; caches and audits, by their names, stay."""
    swept = files.filter(F.col("file").endswith(".json") & ~F.col("file").startswith("embeddings_") & ~F.col("file").startswith("etr_audit_"))
    return swept.join(alive.select(file_of(F.col("url")).alias("file")).distinct(), "file", "left_anti")


def alive_urls(files: DataFrame) -> DataFrame:
    """url: each file's resolved URL and its last known path."""
    return files.select(F.col("resolved").alias("url")).union(files.select(F.col("last_path"))).filter("url is not null").distinct()


def cache_key(model: Column, prompt: Column) -> Column:
    return sha_prefix(F.concat_ws(":", model, prompt))


def cached_responses(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Prompts (model, prompt) with key, response where the cache (key, response) has one, and hit."""
    keyed = prompts.withColumn("key", cache_key(F.col("model"), F.col("prompt")))
    return keyed.join(cache, "key", "left").withColumn("hit", F.col("response").isNotNull())


def unmarked(annotations: DataFrame, tracked: DataFrame, prefix: str) -> DataFrame:
    """Annotations (doc_id, key, contents) less those tracked for their document, or, where none is tracked, those marked by the prefix."""
    known = tracked.select("doc_id").distinct().withColumn("known", F.lit(True))
    rest = annotations.join(tracked.select("doc_id", "key"), ["doc_id", "key"], "left_anti").join(known, "doc_id", "left")
    return rest.filter(F.coalesce("known", ~F.coalesce(F.col("contents").startswith(prefix), F.lit(False)))).drop("known")
