"""From a model's answers to nodes, anchors and edges.

concepts: doc_id, batch, ord, entity_ord (null for a concept; its entities carry the concept's ord), label, type, summary,
span, confidence. Order, wherever one counts, is (doc_id, batch, ord, entity_ord with the concept first).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.functions.json_repair import repair
from cartulary.functions.text import normalised, ordered_join
from cartulary.schema import CONCEPT_TYPES, CONTAINMENT_TYPES, EDGE_TYPES, PALETTE_SIZE, lenient, node_identity
from cartulary.tables import stored

ENTITY = "struct<label:string,type:string,summary:string,textSpan:string,confidence:double>"
CONCEPT = f"struct<label:string,type:string,summary:string,textSpan:string,confidence:double,entities:array<{ENTITY}>>"
RESPONSE = f"struct<concepts:array<{CONCEPT}>>"
RELATION = "struct<sourceLabel:string,targetLabel:string,type:string,confidence:double,linkingPhrase:string>"
MERGE = "array<struct<labelA:string,labelB:string,confidence:double,reason:string,mergeType:string>>"
CHAPTERS = "struct<chapters:array<struct<title:string,pageStart:int,pageEnd:int>>>"
ANSWER = "struct<answer:string,citations:array<struct<text:string,pageIndex:int>>>"
FACTS = "struct<facts:array<struct<claim:string,textSpan:string,type:string,confidence:double>>>"
CLUSTERS = "struct<concepts:array<struct<label:string,type:string,summary:string,level:string,factIndices:array<int>,entities:array<struct<label:string,type:string,summary:string,factIndices:array<int>>>>>>"
#: Code points of a span that become a snippet, and those that a prefix match takes.
SNIPPET, PREFIX = 200, 30
#: Pages whose blocks stand in one row.
PAGES = 5


def concepts_of(responses: DataFrame) -> DataFrame:
    """Concepts and entities of responses (doc_id, batch, response), repaired first. Elements without label or span go one by one."""
    parsed = responses.select("doc_id", "batch", F.from_json(repair("response"), RESPONSE).alias("r"))
    each = parsed.select("doc_id", "batch", F.posexplode("r.concepts").alias("ord", "c")).filter("c.label is not null and c.textSpan is not null")
    # a concept and its entities come from one reading of the response
    row = lambda x, at: F.struct(at.cast("int").alias("entity_ord"), x["label"].alias("label"), x["type"].alias("type"), x["summary"].alias("summary"), x["textSpan"].alias("span"), x["confidence"].alias("confidence"))
    inner = F.coalesce(F.transform("c.entities", lambda e, i: row(e, i)), F.array())
    rows = each.select("doc_id", "batch", "ord", F.inline(F.concat(F.array(row(F.col("c"), F.lit(None))), inner))).filter("label is not null and span is not null")
    is_entity = F.col("entity_ord").isNotNull()
    kind = F.when(is_entity, lenient(F.col("type"), CONCEPT_TYPES, "definition")).otherwise(lenient(F.col("type"), CONCEPT_TYPES, "concept"))
    return rows.withColumns({"type": kind, "level": F.when(is_entity, "entity").otherwise("concept"), "confidence": F.coalesce("confidence", F.lit(0.8))})


def relations_of(responses: DataFrame) -> DataFrame:
    """Relations of responses, a bare array or an object with edges: doc_id, batch, ord, source, target, type, confidence, phrase."""
    text = repair("response")
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<{RELATION}>")).otherwise(F.from_json(text, f"struct<edges:array<{RELATION}>>")["edges"])
    each = responses.select("doc_id", "batch", F.posexplode(listed).alias("ord", "e")).filter("e.sourceLabel is not null and e.targetLabel is not null")
    return each.select("doc_id", "batch", "ord", F.col("e.sourceLabel").alias("source"), F.col("e.targetLabel").alias("target"), lenient(F.col("e.type"), EDGE_TYPES, "sameTopic").alias("type"), F.coalesce("e.confidence", F.lit(0.7)).alias("confidence"), F.col("e.linkingPhrase").alias("phrase"))


def merges_of(responses: DataFrame) -> DataFrame:
    """Proposed merges; a response that can't be read gives none."""
    each = responses.select("doc_id", F.posexplode(F.from_json(repair("response"), MERGE)).alias("ord", "m"))
    return each.select("doc_id", "ord", "m.*").filter("labelA is not null and labelB is not null").withColumn("mergeType", F.coalesce("mergeType", F.lit("semanticEquivalent")))


def chapters_of(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposed chapters (doc_id, ord, title, page_start, page_end) of responses, and the documents whose response can be read."""
    parsed = responses.select("doc_id", F.from_json(repair("response"), CHAPTERS)["chapters"].alias("c")).filter("c is not null")
    each = parsed.select("doc_id", F.posexplode("c").alias("ord", "x")).filter("x.title is not null and x.pageStart is not null and x.pageEnd is not null")
    return each.select("doc_id", "ord", "x.title", F.col("x.pageStart").alias("page_start"), F.col("x.pageEnd").alias("page_end")), parsed.select("doc_id").distinct()


def first_concepts(nodes: DataFrame, most: int = 50) -> DataFrame:
    """The one list of labels, in order of node_id, of the first `most` concepts: what a model is shown of a graph."""
    first = nodes.filter("level = 'concept'").orderBy("node_id").limit(most)
    return first.agg(ordered_join(F.col("node_id"), F.col("label"), "; ").alias("labels"))


def merge_prompt(fresh: DataFrame, project: DataFrame, most: int = 50) -> DataFrame:
    """The one prompt that asks which of the first concepts of two graphs are one thing; none if either has none."""
    a, b = (first_concepts(df, most).filter("labels <> ''").select(F.col("labels").alias(name)) for df, name in ((fresh, "a"), (project, "b")))
    return a.join(b).select(prompt(PROMPTS["merges"], a=F.col("a"), b=F.col("b")).alias("prompt"))


def resolve_anchors(spans: DataFrame, blocks: DataFrame, pages: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """span_id, tier, page, line_no, snippet: where a span stands; spans that stand nowhere go.

    spans: span_id, doc_id, page_lo, page_hi, span; blocks: doc_id, page, line_no, text; pages: doc_id, page, text.
    The first that holds wins: the whole span in a block of its batch, its first 30 code points in such
    a block, those on any page of the document. Blocks of PAGES pages stand in one row, which a span meets once; other joins go by
    doc_id, the rest is a residual test. tables: gets the paths of tables that the result reads, to be discarded when it has been read.
    """
    whole = normalised(F.col("span"))
    part = lambda page: F.floor(page / PAGES).cast("int")
    packed = blocks.groupBy("doc_id", part(F.col("page")).alias("part")).agg(F.collect_list(F.struct("page", "line_no", F.lower("text").alias("line"))).alias("lines"))
    by_part = spans.filter("page_lo < page_hi").withColumn("part", F.explode(F.sequence(part(F.col("page_lo")), part(F.col("page_hi") - 1))))
    met = by_part.join(packed, ["doc_id", "part"]).select("span_id", "page_lo", "page_hi", F.left("span", F.lit(SNIPPET)).alias("snippet"), whole.alias("whole"), "lines").withColumn("prefix", F.left("whole", F.lit(PREFIX)))
    near = F.filter("lines", lambda x: (x["page"] >= F.col("page_lo")) & (x["page"] < F.col("page_hi")) & F.contains(x["line"], F.col("prefix")))
    best = F.array_min(F.transform(near, lambda x: F.struct(F.when(F.contains(x["line"], F.col("whole")), 1).otherwise(2).alias("tier"), x["page"].alias("page"), x["line_no"].alias("line_no"), F.col("snippet").alias("span"))))
    # a filter on what is found would search twice, so spans found nowhere go after they are grouped
    found = met.groupBy("span_id").agg(F.min(F.when(F.col("whole") != "", best)).alias("b")).filter("b is not null")
    in_block, at = stored(found, "anchors")
    # only what stands in no block of its batch meets the pages of its document: its ids first, which are few as a rule
    missing, ids_at = stored(spans.select("span_id").join(in_block.select("span_id"), "span_id", "left_anti"), "missing")
    rest, rest_at = stored(spans.join(missing, "span_id", "left_semi").withColumn("prefix", F.left(whole, F.lit(PREFIX))).filter("prefix <> ''").select("span_id", "doc_id", "prefix", F.left("span", F.lit(SNIPPET)).alias("span")), "rest")
    if tables is not None:
        tables += [at, ids_at, rest_at]
    on_page = rest.join(pages.select("doc_id", "page", F.lower("text").alias("line")), "doc_id").filter(F.contains("line", "prefix"))
    anywhere = on_page.groupBy("span_id").agg(F.min(F.struct(F.lit(3).alias("tier"), "page", F.lit(-1).alias("line_no"), "span")).alias("b"))
    best = in_block.unionByName(anywhere)
    return best.select("span_id", "b.tier", "b.page", "b.line_no", F.col("b.span").alias("snippet"))


def upsert_labels(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes and anchors of rows by lower-case label: the first row gives label, type, level and confidence, all rows anchors.

    rows: label, type, summary, level, confidence, doc_id, page, snippet, and the order columns (one total order).
    The summary is the first that isn't null. A label is one node on all levels and in all documents.
    """
    place = F.struct(*order)
    first = F.min_by(F.struct("label", "type", "level", "confidence", "doc_id"), place)
    summary = F.min_by("summary", F.when(F.col("summary").isNotNull(), place))
    grouped = rows.groupBy(F.lower("label").alias("key")).agg(first.alias("f"), summary.alias("summary"), F.min(place).alias("place"))
    node_id = node_identity(F.lit("node"), F.lit(""), F.col("key"))
    nodes = grouped.select(node_id.alias("node_id"), F.col("f.label").alias("label"), F.col("f.type").alias("type"), F.col("f.level").alias("level"), F.col("f.confidence").alias("confidence"), "summary", "place")
    ordinal = F.row_number().over(Window.partitionBy(F.lower("label")).orderBy(*order)) - 1
    anchors = rows.select(node_identity(F.lit("node"), F.lit(""), F.lower("label")).alias("node_id"), ordinal.alias("ord"), "doc_id", "page", "snippet")
    return nodes, anchors


def coloured(nodes: DataFrame, holds: DataFrame | None = None) -> DataFrame:
    """Concepts with colours in turn, in the order of their places over the whole graph; entities with the colour of their first concept.

    nodes: with place, a struct that begins with doc_id; holds: containsEntity edges (src, tgt, edge_id).
    """
    concepts = nodes.filter("level = 'concept'").select("node_id", "place", F.col("place.doc_id").alias("doc_id"))
    # documents are counted through in order, a row each; a document's concepts within it
    counts = concepts.groupBy("doc_id").agg(F.count("*").alias("n"))
    before = counts.select("doc_id", F.coalesce(F.sum("n").over(Window.orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    own = concepts.withColumn("turn", turn).join(before, "doc_id").select("node_id", F.pmod(F.col("turn") + F.col("before"), F.lit(PALETTE_SIZE)).cast("int").alias("color_index"))
    if holds is not None:
        first = holds.groupBy(F.col("tgt").alias("entity")).agg(F.min_by("src", "edge_id").alias("node_id"))
        of_entities = first.join(own, "node_id").join(nodes.filter("level = 'entity'").select(F.col("node_id").alias("entity")), "entity").select(F.col("entity").alias("node_id"), "color_index")
        own = own.unionByName(of_entities)
    return nodes.join(own, "node_id", "left")


def end_points(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with the nodes of their labels; those of unknown labels go. Of nodes with one label, the last id counts."""
    known = nodes.groupBy(F.lower("label").alias("key")).agg(F.max("node_id").alias("id"))
    src, tgt = known.select(F.col("key").alias("s"), F.col("id").alias("src")), known.select(F.col("key").alias("t"), F.col("id").alias("tgt"))
    return relations.join(src, F.lower("source") == F.col("s")).join(tgt, F.lower("target") == F.col("t")).drop("s", "t")


def insert_relations(relations: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """New edges by the guard of the fast mode: the first for a source and target, if no edge goes there yet and no entity is contained the other way.

    relations: src, tgt, type, confidence, phrase and the order columns. Containment is never taken from a model.
    """
    taken = edges.select("src", "tgt").union(edges.filter("type = 'containsEntity'").select("tgt", "src")).distinct()
    free = relations.join(taken, ["src", "tgt"], "left_anti")
    fields = F.struct("type", "confidence", "phrase")
    first = free.groupBy("src", "tgt").agg(F.min_by(fields, F.struct(*order)).alias("f")).select("src", "tgt", "f.type", "f.confidence", F.col("f.phrase").alias("label"))
    return first.filter(~F.col("type").isin(*CONTAINMENT_TYPES))


def insert_relations_deep(relations: DataFrame, edges: DataFrame, order: list[str]) -> DataFrame:
    """New edges by the guard of the deep mode: the first between two nodes, if none is there in either direction. No label."""
    both = lambda df: df.withColumns({"lo": F.least("src", "tgt"), "hi": F.greatest("src", "tgt")})
    free = both(relations).join(both(edges).select("lo", "hi").distinct(), ["lo", "hi"], "left_anti")
    first = free.groupBy("lo", "hi").agg(F.min_by(F.struct("src", "tgt", "type", "confidence"), F.struct(*order)).alias("f")).select("f.*")
    return first.filter(~F.col("type").isin(*CONTAINMENT_TYPES)).withColumn("label", F.lit(None).cast("string"))


def fact_anchors(clusters: DataFrame, facts: DataFrame) -> DataFrame:
    """Anchors of clusters by the ordinals of their facts: the first fact of each page, in the cluster's order.

    clusters: cluster_id, fact_indices; facts: ord, doc_id, page_lo, span. Ordinals of no fact go.
    """
    each = clusters.select("cluster_id", F.posexplode("fact_indices").alias("pos", "ord"))
    met = each.join(facts, "ord")
    first = met.groupBy("cluster_id", F.col("page_lo").alias("page")).agg(F.min(F.struct("pos", "doc_id", "span")).alias("f"))
    ordinal = F.row_number().over(Window.partitionBy("cluster_id").orderBy("f.pos")) - 1
    return first.select("cluster_id", ordinal.alias("ord"), "f.doc_id", "page", F.left("f.span", F.lit(SNIPPET)).alias("snippet"))


def clusters_of(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters and their entities of responses (doc_id, response), and the documents that have an answer.

    clusters: doc_id, ord, entity_ord (-1 for a concept), label, type, summary, fact_indices. Elements without label or indices go one by one;
    a response of which nothing is left is no answer, unless its list is empty.
    """
    parsed = responses.select("doc_id", F.from_json(repair("response"), CLUSTERS)["concepts"].alias("c"))
    whole = lambda x: x["label"].isNotNull() & x["factIndices"].isNotNull()
    answered = parsed.filter((F.size("c") == 0) | F.exists("c", whole)).filter(F.col("c").isNotNull()).select("doc_id").distinct()
    each = parsed.select("doc_id", F.posexplode("c").alias("ord", "c")).filter(whole(F.col("c")))
    fields = lambda x, default: [x["label"].alias("label"), lenient(x["type"], CONCEPT_TYPES, default).alias("type"), x["summary"].alias("summary"), x["factIndices"].alias("fact_indices")]
    own = each.select("doc_id", "ord", F.lit(-1).alias("entity_ord"), *fields(F.col("c"), "concept"))
    inner = each.select("doc_id", "ord", F.posexplode("c.entities").alias("entity_ord", "e")).filter(whole(F.col("e")))
    return own.unionByName(inner.select("doc_id", "ord", "entity_ord", *fields(F.col("e"), "definition"))), answered


def cluster_rows(clusters: DataFrame, facts: DataFrame) -> DataFrame:
    """clusters with the anchors of their facts (anchor_ord, page, snippet), a row each; those without anchors go, a concept with its entities.

    facts: doc_id, fact (ordinal in the document), page, span. An entity's summary counts only where it brings its label.
    """
    named = clusters.withColumn("cluster_id", F.concat_ws("|", "doc_id", F.col("ord").cast("string"), F.col("entity_ord").cast("string")))
    key = lambda fact: F.concat_ws("|", "doc_id", fact.cast("string"))
    at = fact_anchors(named.select("cluster_id", F.transform("fact_indices", key).alias("fact_indices")), facts.select(key(F.col("fact")).alias("ord"), "doc_id", F.col("page").alias("page_lo"), "span"))
    rows = named.join(at.select("cluster_id", F.col("ord").alias("anchor_ord"), "page", "snippet"), "cluster_id").drop("cluster_id", "fact_indices")
    rows = rows.join(rows.filter("entity_ord < 0").select("doc_id", "ord").distinct(), ["doc_id", "ord"], "left_semi")
    entity = F.col("entity_ord") >= 0
    place = F.row_number().over(Window.partitionBy(F.lower("label")).orderBy("doc_id", "ord", "entity_ord", "anchor_ord"))
    rows = rows.withColumn("place", place).withColumn("summary", F.when(~entity | (F.col("place") == 1), F.col("summary"))).drop("place")
    return rows.withColumns({"level": F.when(entity, "entity").otherwise("concept"), "confidence": F.when(entity, 0.85).otherwise(0.9)})


def containment(parents: DataFrame, edge_type: str, existing: DataFrame) -> DataFrame:
    """Edges src, tgt of one type that aren't there yet."""
    return parents.select("src", "tgt").distinct().withColumn("type", F.lit(edge_type)).join(existing.select("src", "tgt", "type"), ["src", "tgt", "type"], "left_anti")


def prompt(template: str, **parts: Column) -> Column:
    """A prompt: the template with {name} for columns."""
    pieces: list[Column] = [F.lit(template)]
    return reduce(lambda acc, kv: F.replace(acc, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), parts.items(), pieces[0])


#: Our own wording of what a model is asked.
PROMPTS = {
    "extract": "List the concepts of this text as JSON {\"concepts\": [...]}, each with label, type, summary, textSpan (a literal quotation), confidence and entities.\nDocument: {title}\nPages: {pages}\nKnown labels: {labels}\nOutline: {outline}\n\n{text}",
    "relations": "Which of these labels relate? Answer as a JSON array of sourceLabel, targetLabel, type, confidence, linkingPhrase.\nLabels: {labels}\nDocument: {title}",
    "merges": "Which labels of A and B name one thing? Answer as a JSON array of labelA, labelB, confidence, reason, mergeType.\nA: {a}\nB: {b}",
    "facts": "List the facts of this text as JSON {\"facts\": [...]}, each with claim, textSpan, type and confidence.\n\n{text}",
    "clusters": "Group these numbered facts of {title} into concepts with entities, as JSON {\"concepts\": [...]} with factIndices.\n\n{facts}",
    "cross": "Which of these concepts relate? Answer as a JSON array of sourceLabel, targetLabel, type, confidence.\n\n{labels}",
    "summary": "Sum up {label} in one sentence.\n\n{text}",
    "answer": "Answer from the context, as JSON with answer and citations (text, pageIndex).\n\n{context}\n\nQuestion: {question}",
    "chapters": "Divide this document of {pages} pages into chapters, as JSON {\"chapters\": [...]} with title, pageStart and pageEnd (from 0, both included).\n\n{text}",
}
