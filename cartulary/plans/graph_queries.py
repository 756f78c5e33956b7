"""Queries over the fixture graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions.text import ordered_join
from cartulary.operators import fold, graph, layout, merge, search, sync
from cartulary.operators.export import linked_notes, markdown_nodes
from cartulary.operators.extract import insert_relations
from cartulary.operators.extract import insert_relations_deep as insert_deep
from cartulary.plans.fixtures import ANCHORS, EDGES, LARGE_LINES, NODES, Fixture, duck
from cartulary.plans.registry import query, with_tables
from cartulary.schema import CONTAINMENT_TYPES, EDGE_NAMES, one_level
from cartulary.sources.graph_files import induced, scoped_all

N, E, A = {"nodes": duck(NODES)}, {"edges": duck(EDGES)}, {"anchors": duck(ANCHORS)}
HOLDS = "type IN (" + ", ".join(f"'{t}'" for t in CONTAINMENT_TYPES) + ")"
EDGE_NAME = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EDGE_NAMES.items()) + " END"
INCIDENT = "SELECT src AS node_id, edge_id, tgt AS other, type, true AS outward FROM edges UNION ALL SELECT tgt, edge_id, src, type, false FROM edges WHERE src <> tgt"
DEGREE = f"SELECT node_id, count(DISTINCT edge_id) AS degree FROM ({INCIDENT}) GROUP BY node_id"


@query(
    with_tables(
        """SELECT DISTINCT a.src AS src, b.src AS tgt, r.type AS type, 0.7::DOUBLE AS confidence, 'aggregated' AS label
FROM edges r JOIN edges a ON a.type = 'containsConcept' AND a.tgt = r.src JOIN edges b ON b.type = 'containsConcept' AND b.tgt = r.tgt
WHERE NOT r.type LIKE 'contains%' AND a.src <> b.src AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.src = a.src AND x.tgt = b.src AND x.type = r.type)""",
        **E,
    )
)
def chapter_edge_aggregation(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return graph.chapter_edges(g.nodes, g.edges)


@query(with_tables("SELECT node_id, label, type, confidence, confidence < 0.6 AS low FROM nodes WHERE level = 'concept'", **N))
def nodes_at_level(spark, sf_dir):
    return one_level(Fixture(spark, sf_dir).nodes, "concept").select("node_id", "label", "type", "confidence", (F.col("confidence") < 0.6).alias("low"))


@query(with_tables("SELECT node_id, label FROM nodes WHERE node_id IN (SELECT node_id FROM anchors WHERE doc_id = 'd1')", **N, **A))
def nodes_for_document(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return graph.nodes_of_document(g.nodes, g.anchors, "d1").select("node_id", "label")


@query(with_tables("SELECT node_id, label FROM nodes WHERE node_id IN (SELECT node_id FROM anchors WHERE doc_id = 'd2' AND page = 7)", **N, **A))
def nodes_on_page(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return graph.nodes_on_page(g.nodes, g.anchors, "d2", 7).select("node_id", "label")


@query(with_tables("SELECT node_id, level FROM nodes WHERE lower(label) = 'france'", **N))
def label_lookup(spark, sf_dir):
    return graph.with_label(Fixture(spark, sf_dir).nodes, "France").select("node_id", "level")


@query(with_tables("SELECT edge_id, src, tgt, type FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE level IN ('chapter', 'concept')) AND tgt IN (SELECT node_id FROM nodes WHERE level IN ('chapter', 'concept'))", **N, **E))
def induced_subgraph(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return induced(g.nodes.filter("level in ('chapter', 'concept')"), g.edges).select("edge_id", "src", "tgt", "type")


@query(with_tables(INCIDENT, **E))
def incident_edges(spark, sf_dir):
    return graph.incident(Fixture(spark, sf_dir).edges)


@query(with_tables(f"SELECT i.node_id, i.other AS neighbour, n.label AS neighbour_label FROM ({INCIDENT}) i JOIN nodes n ON n.node_id = i.other", **N, **E))
def neighbors(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return graph.neighbours(g.edges, g.nodes).select("node_id", "neighbour", "neighbour_label")


@query(with_tables(f"SELECT src AS parent, tgt AS child FROM edges WHERE {HOLDS}", **E))
def contained_children(spark, sf_dir):
    return graph.contained(Fixture(spark, sf_dir).edges)


@query(with_tables(f"SELECT node_id, level FROM nodes WHERE node_id IN (SELECT src FROM edges WHERE {HOLDS})", **N, **E))
def has_children(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return graph.having_children(g.nodes, g.edges).select("node_id", "level")


@query(with_tables("SELECT tgt AS child, arg_min(src, edge_id) AS parent FROM edges WHERE type = 'containsEntity' GROUP BY tgt", **E))
def first_parent(spark, sf_dir):
    return graph.first_parent(Fixture(spark, sf_dir).edges, "containsEntity")


@query(with_tables(DEGREE, **E))
def degree(spark, sf_dir):
    return graph.degrees(Fixture(spark, sf_dir).edges)


@query(with_tables("SELECT src AS node_id, count(*) AS entities FROM edges WHERE type = 'containsEntity' GROUP BY src", **E))
def entity_count(spark, sf_dir):
    return graph.entity_counts(Fixture(spark, sf_dir).edges)


@query(with_tables("SELECT level, type, count(*) AS nodes FROM nodes GROUP BY level, type", **N))
def type_and_level_counts(spark, sf_dir):
    return Fixture(spark, sf_dir).nodes.groupBy("level", "type").agg(F.count("*").alias("nodes"))


@query(with_tables("SELECT node_id, count(DISTINCT doc_id) AS documents FROM anchors GROUP BY node_id HAVING count(DISTINCT doc_id) > 1", **A))
def multi_document_nodes(spark, sf_dir):
    return graph.multi_document(Fixture(spark, sf_dir).anchors)


@query(with_tables("SELECT doc_id, count(DISTINCT node_id) AS concepts FROM anchors GROUP BY doc_id", **A))
def concept_count_per_document(spark, sf_dir):
    return graph.concept_counts(Fixture(spark, sf_dir).anchors)


_PAIRS = {
    "docs": "SELECT DISTINCT concat('d', r_regionkey) AS doc_id FROM region",
    "stands": "SELECT DISTINCT node_id, doc_id FROM anchors",
    "pairs": "SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM docs a JOIN docs b ON a.doc_id < b.doc_id",
    "shared": "SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS n FROM stands a JOIN stands b ON a.node_id = b.node_id AND a.doc_id < b.doc_id GROUP BY ALL",
    "met": "SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_a, greatest(a.doc_id, b.doc_id) AS doc_b, edge_id, type FROM edges JOIN stands a ON a.node_id = src JOIN stands b ON b.node_id = tgt WHERE a.doc_id <> b.doc_id",
    "counted": "SELECT doc_a, doc_b, type AS edge_type, count(*) AS n FROM met GROUP BY ALL",
}


@query(with_tables("SELECT doc_a, doc_b, coalesce(s.n, 0) AS shared, c.edge_type, c.n FROM pairs LEFT JOIN shared s USING (doc_a, doc_b) LEFT JOIN counted c USING (doc_a, doc_b)", **E, **A, **_PAIRS))
def doc_pair_stats(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return graph.document_pairs(g.documents, g.anchors, g.edges).select("doc_a", "doc_b", "shared", F.explode_outer("edge_counts").alias("edge_type", "n"))


@query(with_tables("SELECT doc_a AS doc_id, doc_b AS other, n AS shared FROM shared UNION ALL SELECT doc_b, doc_a, n FROM shared", **E, **A, **_PAIRS))
def shared_concept_summary(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return graph.shared_summary(graph.document_pairs(g.documents, g.anchors, g.edges))


_STATES = "SELECT concat('o', o_custkey) AS doc_id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'failed' ELSE 'processing' END, (o_orderdate, o_orderkey)) AS state FROM orders GROUP BY o_custkey"


@query(f"SELECT concat('o', c_custkey) AS doc_id FROM customer LEFT JOIN ({_STATES}) s ON s.doc_id = concat('o', c_custkey) WHERE coalesce(state, 'unprocessed') IN ('unprocessed', 'failed')")
def unprocessed_documents(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    state = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "failed").otherwise("processing")
    states = g.table("orders").groupBy(F.concat(F.lit("o"), "o_custkey").alias("doc_id")).agg(F.max_by(state, F.struct("o_orderdate", "o_orderkey")).alias("state"))
    return graph.unprocessed(g.table("customer").select(F.concat(F.lit("o"), "c_custkey").alias("doc_id")), states)


@query(with_tables("SELECT node_id, label FROM nodes WHERE contains(lower(label), 'machin') OR contains(lower(coalesce(summary, '')), 'machin') OR contains(lower(type), 'machin')", **N))
def map_filter(spark, sf_dir):
    return search.map_filter(Fixture(spark, sf_dir).nodes, "Machin").select("node_id", "label")


@query(with_tables("SELECT node_id, label FROM nodes n WHERE contains(lower(label), 'd3 on 1') OR contains(lower(coalesce(summary, '')), 'd3 on 1') OR EXISTS (SELECT 1 FROM anchors a WHERE a.node_id = n.node_id AND contains(lower(snippet), 'd3 on 1'))", **N, **A))
def map_search(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return search.map_search(g.nodes, g.anchors, "D3 on 1").select("node_id", "label")


@query(with_tables("SELECT kind, title, target FROM (SELECT 0 AS o, 'node' AS kind, label AS title, node_id AS target FROM nodes WHERE contains(lower(label), '12') UNION ALL SELECT 1, 'page', 'Page 12', '11') ORDER BY o, title, target LIMIT 20", **N))
def command_palette(spark, sf_dir):
    return search.command_palette(Fixture(spark, sf_dir).nodes, "12")


@query(
    with_tables(
        f"""SELECT doc_id, place, node_id, degree, concat('- ', label, CASE WHEN summary IS NULL THEN '' ELSE concat(': ', summary) END) AS bullet FROM (
  SELECT a.doc_id, n.*, coalesce(g.degree, 0) AS degree, CAST(row_number() OVER (PARTITION BY a.doc_id ORDER BY coalesce(g.degree, 0) DESC, n.node_id) AS int) AS place
  FROM nodes n JOIN (SELECT DISTINCT node_id, doc_id FROM anchors) a USING (node_id) LEFT JOIN ({DEGREE}) g USING (node_id) WHERE level = 'concept') WHERE place <= 8""",
        **N, **E, **A,
    )
)
def top_concepts_by_degree(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return graph.top_by_degree(g.nodes, g.edges, g.anchors)


@query(
    with_tables(
        f"""SELECT 'anchor' AS kind, ord AS place, concat(doc_id, ' p. ', page + 1) AS text, NULL AS direction FROM anchors WHERE node_id = 'c7' AND ord < 3
UNION ALL SELECT kind, place, label, CASE WHEN kind = 'containment' THEN CASE WHEN outward THEN 'Contains' ELSE 'In' END ELSE CASE WHEN outward THEN 'to' ELSE 'from' END END FROM (
  SELECT CASE WHEN {HOLDS} THEN 'containment' ELSE 'relation' END AS kind, CAST(row_number() OVER (PARTITION BY {HOLDS} ORDER BY edge_id) AS int) AS place, label, outward
  FROM (SELECT i.*, n.label FROM ({INCIDENT}) i JOIN nodes n ON n.node_id = i.other WHERE i.node_id = 'c7')) WHERE place <= 5""",
        **N, **E, **A,
    )
)
def node_detail(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return graph.node_details("c7", g.nodes, g.edges, g.anchors)


_MINE = "SELECT DISTINCT doc_id, node_id FROM anchors"


@query(with_tables(f"SELECT a.doc_id, e.edge_id, e.src, e.tgt, e.type FROM edges e JOIN ({_MINE}) a ON a.node_id = e.src JOIN ({_MINE}) b ON b.node_id = e.tgt AND b.doc_id = a.doc_id", **E, **A))
def scoped_subgraph(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return scoped_all(g.nodes, g.edges, g.anchors)[1].select("doc_id", "edge_id", "src", "tgt", "type")


_CHAPTERS = "SELECT concat('d', n_regionkey) AS doc_id, concat('h', n_nationkey) AS node_id, CAST(n_nationkey * 7 % 38 AS int) AS page_start FROM nation"
_RANGES = f"SELECT doc_id, node_id, page_start AS lo, greatest(page_start, coalesce(lead(page_start) OVER (PARTITION BY doc_id ORDER BY page_start, node_id) - 1, 2147483647)) AS hi FROM ({_CHAPTERS})"


@query(with_tables(f"SELECT DISTINCT c.node_id AS src, a.node_id AS tgt, 'containsConcept' AS type FROM anchors a JOIN ({_RANGES}) c ON c.doc_id = a.doc_id AND a.page BETWEEN c.lo AND c.hi WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = c.node_id AND e.tgt = a.node_id AND e.type = 'containsConcept')", **E, **A))
def concepts_to_chapters(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    chapters = g.table("nation").select(F.concat(F.lit("d"), "n_regionkey").alias("doc_id"), F.concat(F.lit("h"), "n_nationkey").alias("node_id"), (F.col("n_nationkey") * 7 % 38).cast("int").alias("page_start"))
    return fold.attach_concepts(chapters, g.anchors, g.edges)


@query(with_tables("SELECT coalesce(d.node_id, concat('new-', r.doc_id)) AS node_id, r.doc_id, coalesce(d.label, r.label) AS label, CASE WHEN trim(r.summary) <> '' THEN r.summary ELSE d.summary END AS summary FROM (SELECT concat('d', r_regionkey) AS doc_id, concat('About ', r_name) AS label, CASE WHEN r_regionkey < 2 THEN ' ' ELSE concat('On ', r_name) END AS summary FROM region) r LEFT JOIN (SELECT node_id, node_id AS doc_id, label, 'old' AS summary FROM nodes WHERE level = 'document' AND node_id <> 'd4') d USING (doc_id)", **N))
def document_upsert(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    fresh = g.table("region").select(F.concat(F.lit("new-d"), "r_regionkey").alias("node_id"), F.concat(F.lit("d"), "r_regionkey").alias("doc_id"), F.concat(F.lit("About "), "r_name").alias("label"), F.when(F.col("r_regionkey") < 2, " ").otherwise(F.concat(F.lit("On "), "r_name")).alias("summary"))
    old = one_level(g.nodes, "document").filter("node_id <> 'd4'").select("node_id", F.col("node_id").alias("doc_id"), "label", F.lit("old").alias("summary"))
    return fold.upsert_documents(fresh, old)


_SIDE = "SELECT concat('c', o_custkey) AS node_id, {label} AS label, max(o_orderdate) AS last_modified FROM {orders} WHERE {test} GROUP BY o_custkey"
_OWN = {"label": "'own'", "test": "o_orderpriority IN ('1-URGENT', '2-HIGH')"}
_INCOMING = {"label": "'incoming'", "test": "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"}


@query(f"SELECT node_id, arg_max(label, (last_modified, label = 'own')) AS label FROM ({_SIDE.format(orders='orders', **_OWN)} UNION ALL {_SIDE.format(orders='orders', **_INCOMING)}) GROUP BY node_id")
def merge_graphs(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return merge.merge_nodes(g.sql(_SIDE.format(orders="{orders}", **_OWN)), g.sql(_SIDE.format(orders="{orders}", **_INCOMING))).select("node_id", "label")


@query(
    with_tables(
        """SELECT edge_id, src, tgt, type FROM own UNION ALL SELECT min(edge_id), src, tgt, type FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.src = i.src AND o.tgt = i.tgt AND o.type = i.type) GROUP BY src, tgt, type""",
        **E,
        own="SELECT * FROM edges WHERE type <> 'uses'",
        incoming="SELECT concat('in-', edge_id) AS edge_id, src, tgt, CASE type WHEN 'cites' THEN 'uses' ELSE type END AS type FROM edges WHERE NOT type LIKE 'contains%'",
    )
)
def merge_graph_edges(spark, sf_dir):
    edges = Fixture(spark, sf_dir).edges
    incoming = edges.filter("type not like 'contains%'").select(F.concat(F.lit("in-"), "edge_id").alias("edge_id"), "src", "tgt", F.when(F.col("type") == "cites", "uses").otherwise(F.col("type")).alias("type"))
    return merge.merge_edges(edges.filter("type <> 'uses'"), incoming)


#: Customers in debt merge into the next one by key; neighbours in debt form chains.
_MERGES = "SELECT concat('c', a.c_custkey) AS source, concat('c', b.c_custkey) AS target FROM {customer} a JOIN {customer} b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_acctbal < 0"
_MOVED = "SELECT source, arg_max(target, depth) AS target FROM chain GROUP BY source"
_CHAIN = "SELECT source, target, 1 AS depth FROM merges UNION ALL SELECT c.source, m.target, c.depth + 1 FROM chain c JOIN merges m ON m.source = c.target"


def _recursive(body: str, **tables: str) -> str:
    return with_tables(body, **tables).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    _recursive(
        """SELECT n.node_id, coalesce(n.summary, g.more) AS summary, greatest(n.confidence, g.other) AS confidence
FROM nodes n LEFT JOIN (SELECT m.target, arg_min(s.summary, s.node_id) FILTER (s.summary IS NOT NULL) AS more, max(s.confidence) AS other FROM moved m JOIN nodes s ON s.node_id = m.source GROUP BY m.target) g ON g.target = n.node_id
WHERE n.node_id NOT IN (SELECT source FROM moved)""",
        **N,
        merges=duck(_MERGES),
        chain=_CHAIN,
        moved=_MOVED,
    )
)
def execute_merge(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return merge.execute_merges(g.nodes, g.edges, g.anchors, g.sql(_MERGES))[0].select("node_id", "summary", "confidence")


@query(
    _recursive(
        """SELECT edge_id, s AS src, t AS tgt, type FROM drawn WHERE type <> 'containsEntity' AND NOT (touched AND s = t)
UNION ALL SELECT edge_id, s, t, type FROM drawn WHERE type = 'containsEntity' AND NOT touched
UNION ALL SELECT min(edge_id), s, t, type FROM drawn d WHERE type = 'containsEntity' AND ns IS NOT NULL AND nt IS NULL AND NOT EXISTS (SELECT 1 FROM drawn h WHERE h.type = 'containsEntity' AND NOT h.touched AND h.s = d.s AND h.t = d.t) GROUP BY s, t, type""",
        **E,
        merges=duck(_MERGES),
        chain=_CHAIN,
        moved=_MOVED,
        drawn="SELECT e.edge_id, e.type, a.target AS ns, b.target AS nt, coalesce(a.target, e.src) AS s, coalesce(b.target, e.tgt) AS t, a.target IS NOT NULL OR b.target IS NOT NULL AS touched FROM edges e LEFT JOIN moved a ON a.source = e.src LEFT JOIN moved b ON b.source = e.tgt",
    )
)
def execute_merge_edges(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return merge.execute_merges(g.nodes, g.edges, g.anchors, g.sql(_MERGES))[1].select("edge_id", "src", "tgt", "type")


_PARTS = "SELECT concat('p', p_partkey) AS node_id, p_name AS label, p_brand AS brand, concat('s', p_size) AS doc FROM part"


@query(
    with_tables(
        """SELECT id_a, id_b, similarity, CASE WHEN similarity > 0.95 THEN 'same label' ELSE 'similar label' END AS reason FROM (
  SELECT a.node_id AS id_a, b.node_id AS id_b, CASE WHEN lower(trim(a.label)) = lower(trim(b.label)) THEN 1.0 ELSE 1.0 - levenshtein(lower(trim(a.label)), lower(trim(b.label)))::DOUBLE / greatest(length(trim(a.label)), length(trim(b.label))) END AS similarity
  FROM parts a JOIN parts b ON a.size <= 25 AND b.size > 25) WHERE similarity > 0.7""",
        parts="SELECT concat('p', p_partkey) AS node_id, p_name AS label, p_size AS size FROM part",
    )
)
def fuzzy_merge_proposals(spark, sf_dir):
    part = Fixture(spark, sf_dir).table("part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_name").alias("label"), F.array(F.concat(F.lit("s"), "p_size")).alias("docs"), "p_size")
    found = merge.merge_proposals(part.filter("p_size <= 25"), part.filter("p_size > 25"), 0.7)
    return found.select("id_a", "id_b", "similarity", "reason")


_DESIRED = "SELECT doc_id, node_id, page, CAST(ord * 50 + 10 AS double) AS x, 10.0::DOUBLE AS y, 40.0::DOUBLE AS w, 20.0::DOUBLE AS h, CAST(page % 12 AS int) AS color FROM anchors"


@query(
    with_tables(
        """SELECT doc_id, node_id, page, x, y, w, h, coalesce(want, have) AS color, CASE WHEN have IS NULL THEN 'add' WHEN want IS NULL THEN 'remove' WHEN want = have THEN 'keep' ELSE 'recolour' END AS action
FROM (SELECT * EXCLUDE (color), color AS want FROM desired WHERE page < 35) FULL JOIN (SELECT * EXCLUDE (color), CAST(color // 2 * 2 AS int) AS have FROM desired WHERE page > 4) USING (doc_id, node_id, page, x, y, w, h)""",
        **A,
        desired=_DESIRED,
    )
)
def highlight_diff(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    all_of = g.anchors.select("doc_id", "node_id", "page", (F.col("ord") * 50 + 10).cast("double").alias("x"), F.lit(10.0).alias("y"), F.lit(40.0).alias("w"), F.lit(20.0).alias("h"), (F.col("page") % 12).cast("int").alias("color"))
    present = all_of.filter("page > 4").withColumn("color", (F.floor(F.col("color") / 2) * 2).cast("int"))
    return sync.highlight_diff(all_of, present, g.documents.withColumn("n", F.lit(35)))


@query(with_tables("SELECT level, count(*) AS nodes FROM nodes n WHERE EXISTS (SELECT 1 FROM anchors a WHERE a.node_id = n.node_id AND a.page = 3) GROUP BY level", **N, **A))
def annotated_nodes(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    marks = g.documents.withColumn("page", F.lit(3))
    return sync.annotated(g.nodes, g.anchors, marks).filter("reading_state = 'annotated'").groupBy("level").agg(F.count("*").alias("nodes"))


@query(
    with_tables(
        f"""SELECT md5(string_agg(line, chr(10) ORDER BY part, label, id) || chr(10) || chr(10) || 'the page') AS digest, count(*) AS lines FROM (
  SELECT 0 AS part, label, concat('- ', label, ' (', upper(type[1]), substr(type, 2), ')', CASE WHEN summary IS NULL THEN '' ELSE concat(': ', summary) END) AS line, node_id AS id FROM nodes WHERE level IN ('document', 'chapter')
  UNION ALL SELECT 1, a.label, concat('- ', a.label, ' -> ', {EDGE_NAME.replace("CASE type", "CASE e.type")}, ' -> ', b.label), e.edge_id FROM edges e JOIN nodes a ON a.node_id = e.src AND a.level IN ('document', 'chapter') JOIN nodes b ON b.node_id = e.tgt AND b.level IN ('document', 'chapter'))""",
        **N, **E,
    )
)
def qa_context(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    nodes = g.nodes.filter("level in ('document', 'chapter')")
    found = search.question_context(nodes, g.edges, "the page")
    return found.select(F.md5("context").alias("digest"), (F.size(F.split("context", "\n")) - 2).cast("long").alias("lines"))


@query(
    with_tables(
        """SELECT citation_id, arg_min(node_id, (miss, node_id, ord)) AS node_id, arg_min(ord, (miss, node_id, ord)) AS ord, min(miss) = 0 AS matched FROM (
  SELECT c.citation_id, a.node_id, a.ord, CASE WHEN contains(lower(a.snippet), c.text) OR contains(c.text, lower(a.snippet)) THEN 0 ELSE 1 END AS miss
  FROM (SELECT concat('q', c_custkey) AS citation_id, lower(concat('IN D', c_nationkey % 5, ' on')) AS text, CAST(c_custkey % 45 AS int) AS page FROM customer) c JOIN anchors a ON a.page = c.page) GROUP BY citation_id""",
        **A,
    )
)
def citation_lookup(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    cited = g.table("customer").select(F.concat(F.lit("q"), "c_custkey").alias("citation_id"), F.concat(F.lit("IN D"), F.col("c_nationkey") % 5, F.lit(" on")).alias("text"), (F.col("c_custkey") % 45).cast("int").alias("page"))
    return search.citation_anchors(cited, g.anchors)


@query(with_tables("SELECT node_id, arg_min(doc_id, (doc_id <> 'd2', ord)) AS doc_id, arg_min(page, (doc_id <> 'd2', ord)) AS page, arg_min(ord, (doc_id <> 'd2', ord)) AS ord FROM anchors GROUP BY node_id", **A))
def navigation_anchor(spark, sf_dir):
    return search.navigation_anchors(Fixture(spark, sf_dir).anchors, "d2")


_EDGE_LINES = f"SELECT i.node_id, string_agg(concat('- ', {EDGE_NAME.replace('CASE type', 'CASE i.type')}, ': ', '{{0}}', n.label, '{{1}}'), chr(10) ORDER BY i.edge_id) AS lines FROM ({INCIDENT}) i JOIN nodes n ON n.node_id = i.other GROUP BY i.node_id"


@query(with_tables(f"SELECT node_id, md5(concat('### ', label, chr(10), upper(type[1]), substr(type, 2), ' | Confidence: ', CAST(trunc(confidence * 100) AS int), '%', chr(10), CASE WHEN summary IS NULL THEN '' ELSE concat(summary, chr(10)) END, coalesce(lines, ''))) AS digest FROM nodes LEFT JOIN ({_EDGE_LINES.format('', '')}) USING (node_id)", **N, **E))
def export_markdown(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return markdown_nodes(g.nodes, g.edges).select("node_id", F.md5("section").alias("digest"))


@query(
    with_tables(
        f"""SELECT type, md5(string_agg(note, chr(10) || chr(10) ORDER BY label, node_id)) AS digest FROM (
  SELECT type, label, node_id, concat_ws(chr(10), concat('## ', label), summary, lines, places) AS note FROM nodes LEFT JOIN ({_EDGE_LINES.format("[[", "]]")}) USING (node_id)
  LEFT JOIN (SELECT node_id, string_agg(concat('- ', doc_id, ', page ', page + 1), chr(10) ORDER BY ord) AS places FROM anchors GROUP BY node_id) USING (node_id) WHERE level <> 'entity') GROUP BY type""",
        **N, **E, **A,
    )
)
def export_notes(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    kept = g.nodes.filter("level <> 'entity'").select("node_id")
    notes = linked_notes(g.nodes, g.edges, g.anchors).join(kept, "node_id", "left_semi")
    return notes.groupBy("type").agg(F.md5(ordered_join(F.struct("label", "node_id"), F.col("note"), "\n\n")).alias("digest"))


_AT = "SELECT concat('n', c_nationkey) AS grp, concat('c', c_custkey) AS node_id, CAST(c_custkey % 97 * 13 AS double) AS x, CAST(c_custkey % 89 * 11 AS double) AS y FROM {customer}"


@query(
    with_tables(
        """SELECT grp, node_id, round(sum(f * dx), 3) AS fx, round(sum(f * dy), 3) AS fy FROM (SELECT a.grp, a.node_id, a.x - b.x AS dx, a.y - b.y AS dy, greatest(1.0, (a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d2, 25000 / d2 / sqrt(d2) AS f FROM stands a JOIN stands b ON a.grp = b.grp AND a.node_id <> b.node_id) GROUP BY ALL""",
        stands=duck(_AT),
    )
)
def repulsion_one_step(spark, sf_dir):
    return layout.repulsion_step(Fixture(spark, sf_dir).sql(_AT)).select("grp", "node_id", F.round("fx", 3).alias("fx"), F.round("fy", 3).alias("fy"))


_GROUPED = "SELECT node_id, level, arg_min(src, edge_id) AS parent FROM nodes LEFT JOIN edges e ON tgt = node_id AND e.type LIKE 'contains%' GROUP BY node_id, level"


@query(
    with_tables(
        """SELECT node_id, round(((g + 0.5) * 1200 / count_groups + (i % 3 - 1) * 70)::DOUBLE, 6) AS x, round((CASE level WHEN 'document' THEN 0.15 WHEN 'chapter' THEN 0.40 WHEN 'concept' THEN 0.65 ELSE 0.85 END * 800 + (i // 3) * 70)::DOUBLE, 6) AS y FROM (
  SELECT *, max(g) OVER (PARTITION BY level) + 1 AS count_groups FROM (SELECT node_id, level, dense_rank() OVER (PARTITION BY level ORDER BY coalesce(parent, '')) - 1 AS g, row_number() OVER (PARTITION BY level, coalesce(parent, '') ORDER BY node_id) - 1 AS i FROM grouped))""",
        **N, **E, grouped=_GROUPED,
    )
)
def band_seed(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    parents = g.edges.filter("type like 'contains%'").groupBy(F.col("tgt").alias("node_id")).agg(F.min_by("src", "edge_id").alias("parent"))
    placed = layout.band_seeds(g.nodes.select("node_id", "level").join(parents, "node_id", "left"), 1200, 800)
    return placed.select("node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"SELECT grp, CAST(floor(x / 200) AS BIGINT) AS cell_x, CAST(floor(y / 200) AS BIGINT) AS cell_y, count(*) AS mass, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM ({duck(_AT)}) GROUP BY 1, 2, 3")
def cell_masses(spark, sf_dir):
    return layout.cell_masses(Fixture(spark, sf_dir).sql(_AT), 200).select("grp", "cell_x", "cell_y", "mass", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))


@query(f"SELECT grp, round(s, 6) AS scale, round(400 - (x0 + x1) / 2 * s, 6) AS dx, round(300 - (y0 + y1) / 2 * s, 6) AS dy FROM (SELECT grp, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, least(800 / (max(x) - min(x) + 200), 600 / (max(y) - min(y) + 200), 2) AS s FROM ({duck(_AT)}) GROUP BY grp)")
def fit_to_content(spark, sf_dir):
    return layout.fit(Fixture(spark, sf_dir).sql(_AT), 800, 600).select("grp", *(F.round(c, 6).alias(c) for c in ("scale", "dx", "dy")))


@query(
    with_tables(
        "SELECT parent, min(x) - 40 AS x, min(y) - 30 AS y, max(x) - min(x) + 80 AS w, max(y) - min(y) + 80 AS h FROM (SELECT DISTINCT p.node_id AS parent, p.x, p.y FROM stands p JOIN edges ON src = p.node_id AND type = 'containsEntity' UNION ALL SELECT src, o.x, o.y FROM edges JOIN stands o ON o.node_id = tgt WHERE type = 'containsEntity') GROUP BY parent",
        **E,
        stands=f"SELECT node_id, x, y FROM ({duck(_AT)}) UNION ALL SELECT concat('o', o_orderkey), CAST(o_orderkey % 71 * 9 AS double), CAST(o_orderkey % 53 * 7 AS double) FROM orders",
    )
)
def cluster_boxes(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    at = g.sql(_AT).select("node_id", "x", "y").unionByName(g.table("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node_id"), (F.col("o_orderkey") % 71 * 9).cast("double").alias("x"), (F.col("o_orderkey") % 53 * 7).cast("double").alias("y")))
    return layout.cluster_boxes(at, g.edges)


@query(with_tables("SELECT src, tgt, arg_min(type, ord) AS type, arg_min(confidence, ord) AS confidence, arg_min(label, ord) AS label FROM relations r WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.src = r.src AND t.tgt = r.tgt) AND NOT EXISTS (SELECT 1 FROM taken t WHERE t.type = 'containsEntity' AND t.src = r.tgt AND t.tgt = r.src) GROUP BY src, tgt",
    **E, taken="SELECT * FROM edges WHERE type LIKE 'contains%' OR type = 'uses'", relations=f"SELECT concat('c', o_custkey) AS src, concat('c', l_suppkey) AS tgt, type, 0.7::DOUBLE AS confidence, concat('on ', l_partkey) AS label, o_orderkey * 10 + l_linenumber AS ord FROM ({duck(LARGE_LINES)}) UNION ALL SELECT tgt, src, 'cites', 0.5, 'back', -1 FROM edges WHERE type = 'containsEntity'"))
def insert_relations_fast(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return insert_relations(_relations(g), g.edges.filter("type like 'contains%' or type = 'uses'"), ["ord"])


def _relations(g: Fixture):
    lines = g.sql(LARGE_LINES).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("c"), "l_suppkey").alias("tgt"), "type", F.lit(0.7).alias("confidence"), F.concat(F.lit("on "), "l_partkey").alias("phrase"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    back = g.edges.filter("type = 'containsEntity'").select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.lit("cites").alias("type"), F.lit(0.5).alias("confidence"), F.lit("back").alias("phrase"), F.lit(-1).cast("long").alias("ord"))
    return lines.unionByName(back)


@query(with_tables("SELECT arg_min(src, ord) AS src, arg_min(tgt, ord) AS tgt, arg_min(type, ord) AS type, arg_min(confidence, ord) AS confidence, CAST(NULL AS string) AS label FROM relations r WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE least(t.src, t.tgt) = least(r.src, r.tgt) AND greatest(t.src, t.tgt) = greatest(r.src, r.tgt)) GROUP BY least(r.src, r.tgt), greatest(r.src, r.tgt)",
    **E, taken="SELECT * FROM edges WHERE type LIKE 'contains%' OR type = 'uses'", relations=f"SELECT concat('c', o_custkey) AS src, concat('c', l_suppkey) AS tgt, type, 0.7::DOUBLE AS confidence, o_orderkey * 10 + l_linenumber AS ord FROM ({duck(LARGE_LINES)})"))
def insert_relations_deep(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return insert_deep(_relations(g).filter("ord >= 0"), g.edges.filter("type like 'contains%' or type = 'uses'"), ["ord"])
