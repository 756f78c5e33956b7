"""Queries over what an application keeps around the graph: lists, views, geometry, proposals, files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartulary.functions import geometry as G
from cartulary.functions.text import marked_node
from cartulary.operators import extract, layout, lists, merge, search, sync
from cartulary.operators.graph import contained
from cartulary.plans.fixtures import ANCHORS, DUCK_PAGES, EDGES, LARGE_LINES, NODES, Fixture, duck
from cartulary.plans.registry import query, with_tables
from cartulary.schema import EDGE_TYPES
from cartulary.sources import graph_files, text
from cartulary.streaming import events as E

N, D, A = {"nodes": duck(NODES)}, {"edges": duck(EDGES)}, {"anchors": duck(ANCHORS)}


@query(with_tables("SELECT doc_id, page, length(text) AS chars FROM pg WHERE page BETWEEN 1 AND 3", pg=DUCK_PAGES))
def page_range_scan(spark, sf_dir):
    return text.read_pages(Fixture(spark, sf_dir).pages, 1, 4).select("doc_id", "page", F.length("text").cast("long").alias("chars"))


@query("SELECT path, min(page_id) AS ord FROM (SELECT page_id, regexp_replace(url, '/+', '/', 'g') AS path FROM pages WHERE lower(url) LIKE '%.html') GROUP BY path ORDER BY ord LIMIT 10")
def dropped_files(spark, sf_dir):
    pages = Fixture(spark, sf_dir).table("pages").filter("lower(url) like '%.html'")
    paths = pages.select(F.col("page_id").alias("ord"), F.concat("url", F.lit(".PDF")).alias("path"))
    return lists.dropped_files(paths).select(F.regexp_replace("path", r"\.PDF$", "").alias("path"), "ord")


@query("SELECT url, min(page_id) AS ord, arg_min(page_id % 3 <> 1, page_id) AS inaccessible FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN concat('at', page_id // 2) ELSE concat('at', page_id // 3) END AS url FROM pages) WHERE url IS NOT NULL GROUP BY url ORDER BY ord LIMIT 10")
def session_restore(spark, sf_dir):
    k = F.col("page_id")
    marks = Fixture(spark, sf_dir).table("pages").select(k.alias("ord"), F.when(k % 3 == 1, F.expr("concat('at', page_id div 2)")).alias("resolved"), F.when(k % 3 == 2, F.expr("concat('at', page_id div 3)")).alias("path"))
    return lists.restored(marks)


@query("SELECT project_id, path, CAST(row_number() OVER (PARTITION BY project_id ORDER BY old, ord, path) - 1 AS int) AS ord FROM (SELECT p_brand AS project_id, p_type AS path, min(p_partkey) AS ord, 0 AS old FROM part WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = part.p_brand AND q.p_type = part.p_type AND q.p_size <= 10) GROUP BY ALL UNION ALL SELECT p_brand, p_type, min(p_partkey), 1 FROM part WHERE p_size <= 10 GROUP BY ALL)")
def added_project_files(spark, sf_dir):
    part = Fixture(spark, sf_dir).table("part").select(F.col("p_brand").alias("project_id"), F.col("p_type").alias("path"), F.col("p_partkey").alias("ord"), "p_size")
    existing = part.filter("p_size <= 10").groupBy("project_id", "path").agg(F.min("ord").alias("ord"))
    return lists.added_files(existing, part.drop("p_size"))


@query("SELECT DISTINCT url FROM (SELECT CASE WHEN page_id % 4 = 0 THEN NULL ELSE url END AS url FROM pages UNION ALL SELECT concat('/old', page_id % 9) FROM pages) WHERE url IS NOT NULL")
def alive_urls(spark, sf_dir):
    pages = Fixture(spark, sf_dir).table("pages")
    return graph_files.alive_urls(pages.select(F.when(F.col("page_id") % 4 != 0, F.col("url")).alias("resolved"), F.concat(F.lit("/old"), F.col("page_id") % 9).alias("last_path")))


@query("SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY lower(c_name), c_custkey) AS int) AS place FROM customer")
def projects_by_name(spark, sf_dir):
    named = Fixture(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return lists.sorted_projects(named, "name").select("id", F.row_number().over(Window.orderBy(F.lower("name"), "id")).alias("place"))


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')")
def named_files(spark, sf_dir):
    files = Fixture(spark, sf_dir).table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("path"))
    return search.named_files(files, "RING").select("id")


@query("SELECT s_suppkey AS ord FROM supplier ORDER BY s_suppkey LIMIT 1 OFFSET 2")
def result_cursor(spark, sf_dir):
    return lists.cursor(Fixture(spark, sf_dir).table("supplier").select(F.col("s_suppkey").alias("ord")), 1, 1).select("ord")


@query(with_tables("SELECT node_id, CASE WHEN node_id = 'c3' THEN 'collapsed' ELSE 'expanded' END AS expansion_state FROM nodes", **N))
def expansion_states(spark, sf_dir):
    return lists.toggled_expansion(lists.expanded(Fixture(spark, sf_dir).nodes, "expanded"), "c3").select("node_id", "expansion_state")


@query(with_tables("SELECT node_id, CAST(CASE level WHEN 'entity' THEN 1 WHEN 'concept' THEN 2 WHEN 'chapter' THEN 3 ELSE 4 END AS BIGINT) AS rank FROM nodes", **N))
def draw_order(spark, sf_dir):
    return layout.draw_order(Fixture(spark, sf_dir).nodes).select("node_id", F.col("rank").cast("long").alias("rank"))


_AT = "SELECT concat('c', c_custkey) AS node_id, CAST(c_custkey % 97 * 13 AS double) AS x, CAST(c_custkey % 89 * 11 AS double) AS y FROM {customer}"


@query(f"SELECT node_id FROM ({duck(_AT)}) WHERE x - 70 <= 700 AND x + 70 >= 100 AND y - 20 <= 500 AND y + 20 >= 200")
def viewport_culling(spark, sf_dir):
    return layout.in_view(Fixture(spark, sf_dir).sql(_AT), 100, 200, 600, 300).select("node_id")


@query(f"SELECT node_id FROM ({duck(_AT)}) WHERE abs(x - 130) <= 70 AND abs(y - 110) <= 20 ORDER BY node_id LIMIT 1")
def hit_test(spark, sf_dir):
    return search.hit(Fixture(spark, sf_dir).sql(_AT), 130, 110).select("node_id")


@query(with_tables("SELECT node_id, CASE level WHEN 'document' THEN 200.0 WHEN 'chapter' THEN 180.0 WHEN 'concept' THEN 140.0 ELSE 100.0 END::DOUBLE AS w, (CASE level WHEN 'document' THEN 60 WHEN 'chapter' THEN 50 WHEN 'concept' THEN 40 ELSE 30 END + CASE WHEN summary IS NULL THEN 0 ELSE 20 END)::DOUBLE AS h FROM nodes", **N))
def node_sizes(spark, sf_dir):
    return Fixture(spark, sf_dir).nodes.select("node_id", G.node_size(F.col("level"), F.col("summary").isNotNull()).alias("s")).select("node_id", "s.w", "s.h")


_BOX = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey % 50 AS double) AS x, CAST(l_suppkey % 40 AS double) AS y, CAST(l_quantity AS double) AS w, CAST(l_linenumber * 7 AS double) AS h FROM {lineitem}"


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, x < 45 AND 20 < x + w AND y < 30 AND 10 < y + h AS over, x <= 45 AND 20 <= x + w AND y <= 30 AND 10 <= y + h AS meet,
  greatest(0, least(x + 9, 100 - w)) AS mx, greatest(0, least(y - 9, 100 - h)) AS my, least(x, 20) AS ux, greatest(x + w, 45) - least(x, 20) AS uw, greatest(x + 4, least(x + w - 12, 100)) - x AS sw, least(greatest(1.2 * w / 10, 0.1), 5.0) AS zoom FROM ({duck(_BOX)})"""
)
def annotation_geometry(spark, sf_dir):
    boxes = Fixture(spark, sf_dir).sql(_BOX)
    r = G.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    other, page = G.rect(*map(F.lit, (20.0, 10.0, 25.0, 20.0))), G.rect(*map(F.lit, (0.0, 0.0, 100.0, 100.0)))
    boxes = boxes.withColumn("r", r)
    r = F.col("r")
    moved, joined, sized = G.translated(r, F.lit(9.0), F.lit(-9.0), page), G.union(r, other), G.resized(r, F.lit("e"), F.lit(-12.0), F.lit(0.0), page, 4)
    return boxes.select("l_orderkey", "l_linenumber", "l_partkey", G.overlaps(r, other).alias("over"), G.meets(r, other).alias("meet"), moved["x"].alias("mx"), moved["y"].alias("my"), joined["x"].alias("ux"), joined["w"].alias("uw"), sized["w"].alias("sw"), G.zoomed(F.col("w") / 10, F.lit(1.2)).alias("zoom"))


@query(with_tables("SELECT DISTINCT a.node_id FROM anchors a JOIN (SELECT concat('d', n_nationkey % 5) AS doc_id, CAST(n_nationkey AS int) AS page, n_nationkey * 2.0 AS x FROM nation) h ON h.doc_id = a.doc_id AND h.page = a.page WHERE a.ord * 10 < h.x + 15 AND h.x < a.ord * 10 + 8", **A))
def highlighted_nodes(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    box = lambda x, w: G.rect(x.cast("double"), F.lit(0.0), F.lit(float(w)), F.lit(5.0))
    marks = g.table("nation").select(F.concat(F.lit("d"), F.col("n_nationkey") % 5).alias("doc_id"), F.col("n_nationkey").alias("page"), box(F.col("n_nationkey") * 2, 15).alias("bbox"))
    at = g.anchors.withColumn("bbox", box(F.col("ord") * 10, 8))
    nodes = g.nodes.withColumn("is_pinned", F.lit(False))
    return sync.highlighted(nodes, at, marks).filter("is_pinned and reading_state = 'highlighted'").select("node_id")


_CONTENTS = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('mark:', substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) WHEN event_id % 3 = 1 THEN concat('mark:', h) ELSE h END AS contents FROM (SELECT event_id, md5(CAST(event_id AS string)) AS h FROM {events}) AS e"


@query(f"SELECT event_id, CASE WHEN regexp_full_match(contents, 'mark:[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}') THEN contents[6:] END AS node_id FROM ({duck(_CONTENTS)})")
def marked_annotations(spark, sf_dir):
    return Fixture(spark, sf_dir).sql(_CONTENTS).select("event_id", marked_node(F.col("contents"), "mark:").alias("node_id"))


@query("SELECT p_partkey AS proposal_id, p_size / 50.0::DOUBLE AS similarity, p_size / 50.0::DOUBLE > 0.9 AS bulk FROM part WHERE p_partkey NOT IN (SELECT ps FROM (SELECT DISTINCT l_partkey AS ps FROM lineitem WHERE l_quantity > 45))")
def pending_proposals(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    proposals = g.table("part").select(F.col("p_partkey").alias("proposal_id"), (F.col("p_size") / 50.0).alias("similarity"))
    return search.pending_proposals(proposals, g.table("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("proposal_id")).distinct())


_SIDES = "SELECT concat('p', p_partkey) AS node_id, p_name AS label, 'concept' AS level, p_size AS size FROM part"


@query(
    with_tables(
        """SELECT id_a, id_b, similarity, reason FROM alike UNION ALL SELECT a.id, b.id, 0.6, 'suggested' FROM known a JOIN known b ON a.label = 'blue bolt' AND b.label = 'red gizmo' AND a.side = 1 AND b.side = 2
WHERE NOT EXISTS (SELECT 1 FROM alike WHERE least(label_a, label_b) = 'blue bolt' AND greatest(label_a, label_b) = 'red gizmo')""",
        parts=_SIDES,
        known="SELECT CASE WHEN size <= 25 THEN 1 ELSE 2 END AS side, label, max(node_id) AS id FROM parts GROUP BY ALL",
        scored="SELECT a.node_id AS id_a, b.node_id AS id_b, a.label AS label_a, b.label AS label_b, CASE WHEN a.label = b.label THEN 1.0 ELSE 1.0 - levenshtein(a.label, b.label)::DOUBLE / greatest(length(a.label), length(b.label)) END AS similarity FROM (SELECT label, min(node_id) AS node_id FROM parts WHERE size <= 25 GROUP BY label) a JOIN (SELECT label, min(node_id) AS node_id FROM parts WHERE size > 25 GROUP BY label) b ON true",
        alike="SELECT *, CASE WHEN similarity > 0.95 THEN 'same label' ELSE 'similar label' END AS reason FROM scored WHERE similarity > 0.5 QUALIFY row_number() OVER (PARTITION BY least(label_a, label_b), greatest(label_a, label_b) ORDER BY similarity DESC, id_a, id_b) = 1",
    )
)
def semantic_merge_proposals(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    part = g.table("part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_name").alias("label"), F.lit("concept").alias("level"), F.array(F.concat(F.lit("s"), "p_size")).alias("docs"), "p_size")
    suggested = spark.createDataFrame([("Blue bolt", "red gizmo", 0.6, "suggested", None), ("blue bolt", "nowhere", 0.9, "suggested", None)], "labelA string, labelB string, confidence double, reason string, mergeType string")
    return merge.semantic_proposals(part.filter("p_size <= 25"), part.filter("p_size > 25"), suggested).select("id_a", "id_b", "similarity", "reason")


@query(with_tables("SELECT edge_id, src, tgt, type FROM edges WHERE src NOT IN (SELECT node_id FROM nodes WHERE confidence < 0.3) AND tgt NOT IN (SELECT node_id FROM nodes WHERE confidence < 0.3)", **N, **D))
def remove_nodes(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return merge.without_nodes(g.nodes, g.edges, g.nodes.filter("confidence < 0.3").select("node_id"))[1]


@query("SELECT user_id AS node_id, arg_max(event_type, event_id) AS label, max(event_id) AS seq FROM events GROUP BY user_id")
def node_updates(spark, sf_dir):
    rows = Fixture(spark, sf_dir).table("events").select(F.col("user_id").alias("node_id"), F.col("event_type").alias("label"), F.col("event_id").alias("seq"))
    return merge.latest(rows, "node_id", "seq")


@query(with_tables("SELECT c.tgt AS entity, d.src AS chapter FROM edges c JOIN edges d ON d.tgt = c.src AND d.type = 'containsConcept' WHERE c.type = 'containsEntity'", **D))
def entities_of_chapters(spark, sf_dir):
    edges = Fixture(spark, sf_dir).edges
    inner, outer = contained(edges, "containsEntity"), contained(edges, "containsConcept")
    return inner.select(F.col("parent").alias("concept"), F.col("child").alias("entity")).join(outer.select(F.col("parent").alias("chapter"), F.col("child").alias("concept")), "concept").select("entity", "chapter")


@query("SELECT l_orderkey, l_linenumber, 0 AS ord, concat('part ', l_partkey) AS source, concat('supplier ', l_suppkey) AS target, CASE l_returnflag WHEN 'R' THEN 'cites' WHEN 'A' THEN 'sameTopic' ELSE 'uses' END AS type, CASE WHEN l_returnflag = 'N' THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM lineitem")
def parsed_relations(spark, sf_dir):
    """Responses made of order lines, in fences, cut or whole, bare or in an object."""
    body = """concat('{"sourceLabel":"part ', l_partkey, '","targetLabel":"supplier ', l_suppkey, '","type":"', CASE l_returnflag WHEN 'R' THEN 'cites' WHEN 'A' THEN 'odd' ELSE 'uses' END, '"', CASE WHEN l_returnflag = 'N' THEN ',"confidence":0.9' ELSE '' END, '}')"""
    response = f"CASE l_linenumber % 4 WHEN 0 THEN concat('[', {body}, ']') WHEN 1 THEN concat('{{\"edges\":[', {body}, ']}}') WHEN 2 THEN concat('```json\\n[', {body}, ',\\n') ELSE concat('[', {body}) END"
    lines = Fixture(spark, sf_dir).table("lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber").alias("doc_id"), F.col("l_partkey").alias("batch"), F.expr(response).alias("response"))
    found = extract.relations_of(lines)
    return found.select(F.split("doc_id", r"\|")[0].cast("long").alias("l_orderkey"), F.split("doc_id", r"\|")[1].cast("int").alias("l_linenumber"), "ord", "source", "target", "type", "confidence")


_FILE = "concat('{\"nodes\":[{\"node_id\":\"', o_orderkey, '\",\"label\":\"x\",\"type\":\"concept\",\"level\":\"concept\",\"confidence\":1.0}', CASE WHEN o_orderkey % 6 = 0 THEN ',{\"node_id\":\"bad\"}' ELSE '' END, '],\"edges\":[{\"edge_id\":\"e\",\"src\":\"a\",\"tgt\":\"b\",\"type\":\"', CASE WHEN o_orderkey % 4 = 0 THEN 'subtopicOf' ELSE 'dependsOn' END, '\",\"confidence\":1.0}]}')"


@query("SELECT o_orderkey AS key, 'dependsOn' AS type FROM orders WHERE o_orderkey % 6 <> 0 AND o_orderkey % 4 <> 0")
def lossy_graph_decode(spark, sf_dir):
    payloads = Fixture(spark, sf_dir).table("orders").select(F.col("o_orderkey").alias("key"), F.expr(_FILE).alias("payload"))
    return graph_files.decoded(payloads)[1].filter(F.col("type").isin(*EDGE_TYPES)).select("key", "type")


@query("SELECT left(sha256(concat('node||', key)), 32) AS node_id, label, CAST((row_number() OVER (ORDER BY place) - 1) % 12 AS int) AS color_index FROM (SELECT lower(p_name) AS key, arg_min(p_name, (p_brand, p_partkey)) AS label, min((p_brand, p_partkey)) AS place FROM part GROUP BY 1)")
def concept_colours(spark, sf_dir):
    part = Fixture(spark, sf_dir).table("part")
    rows = part.select(F.col("p_name").alias("label"), F.lit("concept").alias("type"), F.lit(None).cast("string").alias("summary"), F.lit("concept").alias("level"), F.lit(0.8).alias("confidence"), F.col("p_brand").alias("doc_id"), F.lit(0).alias("page"), F.col("p_name").alias("snippet"), F.col("p_partkey").alias("ord"))
    return extract.coloured(extract.upsert_labels(rows, ["doc_id", "ord"])[0]).select("node_id", "label", "color_index")


@query("SELECT doc_id, max(ts) + INTERVAL 1 SECOND AS fires_at, arg_max(payload, ts) AS payload, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id AS doc_id, ts, event_type AS payload, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 SECOND THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY doc_id, s")
def debounced_saves(spark, sf_dir):
    return E.saves(Fixture(spark, sf_dir).table("events").select(F.col("user_id").alias("doc_id"), "ts", F.col("event_type").alias("payload")))


@query(f"SELECT concat('c', o_custkey) AS src, count(*) AS prompts, CAST(sum(length(concat('Labels: ', type, chr(10), 'Document: ', o_custkey))) AS BIGINT) AS chars FROM ({duck(LARGE_LINES)}) GROUP BY o_custkey")
def prompts(spark, sf_dir):
    lines = Fixture(spark, sf_dir).sql(LARGE_LINES)
    made = lines.select("o_custkey", extract.prompt("Labels: {labels}\nDocument: {title}", labels=F.col("type"), title=F.col("o_custkey")).alias("prompt"))
    return made.groupBy(F.concat(F.lit("c"), "o_custkey").alias("src")).agg(F.count("*").alias("prompts"), F.sum(F.length("prompt")).alias("chars"))
