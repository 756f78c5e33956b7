"""Queries over questions, projects, files of several documents, and what the other modules of queries do not reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import geometry as G
from cartulary.functions import text as T
from cartulary.operators import answer, export, extract, fold, graph, layout, lists, merge, search
from cartulary.plans import pipelines
from cartulary.plans.fixtures import ANCHORS, DUCK_BLOCKS, DUCK_PAGES, EDGES, NODES, Fixture, duck
from cartulary.plans.registry import query, with_tables
from cartulary.sources import graph_files, projects, text
from cartulary.streaming import events as E
from cartulary.tables import fresh_path

N, D, A, P, B = {"nodes": duck(NODES)}, {"edges": duck(EDGES)}, {"anchors": duck(ANCHORS)}, {"pg": DUCK_PAGES}, {"blocks": DUCK_BLOCKS}

#: Users' turns as questions; a recorded response for four in five, with a citation.
_ASKED = "SELECT conv_id, turn, text, turn * 7 % 40 AS page, (conv_id + turn) % 5 <> 0 AS answered FROM conversations WHERE role = 'user'"


def _answers(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    turns = g.table("conversations").filter("role = 'user'").select(F.struct("conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    context = search.question_context(g.nodes.filter("level = 'document'"), g.edges.limit(0), "")
    prompts = answer.question_prompts(turns, context)
    said = F.to_json(F.struct(F.concat(F.lit("Re: "), "question").alias("answer"), F.array(F.struct(F.lit("IN D1 on").alias("text"), F.expr("int(question_id.turn * 7 % 40)").alias("pageIndex"))).alias("citations")))
    answered = F.expr("(question_id.conv_id + question_id.turn) % 5 <> 0")
    cache = prompts.filter(answered).groupBy(F.left(F.sha2(F.concat_ws(":", F.lit("recorded"), "prompt"), 256), F.lit(32)).alias("key")).agg(F.min_by(said, F.struct("question_id.conv_id", "question_id.turn")).alias("response"))
    return answer.messages(pipelines.recorded(prompts, cache)), g


#: What is asked in the same words has the same prompt, and with it the same response: that of the first turn that has one.
_SAID = f"SELECT q.conv_id, q.turn, q.text, f.page AS page, f.text IS NOT NULL AS said FROM ({_ASKED}) q LEFT JOIN (SELECT text, arg_min(page, (conv_id, turn)) AS page FROM ({_ASKED}) WHERE answered GROUP BY text) f ON f.text = q.text"


@query(f"SELECT conv_id, turn, 0 AS place, 'user' AS role, text AS content FROM ({_SAID}) UNION ALL SELECT conv_id, turn, 1, CASE WHEN said THEN 'assistant' ELSE 'error' END, CASE WHEN said THEN concat('Re: ', text) ELSE 'The model gave no answer that can be read.' END FROM ({_SAID})")
def question_answers(spark, sf_dir):
    found, _ = _answers(spark, sf_dir)
    return found.select("question_id.conv_id", "question_id.turn", "place", "role", "content")


@query(
    with_tables(
        """SELECT conv_id, turn, 0 AS ord, arg_min(node_id, (miss, node_id, aord)) AS node_id, min(miss) = 0 AS matched FROM (
  SELECT q.conv_id, q.turn, a.node_id, a.ord AS aord, CASE WHEN contains(lower(a.snippet), 'in d1 on') OR contains('in d1 on', lower(a.snippet)) THEN 0 ELSE 1 END AS miss FROM said q JOIN anchors a ON q.said AND a.page = q.page) GROUP BY conv_id, turn""",
        **A,
        said=_SAID,
    )
)
def question_citations(spark, sf_dir):
    found, g = _answers(spark, sf_dir)
    return answer.cited(found, g.anchors).select("question_id.conv_id", "question_id.turn", "ord", "node_id", "matched")


@query("SELECT c_custkey AS id, c_name AS name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS files, c_custkey = (SELECT arg_min(c_custkey, (c_nationkey, c_custkey)) FROM customer) AS selected FROM customer")
def project_store(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    own = g.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("ord"))
    files = g.table("orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").cast("string").alias("file_id"), F.col("o_clerk").alias("name") if "o_clerk" in g.table("orders").columns else F.lit("file").alias("name"), F.concat(F.lit("/"), "o_orderkey").alias("path"), F.lit(0).alias("ord"))
    path = fresh_path(spark, "projects")
    projects.write_projects(own, files, path)
    return projects.read_projects(spark, path).select("id", "name", F.size("files").cast("long").alias("files"), "selected")


#: Each document's file holds its own nodes and, from before files were scoped, every seventh customer.
_FILED = "SELECT f.file, n.node_id, n.label, make_timestamp(2020, 1, 1 + CAST((length(n.node_id) * 3 + CAST(substr(f.file, 2) AS int) * 5 + CAST(substr(n.node_id, 2) AS int)) % 9 AS int), 0, 0, 0) AS last_modified FROM {nodes} n JOIN (SELECT node_id, doc_id AS file FROM {anchors} UNION SELECT m.node_id, g.file FROM {nodes} m JOIN (SELECT DISTINCT doc_id AS file FROM {anchors}) g ON CAST(substr(m.node_id, 2) AS int) % 7 = 0) f ON f.node_id = n.node_id WHERE n.level = 'concept'"


def _project(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    nodes = spark.sql(_FILED, nodes=g.nodes, anchors=g.anchors)
    files = g.anchors.select(F.col("doc_id").alias("file")).distinct()
    edges = g.edges.filter("type not like 'contains%'").join(files)
    anchors = g.anchors.join(files)
    return merge.project_wide(nodes, edges.select("file", "edge_id", "src", "tgt", "type"), anchors.select("file", "node_id", "doc_id"))


_OWN = {**N, **A, "filed": _FILED.replace("{nodes}", "nodes").replace("{anchors}", "anchors").replace("0, 0, 0)", "0, 0, 0.0)"), "own": "SELECT * FROM filed f WHERE EXISTS (SELECT 1 FROM anchors a WHERE a.node_id = f.node_id AND a.doc_id = f.file)"}


@query(with_tables("SELECT node_id, CAST(epoch_us(max(last_modified)) AS BIGINT) AS modified, count(*) > 0 AS known FROM own GROUP BY node_id", **_OWN))
def project_wide_nodes(spark, sf_dir):
    nodes, _ = _project(spark, sf_dir)
    return nodes.select("node_id", F.unix_micros(F.col("last_modified").cast("timestamp")).alias("modified"), F.lit(True).alias("known"))


@query(with_tables("SELECT min(edge_id) AS edge_id, e.src, e.tgt, e.type FROM edges e WHERE NOT type LIKE 'contains%' AND EXISTS (SELECT 1 FROM own a JOIN own b ON a.file = b.file WHERE a.node_id = e.src AND b.node_id = e.tgt) GROUP BY e.src, e.tgt, e.type", **_OWN, **D))
def project_wide_edges(spark, sf_dir):
    return _project(spark, sf_dir)[1].select("edge_id", "src", "tgt", "type")


@query(with_tables("SELECT edge_id, src, tgt, type FROM edges WHERE type = 'uses' UNION ALL SELECT min(edge_id), src, tgt, type FROM edges e WHERE type <> 'uses' AND src IN (SELECT node_id FROM anchors WHERE doc_id = 'd1') AND tgt IN (SELECT node_id FROM anchors WHERE doc_id = 'd1') GROUP BY src, tgt, type", **D, **A))
def scoped_merge(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    dated = g.nodes.withColumn("last_modified", F.lit("2020-01-01").cast("timestamp"))
    return merge.merge_scoped((dated.limit(0), g.edges.filter("type = 'uses'")), (dated, g.edges), g.anchors, "d1")[1].select("edge_id", "src", "tgt", "type")


@query("SELECT user_id AS doc_id, coalesce(b.state, a.state) AS state FROM (SELECT user_id, arg_max(event_type, event_id) AS state FROM events WHERE event_id % 2 = 0 GROUP BY user_id) a FULL JOIN (SELECT user_id, arg_max(event_type, event_id) AS state FROM events WHERE event_id % 3 = 0 GROUP BY user_id) b USING (user_id)")
def merged_states(spark, sf_dir):
    log = Fixture(spark, sf_dir).table("events")
    of = lambda k: log.filter(F.col("event_id") % k == 0).groupBy(F.col("user_id").alias("doc_id")).agg(F.max_by("event_type", "event_id").alias("state"))
    return merge.merge_states(of(2), of(3))


@query("SELECT md5(concat((SELECT string_agg(label, '; ' ORDER BY id) FROM (SELECT concat('p', p_partkey) AS id, p_name AS label FROM part WHERE p_size <= 25 ORDER BY id LIMIT 50)), '|', (SELECT string_agg(label, '; ' ORDER BY id) FROM (SELECT concat('p', p_partkey) AS id, p_name AS label FROM part WHERE p_size > 25 ORDER BY id LIMIT 50)))) AS digest")
def merge_prompt_labels(spark, sf_dir):
    part = Fixture(spark, sf_dir).table("part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_name").alias("label"), F.lit("concept").alias("level"), "p_size")
    asked = extract.merge_prompt(part.filter("p_size <= 25"), part.filter("p_size > 25"))
    shown = F.concat_ws("|", F.regexp_extract("prompt", r"\nA: (.*)", 1), F.regexp_extract("prompt", r"\nB: (.*)", 1))
    return asked.select(F.md5(shown).alias("digest"))


@query("SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, concat('supplier ', l_suppkey)) - 1 AS int) AS ord, concat('part ', l_partkey) AS a, concat('supplier ', l_suppkey) AS b, CASE WHEN l_returnflag = 'R' THEN 'exactMatch' ELSE 'semanticEquivalent' END AS merge_type FROM lineitem")
def parsed_merges(spark, sf_dir):
    one = F.to_json(F.struct(F.concat(F.lit("part "), "l_partkey").alias("labelA"), F.concat(F.lit("supplier "), "l_suppkey").alias("labelB"), F.lit(0.9).alias("confidence"), F.lit("alike").alias("reason"), F.when(F.col("l_returnflag") == "R", "exactMatch").alias("mergeType")))
    made = Fixture(spark, sf_dir).table("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("```json\n["), T.ordered_join(F.struct("l_linenumber", "l_partkey"), one, ","), F.lit("]\n```")).alias("response"))
    return extract.merges_of(made).select("doc_id", "ord", F.col("labelA").alias("a"), F.col("labelB").alias("b"), F.col("mergeType").alias("merge_type"))


_MARKS = "SELECT concat('doc', doc_id) AS doc_id, CAST(doc_id % 4 AS int) AS page, CAST(k AS int) AS ord, CASE WHEN (doc_id + k) % 3 = 0 THEN 'Widget' WHEN (doc_id + k) % 3 = 1 THEN 'Highlight' ELSE NULL END AS type FROM {docs}"


@query(f"SELECT doc_id, page, ord, type FROM ({_MARKS.replace('{docs}', '(SELECT doc_id, unnest(range(0, 3)) AS k FROM documents)')}) WHERE coalesce(type, '') <> 'Widget'")
def page_annotations(spark, sf_dir):
    docs = Fixture(spark, sf_dir).table("documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    marks = spark.sql(_MARKS, docs=docs).groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "type"))), lambda x: F.struct(x["type"].alias("type"))).alias("annotations"))
    return text.annotations(marks).select("doc_id", "page", "ord", F.col("annotation.type").alias("type"))


@query(with_tables("SELECT doc_id, page, arg_min(line_no, line_no) AS line_no, text, CAST(min(line_no) * 10 + 5 AS double) AS x FROM blocks WHERE false GROUP BY ALL UNION ALL SELECT b.doc_id, b.page, b.line_no, b.text, f.x FROM blocks b JOIN (SELECT doc_id, page, text, CAST(min(line_no) * 10 + 5 AS double) AS x, min(line_no) AS first FROM blocks GROUP BY doc_id, page, text) f USING (doc_id, page, text) WHERE f.first <> 1 UNION ALL SELECT doc_id, page, -1, text, NULL FROM pg WHERE NOT EXISTS (SELECT 1 FROM blocks b JOIN (SELECT doc_id, page, text, min(line_no) AS first FROM blocks GROUP BY ALL) f USING (doc_id, page, text) WHERE b.doc_id = pg.doc_id AND b.page = pg.page AND f.first <> 1)", **B, **P))
def placed_blocks(spark, sf_dir):
    """Blocks with boxes; the second line's has no area."""
    pages = Fixture(spark, sf_dir).pages
    unit = G.rect(F.col("line_no") * 0.1, F.lit(0.0), F.when(F.col("line_no") == 1, 0.0).otherwise(0.5), F.lit(0.02))
    on_page = G.from_unit_square(unit, G.rect(F.lit(5.0), F.lit(0.0), F.lit(100.0), F.lit(200.0)))
    boxes = text.lines(pages).select("doc_id", "page", "line_no", on_page.alias("bbox"))
    return text.text_blocks(pages, boxes).select("doc_id", "page", "line_no", "text", F.round("bbox.x", 6).alias("x"))


@query(with_tables("SELECT md5(concat('{\"edges\":[', (SELECT coalesce(string_agg(concat('{\"edge_id\":\"', edge_id, '\",\"src\":\"', src, '\",\"tgt\":\"', tgt, '\",\"type\":\"', type, '\"}'), ',' ORDER BY edge_id), '') FROM edges WHERE type = 'containsChapter'), '],\"nodes\":[', (SELECT string_agg(concat('{\"node_id\":\"', node_id, '\",\"label\":\"', label, '\"}'), ',' ORDER BY node_id) FROM nodes WHERE level IN ('document', 'chapter')), ']}')) AS digest", **N, **D))
def graph_as_json(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    whole = graph_files.graph_json(g.nodes.filter("level in ('document', 'chapter')").select("node_id", "label"), g.edges.filter("type = 'containsChapter'").select("edge_id", "src", "tgt", "type"))
    return whole.select(F.md5("json").alias("digest"))


@query(with_tables("SELECT 'Regions' AS title, (SELECT count(*) FROM nodes WHERE level = 'document') AS nodes, 0::BIGINT AS edges", **N))
def markdown_document(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    whole = export.markdown(g.nodes.filter("level = 'document'"), g.edges.limit(0), "Regions")
    count = lambda word: F.regexp_extract("document", rf"(\d+) {word}", 1).cast("long").alias(word)
    return whole.select(F.regexp_extract("document", r"\A# (.*)\n", 1).alias("title"), count("nodes"), count("edges"))


@query(with_tables("SELECT type, count(*) AS notes FROM nodes WHERE level IN ('document', 'chapter') GROUP BY type", **N))
def notes_by_type(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    grouped = export.type_groups(g.nodes.filter("level in ('document', 'chapter')"), g.edges.limit(0), g.anchors)
    return grouped.select("type", F.size(F.split("text", "\n\n")).cast("long").alias("notes"))


@query("SELECT event_id FROM events e WHERE user_id % 3 <> 0 AND event_id % 4 <> 0 UNION ALL SELECT event_id FROM events WHERE user_id % 3 = 0 AND event_id % 5 <> 0")
def unmarked_annotations(spark, sf_dir):
    log = Fixture(spark, sf_dir).table("events")
    marks = log.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("key"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("mark:"), "event_id")).alias("contents"))
    tracked = log.filter("user_id % 3 <> 0").select(F.col("user_id").alias("doc_id"), F.when(F.col("event_id") % 4 == 0, F.col("event_id")).otherwise(F.lit(-1)).alias("key")).distinct()
    return graph_files.unmarked(marks, tracked, "mark:").select(F.col("key").alias("event_id"))


@query("SELECT concat('d', r_regionkey) AS doc_id FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey < 9)")
def documents_without_chapters(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    chapters = g.table("nation").filter("n_nationkey % 3 = 0 and n_nationkey < 9").select(F.concat(F.lit("d"), "n_regionkey").alias("doc_id"))
    return fold.missing_chapters(g.documents, chapters)


@query("SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS int) AS updated, CAST(row_number() OVER (ORDER BY c_nationkey, c_custkey) AS int) AS manual FROM customer")
def projects_in_order(spark, sf_dir):
    named = Fixture(spark, sf_dir).table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("ord"), F.col("c_acctbal").alias("updated_at"))
    from pyspark.sql.window import Window

    place = lambda mode, order, alias: lists.sorted_projects(named, mode).select("id", F.row_number().over(Window.orderBy(order, "id")).alias(alias))
    return place("updated", F.col("updated_at").desc(), "updated").join(place("manual", F.col("ord"), "manual"), "id")


_RECENT = "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS int) AS ord, concat('/f', event_id) AS url, event_id % 4 = 0 AS inaccessible, CAST(event_id % 3 AS int) AS misses FROM {events}"


@query(f"SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ord) - 1 AS int) AS ord, url, inaccessible, misses FROM (SELECT user_id, ord, CASE WHEN ord = 2 THEN '/found' ELSE url END AS url, CASE WHEN ord = 2 THEN false ELSE inaccessible END AS inaccessible, CASE WHEN ord = 2 THEN 0 ELSE misses END AS misses FROM ({duck(_RECENT)})) WHERE ord NOT IN (1, 4)")
def recent_files_edited(spark, sf_dir):
    """Recent files after one was found again and two were removed."""
    files = Fixture(spark, sf_dir).sql(_RECENT)
    users = files.select("user_id").distinct()
    found = lists.located(files, users.select("user_id", F.lit(2).alias("ord"), F.lit("/found").alias("url")))
    return lists.closed_up(found, users.select("user_id", F.explode(F.array(F.lit(1), F.lit(4))).alias("ord")))


@query("SELECT user_id, event_id AS seq, event_type AS title, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS int) AS place FROM events QUALIFY place <= 50")
def notification_cap(spark, sf_dir):
    return lists.notices(Fixture(spark, sf_dir).table("events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("title")))


@query("SELECT o_orderkey AS file_id, o_custkey AS project_id FROM orders WHERE o_custkey % 5 <> 0")
def removed_projects(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    own = g.table("customer").select(F.col("c_custkey").alias("id"))
    return lists.removed_project(own, g.table("orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("project_id")), own.filter("id % 5 = 0"))[1].select("file_id", "project_id")


@query("SELECT user_id, seq, term, t + CASE WHEN term = '' THEN 0.0 ELSE 1800.0 END AS applies_at FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, seq) AS following FROM (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id AS seq, CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type END AS term FROM events)) WHERE term = '' OR following IS NULL OR following - t >= 1800")
def search_debounce(spark, sf_dir):
    log = Fixture(spark, sf_dir).table("events")
    typed = log.select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 6 == 0, "").otherwise(F.col("event_type")).alias("term"))
    return E.searches(typed, 1800.0)


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS int) AS place FROM (SELECT concat('o', c_custkey) AS doc_id FROM customer WHERE c_custkey % 3 <> 0)")
def analysis_queue(spark, sf_dir):
    docs = Fixture(spark, sf_dir).table("customer").select(F.concat(F.lit("o"), "c_custkey").alias("doc_id"), "c_custkey")
    states = docs.filter("c_custkey % 3 < 2").select("doc_id", F.when(F.col("c_custkey") % 3 == 0, "complete").otherwise("failed").alias("state"))
    return graph.analysis_queue(docs.select("doc_id"), states)


_AT = "SELECT concat('n', c_nationkey) AS grp, concat('c', c_custkey) AS node_id, CAST(c_custkey % 97 * 13 AS double) AS x, CAST(c_custkey % 89 * 11 AS double) AS y, CAST(c_custkey % 4 - 1 AS int) AS cluster FROM {customer}"


@query(with_tables("SELECT e.edge_id FROM edges e JOIN stands a ON a.node_id = e.src JOIN stands b ON b.node_id = e.tgt WHERE least(a.x, b.x) <= 700 AND greatest(a.x, b.x) >= 100 AND least(a.y, b.y) <= 500 AND greatest(a.y, b.y) >= 200", **D, stands=duck(_AT)))
def edges_in_view(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    return layout.edges_in_view(g.edges, g.sql(_AT), 100, 200, 600, 300).select("edge_id")


@query()
def cluster_layout(spark, sf_dir):
    """Customers of each nation in three clusters, shifted apart."""
    return layout.cluster_layout(Fixture(spark, sf_dir).sql(_AT))


@query(with_tables("SELECT a.grp, a.node_id, round(sum(25000 * (a.x - b.x) / d2 / sqrt(d2)), 3) AS fx FROM (SELECT x.*, y.x AS bx, y.y AS by_, greatest(1.0, (x.x - y.x) ** 2 + (x.y - y.y) ** 2) AS d2 FROM stands x JOIN stands y ON x.grp = y.grp AND x.node_id <> y.node_id) a, LATERAL (SELECT a.bx AS x) b GROUP BY ALL", stands=duck(_AT)))
def tree_repulsion(spark, sf_dir):
    """Repulsion by the tree of cells, opened down to single bodies."""
    return layout.tree_repulsion(Fixture(spark, sf_dir).sql(_AT), 0.0).select("grp", "node_id", F.round("fx", 3).alias("fx"))


@query(with_tables("SELECT n.node_id, abs(p.x - o.x) <= 80 AS near_x, abs(p.y - o.y) <= 80 AS near_y FROM (SELECT concat('o', o_orderkey) AS node_id, concat('c', o_custkey) AS c FROM orders) n JOIN stands o ON o.node_id = n.c, LATERAL (SELECT o.x AS x, o.y AS y) p", stands=duck(_AT)))
def place_near(spark, sf_dir):
    """New nodes stand within 80 of their first placed neighbour on each axis."""
    g = Fixture(spark, sf_dir)
    known = g.sql(_AT).select("node_id", "x", "y")
    links = g.table("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node_id"), F.concat(F.lit("c"), "o_custkey").alias("neighbour"))
    placed = layout.place_near(links.select("node_id"), links, known, 1200, 800)
    beside = links.join(known.select(F.col("node_id").alias("neighbour"), F.col("x").alias("nx"), F.col("y").alias("ny")), "neighbour")
    return placed.join(beside, "node_id").select("node_id", (F.abs(F.col("x") - F.col("nx")) <= 80).alias("near_x"), (F.abs(F.col("y") - F.col("ny")) <= 80).alias("near_y"))


@query(
    """SELECT event_id, CASE WHEN abs(px) <= 4 AND abs(py - 60) <= 4 THEN 'nw' WHEN abs(px - 100) <= 4 AND abs(py - 60) <= 4 THEN 'ne' WHEN abs(px) <= 4 AND abs(py) <= 4 THEN 'sw' WHEN abs(px - 100) <= 4 AND abs(py) <= 4 THEN 'se'
  WHEN abs(px - 50) <= 4 AND abs(py - 60) <= 4 THEN 'n' WHEN abs(px - 50) <= 4 AND abs(py) <= 4 THEN 's' WHEN abs(px) <= 4 AND abs(py - 30) <= 4 THEN 'w' WHEN abs(px - 100) <= 4 AND abs(py - 30) <= 4 THEN 'e' END AS handle,
  least(px, py) - 5 AS ink_x, abs(px - py) + 10 AS ink_w, CASE WHEN px >= 5 AND py >= 5 THEN px END AS drag_w, 20 - (20 - px) * 2.0 AS offset_x FROM (SELECT event_id, CAST(event_id * 7 % 105 AS double) AS px, CAST(event_id * 11 % 65 AS double) AS py FROM events)"""
)
def pointer_geometry(spark, sf_dir):
    at = Fixture(spark, sf_dir).table("events").select("event_id", (F.col("event_id") * 7 % 105).cast("double").alias("px"), (F.col("event_id") * 11 % 65).cast("double").alias("py"))
    box = G.rect(*map(F.lit, (0.0, 0.0, 100.0, 60.0)))
    ink = G.ink_box(F.array(F.struct(F.col("px").alias("x"), F.col("py").alias("y")), F.struct(F.col("py").alias("x"), F.col("px").alias("y"))))
    zero = F.lit(0.0)
    return at.select("event_id", G.handle_at(box, F.col("px"), F.col("py"), 8).alias("handle"), ink["x"].alias("ink_x"), ink["w"].alias("ink_w"), G.dragged(zero, zero, F.col("px"), F.col("py"))["w"].alias("drag_w"), G.zoomed_offset(F.col("px"), F.lit(20.0), F.lit(1.0), F.lit(2.0)).alias("offset_x"))
