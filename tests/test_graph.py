"""Graph operators on small literal graphs."""

import random

import pytest
from pyspark.sql import functions as F

from cartulary.operators import fold, graph, merge, search, sync
from cartulary.sources import graph_files
from tests.conftest import rows


def nodes(spark, *items):
    """(id, level)"""
    return spark.createDataFrame([(i, i, "concept", None, "unseen", 0.9, False, lv) for i, lv in items], "node_id string, label string, type string, summary string, reading_state string, confidence double, is_pinned boolean, level string")


def edges(spark, *items):
    """(src, tgt, type)"""
    return spark.createDataFrame([(f"e{k}", *x, 1.0, None) for k, x in enumerate(items)], "edge_id string, src string, tgt string, type string, confidence double, label string")


def anchors(spark, *items):
    """(node, ord, doc, page)"""
    return spark.createDataFrame([(*x, f"snippet of {x[0]}") for x in items], "node_id string, ord int, doc_id string, page int, snippet string")


TWO = [("A", "chapter"), ("B", "chapter"), ("A1", "concept"), ("B1", "concept")]
TWO_EDGES = [("A", "A1", "containsConcept"), ("B", "B1", "containsConcept"), ("A1", "B1", "dependsOn")]


def test_chapter_edges_of_two_chapters_and_again(spark):
    n, e = nodes(spark, *TWO), edges(spark, *TWO_EDGES)
    got = graph.chapter_edges(n, e)
    assert rows(got) == [("A", "B", "dependsOn", 0.7, "aggregated")]
    again = e.unionByName(got.withColumn("edge_id", F.lit("new")))
    assert graph.chapter_edges(n, again).count() == 0


def test_no_chapter_edges_within_a_chapter_or_of_containment(spark):
    one = edges(spark, ("A", "A1", "containsConcept"), ("A", "B1", "containsConcept"), ("A1", "B1", "dependsOn"))
    assert graph.chapter_edges(nodes(spark, *TWO), one).count() == 0
    assert graph.chapter_edges(nodes(spark, *TWO), edges(spark, *TWO_EDGES[:2])).count() == 0


def test_chapter_edges_of_several_parents(spark):
    n = nodes(spark, ("X", "chapter"), ("Y", "chapter"), ("Z", "chapter"), ("A1", "concept"), ("B1", "concept"))
    e = edges(spark, ("X", "A1", "containsConcept"), ("Y", "A1", "containsConcept"), ("Z", "B1", "containsConcept"), ("A1", "B1", "dependsOn"))
    assert [r[:2] for r in rows(graph.chapter_edges(n, e))] == [("X", "Z"), ("Y", "Z")]


def test_incident_counts_a_loop_once_and_neighbours_keep_doubles(spark):
    e = edges(spark, ("A", "A", "uses"), ("A", "B", "uses"), ("A", "B", "cites"))
    assert rows(graph.degrees(e)) == [("A", 3), ("B", 2)]
    got = graph.neighbours(e, nodes(spark, ("A", "concept"), ("B", "concept")))
    assert sorted(r.neighbour for r in got.collect() if r.node_id == "A") == ["A", "B", "B"]


def test_document_pairs_without_anything_stay(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    at = anchors(spark, ("n", 0, "a", 1), ("n", 1, "b", 1), ("m", 0, "b", 2), ("k", 0, "a", 0))
    got = {(r.doc_a, r.doc_b): (r.shared, r.edge_counts) for r in graph.document_pairs(docs, at, edges(spark, ("k", "m", "uses"), ("m", "k", "uses"))).collect()}
    assert got == {("a", "b"): (1, {"uses": 2}), ("a", "c"): (0, {}), ("b", "c"): (0, {})}


def test_page_filter_needs_one_anchor_for_both(spark):
    at = anchors(spark, ("n", 0, "a", 1), ("n", 1, "b", 2))
    assert graph.nodes_on_page(nodes(spark, ("n", "concept")), at, "a", 2).count() == 0


def test_merge_takes_the_later_and_keeps_own_on_ties(spark):
    schema = "node_id string, label string, last_modified timestamp"
    row = lambda label, t: spark.sql(f"select 'x' node_id, '{label}' label, timestamp_seconds({t}) last_modified")
    assert schema
    for own, incoming, want in (("New", "Old", "New"), ("Old", "New", "New")):
        times = {"New": 1_800_000_000, "Old": 1_700_000_000}
        assert [r.label for r in merge.merge_nodes(row(own, times[own]), row(incoming, times[incoming])).collect()] == [want]
    assert [r.label for r in merge.merge_nodes(row("own", 5), row("incoming", 5)).collect()] == ["own"]


def test_merged_edges_have_no_new_doubles(spark):
    own, incoming = edges(spark, ("a", "b", "containsEntity"), ("a", "b", "containsEntity")), edges(spark, ("a", "b", "containsEntity"), ("b", "c", "uses"), ("b", "c", "uses"))
    assert sorted((r.src, r.tgt) for r in merge.merge_edges(own, incoming).collect()) == [("a", "b"), ("a", "b"), ("b", "c")]


def test_execute_merge_follows_chains(spark):
    n = nodes(spark, ("a", "concept"), ("b", "concept"), ("c", "concept"), ("e", "entity"))
    e = edges(spark, ("a", "e", "containsEntity"), ("a", "b", "uses"), ("x", "a", "cites"))
    at = anchors(spark, ("a", 0, "d", 1), ("c", 0, "d", 2))
    m = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    n2, e2, a2 = merge.execute_merges(n, e, at, m)
    assert sorted(r.node_id for r in n2.collect()) == ["c", "e"]
    assert sorted((r.src, r.tgt, r.type) for r in e2.collect()) == [("c", "e", "containsEntity"), ("x", "c", "cites")]
    assert sorted((r.node_id, r.ord, r.page) for r in a2.collect()) == [("c", 0, 2), ("c", 1, 1)]


def test_scopes(spark):
    n, e = nodes(spark, ("a1", "concept"), ("a2", "concept"), ("b1", "concept")), edges(spark, ("a1", "a2", "dependsOn"), ("a1", "b1", "sameTopic"))
    at = anchors(spark, ("a1", 0, "a.pdf", 0), ("a2", 0, "a.pdf", 1), ("b1", 0, "b.pdf", 0))
    kept, met = graph_files.scoped(n, e, at, "a.pdf")
    assert (kept.count(), met.count()) == (2, 1)


def test_lossy_decoding(spark):
    node = '{"node_id":"%s","label":"x","type":"concept","level":"concept","confidence":1.0}'
    good = '{"nodes":[%s,%s],"edges":[{"edge_id":"1","src":"a","tgt":"b","type":"dependsOn","confidence":1.0},{"edge_id":"2","src":"a","tgt":"b","type":"subtopicOf","confidence":1.0},{"edge_id":"3","src":"a"}],"documentProcessingState":{"d":"complete"}}' % (node % "a", node % "b")
    bad = '{"nodes":[%s,{"node_id":"c"}],"edges":[]}' % (node % "a")
    n, e, s = graph_files.decoded(spark.createDataFrame([("good", good), ("bad", bad), ("none", "no json")], "key string, payload string"))
    assert sorted(r.node_id for r in n.collect()) == ["a", "b"]
    assert [r.edge_id for r in e.collect()] == ["1"]
    assert [(r.doc_id, r.state) for r in s.collect()] == [("d", "complete")]


def test_sweep_takes_only_graph_files_without_document(spark):
    alive = spark.createDataFrame([("file:///a.pdf",)], "url string")
    name = alive.select(graph_files.file_of(F.col("url"))).first()[0]
    files = spark.createDataFrame([(name,), ("0123.json",), ("project_x.json",), ("embeddings_1.json",), ("etr_audit_1.json",), ("x.txt",)], "file string")
    assert rows(graph_files.orphans(files, alive)) == [("0123.json",), ("project_x.json",)]


def test_fresh_payloads_skip_null_checks(spark):
    stored = spark.createDataFrame([("a", 10.0, 5, "p"), ("b", 10.0, 5, "p"), ("c", None, None, "p"), ("d", 10.0, 5, "p")], "url string, mtime double, size int, payload string")
    files = spark.createDataFrame([("a", 11.0, 5), ("b", 11.1, 5), ("c", 1.0, 1)], "url string, file_mtime double, file_size int")
    assert [r[0] for r in rows(graph_files.fresh_payloads(stored, files))] == ["a", "c", "d"]


def test_attach_concepts_to_chapters(spark):
    chapters = spark.createDataFrame([("d", "ch1", 2), ("d", "ch2", 6)], "doc_id string, node_id string, page_start int")
    concepts = spark.createDataFrame([("d", f"c{k}", p) for k, ps in enumerate([[1], [5], [6, 7], [5, 6]]) for p in ps], "doc_id string, node_id string, page int")
    got = fold.attach_concepts(chapters, concepts, edges(spark, ("ch1", "c1", "containsConcept")))
    assert [r[:2] for r in rows(got)] == [("ch1", "c3"), ("ch2", "c2"), ("ch2", "c3")]


def test_highlight_diff_turns_present_into_wanted(spark):
    schema = "doc_id string, node_id string, page int, x double, y double, w double, h double, color int"
    row = lambda k, color: ("d", f"n{k}", 0, 10.0 + 50 * k, 10.0, 40.0, 20.0, color)
    wanted, present = spark.createDataFrame([row(0, 1), row(1, 1), row(2, 1)], schema), spark.createDataFrame([row(1, 1), row(2, 2), row(3, 1)], schema)
    got = {r.node_id: r.action for r in sync.highlight_diff(wanted, present).collect()}
    assert got == {"n0": "add", "n1": "keep", "n2": "recolour", "n3": "remove"}
    assert {r.action for r in sync.highlight_diff(wanted, present.limit(0)).collect()} == {"add"}


def test_citations(spark):
    at = spark.createDataFrame([("n1", 0, "d", 5, "light energy is converted into chemical energy"), ("n0", 0, "d", 5, "other")], "node_id string, ord int, doc_id string, page int, snippet string")
    cited = spark.createDataFrame([("q1", "Light energy is converted", 5), ("q2", "nothing like it", 5), ("q3", "x", None), ("q4", "x", 9)], "citation_id string, text string, page int")
    assert rows(search.citation_anchors(cited, at)) == [("q1", "n1", 0, True), ("q2", "n0", 0, False)]


def test_palette_appends_a_page(spark):
    n = nodes(spark, ("chapter 3", "chapter"), ("x", "concept"))
    assert [(r.kind, r.target) for r in search.command_palette(n, "3").collect()] == [("node", "chapter 3"), ("page", "2")]
    assert [r.kind for r in search.command_palette(n, "chap").collect()] == ["node"]


def test_operators_take_empty_tables(spark):
    n, e, at = nodes(spark, *TWO).limit(0), edges(spark, *TWO_EDGES).limit(0), anchors(spark, ("a", 0, "d", 0)).limit(0)
    assert graph.chapter_edges(n, e).count() == 0
    assert graph.top_by_degree(n, e, at).count() == 0
    assert merge.merge_edges(e, e).count() == 0
    assert search.question_context(n, e).count() == 1


def test_proposals_need_documents_apart(spark):
    schema = "node_id string, label string, docs array<string>, level string"
    a = spark.createDataFrame([("a1", "Cost Function", ["d1"], "concept"), ("a2", "abc", ["d1"], "concept")], schema)
    b = spark.createDataFrame([("b1", "cost function ", ["d2"], "concept"), ("b2", "cost function", ["d1"], "concept"), ("b3", "abd", ["d2"], "concept")], schema)
    got = merge.merge_proposals(a, b, 0.6)
    assert [(r[0], r[1], round(r[4], 3), r[5]) for r in rows(got)] == [("a1", "b1", 1.0, "same label"), ("a2", "b3", 0.667, "similar label")]


def test_merges_are_followed_to_the_end_of_any_chain(spark):
    m = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(70)] + [("z", "n005")], "source string, target string")
    assert rows(merge.resolved_merges(m)) == [(f"n{k:03}", "n070") for k in range(70)] + [("z", "n070")]
    with pytest.raises(ValueError, match="circle"):
        merge.resolved_merges(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "source string, target string"))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.7, 0.9])
def test_proposals_lose_no_pair_of_similar_labels(spark, least):
    rng = random.Random(int(10 * least))
    words = ["", "a", "b", "ab", "ba", *("".join(rng.choice("abé") for _ in range(rng.randrange(1, 15))) for _ in range(60))]
    near = [w[:k] + rng.choice(["", "a", "bb"]) + w[k + rng.randrange(3) :] for w in words for k in [rng.randrange(len(w) + 1)]]
    schema = "node_id string, label string, docs array<string>"
    made = lambda side, labels: spark.createDataFrame([(f"{side}{k}", x, [side]) for k, x in enumerate([*labels, None])], schema)
    got = {(r.id_a, r.id_b): r.similarity for r in merge.merge_proposals(made("a", words), made("b", near), least).collect()}
    want = {}
    for i, x in enumerate(words):
        for j, y in enumerate(near):
            alike = 1.0 if x == y else 1.0 - distance(x, y) / max(len(x), len(y))
            if alike > least and abs(len(x) - len(y)) <= (1 - least) * max(len(x), len(y)):
                want[f"a{i}", f"b{j}"] = alike
    assert got == want and want
