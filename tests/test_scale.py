"""What must not grow with the number of copies: rows that joins make, told by Spark's own metrics."""

import math

import numpy as np
from pyspark.sql import functions as F

from cartulary import tables
from cartulary.operators import answer, extract, graph, layout, merge, search
from cartulary.plans import pipelines, state_queries
from cartulary.plans.fixtures import Fixture
from cartulary.sources import text
from tests.conftest import rows


def joined(df):
    """The most rows that one join of df's plan made, and df's rows."""
    found = sorted(tuple(r) for r in df.collect())
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            plan.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            plan.append(node.plan())
        elif name == "ReusedExchange":
            plan.append(node.child())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        plan += [children.apply(i) for i in range(children.size())]
    return most, found


def test_citations_and_snippets_that_repeat_meet_once(spark):
    n = 400
    cited = spark.range(n).select(F.col("id").alias("citation_id"), F.element_at(F.array(F.lit("THE Same"), F.lit("nothing like it"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit(3).alias("page"))
    at = spark.range(n).select(F.concat(F.lit("n"), F.col("id") + 1000).alias("node_id"), F.lit(0).alias("ord"), F.lit("d").alias("doc_id"), F.lit(3).alias("page"), F.when(F.col("id") % 2 == 1, "of the same words").otherwise("other").alias("snippet"))
    most, found = joined(search.citation_anchors(cited, at))
    assert found == [(i, "n1001" if i % 3 == 0 else "n1000", 0, i % 3 == 0) for i in range(n)]
    assert 0 < most <= 2 * n
    assert joined(search.citation_anchors(cited.withColumn("doc_id", F.lit("d")), at, same_document=True))[1] == found


def test_questions_with_the_same_citation_meet_its_anchors_once(spark):
    n = 400
    said = F.array(F.struct(F.lit("IN D1 on").alias("text"), F.lit(2).alias("pageIndex")), F.struct(F.lit("x").alias("text"), F.lit(None).cast("int").alias("pageIndex")))
    replies = spark.range(n).select(F.col("id").alias("question_id"), F.lit("assistant").alias("role"), said.alias("citations"))
    at = spark.range(n).select(F.concat(F.lit("n"), F.col("id") + 1000).alias("node_id"), F.lit(0).alias("ord"), F.lit("d").alias("doc_id"), F.lit(2).alias("page"), F.concat(F.lit("seen in d"), F.col("id") % 5, F.lit(" on 2")).alias("snippet"))
    most, found = joined(answer.cited(replies, at))
    assert found == [(i, 0, "n1001", True) for i in range(n)]
    assert 0 < most <= 2 * n


def test_pairs_of_chapters_are_made_once_and_not_joined(spark, monkeypatch):
    n = 120
    pages = spark.range(n).select(F.concat(F.lit("doc"), "id").alias("doc_id"), F.lit(0).alias("page"))
    nodes = spark.createDataFrame([(x, x, "concept", "concept", 0.9, None) for x in "abc"], "node_id string, label string, type string, level string, confidence double, summary string")
    anchors = pages.crossJoin(nodes.select("node_id")).filter("node_id <> 'c' or doc_id < 'doc2'").select("node_id", F.lit(0).alias("ord"), "doc_id", "page", F.lit("").alias("snippet"))
    edges = spark.createDataFrame([("1", "a", "b", "uses", 1.0, None), ("2", "b", "c", "uses", 1.0, None), ("3", "b", "c", "cites", 1.0, None)], "edge_id string, src string, tgt string, type string, confidence double, label string")
    sections = pages.select("doc_id", F.lit("all").alias("title"), F.lit(0).alias("page_start"))
    made = pipelines.folded(pages, nodes, anchors, edges, sections)
    most, found = joined(made["edges"].filter("label = 'aggregated'"))
    c = len({f"doc{i}" for i in range(n) if f"doc{i}" < "doc2"})
    assert len(found) == len({r[1:4] for r in found}) == n * (n - 1) + c * (n - 1)
    assert most <= 5 * n
    monkeypatch.setattr(graph, "FROM", 7)
    monkeypatch.setattr(graph, "TO", 11)
    monkeypatch.setattr(graph, "ROWS", 50)
    # two of the edges are there already, and one of another type
    plain = [r[1:4] for r in found]
    have = made["edges"].filter("label is null").select("src", "tgt", "type").union(spark.createDataFrame([plain[0], plain[-1], (*plain[1][:2], "extends")], "src string, tgt string, type string"))
    want = rows(graph.chapter_edges(made["nodes"], have))
    assert rows(graph.chapter_edges_in_blocks(made["nodes"], have, n)) == want
    assert len(want) == len(found) - 2


def test_relations_of_a_concept_are_not_repeated_for_each_of_its_chapters(spark):
    n, m = 150, 40
    chapters = [f"s{i}" for i in range(n)] + ["far"]
    nodes = spark.createDataFrame([(x, "chapter") for x in chapters] + [(x, "concept") for x in ["hub", *(f"t{i}" for i in range(m))]], "node_id string, level string")
    held = [(f"s{i}", "hub", "containsConcept") for i in range(n)] + [("far", f"t{i}", "containsConcept") for i in range(m)]
    edges = spark.createDataFrame(held + [("hub", f"t{i}", "uses") for i in range(m)] + [("s1", "far", "uses"), ("s2", "far", "cites")], "src string, tgt string, type string")
    most, found = joined(graph.chapter_edges_in_blocks(nodes, edges, n + 1))
    assert [r[:3] for r in found] == sorted((f"s{i}", "far", "uses") for i in range(n) if i != 1)
    assert most <= 2 * (n + m)
    assert rows(graph.chapter_edges(nodes, edges)) == found


def test_spans_meet_the_blocks_of_their_batch_once(spark, monkeypatch):
    n = 30
    p = spark.range(8).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("page"), F.array_join(F.array_repeat(F.concat(F.lit("The same words on "), "id"), 4), "\n").alias("text"))
    at = "span_id string, doc_id string, page_lo int, page_hi int, span string"
    spans = spark.createDataFrame([(f"s{i:02}", "d", 0, 5, "the same words") for i in range(n)], at)
    tables_made = []
    monkeypatch.setattr(extract, "stored", lambda df, label: (tables_made.append(df) or df, label))
    assert {r[1:4] for r in rows(extract.resolve_anchors(spans, text.lines(p), p))} == {(1, 0, 0)}
    assert 0 < joined(tables_made[0])[0] <= n
    # ranges end within a row of pages, or go over two
    spans = spark.createDataFrame([("a", "d", 3, 8, "words on 7"), ("b", "d", 3, 7, "words on 7"), ("c", "d", 3, 7, "words on"), ("e", "d", 7, 7, "words on 6"), ("f", "d", 0, 8, "words on 9"), ("g", "d", 6, 8, "Words on 6\n")], at)
    assert [r[:4] for r in rows(extract.resolve_anchors(spans, text.lines(p), p))] == [("a", 1, 7, 0), ("b", 3, 7, -1), ("c", 1, 3, 0), ("e", 3, 6, -1), ("g", 1, 6, 0)]


def test_a_response_is_read_once_for_concepts_and_their_entities(spark):
    responses = spark.createDataFrame([("d", 0, '{"concepts": [{"label": "A", "textSpan": "a", "entities": [{"label": "B"}, {"label": "C", "textSpan": "c"}]}]}')], "doc_id string, batch int, response string")
    found = extract.concepts_of(responses)
    assert rows(found.select("ord", "entity_ord", "label", "level").fillna(-1)) == [(0, -1, "A", "concept"), (0, 1, "C", "entity")]
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_pages_are_cut_without_a_shuffle_unless_ids_repeat(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb\r\nc\rd\n\n"), (2, None), (3, "x\n" * 8)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "once" / "documents.parquet"))
    docs.union(docs.filter("doc_id = 1")).write.parquet(str(tmp_path / "twice" / "documents.parquet"))
    once, twice = (Fixture(spark, str(tmp_path / at)).pages for at in ("once", "twice"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert rows(once) == [("doc1", 0, "a\nb\nc\nd"), ("doc1", 1, "\n"), ("doc2", 0, ""), ("doc3", 0, "x\nx\nx\nx"), ("doc3", 1, "x\nx\nx\nx"), ("doc3", 2, "")]
    assert rows(twice)[0] == ("doc1", 0, "a\na\nb\nb\nc\nc\nd\nd")
    assert rows(twice)[2:] == rows(once)[2:]


def test_the_fast_pipeline_keeps_no_table_of_places(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda spark: f"file://{tmp_path}")
    pages = spark.createDataFrame([("d", 0, "Energy is kept. Always.\nMomentum too.")], "doc_id string, page int, text string")
    assert pipelines.fast(pages, pipelines.rule_based)["anchors"].count() > 0
    left = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert "anchored" in left and "anchors" not in left
    assert "span" not in spark.read.parquet(*(str(p) for p in tmp_path.iterdir() if p.name.startswith("anchored"))).columns


def test_tree_forces_equal_a_walk_of_each_point_alone():
    rng = np.random.default_rng(3)
    xy = np.round(rng.random((300, 2)) * 40) * 7
    xy[:40] = xy[0]

    def alone(p, own, corner, side, depth):
        center = xy[own].mean(0)
        if side < layout.THETA * math.dist(p, center):
            bodies, mass = center[None], len(own)
        elif len(own) <= 8 or depth >= layout.DEEPEST:
            bodies, mass = xy[own], 1
        else:
            half = side / 2
            quarter = (xy[own, 0] >= corner[0] + half) + 2 * (xy[own, 1] >= corner[1] + half)
            return sum((alone(p, own[quarter == q], corner + half * np.array([q & 1, q >> 1]), half, depth + 1) for q in range(4) if (quarter == q).any()), np.zeros(2))
        delta = p - bodies
        return (layout.REPULSION * mass * delta / np.maximum(1.0, (delta**2).sum(1))[:, None] ** 1.5).sum(0)

    wanted = [alone(p, np.arange(len(xy)), xy.min(0), float(np.ptp(xy, axis=0).max()), 0) for p in xy]
    assert np.allclose(layout.tree_forces(xy), wanted, rtol=1e-9, atol=1e-7)


def test_tree_forces_take_few_steps_of_numpy(monkeypatch):
    steps, real = [], np.sqrt
    monkeypatch.setattr(np, "sqrt", lambda *a: steps.append(1) or real(*a))
    layout.tree_forces(np.random.default_rng(0).random((600, 2)) * 800)
    # three a level, however many cells a level has
    assert len(steps) <= 3 * (layout.DEEPEST + 1)


def test_separated_moves_points_one_after_another_without_an_array_a_pair(monkeypatch):
    rng = np.random.default_rng(5)
    xy, fixed = np.round(rng.random((60, 2)) * 60) * 10, rng.random(60) < 0.2
    wanted = xy.copy()
    for _ in range(3):
        for i in range(60):
            for j in [j for j in range(i + 1, 60) if ((wanted[j] - wanted[i]) ** 2).sum() < layout.APART**2]:
                step = wanted[j] - wanted[i]
                d = math.hypot(*step)
                if d < layout.APART and not (fixed[i] and fixed[j]):
                    push = (step / d if d > 1e-9 else np.array([1.0, 0.0])) * (layout.APART - d) * (1.0 if fixed[i] or fixed[j] else 0.5)
                    wanted[i] -= push * (not fixed[i])
                    wanted[j] += push * (not fixed[j])
    made, real = [], np.array
    monkeypatch.setattr(np, "array", lambda *a, **b: made.append(1) or real(*a, **b))
    assert (layout.separated(xy, fixed, sweeps=3) == wanted).all()
    assert (layout.separated(np.zeros((30, 2)), np.zeros(30, bool), sweeps=1)[:, 0] != 0).any()
    assert len(made) <= 8


def test_graphs_are_laid_out_in_tasks_of_their_own(spark):
    for query, sides in ((state_queries.force_layout, 2), (state_queries.resolve_overlaps, 1)):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") == sides


def test_nodes_with_the_same_label_and_documents_meet_others_in_chunks(spark):
    n = 1100
    side = lambda first, label: spark.range(n).select(F.concat(F.lit(first), F.col("id")).alias("node_id"), F.lit(label).alias("label"), F.array(F.concat(F.lit("s"), F.col("id") % 2)).alias("docs"))
    proposals = merge.merge_proposals(side("a", "blue bolt"), side("b", "blue bolts"), 0.7)
    most, found = joined(proposals.groupBy("id_a", "similarity", "reason").agg(F.count_distinct("id_b").alias("n"), F.count("*").alias("rows")))
    assert [(r[0], r[2:]) for r in found] == sorted((f"a{i}", ("similar label", n // 2, n // 2)) for i in range(n))
    assert most <= 2 * n


def test_labels_that_many_nodes_have_meet_once_for_each_set_of_documents(spark):
    n = 300
    side = lambda first, label: spark.range(n).select(F.concat(F.lit(first), F.col("id") + 1000).alias("node_id"), F.lit(label).alias("label"), F.lit("concept").alias("level"), F.array(F.concat(F.lit("s"), F.col("id") % 3)).alias("docs"))
    none = spark.createDataFrame([], "labelA string, labelB string, confidence double, reason string, mergeType string")
    most, found = joined(merge.semantic_proposals(side("a", "blue bolt"), side("b", "blue bolts"), none))
    # the first nodes of both sides are in one document
    assert [(r[0], r[1]) for r in found] == [("a1000", "b1001")]
    assert most <= 100
