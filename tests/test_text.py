"""Texts, outlines, JSON repair and extraction."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cartulary.functions import text as T
from cartulary.functions.json_repair import repaired
from cartulary.operators import extract
from cartulary.plans import pipelines
from cartulary.sources import outline
from cartulary.sources import text as pages_of
from tests.conftest import rows


def sanitized_loop(chapters, n):
    """One chapter after another, as plainly as can be."""
    kept, last = [], -1
    clean = [(max(0, min(s, n - 1)), k, t, max(0, min(e, n - 1))) for k, (t, s, e) in enumerate(chapters) if t.strip()]
    for s, _, t, e in sorted(clean):
        e = max(s, e)
        s = max(s, last + 1)
        if s <= e:
            kept.append((t, s, e))
            last = e
    return kept


def test_sanitized_chapters_equal_the_loop(spark):
    rng = random.Random(7)
    cases = {"fixed": [("a", 0, 4), ("b", 3, 6), ("c", 2, 3), ("d", 8, 20), (" ", 1, 2)]}
    cases |= {f"r{k}": [(rng.choice(["x", "y", " "]), rng.randint(-2, 14), rng.randint(-2, 14)) for _ in range(rng.randint(0, 8))] for k in range(300)}
    flat = [(d, k, *c) for d, cs in cases.items() for k, c in enumerate(cs)]
    counts = spark.createDataFrame([(d, 10) for d in cases], "doc_id string, n int")
    got = outline.sanitized(spark.createDataFrame(flat, "doc_id string, ord int, title string, page_start int, page_end int"), counts)
    want = sorted((d, *c) for d, cs in cases.items() for c in sanitized_loop(cs, 10))
    assert rows(got) == want
    assert [r[2:] for r in want if r[0] == "fixed"] == [(0, 4), (5, 6), (8, 9)]


def test_outline_in_pre_order_and_its_chapters(spark):
    tree = spark.createDataFrame([("d", 1, None, 0, "A", 0), ("d", 2, 1, 0, None, 3), ("d", 3, 2, 0, "B", 3), ("d", 4, None, 1, "C", 3), ("d", 5, None, 2, "D", 12)], "doc_id string, node int, parent int, sibling_ord int, title string, page int")
    flat = outline.flattened(tree)
    assert [r.title for r in flat.orderBy("ord").collect()] == ["A", "B", "C", "D"]
    got = outline.chapters_from_outline(flat, spark.createDataFrame([("d", 10)], "doc_id string, n int"))
    assert rows(got) == [("d", "A", 0, 2), ("d", "B", 3, 3), ("d", "C", 3, 9)]


@pytest.mark.parametrize(("n", "sections"), [(0, 0), (1, 1), (2, 2), (25, 4), (109, 11)])
def test_fallback_sections(spark, n, sections):
    assert outline.fallback_chapters(spark.createDataFrame([("d", n)], "doc_id string, n int")).count() == sections


def test_outline_without_valid_page_gives_no_chapters(spark):
    counts = spark.createDataFrame([("d", 5), ("e", 5), ("f", 5)], "doc_id string, n int")
    entries = spark.createDataFrame([("d", 0, "A", 9)], "doc_id string, ord int, title string, page int")
    proposed = spark.createDataFrame([("e", 0, "P", 0, 4), ("d", 0, "Q", 0, 4)], "doc_id string, ord int, title string, page_start int, page_end int")
    got = outline.chosen_chapters(counts, entries, proposed)
    assert {r.doc_id for r in got.collect()} == {"e", "f"}


def test_blank_pages_are_one_body_block(spark):
    p = spark.createDataFrame([("d", 0, "one\n\n  two  \nthree"), ("d", 1, " \n ")], "doc_id string, page int, text string")
    got = pages_of.text_blocks(p)
    assert [(r.page, r.line_no, r.text, r.block_type) for r in got.orderBy("page", "line_no").collect()] == [(0, 0, "one", None), (0, 2, "two", None), (0, 3, "three", None), (1, -1, " \n ", "body")]


def test_upper_median(spark):
    b = spark.createDataFrame([("d", 0, float(h)) for h in (4, 1, 3, 2)], "doc_id string, page int, h double")
    assert pages_of.median_heights(b).first().median_h == 3.0


def test_similarity(spark):
    cases = spark.createDataFrame([("Cost Function", "cost function ", 1.0), ("abc", "abd", 2 / 3), ("", "", 1.0), ("a", "", 0.0)], "a string, b string, want double")
    assert all(abs(r.got - r.want) < 1e-9 for r in cases.withColumn("got", T.similarity(F.col("a"), F.col("b"))).collect())


def test_passages(spark):
    page = "First the Quick\n  brown fóx jumps.\nThen (a+b) rests."
    cases = [("quick brown", True), ("FOX", True), ("then (a+b)  rests", True), ("absent", False), ("", False), (" \n", False), ("a\\Eb", False)]
    df = spark.createDataFrame([(page, s, w) for s, w in cases], "t string, s string, w boolean")
    assert [r for r in df.withColumn("g", T.passage_found(F.col("t"), F.col("s"))).collect() if r.g != r.w] == []


def test_block_classes(spark):
    cases = [("∑∫∂ x", 10.0, "equation"), ("Big", 20.0, "heading"), ("ALL CAPS", 10.0, "heading"), ("small note", 10.0, "footnote"), ("tiny", 5.0, "caption"), ("Figure 1", 10.0, "caption"), ("plain text.", 10.0, "body")]
    y = {"small note": 10.0}
    df = spark.createDataFrame([(t, h, y.get(t, 400.0), w) for t, h, w in cases], "t string, h double, y double, w string")
    got = df.withColumn("g", T.block_class(F.col("t"), F.col("h"), F.lit(10.0), F.col("y"), F.lit(842.0))).collect()
    assert [r for r in got if r.g != r.w] == []


def test_json_repair():
    assert json.loads(repaired('```json\n{"concepts": []}\n```')) == {"concepts": []}
    assert json.loads(repaired('{"concepts": [{"label": "a"}, {"label": "b"')) == {"concepts": [{"label": "a"}]} or json.loads(repaired('{"concepts": [{"label": "a"}, {"label": "b"'))["concepts"][0] == {"label": "a"}
    assert json.loads(repaired('{"a": [1, 2')) == {"a": [1, 2]}
    assert json.loads(repaired('{"a": "open')) == {"a": "open"}
    assert json.loads(repaired('{"concepts": [{"label": "á"}], "edges": [{"sourceLabel": "a", "tar'))["concepts"] == [{"label": "á"}]
    assert repaired("not json at all") == "not json at all"


def test_bad_elements_go_alone(spark):
    response = json.dumps({"concepts": [{"label": "A", "type": "odd", "textSpan": "s", "entities": [{"label": "E", "type": "odd", "textSpan": "t"}]}, {"label": "B"}]})
    df = spark.createDataFrame([("d", 0, response), ("d", 1, "nonsense"), ("d", 2, None)], "doc_id string, batch int, response string")
    got = extract.concepts_of(df).collect()
    assert sorted((r.label, r.type, r.level, r.confidence) for r in got) == [("A", "concept", "concept", 0.8), ("E", "definition", "entity", 0.8)]


def test_relations_bare_or_in_an_object(spark):
    one = [{"sourceLabel": "a", "targetLabel": "b", "type": "odd"}]
    df = spark.createDataFrame([("d", 0, json.dumps(one)), ("d", 1, json.dumps({"edges": one}))], "doc_id string, batch int, response string")
    assert [(r.batch, r.type, r.confidence) for r in extract.relations_of(df).orderBy("batch").collect()] == [(0, "sameTopic", 0.7), (1, "sameTopic", 0.7)]


def test_anchor_tiers(spark):
    long = "x" * 35
    p = spark.createDataFrame([("d", 0, f"Alpha beta\n{long} tail"), ("d", 7, "far away words that stand here only")], "doc_id string, page int, text string")
    spans = [("s1", "ALPHA beta"), ("s2", long + " other"), ("s3", "far away words that stand here or there"), ("s4", "nowhere"), ("s5", "  ")]
    df = spark.createDataFrame([(i, "d", 0, 5, s) for i, s in spans], "span_id string, doc_id string, page_lo int, page_hi int, span string")
    assert [r[:3] for r in rows(extract.resolve_anchors(df, pages_of.lines(p), p))] == [("s1", 1, 0), ("s2", 2, 0), ("s3", 3, 7)]


def test_upsert_takes_first_and_fills_summary(spark):
    df = spark.createDataFrame([("Kea", "concept", None, "concept", 0.8, "d", 0, "a", 0), ("KEA", "method", "bird", "entity", 0.9, "d", 4, "b", 1)], "label string, type string, summary string, level string, confidence double, doc_id string, page int, snippet string, ord int")
    n, a = extract.upsert_labels(df, ["ord"])
    assert [(r.label, r.type, r.level, r.summary) for r in n.collect()] == [("Kea", "concept", "concept", "bird")]
    assert [(r.ord, r.page) for r in a.orderBy("ord").collect()] == [(0, 0), (1, 4)]


def test_relation_guards(spark):
    e = spark.createDataFrame([("a", "b", "uses"), ("c", "d", "containsEntity")], "src string, tgt string, type string")
    r = spark.createDataFrame([("a", "b", "cites", 0.7, "p", 0), ("b", "a", "cites", 0.7, "p", 1), ("d", "c", "uses", 0.7, "p", 2), ("x", "y", "uses", 0.7, "p", 3), ("x", "y", "cites", 0.7, "p", 4), ("p", "q", "containsChapter", 0.7, "p", 5)], "src string, tgt string, type string, confidence double, phrase string, ord int")
    assert [x[:3] for x in rows(extract.insert_relations(r, e, ["ord"]).select("src", "tgt", "type"))] == [("b", "a", "cites"), ("x", "y", "uses")]
    assert rows(extract.insert_relations_deep(r, e, ["ord"]).select("src", "tgt", "type")) == [("x", "y", "uses")]


def test_pipelines_with_a_recorded_model(spark):
    p = spark.createDataFrame([("d", k, "Helicase opens the strand. Replication begins there.") for k in range(7)], "doc_id string, page int, text string")

    def model(prompt):
        if "sourceLabel" in prompt:
            return json.dumps([{"sourceLabel": "replication", "targetLabel": "Helicase", "type": "dependsOn"}, {"sourceLabel": "x", "targetLabel": "Helicase", "type": "uses"}])
        if '"facts"' in prompt:
            return json.dumps({"facts": [{"claim": "Replication", "textSpan": "Replication begins", "type": "concept"}, {"claim": "Helicase", "textSpan": "Helicase opens", "type": "concept"}]})
        return json.dumps({"concepts": [{"label": "Replication", "type": "concept", "textSpan": "Replication begins", "entities": [{"label": "Helicase", "type": "person", "textSpan": "helicase opens"}]}, {"label": "Invented", "type": "concept", "textSpan": "not in the text"}]})

    g = pipelines.fast(p, model)
    n = {r.label: r for r in g["nodes"].collect()}
    assert {"Replication", "Helicase", "d"} <= set(n) and "Invented" not in n
    e = {(r.src, r.tgt, r.type) for r in g["edges"].collect()}
    assert (n["Replication"].node_id, n["Helicase"].node_id, "containsEntity") in e
    assert (n["Replication"].node_id, n["Helicase"].node_id, "dependsOn") not in e  # an edge is there already
    assert [r.state for r in g["states"].collect()] == ["complete"]
    d = pipelines.deep(p, model)
    m = {r.label: r.node_id for r in d["nodes"].collect()}
    assert (m["Replication"], m["Helicase"], "dependsOn") in {(r.src, r.tgt, r.type) for r in d["edges"].collect()}
    assert sorted((r.page) for r in d["anchors"].collect() if r.node_id == m["Helicase"]) == [0, 5]


def test_deep_pipeline_builds_what_the_clusters_answer_says(spark):
    p = spark.createDataFrame([(d, k, "Text.") for d in "de" for k in range(7)], "doc_id string, page int, text string")

    def model(prompt):
        if "sourceLabel" in prompt:
            return json.dumps([{"sourceLabel": "Copying", "targetLabel": "Fork", "type": "uses"}, {"sourceLabel": "Copying", "targetLabel": "Repair", "type": "dependsOn"}] if "Copying: how" in prompt and "Fork" not in prompt else [])
        if '"facts"' in prompt:
            return json.dumps({"facts": [{"claim": c, "textSpan": "span of " + c, "type": "claim"} for c in ("a", "b", "c")]})
        if '"chapters"' in prompt:
            return "no chapters"
        if " of e " in prompt:
            return "no answer"
        assert "0 (claim): a" in prompt and "5 (claim): c" in prompt
        fork = {"label": "Fork", "type": "strange", "summary": "where", "factIndices": [4]}
        return json.dumps({"concepts": [{"label": "Copying", "type": "method", "summary": "how", "level": "concept", "factIndices": [3, 1, 0, 99], "entities": [fork, {"label": "Lost", "type": "person", "factIndices": [-1]}]}, {"label": "Repair", "type": "x", "level": "concept", "factIndices": [2]}, {"label": "Empty", "type": "claim", "level": "concept", "factIndices": [77], "entities": [fork | {"label": "Gone"}]}]})

    g = pipelines.deep(p, model)
    n = {r.label: r for r in g["nodes"].collect() if r.level in ("concept", "entity")}
    assert {k: (r.type, r.level, r.confidence, r.summary) for k, r in n.items()} == {
        "Copying": ("method", "concept", 0.9, "how"),
        "Fork": ("definition", "entity", 0.85, "where"),
        "Repair": ("concept", "concept", 0.9, None),
        **{k: ("claim", "concept", 0.9, None) for k in "abc"},
    }
    ids = {r.node_id: k for k, r in n.items()}
    anchors = sorted((ids[r.node_id], r.ord, r.doc_id, r.page, r.snippet) for r in g["anchors"].collect())
    assert anchors[:4] == [("Copying", 0, "d", 5, "span of a"), ("Copying", 1, "d", 0, "span of b"), ("Fork", 0, "d", 5, "span of b"), ("Repair", 0, "d", 0, "span of c")]
    assert anchors[4:] == [(k, o, "e", 5 * o, "span of " + k) for k in "abc" for o in (0, 1)]
    edges = {(ids[r.src], ids[r.tgt], r.type) for r in g["edges"].collect() if r.src in ids and r.tgt in ids}
    assert edges == {("Copying", "Fork", "containsEntity"), ("Copying", "Repair", "dependsOn")}
