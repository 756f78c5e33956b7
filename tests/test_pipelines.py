"""Pipelines with models that count their calls, projects, questions, names and layouts against plain versions."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from cartulary.functions import text as T
from cartulary.models import PromptModel, create_model, filled
from cartulary.operators import answer, extract, lists, merge
from cartulary.plans import pipelines
from cartulary.sources import outline, projects
from cartulary.tables import shared_folder
from tests.conftest import rows

PAGES = [("a", k, f"Alpha{k} is here.\nBeta{k} follows it.") for k in range(12)] + [("b", 0, "Gamma stands alone.")]


def paged(spark, data=PAGES):
    return spark.createDataFrame(data, "doc_id string, page int, text string")


def logged(path, model):
    """A model that leaves each prompt as a line of a file."""

    def run(prompt):
        with open(path, "a") as f:
            f.write(json.dumps(prompt) + "\n")
        return model(prompt)

    return run


def prompts_in(path):
    return [json.loads(line) for line in open(path)] if os.path.exists(path) else []


def test_each_batch_is_asked_once_and_knows_the_labels_before(spark, tmp_path):
    log = str(tmp_path / "log")
    entries = spark.createDataFrame([("a", 0, "Opening", 0), ("a", 1, "Closing", 7)], "doc_id string, ord int, title string, page int")
    graph = pipelines.fast(paged(spark), logged(log, pipelines.rule_based), entries)
    for part in graph.values():
        part.collect()
    asked = prompts_in(log)
    batches = [p for p in asked if p.startswith("List the concepts")]
    # three batches of a and one of b, then a relation call each; b has no outline and is shown whole
    assert len(batches) == 4 and len([p for p in asked if "sourceLabel" in p]) == 4 and len([p for p in asked if '"chapters"' in p]) == 1
    known = {p.split("Pages: ")[1].split("\n")[0]: p.split("Known labels: ")[1].split("\n")[0] for p in batches if "Document: a" in p}
    assert known["0-5"] == "" and "Alpha0" in known["5-10"] and "Alpha9" not in known["5-10"] and "Alpha9" in known["10-12"]
    assert all("Outline: Opening; Closing\n" in p for p in batches if "Document: a" in p) and all("Outline: \n" in p for p in batches if "Document: b" in p)
    titles = {r.label for r in graph["nodes"].filter("level = 'chapter'").collect()}
    assert {"Opening", "Closing", "Section 1"} <= titles
    assert {r.doc_id: r.state for r in graph["states"].collect()} == {"a": "complete", "b": "complete"}


def test_all_names_of_a_chunk_are_read(spark):
    names = [f"Name{chr(97 + k)}" for k in range(26)]
    pages = paged(spark, [("a", 0, "\n".join(f"{n} is one." for n in names))])
    found = {r.label for r in pipelines.fast(pages, pipelines.rule_based)["nodes"].filter("level = 'concept'").collect()}
    assert {n.split()[0] for n in found} == set(names)


def test_a_model_proposes_chapters_or_fails(spark):
    def proposing(prompt):
        return json.dumps({"chapters": [{"title": "Whole", "pageStart": 0, "pageEnd": 99}]}) if "--- Page 12 ---" in prompt else "nothing"

    got = rows(pipelines.chapters(paged(spark), proposing))
    assert ("a", "Whole", 0, 11) in got and ("b", "Section 1", 0, 0) in got
    assert rows(pipelines.chapters(paged(spark), lambda p: '{"chapters": []}')) == []


def test_deep_pipeline_clusters_facts(spark, tmp_path):
    log = str(tmp_path / "log")
    pages = paged(spark, [("a", 0, "Alpha first thing.\nAlpha second thing.\nBeta alone."), ("a", 5, "Alpha first again.")])
    graph = pipelines.deep(pages, logged(log, pipelines.rule_based))
    anchors, edges = graph["anchors"].collect(), graph["edges"].collect()
    nodes = {r.node_id: r for r in graph["nodes"].collect()}
    assert {r.label for r in nodes.values() if r.level == "entity"} == {"Alpha first", "Alpha second", "Beta alone"}
    alpha = next(k for k, r in nodes.items() if r.level == "concept" and r.label.lower() == "alpha")
    assert sorted(r.page for r in anchors if r.node_id == alpha) == [0, 5]
    assert {nodes[e.tgt].label for e in edges if e.src == alpha and e.type == "containsEntity"} == {"Alpha first", "Alpha second"}
    kinds = [next(k for k in ('"facts"', "factIndices", "sourceLabel", '"chapters"') if k in p) for p in prompts_in(log)]
    assert sorted(kinds) == sorted(['"facts"'] * 2 + ["factIndices", "sourceLabel", '"chapters"'])


def test_unreadable_responses_leave_states(spark):
    model = lambda p: pipelines.rule_based(p) if "Pages: 0-5" in p or "Pages" not in p else "broken"
    states = {r.doc_id: r.state for r in pipelines.fast(paged(spark), model)["states"].collect()}
    assert states == {"a": "partial", "b": "failed"}


def test_questions_have_answers_or_errors(spark):
    asked = spark.createDataFrame([(1, "what?", '{"answer": "that", "citations": [{"text": "Seen", "pageIndex": 3}, {"text": "x"}]}'), (2, "why?", None), (3, "who?", "no JSON")], "question_id int, question string, response string")
    found = answer.messages(asked)
    assert [(r.question_id, r.role, r.content) for r in found.orderBy("question_id", "place").collect()] == [(1, "user", "what?"), (1, "assistant", "that"), (2, "user", "why?"), (2, "error", answer.NO_ANSWER), (3, "user", "who?"), (3, "error", answer.NO_ANSWER)]
    anchors = spark.createDataFrame([("m", 0, "d", 3, "other"), ("n", 0, "d", 3, "was seen here"), ("o", 0, "d", 4, "seen")], "node_id string, ord int, doc_id string, page int, snippet string")
    assert [tuple(r) for r in answer.cited(found, anchors).collect()] == [(1, 0, "n", True)]


def test_models_by_kind():
    calls = []

    def respond(prompt):
        calls.append(prompt)
        return '```json\n{"concepts": [{"label": "X"}], "edges": [], "answer": "y"}\n```'

    model = create_model("echo", {"echo": (lambda key: respond, True)}, key="k")
    assert model.preflight() is None and model.extract_concepts("t", "1-2", ["{text}"], [], "body")["concepts"] == [{"label": "X"}]
    assert "Known labels: {text}" in calls[0] and calls[0].endswith("body")
    assert model.propose_edges(["a"], "t") == [] and model.answer_question("q", "c")["answer"] == "y"
    for bad in (("echo", None), ("other", "k")):
        with pytest.raises(ValueError):
            create_model(bad[0], {"echo": (lambda key: respond, True)}, key=bad[1])
    with pytest.raises(ValueError):
        PromptModel(lambda p: "nothing").propose_merges(["a"], ["b"])
    assert filled("{a}{b}", a="{b}", b="1") == "{b}1"


def test_project_store_round_trip_and_defaults(spark, tmp_path):
    own = spark.createDataFrame([(1, "one", 2), (2, "two", 1)], "id long, name string, ord int")
    files = spark.createDataFrame([(1, "f", "n", "/p", 0), (1, "g", "m", "/q", 1)], "project_id long, file_id string, name string, path string, ord int")
    path = str(tmp_path / "store")
    projects.write_projects(own, files, path)
    got = {r.id: (r.name, [f.file_id for f in r.files], r.selected) for r in projects.read_projects(spark, path).collect()}
    assert got == {1: ("one", ["f", "g"], False), 2: ("two", [], True)}
    assert projects.read_projects(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("not json\n")
    assert projects.read_projects(spark, str(tmp_path / "bad")).count() == 0


def test_names_are_the_first_free(spark):
    rng = random.Random(3)
    names = [rng.choice(["A", "a ", "A (2)", "A (3)", "Á", "B", "", "  ", "A (2) (2)", "B (x)", None]) for _ in range(120)] + ["A", "A", "A (2)"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    fold = lambda s: s.lower().replace("á", "a")
    taken, want = set(), {}
    for k, n in enumerate(names):
        base = (n or "").strip()
        if not base:
            want[k] = "Untitled Project"
            continue
        i, candidate = 1, base
        while fold(candidate) in taken:
            i += 1
            candidate = f"{base} ({i})"
        taken.add(fold(candidate))
        want[k] = candidate
    assert {r.id: r.unique_name for r in lists.unique_names(df).collect()} == want


def test_deep_outlines(spark):
    tree = spark.createDataFrame([("d", k, k - 1 if k else None, 0, f"t{k}", k) for k in range(45)], "doc_id string, node int, parent int, sibling_ord int, title string, page int")
    assert [r.title for r in outline.flattened(tree).orderBy("ord").collect()] == [f"t{k}" for k in range(45)]


def test_long_chains_of_merges_and_circles(spark):
    chain = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(40)], "source string, target string")
    assert {r.target for r in merge.resolved_merges(chain).collect()} == {"n40"}
    with pytest.raises(ValueError):
        merge.resolved_merges(chain.union(spark.createDataFrame([("n40", "n00")], "source string, target string"))).collect()


def test_arrows_are_signs_of_formulas(spark):
    texts = ["→→→", "a → b → c ⇔ d", "one → two", "x = y + z", "±×÷√∏ plain words that go on"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.looks_like_equation(F.col("t")).alias("e"))
    assert {r.t: r.e for r in df.collect()} == dict(zip(texts, [True, True, False, False, False], strict=True))


def test_colours_go_round_over_the_whole_graph(spark):
    nodes = spark.createDataFrame([(f"n{k:02}", "entity" if k % 5 == 4 else "concept", (f"d{k % 3}", k)) for k in range(40)], "node_id string, level string, place struct<doc_id:string,ord:int>")
    holds = spark.createDataFrame([("n00", "n04", "e1"), ("n01", "n04", "e0"), ("n02", "n01", "e2")], "src string, tgt string, edge_id string")
    got = {r.node_id: r.color_index for r in extract.coloured(nodes, holds).collect()}
    order = sorted((f"d{k % 3}", k) for k in range(40) if k % 5 != 4)
    want = {f"n{k:02}": i % 12 for i, (_, k) in enumerate(order)}
    assert got == {f"n{k:02}": want.get(f"n{k:02}") for k in range(40)} | {"n04": want["n01"]}


def test_tables_go_to_the_folder_that_is_set(spark):
    assert shared_folder(spark) == shared_folder(spark)
