"""Layout invariants, lists and event operators."""

import inspect

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cartulary.functions import geometry as G
from cartulary.operators import layout, lists
from cartulary.plans import state_queries
from cartulary.streaming import events as E
from tests.conftest import rows


def test_two_bodies_push_alike():
    f = layout.exact_forces(np.array([[0.0, 0.0], [100.0, 0.0]]))
    assert np.allclose(f, [[-2.5, 0], [2.5, 0]]) and np.allclose(f.sum(0), 0, atol=1e-6)


def test_tree_forces_are_near_the_exact_ones():
    rng = np.random.default_rng(1)
    a = np.linspace(0, 2 * np.pi, 50, endpoint=False)
    far = np.stack([1000 + 5 * np.cos(a), 1000 + 5 * np.sin(a)], 1)
    probe = np.zeros((1, 2))
    exact = layout.exact_forces(np.concatenate([probe, far]))[0]
    assert np.linalg.norm(layout.tree_forces(far, 0.5, probe)[0] - exact) < 0.01 * np.linalg.norm(exact)
    assert np.isfinite(layout.tree_forces(np.zeros((10, 2)))).all()
    many = layout.tree_forces(rng.uniform(0, 1000, (1000, 2)))
    assert np.isfinite(many).all()


def test_clusters_are_moved_whole():
    xy = np.array([[100.0, 100], [110, 120], [90, 120], [140, 110], [150, 130]])
    c = np.array([0, 0, 0, 1, 1])
    out = layout.separated_clusters(xy, c)
    assert np.allclose(out[1] - out[0], xy[1] - xy[0]) and np.allclose(out[4] - out[3], xy[4] - xy[3])
    boxes = [(out[c == k].min(0) - (40, 30), out[c == k].max(0) + (40, 50)) for k in (0, 1)]
    assert (np.minimum(boxes[0][1], boxes[1][1]) - np.maximum(boxes[0][0], boxes[1][0]) <= 1e-6).any()
    apart = np.array([[100.0, 100], [500, 500]])
    assert np.allclose(layout.separated_clusters(apart, np.array([0, 1])), apart)


def test_fit(spark):
    at = spark.createDataFrame([("g", 0.0, 0.0), ("g", 1000.0, 800.0)], "grp string, x double, y double")
    r = layout.fit(at, 800, 600).first()
    s = min(800 / 1200, 600 / 1000)
    assert np.allclose([r.scale, r.dx, r.dy], [s, 400 - 500 * s, 300 - 400 * s])


def test_bands_and_known_places(spark):
    n = spark.createDataFrame([("d", "document", None), ("c", "chapter", "d"), ("k", "concept", "c"), ("e", "entity", "k")], "node_id string, level string, parent string")
    got = {r.node_id: r.y for r in layout.band_seeds(n, 1000, 1000).collect()}
    assert {k: round(v) for k, v in got.items()} == {"d": 150, "c": 400, "k": 650, "e": 850}
    known = spark.createDataFrame([("k", 1.0, 2.0), ("gone", 0.0, 0.0)], "node_id string, x double, y double")
    placed = {r.node_id: (r.x, r.y) for r in layout.seeded(n, known, 1000, 1000).collect()}
    assert placed["k"] == (1.0, 2.0) and "gone" not in placed


def test_force_layout_is_the_same_each_time(spark):
    at = spark.createDataFrame([("g", f"n{k}", None, None, k == 0, None) for k in range(12)] + [("h", "m", 1.0, 1.0, True, None)], "grp string, node_id string, x double, y double, is_fixed boolean, parent string")
    links = spark.createDataFrame([("g", "n1", "n2"), ("g", "n2", "n9")], "grp string, src string, tgt string")
    one, two = (rows(layout.force_layout(at, links, 800, 600, iterations=30)) for _ in range(2))
    assert one == two and len(one) == 13 and all(np.isfinite(r[2]) for r in one)


def test_geometry(spark):
    one = spark.sql("select struct(0D as x, 0D as y, 10D as w, 10D as h) a, struct(10D as x, 0D as y, 5D as w, 5D as h) b, struct(5D as x, 5D as y, 20D as w, 20D as h) c, struct(0D as x, 0D as y, 100D as w, 100D as h) page")
    a, b, c, page = (F.col(x) for x in ("a", "b", "c", "page"))
    r = one.select(G.overlaps(a, b).alias("touch"), G.meets(a, b).alias("meet"), G.overlaps(a, c).alias("over"), G.translated(a, F.lit(-5.0), F.lit(95.0), page).alias("moved"), G.handle_at(a, F.lit(10.0), F.lit(10.0), 4).alias("handle"), G.resized(a, F.lit("ne"), F.lit(-50.0), F.lit(5.0), page, 4).alias("sized"), G.zoomed(F.lit(4.5), F.lit(1.2)).alias("zoom"), G.dragged(F.lit(1.0), F.lit(1.0), F.lit(3.0), F.lit(30.0)).alias("small")).first()
    assert (r.touch, r.meet, r.over, r.handle, r.zoom, r.small) == (False, True, True, "ne", 5.0, None)
    assert tuple(r.moved) == (0.0, 90.0, 10.0, 10.0) and tuple(r.sized) == (0.0, 0.0, 4.0, 15.0)


def test_history_and_recent_files(spark):
    h = spark.createDataFrame([(1, 1, "  hello "), (1, 2, "HELLO"), (1, 3, " ")], "user_id int, seq int, term string")
    assert [(r.term, r.place) for r in lists.search_history(h).collect()] == [("HELLO", 1)]
    f = spark.createDataFrame([(1, k, f"f{k % 30}") for k in range(60)], "user_id int, seq int, url string")
    got = lists.recent_files(f).orderBy("place").collect()
    assert len(got) == 20 and got[0].url == "f29"


def test_names_and_cursor(spark):
    n = spark.createDataFrame([(1, "Book"), (2, "book"), (3, "Bóok"), (4, "Other")], "id int, name string")
    assert [r.unique_name for r in lists.unique_names(n).orderBy("id").collect()] == ["Book", "book (2)", "Bóok (3)", "Other"]
    c = spark.createDataFrame([(10,), (20,), (30,)], "ord int")
    assert [lists.cursor(c, 2, 1).first().ord, lists.cursor(c, 0, -1).first().ord] == [10, 30]


def test_stale_counts_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    checks = [(f"k{k}", s, bool(rng.random() < 0.4)) for k in range(20) for s in range(rng.integers(1, 25))]
    want = {}
    for key, _, ok in checks:
        misses, removed = want.get(key, (0, 0))
        misses = 0 if ok else misses + 1
        want[key] = (0, removed + 1) if misses == 3 else (misses, removed)
    got = {r.key: (r.misses, r.removed) for r in E.stale_counts(spark.createDataFrame(checks, "key string, seq int, accessible boolean")).collect()}
    assert got == want


def test_throttle_and_undo_in_batch_and_stream(spark, tmp_path):
    ev = pd.DataFrame({"key": ["a"] * 5 + ["b"], "at": [0.0, 4.0, 5.0, 9.0, 10.0, 1.0]})
    batch = rows(E.throttled(spark.createDataFrame(ev), 5.0))
    assert [r[2] for r in batch] == [True, False, True, False, True, True]
    spark.createDataFrame(ev).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at double").parquet(str(tmp_path / "in"))
    q = E.throttled_stream(stream, 5.0).writeStream.format("memory").queryName("throttled").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("throttled")) == batch
    log = spark.createDataFrame([("a", 0, "do", "x"), ("a", 1, "do", "y"), ("a", 2, "undo", None), ("a", 3, "redo", None), ("a", 4, "undo", None), ("a", 5, "do", "z"), ("b", 0, "undo", None)], "key string, seq int, action string, op string")
    assert {r.key: (r.undo, r.redo) for r in E.undo_stacks(log).collect()} == {"a": (["x", "z"], []), "b": ([], [])}
    capped = spark.createDataFrame([("a", k, "do", str(k)) for k in range(60)], "key string, seq int, action string, op string")
    assert E.undo_stacks(capped).first().undo[0] == "10"


def test_debounce_in_batch_and_stream(spark, tmp_path):
    ev = spark.sql("select * from values ('d', timestamp'2024-01-01 00:00:00', 'p1'), ('d', timestamp'2024-01-01 00:00:00.5', 'p2'), ('d', timestamp'2024-01-01 00:00:09', 'p3'), ('e', timestamp'2024-01-01 00:00:00.6', 'q') as t(doc_id, ts, payload)")
    batch = [(r.doc_id, r.payload, r.events) for r in E.saves(ev).orderBy("doc_id", "fires_at").collect()]
    assert batch == [("d", "p2", 2), ("d", "p3", 1), ("e", "q", 1)]
    ev.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = E.saves(stream, "1 second").writeStream.format("memory").outputMode("append").queryName("saved").trigger(availableNow=True).start()
    q.awaitTermination(120)
    fired = {(r.doc_id, r.payload, r.events) for r in spark.table("saved").collect()}
    assert fired == {("d", "p2", 2), ("e", "q", 1)}  # the last has not been silent long enough yet


def test_layout_queries_run_as_far_as_the_operators(spark, monkeypatch):
    given, run = [], layout.force_layout
    monkeypatch.setattr(layout, "force_layout", lambda *a, **b: given.append(inspect.signature(run).bind(*a, **b)) or run(*a, **b))
    assert state_queries.force_layout(spark, "/root/testdata/sf0.001").count() > 0
    given[0].apply_defaults()
    assert given[0].arguments["iterations"] == layout.ITERATIONS == 500
    at = state_queries.resolve_overlaps(spark, "/root/testdata/sf0.001").toPandas()
    for _, g in at.groupby("grp"):
        xy = g[["x", "y"]].to_numpy()
        d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)) + np.eye(len(xy)) * 1e9
        assert d.min() > layout.APART - 1
