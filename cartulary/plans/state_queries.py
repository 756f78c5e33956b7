"""Queries over stores, lists and events, and the pipelines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cartulary.operators import layout, lists, merge, search
from cartulary.plans import pipelines
from cartulary.plans.fixtures import ANCHORS, DUCK_PAGES, Fixture, duck
from cartulary.plans.registry import query, with_tables
from cartulary.sources import graph_files
from cartulary.streaming import events as E

A = {"anchors": duck(ANCHORS)}


@query("SELECT url, payload FROM (SELECT url, md5(html) AS payload, CAST(page_id AS double) AS mtime, CASE WHEN page_id % 5 = 0 THEN NULL ELSE length(html) END AS size, CAST(page_id AS double) + page_id % 4 * 0.5 AS fm, length(html) + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS fs FROM pages) WHERE NOT coalesce(abs(mtime - fm) > 1.0, false) AND NOT coalesce(size <> fs, false)")
def stale_payload_filter(spark, sf_dir):
    pages = Fixture(spark, sf_dir).table("pages").withColumn("key", F.concat("page_id", F.lit("|"), "url"))
    size = F.length("html")
    stored = pages.select(F.col("key").alias("url"), F.col("page_id").cast("double").alias("mtime"), F.when(F.col("page_id") % 5 != 0, size).alias("size"), F.struct("url", F.md5("html").alias("hash")).alias("payload"))
    files = pages.select(F.col("key").alias("url"), (F.col("page_id").cast("double") + F.col("page_id") % 4 * 0.5).alias("file_mtime"), (size + F.when(F.col("page_id") % 7 == 0, 1).otherwise(0)).alias("file_size"))
    return graph_files.fresh_payloads(stored, files).select("payload.url", F.col("payload.hash").alias("payload"))


_FILES = "SELECT CASE WHEN page_id % 6 = 0 THEN concat('embeddings_', page_id, '.json') WHEN page_id % 6 = 1 THEN concat('note', page_id, '.txt') ELSE left({sha}, 32) || '.json' END AS file FROM {pages}"


@query(with_tables("SELECT file FROM files WHERE file LIKE '%.json' AND NOT file LIKE 'embeddings!_%' ESCAPE '!' AND NOT file LIKE 'etr!_audit!_%' ESCAPE '!' AND file NOT IN (SELECT left(sha256(url), 32) || '.json' FROM pages WHERE page_id % 3 = 0)", files=_FILES.format(sha="sha256(url)", pages="pages")))
def orphan_sweep(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    files = g.sql(_FILES.replace("{sha}", "sha2(url, 256)"))
    alive = graph_files.alive_urls(g.table("pages").filter("page_id % 3 = 0").select(F.col("url").alias("resolved"), F.lit(None).cast("string").alias("last_path")))
    return graph_files.orphans(files, alive)


@query("SELECT c.conv_id, c.turn, left(sha256(concat('m1:', c.text)), 32) AS key, r.response, r.response IS NOT NULL AS hit FROM conversations c LEFT JOIN (SELECT left(sha256(concat('m1:', text)), 32) AS key, max(concat('answer ', length(text))) AS response FROM conversations WHERE role = 'user' GROUP BY 1) r ON r.key = left(sha256(concat('m1:', c.text)), 32)")
def response_cache_lookup(spark, sf_dir):
    turns = Fixture(spark, sf_dir).table("conversations").withColumn("model", F.lit("m1")).withColumn("prompt", F.col("text"))
    cache = turns.filter("role = 'user'").groupBy(graph_files.cache_key(F.col("model"), F.col("prompt")).alias("key")).agg(F.max(F.concat(F.lit("answer "), F.length("text"))).alias("response"))
    return graph_files.cached_responses(turns, cache).select("conv_id", "turn", "key", "response", "hit")


_TERM = "CASE WHEN event_id % 3 = 0 THEN concat(' ', upper(event_type), ' ') WHEN event_id % 11 = 0 THEN ' ' ELSE concat(event_type, CAST(event_id % 14 AS string)) END"


@query(f"SELECT user_id, seq, term, CAST(row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS int) AS place FROM (SELECT user_id, max(event_id) AS seq, arg_max(trim({_TERM}), event_id) AS term FROM events WHERE trim({_TERM}) <> '' GROUP BY user_id, lower(trim({_TERM}))) QUALIFY place <= 10")
def search_history(spark, sf_dir):
    searches = Fixture(spark, sf_dir).table("events").select("user_id", F.col("event_id").alias("seq"), F.expr(_TERM).alias("term"))
    return lists.search_history(searches)


@query("SELECT user_id, max(event_id) AS seq, concat('file', json_extract_string(props, '$.k')) AS url, CAST(row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC) AS int) AS place FROM events GROUP BY user_id, url QUALIFY place <= 20")
def recent_files(spark, sf_dir):
    opened = Fixture(spark, sf_dir).table("events").select("user_id", F.col("event_id").alias("seq"), F.concat(F.lit("file"), F.get_json_object("props", "$.k")).alias("url"))
    return lists.recent_files(opened)


@query("SELECT user_id AS doc_id, CAST(event_id % 9 AS int) AS page FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def page_bookmarks(spark, sf_dir):
    return lists.toggled(Fixture(spark, sf_dir).table("events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 9).cast("int").alias("page")))


#: Names of projects as they are added: repeated, suffixed already, in other case, blank.
_NAMES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN '  ' WHEN c_custkey % 7 = 0 THEN concat('Project ', c_mktsegment, ' (', c_custkey % 4 + 2, ')') WHEN c_custkey % 11 = 0 THEN concat(' PROJECT ', c_mktsegment) ELSE concat('Project ', c_mktsegment) END AS name FROM {customer}"


@query(
    with_tables(
        """SELECT id, unique_name FROM step WHERE n > 0 UNION ALL SELECT id, 'Untitled Project' FROM clean WHERE name = ''""",
        clean=f"SELECT id, trim(name) AS name FROM ({duck(_NAMES)})",
        named="SELECT id, name, lower(name) AS fold, regexp_replace(lower(name), '( \\(\\d+\\))+$', '') AS family, row_number() OVER (PARTITION BY regexp_replace(lower(name), '( \\(\\d+\\))+$', '') ORDER BY id) AS n FROM clean WHERE name <> ''",
        step="""SELECT DISTINCT family, 0::BIGINT AS n, []::VARCHAR[] AS taken, NULL::BIGINT AS id, NULL::VARCHAR AS unique_name FROM named
  UNION ALL SELECT family, n, list_append(taken, lower(fresh)), id, fresh FROM (SELECT r.family, r.n, s.taken, r.id,
    CASE WHEN list_contains(s.taken, r.fold) THEN concat(r.name, ' (', list_filter(range(2, r.n + 3), lambda i: NOT list_contains(s.taken, concat(r.fold, ' (', i, ')')))[1], ')') ELSE r.name END AS fresh FROM step s JOIN named r ON r.family = s.family AND r.n = s.n + 1)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def unique_project_names(spark, sf_dir):
    return lists.unique_names(Fixture(spark, sf_dir).sql(_NAMES))


@query("SELECT p_brand AS project_id, concat('p', p_partkey) AS file_id, CAST(CASE WHEN spot IS NULL THEN o WHEN concat('p', p_partkey) = 'p7' THEN least(3, n - 1) WHEN o > spot AND o <= least(3, n - 1) THEN o - 1 WHEN o < spot AND o >= least(3, n - 1) THEN o + 1 ELSE o END AS int) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, concat('p', p_partkey)) - 1 AS o, count(*) OVER (PARTITION BY p_brand) AS n FROM part) LEFT JOIN (SELECT b, spot FROM (SELECT p_brand AS b, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, concat('p', p_partkey)) - 1 AS spot FROM part) WHERE k = 7) ON b = p_brand")
def manual_reorder(spark, sf_dir):
    files = Fixture(spark, sf_dir).table("part").select(F.col("p_brand").alias("project_id"), F.concat(F.lit("p"), "p_partkey").alias("file_id"), F.col("p_size").alias("ord"))
    return lists.reordered(files, "project_id", "file_id", "p7", 3)


@query("SELECT user_id, fires_at, payload, n AS events FROM (SELECT user_id, max(ts) + INTERVAL 30 MINUTE AS fires_at, arg_max(event_id, ts) AS payload, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s)")
def debounce_events(spark, sf_dir):
    return E.debounced(Fixture(spark, sf_dir).table("events"), "user_id", "ts", "event_id", "30 minutes")


@query("SELECT user_id AS key, arg_max(event_type, (ts, event_type)) AS state FROM events GROUP BY user_id")
def document_states(spark, sf_dir):
    return E.last_states(Fixture(spark, sf_dir).table("events"), "user_id", "ts", "event_type").withColumnRenamed("user_id", "key")


@query(
    with_tables(
        """SELECT doc_id, visit_id, page, active FROM (SELECT *, lag(active) OVER (PARTITION BY doc_id ORDER BY visit_id) AS before FROM (
  SELECT v.doc_id, v.visit_id, v.page, arg_min(a.node_id, (abs(a.page - v.page), a.node_id)) AS active FROM visits v LEFT JOIN anchors a ON a.doc_id = v.doc_id AND abs(a.page - v.page) <= 1 GROUP BY ALL)) WHERE active IS DISTINCT FROM before""",
        **A,
        visits="SELECT concat('d', user_id % 5) AS doc_id, event_id AS visit_id, CAST(json_extract_string(props, '$.k') AS int) AS page FROM events",
    )
)
def active_node_changes(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    visits = g.table("events").select(F.concat(F.lit("d"), F.col("user_id") % 5).alias("doc_id"), F.col("event_id").alias("visit_id"), F.get_json_object("props", "$.k").cast("int").alias("page"))
    return search.active_changes(search.active_nodes(visits, g.anchors))


@query(
    "SELECT key, CAST(coalesce(max(n % 3) FILTER (seq = last), 0) AS BIGINT) AS misses, CAST(coalesce(sum(n // 3), 0) AS BIGINT) AS removed FROM (SELECT user_id AS key, max(event_id) AS last FROM events GROUP BY user_id) LEFT JOIN (SELECT user_id AS key, run, count(*) AS n, max(event_id) AS seq FROM (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events) WHERE event_type <> 'purchase' GROUP BY user_id, run) USING (key) GROUP BY key"
)
def stale_file_counts(spark, sf_dir):
    checks = Fixture(spark, sf_dir).table("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("accessible"))
    return E.stale_counts(checks)


@query("SELECT (SELECT count(*) FROM labels WHERE quality = 1 AND toxic = 1) / (SELECT count(*) FROM labels WHERE quality = 1)::DOUBLE AS precision, (SELECT count(*) FROM labels WHERE quality = 1 AND toxic = 1) / (SELECT count(*) FROM labels WHERE toxic = 1)::DOUBLE AS recall")
def merge_agreement(spark, sf_dir):
    labels = Fixture(spark, sf_dir).table("labels")
    return merge.agreement(labels.filter("quality = 1"), labels.filter("toxic = 1"), "doc_id")


#: Events of each user, accepted when the last accepted one is an hour or more before.
@query(
    with_tables(
        "SELECT key, t AS \"at\", turn = 1 AND EXISTS (SELECT 1 FROM taken x WHERE x.key = timed.key AND x.t = timed.t) AS accepted FROM timed",
        timed="SELECT CAST(user_id AS string) AS key, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS turn FROM events",
        taken="SELECT key, min(t) AS t FROM timed GROUP BY key UNION ALL SELECT x.key, min(e.t) FROM taken x JOIN timed e ON e.key = x.key AND e.t >= x.t + 3600 GROUP BY x.key, x.t",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def throttle_state(spark, sf_dir):
    rows = Fixture(spark, sf_dir).table("events").select(F.col("user_id").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return E.throttled(rows.select("key", (F.col("us") / 1e6).alias("at")), 3600.0)


#: Each user's events as operations: some undo, some redo.
@query(
    with_tables(
        "SELECT key, array_to_string(arg_max(undo, n), ',') AS undo, array_to_string(arg_max(redo, n), ',') AS redo FROM step GROUP BY key",
        log="SELECT CAST(user_id AS string) AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_id % 5 = 0 THEN 'undo' WHEN event_id % 7 = 0 THEN 'redo' ELSE 'do' END AS action, event_type AS op FROM events",
        step="""SELECT DISTINCT key, 0::BIGINT AS n, []::VARCHAR[] AS undo, []::VARCHAR[] AS redo FROM log
  UNION ALL SELECT s.key, l.n, CASE WHEN action = 'do' THEN list_append(undo, op)[-50:] WHEN action = 'undo' THEN undo[:-2] WHEN len(redo) > 0 THEN list_append(undo, redo[-1])[-50:] ELSE undo END,
    CASE WHEN action = 'do' THEN [] WHEN action = 'undo' AND len(undo) > 0 THEN list_append(redo, undo[-1]) WHEN action = 'redo' THEN redo[:-2] ELSE redo END FROM step s JOIN log l ON l.key = s.key AND l.n = s.n + 1""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def undo_log(spark, sf_dir):
    action = F.when(F.col("event_id") % 5 == 0, "undo").when(F.col("event_id") % 7 == 0, "redo").otherwise("do")
    log = Fixture(spark, sf_dir).table("events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), action.alias("action"), F.col("event_type").alias("op"))
    return E.undo_stacks(log).select("key", F.array_join("undo", ",").alias("undo"), F.array_join("redo", ",").alias("redo"))


@query()
def extract_fast_pipeline(spark, sf_dir):
    """Nodes that the fast pipeline makes of the paged texts with the rule-based model."""
    return pipelines.fast(Fixture(spark, sf_dir).pages, pipelines.rule_based)["nodes"].select("node_id", "label", "type", "level", "confidence", "summary")


@query()
def extract_fast_edges(spark, sf_dir):
    """Edges of the same graph."""
    return pipelines.fast(Fixture(spark, sf_dir).pages, pipelines.rule_based)["edges"].select("edge_id", "src", "tgt", "type", "confidence", "label")


@query(with_tables("SELECT DISTINCT doc_id, 'complete' AS state FROM pg WHERE regexp_matches(text, '\\S')", pg=DUCK_PAGES))
def extract_fast_states(spark, sf_dir):
    return pipelines.fast(Fixture(spark, sf_dir).pages, pipelines.rule_based)["states"]


@query()
def extract_deep_anchors(spark, sf_dir):
    """Anchors that the deep pipeline makes with the rule-based model."""
    return pipelines.deep(Fixture(spark, sf_dir).pages, pipelines.rule_based)["anchors"].select("node_id", "ord", "doc_id", "page", "snippet")


@query()
def extract_deep_pipeline(spark, sf_dir):
    """Nodes that the deep pipeline makes of the paged texts with the rule-based model."""
    return pipelines.deep(Fixture(spark, sf_dir).pages, pipelines.rule_based)["nodes"].select("node_id", "label", "type", "level", "confidence", "summary")


@query()
def force_layout(spark, sf_dir):
    """Customers of each nation laid out by their relations."""
    g = Fixture(spark, sf_dir)
    at = g.sql("SELECT concat('n', c_nationkey) AS grp, concat('c', c_custkey) AS node_id, CAST(NULL AS double) AS x, CAST(NULL AS double) AS y, false AS is_fixed, CAST(NULL AS string) AS parent FROM {customer}")
    links = g.edges.filter("type not like 'contains%'").join(at.select("grp", F.col("node_id").alias("src")), "src").select("grp", "src", "tgt")
    return layout.force_layout(at, links, 1200, 800)


@query()
def resolve_overlaps(spark, sf_dir):
    """Customers of each nation, on a grid of their keys, pushed apart."""
    at = Fixture(spark, sf_dir).sql("SELECT concat('n', c_nationkey) AS grp, concat('c', c_custkey) AS node_id, CAST(c_custkey % 97 * 13 AS double) AS x, CAST(c_custkey % 89 * 11 AS double) AS y FROM {customer}")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node_id", ignore_index=True)
        xy = layout.separated(frame[["x", "y"]].to_numpy(float), np.zeros(len(frame), bool))
        return frame.assign(x=xy[:, 0], y=xy[:, 1])

    return layout.by_graph(at).groupBy("grp").applyInPandas(run, at.schema)
