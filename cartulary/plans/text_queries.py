"""Queries over the paged texts, outlines and a model's answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartulary.functions import text as T
from cartulary.functions.json_repair import repair
from cartulary.operators import extract
from cartulary.plans.fixtures import DUCK_BLOCKS, DUCK_LINES, DUCK_PAGES, Fixture, duck
from cartulary.plans.registry import query, with_tables
from cartulary.schema import CONCEPT_TYPES, EDGE_TYPES, default_level, lenient
from cartulary.sources import outline, text
from cartulary.sources.graph_files import file_of

L, P, B = {"lines": DUCK_LINES}, {"pg": DUCK_PAGES}, {"blocks": DUCK_BLOCKS}


@query(with_tables("SELECT doc_id, page, line_no, text, CAST(NULL AS string) AS block_type FROM blocks UNION ALL SELECT doc_id, page, -1, text, 'body' FROM pg WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = pg.doc_id AND b.page = pg.page)", **B, **P))
def text_blocks(spark, sf_dir):
    return text.text_blocks(Fixture(spark, sf_dir).pages).select("doc_id", "page", "line_no", "text", "block_type")


@query(with_tables("SELECT c.doc_id, c.page AS center, md5(string_agg(concat('--- Page ', p.page + 1, ' ---', chr(10), p.text), chr(10) || chr(10) ORDER BY p.page)) AS digest FROM (SELECT doc_id, CAST((page // 5 * 5 + least(page // 5 * 5 + 5, any_value(n))) // 2 AS int) AS page FROM pg JOIN (SELECT doc_id, max(page) + 1 AS n FROM pg GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, page // 5) c JOIN pg p ON p.doc_id = c.doc_id AND abs(p.page - c.page) <= 2 GROUP BY c.doc_id, c.page", **P))
def context_windows(spark, sf_dir):
    pages = Fixture(spark, sf_dir).pages
    centers = text.batches(pages).select("doc_id", "center")
    return text.context_windows(pages, centers).select("doc_id", "center", F.md5("context").alias("digest"))


@query(
    with_tables(
        """SELECT doc_id, batch, lo AS page_lo, hi AS page_hi, CAST((lo + hi) // 2 AS int) AS center, chars, chars // greatest(1, hi - lo) AS avg_chars, chars // greatest(1, hi - lo) < 10 AS scanned, chars = 0 AS needs_ocr FROM (
  SELECT doc_id, CAST(page // 5 AS int) AS batch, CAST(page // 5 * 5 AS int) AS lo, CAST(least(page // 5 * 5 + 5, any_value(n)) AS int) AS hi, CAST(sum(length(text)) AS BIGINT) AS chars FROM pg JOIN (SELECT doc_id, max(page) + 1 AS n FROM pg GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, page // 5)""",
        **P,
    )
)
def batch_char_stats(spark, sf_dir):
    return text.batches(Fixture(spark, sf_dir).pages)


@query(with_tables("SELECT doc_id, page // 5 * 5 AS page_lo, max(page) + 1 AS page_hi, md5(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS digest FROM pg GROUP BY doc_id, page // 5 HAVING string_agg(text, '') ~ '(?s).*\\S.*'", **P))
def text_chunks(spark, sf_dir):
    return text.text_chunks(Fixture(spark, sf_dir).pages).select("doc_id", "page_lo", "page_hi", F.md5("text").alias("digest"))


#: A line's height and place, made of its length and number alike in both engines.
_HEIGHT, _Y = "CAST(8 + length(text) % 11 AS double)", "CAST(800 - 20 * line_no AS double)"


@query(with_tables(f"SELECT doc_id, page, list_sort(list({_HEIGHT}))[count(*) // 2 + 1] AS median_h FROM blocks GROUP BY doc_id, page", **B))
def median_line_height(spark, sf_dir):
    return text.median_heights(_measured(spark, sf_dir))


def _measured(spark, sf_dir):
    return text.lines(Fixture(spark, sf_dir).pages).withColumn("h", F.expr(_HEIGHT)).withColumn("y", F.expr(_Y))


_SIGNS = "length(text) - length(translate(text, '{}', ''))"
#: The lines to classify: some of them end in arrows.
_SIGNED = "CASE WHEN length(text) % 40 = 0 THEN concat(text, ' →⇒⇔') ELSE text END"


@query(
    with_tables(
        f"""SELECT doc_id, page, line_no, CASE WHEN {_SIGNS.format('∑∫∂∇≈≠≤≥∈∉⊂⊃∪∩→←⇒⇔∀∃∞αβγδεθλμπσφω')} > 2 OR (length(text) > 5 AND ({_SIGNS.format('=+-*/^_{}()[]')})::DOUBLE / length(text) > 0.3) THEN 'equation'
  WHEN h > median_h * 1.4 AND length(text) < 120 THEN 'heading' WHEN length(text) > 3 AND length(text) < 80 AND text = upper(text) AND NOT regexp_matches(text, '[a-z]') THEN 'heading'
  WHEN y < 842 * 0.15 AND length(text) < 200 THEN 'footnote' WHEN h < median_h * 0.7 AND length(text) < 150 THEN 'caption' WHEN lower(text) LIKE 'figure %' OR lower(text) LIKE 'fig. %' THEN 'caption' ELSE 'body' END AS block_type
FROM (SELECT doc_id, page, line_no, {_SIGNED} AS text, {_HEIGHT} AS h, {_Y} AS y FROM blocks) JOIN (SELECT doc_id, page, list_sort(list({_HEIGHT}))[count(*) // 2 + 1] AS median_h FROM blocks GROUP BY doc_id, page) USING (doc_id, page)""",
        **B,
    )
)
def classify_blocks(spark, sf_dir):
    measured = _measured(spark, sf_dir)
    met = measured.join(text.median_heights(measured), ["doc_id", "page"])
    return met.select("doc_id", "page", "line_no", T.block_class(F.expr(_SIGNED), F.col("h"), F.col("median_h"), F.col("y"), F.lit(842)).alias("block_type"))


@query(with_tables(f"SELECT doc_id, page, line_no, {_Y} AS y FROM (SELECT * FROM blocks WHERE contains(lower(text), 'hea') ORDER BY doc_id, page, line_no LIMIT 200)", **B))
def pdf_search_topk(spark, sf_dir):
    return text.search_hits(_measured(spark, sf_dir), "hea").select("doc_id", "page", "line_no", "y")


#: An outline of each document: its short lines, on the page they stand on, an entry in five without title.
_ENTRIES = "SELECT doc_id, n AS ord, CASE WHEN n % 5 = 4 THEN NULL ELSE text END AS title, page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) - 1 AS n FROM blocks WHERE length(text) < 60)"
_PAGE_COUNT = "SELECT doc_id, CAST(max(page) + 1 AS int) AS n FROM pg GROUP BY doc_id"


@query(with_tables("SELECT doc_id, title, page AS page_start, greatest(page, lead(page, 1, n) OVER (PARTITION BY doc_id ORDER BY page, ord) - 1) AS page_end FROM entries JOIN counts USING (doc_id) WHERE title IS NOT NULL", **B, **P, entries=_ENTRIES, counts=_PAGE_COUNT))
def chapters_from_outline(spark, sf_dir):
    entries, counts = _outline(spark, sf_dir)
    return outline.chapters_from_outline(outline.flattened(entries), counts)


def _outline(spark, sf_dir):
    """The outline as a tree of two levels whose pre-order is the order of the lines."""
    pages = Fixture(spark, sf_dir).pages
    blocks = text.lines(pages)
    entries = spark.sql(_ENTRIES.replace("FROM blocks", "FROM {blocks}"), blocks=blocks)
    tree = entries.select("doc_id", F.col("ord").cast("int").alias("node"), F.when(F.col("ord") % 3 != 0, F.col("ord") - F.col("ord") % 3).cast("int").alias("parent"), F.col("ord").cast("int").alias("sibling_ord"), "title", "page")
    return tree, pages.groupBy("doc_id").agg((F.max("page") + 1).alias("n"))


#: Chapters as a model may propose them: overlapping, beyond the end, untitled.
_PROPOSED = "SELECT concat('doc', {x}) AS doc_id, k AS ord, CASE WHEN ({x} + k) % 7 = 0 THEN ' ' ELSE concat('Part ', k) END AS title, CAST(({x} * 31 + k * 17) % 23 - 2 AS int) AS page_start, CAST(({x} * 31 + k * 17) % 23 - 2 + ({x} + k) % 6 AS int) AS page_end"


@query(
    with_tables(
        """SELECT doc_id, title, start AS page_start, e AS page_end FROM (
  SELECT *, greatest(s, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0)) AS start FROM (
    SELECT doc_id, ord, title, greatest(0, least(page_start, 19)) AS s, greatest(greatest(0, least(page_start, 19)), greatest(0, least(page_end, 19))) AS e FROM proposed WHERE trim(title) <> '')) WHERE start <= e""",
        proposed=_PROPOSED.format(x="doc_id") + " FROM documents, generate_series(0, 5) AS g(k)",
    )
)
def sanitize_chapters(spark, sf_dir):
    docs = Fixture(spark, sf_dir).table("documents").select("doc_id", F.explode(F.expr("sequence(0, 5)")).alias("k"))
    proposed = spark.sql(_PROPOSED.format(x="doc_id") + " FROM {docs}", docs=docs)
    return outline.sanitized(proposed, proposed.select("doc_id").distinct().withColumn("n", F.lit(20)))


@query(
    """SELECT doc_id, concat('Section ', k // per + 1) AS title, CAST(k AS int) AS page_start, CAST(least(k + per - 1, n - 1) AS int) AS page_end FROM (
  SELECT doc_id, n, per, unnest(range(0, n, per)) AS k FROM (SELECT concat('doc', doc_id) AS doc_id, n, greatest(1, n // least(10, greatest(3, n // 10))) AS per FROM (SELECT doc_id, 1 + doc_id % 130 AS n FROM documents)))"""
)
def fallback_chapters(spark, sf_dir):
    docs = Fixture(spark, sf_dir).table("documents").select(F.concat(F.lit("doc"), "doc_id").alias("doc_id"), (1 + F.col("doc_id") % 130).alias("n"))
    return outline.fallback_chapters(docs)


#: Spans: 50 code points of each page's first line, sought in the first batch of pages.
_SPANS = "SELECT concat(doc_id, '-', page) AS span_id, doc_id, 0 AS page_lo, 5 AS page_hi, substr(text, 3, 50) AS span FROM blocks WHERE line_no = 0 AND length(text) > 3"


@query(
    with_tables(
        """SELECT span_id, min(tier) AS tier, arg_min(page, (tier, page, line_no)) AS page, arg_min(line_no, (tier, page, line_no)) AS line_no, arg_min(left(span, 200), (tier, page, line_no)) AS snippet FROM (
  SELECT w.span_id, CASE WHEN contains(lower(b.text), w.whole) THEN 1 ELSE 2 END AS tier, b.page, b.line_no, w.span FROM wanted w JOIN blocks b ON b.doc_id = w.doc_id AND b.page BETWEEN w.page_lo AND w.page_hi - 1 AND contains(lower(b.text), left(w.whole, 30))
  UNION ALL SELECT w.span_id, 3, p.page, -1, w.span FROM wanted w JOIN pg p ON p.doc_id = w.doc_id AND contains(lower(p.text), left(w.whole, 30))) GROUP BY span_id""",
        **B, **P, spans=_SPANS,
        wanted="SELECT *, lower(regexp_replace(span, '^\\s+|\\s+$', '', 'g')) AS whole FROM spans WHERE regexp_replace(span, '^\\s+|\\s+$', '', 'g') <> ''",
    )
)
def resolve_anchors(spark, sf_dir):
    pages = Fixture(spark, sf_dir).pages
    blocks = text.lines(pages)
    spans = spark.sql(_SPANS.replace("FROM blocks", "FROM {blocks}"), blocks=blocks)
    return extract.resolve_anchors(spans, blocks, pages)


_LABELLED = "SELECT p_name AS label, CASE p_size % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'theorem' ELSE 'method' END AS type, CASE WHEN p_size > 25 THEN p_type ELSE NULL END AS summary, CASE WHEN p_size % 2 = 0 THEN 'concept' ELSE 'entity' END AS level, p_size / 50.0::DOUBLE AS confidence, p_brand AS doc_id, p_partkey AS ord FROM part"


@query(
    with_tables(
        """SELECT left(sha256(concat('node||', lower(label))), 32) AS node_id, arg_min(label, ord) AS label, arg_min(type, ord) AS type, arg_min(level, ord) AS level, arg_min(confidence, ord) AS confidence, arg_min(summary, ord) FILTER (summary IS NOT NULL) AS summary, count(*) AS anchors FROM labelled GROUP BY lower(label)""",
        labelled=_LABELLED,
    )
)
def label_upsert(spark, sf_dir):
    nodes, anchors = extract.upsert_labels(_labelled(spark, sf_dir), ["ord"])
    return nodes.drop("place").join(anchors.groupBy("node_id").agg(F.count("*").alias("anchors")), "node_id")


def _labelled(spark, sf_dir):
    part = Fixture(spark, sf_dir).table("part")
    kind = F.when(F.col("p_size") % 3 == 0, "concept").when(F.col("p_size") % 3 == 1, "theorem").otherwise("method")
    return part.select(F.col("p_name").alias("label"), kind.alias("type"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("summary"), F.when(F.col("p_size") % 2 == 0, "concept").otherwise("entity").alias("level"), (F.col("p_size") / 50.0).alias("confidence"), F.col("p_brand").alias("doc_id"), F.lit(0).alias("page"), F.col("p_name").alias("snippet"), F.col("p_partkey").alias("ord"))


_CHAINED = "SELECT l_orderkey, l_linenumber, a.p_name AS source, CASE WHEN x.l_returnflag = 'R' THEN 'nowhere' ELSE b.p_name END AS target FROM {lineitem} x JOIN {part} a ON a.p_partkey = x.l_partkey JOIN {part} b ON b.p_partkey = x.l_suppkey"


@query(with_tables("SELECT l_orderkey, l_linenumber, s.id AS src, t.id AS tgt FROM chained JOIN known s ON s.k = lower(source) JOIN known t ON t.k = lower(target)", chained=duck(_CHAINED), known="SELECT lower(p_name) AS k, max(concat('p', p_partkey)) AS id FROM part GROUP BY 1"))
def endpoint_lookup(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    nodes = g.table("part").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"), F.col("p_name").alias("label"))
    return extract.end_points(g.sql(_CHAINED), nodes).select("l_orderkey", "l_linenumber", "src", "tgt")


@query(
    """SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY pos) - 1 AS int) AS ord, page, snippet FROM (SELECT cluster_id, page, min(pos) AS pos, arg_min(snippet, pos) AS snippet FROM (
  SELECT l_orderkey AS cluster_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos, p_size AS page, p_name AS snippet FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY cluster_id, page)"""
)
def fact_anchors(spark, sf_dir):
    g = Fixture(spark, sf_dir)
    clusters = g.table("lineitem").groupBy(F.col("l_orderkey").alias("cluster_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("fact_indices"))
    facts = g.table("part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("doc_id"), F.col("p_size").alias("page_lo"), F.col("p_name").alias("span"))
    return extract.fact_anchors(clusters, facts).select("cluster_id", "ord", "page", "snippet")


def _within(column: str, domain: tuple[str, ...], default: str) -> str:
    return f"CASE WHEN {column} IN (" + ", ".join(f"'{d}'" for d in domain) + f") THEN {column} ELSE '{default}' END"


_WORD = "substr('concept   theorem   Claim     entity    cites     uses      USES      nothing   ', 1 + 10 * CAST(event_id % 8 AS int), 10)"


@query(f"SELECT event_id, {_within('w', CONCEPT_TYPES, 'concept')} AS concept, {_within('w', CONCEPT_TYPES, 'definition')} AS entity, {_within('w', EDGE_TYPES, 'sameTopic')} AS edge, CASE WHEN w IN ('concept', 'theorem', 'method', 'claim') THEN 'concept' ELSE 'entity' END AS level FROM (SELECT event_id, trim({_WORD}) AS w FROM events)")
def lenient_enum_decode(spark, sf_dir):
    rows = Fixture(spark, sf_dir).table("events").select("event_id", F.expr(f"trim({_WORD})").alias("w"))
    w = F.col("w")
    return rows.select("event_id", lenient(w, CONCEPT_TYPES, "concept").alias("concept"), lenient(w, CONCEPT_TYPES, "definition").alias("entity"), lenient(w, EDGE_TYPES, "sameTopic").alias("edge"), default_level(w).alias("level"))


@query("SELECT page_id, left(sha256(url), 32) || '.json' AS file, string_split(url, '/')[-1] AS name, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS title FROM pages")
def sha_prefix(spark, sf_dir):
    url = F.col("url")
    return Fixture(spark, sf_dir).table("pages").select("page_id", file_of(url).alias("file"), T.file_name(url).alias("name"), T.without_extension(T.file_name(url)).alias("title"))


@query("SELECT conv_id, turn, replace(text, '\"', '\\\"') AS quoted, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS bare, lower(left(text, 30)) AS prefix FROM conversations")
def string_functions(spark, sf_dir):
    c = Fixture(spark, sf_dir).table("conversations")
    return c.select("conv_id", "turn", T.quoted_json(F.col("text")).alias("quoted"), T.trimmed(F.col("text")).alias("bare"), F.lower(F.left("text", F.lit(30))).alias("prefix"))


#: Each document's first 40 code points, white space flattened, sought on all its pages.
@query(with_tables("SELECT p.doc_id, p.page, trim(s.snippet) <> '' AND (contains(strip_accents(lower(p.text)), strip_accents(lower(s.snippet))) OR contains(lower(regexp_replace(p.text, '\\s+', ' ', 'g')), lower(trim(s.snippet)))) AS found FROM pg p JOIN (SELECT doc_id, left(regexp_replace(text, '\\s+', ' ', 'g'), 40) AS snippet FROM pg WHERE page = 0) s USING (doc_id)", **P))
def passage_match(spark, sf_dir):
    pages = Fixture(spark, sf_dir).pages
    sought = pages.filter("page = 0").select("doc_id", F.left(F.regexp_replace("text", r"\s+", " "), F.lit(40)).alias("snippet"))
    return pages.join(sought, "doc_id").select("doc_id", "page", T.passage_found(F.col("text"), F.col("snippet")).alias("found"))


@query()
def json_repair(spark, sf_dir):
    """Events' JSON, cut by a fifth of its length, repaired."""
    events = Fixture(spark, sf_dir).table("events").select("event_id", "props", F.expr("left(props, int(length(props) * 4 div 5))").alias("cut"))
    return events.select("event_id", repair("props").alias("whole"), repair("cut").alias("repaired"))
