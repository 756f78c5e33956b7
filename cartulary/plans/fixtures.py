"""A four-level graph and paged texts from the driver's tables.

Documents are regions, chapters nations, concepts customers, entities orders; customers relate where
lines of 49 pieces or more of theirs share a part. Definitions that both engines read are SQL
with {table} for the driver's tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions.text import ordered_join

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")

_NODE = "{id} AS node_id, {label} AS label, {type} AS type, {summary} AS summary, 'unseen' AS reading_state, CAST({confidence} AS double) AS confidence, '{level}' AS level"


def _node(**parts: str) -> str:
    return _NODE.format(**parts)


NODES = f"""
SELECT {_node(id="concat('d', r_regionkey)", label="r_name", type="'concept'", summary="CAST(NULL AS string)", confidence="1", level="document")} FROM {{region}}
UNION ALL SELECT {_node(id="concat('h', n_nationkey)", label="n_name", type="'concept'", summary="CAST(NULL AS string)", confidence="1", level="chapter")} FROM {{nation}}
UNION ALL SELECT {_node(id="concat('c', c_custkey)", label="c_name", type="CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'theorem' WHEN 'BUILDING' THEN 'method' WHEN 'MACHINERY' THEN 'claim' ELSE 'concept' END",
                         summary="CASE WHEN c_acctbal < 0 THEN NULL ELSE concat('Segment ', c_mktsegment) END", confidence="(c_custkey % 100) / 100.0", level="concept")} FROM {{customer}}
UNION ALL SELECT {_node(id="concat('o', o_orderkey)", label="concat('Order ', o_orderkey)", type="CASE o_orderstatus WHEN 'F' THEN 'result' ELSE 'dataset' END", summary="CAST(NULL AS string)", confidence="(o_orderkey % 50) / 50.0", level="entity")} FROM {{orders}}"""

RELATION = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'dependsOn' WHEN '2' THEN 'extends' WHEN '3' THEN 'uses' WHEN '4' THEN 'cites' ELSE 'sameTopic' END"

#: Lines of 49 pieces or more with their customer, region and relation.
LARGE_LINES = f"""
SELECT l_partkey, l_suppkey, l_linenumber, o_custkey, o_orderkey, {RELATION} AS type FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey WHERE l_quantity >= 49"""

EDGES = f"""
SELECT concat('dh', n_nationkey) AS edge_id, concat('d', n_regionkey) AS src, concat('h', n_nationkey) AS tgt, 'containsChapter' AS type FROM {{nation}}
UNION ALL SELECT concat('hc', c_custkey), concat('h', c_nationkey), concat('c', c_custkey), 'containsConcept' FROM {{customer}}
UNION ALL SELECT concat('co', o_orderkey), concat('c', o_custkey), concat('o', o_orderkey), 'containsEntity' FROM {{orders}}
UNION ALL SELECT concat('r', a, '-', b, '-', type), concat('c', a), concat('c', b), type FROM (
  SELECT DISTINCT x.o_custkey AS a, y.o_custkey AS b, x.type AS type FROM ({LARGE_LINES}) x JOIN ({LARGE_LINES}) y ON x.l_partkey = y.l_partkey AND x.o_custkey < y.o_custkey) AS pairs"""

#: A customer stands in its own region's document, and in those of the suppliers of its large lines.
ANCHORS = f"""
SELECT node_id, CAST(row_number() OVER (PARTITION BY node_id ORDER BY own DESC, doc_id, page) - 1 AS int) AS ord, doc_id, page, concat('seen in ', doc_id, ' on ', page) AS snippet FROM (
  SELECT concat('c', c_custkey) AS node_id, concat('d', n_regionkey) AS doc_id, CAST(c_custkey % 40 AS int) AS page, 1 AS own FROM {{customer}} JOIN {{nation}} ON n_nationkey = c_nationkey
  UNION SELECT concat('c', o_custkey), concat('d', n_regionkey), CAST(l_partkey % 40 AS int), 0 FROM ({LARGE_LINES}) l JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{nation}} ON n_nationkey = s_nationkey) AS places"""


def duck(sql: str) -> str:
    """A definition for DuckDB, where the tables are views of their own names."""
    return sql.format(**{t: t for t in TABLES})


#: The texts as pages of four lines, and their lines that aren't blank, for DuckDB.
DUCK_LINES = "SELECT concat('doc', doc_id) AS doc_id, CAST(n // 4 AS int) AS page, CAST(n % 4 AS int) AS line_no, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r') AS l FROM documents))"
DUCK_PAGES = f"SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_no) AS text FROM ({DUCK_LINES}) GROUP BY ALL"
DUCK_BLOCKS = f"SELECT doc_id, page, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text FROM ({DUCK_LINES}) WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''"


class Fixture:
    """The fixture of one scale. Each part is a plan, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # Python workers find this package where the driver has it on a path of its own
        env = spark.sparkContext.environment
        if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), ROOT]))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{t: self.table(t) for t in TABLES if "{" + t + "}" in text})

    @property
    def nodes(self) -> DataFrame:
        return self.sql(NODES)

    @property
    def edges(self) -> DataFrame:
        return self.sql(EDGES)

    @property
    def anchors(self) -> DataFrame:
        return self.sql(ANCHORS)

    @property
    def documents(self) -> DataFrame:
        return self.table("region").select(F.concat(F.lit("d"), "r_regionkey").alias("doc_id"))

    @property
    def pages(self) -> DataFrame:
        """doc_id, page, text: four lines a page. Pages are cut within a row; only where ids repeat are their lines put together by a shuffle."""
        docs = self.table("documents")
        lines = F.split(F.coalesce("text", F.lit("")), r"\R")
        named = docs.select(F.concat(F.lit("doc"), "doc_id").alias("doc_id"), lines.alias("lines"))
        if docs.groupBy("doc_id").count().filter("count > 1").head(1):
            split = named.select("doc_id", F.posexplode("lines").alias("n", "line"))
            return split.groupBy("doc_id", F.floor(F.col("n") / 4).cast("int").alias("page")).agg(ordered_join(F.col("n"), F.col("line"), "\n").alias("text"))
        cut = F.transform(F.sequence(F.lit(0), F.expr("int((size(lines) - 1) div 4)")), lambda k: F.array_join(F.slice("lines", k * 4 + 1, F.lit(4)), "\n"))
        return named.select("doc_id", F.posexplode(cut).alias("page", "text"))
