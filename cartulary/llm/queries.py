"""The driver's queries of this subpackage, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import bpe_tree, gif_media, language_profiles, ngram_join, piece_counts, quartile_digest, secret_scan, source_mix, token_files, url_rules
from cartulary.llm.common import discard, fresh_path, kept, table

#: Training leaves out the documents whose crc32 of the id has this remainder by FOLDS.
FOLDS, HELD_OUT = 4, 2
TOKEN_LIMIT = 4096
#: The id that closes each document in token files.
END_ID = 2
#: Shares of the mix: a source's weight, 1 where it has none here.
MIX_WEIGHTS, MIX_SEED = {"src0": 4.0}, "mix"
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op1_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    prototypes = language_profiles.fit(documents.filter(~held_out))
    return language_profiles.predict(documents, prototypes, keep=["doc_id", ("held_out", held_out)])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_texts(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.joined_spans(base), 256).alias("base_sha256"), secret_scan.joined_spans(F.col("spans")).alias("spans"), count("novel"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), with_links=True)


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_tree.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("packed_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the media column is written, and what is written is read
    return gif_media.read_texts(kept(gif_media.write_texts(table(spark, sf_dir, "documents")), "media"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.replicate(table(spark, sf_dir, "documents"), MIX_WEIGHTS, seed=MIX_SEED)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, END_ID)
    # decoded once: the table serves the offsets and the rows
    rows = kept(token_files.read(spark, folder), "token-rows")
    discard(spark, folder)
    return token_files.placed(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile_digest.compare_neighbours(table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rules_table(spark, URL_RULES))


def op10_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)


QUERIES = {f.__name__: f for f in (op1_language_profiles, op2_secret_scan, op3_ngram_join, op4_bpe_tree, op5_gif_media, op6_source_mix, op7_token_files, op8_quartile_digest, op9_url_rules, op10_piece_counts)}

_UPPER, _LOWER = url_rules.UPPER, url_rules.LOWER

ORACLES = {
    "op3_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
f AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS o FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT i, j FROM p JOIN s a ON a.doc_id = i JOIN s b ON b.doc_id = j WHERE 100 * o >= 75 * (len(a.g) + len(b.g) - o)),
e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.j, r.c FROM r JOIN e ON r.doc_id = e.i)
SELECT s.doc_id, len(any_value(s.g)) AS n_shingles, min(r.c) AS component_id, (SELECT count(*) FROM e WHERE e.i = s.doc_id) AS n_links FROM s JOIN r USING (doc_id) GROUP BY s.doc_id""",
    "op6_source_mix": f"""
WITH z AS (SELECT source, sum(length(coalesce(text, ''))) AS size, CASE source WHEN 'src0' THEN {MIX_WEIGHTS["src0"]} ELSE 1.0 END::DOUBLE AS weight FROM documents GROUP BY source),
r AS (SELECT source, CASE WHEN size = 0 THEN 1.0 ELSE weight / (SELECT sum(weight) FROM z) * (SELECT sum(size) FROM z)::DOUBLE / size END AS rate FROM z),
k AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below FROM r, generate_series(0, 400) AS g(k)),
d AS (SELECT *, ('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / {16**13}::DOUBLE AS u FROM documents)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (k.k + 1)::INTEGER AS copy, md5('{MIX_SEED}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || (k.k + 1)::INTEGER) AS shuffle_key
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source AND k.below <= d.u""",
    "op9_url_rules": f"""
WITH rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)}),
u AS (SELECT row_number() OVER () AS row, page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
      coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(contains(url, '://'), false) AS whole FROM pages),
m AS (SELECT row, arg_max(h || p, (length(h) + length(p), length(h), v = 'block')) AS rule, arg_max(v, (length(h) + length(p), length(h), v = 'block')) AS v
      FROM u JOIN rules ON whole AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (row)""",
}
