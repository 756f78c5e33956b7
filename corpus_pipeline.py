"""From raw documents to token ids: five stages, each over all that the one before it kept.

Each stage takes whole texts of any length, an empty table (which gives an empty one) and rows that repeat, and
returns no columns but those of documents, whatever else docs has; the last returns ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import bpe_tree, language_profiles, ngram_join, secret_scan, source_mix
from cartulary.llm.common import discard, stored, table
from cartulary.llm.queries import MIX_SEED, MIX_WEIGHTS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Cosines under this are no likelier of a text in a language than of unrelated vectors of 1024 places (a standard deviation is 0.031).
LEAST_SCORE = 0.03


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without a letter, or like no language's profile, go.

    A null text, or one without a letter, goes. Null languages are not learned from, and without any language known all documents go. A tie
    of languages goes to the first by name, which keeps the document all the same. Null ids, sources and lengths stay as they are;
    repeated rows are judged alike.
    """
    prototypes = language_profiles.fit(docs)
    return language_profiles.predict(docs, prototypes, keep=COLUMNS).filter((F.col("lang_pred") != language_profiles.UND) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of links: that of the smallest id.

    Documents without words link with nothing and stay, as do those without id. Of rows that repeat id and text, one stays: that
    whose lang, source and n_chars come first in order, nulls first. Rows that repeat an id with texts that do not link all stay.
    """
    return ngram_join.keep_one(docs, ngram_join.components(docs)).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a label.

    Overlapping secrets get one label. A null text stays null, with a null n_chars; other n_chars are those of the new text. Nulls in other
    columns and repeated rows stay.
    """
    clean = secret_scan.redact_texts(docs, keep=["doc_id", "lang", "source"])
    return clean.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for, in a global shuffle.

    A null source is a source of its own, of weight 1. A null or empty text has no size and is replicated like others of its source. Null
    ids count as one id; repeated ids get equal counts, and their copies an order that their other columns decide.
    """
    return source_mix.replicate(docs, MIX_WEIGHTS, seed=MIX_SEED).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it: doc_id, source, n_tokens, packed_ids, ids_sha256, round_trip.

    A null text has no ids, like an empty one. Nulls in doc_id and source stay; a row comes for each row, repeated ones too.
    """
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe_tree.round_trip(docs, path, pattern, keep=["doc_id", "source", ("wanted", F.sha2(F.coalesce("text", F.lit("")), 256))])
    return coded.select("doc_id", "source", "n_tokens", "packed_ids", F.sha2("packed_ids", 256).alias("ids_sha256"), (F.sha2("decoded", 256) == F.col("wanted")).alias("round_trip"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

#: Novelty, profiles and token ids are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs, at = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        # a stage's table is read by the next alone
        discard(spark, *before)
        before = [at]
    return docs
