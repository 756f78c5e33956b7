"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. Three letters in a row are bound into one: the
vectors of the first and second, permuted (rotated) by two places and one, times that of the
third. A document is the bundle (sum) of its trigrams' vectors, a language the bundle of its
documents' vectors, each scaled to one length. The nearest language by cosine is predicted; the
score is that cosine (at least 0).

Texts are lowered and profiled whole, however long; what is no letter counts as one space. Letters from U+0400 on share
1024 vectors, so scripts are told apart, but not each letter of large ones. A text that is null or has no letter is
`und` with score 0, as are all without any prototype. Ties go to the first label in order.
Prototypes are sums of whole numbers, so they don't depend on the order of rows or tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from cartulary.llm.common import ROWS, col, map_texts, tidied, workers_import

#: Places of a vector; letters told apart; trigrams bound at once; steps to a unit of a scaled document vector.
PLACES, LETTERS, AT_ONCE, STEPS = 1024, 2048, 8192, 1 << 20
SEED = 20
#: Code points of texts profiled at once.
STRETCH = 1 << 21
UND = "und"
#: Documents of a label that a fit takes, as expected; a label with fewer gives all. Labels a fit may have.
PER_LABEL, MOST_LABELS = 1500, 10_000


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point (0: no letter) and each symbol's vector."""
    symbols = np.zeros(0x110000, np.uint16)
    points = np.array([p for p in range(0x110000) if chr(p).isalpha()])
    symbols[points] = np.where(points < 1024, points, 1024 + points % (LETTERS - 1024))
    return symbols, np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (LETTERS, PLACES), np.int8) * 2 - 1


def bound(trigrams: np.ndarray) -> np.ndarray:
    """The vector of each trigram (22 bits of two letters, 11 of the third)."""
    vectors = _letters()[1]
    a, b, c = trigrams >> 22, trigrams >> 11 & 2047, trigrams & 2047
    return np.roll(vectors, 2, 1)[a] * np.roll(vectors, 1, 1)[b] * vectors[c]


def trigram_codes(text: str) -> np.ndarray:
    """Codes of the trigrams of a text, with a space before and after; none if it has no letter."""
    if not text:
        return np.zeros(0, np.int64)
    s = _letters()[0][np.frombuffer(text.lower().encode("utf-32-le"), "<u4")]
    s = np.concatenate([[0], s, [0]]).astype(np.int64)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    return s[:-2] << 22 | s[1:-1] << 11 | s[2:] if len(s) > 2 else np.zeros(0, np.int64)


def bundles(texts: Sequence[str | None]) -> np.ndarray:
    """One row for each text: the sum of its trigrams' vectors."""
    out = np.zeros((len(texts), PLACES), np.float32)
    at = 0
    while at < len(texts):
        rows, size = [], 0
        while at + len(rows) < len(texts) and (not rows or size < STRETCH):
            rows.append(trigram_codes(texts[at + len(rows)] or ""))
            size += len(rows[-1])
        coded = np.concatenate(rows) | np.repeat(np.arange(len(rows)), list(map(len, rows))) << 33
        coded, counts = np.unique(coded, return_counts=True)
        row, codes = coded >> 33, coded & (1 << 33) - 1
        known, place = np.unique(codes, return_inverse=True)
        for k in range(0, len(known), AT_ONCE):
            here = (place >= k) & (place < k + AT_ONCE)
            weights = np.zeros((len(rows), min(AT_ONCE, len(known) - k)), np.float32)
            weights[row[here], place[here] - k] = counts[here]
            out[at : at + len(rows)] += weights @ bound(known[k : k + AT_ONCE]).astype(np.float32)
        at += len(rows)
    return out


def fit(df: DataFrame, per_label: int = PER_LABEL, ident: str = "doc_id", text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by label from rows with a label and a text.

    A label's documents are taken by a hash of their ids, per_label of them as expected: a bounded
    sample, spread over the whole table. Labels are a closed set; over MOST_LABELS is an error.
    """
    workers_import(df.sparkSession)
    rows = df.select(col(ident).cast("string").alias("ident"), col(label).cast("string").alias("label"), col(text).cast("string").alias("text")).filter("label is not null and text is not null")
    counts = rows.groupBy("label").count().limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels")
    if not counts:
        return {}
    share = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r["label"], per_label / r["count"]))), F.col("label"))
    taken = rows.filter(F.pmod(F.xxhash64("ident", F.lit(SEED)), F.lit(1_000_000)) / 1e6 < share).select("label", "text")

    def summed(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                vectors = bundles(part.column(1).to_pylist()).astype(np.float64)
                lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
                scaled = np.rint(vectors / np.where(lengths > 0, lengths, 1) * STEPS).astype(np.int64)
                for name, v in zip(part.column(0).to_pylist(), scaled, strict=True):
                    sums[name] = sums[name] + v if name in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["label", "vector"])

    parts = taken.mapInArrow(tidied(summed), StructType([StructField("label", StringType()), StructField("vector", ArrayType(LongType()))]))
    total = parts.select("label", F.posexplode("vector").alias("place", "value")).groupBy("label", "place").agg(F.sum("value").alias("value"))
    whole = total.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector"))
    out = {r["label"]: np.array(r["vector"], np.float64) for r in whole.toLocalIterator()}  # one row of PLACES numbers a label
    return dict(sorted((k, v) for k, v in out.items() if v.any()))


def _predictor(labels: list[str], prototypes: np.ndarray):
    def compute(texts):
        vectors = bundles(texts).astype(np.float64)
        lengths = np.linalg.norm(vectors, axis=1)
        if not labels:
            return [pa.array([UND] * len(texts)), pa.array([0.0] * len(texts))]
        cosines = vectors @ prototypes.T / np.where(lengths > 0, lengths, 1)[:, None]
        best = cosines.argmax(1)
        score = np.clip(cosines[np.arange(len(texts)), best], 0, 1)
        return [pa.array([labels[b] if n else UND for b, n in zip(best, lengths, strict=True)], pa.string()), pa.array(np.where(lengths > 0, score, 0.0))]

    return compute


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep: Sequence[str | tuple[str, Column]] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, lang_pred and score (0 to 1) of each whole text."""
    scaled = np.array([v / np.linalg.norm(v) for v in prototypes.values()]) if prototypes else np.zeros((0, PLACES))
    return map_texts(df, text, keep, [("lang_pred", StringType()), ("score", DoubleType())], _predictor, list(prototypes), scaled)
