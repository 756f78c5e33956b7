"""Document fingerprints: digests of quartiles over buckets of hashed byte triplets.

Of each four bytes in a row, three triplets are hashed into 128 buckets. A bucket's code
(0 to 3) says between which quartiles of all bucket counts its count lies. The digest is
hex: a length code (logarithm of the byte length), the ratios of the quartiles, the codes.
Two digests differ by a bounded score; likeness is 1 less the score's share of its bound.

Nulls count as empty text, whose digest is that of no triplets. Texts under four bytes have
no triplets either, and differ by length alone. Equal texts have equal digests, and likeness 1. A text of any
length is hashed whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from cartulary.llm.common import col, kept, map_texts, pieces_of, tidied, workers_import

BUCKETS = 128
#: Bytes of a text that are hashed at once.
STRETCH = 1 << 20
#: Bytes of text of a partition of neighbours, as expected.
PART_BYTES = 32 << 20
#: Odd multipliers and offsets of the three triplet hashes.
MIX = ((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 11), (0x27D4EB2F, 0x165667B1, 0x9E3779B1, 101), (0x85EBCA77, 0x27D4EB2F, 0xC2B2AE3D, 211))
#: Bounds of the difference in length codes and in each quartile ratio.
MOST_LENGTH, MOST_RATIO = 24, 7
#: The bound of the difference score.
MOST = MOST_LENGTH + 2 * MOST_RATIO + 6 * BUCKETS
#: Difference of two bucket codes: opposite ends weigh double.
APART = np.array([0, 1, 2, 6], np.int64)


def bucket_counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(0, len(data) - 3), STRETCH):
        x = np.frombuffer(data, np.uint8, min(STRETCH + 3, len(data) - at), at).astype(np.uint32)
        a, b, c, d = x[:-3], x[1:-2], x[2:-1], x[3:]
        for (p, q, r, s), three in zip(MIX, ((a, b, c), (a, b, d), (a, c, d)), strict=True):
            h = three[0] * np.uint32(p) + three[1] * np.uint32(q) + three[2] * np.uint32(r) + np.uint32(s)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    return counts


def digest(text: str | bytes) -> str:
    data = text.encode() if isinstance(text, str) else text
    counts = bucket_counts(data)
    ranked = np.sort(counts)
    q1, q2, q3 = (int(ranked[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(-1, 4)
    packed = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    length = min(255, round(math.log(len(data) + 1, 1.2)))
    ratios = (16 * q1 // q3 % 16 if q3 else 0) | (16 * q2 // q3 % 16 if q3 else 0) << 4
    return f"{length:02x}{ratios:02x}{packed.astype(np.uint8).tobytes().hex()}"


def difference(a: str, b: str) -> int:
    """The difference score of two digests, 0 to MOST."""
    if a == b:
        return 0
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (a, b))
    score = min(MOST_LENGTH, abs(int(x[0]) - int(y[0])))
    for shift in (0, 4):
        r = abs(int(x[1] >> shift & 15) - int(y[1] >> shift & 15))
        score += min(MOST_RATIO, r, 16 - r)
    for shift in (0, 2, 4, 6):
        score += int(APART[np.abs((x[2:] >> shift & 3).astype(np.int64) - (y[2:] >> shift & 3))].sum())
    return score


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / MOST


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many code points of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _digests():
    return lambda texts: [pa.array([digest(t or "") for t in texts], pa.string())]


def fingerprint(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and the fingerprint of each whole text."""
    return map_texts(df, text, keep, [("fingerprint", StringType())], _digests)


def compared(text: str, following: str, own: str, after: str) -> tuple:
    changed = edited(text, following)
    d = digest(changed)
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), own, d, likeness(own, d), likeness(own, after)


#: What compared() gives, and its Arrow types.
FIELDS = (("n_chars", pa.int64(), LongType()), ("edited_sha256", pa.string(), StringType()), ("fingerprint", pa.string(), StringType()), ("edited_fingerprint", pa.string(), StringType()), ("near_edited", pa.float64(), DoubleType()), ("near_next", pa.float64(), DoubleType()))


def compare_neighbours(df: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form, and its likeness to that and to the next row's text.

    Rows stand in ascending order of ident (nulls first, equal idents by text); after the last comes the first.
    The texts are dealt out by ranges of ident once. Within a range neighbours meet in one pass; the first
    text of each range and its last, two rows a partition, then meet across the borders.
    A repeated row is its own neighbour like any other. A single row is its own next.
    """
    workers_import(df.sparkSession)
    rows = df.select(col(ident).alias("ident"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-volume // PART_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_rows = rows.repartitionByRange(parts, F.col("ident").asc_nulls_first()).sortWithinPartitions(F.col("ident").asc_nulls_first(), "text")
    kind = sorted_rows.schema["ident"].dataType
    #: part and last: of border rows alone, which keep their text.
    schema = StructType([StructField("ident", kind), *(StructField(n, t) for n, _, t in FIELDS), StructField("part", IntegerType()), StructField("last", BooleanType()), StructField("text", StringType())])

    def run(batches):
        from pyspark import TaskContext

        part, previous, first, ident_type = TaskContext.get().partitionId(), None, None, None

        def out(found, borders=()):
            idents = pa.array([r[0] for r in found] + [b[0] for b in borders], ident_type)
            nothing = [None] * len(borders)
            columns = [pa.array([r[1][k] for r in found] + nothing, t) for k, (_, t, _) in enumerate(FIELDS)]
            blank = [None] * len(found)
            tail = [pa.array(blank + [part] * len(borders), pa.int32()), pa.array(blank + [b[2] for b in borders], pa.bool_()), pa.array(blank + [b[1] for b in borders], pa.string())]
            return pa.RecordBatch.from_arrays([idents, *columns, *tail], names=schema.names)

        for batch in batches:
            ident_type = batch.column(0).type
            for piece in pieces_of(batch, 1):
                found = []
                for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    d = digest(t)
                    if previous is None:
                        first = (i, t, False)
                    else:
                        found.append((previous[0], compared(previous[1], t, previous[2], d)))
                    previous = (i, t, d)
                yield out(found)
        if previous is not None:
            yield out([], [first, (previous[0], previous[1], True)])

    done = kept(sorted_rows.mapInArrow(tidied(run), schema), "digests")
    names = [n for n, _, _ in FIELDS]
    inner = done.filter("part is null").select("ident", *names)
    # two rows for each partition with rows; their numbers alone, without texts, are put in order
    borders = done.filter("part is not null").select("ident", "text", "part", "last")
    numbers = done.filter("not last").select("part")
    after = numbers.select("part", F.lead("part").over(Window.orderBy("part")).alias("next")).join(numbers.agg(F.min("part").alias("first"))).select("part", F.coalesce("next", "first").alias("next"))
    starts = borders.filter("not last").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = borders.filter("last").join(after, "part").join(starts, "next")

    def meet(batches):
        for batch in batches:
            found = [compared(t, f, digest(t), digest(f)) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in found], t) for k, (_, t, _) in enumerate(FIELDS))], names=["ident", *names])

    outer = ends.select("ident", "text", "following").mapInArrow(tidied(meet), StructType(schema.fields[: 1 + len(FIELDS)]))
    return inner.unionByName(outer).withColumnRenamed("ident", ident)
