"""Token counts by heap-and-linked-list pair merging over pieces.

Symbols of a text stand in a linked list, their mergeable neighbours in a heap. The pair of
the lowest rank (the highest score), leftmost of equals, is popped and merged until none is
left: the count is the initial symbols less the merges. A symbol outside the vocabulary
counts as its UTF-8 bytes where the model falls back to bytes, else as one. No ids are made.

A text is cut before each run of space marks where no piece of the vocabulary reaches over
such a cut, as then no merge can; what a worker has counted it remembers up to a bound.

Nulls count as empty text; empty texts have 0 tokens. A text of any length is counted whole. Equal texts have equal counts.
A table without rows gives none. Columns beside those named are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cartulary.llm.common import map_texts

MARK = "▁"
REMEMBERED, LONGEST = 200_000, 64


def merge_count(text: str, ranks: dict[str, float], byte_fallback: bool = True) -> int:
    """Tokens of a normalised text (spaces already marks): initial symbols less merges."""
    parts: list[str] = list(text)
    n = count = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(text[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = parts[i]
        j = after[i] if left else n
        if not left or j >= n or len(left) + len(parts[j]) != size:
            continue  # one of the two has been merged since
        count -= 1
        parts[i] = left = left + parts[j]
        parts[j] = ""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(left + parts[k])) is not None:
                heapq.heappush(heap, (r, i, size + len(parts[k])))
        if (k := before[i]) >= 0 and (r := ranks.get(parts[k] + left)) is not None:
            heapq.heappush(heap, (r, k, size + len(parts[k])))
    if byte_fallback:
        count += sum(len(p.encode()) - 1 for p in parts if len(p) == 1 and p not in ranks)
    return count


class Counter(dict):
    """Counts of whole texts. As a dict: what stretches met lately gave; `older` is the generation before."""

    def __init__(self, path: str):
        import sentencepiece

        self.older: dict[str, int] = {}
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        self.fallback = any(map(p.is_byte, ids))
        self.ranks = {p.id_to_piece(i): -p.get_score(i) for i in ids if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
        self.normalize = p.normalize
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if not any(MARK in x.lstrip(MARK) for x in self.ranks) else None

    def __missing__(self, stretch: str) -> int:
        if (n := self.older.pop(stretch, None)) is None:
            n = merge_count(stretch, self.ranks, self.fallback)
        if len(stretch) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[stretch] = n
        return n

    def count(self, text: str) -> int:
        marked = self.normalize(text)
        return sum(map(self.__getitem__, self.cut.findall(marked) if self.cut else [marked]))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One to a worker, with what it remembers."""
    return Counter(path)


def _counts(path: str):
    c = counter(path)
    return lambda texts: [pa.array([c.count(t) if t else 0 for t in texts], pa.int64())]


def count_tokens(df: DataFrame, path: str, limit: int, text: str = "text", keep: Sequence[str | tuple[str, Column]] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each whole text."""
    size = F.octet_length(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).cast("long")
    return map_texts(df, text, [*keep, ("n_bytes", size)], [("n_tokens", LongType())], _counts, path).withColumn("over_limit", F.col("n_tokens") > limit)
