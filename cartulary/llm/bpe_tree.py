"""Byte-level BPE encoding and decoding by tree reduction.

Encodings form a monoid: the encoding of a+b follows from those of a and b. A piece
(a match of the pre-tokenisation pattern) is halved until a half is a few bytes long;
two halves are joined by encoding a window of tokens around the seam anew. The window
grows on a side until its outermost token there is what it was, or the side ends.

Why that is enough: byte pair merging always merges the lowest rank, leftmost first. A
sequence of tokens is the encoding of its bytes if and only if each two neighbours are
the encoding of theirs: the first merge that would cross a boundary would also cross it
when the two tokens at that boundary are merged alone. With the outermost token
unchanged, each neighbouring pair of the joined sequence stands inside one of the three
encodings, so all pairs are right and the whole is.

Decoding concatenates the tokens' bytes block by block, then up the tree.

Nulls count as empty text. Empty texts have no ids. A text of any length is encoded whole. Equal texts have equal ids. A table
without rows gives none. Columns beside those named are ignored.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType

from cartulary.llm.common import map_texts

#: Bytes up to which a half is encoded at once.
LEAF = 8
#: Pieces that each of a worker's two generations remembers, and the length up to which it does.
REMEMBERED, LONGEST = 150_000, 48
#: Stretches of bytes that a worker remembers the tokens of, and the length up to which it does.
SHORT_REMEMBERED, SHORT = 100_000, 16
#: Tokens whose bytes are joined at once in decoding.
BLOCK = 2048
#: Above all ranks.
NEVER = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Byte pair merging of all of data: the lowest rank first, the leftmost of equals."""
    parts = [data[i : i + 1] for i in range(len(data))]
    rank = ranks.get
    if len(parts) <= 64:
        near = [rank(data[i : i + 2], NEVER) for i in range(len(parts) - 1)]
        while near and (best := min(near)) != NEVER:
            i = near.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
            if i < len(near):
                near[i] = rank(parts[i] + parts[i + 1], NEVER)
        return parts
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = parts[i]
        j = after[i] if left else n
        if not left or j >= n or len(left) + len(parts[j]) != size:
            continue
        parts[i] = left = left + parts[j]
        parts[j] = b""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(left + parts[k])) is not None:
                heapq.heappush(heap, (r, i, size + len(parts[k])))
        if (k := before[i]) >= 0 and (r := ranks.get(parts[k] + left)) is not None:
            heapq.heappush(heap, (r, k, size + len(parts[k])))
    return [p for p in parts if p]


class Merger(dict):
    """merged() by the ranks of a vocabulary, with what short stretches gave lately: halves and windows recur in many pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, data: bytes) -> list[bytes]:
        parts = merged(data, self.ranks)
        if len(data) <= SHORT:
            if len(self) >= SHORT_REMEMBERED:
                self.clear()
            self[data] = parts
        return parts


def joined(a: list[bytes], b: list[bytes], merger: Merger) -> list[bytes]:
    """The encoding of the bytes of a and b together, from their encodings."""
    left = right = 1
    while True:
        i, j = max(0, len(a) - left), min(len(b), right)
        window = merger[b"".join(a[i:] + b[:j])]
        left_holds = i == 0 or window[0] == a[i]
        right_holds = j == len(b) or window[-1] == b[j - 1]
        if left_holds and right_holds:
            return a[:i] + window + b[j:]
        left *= 1 if left_holds else 2
        right *= 1 if right_holds else 2


def encode_piece(piece: bytes, merger: Merger) -> list[bytes]:
    """Tokens of one piece; halves are encoded first, then joined."""
    if len(piece) <= LEAF:
        return merger[piece]
    half = len(piece) // 2
    return joined(encode_piece(piece[:half], merger), encode_piece(piece[half:], merger), merger)


def decode_ids(ids: Sequence[int], tokens: Sequence[bytes]) -> bytes:
    if len(ids) <= BLOCK:
        return b"".join(map(tokens.__getitem__, ids))
    half = len(ids) // 2
    return decode_ids(ids[:half], tokens) + decode_ids(ids[half:], tokens)


class Codec(dict):
    """Whole texts to packed ids (little-endian, 32 bits) and back. As a dict: what pieces met lately gave; `older` is the generation before."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.older: dict[str, bytes] = {}
        self.ranks = load_ranks(path)
        self.merger = Merger(self.ranks)
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pieces = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        if (packed := self.older.pop(piece, None)) is None:
            packed = self.fresh(piece)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def fresh(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else [self.ranks[t] for t in encode_piece(data, self.merger)]
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))

    def decode(self, packed: bytes) -> bytes:
        return decode_ids(np.frombuffer(packed, "<u4").tolist(), self.tokens)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One to a worker, with what it remembers."""
    return Codec(path, pattern)


def _coder(path: str, pattern: str, as_array: bool):
    c = codec(path, pattern)

    def compute(texts):
        packed = [c.encode(t or "") for t in texts]
        out = [pa.array([len(p) // 4 for p in packed], pa.int64())]
        if as_array:
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            return [*out, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))]
        return [*out, pa.array(packed, pa.binary()), pa.array([c.decode(p) for p in packed], pa.binary())]

    return compute


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str | tuple[str, Column]] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, n_tokens and ids (array<int>) of each whole text."""
    return map_texts(df, text, keep, [("n_tokens", LongType()), ("ids", ArrayType(IntegerType()))], _coder, path, pattern, True)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str | tuple[str, Column]] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, n_tokens, packed_ids (little-endian, 32 bits each) and decoded (the bytes those ids stand for)."""
    return map_texts(df, text, keep, [("n_tokens", LongType()), ("packed_ids", BinaryType()), ("decoded", BinaryType())], _coder, path, pattern, False)
