"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A file holds segments one after another, each closed by a line feed. A segment holds whole documents:

    magic "CMIX3\\n"; five unsigned 32-bit numbers: the file's place among all files, documents, blocks, ids (its high and low half are two)
    each document's id (signed 64 bits), whether it has one (a byte), its number of ids (32 bits)
    each block's ids, lanes and crc32 of its ids as 16-bit numbers (32 bits each), then the bytes of each of its lanes (32 bits each)
    the lanes' streams

All numbers are little-endian. A block is dealt into lanes, stretches of one length that are coded side by
side, one id of each at a time, by one common model, which begins empty in each block, so a block can be
read alone. The model predicts an id by three orders:

    order 2: the id that followed the last two ids lately, trusted as far as it has held
    order 1: all ids that have followed the last one, by their counts
    order 0: all ids, by their counts

They are mixed in one distribution. Order 2's id has what such a guess has been worth: by how far it is trusted and by
what order 1 gives it. Of the rest, order 1 has the share that it has earned where it had met the last id as often, and with
as many followers; its followers, without order 2's id, divide that by their counts. Order 0 divides what then is left. All of
that is learned from the ids before, anew after each stretch of steps (a GROWTH longer than all before it).

Nulls count as empty text, which has the end id alone. Null document ids come first. Rows that repeat an
id stand together, by a hash of the text, then the text. Ids have to be whole numbers. A document may have any length: its
ids may fill many blocks. A table without rows gives files without documents. Columns beside those named are ignored.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, IntegralType, LongType, StructField, StructType
from pyspark.sql.window import Window

from cartulary.llm.common import col, pieces_of, tidied, workers_import

MAGIC = b"CMIX3\n"
#: Ids of a block; lanes of one, at most, and ids that a lane has at least, if the block has them.
BLOCK, LANES, STRETCH = 1 << 21, 4096, 256
#: How many times the steps learned from are those of the next stretch, at least one.
GROWTH = 0.5
#: Bits of a probability, of the table of order 2 at most, and of counts: those of order 0 and of a context of order 1.
BITS, ORDER2, COUNTED0, COUNTED1 = 28, 20, 17, 18
#: Most trust in order 2's guess, classes of its odds in order 1, and of contexts of order 1 by counts and by counts a follower.
TRUST, ODDS, FOLLOWED, REPEATED = 3, 10, 24, 8
#: Bytes of text that a file holds, as expected, and files up to which their offsets go to every executor.
FILE_BYTES, MOST_SENT = 32 << 20, 100_000
#: Pieces that each of a worker's two generations remembers (a quarter as many words that are more than letters and signs after them), and bytes of text that are cut at once, at least.
REMEMBERED, CHUNK = 500_000, 8 << 20
#: Signs that, after letters and before a space, a line feed or the end, are a piece of their own: those of ASCII, but for the apostrophe.
CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The pre-tokenisation by words, numbers and other signs, each with a space before it; a fixed value.
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The last sign of which any version of Unicode says the same.
FAMILIAR = "\u024f"
UNFAMILIAR = r"[^\x{0}-\x{24F}]"
_WHOLE, _SPAN, _LEAST, _LOW16 = 1 << BITS, float(1 << 48), float(1 << 32), np.uint32(0xFFFF)
#: Where a packed pair holds its first id and all counts before it, and an entry of order 2 its trust; what masks a count and a pair's number.
_OWNER, _CUM, _TRUST, _COUNT, _PAIR = 44, 22, 24, (1 << 22) - 1, (1 << 24) - 1
#: What an id was coded by.
GUESSED, FOLLOWS, OTHER = 0, 1, 2


def stretches(steps: int) -> list[tuple[int, int]]:
    """The steps between which the model learns: begin and end of each stretch."""
    ends = [0]
    while ends[-1] < steps:
        ends.append(min(steps, ends[-1] + max(1, int(ends[-1] * GROWTH))))
    return list(zip(ends, ends[1:], strict=False))


class Weights:
    """How the orders share the whole at some contexts: arrays, one entry a context.

    Masses are whole numbers held as floats: every product stays below 2**53, so a quotient cut to a whole number is exact.
    """

    def __init__(self, m: Model, last: np.ndarray, before: np.ndarray):
        self.at2 = (last * np.uint32(0x85EBCA77) ^ before * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - m.order2)
        entry = m.table.take(self.at2)
        #: Order 2's pair, and how far it is trusted.
        self.guess, self.trust = entry & _PAIR, entry >> _TRUST
        pair, context = m.packed.take(self.guess), m.context.take(last)
        guessed = (pair >> _OWNER) == last
        #: What order 1 counts for the guess, where its part begins, and for all others.
        self.own = (pair & _COUNT) * guessed
        self.base = context & _COUNT
        self.cut = (pair >> _CUM & _COUNT) - self.base
        met = context >> _CUM & _COUNT
        self.rest = met - self.own
        # the binary digits of the odds are the exponent of a float
        odds = np.minimum((((met + 1) / (self.own + 1)).view(np.int64) >> 52) - 1022, ODDS - 2) + (self.own == 0)
        #: Classes from which the masses are learned; 0 where an order has nothing to say.
        self.class2 = (self.trust * ODDS + odds) * guessed
        self.mass2 = m.worth2.take(self.class2)
        self.class1 = ((context >> _OWNER) + guessed * (FOLLOWED * REPEATED)) * (self.rest > 0)
        self.mass1 = np.floor((_WHOLE - self.mass2) * m.worth1.take(self.class1))

    def followers_part(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size, within the whole, of the parts of order 1's packed pairs, the guess cut out."""
        begin = (pair >> _CUM & _COUNT) - self.base
        begin -= self.own * (begin > self.cut)
        rest = np.maximum(self.rest, 1)
        low = np.floor(begin * self.mass1 / rest)
        return self.mass2 + low, np.floor((begin + (pair & _COUNT)) * self.mass1 / rest) - low


class Model:
    """What a block's ids so far say of the next. All of it is whole numbers and quotients cut to them, so any machine gives the same.

    A pair (an id, its follower) has a number, by which all of it is looked up. Pairs that are not met yet, which the encoder knows,
    have no part of anything; number 0 is no pair.
    """

    def __init__(self, ids: int, pairs: np.ndarray | None = None):
        self.order2 = min(ORDER2, max(8, ids.bit_length()))
        #: Order 2: the pair that came last after a hash of two ids, and above it how far it is trusted (0: none yet).
        self.table = np.zeros(1 << self.order2, np.int32)
        #: Order 1: the pairs in order, their numbers in that order (None: they are numbered in it), and by number the pairs' counts and followers.
        self.pairs = np.zeros(0, np.uint32) if pairs is None else pairs
        self.order = np.zeros(0, np.int64) if pairs is None else None
        self.counts = np.zeros(1 + len(self.pairs), np.int64)
        self.follower = np.concatenate([[0], self.pairs & _LOW16]).astype(np.uint32)
        self.arrange()
        self.seen = np.zeros(1 << 16, np.int64)
        #: Tried and held, by class.
        self.tried2, self.held2 = np.zeros((2, (TRUST + 1) * ODDS), np.int64)
        self.tried1, self.held1 = np.zeros((2, 2 * FOLLOWED * REPEATED), np.int64)
        self.settle()

    def arrange(self) -> None:
        self.owner = (self.pairs >> np.uint32(16)).astype(np.int64)
        self.row = np.concatenate([[0], np.cumsum(np.bincount(self.owner, minlength=1 << 16))])
        self.owner <<= _OWNER

    def settle(self) -> None:
        """Make of the counts what weighing and coding look up."""
        self.cum0 = np.concatenate([[0], np.cumsum(1 + (self.seen << COUNTED0) // max(1, int(self.seen.sum())))])
        counts = self.counts[1:] if self.order is None else self.counts.take(self.order)
        cum = np.concatenate([[0], np.cumsum(counts)])
        packed = self.owner | cum[:-1] << _CUM | counts
        self.packed = np.empty(len(counts) + 1, np.int64)
        self.packed[0] = 1 << 16 + _OWNER  # after no id
        self.packed[slice(1, None) if self.order is None else self.order] = packed
        if self.order is not None:
            self.slots = np.repeat(self.order.astype(np.int32), counts)
            self.slots0 = np.repeat(np.arange(1 << 16, dtype=np.uint16), np.diff(self.cum0))
        base = cum.take(self.row)
        met = np.diff(base)
        followers = np.diff(np.concatenate([[0], np.cumsum(counts > 0, dtype=np.int32)]).take(self.row))
        #: Of each id: where its followers begin, how many have been met, and the class of the two by how often each.
        kind = np.minimum(np.frexp(met)[1], FOLLOWED - 1) * REPEATED + np.minimum(np.frexp(met // np.maximum(followers, 1))[1], REPEATED - 1)
        self.context = base[:-1] | met << _CUM | kind.astype(np.int64) << _OWNER
        # every part stays wide enough for the finest division below it
        self.worth2 = np.clip((2 * self.held2 + 1) * _WHOLE // (2 * self.tried2 + 2), 1 << 16, _WHOLE - (1 << 23)).astype(np.float64)
        self.worth1 = np.clip(((2 * self.held1 + 1) << 16) // (2 * self.tried1 + 2), 1 << 12, (1 << 16) - (1 << 11)) / (1 << 16)
        self.worth2[0] = self.worth1[0] = 0

    def parts(self, w: Weights, pairs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and size of each numbered pair's part of the whole, and what codes it; ids: the pairs' followers."""
        pair = self.packed.take(pairs)
        begin, size = w.followers_part(pair)
        guessed = (w.guess == pairs) & (w.class2 > 0)
        others = ((pair & _COUNT) == 0) | (w.class1 == 0)
        others &= ~guessed
        self.others(w, np.flatnonzero(others), ids, begin, size)
        np.copyto(begin, 0, where=guessed)
        np.copyto(size, w.mass2, where=guessed)
        return begin, size, np.where(guessed, GUESSED, FOLLOWS + others.view(np.int8))

    def others(self, w: Weights, at: np.ndarray, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Set the parts of the ids at `at` to those of order 0."""
        found, mass = ids[at], _WHOLE - w.mass2[at] - w.mass1[at]
        low = np.floor(self.cum0.take(found) * mass / self.cum0[-1])
        begin[at] = _WHOLE - mass + low
        size[at] = np.floor(self.cum0.take(found + 1) * mass / self.cum0[-1]) - low

    def which(self, w: Weights, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids whose parts hold the values, their pairs' numbers (0: by order 0), those parts' begin and size, and what codes them."""
        inner = value - w.mass2
        guessed, others = inner < 0, inner >= w.mass1
        others &= ~guessed
        count = np.floor(((inner + 1) * w.rest - 1) / np.maximum(w.mass1, 1)).astype(np.int64)
        count += w.base + w.own * (count >= w.cut)
        pairs = np.where(guessed, w.guess, self.slots.take(count, mode="clip") if len(self.slots) else 0)
        begin, size = w.followers_part(self.packed.take(pairs))
        ids = self.follower.take(pairs)
        if len(at := np.flatnonzero(others)):
            mass = _WHOLE - w.mass2[at] - w.mass1[at]
            ids[at] = self.slots0.take((((inner[at] - w.mass1[at] + 1) * self.cum0[-1] - 1) / mass).astype(np.int64), mode="clip")
            pairs[at] = 0
            self.others(w, at, ids, begin, size)
        np.copyto(begin, 0, where=guessed)
        np.copyto(size, w.mass2, where=guessed)
        return ids, pairs, begin, size, np.where(guessed, GUESSED, FOLLOWS + others.view(np.int8))

    def numbered(self, ids: np.ndarray, last: np.ndarray, pairs: np.ndarray) -> None:
        """Set the numbers of pairs that are not known (0), new ones where they are."""
        at = np.flatnonzero(pairs == 0)
        found, of = np.unique(last[at] << np.uint32(16) | ids[at], return_inverse=True)
        place = self.pairs.searchsorted(found)
        new = np.ones(len(found), bool)
        inside = place < len(self.pairs)
        new[inside] = self.pairs[place[inside]] != found[inside]
        numbers = np.empty(len(found), np.int64)
        numbers[~new] = self.order[place[~new]]
        numbers[new] = np.arange(len(self.counts), len(self.counts) + new.sum())
        pairs[at] = numbers[of]
        self.order = np.insert(self.order, place[new], numbers[new])
        self.pairs = np.insert(self.pairs, place[new], found[new])
        self.counts = np.concatenate([self.counts, np.zeros(new.sum(), np.int64)])
        self.follower = np.concatenate([self.follower, found[new] & _LOW16])
        self.arrange()

    def learn(self, ids: np.ndarray, last: np.ndarray, pairs: np.ndarray, at2: np.ndarray, guess: np.ndarray, trust: np.ndarray, class2: np.ndarray, class1: np.ndarray, by: np.ndarray) -> None:
        """Take in a stretch: what came where, and what coded it."""
        by2 = np.bincount(class2 * 2 + (by == GUESSED), minlength=2 * len(self.tried2)).reshape(-1, 2)
        by1 = np.bincount(class1 * 3 + by, minlength=3 * len(self.tried1)).reshape(-1, 3)
        self.tried2 += by2.sum(axis=1)
        self.held2 += by2[:, 1]
        self.tried1 += by1[:, FOLLOWS] + by1[:, OTHER]
        self.held1 += by1[:, FOLLOWS]
        if self.order is not None:
            self.numbered(ids, last, pairs)
        trust = np.where(guess == pairs, np.minimum(trust + 1, TRUST), 1)
        self.table[at2] = pairs | trust << _TRUST  # of a context met more than once, the last counts
        self.seen += np.bincount(ids, minlength=1 << 16)
        self.counts += np.bincount(pairs, minlength=len(self.counts))
        # old counts of a context give way where it has very many
        numbers = np.arange(1, len(self.counts)) if self.order is None else self.order
        cum = np.concatenate([[0], np.cumsum(self.counts[numbers])])
        for owner in np.flatnonzero(np.diff(cum.take(self.row)) > 1 << COUNTED1).tolist():
            of = numbers[self.row[owner] : self.row[owner + 1]]
            self.counts[of] = (self.counts[of] + 1) // 2
        self.settle()


def lanes_of(ids: int) -> int:
    return max(1, min(LANES, ids // STRETCH))


def numbered_pairs(last: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs in order, and the number of each one's pair, from 1 on in that order."""
    packed = np.sort((last.astype(np.int64) << 16 | ids) << 31 | np.arange(len(ids)))
    pairs = packed >> 31
    first = np.concatenate([[True], pairs[1:] != pairs[:-1]])
    numbers = np.empty(len(ids), np.int32)
    numbers[packed & ((1 << 31) - 1)] = np.cumsum(first, dtype=np.int32)
    return pairs[first].astype(np.uint32), numbers


def encode_block(ids: np.ndarray) -> list[bytes]:
    """The stream of each lane of a block's ids."""
    lanes = lanes_of(len(ids))
    steps = -(-len(ids) // lanes)
    padded = np.zeros(lanes * steps, np.uint32)  # the last lane is filled up with id 0
    padded[: len(ids)] = ids
    # two empty steps stand before the first
    columns = np.concatenate([np.zeros((2, lanes), np.uint32), padded.reshape(lanes, steps).T])
    known, numbers = numbered_pairs(columns[1:-1].ravel(), columns[2:].ravel())
    m = Model(len(padded), known)
    # whole numbers below 2**53, held as floats
    low, span = np.zeros(lanes), np.full(lanes, _SPAN)
    digits = np.zeros((2 * steps + 8) * lanes, np.int32)
    at = np.arange(lanes) + lanes  # the first digit takes a carry alone
    for a, b in stretches(steps):
        now, last, before = columns[a + 2 : b + 2].ravel(), columns[a + 1 : b + 1].ravel(), columns[a:b].ravel()
        pairs, learned = numbers[a * lanes : b * lanes], []
        for k in range(0, len(now), lanes):
            here = slice(k, k + lanes)
            w = Weights(m, last[here], before[here])
            begin, size, by = m.parts(w, pairs[here], now[here])
            unit = np.floor(span * (1 / _WHOLE))
            low += unit * begin
            span = unit * size
            while len(small := np.flatnonzero(span < _LEAST)):
                v = low[small]
                digit = np.floor(v * (1 / _LEAST))
                digits[at[small]] = digit
                at[small] += lanes
                low[small] = (v - digit * _LEAST) * 65536
                span[small] *= 65536
            learned.append((w.at2, w.guess, w.trust, w.class2, w.class1, by))
        m.learn(now, last, pairs, *map(np.concatenate, zip(*learned, strict=True)))
    for _ in range(3):
        digit = np.floor(low * (1 / _LEAST))
        digits[at] = digit
        low = (low - digit * _LEAST) * 65536
        at += lanes
    filled = at // lanes
    rows = digits.reshape(-1, lanes)[: filled.max()]
    for k in range(len(rows) - 1, 0, -1):  # carries, from the last digit up
        rows[k - 1] += rows[k] >> 16
    streams = np.ascontiguousarray(rows.astype("<u2").T)
    return [d[1:n].tobytes() for d, n in zip(streams, filled.tolist(), strict=True)]


def decode_block(streams: list[bytes], n: int) -> np.ndarray:
    """The n ids that encode_block was given."""
    lanes = len(streams)
    steps = -(-n // lanes)
    width = max(map(len, streams)) // 2 + 8
    digits = np.zeros((lanes, width), np.uint16)
    for k, stream in enumerate(streams):
        digits[k, : len(stream) // 2] = np.frombuffer(stream, "<u2")
    flat, at = digits.ravel(), np.arange(lanes) * width + 3
    code = (digits[:, 0] * 65536.0 + digits[:, 1]) * 65536.0 + digits[:, 2]
    span = np.full(lanes, _SPAN)
    m, columns = Model(lanes * steps), np.zeros((steps + 2, lanes), np.uint32)
    for a, b in stretches(steps):
        learned = []
        for step in range(a, b):
            w = Weights(m, columns[step + 1], columns[step])
            unit = np.floor(span * (1 / _WHOLE))
            # a damaged stream may ask for more than there is; its checksum tells
            ids, pairs, begin, size, by = m.which(w, np.minimum(np.floor(code / unit), _WHOLE - 1))
            code, span = np.minimum(code - unit * begin, _SPAN - 1), unit * np.maximum(size, 1)
            while len(small := np.flatnonzero(span < _LEAST)):
                here = at[small]
                at[small] = here + 1
                code[small] = code[small] * 65536 + flat.take(here, mode="clip")
                span[small] *= 65536
            columns[step + 2] = ids
            learned.append((pairs, w.at2, w.guess, w.trust, w.class2, w.class1, by))
        m.learn(columns[a + 2 : b + 2].ravel(), columns[a + 1 : b + 1].ravel(), *map(np.concatenate, zip(*learned, strict=True)))
    return columns[2:].T.ravel()[:n].astype(np.uint16)


def write_segment(part: int, idents: list[int | None], ids: list[np.ndarray]) -> bytes:
    """The bytes of a segment of file `part`; ids: 16-bit numbers of each document."""
    sizes = np.array(list(map(len, ids)), "<u4")
    flat = np.concatenate([*ids, np.zeros(0, np.uint16)]).astype("<u2")
    table, streams = [], []
    for at in range(0, len(flat), BLOCK):
        block = flat[at : at + BLOCK]
        coded = encode_block(block)
        table += [len(block), len(coded), zlib.crc32(block.tobytes()), *map(len, coded)]
        streams += coded
    head = np.array([part, len(ids), -(-len(flat) // BLOCK), len(flat) >> 32, len(flat) & 0xFFFFFFFF], "<u4")
    named = np.array([i if i is not None else 0 for i in idents], "<i8"), np.array([i is not None for i in idents], np.uint8)
    return b"".join([MAGIC, head.tobytes(), named[0].tobytes(), named[1].tobytes(), sizes.tobytes(), np.array(table, "<u4").tobytes(), *streams, b"\n"])


def read_segments(data: bytes) -> Iterator[tuple[int, list[int | None], np.ndarray, np.ndarray]]:
    """Of each segment: its file's place, the documents' ids, their numbers of ids, and all ids (16 bits). A damaged one raises ValueError."""
    at = 0

    def numbers(kind: str, n: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize * n
        if at + size > len(data):
            raise ValueError(f"a segment is cut at byte {at}")
        at += size
        return np.frombuffer(data, kind, n, at - size)

    while at < len(data):
        if data[at : at + len(MAGIC)] != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        at += len(MAGIC)
        part, n, blocks, high, low = numbers("<u4", 5).tolist()
        idents, named, sizes = numbers("<i8", n).tolist(), numbers("u1", n).tolist(), numbers("<u4", n)
        table = []
        for _ in range(blocks):
            count, lanes, crc = numbers("<u4", 3).tolist()
            table.append((count, crc, numbers("<u4", lanes).tolist()))
        out = []
        for k, (count, crc, lengths) in enumerate(table):
            decoded = decode_block([numbers("u1", size).tobytes() for size in lengths], count)
            if zlib.crc32(decoded.astype("<u2").tobytes()) != crc:
                raise ValueError(f"block {k} is damaged")
            out.append(decoded)
        if data[at : at + 1] != b"\n":
            raise ValueError(f"a segment is cut at byte {at}")
        at += 1
        ids = np.concatenate([*out, np.zeros(0, np.uint16)])
        if len(ids) != high << 32 | low or int(sizes.sum(dtype=np.int64)) != len(ids):
            raise ValueError("a segment's documents and blocks differ")
        yield part, [i if x else None for i, x in zip(idents, named, strict=True)], sizes, ids


class Remembered(dict):
    """What keys met lately gave, in two generations of at most `most`."""

    def __init__(self, most: int):
        self.most, self.older = most, {}

    def put(self, key: str, value: bytes) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def all(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """What the keys, all different, gave; make(those that are not remembered)."""
        found = list(map(self.get, keys))
        lacking = [k for k, x in enumerate(found) if x is None]
        if lacking:
            older, new = self.older, []
            for k in lacking:
                found[k] = value = older.get(keys[k])
                if value is None:
                    new.append(k)
            for k, value in zip(new, make([keys[k] for k in new]) if new else (), strict=True):
                found[k] = value
            for k in lacking:
                self.put(keys[k], found[k])
        return found


def strings(words: pa.Array, between: str) -> list[str]:
    """Strings that do not hold the sign `between` as Python's."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(between, words.type))[0].as_py().split(between)


class Encoder:
    """The tokenizers library's ids of whole texts, as packed 16-bit numbers.

    The library's pre-tokenisation cuts a text into pieces that its model encodes one by one, so a piece is encoded once while it
    is remembered. Where it cuts by WORDWISE, a single space or line feed between other signs always begins a piece, so
    the words between such are encoded once as well: Arrow cuts many texts at once, and of their words only different ones
    are looked up. What may be cut otherwise than by `pattern` goes to the library whole: a text that holds one of its
    added tokens, and a piece with signs beyond FAMILIAR.
    """

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are stored in 16 bits")
        if sys.byteorder != "little":
            raise ValueError("ids are packed as this machine orders bytes, which has to be little-endian")
        self.cut = regex.compile(pattern).findall
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        form = json.loads(self.library.to_str())
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.direct = pattern == WORDWISE and form["normalizer"] is None and byte_level.items() <= (form["pre_tokenizer"] or {}).items()
        self.tokenize = self.library.model.tokenize
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: How the model writes the bytes of signs up to FAMILIAR.
        self.marks = {byte: mark for k in range(ord(FAMILIAR) + 1) for byte, mark in zip(chr(k).encode(), signs(chr(k))[0][0], strict=True)}
        self.pieces, self.words = Remembered(REMEMBERED), Remembered(REMEMBERED // 4)

    def model_pieces(self, pieces: list[str]) -> list[bytes]:
        """The model's ids of pieces without a line feed, whose signs are none beyond FAMILIAR."""
        ids, sizes, tokenize, of = [], [], self.tokenize, attrgetter("id")
        for signs in "\n".join(pieces).encode().decode("latin-1").translate(self.marks).split(self.marks[10]):
            tokens = tokenize(signs)
            ids.extend(map(of, tokens))
            sizes.append(2 * len(tokens))
        packed = array("H", ids).tobytes()
        return [packed[e - s : e] for e, s in zip(accumulate(sizes), sizes, strict=True)]

    def whole(self, text: str) -> bytes:
        return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def new_pieces(self, pieces: list[str]) -> list[bytes]:
        return [array("H", [t.id for t in self.tokenize(p.encode().decode("latin-1").translate(self.marks))]).tobytes() if self.direct and max(p) <= FAMILIAR else self.whole(p) for p in pieces]

    def by_pieces(self, text: str) -> bytes:
        pieces = self.cut(text)
        different = list(dict.fromkeys(pieces))
        of = dict(zip(different, self.pieces.all(different, self.new_pieces), strict=True))
        return b"".join(map(of.__getitem__, pieces))

    def word_ids(self, words: pa.Array) -> list[bytes]:
        """The ids of different words with the space before them, or with the line feed that they begin with; b"" of one that does not stand alone."""
        # letters, and signs after them that join nothing, are cut as they stand; the space is theirs, a line feed is not
        feeds = pc.starts_with(words, "\n")
        bare = pc.if_else(feeds, pc.utf8_slice_codeunits(words, 1), words)
        stems = pc.utf8_rtrim(bare, CLOSING)
        plain = pc.and_(pc.utf8_is_alpha(stems), pc.invert(pc.match_substring_regex(stems, UNFAMILIAR)))
        signs = pc.subtract(pc.binary_length(bare), pc.binary_length(stems)).to_numpy()
        nothing, space = pa.scalar("", words.type), pa.scalar(" ", words.type)
        pieces = pc.binary_join_element_wise(pc.if_else(feeds, nothing, space), stems, nothing).filter(plain).dictionary_encode()
        ids = self.pieces.all(strings(pieces.dictionary, "\n"), self.model_pieces)
        feeds, plain = feeds.to_numpy(zero_copy_only=False), plain.to_numpy(zero_copy_only=False)
        found, names = np.full(len(words), b"", object), strings(words, " ")
        found[plain] = np.array([*ids, b""], object)[:-1].take(pieces.indices.to_numpy())
        if (at := np.flatnonzero(plain & (signs > 0))).size:
            tails = [names[k][-n:] for k, n in zip(at.tolist(), signs[at].tolist(), strict=True)]
            different = list(dict.fromkeys(tails))
            of = dict(zip(different, self.pieces.all(different, self.model_pieces), strict=True))
            found[at] += np.fromiter(map(of.__getitem__, tails), object, len(tails))
        if (at := np.flatnonzero(plain & feeds)).size:
            begin = self.by_pieces("\n")
            found[at] = np.fromiter((begin + x for x in found[at].tolist()), object, len(at))
        at = np.flatnonzero(~plain)
        found[at] = np.fromiter(self.words.all([names[k] for k in at.tolist()], lambda new: list(map(self.word, new))), object, len(at))
        return found.tolist()

    def word(self, word: str) -> bytes:
        bare = word.removeprefix("\n")
        if not bare or not (bare[0] + bare[-1]).isprintable() or bare[0].isspace() or bare[-1].isspace():
            return b""
        return self.by_pieces(word if bare is not word else " " + word)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, sizes = self.encode_all(pa.array(texts, pa.string()), b"")
        ends = np.cumsum(sizes)
        return [ids[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def encode_all(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each text's with `end` behind them, and how many each has."""
        n = len(texts)
        added = np.zeros(n, bool)
        for x in self.added:
            added |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        if not self.direct:
            found = [(self.whole if a else self.by_pieces)(t.as_py()) + end for t, a in zip(texts, added.tolist(), strict=True)]
            return np.frombuffer(b"".join(found), np.uint16), np.fromiter(map(len, found), np.int64, n) // 2
        # bytes: no offset overflows, as a batch does not either; a word begins at each space, or is a line feed's
        cut = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " \n"), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        counts = np.diff(offsets)
        of, firsts = np.repeat(np.arange(n), counts), codes[offsets[:-1]]
        later = np.ones(len(codes), bool)
        later[offsets[:-1]] = False
        met = np.zeros(len(words), bool)
        met[codes[later & ~added.take(of)]] = True
        met = np.flatnonzero(met)
        found = np.full(len(words), b"", object)
        found[met] = np.fromiter(self.word_ids(words.take(met)), object, len(met))
        uneven = np.zeros(len(words), bool)
        uneven[met] = [not x for x in found[met].tolist()]
        found = found.tolist()
        apart = added.copy()
        if uneven.any():
            apart[of[uneven.take(codes) & later]] = True
        # what stands for a text's first word: that, or the whole text
        heads = [(self.whole if a else self.by_pieces)(texts[k].as_py()) if x else self.by_pieces(f) for k, (x, a, f) in enumerate(zip(apart.tolist(), added.tolist(), words.take(firsts).to_pylist(), strict=True))]
        none = len(words) + n
        codes[apart.take(of)] = none
        codes[offsets[:-1]] = np.arange(len(words), none)
        items = np.full(len(codes) + n, none + 1)
        items[np.arange(len(codes)) + of] = codes
        found += [*heads, b"", end]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        begins = np.cumsum(sizes) - sizes
        each = sizes.take(items)
        ends = np.cumsum(each)
        at = np.repeat(begins.take(items) - (ends - each), each)
        at += np.arange(len(at))
        total = ends[offsets[1:] + np.arange(n)] if n else np.zeros(0, np.int64)
        return np.frombuffer(b"".join(found), np.uint16).take(at), np.diff(total, prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One to a worker, with what it remembers."""
    return Encoder(path, pattern)


def write(df: DataFrame, folder: str, tokenizer: str, pattern: str, end_id: int, ident: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all texts, each closed by end_id, to files in folder, in ascending order of ident."""
    spark = df.sparkSession
    workers_import(spark)
    if not isinstance(df.schema[ident].dataType, IntegralType):
        raise ValueError(f"{ident} has to be a column of whole numbers")
    rows = df.select(col(ident).cast("long").alias("ident"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-volume // FILE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the hash lets rows of one id, or of none, fill more than one file
    order = [F.col("ident").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    end = int(end_id).to_bytes(2, "little")

    def run(batches):
        from pyspark import TaskContext

        e, part = encoder(tokenizer, pattern), TaskContext.get().partitionId()
        idents, sizes, ids = [], np.zeros(0, np.int64), np.zeros(0, np.uint16)
        waiting, volume = [], 0

        def segment(n: int, m: int) -> pa.RecordBatch:
            """The first n documents, of m ids; the rest is kept."""
            nonlocal idents, sizes, ids
            made = write_segment(part, idents[:n], np.split(ids[:m], np.cumsum(sizes[:n])[:-1]))
            idents, sizes, ids = idents[n:], sizes[n:], ids[m:]
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["value"])

        def take() -> None:
            nonlocal idents, sizes, ids, waiting, volume
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches() if waiting else []
            for b in rows:
                new, counts = e.encode_all(b.column(1), end)
                idents, sizes, ids = idents + b.column(0).to_pylist(), np.concatenate([sizes, counts]), np.concatenate([ids, new])
            waiting, volume = [], 0

        def full() -> Iterator[pa.RecordBatch]:
            """Segments of as many documents as fill a block, one at least."""
            while len(ids) > BLOCK:
                ends = np.cumsum(sizes)
                n = max(1, int(ends.searchsorted(BLOCK, side="right")))
                yield segment(n, int(ends[n - 1]))

        for batch in batches:
            for piece in pieces_of(batch, 1):
                waiting.append(piece)
                volume += int(pc.sum(pc.binary_length(piece.column(1))).as_py() or 0)
                if volume >= CHUNK:
                    take()
                    yield from full()
        take()
        yield from full()
        if idents:
            yield segment(len(idents), len(ids))

    # the segments' own last byte is the line feed that the writer puts after a row; Spark's strings carry any bytes
    segments = dealt.mapInArrow(tidied(run), StructType([StructField("value", BinaryType())]))
    segments.select(F.expr("cast(substring(value, 1, length(value) - 1) as string)").alias("value")).write.option("maxRecordsPerFile", 0).text(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """part (the file's place), doc_id, start (ids of all documents before it in its file), n_tokens, ids_crc32 of each document; its packed 16-bit ids if asked for."""
    workers_import(spark)
    found = spark.read.format("binaryFile").load(folder).select("content")
    fields = [StructField("part", IntegerType()), StructField("doc_id", LongType()), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())] + [StructField("packed_ids", BinaryType())] * with_ids

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                start = 0
                for part, idents, sizes, ids in read_segments(batch.column(0)[k].as_py()):
                    ends = np.cumsum(sizes, dtype=np.int64)
                    wide = ids.astype("<u4")
                    crcs = [zlib.crc32(wide[e - s : e].tobytes()) for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    columns = [pa.array([part] * len(idents), pa.int32()), pa.array(idents, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes.astype(np.int64)), pa.array(crcs, pa.int64())]
                    if with_ids:
                        columns.append(pa.array([ids[e - s : e].astype("<u2").tobytes() for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary()))
                    start += int(ends[-1]) if len(ends) else 0
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return found.mapInArrow(tidied(run), StructType(fields))


def placed(rows: DataFrame) -> DataFrame:
    """Rows of read() with start counted over all files, which stand in the order of their places, not of their names."""
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    # a row for each file, however many documents there are
    before = sizes.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if before.count() <= MOST_SENT:
        before = F.broadcast(before)
    return rows.join(before, "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")
