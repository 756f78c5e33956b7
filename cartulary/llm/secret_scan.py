"""Secret scans: fixed patterns, and novelty under a primed zstandard compressor.

Base spans are those of three patterns (assign, access, hex). Beyond them, each long string of a text
with a sensitive word, before or after it and however far, is a candidate: its marginal compressed
bytes are those that it adds to the text around it, with that text and a dictionary of identifiers
known to the compressor, but not with other copies of the string: a secret does not explain itself.
A string that nothing known explains adds about as many bytes as it has; if its share reaches NOVEL,
it is reported as `novel`, in all places where it stands. Where a line of a private key's block is reported,
all its lines are, to the END mark, whatever their share. The share is given for base spans as well.

Null texts count as empty and have no spans. A text of any length is scanned whole, in time that grows with its length. Empty tables give none. Positions are code points, ends exclusive. Spans
stand by start, then by kind as listed in KINDS. Equal texts have equal spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from cartulary.llm.common import map_texts

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words that an assign match begins with, and those that make their text sensitive.
ASSIGNED = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE = (*ASSIGNED, "bearer", "credential", "private_key", "private key", "signature", "auth_", "authorization", "access_key", "access key")
NEAR = re.compile("|".join(map(re.escape, SENSITIVE)), re.A | re.I)
#: Code points around a candidate that prime the compressor.
AROUND = 1024
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
#: A private key between its marks, and the lines of one that hold nothing but the key.
BLOCK = re.compile(r"-----BEGIN (?P<what>[A-Z0-9 ]*PRIVATE KEY[A-Z ]*)-----(?P<body>(?:(?!-----BEGIN ).)*?)-----END (?P=what)-----", re.S)
KEY_LINE = re.compile(r"^[^\S\n]*([A-Za-z0-9+/_=-]+)[^\S\n]*$", re.M)
#: Share of its bytes that a novel string adds.
NOVEL = 0.7
#: Identifiers and words of code that explain a string; fixed values.
IDENTIFIERS = (
    "abstract async await boolean break class client config connection const context continue controller database default define delete "
    "environment error exception export extends false final float function global handler header import include instance integer interface "
    "iterator lambda length logger manager message method module namespace object option package parameter parser private process "
    "property protected provider public query request response result return schema secret server service session settings static "
    "string struct template token true undefined username value variable version void while yield "
    "get_user set_password access_token refresh_token client_secret client_id api_key private_key public_key authorization bearer basic "
    "http https www com org net localhost example test sample placeholder changeme your_api_key_here "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 aaaaaaaaaaaaaaaa xxxxxxxxxxxxxxxx 0000000000000000"
)


@lru_cache(maxsize=1)
def _compressor():
    import zstandard

    known = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_checksum=False)


def before(text: str, start: int, string: str) -> str:
    """The AROUND code points before start without copies of string, also of one that they hold the end of."""
    at = max(0, start - AROUND)
    low = max(0, at - len(string) + 1)
    first, *rest = text[low:start].split(string)
    # shorter than what precedes the window: a copy reaches into it
    return first[at - low :] + "".join(rest)


def after(text: str, end: int, string: str) -> str:
    """The AROUND code points after end without copies of string, also of one that they hold the beginning of."""
    high = min(len(text), end + AROUND + len(string) - 1)
    *rest, last = text[end:high].split(string)
    return "".join(rest) + last[: max(0, len(last) - max(0, high - end - AROUND))]


def novelty(text: str, start: int, end: int) -> float:
    """Share of its own bytes that text[start:end] adds to its surroundings, its copies cut out, when compressed after them."""
    size = _compressor().compress
    string = text[start:end].encode()
    around = (before(text, start, text[start:end]) + "\n" + after(text, end, text[start:end]) + "\n").encode()
    return (len(size(around + string)) - len(size(around))) / max(1, len(string))


class Taken:
    """Spans that stand already; asked by overlap."""

    def __init__(self, spans: Sequence[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a


def candidates(text: str) -> Iterator[list[tuple[int, int]]]:
    """Each long string's stretches in the order in which they count: after each sensitive word in it, before the first, and whole."""
    for run in CANDIDATE.finditer(text):
        a, b = run.span()
        words = [w.span() for w in NEAR.finditer(text, a, b)]
        # a word of two parts, such as "access key", ends in the string but begins before it
        words += [w.span() for w in NEAR.finditer(text, max(0, a - 16), min(len(text), b)) if w.start() < a < w.end()]
        stretches = [(end, b) for _, end in sorted(words)]
        if words:
            stretches.append((a, min(words)[0]))
        yield [(x, y) for x, y in [*stretches, (a, b)] if y - x >= LEAST]


def scan(text: str) -> list[tuple[str, int, int, float]]:
    """kind, start, end and novelty of all spans."""
    found, lowered = [], None
    lowered = text.lower()
    near = any(w in lowered for w in SENSITIVE)
    if near and any(w in lowered for w in ASSIGNED):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    spans = [(k, a, b, novelty(text, a, b)) for k, a, b in found]
    if near:
        base, novel = Taken([(a, b) for _, a, b in found]), []
        for stretches in candidates(text):
            own = []
            for a, b in stretches:
                if not base.meets(a, b) and not any(x < b and a < y for x, y in own) and novelty(text, a, b) >= NOVEL:
                    own.append((a, b))
            novel += own
        novel += copies(text, novel, found)
        novel += key_lines(text, [*novel, *((a, b) for _, a, b in found)])
        spans += [("novel", a, b, novelty(text, a, b)) for a, b in novel]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def copies(text: str, novel: Sequence[tuple[int, int]], found: Sequence[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The other places of novel strings, from the left and the longest first, that no span meets yet."""
    heads: dict[str, list[str]] = {}
    for string in sorted({text[a:b] for a, b in novel}, key=len, reverse=True):
        heads.setdefault(string[:LEAST], []).append(string)
    out, end, taken = [], 0, Taken([*novel, *((a, b) for _, a, b in found)])
    for run in CANDIDATE.finditer(text) if heads else ():
        for a in range(run.start(), run.end() - LEAST + 1):
            for string in heads.get(text[a : a + LEAST], ()):
                b = a + len(string)
                if a >= end and text.startswith(string, a) and not taken.meets(a, b):
                    out.append((a, end := b))
    return out


def key_lines(text: str, spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """The lines of private keys' blocks that no span meets, where some line of the block is met."""
    if "-----BEGIN " not in text:
        return []
    taken, out = Taken(spans), []
    for block in BLOCK.finditer(text):
        if taken.meets(*block.span("body")):
            out += [m.span(1) for m in KEY_LINE.finditer(text, *block.span("body")) if not taken.meets(*m.span(1))]
    return out


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("novelty", DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))


def _scanner():
    return lambda texts: [pa.array([[{"kind": k, "start": a, "end": b, "novelty": n} for k, a, b, n in scan(t)] if t else [] for t in texts], _ARROW)]


def scan_texts(df: DataFrame, text: str = "text", keep: Sequence[str | tuple[str, Column]] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and the spans (kind, start, end, novelty) of each whole text."""
    return map_texts(df, text, keep, [("spans", SPANS)], _scanner)


def redacted(text: str, spans: Sequence[tuple[int, int]], label: str) -> str:
    """text with each span, overlapping ones together, replaced by label."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], label]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redactor(label: str):
    def clean(t):
        return t if t is None else redacted(t, [(a, b) for _, a, b, _ in scan(t)], label)

    return lambda texts: [pa.array([clean(t) for t in texts], pa.string())]


def redact_texts(df: DataFrame, text: str = "text", keep: Sequence[str | tuple[str, Column]] = ("doc_id",), label: str = "[secret]") -> DataFrame:
    """Columns `keep` and each whole text without its secrets (`redacted`). A null text stays null."""
    return map_texts(df, text, keep, [("redacted", StringType())], _redactor, label)


def joined_spans(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
