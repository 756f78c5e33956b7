"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames.

frames_of() reads any GIF87a or GIF89a: it decodes each image's LZW codes, undoes interlacing,
composes it on the canvas by the transparency and the disposal of its control block, and
gives timed frames, one at a time. encode_gif() writes indexed frames losslessly. The text operators store
the bytes of a text as samples of such frames, one byte a sample (write_texts), and read a stored
column back (read_texts); read_frames gives the frames of any media column with their colour histograms.

Nulls count as empty text, whose payload is padding alone. Equal texts have equal media. A text of any length is stored
whole, in as many frames as it takes. Media that are null or no GIF have no frames, nor has a GIF whose header asks for a canvas of
more than MOST_PIXELS. A broken end gives the frames before it. Kept columns whose names are those of results give way. Empty tables give none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from cartulary.llm.common import col, map_texts, pieces_of, tidied, workers_import

#: A frame of samples is WIDTH wide and at most HIGHEST high; payloads are multiples of UNIT bytes.
WIDTH, UNIT, HIGHEST = 24, 576, 384
#: Hundredths of a second that a frame of samples stands.
DELAY = 4
GREY = bytes(v for k in range(256) for v in (k, k, k))
#: Pixels of the largest canvas that is made, whatever a header asks for.
MOST_PIXELS = 1 << 26


def code_widths(first: int, n: int, least: int) -> np.ndarray:
    """Bits of the n codes that follow a clear code; the table begins with `first` entries and gains one from the second code on."""
    size = first + np.maximum(0, np.arange(n) - 1)
    return np.clip(np.floor(np.log2(size)).astype(np.int64) + 1, least, 12)


_WIDTHS = {bits: code_widths((1 << bits) + 2, 4200, bits + 1) for bits in range(1, 9)}


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The LZW codes of samples, packed from the lowest bit; begins with a clear code and ends with the end code."""
    clear, end = 1 << bits, (1 << bits) + 1
    runs, codes, known, fresh = [[clear]], [], {}, end + 1
    limit, last = 4095 - end, None
    find, put = known.get, codes.append
    for s in samples:
        if last is None:
            last = s
            continue
        key = last << 8 | s
        if (code := find(key)) is not None:
            last = code
            continue
        put(last)
        known[key] = fresh
        fresh += 1
        last = s
        if len(codes) >= limit:
            codes.append(clear)
            runs.append(codes)
            codes, fresh = [], end + 1
            put = codes.append
            known.clear()
    if last is not None:
        codes.append(last)
    codes.append(end)
    runs.append(codes)
    table = _WIDTHS[bits]
    flat = np.array([c for r in runs for c in r], np.int64)
    widths = np.concatenate([table[:1], *(table[: len(r)] for r in runs[1:])])
    ends = np.cumsum(widths)
    starts = ends - widths
    shifted, at = flat << (starts & 7), starts >> 3
    size = int(ends[-1] + 7 >> 3)
    out = sum(np.bincount(at + k, (shifted >> 8 * k & 255).astype(np.float64), size + 3) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """The samples of an LZW stream, at most `most`; a damaged stream gives what precedes the damage. A full table is kept until a clear code comes."""
    clear, end = 1 << bits, (1 << bits) + 1
    table = _WIDTHS[bits]
    b = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int64)
    total, at, size, out, met, kept = 8 * len(data), 0, 0, [], 0, False
    basic = [bytes([k]) for k in range(clear)] + [b"", b""]
    while at < total and size < most:
        # the codes up to the next clear code: their widths are known before their values are
        widths = np.full(min(len(table), (total - at) // 12), 12) if kept else table[: min(len(table), (total - at) // (bits + 1) + 1)]
        starts = at + np.cumsum(widths) - widths
        widths, starts = widths[(inside := starts + widths <= total)], starts[inside]
        if not len(starts):
            break
        k = starts >> 3
        codes = (b[k] | b[k + 1] << 8 | b[k + 2] << 16) >> (starts & 7) & (1 << widths) - 1
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        if not kept:
            entries, before = basic.copy(), None
        add, put = entries.append, out.append
        for code in codes[:stop].tolist():
            if before is None:
                if code >= clear:
                    return b"".join(out)[:most]
                before = entries[code]
                put(before)
                continue
            if code < len(entries):
                entry = entries[code]
            elif code == len(entries) and len(entries) < 4096:
                entry = before + before[:1]
            else:
                return b"".join(out)[:most]
            put(entry)
            if len(entries) < 4096:
                add(before + entry[:1])
            before = entry
        if (kept := stop == len(codes)) is False and codes[stop] == end:
            break
        last = stop - kept
        at = int(starts[last] + widths[last])
        size, met = size + sum(map(len, out[met:])), len(out)
    return b"".join(out)[:most]


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(width: int, height: int, images: Sequence[tuple[int, int, bytes, int]], palette: bytes = GREY) -> bytes:
    """images: width, height, samples and delay (hundredths of a second) of each, drawn from the canvas's corner. Palettes hold 256 colours."""
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", palette]
    for w, h, samples, delay in images:
        out += [b"\x21\xf9\x04\x04", delay.to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", w.to_bytes(2, "little"), h.to_bytes(2, "little"), b"\0\x08", blocks(lzw_encode(samples))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """start, delay: hundredths of a second. box: left, top, width, height. indices: the image's own. canvas: RGBA after drawing, until the next frame is drawn on it."""

    start: int
    delay: int
    box: tuple[int, int, int, int]
    indices: np.ndarray
    canvas: np.ndarray


def decode_gif(data: bytes) -> list[Frame]:
    """All frames of a GIF, each with a canvas of its own."""
    return [replace(f, canvas=f.canvas.copy()) for f in frames_of(data)]


def frames_of(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in turn. Bytes that are no GIF give none; a broken end gives the frames before it."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return
    word = lambda at: data[at] | data[at + 1] << 8
    width, height, flags, at = word(6), word(8), data[10], 13

    def colours(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 3 << (flags & 7) + 1
        table = np.full((256, 4), 255, np.uint8)
        read = np.frombuffer(data[at : at + n - (len(data[at : at + n]) % 3)], np.uint8)
        read = read[: len(read) // 3 * 3].reshape(-1, 3)
        table[:, :3] = 0
        table[: len(read), :3] = read
        return table, at + n

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    common = None
    if flags & 128:
        common, at = colours(at, flags)
    if width * height > MOST_PIXELS:
        return
    canvas, start = np.zeros((height, width, 4), np.uint8), 0
    delay, disposal, clear_index = 0, 0, -1
    undo = None  # what the frame drawn last leaves behind when the next comes
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, after = joined(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear_index = body[3] if body[0] & 1 else -1
            at = after
            continue
        if data[at] != 0x2C or at + 11 > len(data):
            break
        left, top, w, h, local = word(at + 1), word(at + 3), word(at + 5), word(at + 7), data[at + 9]
        at += 10
        palette = common
        if local & 128:
            palette, at = colours(at, local)
        if at >= len(data) or not 1 <= (bits := data[at]) <= 8:
            break
        body, at = joined(at + 1)
        samples = np.frombuffer(lzw_decode(body, bits, w * h), np.uint8)
        if len(samples) < w * h:
            break
        image = samples.reshape(h, w)
        if local & 64:
            rows = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            plain = np.empty_like(image)
            plain[rows] = image
            image = plain
        if undo is not None:
            undo()
        seen = image[: max(0, height - top), : max(0, width - left)]
        box = (slice(top, top + seen.shape[0]), slice(left, left + seen.shape[1]))
        before = canvas[box].copy() if disposal == 3 else None
        drawn = (palette if palette is not None else np.zeros((256, 4), np.uint8))[seen]
        if clear_index >= 0:
            drawn = np.where((seen == clear_index)[..., None], canvas[box], drawn)
        canvas[box] = drawn
        yield Frame(start, delay, (left, top, w, h), image, canvas)
        undo = (lambda b=box: canvas.__setitem__(b, 0)) if disposal == 2 else (lambda b=box, v=before: canvas.__setitem__(b, v)) if disposal == 3 else None
        start += delay
        delay, disposal, clear_index = 0, 0, -1


def histogram(canvas: np.ndarray, bins: int = 8) -> np.ndarray:
    """Counts of pixels by bin for red, green and blue; pixels that show nothing don't count."""
    shown = canvas[canvas[..., 3] > 0][:, :3].astype(np.int64) * bins >> 8
    return np.bincount((shown + np.arange(3) * bins).ravel(), minlength=3 * bins)


def store_bytes(data: bytes) -> bytes:
    """The GIF whose samples are data, padded with 255 to a positive multiple of UNIT bytes."""
    data = data + b"\xff" * (-len(data) % UNIT if data else UNIT)
    step = WIDTH * HIGHEST
    images = [(WIDTH, len(x) // WIDTH, x, DELAY) for x in (data[i : i + step] for i in range(0, len(data), step))]
    return encode_gif(WIDTH, images[0][1], images)


def read_bytes(media: bytes) -> tuple[bytes, np.ndarray, int, int]:
    """The samples of all frames in turn, the sum of the frames' colour histograms, the number of frames and how long they stand."""
    out, total, end = [], np.zeros(24, np.int64), 0
    for f in frames_of(media):
        x, y, w, h = f.box
        shown = f.canvas[y : y + h, x : x + w]
        out.append(shown[..., 0].tobytes())
        total += histogram(shown)
        end = f.start + f.delay
    return b"".join(out), total, len(out), end


def feature(counts: np.ndarray) -> str:
    """Each bin's share of its channel in 255ths, as hex."""
    channels = counts.reshape(3, -1)
    whole = np.maximum(1, channels.sum(1, keepdims=True))
    return (channels * 255 // whole).astype(np.uint8).tobytes().hex()


def _stored():
    def compute(texts):
        rows = [(t or "").encode() for t in texts]
        return [pa.array(list(map(len, rows)), pa.int64()), pa.array(list(map(store_bytes, rows)), pa.binary())]

    return compute


def write_texts(df: DataFrame, text: str = "text", keep: Sequence[str | tuple[str, Column]] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, n_bytes and the stored form (`media`) of each whole text: the media column to be written."""
    return map_texts(df, text, keep, [("n_bytes", LongType()), ("media", BinaryType())], _stored)


#: What read_texts computes of a stored form, and its Arrow types.
READ = (("payload_bytes", LongType(), pa.int64()), ("payload_sha256", StringType(), pa.string()), ("tail_crc32", LongType(), pa.int64()), ("media_bytes", LongType(), pa.int64()), ("media_sha256", StringType(), pa.string()), ("feature", StringType(), pa.string()), ("n_frames", LongType(), pa.int64()), ("duration", LongType(), pa.int64()))


def _read(media: bytes) -> tuple:
    payload, counts, frames, end = read_bytes(media)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(counts), frames, end


def read_texts(df: DataFrame, media: str = "media", keep: Sequence[str] = ("doc_id", "n_bytes")) -> DataFrame:
    """Columns `keep`, then what each stored form gives when read back; null media count as no bytes."""
    workers_import(df.sparkSession)
    picked = df.select(*(col(k) for k in keep if k.lower() not in {n for n, _, _ in READ}), F.coalesce(col(media), F.lit(b"")).alias("__media"))
    schema = StructType([*picked.schema.fields[:-1], *(StructField(n, t) for n, t, _ in READ)])

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, batch.num_columns - 1):
                rows = list(map(_read, part.column(part.num_columns - 1).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array([r[k] for r in rows], t) for k, (_, _, t) in enumerate(READ))], names=schema.names)

    return picked.mapInArrow(tidied(run), schema)


#: A frame's columns and their Arrow types.
FRAME = (("frame", IntegerType(), pa.int32()), ("start", IntegerType(), pa.int32()), ("delay", IntegerType(), pa.int32()), ("width", IntegerType(), pa.int32()), ("height", IntegerType(), pa.int32()), ("rgba", BinaryType(), pa.binary()), ("histogram", ArrayType(LongType()), pa.list_(pa.int64())))


def read_frames(df: DataFrame, media: str = "media", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A row for each timed frame of each GIF: columns `keep`, frame (from 0), start and delay (hundredths of a second), and the composed canvas: width, height, rgba and histogram (eight bins of red, green and blue)."""
    workers_import(df.sparkSession)
    picked = df.select(*(col(k) for k in keep if k.lower() not in {n for n, _, _ in FRAME}), col(media).alias("__media"))
    schema = StructType([*picked.schema.fields[:-1], *(StructField(n, t) for n, t, _ in FRAME)])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                # a frame a batch: one canvas is held at a time
                for k, f in enumerate(frames_of(row.column(row.num_columns - 1)[0].as_py() or b"")):
                    values = (k, f.start, f.delay, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), histogram(f.canvas).tolist())
                    yield pa.RecordBatch.from_arrays([*row.columns[:-1], *(pa.array([v], t) for v, (_, _, t) in zip(values, FRAME, strict=True))], names=schema.names)

    return picked.mapInArrow(tidied(run), schema)
