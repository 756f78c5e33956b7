"""N-gram Jaccard join by rare-first prefixes.

Texts are lowered (A-Z) and split at ASCII white space; a document is the set of its n-word shingles,
or its whole sequence as one where it has fewer words. Sets of at least the given similarity
link; the result is each document's component, and with how many documents it links.

1. One pass over the texts hashes shingles (64 bits) and gives, for each block of documents,
   its tokens (shorter hashes) by ranges, packed: each token once, with the number of the block's sets
   that it stands in. Copies within a block are packed once. So a token that is in all documents is an entry a block, not one a document.
2. A range's task sums these over all blocks. Tokens of one set alone go no further; of the others
   the block gets token and count, and finds the sets that hold them in what it kept.
3. A set's tokens stand in one global order, rare first (count, then token). Its prefix is that many
   tokens that a set sharing none of them cannot reach the similarity. A set whose own
   tokens fill the prefix has no partner, and leaves no posting.
4. Sets that share a prefix token are candidates, if lengths, positions (own tokens never match)
   and suffixes (counts of shared tokens in 32 classes) allow the similarity. First each
   token's most central set is compared with the others; then, between components alone, all
   that remain. A pair is verified once, by its whole sets; no pair that could join two components is left out.
5. A link never leaves a component, so all links are those between the different sets of each, where counts
   of links are asked for. Components are dealt into bounded chunks of sets of near sizes; any two chunks
   whose sizes allow the similarity meet in one task, which counts shared shingles of all their pairs at once
   and gives a sum for each set. No pair is a row.

Equal sets are one node throughout, named by a 128-bit digest. Tokens that collide make more candidates,
never fewer; equality of 64-bit shingle hashes stands for equality of shingles.

Documents without words, and null texts, have no shingles, link with nothing and are their own
component. Copies link with each other. A text of any length is one set. Null ids stay null: a document without id is in a component named by the least id of
its others, or null. Repeated rows are kept and link as equal sets. Empty tables give none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, MapType, StructField, StructType

from cartulary.llm.common import ROWS, col, discard, free_name, give_back, stored, tidied, workers_import
from cartulary.llm.components import connected

#: Bounds of a block: shingles and documents. Shingles that a range's task counts, as expected.
BLOCK_SHINGLES, BLOCK_DOCUMENTS, RANGE_SHINGLES = 1 << 19, 4096, 750_000
#: Bits of a token within its range, of all, and of a document's place in its block.
LOW_BITS, MOST_BITS, PLACE_BITS = 28, 52, 12
#: Sets, and shingles of them, in a chunk of a component that links are counted in; shingles compared at once.
CHUNK_SETS, CHUNK_SHINGLES, COMPARED = 512, 1 << 19, 2048
#: Words that a worker remembers the hash of.
REMEMBERED = 100_000
#: Classes of the suffix filter; two counts to a long.
CLASSES = 32
#: Bits of the filter of ids, at most.
FILTER_BITS = 1 << 26
#: Digests with ids (under 100 bytes each) up to which every executor gets them; more are joined by a shuffle.
MOST_SENT = 100_000
MULTIPLIERS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93


class Words(dict):
    """Hashes of words met lately."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str | None, n: int, words: Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles."""
    split = text.encode().lower().split() if text else []
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    width = min(n, len(h))
    total = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        total = (total ^ total >> np.uint64(29)) * np.uint64(MULTIPLIERS[k % 4]) + h[k : len(h) - width + 1 + k]
    total ^= total >> np.uint64(32)
    total *= np.uint64(MULTIPLIERS[3])
    total ^= total >> np.uint64(29)
    return np.unique(total)


def set_digest(hashes: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed planes of bytes."""
    import zstandard

    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    import zstandard

    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _blocks(n: int, low_bits: int, range_bits: int, ident: pa.DataType, names: list[str]):
    """Rows of kind 0 (a document), 1 (a block's tokens of one range, each with its sets or the only one) and 2 (a block's tokens of several sets, with each set)."""
    shift = np.uint64(64 - low_bits - range_bits)

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, block = Words(), TaskContext.get().partitionId() << 32
        idents, sizes, digests, places, parts, seen, held = [], [], [], [], [], {}, 0

        def flush():
            nonlocal block, held
            if idents:
                m = len(idents)
                nothing = pa.nulls(m, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([0] * m, pa.int32()), pa.array([block] * m, pa.int64()), pa.array(places, pa.int32()), pa.array(idents, ident), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), nothing, nothing, pa.nulls(m, pa.binary())], names=names)
            if held:
                # one sort puts the entries in order of token and place
                entries = np.concatenate([(h >> shift) << np.uint64(PLACE_BITS) | np.uint64(p) for p, h in parts])
                entries.sort()
                tokens, place = entries >> np.uint64(PLACE_BITS), (entries & np.uint64((1 << PLACE_BITS) - 1)).astype(np.uint16)
                first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
                within = np.diff(np.append(first, len(tokens)))
                several = np.repeat(within > 1, within)
                shared = (np.diff(tokens[several], prepend=np.uint64(0)), place[several])
                # a token's place here is that of its only set
                tokens, place, within = tokens[first], place[first], within.astype(np.uint16)
                ranges = (tokens >> np.uint64(low_bits)).astype(np.int64)
                low = (tokens & np.uint64((1 << low_bits) - 1)).astype(np.uint32)
                starts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]]))
                ends = np.append(starts[1:], len(ranges))

                def rows_of(kind, range_, count, packed):
                    m = len(packed)
                    return pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.int32()), pa.array([block] * m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, ident), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(range_, pa.int32()), pa.array(count, pa.int32()), pa.array(packed, pa.binary())], names=names)

                for k in range(0, len(starts), ROWS):
                    s, e = starts[k : k + ROWS], ends[k : k + ROWS]
                    yield rows_of(1, ranges[s], e - s, [pack(np.diff(low[a:b], prepend=np.uint32(0)), place[a:b], within[a:b]) for a, b in zip(s.tolist(), e.tolist(), strict=True)])
                if several.any():
                    yield rows_of(2, [None], [len(shared[0])], [pack(*shared)])
            for x in (idents, sizes, digests, places, parts):
                x.clear()
            seen.clear()
            block, held = block + 1, 0

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                for i, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    h = shingle_hashes(t, n, words)
                    d = set_digest(h)
                    place = -1
                    if d is not None and d not in seen:
                        place = seen[d] = len(parts)
                        parts.append((place, h))
                        held += len(h)
                    idents.append(i)
                    sizes.append(len(h))
                    digests.append(d)
                    places.append(place)
                    if held >= BLOCK_SHINGLES or len(parts) >= BLOCK_DOCUMENTS or len(idents) >= 16 * BLOCK_DOCUMENTS:
                        yield from flush()
        yield from flush()

    return run


def _count_range(low_bits: int):
    """Of one range: each block's tokens that stand in several sets, with their counts, its only set, and its number of sets."""

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        low, place, within, owner = [], [], [], []
        for k, (n, data) in enumerate(zip(table.column("entries").to_pylist(), table.column("payload").to_pylist(), strict=True)):
            delta, p, w = unpack(data, n, "<u4", "<u2", "<u2")
            low.append(np.cumsum(delta, dtype=np.uint32))
            place.append(p)
            within.append(w)
            owner.append(np.full(n, k, np.int32))
        low, place, within, owner = map(np.concatenate, (low, place, within, owner))
        order = np.argsort(low, kind="stable")
        ranked = low[order]
        starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        counts = np.add.reduceat(within[order], starts, dtype=np.int64)
        count = np.empty(len(low), np.uint32)
        count[order] = np.repeat(np.minimum(counts, 2**32 - 1).astype(np.uint32), np.diff(np.append(starts, len(ranked))))
        keep = count > 1
        low, place, within, owner, count = low[keep], place[keep], within[keep], owner[keep], count[keep]
        token = np.uint64(table.column("range")[0].as_py()) << np.uint64(low_bits) | low.astype(np.uint64)
        # owners are in order: the pieces were joined in turn
        cuts = np.searchsorted(owner, np.arange(len(blocks) + 1))
        rows = [(int(blocks[k]), int(b - a), pack(token[a:b], count[a:b], place[a:b], within[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        give_back()
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "entries": pa.array([r[1] for r in rows], pa.int32()), "payload": pa.array([r[2] for r in rows], pa.binary())})

    return run


def prefix_sizes(n: np.ndarray, over: int, under: int) -> np.ndarray:
    """Tokens of a set of size n of which a set of similarity over / under or more shares one at least."""
    return n - (over * n + under - 1) // under + 1


def _entries(kept: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, counts and sets of a block, from what its ranges gave (kind 1) and what it kept of tokens of several sets (kind 2)."""
    shared = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32))]
    own = []
    for kind, n, data in zip(kept.column("kind").to_pylist(), kept.column("entries").to_pylist(), kept.column("payload").to_pylist(), strict=True):
        if kind == 1:
            token, count, place, within = unpack(data, n, "<u8", "<u4", "<u2", "<u2")
            one = within == 1
            yield token[one], count[one], place[one]
            shared.append((token[~one], count[~one]))
        else:
            delta, place = unpack(data, n, "<u8", "<u2")
            own.append((np.cumsum(delta, dtype=np.uint64), place))
    token, count = map(np.concatenate, zip(*shared, strict=True))
    order = np.argsort(token)
    for wanted, place in own:
        yield wanted, count[order[np.searchsorted(token, wanted, sorter=order)]], place


def _select_prefixes(over: int, under: int, names: list[str]):
    """Of one block: the prefix tokens of its sets that other sets have too."""

    def run(kept: pa.Table, documents: pa.Table) -> pa.Table:
        out = [pa.array([], t) for t in (pa.int64(), pa.binary(), *[pa.int64()] * (3 + CLASSES // 2))]
        place = documents.column("place").to_numpy() if len(documents) else np.zeros(0, np.int32)
        if len(kept) and len(place):
            pieces = [([], [], []), *_entries(kept)]
            token, count, owner = (np.concatenate(x).astype(t) for x, t in zip(zip(*pieces, strict=True), (np.uint64, np.uint32, np.uint16), strict=True))
            own = np.flatnonzero(place >= 0)
            sets = int(place.max()) + 1
            size = np.zeros(sets, np.int64)
            size[place[own]] = documents.column("n").to_numpy()[own]
            digests = np.empty(sets, object)
            digests[place[own]] = documents.column("digest").take(pa.array(own)).to_pylist()
            shared = np.bincount(owner, minlength=sets)
            alone = size - shared
            quota = prefix_sizes(size, over, under) - alone
            classes = np.bincount(owner.astype(np.int64) * CLASSES + (token & np.uint64(CLASSES - 1)).astype(np.int64), minlength=sets * CLASSES).reshape(sets, CLASSES)
            halves = classes[:, 0::2] | classes[:, 1::2] << 32
            order = np.lexsort((token, count, owner))
            token, owner = token[order], owner[order]
            first = np.cumsum(shared) - shared
            position = np.arange(len(token)) - first[owner]
            chosen = position < quota[owner]
            token, owner, position = token[chosen], owner[chosen], position[chosen]
            # a set's classes stand in its first row alone
            later = pa.array(np.concatenate([[False], owner[1:] == owner[:-1]]) if len(owner) else np.zeros(0, bool))
            out = [pa.array(token.astype(np.int64)), pa.array(digests[owner].tolist(), pa.binary()), pa.array(size[owner]), pa.array(alone[owner]), pa.array(position + alone[owner]), *(pc.if_else(later, pa.scalar(None, pa.int64()), pa.array(halves[owner, k])) for k in range(CLASSES // 2))]
        give_back()
        return pa.table(out, names=names)

    return run


def _sets(n: int, members: np.ndarray | None, bits: int):
    """The whole shingle set of each document whose id may be among the members."""

    def run(batches):
        words = Words()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            if members is not None:
                h = batch.column(2).to_numpy().astype(np.uint64)
                for turn in range(2):
                    at = h >> np.uint64(32 * turn) & np.uint64(bits - 1)
                    keep &= (members[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                keep |= np.asarray(batch.column(0).is_null())
            batch = batch.filter(pa.array(keep))
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                hashes = [shingle_hashes(t, n, words) for t in piece.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, hashes)])
                values = np.concatenate([*hashes, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([set_digest(h) for h in hashes], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["ident", "digest", "shingles"])

    return run


def _needed(over: int, under: int, a: Column, b: Column) -> Column:
    """Overlap times (over + under) that two sizes need for the similarity: overlap * (over + under) >= over * (a + b)."""
    return F.lit(over) * (a + b)


def _may_link(over: int, under: int, x: str, y: str) -> Column:
    """Length and positional filters at a shared prefix token of the rows x and y."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    i, j = F.col(f"{x}.position"), F.col(f"{y}.position")
    most = F.least(i - F.col(f"{x}.alone"), j - F.col(f"{y}.alone")) + 1 + F.least(n - i - 1, m - j - 1)
    return (F.least(n, m) * under >= F.greatest(n, m) * over) & (most * (over + under) >= _needed(over, under, n, m))


def _suffixes_may(over: int, under: int, x: str, y: str) -> Column:
    """Suffix filter: shared tokens can only meet within their class."""
    total = None
    for k in range(CLASSES // 2):
        a, b = F.col(f"{x}.c{k}"), F.col(f"{y}.c{k}")
        low = F.lit(0xFFFFFFFF)
        both = F.least(a.bitwiseAND(low), b.bitwiseAND(low)) + F.least(F.shiftright(a, 32), F.shiftright(b, 32))
        total = both if total is None else total + both
    return total * (over + under) >= _needed(over, under, F.col(f"{x}.n"), F.col(f"{y}.n"))


def _verified(pairs: DataFrame, sets: DataFrame, over: int, under: int) -> DataFrame:
    """Pairs (a, b) whose whole sets have the similarity."""
    left = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    met = pairs.join(left, "a").join(right, "b")
    return met.filter(common * (over + under) >= _needed(over, under, F.size("sa").cast("long"), F.size("sb").cast("long"))).select("a", "b")


def _links_of(sets: list[np.ndarray], sizes: np.ndarray, copies: np.ndarray, over: int, under: int, second: np.ndarray) -> np.ndarray:
    """For each set, with how many documents of other sets it links, by the counts of shingles that any two share.

    second: which sets stand on the second of two sides. Pairs are met across the sides, or all if there is one.
    """
    m = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], (np.cumsum(new & shared) - 1)[shared]
    common = np.zeros((m, m), np.float32)  # whole numbers up to the largest shared count of COMPARED, summed below 2**24
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COMPARED):
        a, b = np.searchsorted(column, (at, at + COMPARED))
        has = np.zeros((m, COMPARED), np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        common += has @ has.T
    linked = common.astype(np.int64) * (over + under) >= over * (sizes[:, None] + sizes)
    np.fill_diagonal(linked, False)
    if second.any():
        linked &= second[:, None] != second
    return linked @ copies


def _count_links(over: int, under: int):
    """Of chunks that meet (unit; rows by root, second, digest, copies, shingles): links of each set."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("root")
        roots = pc.rank(table.column("root"), tiebreaker="dense").to_numpy() if len(table) else np.zeros(0, np.int64)
        shingles, sizes = table.column("shingles").combine_chunks(), pc.list_value_length(table.column("shingles")).to_numpy().astype(np.int64)
        values, ends = np.asarray(pc.list_flatten(shingles)), np.cumsum(sizes)
        copies, second = table.column("copies").to_numpy().astype(np.int64), table.column("second").to_numpy().astype(bool)
        out = np.zeros(len(table), np.int64)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], roots[1:] != roots[:-1]])), len(roots))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out[a:b] = _links_of([values[e - s : e] for e, s in zip(ends[a:b].tolist(), sizes[a:b].tolist(), strict=True)], sizes[a:b], copies[a:b], over, under, second[a:b])
        give_back()
        return pa.table({"digest": table.column("digest"), "links": pa.array(out)})

    return run


def link_counts(members: DataFrame, over: int, under: int) -> DataFrame:
    """digest and links: with how many documents of other sets each set links. members: digest, root, copies, shingles; one row a set."""
    spark = members.sparkSession
    # sets of one size class, or of two that follow each other, may link
    size = F.size("shingles").cast("long")
    sized, sized_at = stored(members.withColumn("bucket", F.floor(F.log(size.cast("double")) / math.log(under / over) + 1e-9).cast("int") if over < under else size), "members")
    per_bucket, buckets_at = stored(sized.groupBy("root", "bucket").agg(F.count("*").alias("sets"), F.sum(F.size("shingles").cast("long")).alias("shingles")), "buckets")
    per_root = per_bucket.groupBy("root").agg(F.sum("sets").alias("sets"), F.sum("shingles").alias("shingles"))
    small = (F.col("sets") <= CHUNK_SETS) & (F.col("shingles") <= CHUNK_SHINGLES)
    volume = per_root.filter(small).agg(F.sum("shingles")).first()[0] or 0
    common = ["root", "second", "digest", "copies", "shingles"]
    # many small components to a task
    whole = sized.join(per_root.filter(small).select("root"), "root", "left_semi").withColumn("second", F.lit(False))
    whole = whole.select(F.concat(F.lit("small "), F.pmod(F.xxhash64("root"), F.lit(volume // CHUNK_SHINGLES + 1)).cast("string")).alias("unit"), *common)
    chunks = per_bucket.join(per_root.filter(~small).select("root"), "root", "left_semi").select("root", "bucket", F.greatest(F.ceil(F.col("sets") / CHUNK_SETS), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int").alias("k"))
    of = lambda step, name: chunks.select("root", (F.col("bucket") - step).alias("bucket"), F.col("k").alias(name))
    met = chunks.join(of(1, "after"), ["root", "bucket"], "left").join(of(-1, "before"), ["root", "bucket"], "left")
    rows = sized.join(met, ["root", "bucket"]).withColumn("salt", F.pmod(F.xxhash64("digest"), F.col("k")).cast("int"))
    turns = lambda k, make: F.when(k.isNotNull(), F.transform(F.sequence(F.lit(0), k - 1), make)).otherwise(F.array())
    name = lambda b, x, c, y: F.concat_ws(" ", F.hex("root"), b.cast("string"), x.cast("string"), c.cast("string"), y.cast("string"))
    b, salt = F.col("bucket"), F.col("salt")
    own = turns(F.col("k"), lambda y: F.struct(name(b, F.least(salt, y), b, F.greatest(salt, y)).alias("unit"), (salt > y).alias("second")))
    up = turns(F.col("after"), lambda y: F.struct(name(b, salt, b + 1, y).alias("unit"), F.lit(False).alias("second")))
    down = turns(F.col("before"), lambda y: F.struct(name(b - 1, y, b, salt).alias("unit"), F.lit(True).alias("second")))
    large = rows.withColumn("at", F.explode(F.concat(own, up, down))).select("at.unit", "root", "at.second", "digest", "copies", "shingles")
    counted = whole.unionByName(large).groupBy("unit").applyInArrow(_count_links(over, under), "digest binary, links long")
    links, _ = stored(counted.groupBy("digest").agg(F.sum("links").alias("links")), "link-counts")
    discard(spark, sized_at, buckets_at)
    return links


def components(df: DataFrame, n: int = 5, similarity: tuple[int, int] = (3, 4), ident: str = "doc_id", text: str = "text", with_links: bool = False) -> DataFrame:
    """ident, n_shingles and component_id (the smallest ident reachable by links, itself included) of each row; n_links (documents it links with) if asked for.

    similarity: numerator and denominator.
    """
    over, under = similarity
    spark = df.sparkSession
    workers_import(spark)
    rows = df.select(col(ident).alias("ident"), col(text).cast("string").alias("text"))
    kind = rows.schema["ident"].dataType
    # a word has a letter and a space at least, seldom under six bytes on average
    volume = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    range_bits = min(MOST_BITS - LOW_BITS, max(0, math.ceil(math.log2(max(1, volume / RANGE_SHINGLES)))))
    schema = StructType([StructField(x, t) for x, t in (("kind", IntegerType()), ("block", LongType()), ("place", IntegerType()), ("ident", kind), ("n", LongType()), ("digest", BinaryType()), ("range", IntegerType()), ("entries", IntegerType()), ("payload", BinaryType()))])
    from pyspark.sql.pandas.types import to_arrow_type

    first = rows.mapInArrow(tidied(_blocks(n, LOW_BITS, range_bits, to_arrow_type(kind), schema.names)), schema)
    packed, packed_at = stored(first, "blocks", partition_by="kind")
    documents = packed.filter("kind = 0").select("block", "place", "ident", "n", "digest")

    counted = packed.filter("kind = 1").select("range", "block", "entries", "payload").groupBy("range").applyInArrow(_count_range(LOW_BITS), "block long, entries int, payload binary")
    counted = counted.withColumn("kind", F.lit(1)).unionByName(packed.filter("kind = 2").select("block", "entries", "payload", F.col("kind").cast("int").alias("kind")))
    classes = [f"c{k}" for k in range(CLASSES // 2)]
    names = ["token", "digest", "n", "alone", "position", *classes]
    picked = counted.groupBy("block").cogroup(documents.filter("place >= 0").select("block", "place", "n", "digest").groupBy("block")).applyInArrow(_select_prefixes(over, under, names), "token long, digest binary, n long, alone long, position long, " + ", ".join(f"{c} long" for c in classes))
    picked, picked_at = stored(picked, "prefixes")
    discard(spark, f"{packed_at}/kind=1", f"{packed_at}/kind=2")
    # copies in other blocks give the same rows
    postings, postings_at = stored(picked.select(*names[:5]).distinct(), "postings")
    nodes_classes = picked.filter("c0 is not null").select("digest", *classes).dropDuplicates(["digest"])

    # the whole sets of the documents that have postings, each from its least id
    several = postings.select("digest").distinct()
    least = documents.filter("digest is not null").groupBy("digest").agg(F.min("ident").alias("ident"), F.count("*").alias("copies"))
    chosen, chosen_at = stored(several.join(least.drop("copies"), "digest"), "chosen")
    hashed = rows.select("ident", "text", F.xxhash64("ident").alias("h"))
    count = chosen.count()
    bits = min(FILTER_BITS, 1 << max(10, (16 * count).bit_length()))
    at = F.explode(F.array(*(F.shiftrightunsigned(F.xxhash64("ident"), 32 * turn).bitwiseAND(F.lit(bits - 1)) for turn in range(2))))
    # FILTER_BITS / 64 longs at most
    filled = chosen.filter("ident is not null").select(at.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("value"))
    members = np.zeros(bits // 64, np.uint64)
    for r in filled.toLocalIterator():
        members[r["word"]] = r["value"] & 0xFFFFFFFFFFFFFFFF
    whole = hashed.mapInArrow(tidied(_sets(n, members, bits)), StructType([StructField("ident", kind), StructField("digest", BinaryType()), StructField("shingles", ArrayType(LongType()))]))
    sought = F.broadcast(chosen) if count <= MOST_SENT else chosen
    whole = whole.filter("digest is not null").alias("w").join(sought.alias("c"), F.col("w.digest").eqNullSafe(F.col("c.digest")) & F.col("w.ident").eqNullSafe(F.col("c.ident")), "left_semi")
    # a row that repeats id and text gives its set again, and with it links that are made distinct later
    sets, sets_at = stored(whole.select("digest", "shingles"), "sets")

    # the most central set of each token against the token's others
    centre = F.max(F.struct((F.col("n") - F.col("alone")).alias("shared"), "digest", "n", "alone", "position"))
    hubs = postings.groupBy("token").agg(centre.alias("hub"), F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least <> most")
    hubs, hubs_at = stored(hubs.select("token", "hub.digest", "hub.n", "hub.alone", "hub.position"), "hubs")
    pair = (F.least("x.digest", "y.digest").alias("a"), F.greatest("x.digest", "y.digest").alias("b"))
    spokes = postings.alias("x").join(hubs.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.digest") != F.col("y.digest")) & _may_link(over, under, "x", "y")).select(*pair).distinct()
    spokes, spokes_at = stored(spokes, "spokes")
    links, links_at = stored(_verified(spokes, sets, over, under), "links")
    roots, roots_at = connected(links)

    # what is left between components
    joined = postings.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    joined, joined_at = stored(joined, "rooted")
    mixed = joined.groupBy("token").agg(F.max(F.struct((F.col("n") - F.col("alone")).alias("shared"), "digest", "root")).alias("hub"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most")
    mixed, mixed_at = stored(mixed.select(F.col("token"), F.col("hub.root").alias("main")), "mixed")
    open_rows = joined.join(mixed, "token")
    # of the sets that are met again alone
    open_rows, open_at = stored(open_rows, "open")
    classed, classed_at = stored(open_rows.join(nodes_classes, "digest"), "classed")
    x, y = classed.filter("root <> main").alias("x"), classed.alias("y")
    once = (F.col("y.root") == F.col("y.main")) | (F.col("x.digest") < F.col("y.digest"))
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & once & _may_link(over, under, "x", "y") & _suffixes_may(over, under, "x", "y")).select(*pair).distinct()
    rest, rest_at = stored(rest.join(spokes, ["a", "b"], "left_anti"), "rest")
    more, more_at = stored(_verified(rest, sets, over, under), "links")
    if more.head(1):
        final, final_at = connected(links.union(more))
    else:
        final, final_at = roots, roots_at

    # equal sets are one node: its least id, then the least of its component
    nodes, nodes_at = stored(least.join(final.select(F.col("node").alias("digest"), "root"), "digest", "left").select("digest", "ident", "copies", F.coalesce("root", "digest").alias("root")), "nodes")
    named = nodes.groupBy("root").agg(F.min("ident").alias("component_id"))
    if with_links:
        members = nodes.join(final.select(F.col("node").alias("digest")), "digest", "left_semi").select("digest", "root", "copies").join(sets.dropDuplicates(["digest"]), "digest")
        nodes_linked = nodes.join(link_counts(members, over, under), "digest", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    else:
        nodes_linked = nodes.withColumn("n_links", F.lit(None).cast("long"))
    names_of, _ = stored(nodes_linked.select("digest", "root", "n_links").join(named, "root").select("digest", "component_id", "n_links"), "components")
    gone = [picked_at, classed_at, postings_at, chosen_at, sets_at, hubs_at, spokes_at, links_at, joined_at, mixed_at, open_at, rest_at, more_at, nodes_at, roots_at, final_at]
    discard(spark, *dict.fromkeys(gone))
    result = documents.join(names_of, "digest", "left")
    links = [F.coalesce("n_links", F.lit(0)).alias("n_links")] * with_links
    return result.select(F.col("ident").alias(ident), F.col("n").alias("n_shingles"), F.coalesce("component_id", "ident").alias("component_id"), *links)


def keep_one(df: DataFrame, classes: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id; of rows that repeat its id and text, that whose other columns come first in order.

    Documents without id stay. Columns are those of df.
    """
    stays = free_name(df, "stays")
    stay = classes.filter(col(ident) == F.col("component_id")).select(col(ident).alias(stays)).distinct()
    others = [c for c in df.columns if c not in (ident, text)]
    ranked = F.struct(F.lit(0), *(F.to_json(col(c)) if isinstance(df.schema[c].dataType, MapType) else col(c) for c in others))
    row = free_name(df, "row")
    first = df.join(stay, col(ident) == F.col(stays), "left_semi").groupBy(col(ident), col(text)).agg(F.min_by(F.struct(F.lit(0).alias("_"), *map(col, others)), ranked).alias(row))
    named = first.select(*(col(c) if c in (ident, text) else F.col(row)[c].alias(c) for c in df.columns))
    return named.unionByName(df.filter(col(ident).isNull()))
