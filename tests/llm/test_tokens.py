"""BPE encoding and decoding, piece counts and token files against the libraries."""

import base64
import math
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import sentencepiece
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cartulary.llm import bpe_tree, piece_counts, token_files

SF = "/root/testdata/sf0.01"
BPE, PIECES, IDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
ODD = ["a", "e", "th", "er", "aaaa", "  ", "\n", "é", "ß", "日本", "😀", "123", "--", "==", "\x1c", "\x85", "\u200b", "\u00a0", "\u3000", " ", "'s", "ab" * 9, "0" * 20, "▁", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BPE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n, longest=80, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD[: rng.randint(2, len(ODD))]) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def unpack(packed):
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_encoded_as_by_the_library(text):
    c = bpe_tree.codec(BPE, P.PATTERN)
    global _ENC
    if "_ENC" not in globals():
        _ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    packed = c.encode(text)
    assert unpack(packed) == _ENC.encode_ordinary(text) and c.decode(packed) == text.encode()


def test_long_runs_and_odd_texts(library):
    c = bpe_tree.codec(BPE, P.PATTERN)
    for t in [*odd_texts(400), "a" * 30_001, "ab" * 9_000, "=" * 20_001, " " * 999, "aab" * 7_000]:
        assert unpack(c.encode(t)) == library.encode_ordinary(t)
        assert c.decode(c.encode(t)) == t.encode()


def test_joining_equals_encoding_the_whole():
    c, rng = bpe_tree.codec(BPE, P.PATTERN), random.Random(2)
    for _ in range(500):
        data = bytes(rng.choice(b"aabeth er\xc3\xa9") for _ in range(rng.randint(2, 60)))
        k = rng.randint(0, len(data))
        assert bpe_tree.joined(bpe_tree.merged(data[:k], c.ranks), bpe_tree.merged(data[k:], c.ranks), c.merger) == bpe_tree.merged(data, c.ranks)


def test_heap_and_list_merging_agree():
    c, rng = bpe_tree.codec(BPE, P.PATTERN), random.Random(4)
    for n in (65, 100, 300):
        data = bytes(rng.choice(b"abeth er") for _ in range(n))
        parts = [data[i : i + 1] for i in range(n)]
        while True:
            ranked = [(c.ranks.get(parts[i] + parts[i + 1], bpe_tree.NEVER), i) for i in range(len(parts) - 1)]
            best = min(ranked, default=(bpe_tree.NEVER, 0))
            if best[0] == bpe_tree.NEVER:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert bpe_tree.merged(data, c.ranks) == parts


EDGES = [(1, None), (2, ""), (3, "x" * 200_000), (4, "same"), (4, "same"), (None, "no id"), (5, "two\nlines é 😀")]


def edge_table(spark, rows=EDGES):
    return spark.createDataFrame([(i, t, f"tok{k}", 7, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, ids string, n_tokens int, __text string")


def test_bpe_operator_on_edge_cases(spark, library):
    got = bpe_tree.round_trip(edge_table(spark), BPE, P.PATTERN).collect()
    assert sorted(map(str, [(r.doc_id, r.n_tokens, bytes(r.decoded)) for r in got])) == sorted(map(str, [(i, len(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in EDGES]))
    ids = bpe_tree.encode(edge_table(spark), BPE, P.PATTERN).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in ids) == sorted((str(i), library.encode_ordinary(t or "")) for i, t in EDGES)
    assert bpe_tree.round_trip(edge_table(spark).limit(0), BPE, P.PATTERN).count() == 0


def test_piece_counts_equal_the_library(spark):
    sp, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_counts.counter(PIECES)
    for t in [*odd_texts(600), "a" * 5_000, " " * 300, "é" * 1_000]:
        assert (c.count(t) if t else 0) == len(sp.encode(t)), t[:50]
    got = piece_counts.count_tokens(edge_table(spark).drop("n_tokens"), PIECES, 4).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4) for i, t in EDGES]
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))
    assert piece_counts.count_tokens(edge_table(spark).drop("n_tokens").limit(0), PIECES, 4).count() == 0


def test_merge_count_is_symbols_less_merges():
    assert piece_counts.merge_count("▁ab", {"a": 0, "b": 0, "ab": -1, "▁": 0, "▁ab": -2}) == 1
    assert piece_counts.merge_count("aaaa", {"a": 0, "aa": 1}) == 2
    assert piece_counts.merge_count("é", {"a": 0}) == 2 and piece_counts.merge_count("é", {"a": 0}, False) == 1


def ids_round_trip(idents, ids):
    data = token_files.write_segment(7, idents, ids)
    ((part, i, sizes, flat),) = token_files.read_segments(data)
    assert part == 7 and i == idents and sizes.tolist() == list(map(len, ids)) and flat.tolist() == [x for d in ids for x in d.tolist()]
    return data


def test_segments_round_trip():
    rng = np.random.default_rng(0)
    ids_round_trip([], [])
    ids_round_trip([None], [np.zeros(0, np.uint16)])
    ids_round_trip([1, -5], [np.array([5], np.uint16), np.array([65535, 0] * 3000, np.uint16)])
    ids_round_trip([3], [rng.integers(0, 65536, 9_000).astype(np.uint16)])
    ids_round_trip([3], [np.full(20_000, 7, np.uint16)])
    ids_round_trip(list(range(50)), [rng.zipf(1.3, 400).clip(0, 65535).astype(np.uint16) for _ in range(50)])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=50), max_size=5))
def test_any_ids_round_trip(lists):
    ids_round_trip(list(range(len(lists))), [np.array(x, np.uint16) for x in lists])


def test_blocks_are_read_alone_and_checked(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(token_files, "BLOCK", 700)
    ids = rng.integers(0, 300, 2_000).astype(np.uint16)
    data = bytearray(ids_round_trip([1], [ids]))
    streams = [token_files.encode_block(ids[at : at + 700]) for at in (0, 700, 1400)]
    assert bytes(data).endswith(b"".join(x for s in streams for x in s) + b"\n")
    assert token_files.decode_block(streams[1], 700).tolist() == ids[700:1400].tolist()
    for at in (-20, -400, 60):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            list(token_files.read_segments(bytes(bad)))
    with pytest.raises(ValueError):
        list(token_files.read_segments(bytes(data[:-9])))


def test_many_lanes_and_stretches(monkeypatch):
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.zipf(1.2, 30_000).clip(0, 65535), np.tile(rng.integers(0, 65536, 500), 20)]).astype(np.uint16)
    monkeypatch.setattr(token_files, "COUNTED1", 6)  # counts give way
    streams = token_files.encode_block(ids)
    assert len(streams) == len(ids) // token_files.STRETCH
    assert token_files.decode_block(streams, len(ids)).tolist() == ids.tolist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_prediction_beats_order_0_and_a_general_compressor():
    texts = pq.read_table(f"{SF}/documents.parquet").sort_by("doc_id")["text"].to_pylist()
    ids = np.frombuffer(b"".join(x + b"\2\0" for x in token_files.encoder(IDS, P.PATTERN).encode([t or "" for t in texts])), "<u2")
    share = np.bincount(ids) / len(ids)
    order0 = -sum(p * math.log2(p) for p in share if p)
    general = 8 * len(zstandard.ZstdCompressor(level=3).compress(ids.tobytes())) / len(ids)
    ours = 8 * len(token_files.write_segment(0, [1], [ids])) / len(ids)
    assert ours < 6.6 < min(order0, general)


def test_many_texts_at_once_equal_the_library():
    parts = ["foo", "Foo", "été", "naïve", "\u01c5a", "\u0250b", "日本", "a1", "it's", "x'", "mail@a.b", " ", "  ", "\n", "\n\n", "\x85", "\u00a0", ",", "...", "$$$", '"', "_", "<|endoftext|>", "\0", "😀"]
    rng, library = random.Random(3), Tokenizer.from_file(IDS)
    texts = ["", *parts, *(rng.choice(["", " ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(1500))]
    e = token_files.Encoder(IDS, P.PATTERN)
    for _ in range(2):  # the second time from memory
        ids, sizes = e.encode_all(token_files.pa.array(texts), b"\2\0")
        want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_files_stand_by_their_place_not_their_name(spark):
    rows = spark.range(100_001).selectExpr("int(id) AS part", "id AS doc_id", "0L AS start", "id % 3 + 1 AS n_tokens", "0L AS ids_crc32")
    got = {r.doc_id: r.start for r in token_files.placed(rows).filter("doc_id >= 99998").collect()}
    before = sum(k % 3 + 1 for k in range(99_998))
    assert got == {99_998: before, 99_999: before + 3, 100_000: before + 4}


def test_ids_have_to_be_whole_numbers(spark, tmp_path):
    with pytest.raises(ValueError):
        token_files.write(spark.createDataFrame([("x", "y")], "doc_id string, text string"), str(tmp_path / "files"), IDS, P.PATTERN, 2)


def test_token_files_equal_the_library(spark, tmp_path):
    texts = [(i, t) for i, t in enumerate([*odd_texts(40), "x" * 30_000])] + [(None, None), (7, "again"), (7, "again"), (100, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, start int")
    token_files.write(df, str(tmp_path / "files"), IDS, P.PATTERN, 2)
    t = Tokenizer.from_file(IDS)
    want, at = [], 0
    for i, x in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] == "again", r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.placed(token_files.read(spark, str(tmp_path / "files"))).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    packed = token_files.read(spark, str(tmp_path / "files"), with_ids=True).collect()
    assert sum(len(r.packed_ids) for r in packed) == 2 * at


def test_token_files_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(df, str(tmp_path / "files"), IDS, P.PATTERN, 2)
    assert token_files.placed(token_files.read(spark, str(tmp_path / "files"))).count() == 0
