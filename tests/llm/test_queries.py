"""The registered queries of the training-data operators: columns, folds and digests against plain versions, and their SQL."""

import base64
import hashlib
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from cartulary.llm import gif_media, language_profiles, quartile_digest, queries, secret_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def found(spark, name, columns):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert set(columns) <= set(rows[0].asDict())
    assert len({r[0] for r in rows}) == len(rows)
    return {r.doc_id: r for r in rows}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, documents):
    got = found(spark, "op1_language_profiles", ("doc_id", "held_out", "lang_pred", "score"))
    assert set(got) == set(documents)
    known = {r.lang for i, r in documents.items() if r.lang and zlib.crc32(str(i).encode()) % 4 != 2}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in known | {language_profiles.UND}
        assert (r.lang_pred == language_profiles.UND) == (not any(c.isalpha() for c in documents[i].text or ""))
    held = [i for i, r in got.items() if r.held_out and documents[i].lang and r.lang_pred != language_profiles.UND]
    assert sum(got[i].lang_pred == documents[i].lang for i in held) > 0.8 * len(held)


def test_op2(spark, documents):
    got = found(spark, "op2_secret_scan", ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"))
    for i, r in got.items():
        t = documents[i].text or ""
        base = [("assign", *m.span()) for m in secret_scan.ASSIGN.finditer(t) if len(m[2]) >= 8] + [("access", *m.span()) for m in secret_scan.ACCESS.finditer(t)] + [("hex", *m.span()) for m in secret_scan.HEX.finditer(t)]
        base.sort(key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        joined = [":".join(map(str, s)) for s in base]
        assert r.base_sha256 == sha(",".join(joined).encode()) and set(joined) <= set(r.spans.split(",")) | {""}


def test_op4_and_op7(spark, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in found(spark, "op4_bpe_tree", ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")).items():
        t = documents[i].text or ""
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.encode()))
    got, start, t = found(spark, "op7_token_files", ("doc_id", "start", "n_tokens", "ids_crc32")), 0, Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i in sorted(documents):
        ids = [*t.encode(documents[i].text or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i])[1:4] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op5(spark, documents):
    for i, r in found(spark, "op5_gif_media", ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")).items():
        data = (documents[i].text or "").encode()
        payload, media = data + b"\xff" * (-len(data) % 576 if data else 576), gif_media.store_bytes(data)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), sha(media)) and r.n_frames == -(-len(payload) // 9216)


def test_op8(spark, documents):
    got, order = found(spark, "op8_quartile_digest", ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")), sorted(documents)
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        t, after = documents[i].text or "", documents[j].text or ""
        changed = quartile_digest.edited(t, after)
        a, b, c = map(quartile_digest.digest, (t, changed, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(changed.encode()), a, b)
        assert (r.near_edited, r.near_next) == (quartile_digest.likeness(a, b), quartile_digest.likeness(a, c))


def test_op10(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for i, r in found(spark, "op10_piece_counts", ("doc_id", "n_bytes", "n_tokens", "over_limit")).items():
        n = len(library.encode(documents[i].text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((documents[i].text or "").encode()), n, n > 4096)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_says_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rows = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in rows.description]
    assert sorted(df.columns) == sorted(columns)
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in rows.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in sorted(columns)) for r in df.collect()), key=repr) == want


def test_a_text_of_20_mb_is_scanned():
    line = 'value = compute(first, second)  # secret words and https://example.org/path\n'
    text = line * (20_000_000 // len(line)) + "token = 'q8Zk2LmP0vXw9RtY7cBn'\n"
    spans = secret_scan.scan(text)
    assert [s[:3] for s in spans if s[0] == "assign"] == [("assign", m.start(), m.end()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 8]
