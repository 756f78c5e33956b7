"""The n-gram join against brute force, components, and the pipeline against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartulary.llm import bpe_tree, language_profiles, ngram_join, secret_scan, source_mix
from cartulary.llm.components import connected
from tests.llm.test_texts import SYLLABLES, prose


def shingles(text, n=5):
    w = text.encode().lower().split() if text else []
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def plain_components(rows, over=3, under=4, n=5, with_links=False):
    """(id, text) -> {id: (size, component)}, or with the number of links; ids are unique."""
    sets = {i: shingles(t, n) for i, t in rows}
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) * under >= over * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
                links[i] += 1
                links[j] += 1
    return {i: (len(s), find(i), *[links[i]] * with_links) for i, s in sets.items()}


def corpus(seed, n):
    """Texts with exact and near copies, chains of edits, shared passages, short ones and none."""
    rng = random.Random(seed)
    passage = prose(rng, SYLLABLES["aa"], 60)
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3 or not texts:
            t = prose(rng, SYLLABLES["aa"] + SYLLABLES["bb"], rng.randint(1, 120))
        elif kind < 0.4:
            t = rng.choice(texts)
        elif kind < 0.75:
            w = (rng.choice(texts) or "x").split() or ["x"]
            for _ in range(rng.randint(1, max(1, len(w) // 15))):
                w[rng.randrange(len(w))] = rng.choice(["NEW", "ka", "to"])
            t = rng.choice([" ", "\n", "\t "]).join(w)
        elif kind < 0.9:
            t = passage + " " + prose(rng, SYLLABLES["cc"], rng.randint(1, 40))
        else:
            t = rng.choice(["", " \n", None, "one", "One", "two three", "Two\u00a0three"])
        texts.append(t)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed, 160)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, component_id int, digest string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in ngram_join.components(df, with_links=True).collect()}
    assert got == plain_components(rows, with_links=True)


def test_other_shingles_and_similarity(spark):
    rows = corpus(9, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in ngram_join.components(df, n=3, similarity=(9, 10), with_links=True).collect()}
    assert got == plain_components(rows, 9, 10, 3, True)
    alike = {r.doc_id: tuple(r)[1:] for r in ngram_join.components(df, similarity=(1, 1), with_links=True).collect()}
    assert alike == plain_components(rows, 1, 1, 5, True)


def test_small_blocks_and_ranges_give_the_same(spark, monkeypatch):
    rows = corpus(11, 120)
    for name, value in (("RANGE_SHINGLES", 50), ("CHUNK_SETS", 3), ("CHUNK_SHINGLES", 200), ("COMPARED", 7)):
        monkeypatch.setattr(ngram_join, name, value)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: tuple(r)[1:] for r in ngram_join.components(df, with_links=True).collect()}
    assert got == plain_components(rows, with_links=True)


def test_a_line_that_is_in_all_documents(spark):
    rng = random.Random(15)
    line = prose(rng, SYLLABLES["cc"], 30)
    rows = [(k, prose(rng, SYLLABLES["aa"] + SYLLABLES["bb"], rng.randint(1, 60)) + "\n" + line) for k in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id: tuple(r)[1:] for r in ngram_join.components(df, with_links=True).collect()}
    assert got == plain_components(rows, with_links=True)


def test_a_large_group_of_near_copies_and_one_of_copies(spark):
    rng = random.Random(12)
    base = prose(rng, SYLLABLES["bb"], 150).split()
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"edit{k}"
        rows.append((k, " ".join(w)))
    rows += [(k, "the same text of a good many words in all of these") for k in range(300, 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in ngram_join.components(df, with_links=True).collect()}
    want = plain_components(rows[:301], with_links=True)
    assert all(got[i] == want[i][1:] for i in range(300)) and {got[k] for k in range(300, 600)} == {(300, 299)}


def test_pair_edge_cases(spark):
    rows = [(None, "a b c d e f"), (2, "A B C D E F"), (2, "A B C D E F"), (None, None), (3, None), (4, ""), (5, "word " * 50_000), (6, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.components(df, with_links=True).collect()]))
    assert got == sorted(map(str, [(None, 2, 2, 2), (2, 2, 2, 2), (2, 2, 2, 2), (None, 0, None, 0), (3, 0, 3, 0), (4, 0, 4, 0), (5, 1, 5, 1), (6, 1, 5, 1)]))
    assert ngram_join.components(df.limit(0)).count() == 0
    tagged = df.withColumn("Stays", F.lit(1)).union(df.filter("doc_id = 2").withColumn("Stays", F.lit(0))).withColumn("row", F.create_map(F.lit("a"), "Stays"))
    kept = ngram_join.keep_one(tagged, ngram_join.components(df))
    assert kept.columns == ["doc_id", "text", "Stays", "row"]
    assert sorted(f"{r.doc_id} {r.Stays} {r.row}" for r in kept.collect()) == ["2 0 {'a': 0}", *(f"{k} 1 {{'a': 1}}" for k in ("3", "4", "5", "None", "None"))]


def test_components_of_long_chains(spark):
    n = 200
    links = spark.createDataFrame([(k + 1, k) for k in range(n)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in connected(links)[0].collect()}
    assert got == {k: 0 for k in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_pipeline_equals_a_plain_one(spark, tmp_path):
    rng = random.Random(13)
    rows = [(i, t, "en" if k % 2 else "de", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(corpus(14, 120))]
    rows += [(900, "12 34 !!", "en", "src0", 8), (901, prose(rng, SYLLABLES["aa"], 20) + " password=b7db7aa4a5fcc78305", "en", "src1", 60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.source, r.n_tokens, r.round_trip) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    prototypes = language_profiles.fit(df)
    scored = {r.doc_id: (r.lang_pred, r.score) for r in language_profiles.predict(df, prototypes).collect()}
    kept = [r for r in rows if scored[r[0]][0] != "und" and scored[r[0]][1] >= corpus_pipeline.LEAST_SCORE]
    assert {900} <= {r[0] for r in rows} - {r[0] for r in kept}
    comp = plain_components([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if comp[r[0]][1] == r[0]]
    kept = [(r[0], secret_scan.redacted(r[1], [(a, b) for _, a, b, _ in secret_scan.scan(r[1])], "[secret]"), *r[2:]) for r in kept]
    assert any("[secret]" in r[1] for r in kept)
    mixed = source_mix.replicate(spark.createDataFrame(kept, df.schema), corpus_pipeline.MIX_WEIGHTS, seed=corpus_pipeline.MIX_SEED).collect()
    import public_tokenizers as P

    c = bpe_tree.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert got == sorted((r.doc_id, r.source, len(c.encode(r.text)) // 4, True) for r in mixed)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "some plain words", "en", "src0", 16), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in df.schema], name
            out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, df.filter(F.col("text").isNotNull()), "").first().round_trip
