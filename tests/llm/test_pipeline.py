import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp

EN = "the quick brown fox jumps over the lazy dog and then they walked through this weather with others before night".split()
DE = "der schnelle braune fuchs springt über den faulen hund und dann gingen sie durch das wetter mit anderen nach hause".split()


def documents():
    r = random.Random(3)
    rows = [(i, " ".join(r.choice((EN, DE)[i % 2]) + str(r.randrange(40)) for _ in range(60)), ("en", "de")[i % 2], f"s{i % 4}") for i in range(40)]
    passage = " ".join(f"test{i} passage" for i in range(6))
    rows += [(100, rows[0][1], "en", "s0"), (101, rows[2][1] + " more", "en", "s9"), (102, f"{rows[4][1]} x {passage.upper()}, y", "en", "s1"), (103, "123 --- 456", None, None), (104, None, "de", "s2"), (105, "", "en", "s3"), (106, "ein kurzer text", "de", None)]
    return rows, passage


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, passage = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) as n_chars")
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "short one"), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def shingles(t, k=5):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_stages_against_brute_force(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    kept = cp.language(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    want = {d for d, r in rows.items() if r.text and any(c.isalpha() for c in r.text)}
    assert {r.doc_id for r in kept.collect()} == want

    once = cp.near_dedup(spark, kept, sf_dir)
    assert once.columns == docs.columns
    sets = {d: shingles(rows[d].text) for d in want}
    dup = {b for a in want for b in want if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    want -= dup
    assert dup and {r.doc_id for r in once.collect()} == want

    clean = cp.decontamination(spark, once, sf_dir)
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    assert left == {d for d in want if "TEST0 PASSAGE" not in rows[d].text}

    mixed = cp.mixing(spark, clean, sf_dir)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    assert {r.doc_id for r in got} <= left
    total = sum(len(rows[d].text.split()) for d in left)
    assert abs(sum(len(r.text.split()) for r in got) - 1.5 * total) <= 64 * 6
    for r in got:
        words = rows[r.doc_id].text.split()
        assert len(r.text.split()) <= len(words) and set(r.text.split()) <= set(words) and r.n_chars == len(r.text)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    digest = cp.token_files(spark, mixed, sf_dir).collect()
    brute = [(r.doc_id, tokenizer.encode(r.text, add_special_tokens=False).ids + [1]) for r in got]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in digest) == sorted((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in brute)


def test_run(spark, sf_dir):
    out = cp.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert rows and all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(rows, rows[1:]))
