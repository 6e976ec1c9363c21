import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from locusframe.llm import token_orc

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
MEMO = token_orc.Encoder(PATH)


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    ids, sizes = encoder.batch(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.sampled_from(["<|startoftext|>", "<|endoftext|>", "it's", "I'LL", "é", "é", " ́", "\x85", " ", "\x1c", "x.", "a<|startoftext|>b", "İ", "Σ", "Été.", "NAÏVE,", "ÿ.,", "it.s", "WORD.", "ﬁ", "ſ", "K", "µ", "ß"])), max_size=8), st.sampled_from([" ", "\n", "", "  ", "\t"]))
def test_pieces_encode_as_whole_texts(parts, by):
    text = by.join(parts)
    assert MEMO.table is not None
    assert encoded(MEMO, [text, "next", text]) == [WHOLE.encode(t, add_special_tokens=False).ids for t in (text, "next", text)]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = token_orc.Encoder(path)
    assert encoder.table is None
    assert encoded(encoder, [" a b", ""])[0] == Tokenizer.from_file(path).encode(" a b", add_special_tokens=False).ids


def test_a_full_table_starts_again_and_a_batch_beyond_it_is_not_remembered(monkeypatch):
    monkeypatch.setattr(token_orc, "SLOTS", 64)
    monkeypatch.setattr(token_orc, "POOL", 256)
    encoder = token_orc.Encoder(PATH)
    for n in (5, 20, 31, 200, 3, 40, 33):
        texts = [f"the word w{i} of{i % 7} and, a-very-long-piece-of-text-{i}." for i in range(n)] + ["", " "]
        assert encoded(encoder, texts) == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]
        assert encoder.table.n <= 32 and len(encoder.table.slots) == 64


def test_round_trip(spark, tmp_path):
    rows = [(i, f"Text number {i}, it's " + "word " * (i % 7)) for i in range(50, 0, -1)] + [(60, None), (61, ""), (61, "twice"), (None, "no id"), (62, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "1 as at")
    path = str(tmp_path / "tokens")
    token_orc.write_tokens(df.repartition(5), path, tokenizer=PATH)
    stored = sorted(((r.doc_id, list(r.ids)) for r in token_orc.read_tokens(spark, path).collect()), key=str)
    want = sorted(((d, WHOLE.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows), key=str)
    assert stored == want
    got = token_orc.digest(spark, path).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(i), zlib.crc32(np.array(i, dtype="<u4").tobytes())) for d, i in want)
    at = 0
    ordered = sorted(got, key=lambda r: r.start)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)
    one = token_orc.read_tokens(spark, path).where("doc_id = 7")
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString() and one.count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_orc.tokenized(df, tokenizer=PATH).collect() == []
