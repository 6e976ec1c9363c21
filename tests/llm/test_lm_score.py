import time

import numpy as np
import pyarrow as pa

from locusframe.llm import lm_score as lm


def text(seed, n):
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        i = int(r.integers(0, 40))
        out += [f"a{i}", f"b{i}", f"c{i}"]  # the middle follows from both sides
    return " ".join(out)


def rows():
    return [(i, text(i, 80)) for i in range(60)]


def test_log_prob_is_a_distribution():
    net = lm.Network()
    context = np.arange(2 * lm.SIDE)[None, :].repeat(lm.CLASSES * lm.PER_CLASS, axis=0)
    total = np.exp(net.log_prob(context, np.arange(lm.CLASSES * lm.PER_CLASS)).astype(float)).sum()
    assert abs(total - 1) < 1e-4


def test_step_follows_the_gradient():
    rng = np.random.default_rng(1)
    net = lm.Network()
    context, target = rng.integers(0, 500, (64, 2 * lm.SIDE)), rng.integers(0, 500, 64)
    before = net.log_prob(context, target).mean()
    for _ in range(20):
        net.step(context, target, 0.2)
    assert net.log_prob(context, target).mean() > before + 0.1


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "EVERY", 1)
    monkeypatch.setattr(lm, "DOCS", 1)
    monkeypatch.setattr(lm, "STEP", 32)
    odd = [(900, None), (901, ""), (902, " \n"), (903, "x"), (3, rows()[3][1]), (None, "a1 b1 c1"), (904, "a1 " * 20_000)]
    r = np.random.default_rng(9)
    shuffled = [(800 + i, " ".join(r.permutation(text(i, 80).split()))) for i in range(5)]
    df = spark.createDataFrame(rows() + odd, "doc_id long, text string").selectExpr("*", "1 as pll")
    vocab, net = lm.train(df, rounds=6)
    got = {x.doc_id: x for x in lm.score(spark.createDataFrame(rows() + odd + shuffled, "doc_id long, text string"), model=(vocab, net)).collect()}
    assert len(got) == 72 - 1
    assert got[900].n_tokens == got[901].n_tokens == got[902].n_tokens == 0 and got[900].pll == 0 and got[900].perplexity is None
    assert got[904].n_tokens == 20_000 and got[903].n_tokens == 1
    ids = vocab.ids(lm.words_of(rows()[7][1]))
    brute = sum(float(net.log_prob(*lm.windows(ids, i, i + 1))[0]) for i in range(len(ids)))
    assert abs(brute - got[7].pll) < 1e-3 * abs(brute)
    assert np.mean([got[i].pll_per_token for i in range(60)]) > np.mean([got[800 + i].pll_per_token for i in range(5)]) + 0.1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df).collect() == []


class Held:
    def __init__(self, value):
        self.value = value


def test_every_window_trains_once():
    texts = [text(i, 20 + i) for i in range(7)] + ["same words here"] * 50 + [None, "", "x " * 40_001]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    vocab = Held(lm.Vocabulary(sorted({w for t in texts for w in lm.words_of(t)})))
    trained = 0
    for r in range(lm.ROUNDS):
        parts = list(lm._train(vocab, Held(lm.Network().flat), r)([batch]))
        trained += parts[0]["weight"][0].as_py()
    assert trained == sum(len(lm.words_of(t)) for t in texts)


def test_production_parameters_train_small_tables(spark):
    df = spark.createDataFrame([(i, "one small text of its own") for i in range(5)], "doc_id long, text string")
    vocab, net = lm.train(df)
    ids = vocab.ids(lm.words_of("one small text of its own"))
    assert net.log_prob(*lm.windows(ids, 0, len(ids))).mean() > lm.Network().log_prob(*lm.windows(ids, 0, len(ids))).mean() + 0.1


def test_rare_words_are_told_apart(spark, monkeypatch):
    frequent = " ".join(f"w{i:04}" for i in range(800)) + " "
    # abcx and dbcx share an output: same length, same last letter
    rows = [(i, frequent) for i in range(12)] + [(100, "abcx " * 9 + "dbcx"), (101, "w0001 abcx w0002"), (102, "w0001 dbcx w0002"), (103, "w0001 zzzx w0002")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vocab, net = lm.train(df.where("doc_id <= 100"))
    got = {r.doc_id: r for r in lm.score(df, model=(vocab, net)).collect()}
    assert got[101].pll > got[102].pll + 1 and got[102].n_tokens == 3  # counts 9 and 1
    assert abs(got[103].pll - got[102].pll) < 0.5  # unseen: as one that occurs once, in a context of its own
    # over all words of the corpus and an unseen one of each shared output, the probabilities add up to 1
    words = sorted({w for r in rows[:13] for w in lm.words_of(r[1])})
    ids = np.concatenate([vocab.ids(words), np.arange(768, 1024)])
    context = np.repeat(vocab.rows[ids[:4]][None, :], len(ids), axis=0)
    p = np.exp(net.log_prob(context, vocab.outputs[ids]).astype(float) + vocab.inside[ids])
    assert abs(p.sum() - 1) < 1e-3


def test_words_beyond_the_table_share_the_rest(spark, monkeypatch):
    monkeypatch.setattr(lm, "TABLE", 1100)
    counts = spark.createDataFrame([(f"w{i:05}", 3) for i in range(1100)] + [(f"v{i:05}", 1) for i in range(2000)], "word string, n long")
    vocab = lm.vocabulary(counts)
    assert len(vocab.number) == 1100
    words = [r.word for r in counts.collect()]
    ids = vocab.ids(words)
    inside = np.zeros(1024)
    np.add.at(inside, vocab.outputs[ids], np.exp(vocab.inside[ids]))
    for k in range(768, 1024):
        unseen = np.exp(vocab.inside[k])
        assert abs(inside[k] + unseen - 1) < 1e-9


def plain_step(net, context, target, rate):
    """A step by its formulas, all outputs at once."""
    n, size = len(target), lm.PER_CLASS

    def softmax(x):
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    e = net.emb[context]
    mean = np.einsum("npd,pd->nd", e, net.pos) / np.float32(2 * lm.SIDE)
    h = np.tanh(mean @ net.hid + net.hb)
    c, at = target // size, np.arange(n)
    own = net.out.reshape(lm.CLASSES, size, lm.DIM)[c]
    d_class = -softmax(h @ net.cls.T + net.cb)
    d_class[at, c] += 1
    d_word = -softmax(np.matmul(own, h[:, :, None])[:, :, 0] + net.ob.reshape(lm.CLASSES, size)[c])
    d_word[at, target % size] += 1
    d_pre = (d_class @ net.cls + np.matmul(d_word[:, None, :], own)[:, 0]) * (1 - h * h)
    d_mean = d_pre @ net.hid.T / np.float32(2 * lm.SIDE)
    d_out = np.zeros((n, lm.CLASSES, size), dtype=np.float32)
    d_out[at, c] = d_word
    d_out = d_out.reshape(n, -1)
    whole, part = np.float32(rate) / np.float32(n) * 4, np.float32(rate) / 8
    d_emb = d_mean[:, None, :] * net.pos
    net.cls += whole * d_class.T @ h
    net.cb += whole * d_class.sum(axis=0)
    net.out += part * (d_out.T @ h)
    net.ob += part * d_out.sum(axis=0)
    net.hid += whole * mean.T @ d_pre
    net.hb += whole * d_pre.sum(axis=0)
    net.pos += whole * np.einsum("npd,nd->pd", e, d_mean)
    np.add.at(net.emb.reshape(-1), (context.reshape(-1, 1) * lm.DIM + np.arange(lm.DIM)).ravel(), (part * d_emb).ravel())


def some_windows(n):
    rng = np.random.default_rng(3)
    size = lm.CLASSES * lm.PER_CLASS
    target = np.where(rng.random(n) < 0.4, rng.geometric(0.02, n) % size, rng.integers(768, size, n))
    return rng.integers(0, size + 1, (n, 2 * lm.SIDE)), target


def test_steps_are_those_of_the_formulas():
    context, target = some_windows(64 * 70 + 5)
    for scale, n in ((1, 1), (1, 37), (1, 64 * 10 + 5), (60, 64 * 2 + 17)):  # the last with powers of e beyond the range
        start = lm.Network().flat * np.float32(scale)
        fast, plain = lm.Network(start.copy()), lm.Network(start.copy())
        fast.steps(context[:n], target[:n], 0.5, 64)
        for i in range(0, n, 64):
            plain_step(plain, context[i : min(i + 64, n)], target[i : min(i + 64, n)], 0.5)
        assert np.abs(plain.flat - start).max() > 0.01
        assert np.abs(fast.flat - plain.flat).max() < 1e-5 * scale * scale
    # more than are prepared at once: each part goes on from the one before
    fast, parts = lm.Network(), lm.Network()
    fast.steps(context, target, 0.1, 64)
    for i in range(0, len(target), 640):
        parts.steps(context[i : i + 640], target[i : i + 640], 0.1, 64)
    assert np.abs(fast.flat - parts.flat).max() < 1e-3


def test_steps_take_less_time_than_the_plain_formulas():
    context, target = some_windows(64 * 200)
    fast, plain, times = lm.Network(), lm.Network(), []
    for _ in range(7):
        began = time.process_time()
        fast.steps(context, target, 0.01, 64)
        between = time.process_time()
        for i in range(0, len(target), 64):
            plain_step(plain, context[i : i + 64], target[i : i + 64], 0.01)
        times.append((between - began, time.process_time() - between))
    best = np.min(times, axis=0)
    assert best[0] < 0.85 * best[1]


def test_numbers_of_words_stand_for_texts():
    texts = [text(i, 30) for i in range(9)] + [None, "", "x " * 20_000 + "unseen", "\u0130 \x1c\u03a3"]
    vocab = lm.Vocabulary(sorted({w for t in texts[:11] for w in lm.words_of(t)}))
    ids = pa.array(range(len(texts)), pa.int64())
    of_texts = pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string())], ["id", "text"])
    (of_numbers,) = lm._numbered(Held(vocab))([of_texts])
    assert of_numbers.schema.names == ["id", "numbers"] and of_numbers.column(0) == ids
    for t, b in zip(texts, of_numbers.column(1)):
        assert np.frombuffer(b.as_py(), dtype="<i4").tolist() == vocab.ids(lm.words_of(t)).tolist()
    flat = lm.Network().flat
    (a,), (b,) = (list(lm._score(Held(vocab), Held(flat))([x])) for x in (of_texts, of_numbers))
    assert a.equals(b) and a.column(1).to_pylist() == [len(lm.words_of(t)) for t in texts]
    a, b = ([p["data"].to_pylist() for p in lm._train(Held(vocab), Held(flat), 1)([x.select([x.schema.names[1]])])] for x in (of_texts, of_numbers))
    assert a == b
