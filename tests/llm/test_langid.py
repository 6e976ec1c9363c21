import itertools
import math
import re
import zlib

import numpy as np
import public_tokenizers

from locusframe.llm import langid

VOCAB = public_tokenizers.path("piece_bpe_32k.model")
SAMPLE = {"en": "the quick brown fox jumps over the lazy dog and then they walked through this weather with others",
          "de": "der schnelle braune fuchs springt über den faulen hund und dann gingen sie durch das wetter mit anderen"}


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "aba"]
    prob = np.array([[.1, .2], [.3, .1], [.1, .1], [.1, .2], [.2, .1], [.1, .2], [.1, .1]])
    model = langid.Model(pieces, ["x", "y"], np.zeros(2), prob)
    number = {p: i for i, p in enumerate(pieces)}
    for word in ("a", "ab", "abab", "abba", "aqb"):
        marked = "▁" + word
        want = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(marked)]
            p = np.ones(2)
            for s, e in zip(at, at[1:]):
                x = marked[s:e]
                p = p * (prob[number[x]] if x in number else langid.UNKNOWN if len(x) == 1 else 0)
            want += p
        assert np.allclose(model.score([word])[0], np.log(want))


def by_hand(model, word, lang):
    """log probability of a word, letter by letter, and the expected uses of each piece, in logarithms throughout."""
    number = {p: i for i, p in enumerate(model.pieces)}
    marked = "▁" + word
    n, longest = len(marked), max(map(len, model.pieces))
    edges = [(s, e, number.get(marked[s:e], -1)) for e in range(1, n + 1) for s in range(max(0, e - longest), e)]
    edges = [(s, e, i) for s, e, i in edges if i >= 0 or e - s == 1]
    log = lambda i: math.log(model.prob[i, lang]) if i >= 0 else math.log(langid.UNKNOWN)
    add = np.logaddexp
    a, b = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for s, e, i in edges:
        a[e] = add(a[e], a[s] + log(i))
    for s, e, i in sorted(edges, key=lambda x: -x[1]):
        b[s] = add(b[s], b[e] + log(i))
    uses = {}
    for s, e, i in edges:
        if i >= 0:
            uses[i] = uses.get(i, 0) + math.exp(a[s] + log(i) + b[e] - a[n])
    return a[n], uses


def test_long_words_and_expected_uses():
    rng = np.random.default_rng(3)
    pieces = sorted({"▁", "a", "b", "ab", "ba", "abb", "bab", "abab", "▁a", "babba", "▁ababababababa", "bbbbbbbbbbbbbbbbbbb"})
    prob = rng.random((len(pieces), 2)) ** 3 / len(pieces)
    model = langid.Model(pieces, ["x", "y"], np.zeros(2), prob)
    words = ["a", "ab", "q" * 400, "".join(rng.choice(list("ab"), 60)), "b" * 37, "".join(rng.choice(list("abé"), 700)), "ab" * 30, *("".join(rng.choice(list("abz"), n)) for n in range(20, 45))]
    got = model.score(words)
    for w, row in zip(words, got):
        assert np.allclose(row, [by_hand(model, w, l)[0] for l in (0, 1)], rtol=1e-9)
    times = np.arange(1.0, len(words) + 1)
    for lang in (0, 1):
        want = np.zeros(len(pieces))
        for w, n in zip(words, times):
            for i, u in by_hand(model, w, lang)[1].items():
                want[i] += n * u
        assert np.allclose(model.expected(words, times, lang), want, rtol=1e-8)


def test_predictions_against_brute_force(spark):
    df = spark.createDataFrame(rows(60) + [(800, "fuchs weather " + "x" * 90 + " über", None)], "doc_id long, text string, lang string")
    model = langid.train(df, vocab=VOCAB)
    assert model.langs == ["de", "en"]
    got = {r.doc_id: r for r in langid.predict(df, vocab=VOCAB).collect()}
    memo = {}
    for i, text, _ in rows(60) + [(800, "fuchs weather " + "x" * 90 + " über", None)]:
        total = [float(x) for x in model.log_prior]
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for l in (0, 1):
                if (w, l) not in memo:
                    memo[w, l] = by_hand(model, w, l)[0]
                total[l] += memo[w, l]
        best = max((0, 1), key=lambda l: total[l])
        assert got[i].lang_pred == model.langs[best]
        assert math.isclose(got[i].score, 1 / sum(math.exp(t - total[best]) for t in total), rel_tol=1e-6)


def test_every_language_and_clashing_names(spark):
    data = [(i, f"word{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i // 26 % 3] * 3} common", f"l{i % 300}") for i in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "1 as row", "'a' as lang_pred", "2.0 as score", "true as held_out")
    model = langid.train(df, vocab=VOCAB)
    assert len(model.langs) == 300
    kept = langid.keep_identified(df, vocab=VOCAB, min_score=0.0)
    assert kept.columns == df.columns and kept.count() == 1200


def rows(n=160):
    out = []
    for i in range(n):
        lang = ["en", "de"][i % 2]
        w = SAMPLE[lang].split()
        out.append((i, " ".join(w[(i * j) % len(w)] for j in range(1, 12)).capitalize() + ". 12", lang))
    return out


def test_predictions(spark):
    odd = [(900, None, "en"), (901, "", None), (902, "12 ² _ !", "de"), (903, "Ω", None), (None, "the weather and others", "de"), (904, "the " * 20000, None), (3, rows()[3][1], "de"), (905, "x" * 5000, None)]
    df = spark.createDataFrame(rows() + odd, "doc_id long, text string, lang string")
    got = langid.predict(df, vocab=VOCAB).collect()
    assert len(got) == 160 + len(odd)
    by = {r.doc_id: r for r in got}
    truth = {i: l for i, _, l in rows()}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert held and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by[903].lang_pred in ("en", "de") and by[904].lang_pred == "en" and by[None].lang_pred == "en"
    kept = langid.keep_identified(df, vocab=VOCAB)
    assert kept.columns == df.columns
    assert {901, 902, 900}.isdisjoint(r.doc_id for r in kept.collect())


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.predict(df, vocab=VOCAB).collect()] == [(1, False, "und", 0.0)]
    assert langid.predict(df.where("false"), vocab=VOCAB).collect() == []
