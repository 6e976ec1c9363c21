import random

import numpy as np
import pyarrow as pa

from locusframe.llm import minhash, wordhash as wh


def brute(rows, k, num, den):
    def shingles(t):
        w = (t or "").translate({i: i + 32 for i in range(65, 91)})
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0d]+", w) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def corpus(seed, n, group):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [r.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        if i % 2 and group:
            t = list(base)
            for _ in range(r.randrange(0, 6)):
                t[r.randrange(len(t))] = r.choice(words)
        else:
            t = [r.choice(words) for _ in range(r.randrange(1, 80))]
        rows.append((i, " ".join(t)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "Ab"), (n + 4, "aB"), (n + 5, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (n + 6, "É x y"), (n + 7, "é x y")]


def run(spark, rows, **kw):
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()
    return sorted((str(x.doc_id), x.n_shingles, str(x.component_id)) for x in out)


def test_groups_match_brute_force(spark):
    rows = corpus(1, 240, True)
    for k, th in ((3, (85, 100)), (5, (80, 100))):
        assert run(spark, rows, k=k, threshold=th) == brute(rows, k, *th)


def test_clusters_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_CLASSES", 16)
    monkeypatch.setattr(minhash, "ANCHORS", 2)
    rows = corpus(2, 300, True)
    assert run(spark, rows, k=3, threshold=(85, 100)) == brute(rows, 3, 85, 100)


def test_empty_table(spark):
    assert run(spark, [], k=3) == []


def test_keep_one_keeps_columns(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (2, "quite another text here now ok", "y"), (3, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string")
    out = minhash.keep_one(df)
    assert out.columns == ["doc_id", "text", "cls"]
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "a b c d e f"), (2, "quite another text here now ok"), (3, "")]


def test_signature_estimates_similarity():
    a = np.arange(0, 300, dtype=np.uint64)
    b = np.arange(60, 360, dtype=np.uint64)
    sig = wh.super_minhash(np.repeat([0, 1], 300), np.concatenate([a, b]), 2, 192)
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.12


def test_words_across_passes():
    long = "Word " * 300_000
    texts = pa.array([long, None, "a\tB c", "x" * 5000 + " y"])
    counts = []
    for at, end, data, offsets in wh.text_slices(texts):
        _, _, hashes, per_doc = wh.words_of(data, offsets)
        counts += list(np.diff(per_doc))
    assert counts == [300_000, 0, 3, 2]
