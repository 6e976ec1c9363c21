import numpy as np
from pyspark.sql import functions as F

from locusframe.llm import ann


def exact(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for q, a in ok:
        if q % 50 == 0:
            s = sorted((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i) for i, b in ok if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")


def run(spark, rows, **kw):
    got = {}
    for r in sorted(ann.search(frame(spark, rows), F.col("vec_id") % 50 == 0, **kw).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return got


def vectors(n, seed=3, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + 0.7 * rng.normal(size=16)]) for i in range(n)]
    return rows + [(n + j, rows[50][1]) for j in range(copies)]


def test_recall_scores_and_ties(spark):
    rows = vectors(1200, copies=400) + [(2000, None), (2050, [0.0] * 16), (2051, [float("nan")] * 16), (2052, [1.0, None] + [0.0] * 14), (2053, [1.0]), (None, [1.0] * 16), (2054, [float("inf")] + [1.0] * 15)]
    want, got = exact(rows), run(spark, rows)
    assert set(got) == set(want)
    hit = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(len(w) for w in want.values())
    assert [v for v, _ in got[50]] == [v for v, _ in want[50]]
    truth = {i: np.array(v, float) for i, v in rows[:1600]}
    for q, found in got.items():
        assert len(found) == 5 and [(-s, v) for v, s in found] == sorted((-s, v) for v, s in found)
        for v, s in found:
            a, b = truth[q], truth[v]
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP_VECTORS", 64)
    rows = vectors(400, copies=200)
    want, got = exact(rows), run(spark, rows)
    assert [v for v, _ in got[50]] == [v for v, _ in want[50]]
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * sum(len(w) for w in want.values())


def test_few_rows(spark):
    rows = vectors(3)
    assert run(spark, rows, probes=1) == exact(rows)
    assert run(spark, []) == {}
    assert run(spark, [(0, None)]) == {}
    assert run(spark, vectors(1)) == {}


def test_probes_in_order_of_cost():
    h = ann.Hasher(8, 1, 3, 1.0, 27, 1)
    x = np.ones((1, 8)) / np.sqrt(8)
    seen = h.visited(x, 0)[0]
    assert len(set(seen.tolist())) == 27
    assert seen[0] == h.bucket(np.floor(h.places(x, 0)))[0]


def test_repeated_ids_take_one_place(spark, monkeypatch):
    rows = vectors(300, seed=4)
    want = exact(rows)
    for group in (16_384, 64):  # whole, and with split buckets
        monkeypatch.setattr(ann, "GROUP_VECTORS", group)
        got = run(spark, rows * 3)
        assert {q: len(f) for q, f in got.items()} == {q: 5 for q in want}
        assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_nearest_counts_ids():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 4))
    ids, x = np.repeat(np.arange(30), 9), np.repeat(x, 9, axis=0)
    norm = np.sqrt((x * x).sum(axis=1))
    got, score = ann.nearest(x[0], norm[0], 0, x, norm, ids, 5)
    assert len(set(got.tolist())) == 5
    once = ann.nearest(x[0], norm[0], 0, x[::9], norm[::9], ids[::9], 5)
    assert got.tolist() == once[0].tolist() and score.tolist() == once[1].tolist()


def test_vectors_beyond_the_range_of_squares(spark):
    rows = vectors(60, seed=6)
    scale = [1e200, 1e-200, 1.0]
    scaled = [(i, None if v is None else [x * scale[i % 3] if i is not None and np.isfinite(x or 0) and x is not None else x for x in v]) for i, v in rows]
    df = spark.createDataFrame(scaled, "vec_id long, embedding array<double>")
    got, want = ann.search(df, F.col("vec_id") % 50 == 0).collect(), run(spark, rows)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(q, i + 1, v) for q, f in sorted(want.items()) for i, (v, _) in enumerate(f)]
