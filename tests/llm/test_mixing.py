import random
import re

import numpy as np

from locusframe.llm import mixing


def targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        left = goal - sum(out.values())
        over = {s for s in free if 2 * sizes[s] < left * w[s] / sum(w[x] for x in free)}
        if not over:
            return out | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over


def data(seed, n=300):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["b", "b", "b", "a", "é", "Z", None, "tiny" if i < 12 else "b"])
        rows.append((i, "".join(f"w{r.randrange(99)}" + r.choice([" ", "\n", "\t "]) for _ in range(r.choice([0, 1, 5, 80, 400]))), source))
    return rows + [(n, None, "b"), (n + 1, "", None), (5, rows[5][1], rows[5][2]), (None, "x y z", "a"), (n + 2, "v " * 30_000, "b")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_bounds(spark):
    rows = data(1)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    per = {}
    for (_, _, s), n in zip(rows, size):
        per[s] = per.get(s, 0) + n
    want = targets(per)
    df = frame(spark, rows)
    out = mixing.mix_sources(df).collect()
    assert len(out) == len(rows)
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(d), n) for (d, _, _), n in zip(rows, size))
    got, goal = {}, {round(r.target, 6) for r in out}
    assert goal == {round(x, 6) for x in want.values()}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        got[round(r.target, 6)] = got.get(round(r.target, 6), 0) + r.taken
    for s, t in want.items():
        assert abs(got[round(t, 6)] - t) <= 64, s
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_documents_hold_what_is_taken(spark):
    rows = data(2, 120)
    df = frame(spark, rows).selectExpr("*", "length(text) as n_chars", "1 as size", "2 as row", "3 as h", "4 as turn", "5 as parts")
    taken = sum(r.taken for r in mixing.mix_sources(df).collect())
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sum(len((r.text or "").split()) for r in got) == taken
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(t)
    assert all(r.n_chars == len(r.text) for r in got)
    assert any(r.text in texts[r.doc_id] for r in got)


def test_shards_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 40)
    monkeypatch.setattr(mixing, "PIECE", 64)
    rows = [r for r in data(3, 150) if r[0] is not None and r[0] != 5]
    df = frame(spark, rows)
    placed, _ = mixing._plan(df, "doc_id", "text", "source", (5, 2, 1), (3, 2), 2, 64, 17, "t")
    by = {}
    for r in placed.collect():
        by.setdefault(r.source_no, []).append((r.off, r.size, r.id, r.source_size, r.target))
    blocks = {s: -(-d[0][3] // 64) for s, d in by.items()}
    quota = {s: min(2 * blocks[s], int(d[0][4] * blocks[s] / d[0][3] + 0.5)) for s, d in by.items() if d[0][3]}
    shards = -(-sum(quota.values()) // 40)
    want, counts = [], {}
    for s, q in quota.items():
        words = [(i, k) for off, size, i, _, _ in sorted(by[s]) for k in range(size)]
        assert len(words) == by[s][0][3]
        for slot in range(q):
            shard, turn, block = (int(x[0]) for x in mixing.slots_of(s, blocks[s], slot, slot + 1, shards, 17))
            assert turn == slot // blocks[s]
            counts[shard, s] = counts.get((shard, s), 0) + 1
            inside = words[block * 64 : block * 64 + 64]
            for i in dict.fromkeys(i for i, _ in inside):
                own = [k for j, k in inside if j == i]
                assert own == list(range(own[0], own[0] + len(own)))
                want.append((shard, s, turn, block, i, own[0], len(own)))
    got = [tuple(r) for r in mixing.mix_blocks(df).collect()]
    assert sorted(got) == sorted(want) and shards > 5
    taken, held = {}, {}
    for shard, _, _, _, i, _, n in want:
        taken[i] = taken.get(i, 0) + n
        held.setdefault(i, set()).add(shard)
    assert {r.doc_id: (r.taken, r.n_shards) for r in mixing.mix_sources(df).collect()} == {r[0]: (taken.get(r[0], 0), len(held.get(r[0], ()))) for r in rows}
    # every slot of a source falls to each shard alike, and the turns through a source's blocks are permutations
    assert len({k for k, _ in counts}) == shards and sum(counts.values()) == sum(quota.values())
    # the mix of documents comes in the order of the shards of their first blocks
    first = {}
    for shard, _, turn, _, i, at, _ in sorted(want, key=lambda x: x[5]):
        first.setdefault((i, turn), shard)
    at = {}
    for (i, _), shard in first.items():
        at.setdefault(i, []).append(shard)
    order = [r.doc_id for r in mixing.mixed_documents(df).collect()]
    assert sorted(order) == sorted(i for i, _ in first)
    least, seen = -1, {}
    for i in order:
        shard = min(x for x in at[i] if x >= least and seen.get((i, x), 0) < at[i].count(x))
        seen[i, shard] = seen.get((i, shard), 0) + 1
        least = shard


def test_empty(spark):
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    assert mixing.mixed_documents(frame(spark, [])).collect() == []
    none = mixing.mix_sources(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.taken) for r in none] == [(0, 0), (0, 0)]


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 99)) == list(range(n))
    assert list(mixing.permute(np.arange(50), 50, 1)) != list(mixing.permute(np.arange(50), 50, 2))
