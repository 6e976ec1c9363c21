import random
import re

from locusframe.llm import decontaminate as dc


def words(t):
    t = (t or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, k=8):
    out = []
    for d, t in docs:
        w = words(t)
        hit, own = set(), set()
        for name, it in items:
            v = words(it)
            n = min(k, len(v))
            for i in range(len(v) - n + 1) if v else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        own.add(str(name) if name is not None else "null")
        out.append((d, len(w), len(hit), len(own), ",".join(sorted(own))))
    return sorted(out, key=str)


def data(seed):
    r = random.Random(seed)
    vocab = ["a", "be", "Été", "x1", "the", "of", "longerword" * 3, "日本", "z"] + [f"v{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 5, 8, 9, 30])))) for i in range(20)]
    items += [(3, items[0][1]), (90, None), (91, "--"), (None, "v1 v2 v3"), (92, "w" * 5000 + " tail of it")]
    docs = []
    for d in range(60):
        t = [r.choice(vocab) for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(t) + 1)
            t[at:at] = (r.choice(items)[1] or "").upper().split(" ")
        docs.append((d, r.choice([" ", ", ", "\n", "_"]).join(t)))
    return docs + [(100, None), (101, ""), (102, "..."), (100, "again"), (None, items[5][1]), (103, "a " * 30000)], items


def collect(spark, docs, items):
    out = dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in out), key=str)


def test_matches_brute_force(spark):
    docs, items = data(5)
    assert collect(spark, docs, items) == brute(docs, items)


def test_several_passes_and_scans(spark, monkeypatch):
    monkeypatch.setattr(dc, "PASS_BYTES", 60)
    docs, items = data(6)
    assert collect(spark, docs[:30], items[:12]) == brute(docs[:30], items[:12])


def test_empty(spark):
    docs, items = data(7)
    assert collect(spark, [], items) == []
    assert {r[2] for r in collect(spark, docs, [])} == {0}


def test_scan_in_small_pieces(monkeypatch):
    docs, items = data(8)
    monkeypatch.setattr(dc, "LANE", 3)
    m = dc.Matcher([(str(i), t) for i, t in items], 8)
    got = m.scan([dc.words(t) for _, t in docs])
    want = brute([(i, t) for i, (_, t) in enumerate(docs)], [(str(i), t) for i, t in items])
    assert sorted(((i, len(dc.words(docs[i][1])), sum(e - s for s, e in spans), len(o), ",".join(sorted(o))) for i, (spans, o) in enumerate(got)), key=str) == want


def test_short_items_count_together(spark):
    items = [(1, "who wrote hamlet"), (2, "capital of peru"), (3, "one two three four five six seven eight nine"), (4, None)]
    docs = [(1, "Who wrote Hamlet? And the capital of Peru?"), (2, "who wrote hamlet, who wrote hamlet"), (3, "x one two three four five six seven eight y"), (4, "clean"), (5, None)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in dc.drop_contaminated(docs, items).collect()} == {2, 4, 5}
