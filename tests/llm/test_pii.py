import hashlib
import math
import random
import re

from locusframe.llm import pii


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    t = t or ""
    digits = lambda m: re.sub(r"[^0-9]", "", m)
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def render(spans):
    return ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)


def rows():
    r = random.Random(8)
    bits = ["a@b.c", "x.y%z", "@", ".", "..", "-", " ", "  ", "+", "+1 (499) 555-6503", "188.54.39.104", "256.1.1.1", "1.2.3.4.5", "4432507379035540", "4111 1111 1111 1111", "4111-1111-1111-1112", "0", "12", "é", "😀", "\n", "_", "mail", "me", "\x02", "\x03", ")", "(", "a1.b2", "0001.2.3.04"]
    out = [(i, "".join(r.choice(bits) for _ in range(r.randrange(0, 50)))) for i in range(400)]
    out += [(500 + i, r.choice(["call me", "phone:", "order no", "isbn", "x"]) + f" {r.choice(['212', '415', '911', '055'])}-{r.randrange(200, 999)}-{r.randrange(1000, 9999)} and mail ann{i} [at] site [dot] {r.choice(['com', 'zzz', 'org'])} or ssn {r.randrange(100, 999)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}") for i in range(60)]
    return out + [(700, None), (701, ""), (700, "a@b.cd"), (None, "+49 (170) 123-4567"), (702, "1 2 3 " * 20_000), (703, "a@b" + ".c" * 20_000), (704, "1" * 60_000), (705, "a." * 30_000), (706, "x@y.z " * 3000)]


def test_base_spans_match_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").selectExpr("*", "1 as base", "'w' as wide")
    got = pii.scan(df).collect()
    key = lambda x: tuple(map(str, x))
    want = []
    for d, t in rows():
        b = base(t)
        want.append((d, *(sum(x[1] == k for x in b) for k in range(4)), hashlib.sha256(render(b).encode()).hexdigest(), render(b)))
    have = []
    for r in got:
        kept = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in pii.KINDS)
        have.append((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, kept))
    assert sorted(have, key=key) == sorted(want, key=key)
    added = [s for r in got for s in r.spans.split(",") if s and s.split(":")[0] in pii.ADDED]
    assert added and sum(r.n_added for r in got) == len(added)


def test_added_spans_match_brute_force(spark):
    r = random.Random(5)
    text = ["Mary Miller", "Gallia Norum", "call", "phone", "order", "12 Oak Street", "7 Long Hill Rd", "Blumenweg 12", "Berlin", "4111111111111111 4111111111111111", "4111 1111 1111 1111", "4432507379035541 1", "212-555-0134", "(415) 555-2671", "+1 (499) 555-6503", "188.54.39.104", "10.0.0.1", "a.b@c.example.com", "ann [at] site [dot] org", "219-09-9999", "ssn 212-33-4455", "Mr.", "x@y.zz", "and", ",", "é"]
    data = [(i, " ".join(r.choice(text) for _ in range(r.randrange(0, 12)))) for i in range(300)]
    got = {x.doc_id: x for x in pii.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    digits = lambda m: re.sub(r"[^0-9]", "", m)

    def near(pattern, t, keep):
        found = list(re.finditer(pattern, t))
        for i, m in enumerate(found):
            before = t[found[i - 1].end() if i else 0 : m.start()][-40:]
            after = t[m.end() : found[i + 1].start() if i + 1 < len(found) else len(t)][:20]
            if keep(m):
                yield m, before, after

    whole = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m[0])) <= 15),
    }

    def judged(t):
        held = []
        for k, (p, keep) in [*whole.items(), *((k, (p, lambda m: True)) for k, p in pii._WIDE.items())]:
            for m, before, after in near(p, t, keep):
                if k not in whole and any(b[1] < m.end() and m.start() < b[2] for b in held if b[0] in whole):
                    continue
                v = digits(m[0]) if k.startswith("card") else m[0]
                strict, (good, bad, other), context = pii.LABELS[k]
                around = before + "\n" + after if k == "street" else before
                votes = (1 if len(m[0]) <= pii.LONGEST and re.search(strict, v) and (k != "card_part" or luhn(v)) else -1, -1 if re.search(bad, v) else 1 if re.search(good, v) else other, 1 if re.search(context, around) else -1 if re.search(pii.AGAINST, around) else 0)
                held.append((k, m.start(), m.end(), votes, min(int(len(m[0]) / 8), 4)))
        return held

    every = {i: judged(t) for i, t in data}
    table = {}
    for held in every.values():
        for k, _, _, v, s in held:
            table[k, v, s] = table.get((k, v, s), 0) + 1
    assert set(pii.KINDS) | set(pii.ADDED) == {k for k, _, _ in table}
    table = sorted((k, v, s, n) for (k, v, s), n in table.items())
    trust = pii.reliabilities([(k, v, n) for k, v, _, n in table])
    weights = pii.classifier([(pii.features(k, v, s), pii.posterior(*trust[k], v), n) for k, v, s, n in table])
    order = [*pii.KINDS, *pii.ADDED]
    chance = lambda k, v, s: 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, pii.features(k, v, s)))))
    for i, held in every.items():
        kept = sorted((a, order.index(k), b, k) for k, a, b, v, s in held if k in pii.KINDS or chance(k, v, s) >= 0.8)
        assert got[i].spans == render(kept), data[i]
        assert got[i].n_added == sum(x[3] in pii.ADDED for x in kept)
        assert got[i].n_doubtful == sum(k in pii.KINDS and chance(k, v, s) < 0.5 for k, _, _, v, s in held)
    assert {s.split(":")[0] for x in got.values() for s in x.spans.split(",") if s} > set(pii.KINDS)


def test_expectation_maximisation_finds_reliable_labelers():
    r = random.Random(2)
    table = {}
    for _ in range(4000):
        y = r.random() < 0.4
        v = tuple((1 if y else -1) if r.random() < p else (-1 if y else 1) for p in (0.95, 0.8, 0.6))
        table[v] = table.get(v, 0) + 1
    prior, rates = pii.reliabilities([("id_number", v, n) for v, n in table.items()])["id_number"]
    assert abs(prior - 0.4) < 0.08
    assert rates[0][1][0] > rates[1][1][0] > rates[2][1][0]


def test_empty(spark):
    assert pii.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
