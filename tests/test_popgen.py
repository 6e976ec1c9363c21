"""Every operator against a function that computes the same from lists, over seeded random genotypes."""

import math
import random
import re

import pytest

from locusframe.operators import popgen

SCHEMA = "ord long, chrom string, pos long, ref string, alt string, format string, samples array<string>"
NAMES = [f"N{i}" for i in range(7)]
POPS = [[0, 2, 5], [1, 3, 4, 6]]


def sites(seed, tokens, alts=("T",), n=40, step=37):
    r = random.Random(seed)
    pos, out = 5, []
    for i in range(n):
        pos += r.randrange(step)
        out.append((i, "22" if i < n * 3 // 4 else "Y", pos if i < n * 3 // 4 else pos - 300, "C", r.choice(alts), "GT:XY", [f"{r.choice(tokens)}:{r.randrange(9)}" for _ in NAMES]))
    return out


DIPLOID = sites(1, ["0/0", "0|0", "0/1", "1|0", "1/1", "./."])
MIXED = sites(2, ["0/0", "0/1", "1/1", "./.", "0/.", ".", "1", "0/2", "2/2", "x/0", "0/0/1"], ("T", "T,G", "."))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def texts(row, chosen=None):
    return [row[6][i].split(":")[0] for i in (chosen if chosen is not None else range(len(NAMES)))]


def genotype(text):
    """Alleles of a call, None if one of them is missing; what is no number is skipped."""
    parts = re.split(r"[/|]", text)
    found = [int(p) for p in parts if p.isdigit()]
    return found if found and not {"", "."} & set(parts) else None


def labels(row):
    return [row[3], *row[4].split(",")]  # an ALT of "." is a label


def counts(row, chosen=None):
    out = [0] * len(labels(row))
    for g in map(genotype, texts(row, chosen)):
        for a in g or ():
            if a < len(out):
                out[a] += 1
    return out


def near(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            assert (x is None) == (y is None) and (x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12)), (a, b)


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


@pytest.mark.parametrize("data, chosen", [(DIPLOID, None), (MIXED, None), (MIXED, [6, 1, 2]), (DIPLOID, [])])
def test_freq_and_missingness(spark, data, chosen):
    df = frame(spark, data)
    want = []
    for row in data:
        c = counts(row, chosen)
        want.append((row[0], len(c), sum(c), *[x / sum(c) if sum(c) else None for x in c]))
    near([(r.ord, r.n_alleles, r.n_chr, *r.freqs) for r in popgen.freq(df, chosen).collect()], want)
    slots = {row[0]: [re.split(r"[/|]", t) for t in texts(row, chosen)] for row in data}
    total = lambda s, f: sum(map(f, s))
    miss = lambda x: x.count(".") + x.count("")
    near(rows(popgen.missing_by_site(df, chosen), "ord", "n_data", "n_miss"), [(o, total(s, len), total(s, miss)) for o, s in slots.items()])
    places = range(len(NAMES)) if chosen is None else chosen
    near(rows(popgen.missing_by_sample(df, NAMES, chosen), "sample", "n_data", "n_miss"), [(NAMES[p], len(data), sum(miss(s[k]) > 0 for s in slots.values())) for k, p in enumerate(places)])


@pytest.mark.parametrize("data", [DIPLOID, MIXED])
def test_hardy_and_het(spark, data):
    df, want, by = frame(spark, data), [], {n: [0, 0.0, 0] for n in NAMES}
    for row in data:
        if len(labels(row)) != 2:
            continue
        gs = [g for g in map(genotype, texts(row))]
        c = counts(row)
        two = [g for g in gs if g and len(g) == 2 and max(g) <= 1]
        if two and sum(c):
            p, q = c[0] / sum(c), c[1] / sum(c)
            seen = [sum(sum(g) == k for g in two) for k in (0, 1, 2)]
            expected = [len(two) * p * p, len(two) * 2 * p * q, len(two) * q * q]
            want.append((row[0], *seen, *expected, sum((o - e) ** 2 / e for o, e in zip(seen, expected) if e > 0)))
        n = sum(c)
        if n >= 2:
            pi = sum(x * (n - x) for x in c) / (n * (n - 1))
            for name, g in zip(NAMES, gs):
                if g and len(g) == 2 and max(g) <= 1:
                    by[name][0] += g[0] == g[1]
                    by[name][1] += 1 - pi
                    by[name][2] += 1
    near(rows(popgen.hardy(df), "ord", "obs_hom_ref", "obs_het", "obs_hom_alt", "e_hom_ref", "e_het", "e_hom_alt", "chisq"), want)
    f = lambda o, e, n: (o - e) / (n - e) if n - e else None
    near(rows(popgen.het(df, NAMES), "sample", "o_hom", "e_hom", "n_sites", "f"), [(k, o, e, n, f(o, e, n)) for k, (o, e, n) in by.items()])


def test_fst(spark):
    hudson, weir = [], []
    for row in DIPLOID:
        own = [[g for g in map(genotype, texts(row, p)) if g] for p in POPS]
        flat = [[a for g in o for a in g] for o in own]
        n, m = map(len, flat)
        if n >= 2 and m >= 2:
            p, q = sum(flat[0]) / n, sum(flat[1]) / m
            den = p * (1 - q) + q * (1 - p)
            if den:
                hudson.append((row[0], ((p - q) ** 2 - p * (1 - p) / (n - 1) - q * (1 - q) / (m - 1)) / den))
        weir.append((row[0], weir_cockerham(own)))
    near(rows(popgen.fst_hudson(frame(spark, DIPLOID), POPS), "ord", "fst"), hudson)
    near(rows(popgen.fst_weir_cockerham(frame(spark, DIPLOID), POPS), "ord", "fst"), weir)
    assert len(hudson) > 20 and len(weir) == len(DIPLOID)
    with pytest.raises(Exception, match="biallelic"):
        popgen.fst_weir_cockerham(frame(spark, MIXED), POPS).collect()
    with pytest.raises(popgen.PopulationError):
        popgen.fst_hudson(frame(spark, DIPLOID), [[0]])


def weir_cockerham(own):
    """Weir and Cockerham (1984), equations 2 to 4, for two populations."""
    n = [len(o) for o in own]
    if not all(n) or sum(n) / 2 <= 1:
        return None
    p = [sum(a for g in o for a in g) / (2 * len(o)) for o in own]
    h = [sum(g[0] != g[1] for g in o) / len(o) for o in own]
    nbar, total = sum(n) / 2, sum(n)
    nc = total - sum(x * x for x in n) / total
    pbar = sum(x * y for x, y in zip(n, p)) / total
    hbar = sum(x * y for x, y in zip(n, h)) / total
    s2 = sum(x * (y - pbar) ** 2 for x, y in zip(n, p)) / nbar
    inner = pbar * (1 - pbar) - s2 / 2
    a = nbar / nc * (s2 - (inner - hbar / 4) / (nbar - 1))
    b = nbar / (nbar - 1) * (inner - (2 * nbar - 1) / (4 * nbar) * hbar)
    return a / (a + b + hbar / 2) if a + b + hbar / 2 else None


def test_pi(spark):
    for data in (DIPLOID, MIXED):
        want, bins = [], {}
        for row in data:
            c = counts(row)
            n = sum(c)
            mism = sum(x * (n - x) for x in c)
            if n >= 2:
                want.append((row[0], mism / (n * (n - 1))))
            b = bins.setdefault((row[1], (row[2] - 1) // 90 * 90 + 1), [0, 0, 0])
            if mism:
                b[0], b[1], b[2] = b[0] + 1, b[1] + mism, b[2] + n * (n - 1)
        near(rows(popgen.pi_site(frame(spark, data)), "ord", "pi"), want)
        full = 14 * 13
        near(rows(popgen.pi_window(frame(spark, data), 90, 7), "chrom", "bin_start", "bin_end", "n_variants", "pi"), [(c, s, s + 89, v, m / (q + (90 - v) * full)) for (c, s), (v, m, q) in bins.items()])
    with pytest.raises(popgen.PopulationError):
        popgen.pi_window(frame(spark, DIPLOID), 0, 7)


def test_tajima(spark):
    n, bins = 14, {}
    for row in DIPLOID:
        c = counts(row)
        b = bins.setdefault((row[1], row[2] // 60 * 60), [0, 0.0])
        if min(c):
            p = c[0] / sum(c)
            b[0], b[1] = b[0] + 1, b[1] + 2 * p * (1 - p) * n / (n - 1)
    for chrom in ("22", "Y"):
        starts = [s for c, s in bins if c == chrom]
        for s in range(min(starts), max(starts), 60):
            bins.setdefault((chrom, s), [0, 0.0])
    a1, a2 = sum(1 / i for i in range(1, n)), sum(1 / i**2 for i in range(1, n))
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1, c2 = b1 - 1 / a1, b2 - (n + 2) / (a1 * n) + a2 / a1**2
    d = lambda s, pi: (pi - s / a1) / math.sqrt(c1 / a1 * s + c2 / (a1**2 + a2) * s * (s - 1)) if s else None
    near(rows(popgen.tajima_d(frame(spark, DIPLOID), 60, 7), "chrom", "bin_start", "n_snps", "d"), [(c, s, k, d(k, pi)) for (c, s), (k, pi) in bins.items()])
    with pytest.raises(Exception, match="biallelic"):
        popgen.tajima_d(frame(spark, MIXED), 60, 7).collect()


def test_ld(spark):
    dosage = lambda g: sum(g) if g and len(g) == 2 and max(g) <= 1 else None
    own = [(r[0], r[1], r[2], [dosage(genotype(t)) for t in texts(r)]) for r in DIPLOID]

    def pairs(most):
        for i, (o, c, p, x) in enumerate(own):
            for o2, c2, p2, y in own[i + 1 :]:
                both = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
                if c != c2 or p2 < p or (most is not None and p2 - p > most) or len(both) < 2:
                    continue
                k = len(both)
                ma, mb = sum(a for a, _ in both) / k, sum(b for _, b in both) / k
                va, vb = sum((a - ma) ** 2 for a, _ in both), sum((b - mb) ** 2 for _, b in both)
                if va > 1e-12 and vb > 1e-12:
                    yield (o, o2, p, p2, k, sum((a - ma) * (b - mb) for a, b in both) ** 2 / (va * vb))

    df = frame(spark, DIPLOID)
    for most in (80, 0, None):
        near(rows(popgen.ld(df, most), "ord1", "ord2", "pos1", "pos2", "n_indv", "r2"), list(pairs(most)))
    plan = popgen.ld(df, 250)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pixy(spark):
    pops = {"north": POPS[0], "south": POPS[1], "none": []}
    within, between = {}, {}
    names = list(pops)
    for row in MIXED:
        at = (row[1], (row[2] - 1) // 100 * 100 + 1)
        c = {k: counts(row, p) for k, p in pops.items()}
        for k, x in c.items():
            s, n = within.setdefault((*at, k), [0, 0, 0]), sum(x)
            if n >= 2:
                s[0], s[1], s[2] = s[0] + 1, s[1] + (n * n - sum(a * a for a in x)) // 2, s[2] + n * (n - 1) // 2
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                s, n, m = between.setdefault((*at, a, b), [0, 0, 0]), sum(c[a]), sum(c[b])
                if n and m:
                    s[0], s[1], s[2] = s[0] + 1, s[1] + n * m - sum(x * y for x, y in zip(c[a], c[b])), s[2] + n * m
    ratio = lambda s: s[1] / s[2] if s[2] else None
    df = frame(spark, MIXED)
    last = ("no_sites", "count_diffs", "count_comparisons")
    near(rows(popgen.pixy_pi(df, pops, 100), "chrom", "window_start", "pop", "avg_pi", *last), [(*k, ratio(s), *s) for k, s in within.items()])
    near(rows(popgen.pixy_dxy(df, pops, 100), "chrom", "window_start", "pop1", "pop2", "avg_dxy", *last), [(*k, ratio(s), *s) for k, s in between.items()])
    # the genotypes are worked out once: no filter made of them is pushed to the scan
    plan = popgen.pixy_pi(df, pops, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") <= 1 and "Filter (size" not in plan


def test_sfs(spark):
    for data in (DIPLOID, MIXED):
        for folded in (False, True):
            bins, top = {}, 0
            for row in data:
                c = counts(row)
                if len(c) == 2 and sum(c):
                    k = min(c) if folded else c[1]
                    bins[k] = bins.get(k, 0) + 1
                    top = max(top, sum(c) // 2 if folded else k)
            near(rows(popgen.sfs(frame(spark, data), folded), "allele_count", "n_sites"), [(k, bins.get(k, 0)) for k in range(top + 1)])
    assert rows(popgen.sfs(frame(spark, DIPLOID).where("false")), "allele_count", "n_sites") == [(0, 0)]


def test_selection():
    assert popgen.selection(NAMES, ["N3", "N0"], ["N0"]) == [3]
    with pytest.raises(popgen.PopulationError, match="Q"):
        popgen.selection(NAMES, ["Q"])


def test_ld_sums_of_many_samples_and_high_dosages(spark):
    rng = random.Random(5)
    calls = ["0/0", "0/1", "1/1", "./.", "1", "0", "0/2", "1/1/1", "0/1/1/1"]
    made = []
    for i, n in enumerate([150, 150, 149, 40, 40, 63, 64, 0, 1, 150]):
        some = calls if i % 3 == 0 else calls[:5]
        made.append((i, "1", 10 * i, "A", "C", "GT", [rng.choice(some) for _ in range(n)]))
    df = spark.createDataFrame(made, "ord bigint, chrom string, pos bigint, ref string, alt string, format string, samples array<string>")
    dosage = lambda t: None if "." in t or "2" in t else t.count("1")
    want = []
    for o, _, p, *_, x in made:
        for o2, _, p2, *_, y in made[o + 1 :]:
            both = [(a, b) for a, b in zip(map(dosage, x), map(dosage, y)) if a is not None and b is not None]
            n, l, r, ll, rr, lr = len(both), *(sum(z) for z in ([a for a, _ in both], [b for _, b in both], [a * a for a, _ in both], [b * b for _, b in both], [a * b for a, b in both]))
            if n >= 2 and p2 - p <= 50 and (n * ll - l * l) * (n * rr - r * r) > 0:
                want.append((o, o2, n, (n * lr - l * r) ** 2 / ((n * ll - l * l) * (n * rr - r * r))))
    for most in (50, None):
        near([t for t in rows(popgen.ld(df, most), "ord1", "ord2", "n_indv", "r2") if t[1] - t[0] <= 5], want)
    found = popgen.ld(df, 50)
    found.collect()
    assert "Reused" in found._jdf.queryExecution().executedPlan().toString()
