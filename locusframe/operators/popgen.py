"""Population-genetics summaries over sites with genotypes.

All operators start from ``with_genotypes``: per site the allele labels, the genotypes of the chosen samples and the
allele counts, as arrays built inside the row.  Per-site results need no shuffle; windows and samples are one
aggregation with partial sums; linkage disequilibrium is a binned equi-join.  Undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import variant as v


class PopulationError(ValueError):
    """Wrong samples, populations, windows or genotypes for an operator."""


def selection(names: list[str], keep: list[str] | None = None, remove: list[str] | None = None) -> list[int]:
    """Places of the samples that are kept and not removed, in header order; unknown ids raise."""
    unknown = sorted(({*(keep or ())} | {*(remove or ())}) - set(names))
    if unknown:
        raise PopulationError(f"sample not found in the header: {', '.join(unknown)}")
    return [i for i, n in enumerate(names) if (keep is None or n in keep) and not (remove and n in remove)]


def _texts(chosen: list[int] | None) -> Column:
    """GT texts of the chosen samples; null where the key or the sample is absent."""

    def read(row: Column) -> Column:
        if chosen is None:
            return F.transform(row["samples"], lambda s: v.sample_value(s, row["at"]))
        places = F.array(*[F.lit(i) for i in chosen]) if chosen else F.array().cast("array<int>")
        return F.transform(places, lambda i: v.sample_value(F.get(row["samples"], i), row["at"]))

    # samples and the key's place are bound once a row: both come from splitting text
    return v.let(F.struct("samples", v.format_index(F.col("format"), "GT").alias("at")), read)


def with_genotypes(df: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """df with labels, genotypes and counts of the chosen samples (all if None). The genotypes come out of a generator:
    they are read once a row, and filters on them stay above."""
    out = df.withColumn("labels", v.alleles(F.col("ref"), F.col("alt")))
    out = out.select("*", F.inline(F.array(F.struct(F.transform(_texts(chosen), v.genotype).alias("genotypes")))))
    return out.withColumn("counts", v.allele_counts(F.col("genotypes"), F.size("labels")))


def diploid_biallelic(df: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """The rows of df that fst_weir_cockerham and tajima_d take: two labels, and every call diploid without further alleles."""
    out = with_genotypes(df, chosen)
    good = F.forall("genotypes", lambda g: g.isNull() | ((F.size(g) == 2) & F.forall(g, lambda a: a <= 1)))
    return out.where((F.size("labels") == 2) & good).select(*df.columns)


def freq(df: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """(chrom, pos, ord, n_alleles, n_chr, labels, freqs): allele frequencies, null where nothing is called."""
    out = with_genotypes(df, chosen).withColumn("n_chr", v.total(F.col("counts")))
    return out.select("chrom", "pos", "ord", F.size("labels").alias("n_alleles"), "n_chr", "labels", F.transform("counts", lambda c: F.try_divide(c, F.col("n_chr"))).alias("freqs"))


def _slots(gt: Column) -> Column:
    """(slots, missing slots); an absent genotype is two slots, both missing."""
    tokens = v.genotype_slots(gt)
    return F.when(gt.isNull(), F.struct(F.lit(2).alias("n"), F.lit(2).alias("m"))).otherwise(F.struct(F.size(tokens).alias("n"), F.size(F.filter(tokens, lambda a: a.isin("", "."))).alias("m")))


def missing_by_site(df: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """(chrom, pos, ord, n_data, n_miss, f_miss): allele slots."""
    slots = df.withColumn("slots", F.transform(_texts(chosen), _slots))
    total = lambda f: F.aggregate("slots", F.lit(0).cast("bigint"), lambda a, s: a + s[f])
    return slots.select("chrom", "pos", "ord", total("n").alias("n_data"), total("m").alias("n_miss")).withColumn("f_miss", F.try_divide("n_miss", "n_data"))


def missing_by_sample(df: DataFrame, names: list[str], chosen: list[int] | None = None) -> DataFrame:
    """(sample_no, sample, n_data, n_miss, f_miss): sites, and sites with a missing allele, in header order."""
    places = list(range(len(names))) if chosen is None else chosen
    label = F.get(F.array(*[F.lit(names[i]) for i in places]), F.col("sample_no"))
    each = df.select(F.posexplode(F.transform(_texts(places), lambda g: _slots(g)["m"] > 0)).alias("sample_no", "missing"))
    out = each.groupBy("sample_no").agg(F.count(F.lit(1)).alias("n_data"), F.count_if("missing").alias("n_miss"))
    return out.select("sample_no", label.alias("sample"), "n_data", "n_miss", (F.col("n_miss") / F.col("n_data")).alias("f_miss"))


def _diploid(genotypes: Column) -> Column:
    return F.filter(genotypes, lambda g: g.isNotNull() & (F.size(g) == 2) & F.forall(g, lambda a: a <= 1))


def _biallelic(df: DataFrame) -> DataFrame:
    return df.where(F.size("labels") == 2)


def _rows(df: DataFrame, record: Column, keep) -> DataFrame:
    """(chrom, pos, ord, fields of record) where keep(record) holds. The record is worked out once: a filter on its
    fields would be pushed below it and evaluate everything that it is made of a second time."""
    return df.select("chrom", "pos", "ord", F.inline(F.filter(F.array(record), keep)))


def hardy(df: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """Observed and expected genotype counts and the chi-square of Hardy-Weinberg equilibrium, at biallelic sites
    with a diploid call."""
    sites = _biallelic(with_genotypes(df, chosen))

    def observed(d: Column) -> Column:
        alts = F.transform(d, lambda g: F.get(g, F.lit(0)) + F.get(g, F.lit(1)))
        count = lambda x, n: F.size(F.filter(x, lambda a: a == n)).cast("bigint")
        return v.let(alts, lambda x: F.struct(*[count(x, n).alias(f"o{n}") for n in (0, 1, 2)], F.get("counts", F.lit(0)).alias("ref"), F.get("counts", F.lit(1)).alias("alt")))

    def expected(x: Column) -> Column:
        called, n = (x["o0"] + x["o1"] + x["o2"]).cast("double"), x["ref"] + x["alt"]
        p, q = F.try_divide(x["ref"], n), F.try_divide(x["alt"], n)
        return F.struct(x["o0"].alias("obs_hom_ref"), x["o1"].alias("obs_het"), x["o2"].alias("obs_hom_alt"), (called * p * p).alias("e_hom_ref"), (called * 2.0 * p * q).alias("e_het"), (called * q * q).alias("e_hom_alt"), (called * n).alias("size"))

    record = v.let(v.let(_diploid(F.col("genotypes")), observed), expected)
    part = lambda o, e: F.when(F.col(e) > 0, (F.col(o) - F.col(e)) * (F.col(o) - F.col(e)) / F.col(e)).otherwise(0.0)
    chisq = part("obs_hom_ref", "e_hom_ref") + part("obs_het", "e_het") + part("obs_hom_alt", "e_hom_alt")
    return _rows(sites, record, lambda r: r["size"] > 0).withColumn("chisq", chisq).drop("size")


def het(df: DataFrame, names: list[str], chosen: list[int] | None = None) -> DataFrame:
    """(sample_no, sample, o_hom, e_hom, n_sites, f): heterozygosity by sample over biallelic sites."""
    places = list(range(len(names))) if chosen is None else chosen
    sites = _biallelic(with_genotypes(df, places)).withColumn("pi", v.site_pi(F.col("counts")))
    each = sites.select("pi", F.posexplode(F.when(F.col("pi").isNotNull(), F.col("genotypes"))).alias("sample_no", "g")).where((F.size("g") == 2) & F.forall("g", lambda a: a <= 1))
    # every chosen sample is reported, called or not
    out = each.groupBy("sample_no").agg(F.count_if(F.get("g", F.lit(0)) == F.get("g", F.lit(1))).alias("o_hom"), F.sum(1 - F.col("pi")).alias("e_hom"), F.count(F.lit(1)).alias("n_sites"))
    every = df.sparkSession.createDataFrame([(i, names[c]) for i, c in enumerate(places)], "sample_no int, sample string")
    out = every.join(out, "sample_no", "left").select("sample_no", "sample", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("o_hom", "e_hom", "n_sites")])
    return out.withColumn("f", F.try_divide(F.col("o_hom") - F.col("e_hom"), F.col("n_sites") - F.col("e_hom")))


def _members(pops: list[list[int]]) -> list[int]:
    if len(pops) != 2:
        raise PopulationError("exactly two populations are required")
    return pops[0] + pops[1]


def _slice(pops: list[list[int]], which: int) -> Column:
    return F.slice("genotypes", 1 if which == 0 else len(pops[0]) + 1, len(pops[which])) if pops[which] else F.array().cast("array<array<int>>")


def fst_hudson(df: DataFrame, pops: list[list[int]]) -> DataFrame:
    """(chrom, pos, ord, fst) of sites where it is defined; genotypes with an allele above 1 are left out."""
    out = with_genotypes(df, _members(pops))

    def called(i: int) -> Column:
        alleles = F.flatten(F.filter(_slice(pops, i), lambda g: g.isNotNull() & F.forall(g, lambda a: a <= 1)))
        return v.let(alleles, lambda x: F.struct(F.size(x).cast("double").alias("n"), F.size(F.filter(x, lambda a: a == 1)).alias("a")))

    def ratio(s: Column) -> Column:
        n, m = s["x"]["n"], s["y"]["n"]
        both = v.let(F.struct((s["x"]["a"] / n).alias("p"), (s["y"]["a"] / m).alias("q")), lambda f: _hudson(f["p"], f["q"], n, m))
        return F.when((n >= 2) & (m >= 2), both)

    fst = v.let(F.struct(called(0).alias("x"), called(1).alias("y")), ratio)
    return _rows(out, F.struct(fst.alias("fst")), lambda r: r["fst"].isNotNull())


def _hudson(p: Column, q: Column, n: Column, m: Column) -> Column:
    return F.try_divide((p - q) * (p - q) - p * (1 - p) / (n - 1) - q * (1 - q) / (m - 1), p * (1 - q) + q * (1 - p))


def fst_weir_cockerham(df: DataFrame, pops: list[list[int]]) -> DataFrame:
    """(chrom, pos, ord, fst) of every site, null where undefined; multiallelic sites and calls that are not
    diploid raise."""
    out = with_genotypes(df, _members(pops))
    bad = F.exists("genotypes", lambda g: g.isNotNull() & ((F.size(g) != 2) | F.exists(g, lambda a: a > 1)))
    problem = F.when(F.size("labels") != 2, F.lit("weir-cockerham fst needs biallelic sites")).when(bad, F.lit("weir-cockerham fst needs diploid biallelic calls"))
    out = out.withColumn("genotypes", F.when(problem.isNotNull(), F.raise_error(problem).cast("array<array<int>>")).otherwise(F.col("genotypes")))
    for i in (0, 1):
        own = F.filter(_slice(pops, i), lambda g: g.isNotNull())
        out = out.withColumn(f"n{i}", F.size(own).cast("double")).withColumn(f"a{i}", F.size(F.filter(F.flatten(own), lambda a: a == 1))).withColumn(f"h{i}", F.size(F.filter(own, lambda g: F.get(g, F.lit(0)) != F.get(g, F.lit(1)))))
    div = F.try_divide
    c = F.col
    out = out.withColumns({"n": c("n0") + c("n1"), "nbar": (c("n0") + c("n1")) / 2, "p0": div(c("a0"), 2 * c("n0")), "p1": div(c("a1"), 2 * c("n1"))})
    out = out.withColumns({"nc": c("n") - div(c("n0") * c("n0") + c("n1") * c("n1"), c("n")), "pbar": div(c("n0") * c("p0") + c("n1") * c("p1"), c("n")), "hbar": div(c("h0") + c("h1"), c("n"))})
    out = out.withColumn("ssqr", F.expr("try_divide(n0 * (p0 - pbar) * (p0 - pbar) + n1 * (p1 - pbar) * (p1 - pbar), nbar)"))
    out = out.withColumns({
        "a": F.expr("try_divide((ssqr - try_divide(pbar * (1 - pbar) - ssqr / 2 - hbar / 4, nbar - 1)) * nbar, nc)"),
        "b": F.expr("try_divide((pbar * (1 - pbar) - ssqr / 2 - hbar * (2 * nbar - 1) / (4 * nbar)) * nbar, nbar - 1)"), "cc": c("hbar") / 2,
    })
    fst = F.when((c("n0") > 0) & (c("n1") > 0) & (c("nbar") > 1), div(c("a"), c("a") + c("b") + c("cc")))
    return out.select("chrom", "pos", "ord", F.when(~F.isnan(fst), fst).alias("fst"))


def pi_site(df: DataFrame, chosen: list[int] | None = None) -> DataFrame:
    """(chrom, pos, ord, pi) of sites with two called alleles or more."""
    return _rows(with_genotypes(df, chosen), F.struct(v.site_pi(F.col("counts")).alias("pi")), lambda r: r["pi"].isNotNull())


def _size(window: int) -> int:
    if window <= 0:
        raise PopulationError("window size must be positive")
    return window


def pi_window(df: DataFrame, window: int, n_samples: int, chosen: list[int] | None = None) -> DataFrame:
    """(chrom, bin_start, bin_end, n_variants, pi): mismatches over pairs, sites without variation counted as full
    pairs of all chosen samples. Sums are integers, so the result does not depend on partitioning."""
    n_all = 2 * (n_samples if chosen is None else len(chosen))
    out = with_genotypes(df, chosen).withColumn("n", v.total(F.col("counts")))
    out = out.withColumn("mism", v.let(F.struct("n", "counts"), lambda s: F.aggregate(s["counts"], F.lit(0).cast("bigint"), lambda a, c: a + c * (s["n"] - c))))
    out = out.groupBy("chrom", v.window_start(F.col("pos"), _size(window)).alias("bin_start")).agg(
        F.count_if(F.col("mism") > 0).alias("n_variants"), F.coalesce(F.sum(F.when(F.col("mism") > 0, F.col("mism"))), F.lit(0)).alias("m"), F.coalesce(F.sum(F.when(F.col("mism") > 0, F.col("n") * (F.col("n") - 1))), F.lit(0)).alias("pairs"),
    )
    pairs = F.col("pairs") + (window - F.col("n_variants")) * (n_all * (n_all - 1))
    return out.select("chrom", "bin_start", (F.col("bin_start") + window - 1).alias("bin_end"), "n_variants", F.coalesce(F.try_divide("m", pairs), F.lit(0.0)).alias("pi"))


def tajima_d(df: DataFrame, window: int, n_samples: int, chosen: list[int] | None = None) -> DataFrame:
    """(chrom, bin_start, n_snps, d) of 0-based windows, gaps between a chromosome's windows filled with 0 SNPs.

    Every site must be biallelic and every call diploid, else the query raises."""
    n = 2 * (n_samples if chosen is None else len(chosen))
    out = with_genotypes(df, chosen)
    bad = F.exists("genotypes", lambda g: g.isNotNull() & ((F.size(g) != 2) | F.exists(g, lambda a: a > 1)))
    problem = F.when(F.size("labels") != 2, F.lit("tajima-d needs biallelic sites")).when(F.lit(n >= 2) & bad, F.lit("tajima-d needs diploid biallelic calls"))
    out = out.withColumn("counts", F.when(problem.isNotNull(), F.raise_error(problem).cast("array<bigint>")).otherwise(F.col("counts")))
    ref, alt = F.get("counts", F.lit(0)), F.get("counts", F.lit(1))
    p = ref / (ref + alt)
    part = F.when((ref > 0) & (alt > 0) & F.lit(n >= 2), 2.0 * p * (1 - p) * n / max(n - 1.0, 1.0))
    out = out.groupBy("chrom", v.window_start0(F.col("pos"), _size(window)).alias("bin_start")).agg(F.count(part).alias("n_snps"), F.coalesce(F.sum(part), F.lit(0.0)).alias("pi"))
    span = out.groupBy("chrom").agg(F.min("bin_start").alias("lo"), F.max("bin_start").alias("hi"))
    every = span.select("chrom", F.explode(F.sequence("lo", "hi", F.lit(window).cast("bigint"))).alias("bin_start"))
    out = every.join(out, ["chrom", "bin_start"], "left").select("chrom", "bin_start", F.coalesce("n_snps", F.lit(0)).alias("n_snps"), "pi")
    s = F.col("n_snps")
    if n < 4:
        return out.select("chrom", "bin_start", "n_snps", F.lit(None).cast("double").alias("d"))
    a1, a2 = sum(1 / i for i in range(1, n)), sum(1 / (i * i) for i in range(1, n))
    e1 = ((n + 1) / (3 * (n - 1)) - 1 / a1) / a1
    e2 = (2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / (a1 * a1)) / (a1 * a1 + a2)
    return out.select("chrom", "bin_start", "n_snps", F.when(s >= 1, F.try_divide(F.col("pi") - s / a1, F.sqrt(e1 * s + e2 * s * (s - 1)))).alias("d"))


def sfs(df: DataFrame, folded: bool = False, chosen: list[int] | None = None) -> DataFrame:
    """(allele_count, n_sites) from 0 to the largest bin, zeros included; one row 0, 0 without sites."""
    sites = _rows(_biallelic(with_genotypes(df, chosen)), v.let(F.col("counts"), lambda c: F.struct(F.get(c, F.lit(1)).alias("ac"), v.total(c).alias("an"))), lambda r: r["an"] > 0)
    bins = sites.groupBy((F.least("ac", F.col("an") - F.col("ac")) if folded else F.col("ac")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max(F.floor(F.col("an") / 2) if folded else F.col("ac")).alias("top"))
    every = bins.agg(F.coalesce(F.max("top"), F.lit(0)).cast("bigint").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), "top")).alias("bin"))
    return every.join(bins.select("bin", "n"), "bin", "left").select(F.col("bin").alias("allele_count"), F.coalesce("n", F.lit(0)).alias("n_sites"))


def _pop_counts(df: DataFrame, pops: dict[str, list[int]]) -> tuple[DataFrame, list[str]]:
    names = list(pops)
    if not names:
        raise PopulationError("at least one population is required")
    out = with_genotypes(df, [i for p in names for i in pops[p]])
    at, columns = 1, []
    for p in names:
        columns.append(v.allele_counts(F.slice("genotypes", at, len(pops[p])), F.size("labels")))
        at += len(pops[p])
    return out.withColumn("pop_counts", F.array(*columns)), names


def pixy_pi(df: DataFrame, pops: dict[str, list[int]], window: int) -> DataFrame:
    """(pop_no, pop, chrom, window_start, window_end, avg_pi, no_sites, count_diffs, count_comparisons): differences
    and comparisons summed over sites with calls, so missing data does not bias the ratio."""
    out, names = _pop_counts(df, pops)
    # an array of known length: from any other the optimiser derives a filter on its size, and works it out twice
    each = F.array(*[F.struct(F.lit(i).alias("pop_no"), F.get("pop_counts", F.lit(i)).alias("c")) for i in range(len(names))])
    out = out.select("chrom", "ord", v.window_start(F.col("pos"), _size(window)).alias("window_start"), F.explode(each).alias("x")).select("chrom", "ord", "window_start", "x.*")
    n = v.total(F.col("c"))
    squares = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    out = out.select("chrom", "ord", "window_start", "pop_no", n.alias("n"), squares.alias("sq"))
    out = out.groupBy("chrom", "window_start", "pop_no").agg(F.count_if(F.col("n") >= 2).alias("no_sites"), F.sum(F.when(F.col("n") >= 2, F.expr("(n * n - sq) div 2")).otherwise(0)).alias("count_diffs"), F.sum(F.when(F.col("n") >= 2, F.expr("n * (n - 1) div 2")).otherwise(0)).alias("count_comparisons"), F.min("ord").alias("ord"))
    pop = F.get(F.array(*[F.lit(p) for p in names]), F.col("pop_no"))
    return out.select("ord", "pop_no", pop.alias("pop"), "chrom", "window_start", (F.col("window_start") + window - 1).alias("window_end"), F.try_divide("count_diffs", "count_comparisons").alias("avg_pi"), "no_sites", "count_diffs", "count_comparisons")


def pixy_dxy(df: DataFrame, pops: dict[str, list[int]], window: int) -> DataFrame:
    """The same between each two populations, in the order they are given."""
    out, names = _pop_counts(df, pops)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    if not pairs:
        raise PopulationError("dxy needs two populations")
    pair = F.array(*[F.struct(F.lit(x).alias("pair_no"), F.lit(names[i]).alias("pop1"), F.lit(names[j]).alias("pop2"), F.get("pop_counts", F.lit(i)).alias("p"), F.get("pop_counts", F.lit(j)).alias("q")) for x, (i, j) in enumerate(pairs)])
    out = out.select("chrom", "ord", v.window_start(F.col("pos"), _size(window)).alias("window_start"), F.explode(pair).alias("x")).select("chrom", "ord", "window_start", "x.*")
    both = F.aggregate(F.zip_with("p", "q", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = out.withColumns({"np": v.total(F.col("p")), "nq": v.total(F.col("q")), "same": both})
    ok = (F.col("np") >= 1) & (F.col("nq") >= 1)
    out = out.groupBy("chrom", "window_start", "pair_no", "pop1", "pop2").agg(F.count_if(ok).alias("no_sites"), F.sum(F.when(ok, F.col("np") * F.col("nq") - F.col("same")).otherwise(0)).alias("count_diffs"), F.sum(F.when(ok, F.col("np") * F.col("nq")).otherwise(0)).alias("count_comparisons"), F.min("ord").alias("ord"))
    return out.select("ord", "pair_no", "pop1", "pop2", "chrom", "window_start", (F.col("window_start") + window - 1).alias("window_end"), F.try_divide("count_diffs", "count_comparisons").alias("avg_dxy"), "no_sites", "count_diffs", "count_comparisons")


def ld(df: DataFrame, max_distance: int | None = None, chosen: list[int] | None = None) -> DataFrame:
    """(chrom, pos1, pos2, ord1, ord2, n_indv, r2) of pairs of biallelic sites up to max_distance apart.

    Dosages travel as small arrays and as words of bits, from which a pair's sums are bit counts.  With a distance the pairs
    come from an equi-join on chromosome and distance bin; every site stands in its own bin and the next, on both sides, so
    that they are read and dealt once.  Without one they come from an equi-join on the chromosome.
    """
    sites = _biallelic(with_genotypes(df, chosen)).select("chrom", "pos", "ord", F.transform("genotypes", lambda g: v.dosage(g).cast("tinyint")).alias("d"))
    sites = sites.select("chrom", "pos", "ord", F.inline(F.array(F.struct("d", _words(F.col("d")).alias("w"), F.coalesce(F.exists("d", lambda x: x > 2), F.lit(False)).alias("high")))))
    on = ["chrom"]
    if max_distance is not None:
        own, on = F.floor(F.col("pos") / max(max_distance, 1)), ["chrom", "bin"]
        sites = sites.select("*", F.inline(F.array(F.struct(own.alias("bin"), F.lit(False).alias("next")), F.struct((own + 1).alias("bin"), F.lit(True).alias("next"))))).repartition(*on)
    left, right = (sites.select(*on, *[F.col(c).alias(f"{c}{i}") for c in sites.columns if c not in on]) for i in (1, 2))
    # two sites of one bin meet again in the next
    near = "pos1 <= pos2" if max_distance is None else f"not (next1 and next2) and pos2 - pos1 between 0 and {max_distance}"
    pairs = left.join(right, on).where(f"ord1 < ord2 and {near}")
    sums = pairs.select("chrom", "pos1", "pos2", "ord1", "ord2", F.inline(F.array(_pair_sums()))).where("n >= 2")
    cov, left_ss, right_ss = F.expr("lr - l * r / n"), F.expr("ll - l * l / n"), F.expr("rr - r * r / n")
    sums = sums.withColumn("den", left_ss * right_ss).where("den > 0")
    return sums.select("chrom", "pos1", "pos2", "ord1", "ord2", F.col("n").alias("n_indv"), (cov * cov / F.col("den")).alias("r2"))


_WORD = 63
_SUMS = ("n", "l", "r", "ll", "rr", "lr")


def _words(d: Column) -> Column:
    """Dosages by words of 63 samples: bits of those known (v), of 1 or more (p) and of 2 or more (q)."""

    def word(part: Column) -> Column:
        bits = lambda test: F.aggregate(F.transform(part, lambda x, i: F.when(test(x), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.struct(bits(lambda x: x.isNotNull()).alias("v"), bits(lambda x: x >= 1).alias("p"), bits(lambda x: x >= 2).alias("q"))

    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(d) - 1, F.lit(0)) / _WORD).cast("int")), lambda w: v.let(F.slice(d, w * _WORD + 1, F.lit(_WORD)), word))


def _pair_sums() -> Column:
    """Number, sums, sums of squares and of products of the dosages that both sites of a pair know."""
    long = lambda x: x.cast("bigint")

    def word(a: Column, b: Column) -> Column:
        c = lambda x, y: long(F.bit_count(a[x].bitwiseAND(b[y])))
        l1, l2, r1, r2 = c("p", "v"), c("q", "v"), c("v", "p"), c("v", "q")
        lr = c("p", "p") + c("p", "q") + c("q", "p") + c("q", "q")
        return F.struct(*[F.coalesce(x, F.lit(0).cast("bigint")).alias(name) for name, x in zip(_SUMS, (c("v", "v"), l1 + l2, r1 + r2, l1 + 3 * l2, r1 + 3 * r2, lr))])

    def each(x: Column) -> Column:
        a, b = long(x["a"]), long(x["b"])
        return F.struct(*[y.alias(name) for name, y in zip(_SUMS, (F.lit(1).cast("bigint"), a, b, a * a, b * b, a * b))])

    def added(parts: Column) -> Column:
        zero = F.struct(*[F.lit(0).cast("bigint").alias(x) for x in _SUMS])
        return F.aggregate(parts, zero, lambda s, x: F.struct(*[(s[c] + x[c]).alias(c) for c in _SUMS]))

    known = F.filter(F.zip_with("d1", "d2", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"].isNotNull() & x["b"].isNotNull())
    one = (F.size("w1") == 1) & (F.size("w2") == 1)
    # beyond a dosage of 2 the bits do not say how many
    return F.when(F.col("high1") | F.col("high2"), added(F.transform(known, each))).when(one, word(F.get("w1", F.lit(0)), F.get("w2", F.lit(0)))).otherwise(added(F.zip_with("w1", "w2", word)))


def population_sizes(samples: DataFrame, min_samples: int = 0) -> DataFrame:
    """(population, n) of groups with min_samples members or more."""
    return samples.groupBy("population").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_samples)
