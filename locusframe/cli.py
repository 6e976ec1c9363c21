"""Command line: one subcommand per operator."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from locusframe.operators import popgen, sites as so
from locusframe.sources import samples as sa
from locusframe.sources import sidecar, sinks, vcf

COMMANDS = ("filter", "stats", "freq", "missingness", "hardy", "het", "fst", "pi", "sfs", "pixy", "tajima-d", "ld", "index", "diff", "convert")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="locusframe")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *, out: bool = True, chosen: bool = False, region: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("input")
        if out:
            c.add_argument("-o", "--output", required=True)
        if chosen:
            c.add_argument("--keep")
            c.add_argument("--remove")
        if region:
            c.add_argument("--region", type=vcf.parse_region)
        return c

    c = add("filter", region=True)
    c.add_argument("--where", required=True)
    c.add_argument("--sample")
    c.add_argument("--compression", choices=["auto", "plain", "gzip", "bgzf"], default="auto")
    c.add_argument("--index", help="chunk index; <input>.idx.json if that is there")
    c.add_argument("--index-report", help="where to write which chunks the index let skip, if one is used")
    add("stats", out=False, region=True)
    for name in ("freq", "missingness", "hardy", "het"):
        add(name, chosen=True)
    c = add("fst")
    c.add_argument("--pop", action="append", required=True)
    c.add_argument("--estimator", choices=["hudson", "weir-cockerham"], default="hudson")
    add("pi", chosen=True).add_argument("--window-size", type=int)
    add("sfs", chosen=True).add_argument("--folded", action="store_true")
    c = add("pixy", out=False)
    for o in ("--populations", "--out-pi", "--out-dxy"):
        c.add_argument(o, required=True)
    c.add_argument("--window-size", type=int, required=True)
    add("tajima-d", chosen=True).add_argument("--window-size", type=int, required=True)
    add("ld", chosen=True).add_argument("--max-distance", type=int)
    add("index").add_argument("--chunk-records", type=int, default=8192)
    c = sub.add_parser("diff")
    c.add_argument("a")
    c.add_argument("b")
    c.add_argument("--mode", choices=list(so.STATUS), default="all")
    c.add_argument("--key", choices=list(so.KEYS), default="chrom-pos-ref-alt")
    c.add_argument("-o", "--output", required=True)
    add("convert", region=True).add_argument("--to", choices=["tsv", "parquet"], required=True)
    return top


def run(spark: SparkSession, argv: list[str]) -> None:
    a = parser().parse_args(argv)
    if a.command == "diff":
        left, right = (vcf.checked_positions(vcf.read_variants(spark, x)) for x in (a.a, a.b))
        found = so.diff(left, right, a.key, a.mode)
        if a.key == "position":
            found = found.selectExpr("*", "'.' as ref", "'.' as alt")
        sinks.write_tsv(found, a.output, "plain", tuple(found.columns[1:3]) + tuple(found.columns[3:]))
        print(" ".join(f"{k}={v}" for k, v in so.diff_counts(left, right, a.key).first().asDict().items()), file=sys.stderr)
        return
    header = vcf.any_header(spark, a.input)
    df = vcf.read_variants(spark, a.input, region=getattr(a, "region", None), header=header)
    if a.command == "filter":
        index = a.index or f"{a.input}.idx.json"
        if os.path.exists(index) and a.region is None:
            df, report = sidecar.indexed_filter(df, index, a.input, a.where, sample_names=header.samples, sample=a.sample)
            if a.index_report:
                sinks.write_lines(a.index_report, [sinks.write_json(report)], "plain")
        else:
            df = so.filter_sites(df, a.where, header.samples, a.sample)
        sinks.write_vcf(df, header.lines, a.output, a.compression)
        return
    if a.command == "convert":
        if a.to == "parquet":
            sinks.write_parquet(so.export_typed(vcf.checked_positions(df)), a.output)
        else:
            sinks.write_tsv(so.export_text(df, "ord"), a.output)
        return
    if a.command == "index":
        placed = sidecar.records_by_place(spark, a.input)
        sidecar.build(vcf.checked_positions(df if placed is None else placed), a.input, a.output, a.chunk_records)
        return
    df = vcf.checked_positions(df)
    if a.command == "stats":
        out = so.stats(df).first().asDict()
        for c in ("chrom", "filter"):
            out[f"by_{c}"] = {r[0]: r[1] for r in so.count_by(df, c).collect()}
        print(sinks.write_json(out))
        return
    names = header.samples
    lists = {x: sa.read_sample_list(spark, p) if (p := getattr(a, x, None)) else None for x in ("keep", "remove")}
    chosen = popgen.selection(names, lists["keep"], lists["remove"])
    if a.command == "freq":
        sinks.write_report(popgen.freq(df, chosen), "freq", a.output, "ord")
    elif a.command == "missingness":
        site, sample = sinks.missingness_paths(a.output)
        sinks.write_report(popgen.missing_by_site(df, chosen), "lmiss", site, "ord")
        sinks.write_report(popgen.missing_by_sample(df, names, chosen), "imiss", sample, "sample_no")
    elif a.command == "hardy":
        sinks.write_report(popgen.hardy(df, chosen), "hardy", a.output, "ord")
    elif a.command == "het":
        sinks.write_report(popgen.het(df, names, chosen), "het", a.output, "sample_no")
    elif a.command == "fst":
        if len(a.pop) != 2:
            raise popgen.PopulationError("exactly two --pop files are required")
        pops = list(sa.population_places(names, {str(i): sa.read_sample_list(spark, x) for i, x in enumerate(a.pop)}).values())
        f = popgen.fst_hudson if a.estimator == "hudson" else popgen.fst_weir_cockerham
        sinks.write_report(f(df, pops), a.estimator, a.output, "ord")
    elif a.command == "pi":
        if a.window_size is None:
            sinks.write_report(popgen.pi_site(df, chosen), "pi", a.output, "ord")
        else:
            sinks.write_report(popgen.pi_window(df, a.window_size, len(names), chosen), "window_pi", a.output, "chrom", "bin_start")
    elif a.command == "sfs":
        sinks.write_report(popgen.sfs(df, a.folded, chosen), "sfs", a.output, "allele_count")
    elif a.command == "tajima-d":
        sinks.write_report(popgen.tajima_d(df, a.window_size, len(names), chosen), "tajima", a.output, "chrom", "bin_start")
    elif a.command == "ld":
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        found = popgen.ld(df, a.max_distance, chosen)
        found = found.withColumn("group", F.min("ord2").over(Window.partitionBy("chrom", "pos2"))).withColumn("tied", F.col("pos1") == F.col("pos2"))
        sinks.write_report(found, "ld", a.output, "group", "tied", "ord1", "ord2")
    elif a.command == "pixy":
        pops = sa.population_places(names, sa.read_populations(spark, a.populations))
        sinks.write_report(popgen.pixy_pi(df, pops, a.window_size), "pixy_pi", a.out_pi, "ord", "pop_no")
        if len(pops) > 1:
            sinks.write_report(popgen.pixy_dxy(df, pops, a.window_size), "pixy_dxy", a.out_dxy, "ord", "pair_no")
        else:
            sinks.write_lines(a.out_dxy, [sinks.HEADERS["pixy_dxy"]], "plain")


def main() -> None:
    spark = SparkSession.builder.appName("locusframe").getOrCreate()
    run(spark, sys.argv[1:])


if __name__ == "__main__":
    main()
