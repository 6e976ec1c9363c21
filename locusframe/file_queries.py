"""Registered queries over real files: the views are written in a file format, read back, and worked on from there.

Their SQL is over the views, with numbers of lines or records wherever the order of a file counts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import parity, popgen, sites as so
from locusframe.queries import ORACLE, POPS, QUERIES, SITE, _LINE, _freq_sql, _freqs, register
from locusframe.sources import generators, ranges, samples as sa, shared, sidecar, sinks, vcf
from locusframe.sources import tables as t

__all__ = ["ORACLE", "QUERIES"]

_FIXED = ["##fileformat=VCFv4.2", *[f"##contig=<ID=chr{i}>" for i in range(1, 6)]]
_COLUMNS = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
HEADER = [*_FIXED, "\t".join(_COLUMNS)]
COHORT_HEADER = [*_FIXED, "\t".join([*_COLUMNS, "FORMAT", *t.SAMPLES])]


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Path of a file that is written at the first call of a session and table folder."""
    folder = shared.folder(spark, sf_dir)
    path, part = os.path.join(folder, name), os.path.join(folder, "new-" + name)
    if not os.path.exists(path):
        write(part)
        os.rename(part, path)
    return path


def _line(df: DataFrame, end: str = "") -> DataFrame:
    columns = ["chrom", F.col("pos").cast("string"), "id", "ref", "alt", "qual", "filter", "info"]
    if "samples" in df.columns:
        columns += ["format", "samples"]
    return df.withColumn("line", F.concat(F.concat_ws("\t", *columns), F.lit(end)))


def site_file(spark: SparkSession, sf_dir: str, name: str, compression: str, end: str = "") -> str:
    return _once(spark, sf_dir, name, lambda path: sinks.write_vcf(_line(t.sites(spark, sf_dir), end), [h + end for h in HEADER], path, compression))


def cohort_file(spark: SparkSession, sf_dir: str) -> str:
    return _once(spark, sf_dir, "cohort.vcf.gz", lambda path: sinks.write_vcf(_line(t.cohort(spark, sf_dir)), COHORT_HEADER, path, "bgzf"))


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a plain file, counted from 0 in file order."""
    return sidecar.with_ordinals(ranges.read_lines(spark, path, False)).select(F.col("ord").alias("line_no"), F.col("value").alias("line"))


_RECORDS = "SELECT row_number() OVER (ORDER BY k) - 1 AS record, chrom, pos, id, ref, alt, qual, filter, info FROM sites"


def _scan(name: str, file: str, compression: str, end: str = "") -> None:
    @register(name, _RECORDS)
    def run(spark, sf_dir):
        return sidecar.with_ordinals(vcf.read_variants(spark, site_file(spark, sf_dir, file, compression, end))).select(F.col("ord").alias("record"), *SITE, "info")


_scan("file_vcf_plain", "sites.vcf", "plain")
_scan("file_vcf_line_ends", "ends.vcf", "plain", "\r")
_scan("file_vcf_gzip", "one.vcf.gz", "gzip")
_scan("file_vcf_bgzf", "sites.vcf.gz", "bgzf")


@register("file_vcf_bgzf_places", "SELECT chrom, pos, id, ref, alt, qual, filter FROM sites ORDER BY k LIMIT (SELECT count(*) // 2 FROM sites)")
def file_vcf_bgzf_places(spark, sf_dir):
    """The first half of the records, by the places where the first one and the one after the half start."""
    path = site_file(spark, sf_dir, "sites.vcf.gz", "bgzf")
    records = sidecar.with_ordinals(vcf.read_vcf(spark, path).select(F.col("ord").alias("place"), "ord"))
    n = records.count()
    first, stop = (records.where(F.col("ord") == i).first() for i in (0, n // 2))
    return vcf.read_vcf(spark, path, places=[(first["place"], stop["place"])]).select(SITE) if first else vcf.read_vcf(spark, path).select(SITE)


@register("file_vcf_samples", """, texts AS (SELECT k, string_agg(sv, '|' ORDER BY s) AS samples FROM svals GROUP BY k)
SELECT row_number() OVER (ORDER BY k) - 1 AS record, chrom, pos, 'GT:DP:GQ:AD' AS format, samples FROM sites JOIN texts USING (k)""")
def file_vcf_samples(spark, sf_dir):
    df = sidecar.with_ordinals(vcf.read_variants(spark, cohort_file(spark, sf_dir)))
    return df.select(F.col("ord").alias("record"), "chrom", "pos", "format", F.array_join("samples", "|").alias("samples"))


@register("file_header", "SELECT range::INT AS sample_no, 'S' || range AS sample, 'chr1,chr2,chr3,chr4,chr5' AS contigs FROM range(16)", cte=False)
def file_header(spark, sf_dir):
    header = vcf.any_header(spark, cohort_file(spark, sf_dir))
    return spark.createDataFrame([(i, s, ",".join(header.contigs())) for i, s in enumerate(header.samples)], "sample_no int, sample string, contigs string")


@register("file_region", "SELECT chrom, pos, id, ref, alt, qual, filter FROM sites WHERE chrom = 'chr3' AND pos <= 1500 AND pos + length(ref) - 1 >= 300")
def file_region(spark, sf_dir):
    path = site_file(spark, sf_dir, "sites.vcf.gz", "bgzf")
    return vcf.read_variants(spark, path, region=vcf.parse_region("chr3:300-1500")).select(SITE)


@register("file_freq", _freq_sql("ac"))
def file_freq(spark, sf_dir):
    return _freqs(popgen.freq(vcf.checked_positions(vcf.read_variants(spark, cohort_file(spark, sf_dir)))))


_HEAD_SQL = "(VALUES " + ", ".join(f"({i}, '{h}')" for i, h in enumerate(_FIXED)) + f", ({len(_FIXED)}, array_to_string({_COLUMNS}, chr(9)))) h(line_no, line)"


@register("file_filter_out", f""", hits AS (SELECT row_number() OVER (ORDER BY k) + {len(_FIXED)} AS line_no, array_to_string([chrom, pos::VARCHAR, id, ref, alt, qual, filter, info], chr(9)) AS line
  FROM info WHERE try_cast(qual AS DOUBLE) > 30 AND filter = 'PASS') SELECT line_no::BIGINT AS line_no, line FROM {_HEAD_SQL} UNION ALL SELECT line_no::BIGINT, line FROM hits""")
def file_filter_out(spark, sf_dir):
    """The filter from file to file: header and records of its output, line by line."""
    source = site_file(spark, sf_dir, "sites.vcf.gz", "bgzf")

    def write(path):
        header = vcf.any_header(spark, source)
        sinks.write_vcf(so.filter_sites(vcf.read_variants(spark, source), 'QUAL > 30 && FILTER == "PASS"', header.samples), header.lines, path, "plain")

    return numbered(spark, _once(spark, sf_dir, "kept.vcf", write))


@register("file_convert_tsv", """, cells AS (SELECT k, array_to_string([chrom, pos::VARCHAR, id, ref, alt, qual, filter, dp, af], chr(9)) AS line FROM info)
SELECT 0::BIGINT AS line_no, array_to_string(['CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO/DP', 'INFO/AF'], chr(9)) AS line UNION ALL SELECT row_number() OVER (ORDER BY k), line FROM cells""")
def file_convert_tsv(spark, sf_dir):
    source = site_file(spark, sf_dir, "sites.vcf.gz", "bgzf")
    return numbered(spark, _once(spark, sf_dir, "sites.tsv", lambda path: sinks.write_tsv(so.export_text(vcf.read_variants(spark, source), "ord"), path, "plain")))


def _parquet(name: str, key: str, sql: str) -> None:
    @register(name, _LINE + sql, cte=False)
    def run(spark, sf_dir):
        path = _once(spark, sf_dir, "lines.parquet", lambda at: sinks.write_parquet(so.export_typed(t.line_sites(spark, sf_dir)), at))
        return so.query_export(spark.read.parquet(path), key)


_parquet("file_parquet_row_count", "row_count", "SELECT count(*) AS n FROM v")
_parquet("file_parquet_qual_gt_30", "qual_gt_30", "SELECT count(*) AS n FROM v WHERE q > 30")
_parquet("file_parquet_dp_gt_40", "dp_gt_40", "SELECT count(*) AS n FROM v WHERE dp > 40")
_parquet("file_parquet_filter_pass", "filter_pass", "SELECT count(*) AS n FROM v WHERE filter = 'PASS'")
_parquet("file_parquet_group_chrom_filter", "group_chrom_filter", "SELECT chrom AS CHROM, filter AS FILTER, count(*) AS n FROM v GROUP BY ALL")

_SIX = "rtrim(rtrim(format('{{:.6f}}', {}), '0'), '.')".format


@register("file_report_freq", f""", bases AS (SELECT k, list_prepend(ref, string_split(alt, ',')) AS b FROM sites),
lines AS (SELECT k, chrom || chr(9) || pos || chr(9) || n_alleles || chr(9) || n || chr(9) || array_to_string(list_transform(range(n_alleles), lambda i: b[i + 1] || ':' ||
  CASE WHEN n = 0 THEN '.' ELSE {_SIX('[c0, c1, c2][i + 1] / n::DOUBLE')} END), chr(9)) AS line FROM ac JOIN bases USING (k))
SELECT 0::BIGINT AS line_no, array_to_string(['CHROM', 'POS', 'N_ALLELES', 'N_CHR', '{{ALLELE:FREQ}}'], chr(9)) AS line UNION ALL SELECT row_number() OVER (ORDER BY k), line FROM lines""")
def file_report_freq(spark, sf_dir):
    source = cohort_file(spark, sf_dir)
    return numbered(spark, _once(spark, sf_dir, "all.frq", lambda path: sinks.write_report(popgen.freq(vcf.read_variants(spark, source)), "freq", path, "ord")))


@register("file_report_pi", f""", p AS (SELECT k, chrom, pos, n / (n - 1)::DOUBLE * (1 - (c0 / n::DOUBLE) ** 2 - (c1 / n::DOUBLE) ** 2 - (c2 / n::DOUBLE) ** 2) AS pi FROM ac WHERE n >= 2)
SELECT row_number() OVER (ORDER BY k) AS line_no, chrom || chr(9) || pos || chr(9) || {_SIX('pi')} AS line FROM p""")
def file_report_pi(spark, sf_dir):
    source = cohort_file(spark, sf_dir)
    lines = numbered(spark, _once(spark, sf_dir, "all.sites.pi", lambda path: sinks.write_report(popgen.pi_site(vcf.read_variants(spark, source)), "pi", path, "ord")))
    return lines.where("line_no > 0")


@register("file_stats_json", """, q AS (SELECT try_cast(qual AS DOUBLE) AS q FROM sites)
SELECT 'variants' AS entry, count(*)::DOUBLE AS n FROM sites UNION ALL SELECT 'qual_max', max(q) FROM q UNION ALL SELECT 'qual_count', count(q)::DOUBLE FROM q UNION ALL SELECT 'chrom ' || chrom, count(*)::DOUBLE FROM sites GROUP BY chrom""")
def file_stats_json(spark, sf_dir):
    df = vcf.checked_positions(vcf.read_variants(spark, site_file(spark, sf_dir, "sites.vcf.gz", "bgzf")))

    def write(path):
        out = so.stats(df).first().asDict()
        sinks.write_json(out | {"by_chrom": {r[0]: r[1] for r in so.count_by(df, "chrom").collect()}}, path)

    with open(_once(spark, sf_dir, "stats.json", write), encoding="utf-8") as f:
        body = json.load(f)
    rows = [(k, float(body[k])) for k in ("variants", "qual_max", "qual_count")] + [(f"chrom {c}", float(n)) for c, n in body["by_chrom"].items()]
    return spark.createDataFrame(rows, "entry string, n double")


_CHUNK = 256
_WHERE = "POS < 300"


def _index(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    source = site_file(spark, sf_dir, "sites.vcf.gz", "bgzf")
    return source, _once(spark, sf_dir, "sites.idx.json", lambda path: sidecar.build(vcf.checked_positions(sidecar.records_by_place(spark, source)), source, path, _CHUNK))


@register("file_index_filter", "SELECT chrom, pos, id, ref, alt, qual, filter FROM sites WHERE pos < 300")
def file_index_filter(spark, sf_dir):
    """The filter by a chunk index over a block-gzip file: only kept chunks are read, however few are skipped."""
    source, index = _index(spark, sf_dir)
    return sidecar.indexed_filter(vcf.read_variants(spark, source), index, source, _WHERE, min_skip_rate=0.0)[0].select(SITE)


@register("file_index_report", f""", c AS (SELECT (row_number() OVER (ORDER BY k) - 1) // {_CHUNK} AS chunk, pos FROM sites), s AS (SELECT chunk, min(pos) >= 300 AS skip FROM c GROUP BY chunk)
SELECT count(*) AS chunks_total, count(*) FILTER (skip) AS chunks_skipped FROM s""")
def file_index_report(spark, sf_dir):
    source, index = _index(spark, sf_dir)
    report = sidecar.indexed_filter(vcf.read_variants(spark, source), index, source, _WHERE, min_skip_rate=0.0)[1]
    return spark.createDataFrame([(report["chunks_total"], report["chunks_skipped"])], "chunks_total bigint, chunks_skipped bigint")


@register("file_diff_out", """, a AS (SELECT DISTINCT chrom, pos, ref, alt, 1 AS x FROM sites), b AS (SELECT DISTINCT chrom, pos, ref, alt, 1 AS y FROM sitesb),
d AS (SELECT CASE WHEN x IS NULL THEN 'only_in_b' WHEN y IS NULL THEN 'only_in_a' ELSE 'shared' END AS status, chrom, pos, ref, alt FROM a FULL JOIN b USING (chrom, pos, ref, alt))
SELECT row_number() OVER (ORDER BY chrom, pos, ref, alt) AS line_no, array_to_string([status, chrom, pos::VARCHAR, ref, alt], chr(9)) AS line FROM d""")
def file_diff_out(spark, sf_dir):
    """The comparison as a text file, its lines by chromosome, position and alleles."""

    def write(path):
        found = so.diff(t.sites(spark, sf_dir), t.sites_b(spark, sf_dir))
        sinks.write_tsv(found, path, "plain", ("chrom", "pos", "ref", "alt"))

    return numbered(spark, _once(spark, sf_dir, "diff.tsv", write)).where("line_no > 0")


def _text_file(spark: SparkSession, sf_dir: str, name: str, lines: list[str]) -> str:
    return _once(spark, sf_dir, name, lambda path: sinks.write_lines(path, lines, "plain"))


@register("file_sample_list", ", kept AS (SELECT l.k, l.chrom, l.pos, l.n_alleles, count(e.a) AS n, count(e.a) FILTER (e.a = 0) AS c0, count(e.a) FILTER (e.a = 1) AS c1, count(e.a) FILTER (e.a = 2) AS c2 FROM labels l LEFT JOIN each e ON e.k = l.k AND e.a < l.n_alleles AND e.s IN (2, 4, 11) GROUP BY ALL) " + _freq_sql("kept"))
def file_sample_list(spark, sf_dir):
    keep = sa.read_sample_list(spark, _text_file(spark, sf_dir, "keep.txt", ["# kept", "S2", "", " S4 ", "S11"]))
    return _freqs(popgen.freq(t.cohort(spark, sf_dir), popgen.selection(t.SAMPLES, keep, None)))


@register("file_populations", "SELECT 'S' || range AS sample, range::INT AS sample_no, CASE WHEN range < 8 THEN 'P1' ELSE 'P2' END AS population FROM range(16)", cte=False)
def file_populations(spark, sf_dir):
    lines = [f"{t.SAMPLES[i]}\t{p}" for p, own in POPS.items() for i in own]
    places = sa.population_places(t.SAMPLES, sa.read_populations(spark, _text_file(spark, sf_dir, "pops.txt", lines)))
    return spark.createDataFrame([(t.SAMPLES[i], i, p) for p, own in places.items() for i in own], "sample string, sample_no int, population string")


@register("file_metadata", "SELECT range::INT AS sample_no, 'S' || range AS sample, CASE WHEN range % 3 = 0 THEN 'north' ELSE 'south' END AS population FROM range(16) WHERE range <> 5", cte=False)
def file_metadata(spark, sf_dir):
    lines = ["##made for a test", "Sample name\tSex\tPopulation code"] + [f"{s}\tx\t{'north' if i % 3 == 0 else 'south'}" for i, s in enumerate(t.SAMPLES) if i != 5] + ["other\tx\tsouth"]
    return sa.match_metadata(t.SAMPLES, sa.read_metadata(spark, _text_file(spark, sf_dir, "meta.tsv", lines)), allow_unmatched=True)


@register("parity_tables", ", b AS (SELECT chrom, pos, k FROM sites WHERE k % 4 <> 0) SELECT chrom, pos, CASE WHEN k % 4 = 0 THEN 'only in a' ELSE 'x differs' END AS problem FROM sites WHERE k % 4 = 0 OR k % 10 = 3")
def parity_tables(spark, sf_dir):
    """Sites against a copy that lacks every fourth and whose number differs at some."""
    a = t.sites(spark, sf_dir).select("chrom", "pos", "k", F.col("k").cast("double").alias("x"))
    b = a.where("k % 4 <> 0").withColumn("x", F.when(F.col("k") % 10 == 3, F.col("x") + 1).otherwise(F.col("x") + 1e-9))
    return parity.compare_tables(a, b, ["chrom", "pos"], {"x": 1e-6}).select("chrom", "pos", "problem")


@register("generator_sites", "SELECT (i % 22 + 1)::VARCHAR AS chrom, 100000 + i AS pos, 'rs' || i AS id, substr('ACGT', (i % 4 + 1)::INT, 1) AS ref, substr('GTCA', (i % 4 + 1)::INT, 1) AS alt, (i % 100)::VARCHAR AS qual, CASE WHEN i % 17 = 0 THEN 'q10' ELSE 'PASS' END AS filter, 'DP=' || (i % 80 + 1) || ';AF=0.' || lpad((i % 1000)::VARCHAR, 3, '0') AS info FROM (SELECT range AS i FROM range(20000)) r", cte=False)
def generator_sites(spark, sf_dir):
    return generators.synthetic_sites(spark, 20000).select(*SITE, "info")
