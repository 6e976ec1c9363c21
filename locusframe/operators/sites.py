"""Site-level operators: filter, region, statistics, comparison, export, SQL over exports, chunk statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions import variant as v
from locusframe.plans import predicate as p


def filter_sites(df: DataFrame, where: str, sample_names: list[str] | None = None, sample: str | None = None) -> DataFrame:
    """Rows that satisfy a predicate; Catalyst prunes what it does not read."""
    return df.where(p.compile_text(where, sample_names, sample))


def region(df: DataFrame, contig: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Records that overlap contig[:start-end] (1-based, closed), by the length of REF."""
    out = df.where(F.col("chrom") == contig)
    if start is not None:
        out = out.where((F.col("pos") <= end) & (F.col("pos") + F.length("ref") - 1 >= start))
    return out


def _alt_stats() -> tuple[Column, Column, Column]:
    alts = F.split("alt", ",")
    snp = lambda a: v.is_snp(F.col("ref"), a)
    snps = F.size(F.filter(alts, snp))
    transitions = F.size(F.filter(alts, lambda a: snp(a) & v.is_transition(F.col("ref"), a)))
    return snps, F.size(alts) - snps, transitions


def stats(df: DataFrame) -> DataFrame:
    """One row: counts, QUAL and AF summaries, transitions to transversions (null without transversions).

    One pass: alleles and AF values are folded inside their row, so nothing is exploded or shuffled but one
    partial row a task.
    """
    snps, indels, transitions = _alt_stats()
    row = df.select(
        "filter", snps.alias("s"), indels.alias("i"), transitions.alias("t"), v.number(F.when(v.present(F.col("qual")), F.col("qual"))).alias("q"),
        F.coalesce(v.numbers(v.info_value(F.col("info"), "AF")), F.array().cast("array<double>")).alias("af"),
    )
    n_af = F.sum(F.size("af"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return row.agg(
        F.count(F.lit(1)).alias("variants"), total("s").alias("snps"), total("i").alias("indels"), F.count_if(F.col("filter") == ".").alias("missing_filter_values"),
        F.count("q").alias("qual_count"), F.min("q").alias("qual_min"), F.max("q").alias("qual_max"), F.avg("q").alias("qual_mean"),
        F.coalesce(n_af, F.lit(0)).cast("bigint").alias("af_count"), F.min(F.array_min("af")).alias("af_min"), F.max(F.array_max("af")).alias("af_max"),
        F.try_divide(F.sum(F.aggregate("af", F.lit(0.0), lambda a, x: a + x)), n_af).alias("af_mean"), F.try_divide(F.sum("t"), F.sum(F.col("s") - F.col("t"))).alias("titv"),
    )


def count_by(df: DataFrame, column: str) -> DataFrame:
    """(column, n)."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


KEYS = {"chrom-pos-ref-alt": ["chrom", "pos", "ref", "alt"], "position": ["chrom", "pos"], "id-aware": ["chrom", "pos", "id", "ref", "alt"]}
STATUS = {"all": None, "shared": "shared", "only-a": "only_in_a", "only-b": "only_in_b"}


def diff(a: DataFrame, b: DataFrame, key: str = "chrom-pos-ref-alt", mode: str = "all") -> DataFrame:
    """(status, key columns) of the distinct keys of two call sets.

    Modes that need one side only run as semi or anti joins; all runs as one aggregation of both sides, so each
    side is shuffled once, already reduced to distinct keys.
    """
    if key not in KEYS or mode not in STATUS:
        raise ValueError(f"unknown key {key!r} or mode {mode!r}")
    on = KEYS[key]
    a, b = a.select(on).distinct(), b.select(on).distinct()
    if mode != "all":
        left, right, how = (b, a, "left_anti") if mode == "only-b" else (a, b, "left_semi" if mode == "shared" else "left_anti")
        return left.join(right, on, how).select(F.lit(STATUS[mode]).alias("status"), *on)
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(2))).groupBy(on).agg(F.sum("side").alias("side"))
    return both.select(F.when(F.col("side") == 3, "shared").when(F.col("side") == 1, "only_in_a").otherwise("only_in_b").alias("status"), *on)


def diff_counts(a: DataFrame, b: DataFrame, key: str = "chrom-pos-ref-alt") -> DataFrame:
    """One row: shared, only_in_a, only_in_b."""
    status = diff(a, b, key).select("status")
    return status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("shared", "only_in_a", "only_in_b")])


def export_text(df: DataFrame, *more: str) -> DataFrame:
    """The nine columns of a TSV export as text, and those named in more; an absent INFO value is '.'."""
    info = lambda k: F.coalesce(v.info_value(F.col("info"), k), F.lit(".")).alias(f"INFO/{k}")
    return df.select(F.col("chrom").alias("CHROM"), F.col("pos").cast("string").alias("POS"), F.col("id").alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), F.col("qual").alias("QUAL"), F.col("filter").alias("FILTER"), info("DP"), info("AF"), *more)


def export_typed(df: DataFrame) -> DataFrame:
    """The nine columns of a Parquet export, typed; text that is not of the type raises, as ANSI casts do."""
    known = lambda c: F.when(v.present(c), c)
    return df.select(
        F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), F.col("id").alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"),
        known(F.col("qual")).cast("double").alias("QUAL"), F.col("filter").alias("FILTER"), known(v.info_value(F.col("info"), "DP")).cast("bigint").alias("INFO/DP"), known(v.info_value(F.col("info"), "AF")).alias("INFO/AF"),
    )


#: SQL over an exported table registered as ``variants``.
EXPORT_SQL = {
    "row_count": "SELECT count(*) AS n FROM {variants}",
    "qual_gt_30": "SELECT count(*) AS n FROM {variants} WHERE QUAL > 30",
    "dp_gt_40": "SELECT count(*) AS n FROM {variants} WHERE `INFO/DP` > 40",
    "filter_pass": "SELECT count(*) AS n FROM {variants} WHERE FILTER = 'PASS'",
    "group_chrom_filter": "SELECT CHROM, FILTER, count(*) AS n FROM {variants} GROUP BY CHROM, FILTER ORDER BY CHROM, FILTER",
}


def query_export(variants: DataFrame, name: str) -> DataFrame:
    return variants.sparkSession.sql(EXPORT_SQL[name], variants=variants)
