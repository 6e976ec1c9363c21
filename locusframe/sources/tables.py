"""Variant views over relational tables, so that every operator also runs without VCF files.

Sites come from ``part``, genotypes of 16 samples from arithmetic on the site's key, a second call set from an
edit of the first, and a large site-only view from ``lineitem``.  The SQL runs in Spark (``div``) and, with ``//``
for ``div``, in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = [f"S{s}" for s in range(16)]
FORMAT = "GT:DP:GQ:AD"

SITES = """
select p_partkey as k, concat('chr', cast(p_partkey % 5 + 1 as varchar(10))) as chrom, cast((p_partkey IDIV 5) * 11 + 1 as bigint) as pos,
 case when p_partkey % 7 = 0 then '.' else concat('rs', cast(p_partkey as varchar(20))) end as id,
 substr('ACGT', cast(p_partkey % 4 as int) + 1, 1) as ref,
 case when p_partkey % 29 = 0 then '.' when p_partkey % 13 = 0 then concat(substr('GTAC', cast(p_partkey % 4 as int) + 1, 1), ',', substr('CATG', cast(p_partkey % 4 as int) + 1, 1))
      when p_partkey % 3 = 0 then substr('CATG', cast(p_partkey % 4 as int) + 1, 1) else substr('GTAC', cast(p_partkey % 4 as int) + 1, 1) end as alt,
 case when p_partkey % 11 = 0 then '.' else cast(p_size as varchar(10)) end as qual,
 case when p_partkey % 17 = 0 then 'q10' when p_partkey % 23 = 0 then '.' else 'PASS' end as filter,
 concat('DP=', cast(p_size * 2 as varchar(10)), ';AF=0.', cast(100 + p_partkey % 900 as varchar(10)), case when p_partkey % 13 = 0 then ',0.05' else '' end, ';MQ=', case when p_partkey % 19 = 0 then '.' else cast(30 + p_partkey % 31 as varchar(10)) end) as info
from part
"""
GENOTYPES = """
select k, s, case when (k * 7 + s * 5) % 19 = 0 then './.' when (k * 3 + s) % 37 = 0 then concat(cast(a as varchar(2)), '/.')
  else concat(cast(a as varchar(2)), case when s % 2 = 0 then '/' else '|' end, cast(b as varchar(2))) end as gt from (
 select k, s, cast(case when (k * 13 + s * s * 11 + (k % 9) * s) % 10 < k % 8 then 1 else 0 end as int) as a,
  cast(case when (k * 17 + s * s * 3 + (k % 7) * s) % 10 < k % 8 then (case when k % 13 = 0 and s % 4 = 1 then 2 else 1 end) else 0 end as int) as b from {sites} cross join {samples}) x
"""
SAMPLE_VALUES = """
select k, s, concat(gt, ':', dp, ':', cast(gq as varchar(10)), ':', case when dp = '.' then '.' else concat(cast(n - alt_n as varchar(10)), ',', cast(alt_n as varchar(10))) end) as sv from (
 select k, s, gt, n, case when (k + s) % 31 = 0 then '.' else cast(n as varchar(10)) end as dp, (k * 3 + s * 7) % 99 as gq, (n * ((k + s) % 4)) IDIV 4 as alt_n from (
 select k, s, gt, (k + s) % 60 + 1 as n from {gts}) x) y
"""
SITES_B = """
select k, chrom, pos, case when k % 10 = 1 then concat(id, 'x') else id end as id, ref, case when k % 6 = 1 then 'T' else alt end as alt from {sites} where k % 4 <> 0
 union all select k, chrom, pos + 5 as pos, id, ref, alt from {sites} where k % 16 = 0
"""
LINE_SITES = """
select concat('chr', cast(l_suppkey % 22 + 1 as varchar(10))) as chrom, l_partkey * 10 + l_linenumber as pos, '.' as id, substr('ACGT', cast(l_orderkey % 4 as int) + 1, 1) as ref,
 substr('ACGT', cast((l_orderkey + l_linenumber) % 4 as int) + 1, 1) as alt, cast(cast(l_quantity as int) as varchar(10)) as qual,
 case l_returnflag when 'R' then 'q10' when 'A' then 'PASS' else '.' end as filter, concat('DP=', cast(cast(l_quantity as int) * 2 as varchar(10)), ';AF=0.0', cast(cast(round(l_tax * 100) as int) as varchar(10))) as info
from lineitem
"""


def _spark(sql: str) -> str:
    return sql.replace("IDIV", "div")


def _spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to as many partitions as there are cores, or more if its files give more: what follows is work per
    row, and neither a small file nor row groups larger than a split deal it. The rows pass a generator afterwards, as
    the optimiser would move filters, and their work with them, below the dealing and into the tasks of the scan."""
    n = max(df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(n).select(F.inline(F.array(F.struct(*df.columns))))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site columns of ``part``; ord follows the key."""
    part = _spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size"))
    return spark.sql(_spark(SITES.replace("from part", "from {part}")), part=part).withColumn("ord", F.col("k"))


def sites_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second call set."""
    return spark.sql(_spark(SITES_B), sites=sites(spark, sf_dir))


def line_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large site-only view."""
    return spark.sql(_spark(LINE_SITES.replace("from lineitem", "from {lineitem}")), lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with FORMAT and the samples' texts, made row by row: no shuffle. The texts come out of a generator, so that
    they are made once a row and not again for every mention in a filter."""
    df = sites(spark, sf_dir).withColumn("format", F.lit(FORMAT)).withColumn("numbers", F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint")))
    return df.select(*[c for c in df.columns if c != "numbers"], F.inline(F.array(F.struct(F.expr(_one_sample()).alias("samples")))))


def _one_sample() -> str:
    a = "(case when (k * 13 + s * s * 11 + (k % 9) * s) % 10 < k % 8 then 1 else 0 end)"
    b = "(case when (k * 17 + s * s * 3 + (k % 7) * s) % 10 < k % 8 then (case when k % 13 = 0 and s % 4 = 1 then 2 else 1 end) else 0 end)"
    gt = f"(case when (k * 7 + s * 5) % 19 = 0 then './.' when (k * 3 + s) % 37 = 0 then concat({a}, '/.') else concat({a}, case when s % 2 = 0 then '/' else '|' end, {b}) end)"
    n = "((k + s) % 60 + 1)"
    alt = f"(({n} * ((k + s) % 4)) div 4)"
    dp = f"(case when (k + s) % 31 = 0 then '.' else cast({n} as string) end)"
    ad = f"(case when (k + s) % 31 = 0 then '.' else concat({n} - {alt}, ',', {alt}) end)"
    return f"transform(numbers, s -> concat({gt}, ':', {dp}, ':', (k * 3 + s * 7) % 99, ':', {ad}))"
