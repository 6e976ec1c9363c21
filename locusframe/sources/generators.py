"""Synthetic variant tables by arithmetic on the row number: fixed rows for any size, made in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def synthetic_sites(spark: SparkSession, n: int) -> DataFrame:
    """Site-only records: chromosomes 1-22, QUAL 0-99, DP 1-80, AF 0.000-0.999, every 17th record filtered."""
    i = F.col("ord")
    pick = lambda letters: F.substring(F.lit(letters), (i % 4 + 1).cast("int"), F.lit(1))
    return spark.range(n).select(F.col("id").alias("ord")).select(
        "ord", (i % 22 + 1).cast("string").alias("chrom"), (i + 100000).alias("pos"), F.concat(F.lit("rs"), i).alias("id"), pick("ACGT").alias("ref"), pick("GTCA").alias("alt"),
        (i % 100).cast("string").alias("qual"), F.when(i % 17 == 0, "q10").otherwise("PASS").alias("filter"),
        F.concat(F.lit("DP="), i % 80 + 1, F.lit(";AF=0."), F.lpad((i % 1000).cast("string"), 3, "0")).alias("info"),
    )


def stress_cohort(spark: SparkSession, n: int, samples: int = 16, info_fields: int = 40) -> DataFrame:
    """synthetic_sites with many unused INFO entries and GT:DP:GQ:AD of each sample."""
    i = F.col("ord")
    unused = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(info_fields - 1)), lambda f: F.concat(F.lit("UNUSED"), f, F.lit("="), (i + f) % 997)), ";")

    def one(s):
        alt = F.when((i + s) % 3 == 0, 2).when((i + s) % 2 == 0, 1).otherwise(0)
        gt = F.get(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), alt)
        dp = (i + s) % 90 + 1
        return F.concat_ws(":", gt, dp.cast("string"), ((i + s) % 99).cast("string"), F.concat_ws(",", (dp - F.floor(dp * alt / 2)).cast("string"), F.floor(dp * alt / 2).cast("string")))

    df = synthetic_sites(spark, n)
    return df.withColumn("info", F.concat_ws(";", unused, "info")).withColumn("format", F.lit("GT:DP:GQ:AD")).withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), one))


def all_sites(spark: SparkSession, n: int = 5000, per_population: int = 20, missing: float = 0.15, variant: float = 0.45, seed: int = 7) -> DataFrame:
    """Every position of one contig, two populations of diploids, calls missing at random; fixed by the seed."""
    u = lambda *key: (F.pmod(F.xxhash64(F.lit(seed), "ord", *key), F.lit(1 << 30)) / float(1 << 30))
    df = spark.range(n).select(F.col("id").alias("ord"), F.lit("1").alias("chrom"), (F.col("id") + 1).alias("pos"), F.lit(".").alias("id"), F.lit("A").alias("ref"), F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), F.lit(".").alias("info"), F.lit("GT").alias("format"))
    is_variant = u(F.lit("v")) < variant
    share = u(F.lit("f"))
    allele = lambda s, k: F.when(is_variant & (u(F.lit(k), s) < share), "1").otherwise("0")
    sample = lambda s: F.when(u(F.lit("m"), s) < missing, "./.").otherwise(F.concat(allele(s, "a"), F.lit("/"), allele(s, "b")))
    return df.withColumn("alt", F.when(is_variant, "G").otherwise(".")).withColumn("samples", F.transform(F.sequence(F.lit(0), F.lit(2 * per_population - 1)), sample))
