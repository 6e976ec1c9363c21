"""Streams of VCF text: the predicate filter is stateless, per-chromosome counts keep their state in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import variant as v
from locusframe.plans import predicate as p


def read_stream(spark: SparkSession, folder: str, max_files: int = 8) -> DataFrame:
    """Records of VCF files as they arrive in a folder; header lines are left out."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).select(F.col("value").alias("line")).where("substring(line, 1, 1) <> '#' and line <> ''")
    parts = F.split(F.rtrim("line", F.lit("\r")), "\t", 10)
    at = lambda i: F.get(parts, F.lit(i))
    return raw.select("line", at(0).alias("chrom"), v.position(at(1)).alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), at(5).alias("qual"), at(6).alias("filter"), at(7).alias("info"), F.coalesce(at(8), F.lit("")).alias("format"), F.when(F.size(parts) > 9, F.split(at(9), "\t")).otherwise(F.array().cast("array<string>")).alias("samples"))


def filter_stream(records: DataFrame, where: str, sample_names: list[str] | None = None, sample: str | None = None) -> DataFrame:
    return records.where(p.compile_text(where, sample_names, sample))


def chromosome_counts(records: DataFrame) -> DataFrame:
    """Running counts by chromosome (update or complete mode)."""
    return records.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
