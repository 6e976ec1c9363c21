"""VCF text as DataFrames: plain, gzip and block-gzip files."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions import variant as v
from locusframe.sources import ranges


class VcfError(ValueError):
    """A file or region that cannot be read."""


@dataclass(frozen=True)
class Header:
    """Header lines as they stand in the file, and sample names in column order."""

    lines: list[str]
    samples: list[str]

    def contigs(self) -> list[str]:
        return [m[1] for line in self.lines if (m := re.match(r"##contig=<ID=([^,>]+)", line))]


@dataclass(frozen=True)
class Region:
    contig: str
    start: int | None = None
    end: int | None = None


def parse_region(text: str) -> Region:
    """contig or contig:start-end, 1-based and closed."""
    contig, colon, span = text.partition(":")
    if not contig:
        raise VcfError(f"region needs a contig: {text!r}")
    if not colon:
        return Region(contig)
    m = re.fullmatch("([0-9]+)-([0-9]+)", span)
    if not m or int(m[1]) < 1 or int(m[2]) < int(m[1]):
        raise VcfError(f"region must be contig:start-end with 1 <= start <= end: {text!r}")
    return Region(contig, int(m[1]), int(m[2]))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def read_header(spark: SparkSession, path: str) -> Header:
    """Lines up to the first record. Reads on from the file's start only as far as the header goes."""
    n = 64
    while True:
        head = [r[0] for r in _lines(spark, path).limit(n).collect()]
        lines = []
        for line in head:
            if not line.startswith("#"):
                break
            lines.append(line)
        if len(lines) < len(head) or len(head) < n:
            break
        n *= 8
    names = next((line.rstrip("\r").split("\t") for line in lines if line.startswith("#CHROM")), [])
    return Header(lines, names[9:])


def read_vcf(spark: SparkSession, path: str, *, late_headers: str = "skip", partitions: int | None = None, places: list[tuple[int, int | None]] | None = None, by_place: bool = False) -> DataFrame:
    """Records with ord, line and the site columns; see the class of problems below.

    ord ascends in file order: the byte where the split starts plus the record's number in it, which stays below
    the split's length.  A record of fewer than 8 columns or a blank line raises when its columns are read; lines
    with # after the first record are skipped, or raise if late_headers is "raise".  A block-gzip file is read by ranges,
    ord is then the line's place in it; other gzip files come in one task: ``partitions`` deals their records by ranges
    of ord afterwards.  ``by_place`` makes ord a place for a plain file too, ``places`` reads only such ranges.
    """
    blocked = path.endswith(".gz") and ranges.is_blocked(spark, path) and ranges.served(spark, path)
    if blocked or places is not None or by_place:
        raw = ranges.read_lines(spark, path, blocked, places).select(F.col("value").alias("line"), "ord")
    else:
        raw = _lines(spark, path).select(F.col("value").alias("line"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("ord"))
    hash_line = F.substring("line", 1, 1) == "#"
    if late_headers == "raise":
        first = raw.where(~hash_line).agg(F.min("ord")).first()[0]
        late = hash_line & (F.col("ord") > (first if first is not None else (1 << 62)))
        raw = raw.where(~hash_line | late)
    else:
        raw = raw.where(~hash_line)
    if partitions:
        raw = raw.repartitionByRange(partitions, "ord")
    body = F.rtrim(F.col("line"), F.lit("\r"))
    parts = F.split(body, "\t", 10)
    short = F.when((F.size(parts) < 8) & ~(hash_line if late_headers != "raise" else F.lit(False)), F.raise_error(F.concat(F.lit("VCF record has fewer than 8 columns: "), body)).cast("array<string>"))
    fields = F.coalesce(short, parts)
    at = lambda i: F.get(fields, F.lit(i))
    return raw.select(
        "ord", "line", at(0).alias("chrom"), v.position(at(1)).alias("pos"), at(1).alias("pos_raw"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"), at(5).alias("qual"), at(6).alias("filter"), at(7).alias("info"),
        F.coalesce(at(8), F.lit("")).alias("format"), F.when(F.size(fields) > 9, F.split(at(9), "\t")).otherwise(F.array().cast("array<string>")).alias("samples"),
    )


def checked_positions(df: DataFrame) -> DataFrame:
    """df with pos made to raise where its text is not a number, as summaries want it."""
    return df.withColumn("pos", F.when(F.col("pos").isNull(), F.raise_error(F.concat(F.lit("invalid POS: "), F.col("pos_raw"))).cast("bigint")).otherwise(F.col("pos")))


def any_header(spark: SparkSession, path: str) -> Header:
    """The header of a VCF file, or of a BCF file by its name."""
    if path.endswith(".bcf"):
        from locusframe.sources import bcf

        return bcf.read_header(spark, path)
    return read_header(spark, path)


def read_variants(spark: SparkSession, path: str, *, region: Region | None = None, header: Header | None = None) -> DataFrame:
    """read_vcf, or the BCF reader by the file's name, cut to a region whose contig the header must know."""
    if path.endswith(".bcf"):
        from locusframe.sources.bcf import read_bcf

        out = read_bcf(spark, path)
    else:
        out = read_vcf(spark, path)
    if region is None:
        return out
    known = (header or any_header(spark, path)).contigs()
    if known and region.contig not in known:
        raise VcfError(f"contig {region.contig!r} is not in the header")
    from locusframe.operators.sites import region as cut

    return cut(out, region.contig, region.start, region.end)
