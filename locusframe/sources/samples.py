"""Sample lists, population files and sample metadata: small files, read on the driver through Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SampleFileError(ValueError):
    """A sample, population or metadata file that cannot be used."""


def _lines(spark: SparkSession, path: str) -> list[str]:
    return [r[0].rstrip("\r") for r in spark.read.text(path).collect()]


def read_sample_list(spark: SparkSession, path: str) -> list[str]:
    """One id a line; blank lines and # lines are skipped."""
    return [x for line in _lines(spark, path) if (x := line.strip()) and not x.startswith("#")]


def read_populations(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Population -> samples from two columns (sample, population), in the order first seen, each sample once."""
    out: dict[str, list[str]] = {}
    for line in _lines(spark, path):
        words = line.split()
        if not words or words[0].startswith("#"):
            continue
        if len(words) < 2:
            raise SampleFileError(f"population line needs a sample and a population: {line!r}")
        own = out.setdefault(words[1], [])
        if words[0] not in own:
            own.append(words[0])
    return out


def population_places(names: list[str], pops: dict[str, list[str]]) -> dict[str, list[int]]:
    """Population -> places of its samples in the header; unknown samples raise."""
    at = {n: i for i, n in enumerate(names)}
    missing = [s for own in pops.values() for s in own if s not in at]
    if missing:
        raise SampleFileError(f"sample not found in the header: {', '.join(missing)}")
    return {p: sorted(at[s] for s in own) for p, own in pops.items()}


# fixed values: accepted names of the two columns
SAMPLE_NAMES = ("sample", "sample name", "sample_name", "sampleid", "sample_id", "indv", "iid")
POPULATION_NAMES = ("population", "population code", "population_code", "pop", "superpopulation", "super_pop")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(sample, population) of a table with a header line; ## lines are skipped, columns part at tabs or blanks."""
    lines = [x for x in _lines(spark, path) if x.strip() and not x.startswith("##")]
    if not lines:
        raise SampleFileError("metadata file is empty")
    cut = (lambda x: x.split("\t")) if "\t" in lines[0] else (lambda x: x.split())
    head = [c.strip().lstrip("#").lower() for c in cut(lines[0])]
    try:
        s, p = (next(head.index(n) for n in known if n in head) for known in (SAMPLE_NAMES, POPULATION_NAMES))
    except StopIteration:
        raise SampleFileError(f"metadata needs a sample and a population column, has {head}") from None
    rows = [(c[s].strip(), c[p].strip()) for c in map(cut, lines[1:]) if len(c) > max(s, p)]
    return spark.createDataFrame(rows, "sample string, population string").where((F.col("sample") != "") & (F.col("population") != ""))


def match_metadata(names: list[str], metadata: DataFrame, allow_unmatched: bool = False) -> DataFrame:
    """(sample_no, sample, population) of the header's samples; those without metadata raise unless allowed."""
    header = metadata.sparkSession.createDataFrame(list(enumerate(names)), "sample_no int, sample string")
    out = header.join(F.broadcast(metadata.dropDuplicates(["sample"])), "sample", "left").select("sample_no", "sample", "population")
    if not allow_unmatched:
        lost = [r["sample"] for r in out.where("population is null").limit(10).collect()]
        if lost:
            raise SampleFileError(f"samples without metadata: {', '.join(lost)}")
    return out.where("population is not null")
