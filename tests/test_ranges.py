"""Range reading of plain and block-gzip files against the lines that were written."""

import json
import random

import pytest

from locusframe.operators import popgen, sites as so
from locusframe.sources import ranges, sidecar, sinks, vcf

HEAD = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
KINDS = [("plain", ""), ("bgzf", ".gz")]


@pytest.mark.parametrize(("kind", "ending"), KINDS)
@pytest.mark.parametrize("longest", [0, 40, 70_000])
def test_every_split_gives_every_line_once(spark, tmp_path, kind, ending, longest):
    rng = random.Random(longest)
    lines = ["x" * rng.choice([0, longest // 2, longest]) + str(i) for i in range(400)] + ["", "é"]
    path = str(tmp_path / f"f{ending}")
    sinks.write_lines(path, lines, kind)
    size = (tmp_path / f"f{ending}").stat().st_size
    for split in (size + 1, size // 3, max(size // 40, 1)):
        got = ranges.read_lines(spark, path, kind == "bgzf", split=split).orderBy("ord").collect()
        assert [r["value"] for r in got] == lines
    at = [r["ord"] for r in got]
    some = ranges.read_lines(spark, path, kind == "bgzf", [(at[3], at[9]), (at[390], None)]).orderBy("ord").collect()
    assert [r["value"] for r in some] == lines[3:9] + lines[390:]


def test_no_last_line_feed_and_empty_file(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one\ntwo")
    assert [r["value"] for r in ranges.read_lines(spark, str(tmp_path / "a"), False, split=2).orderBy("ord").collect()] == ["one", "two"]
    (tmp_path / "b").write_bytes(b"")
    assert ranges.read_lines(spark, str(tmp_path / "b"), False).count() == 0
    assert not ranges.is_blocked(spark, str(tmp_path / "b")) and not ranges.is_blocked(spark, str(tmp_path))


@pytest.mark.parametrize(("kind", "ending"), KINDS)
def test_index_reads_only_kept_chunks(spark, tmp_path, kind, ending):
    rows = [f"7\t{i * 10}\t.\tC\tG\t{i % 50}\tPASS\tDP={i}" for i in range(1, 2001)]
    path, out = str(tmp_path / f"v.vcf{ending}"), str(tmp_path / "v.idx.json")
    sinks.write_lines(path, HEAD + rows, kind)
    sidecar.build(sidecar.records_by_place(spark, path), path, out, 100)
    df = vcf.read_vcf(spark, path)
    found, report = sidecar.indexed_filter(df, out, path, "POS > 19500")
    assert report["used"] and report["chunks_skipped"] == 19 and len(report["places"]) == 1
    assert [r["line"] for r in found.orderBy("ord").collect()] == rows[1950:]
    assert sorted(r["line"] for r in so.filter_sites(df, "POS > 19500").collect()) == sorted(rows[1950:])
    json.dumps(report)
    # rows outside the kept chunks are not read: one broken there goes unnoticed
    raw = ranges.read_lines(spark, path, kind == "bgzf", report["places"])
    assert raw.count() == 100


def test_diploid_biallelic(spark):
    rows = [("A", "C", ["0/1", "1|1"]), ("A", "C", ["./.", "0/0"]), ("A", "C,G", ["0/1", "0/0"]), ("A", "C", ["0/2", "0/0"]), ("A", "C", ["0", "0/0"])]
    df = spark.createDataFrame([(i, "1", i, *r[:2], "GT", r[2]) for i, r in enumerate(rows)], "ord bigint, chrom string, pos bigint, ref string, alt string, format string, samples array<string>")
    assert [r["ord"] for r in popgen.diploid_biallelic(df).orderBy("ord").collect()] == [0, 1]


def test_ordinals_follow_ord_whatever_the_partitions(spark):
    # more rows than range partitions are sampled by, in partitions out of order, with gaps that empty whole spans
    df = spark.range(0, 250_000, 1, 7).selectExpr("(250000 - id) * 97 + if(id < 1000, 90000000, 0) as was", "repeat('x', 60) as line").selectExpr("was as ord", "was", "line")
    got = sidecar.with_ordinals(df)
    wrong = got.selectExpr("ord", "lead(was) over (order by ord) as next", "was", "row_number() over (order by was) - 1 as place").where("ord is null or ord <> place or next <= was")
    assert got.count() == 250_000 and wrong.count() == 0
    assert [r["ord"] for r in sidecar.with_ordinals(df.where("was < 1000")).collect()] == list(range(df.where("was < 1000").count()))
    assert sidecar.with_ordinals(df.where("was < 0")).count() == 0
