import gzip
import json
import math
import struct

import pytest

from locusframe import cli
from locusframe.operators import chunks, parity, sites as so
from locusframe.sources import bcf, generators, samples as sa, sidecar, sinks, vcf
from locusframe.streaming import variants as stream

EXAMPLE = """##fileformat=VCFv4.2
##contig=<ID=5>
##contig=<ID=12>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO
5\t1040\tv1\tG\tC\t71\tPASS\tDP=9;AF=0.4
5\t1100\tv2\tT\tG,A\t28.5\tweak\tDP=31;AF=0.125,0.0625
5\t2000\t.\tCA\tC\t.\tPASS\tDP=14
12\t77\tv4\tA\tG\t44\tPASS\tDP=3;AF=0.9
12\t901\tv5\tC\tT\t30\t.\tAF=.
"""
COHORT = """##fileformat=VCFv4.2
##contig=<ID=10>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tT1\tT2\tT3\tT4
10\t50\t.\tA\tT\t9\tPASS\t.\tGT\t0/1\t0/1\t0/0\t1/1
10\t90\t.\tG\tC\t8\tPASS\t.\tGT\t0/0\t./.\t0/1\t0/0
10\t300\t.\tT\tA\t7\tPASS\t.\tGT\t1/1\t0/1\t0/1\t0/0
"""
DOSES = [[1, 1, 0, 2], [0, None, 1, 0], [2, 1, 1, 0]]


@pytest.fixture
def example(tmp_path):
    path = tmp_path / "example.vcf"
    path.write_text(EXAMPLE)
    return str(path)


def run(spark, *argv):
    cli.run(spark, [str(a) for a in argv])


def body(path):
    return open(path).read().splitlines()


def test_read(spark, example):
    header = vcf.read_header(spark, example)
    assert len(header.lines) == 4 and header.samples == [] and header.contigs() == ["5", "12"]
    got = vcf.read_vcf(spark, example).orderBy("ord").collect()
    assert [r.pos for r in got] == [1040, 1100, 2000, 77, 901] and got[0].samples == [] and got[4].line.endswith("AF=.")


def test_filter_keeps_lines_and_order(spark, example, tmp_path):
    for compression, read in (("plain", open), ("gzip", gzip.open), ("bgzf", gzip.open)):
        out = tmp_path / f"out.{compression}"
        run(spark, "filter", example, "--where", "QUAL > 30", "--compression", compression, "-o", out)
        text = read(out, "rt").read().splitlines()
        assert text[:4] == EXAMPLE.splitlines()[:4] and [x.split("\t")[2] for x in text[4:]] == ["v1", "v4"]


def test_gzip_members_carriage_returns_and_regions(spark, tmp_path):
    path = tmp_path / "x.vcf.gz"
    head, tail = EXAMPLE.replace("\n", "\r\n").encode()[:220], EXAMPLE.replace("\n", "\r\n").encode()[220:]
    path.write_bytes(gzip.compress(head) + gzip.compress(tail))
    df = vcf.read_vcf(spark, str(path), partitions=3)
    assert sorted(r.info for r in df.collect())[:2] == ["AF=.", "DP=14"]
    assert df.orderBy("ord").first().line.endswith("\r")
    got = vcf.read_variants(spark, str(path), region=vcf.parse_region("12:70-100"))
    assert [r.pos for r in got.collect()] == [77]
    with pytest.raises(vcf.VcfError):
        vcf.read_variants(spark, str(path), region=vcf.parse_region("7"))
    for bad in ("", "1:", "1:5", "1:0-4", "1:9-4", "1:a-b"):
        with pytest.raises(vcf.VcfError):
            vcf.parse_region(bad)


def test_broken_records_raise(spark, tmp_path):
    path = tmp_path / "bad.vcf"
    path.write_text(EXAMPLE + "5\t5\tshort\n")
    with pytest.raises(Exception, match="fewer than 8 columns"):
        vcf.read_vcf(spark, str(path)).select("info").collect()
    path.write_text(EXAMPLE + "#late\n")
    assert vcf.read_vcf(spark, str(path)).count() == 5
    with pytest.raises(Exception, match="fewer than 8 columns"):
        vcf.read_vcf(spark, str(path), late_headers="raise").select("chrom").collect()


def test_stats(spark, example):
    df = vcf.read_vcf(spark, example)
    r = so.stats(df).first()
    assert (r.variants, r.snps, r.indels, r.missing_filter_values, r.qual_count, r.qual_min, r.qual_max, r.af_count, r.titv) == (5, 5, 1, 1, 4, 28.5, 71.0, 4, 2 / 3)
    assert {x.chrom: x.n for x in so.count_by(df, "chrom").collect()} == {"5": 3, "12": 2}
    empty = so.stats(df.where("false")).first()
    assert empty.variants == 0 and empty.snps == 0 and empty.qual_mean is None and empty.titv is None


def test_convert(spark, tmp_path):
    path = tmp_path / "edge.vcf"
    rows = ["3\t12\tq1\tC\tA\t55.5\tPASS\tDP=40;AF=0.75", "3\t19\t.\tG\tT\t.\tlow\tAF=0.1", "4\t8\tq3\tT\tA\t3\tPASS\tDP=2", "4\t30\tq4\tA\tG,T\t80\tPASS\tAF=0.2,0.3;DP=11"]
    path.write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n" + "\n".join(rows) + "\n")
    run(spark, "convert", path, "--to", "tsv", "-o", tmp_path / "o.tsv")
    assert body(tmp_path / "o.tsv")[0] == "CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO/DP\tINFO/AF"
    assert body(tmp_path / "o.tsv")[2:4] == ["3\t19\t.\tG\tT\t.\tlow\t.\t0.1", "4\t8\tq3\tT\tA\t3\tPASS\t2\t."]
    run(spark, "convert", path, "--to", "parquet", "-o", tmp_path / "o.parquet")
    out = spark.read.parquet(str(tmp_path / "o.parquet"))
    assert out.dtypes == [("CHROM", "string"), ("POS", "bigint"), ("ID", "string"), ("REF", "string"), ("ALT", "string"), ("QUAL", "double"), ("FILTER", "string"), ("INFO/DP", "bigint"), ("INFO/AF", "string")]
    assert [tuple(r) for r in out.orderBy("POS").select("QUAL", "`INFO/DP`", "`INFO/AF`").collect()] == [(3.0, 2, None), (55.5, 40, "0.75"), (None, None, "0.1"), (80.0, 11, "0.2,0.3")]
    plan = out.where("QUAL > 30").select("POS")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(QUAL,30.0)" in plan and "FILTER" not in plan.split("ReadSchema")[1]


def test_diff(spark, tmp_path, capsys):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    a, b, out = tmp_path / "a.vcf", tmp_path / "b.vcf", tmp_path / "d.tsv"
    a.write_text(head + "9\t15\tx1\tG\tT\t3\tPASS\t.\n9\t40\tboth\tA\tC\t4\tPASS\t.\nX\t7\tx3\tTG\tT\t5\tPASS\t.\n")
    b.write_text(head + "9\t40\tz\tA\tC\t8\tlow\t.\nX\t6\ty1\tC\tA\t.\tPASS\t.\n")
    run(spark, "diff", a, b, "-o", out)
    assert body(out) == ["status\tchrom\tpos\tref\talt", "only_in_a\t9\t15\tG\tT", "shared\t9\t40\tA\tC", "only_in_b\tX\t6\tC\tA", "only_in_a\tX\t7\tTG\tT"]
    assert "shared=1 only_in_a=2 only_in_b=1" in capsys.readouterr().err
    run(spark, "diff", a, b, "--key", "id-aware", "--mode", "only-a", "-o", out)
    assert [x.split("\t")[3] for x in body(out)[1:]] == ["x1", "both", "x3"]
    run(spark, "diff", a, b, "--key", "position", "--mode", "shared", "-o", out)
    assert body(out)[1:] == ["shared\t9\t40\t.\t."]


def tajima(shares, n=8):
    """Tajima (1989) from the share of the first allele at each site."""
    a1, a2, s = sum(1 / i for i in range(1, n)), sum(1 / i**2 for i in range(1, n)), len(shares)
    c1 = (n + 1) / (3 * (n - 1)) - 1 / a1
    c2 = 2 * (n * n + n + 3) / (9 * n * (n - 1)) - (n + 2) / (a1 * n) + a2 / a1**2
    return (sum(2 * p * (1 - p) * n / (n - 1) for p in shares) - s / a1) / math.sqrt(c1 / a1 * s + c2 / (a1**2 + a2) * s * (s - 1))


def r2(i, j):
    both = [(a, b) for a, b in zip(DOSES[i], DOSES[j]) if a is not None and b is not None]
    x, y = zip(*both)
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((a - mx) * (b - my) for a, b in both) ** 2 / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


def test_reports(spark, tmp_path):
    path, out = tmp_path / "c.vcf", tmp_path / "o.txt"
    path.write_text(COHORT)
    (tmp_path / "p1").write_text("T1\nT2\n# no\n\n")
    (tmp_path / "p2").write_text("T3\nT4\n")
    run(spark, "fst", path, "--pop", tmp_path / "p1", "--pop", tmp_path / "p2", "-o", out)
    assert body(out) == ["CHROM\tPOS\tHUDSON_FST", "10\t50\t-0.333333", "10\t90\t0", "10\t300\t0.2"]
    run(spark, "tajima-d", path, "--window-size", 200, "-o", out)
    assert [x.split("\t")[:3] for x in body(out)[1:]] == [["10", "0", "2"], ["10", "200", "1"]]
    assert [float(x.split("\t")[3]) for x in body(out)[1:]] == pytest.approx([tajima([4 / 8, 5 / 6]), tajima([4 / 8])], abs=1e-6)
    run(spark, "ld", path, "--max-distance", 250, "-o", out)
    assert [x.split("\t")[:4] for x in body(out)[1:]] == [["10", "50", "90", "3"], ["10", "50", "300", "4"], ["10", "90", "300", "3"]]
    assert [float(x.split("\t")[4]) for x in body(out)[1:]] == pytest.approx([r2(0, 1), r2(0, 2), r2(1, 2)], abs=1e-6)
    run(spark, "missingness", path, "-o", tmp_path / "m.txt")
    assert body(tmp_path / "m.lmiss")[2] == "10\t90\t8\t0\t2\t0.25" and body(tmp_path / "m.imiss")[2] == "T2\t3\t0\t1\t0.333333"
    run(spark, "freq", path, "--keep", tmp_path / "p2", "-o", out)
    assert body(out)[2] == "10\t90\t2\t4\tG:0.75\tC:0.25"
    (tmp_path / "pops").write_text("T1 P1\nT2 P1\nT3 P2\nT4 P2\n")
    run(spark, "pixy", path, "--populations", tmp_path / "pops", "--window-size", 1000, "--out-pi", out, "--out-dxy", tmp_path / "dxy")
    assert body(out)[0].startswith("pop\tchromosome") and len(body(out)) == 3 and len(body(tmp_path / "dxy")) == 2
    for name, extra in (("hardy", []), ("het", []), ("pi", []), ("pi", ["--window-size", 200]), ("sfs", []), ("sfs", ["--folded"])):
        run(spark, name, path, *extra, "-o", out)
        assert len(body(out)) > 2


def test_chunks_prune_without_loss(spark, example, tmp_path):
    n = 2000
    df = generators.synthetic_sites(spark, n).withColumn("filter", generators.F.when(generators.F.col("ord") < 1000, "PASS").otherwise("low"))
    stats = chunks.chunk_stats(df, 100, ("DP", "AF")).cache()
    for where in ("POS > 101900", 'FILTER == "low" && POS < 101100', "AF >= 0.99", "QUAL > 200", "DP != 3", 'CHROM == "99"', "POS < 100050 || POS > 101950", 'FILTER != "PASS"'):
        whole = sorted(r.pos for r in so.filter_sites(df, where).collect())
        assert sorted(r.pos for r in chunks.pruned_filter(df, stats, where, 100, 0.0).collect()) == whole
    assert chunks.skip_report(stats, "QUAL > 200")["skip_rate"] == 1.0
    assert chunks.skip_report(stats, "POS > 101900")["chunks_skipped"] == 19


def test_index_sidecar(spark, example, tmp_path):
    out = tmp_path / "i.json"
    run(spark, "index", example, "-o", out, "--chunk-records", 2)
    made = json.loads(out.read_text())
    assert made["record_count"] == 5 and [c["qual_min"] for c in made["chunks"]] == [28.5, 44.0, 30.0]
    df = vcf.read_vcf(spark, example)
    kept, report = sidecar.indexed_filter(df, str(out), example, "QUAL > 50", min_skip_rate=0.5)
    assert report["used"] and report["chunks_skipped"] == 2 and [r.id for r in kept.collect()] == ["v1"]
    assert not sidecar.indexed_filter(df, str(out), example, "QUAL > 1")[1]["used"]
    out.write_text(out.read_text().replace('"record_count": 5', '"record_count": 6'))
    assert sidecar.load(str(out), example) is None


def test_block_gzip_in_many_blocks(tmp_path):
    w = sinks.BlockGzipWriter(str(tmp_path / "x.gz"))
    data = b"".join(b"%d line\n" % i for i in range(40_000))
    w.write(data)
    w.close()
    assert gzip.open(tmp_path / "x.gz").read() == data


def bcf_file(path):
    """Three sites of contig 7 with samples A, B, C."""
    header = '##fileformat=VCFv4.2\n##FILTER=<ID=PASS,Description="ok",IDX=0>\n##INFO=<ID=DP,Number=1,IDX=1>\n##FORMAT=<ID=GT,Number=1,IDX=2>\n##contig=<ID=7,IDX=0>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC\n\0'.encode()
    text = lambda s: bytes([len(s) << 4 | 7]) + s.encode()
    out = b"BCF\x02\x02" + struct.pack("<I", len(header)) + header
    for pos, name, qual, depth, calls in ((99, "s1", 31.5, 12, [2, 4, 4, 4, 0, 0]), (149, "s2", 8.0, 40, [2, 2, 2, 5, 2, 4]), (160, ".", 50.0, 7, [4, 4, 4, 4, 2, 4])):
        shared = struct.pack("<iiifII", 0, pos, 1, qual, 2 << 16 | 1, 1 << 24 | 3) + text(name) + text("A") + text("G") + bytes([0x11, 0]) + bytes([0x11, 1, 0x11, depth])
        own = bytes([0x11, 2, 0x21, *calls])
        out += struct.pack("<II", len(shared), len(own)) + shared + own
    path.write_bytes(gzip.compress(out))


SAME = """##fileformat=VCFv4.2
##FILTER=<ID=PASS,Description="ok">
##INFO=<ID=DP,Number=1>
##FORMAT=<ID=GT,Number=1>
##contig=<ID=7>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\tC
7\t100\ts1\tA\tG\t31.5\tPASS\tDP=12\tGT\t0/1\t1/1\t./.
7\t150\ts2\tA\tG\t8\tPASS\tDP=40\tGT\t0/0\t0|1\t0/1
7\t161\t.\tA\tG\t50\tPASS\tDP=7\tGT\t1/1\t1/1\t0/1
"""


def test_bcf_gives_what_its_vcf_gives(spark, tmp_path, capsys):
    bcf_file(tmp_path / "x.bcf")
    (tmp_path / "x.vcf").write_text(SAME)
    assert "\n".join(r.line for r in bcf.read_bcf(spark, str(tmp_path / "x.bcf")).orderBy("ord").collect()) + "\n" == "".join(SAME.splitlines(True)[6:])
    remote = bcf.read_bcf(spark, f"file://{tmp_path}/x.bcf", through_spark=True)
    assert [r.pos for r in remote.orderBy("ord").collect()] == [100, 150, 161]
    (tmp_path / "keep").write_text("C\nA\n")
    commands = [["filter", "--where", 'ANY(FORMAT/GT == "0/1") && QUAL > 20'], ["filter", "--where", 'FORMAT/GT == "0/1"', "--sample", "C", "--region", "7:120-400"], ["freq"], ["freq", "--keep", tmp_path / "keep"], ["hardy"], ["het"], ["pi"], ["ld"], ["sfs"], ["convert", "--to", "tsv"]]
    for name, *rest in commands:
        found = []
        for kind in ("bcf", "vcf"):
            run(spark, name, tmp_path / f"x.{kind}", *rest, "-o", tmp_path / f"o.{kind}")
            found.append((tmp_path / f"o.{kind}").read_text())
        assert found[0] == found[1] and len(found[0].splitlines()) > 1, name
    capsys.readouterr()
    run(spark, "stats", tmp_path / "x.bcf")
    one = capsys.readouterr().out
    run(spark, "stats", tmp_path / "x.vcf")
    assert capsys.readouterr().out == one
    with pytest.raises(vcf.VcfError):
        run(spark, "stats", tmp_path / "x.bcf", "--region", "8")


def test_metadata(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("## note\nSample name\tPopulation code\nS1\tP1\nS2\tP2\nS9\tP9\n")
    meta = sa.read_metadata(spark, str(path))
    got = sa.match_metadata(["S1", "S2"], meta).orderBy("sample_no").collect()
    assert [(r["sample"], r.population) for r in got] == [("S1", "P1"), ("S2", "P2")]
    with pytest.raises(sa.SampleFileError, match="S3"):
        sa.match_metadata(["S1", "S3"], meta)
    assert sa.match_metadata(["S1", "S3"], meta, True).count() == 1


def test_generators_and_parity(spark):
    a = generators.all_sites(spark, 200)
    assert a.count() == 200 and a.subtract(generators.all_sites(spark, 200)).isEmpty()
    assert generators.stress_cohort(spark, 5).first().samples[0] == "1/1:1:0:0,1"
    left = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", float("nan")), ("c", 1.0)], "k string, x double")
    right = spark.createDataFrame([("a", 2.0), ("a", 1.0000001), ("b", None), ("d", 1.0)], "k string, x double")
    got = {(r.k, r.problem) for r in parity.compare_tables(left, right, ["k"], {"x": 1e-5}).collect()}
    assert got == {("c", "only in a"), ("d", "only in b")}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.vcf").write_text(EXAMPLE)
    kept = stream.filter_stream(stream.read_stream(spark, str(tmp_path / "in")), "QUAL > 30")
    q = kept.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.sql("select id from kept").collect()) == ["v1", "v4"]


@pytest.mark.parametrize("kind", ["plain", "gzip", "bgzf"])
def test_writers_keep_rows_off_the_driver(spark, tmp_path, monkeypatch, kind):
    df = spark.range(0, 30_000, 1, 6).selectExpr("30000 - id as ord", "concat('line ', 30000 - id) as line")
    monkeypatch.setattr(type(df), "toLocalIterator", lambda *a, **k: pytest.fail("rows fetched"))
    path = tmp_path / "x.gz"
    sinks.write_vcf(df, ["#a", "#b"], str(path), kind)
    want = "".join(f"{x}\n" for x in ["#a", "#b", *(f"line {i}" for i in range(1, 30_001))]).encode()
    data = path.read_bytes()
    assert (data if kind == "plain" else gzip.decompress(data)) == want
    assert (data[-28:] == sinks.BlockGzipWriter._END) == (kind == "bgzf") and data.count(sinks.BlockGzipWriter._END) == (kind == "bgzf")
    sinks.write_vcf(df.where("ord < 0"), ["#a"], str(path), kind)
    assert (path.read_bytes() if kind == "plain" else gzip.decompress(path.read_bytes())) == b"#a\n"
    sinks.write_tsv(df.where("ord < 3"), str(tmp_path / "t"), "plain")
    assert (tmp_path / "t").read_text() == "line\nline 1\nline 2\n"
    assert [p.name for p in tmp_path.iterdir() if "parts" in p.name] == []


def test_filters_stay_above_the_dealing_of_rows(spark, tmp_path):
    from locusframe import queries as q

    spark.range(0, 500, 1, 1).selectExpr("id as p_partkey", "cast(id % 50 + 1 as int) as p_size").write.parquet(str(tmp_path / "part.parquet"))
    for name in ("filter_qual_pass", "filter_format_sample", "filter_npass", "filter_any", "filter_all", "tajima_d", "fst_wc"):
        plan = q.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan and all(" Filter" not in part.split("Relation")[0] for part in plan.split("Repartition")[1:]), name


def test_parquet_export_bounds_the_rows_of_a_task(spark, tmp_path):
    df = spark.range(0, 40_000, 1, 2).selectExpr("concat('chr', id % 3) as CHROM", "40000 - id as POS", "id")
    sinks.write_parquet(df, str(tmp_path / "p"), rows=5_000)
    out = spark.read.parquet(str(tmp_path / "p"))
    files = [f for f in (tmp_path / "p").iterdir() if f.suffix == ".parquet"]
    assert sorted(r["id"] for r in out.collect()) == list(range(40_000)) and len(files) == 8
    for f in files:
        keys = [(r["CHROM"], r["POS"]) for r in spark.read.parquet(str(f)).coalesce(1).collect()]
        assert keys == sorted(keys) and len(keys) < 6_000
