import pytest

from locusframe.plans import predicate as p

ROWS = [
    ("6", 7, "31.5", "PASS", "DEPTH=17;BIAS=0.5,3;KIND=gain;NEW", "GT:RD:CALL:SCORE", ["0/1:6,14:ok:31", "1|1:0,9:weak:12", "./.:.:.:."]),
    ("6", 8, "9", "PASS", "DEPTH=60;BIAS=7;KIND=loss", "GT:RD:CALL:SCORE", ["0/0:25,1:ok:40", "0/1:12,11:ok:22", "0/0:30,0:ok:33"]),
    ("11", 9, "70", "shallow", "DEPTH=.;NOTE=;KIND=.", "GT:RD", ["0/1:2,2", ".", "1/1:1"]),
    ("11", 10, ".", ".", "DP=8.5;DP=77;AF=nan,0.25", "GT", ["1/1", "0|1", "0/0"]),
    ("MT", 11, "high", "PASS", ".", "", []),
]
NAMES = ["ada", "ben", "cho"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "chrom string, pos long, qual string, filter string, info string, format string, samples array<string>").cache()


@pytest.mark.parametrize("where, want", [
    ("QUAL > 30", [7, 9]), ("QUAL >= 9 && POS < 9", [7, 8]), ('FILTER != "PASS"', [9, 10]), ('CHROM == "11" || QUAL == 9', [8, 9, 10]),
    ("INFO/BIAS < 1", [7]), ("INFO/BIAS[0] > 6", [8]), ("INFO/BIAS[1] > 2", [7]), ("INFO/BIAS != 0.5", [7, 8]), ("INFO/DEPTH != 17", [8]),
    ('INFO/KIND != "gain"', [8]), ('INFO/NEW == "true" || INFO/NOTE == "" || INFO/DEPTH == "."', []), ('INFO/KIND > "a"', []), ('QUAL == "9"', []), ("CHROM == 11", []),
    ("DP == 8.5", [10]), ("DP > 70", []), ("AF != 0.25", [10]), ("AF == 0.25", [10]), ("AF[0] > 0", []), ("AF[0] != 0", [10]), ("AF[7] != 0", []),
    ("FORMAT/RD > 20", [8]), ('FORMAT/RD[1] > 10 && FORMAT/CALL == "ok"', [7]), ('FORMAT/GT == "0/1"', [7, 9]),
    ("ANY(FORMAT/RD > 20)", [8]), ('ALL(FORMAT/CALL != "weak")', [8]), ("ALL(FORMAT/SCORE >= 20)", [8]), ("ALL(FORMAT/XX != 1)", []),
    ("N_PASS(FORMAT/RD > 8) >= 2", [7, 8]), ("N_PASS(FORMAT/XX > 1) == 0", [7, 8, 9, 10, 11]), ("N_PASS(FORMAT/RD[1] > 10) < 1", [9, 10, 11]),
    ("(QUAL > 50 || QUAL < 10) && POS > 8", [9]), ("QUAL > 31 || QUAL < 10 && POS > 8", [7, 9]), ("POS > -1", [7, 8, 9, 10, 11]),
])
def test_rows(df, where, want):
    assert sorted(r.pos for r in df.where(p.compile_text(where, NAMES, "ada")).collect()) == want


@pytest.mark.parametrize("where, message", [
    ("FOO > 1", "unsupported field"), ("QUAL >", "expected literal"), ("QUAL 3", "expected operator"), ("> 3", "expected field"), ("QUAL > 3 4", "trailing"), ("(QUAL > 3", "expected '\\)'"),
    ("ANY(QUAL > 3)", "FORMAT field"), ("N_PASS(FORMAT/DP > 3)", "expected operator"), ('N_PASS(FORMAT/DP > 3) > "a"', "numeric literal"), ("DP[x] > 1", "invalid vector index"), ("INFO/[1] > 1", "malformed"),
    ("QUAL = 3", "expected operator"), ('FILTER == "PASS', "unterminated"), ("QUAL > 3 & POS > 1", "unexpected character"), ("QUAL > 1.2.3", "invalid numeric"), ("FORMAT/DP > 1", "--sample"), ("", "expected field"),
])
def test_errors(where, message):
    with pytest.raises(p.ExpressionError, match=message):
        p.compile_text(where)


def test_binding():
    with pytest.raises(p.ExpressionError, match="not found"):
        p.compile_text("FORMAT/DP > 1", ["A"], "B")
    with pytest.raises(p.ExpressionError, match="header with samples"):
        p.compile_text("ANY(FORMAT/DP > 1)", [])


def test_required_fields():
    need = p.required(p.parse('POS < 90 && (INFO/KIND == "x" || N_PASS(FORMAT/RD[0] > 2) > 1) && AF > 0.1'))
    assert need == {"chrom": False, "pos": True, "qual": False, "filter": False, "info": ["AF", "KIND"], "format": ["RD"]}


def test_comparisons_and_numbers_at_the_edges(spark):
    import math

    from pyspark.sql import functions as F

    from locusframe.functions import variant as v
    from locusframe.plans import predicate as p

    texts = ["1", "+.5", "1e3", "-2", "nan", "NaN", "inf", "-Infinity", "", ".", "x", "1x", "0x1", " 1", None, "20", "1d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    want = [None if t is None or not p.re.search(v.NUMBER, t) else float(t) for t in texts]
    for op in ("==", "!=", ">", ">=", "<", "<="):
        for x in (0.0, 1.0, 20.0, math.inf):
            got = [r[0] for r in df.select(p.compare(v.number(F.col("t")), op, x)).collect()]
            assert got == [w is not None and p._COMPARE[op](w, x) for w in want], (op, x)
