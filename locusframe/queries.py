"""Registered queries over the variant views of the driver's tables, and their DuckDB SQL.

The SQL starts from the genotype and site expressions, not from anything the engine made, so parsing, counting and
formulas are all held against it.  Ratios are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import chunks, popgen, sites as so
from locusframe.sources import tables as t

POPS = {"P1": list(range(8)), "P2": list(range(8, 16))}
WINDOW = 200
SITE = ["chrom", "pos", "id", "ref", "alt", "qual", "filter"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _duck(sql: str) -> str:
    return sql.replace("IDIV", "//")


_CTE = _duck(f"""WITH sites AS ({t.SITES}), samples AS (SELECT range AS s FROM range(16)),
gts AS MATERIALIZED ({t.GENOTYPES.format(sites="sites", samples="samples")}),
svals AS ({t.SAMPLE_VALUES.format(gts="gts")}),
sitesb AS ({t.SITES_B.format(sites="sites")}),
linesites AS ({t.LINE_SITES}),
info AS (SELECT *, regexp_extract(info, '(?:^|;)DP=([^;]*)', 1) AS dp, regexp_extract(info, '(?:^|;)AF=([^;]*)', 1) AS af, regexp_extract(info, '(?:^|;)MQ=([^;]*)', 1) AS mq FROM sites),
sv AS (SELECT k, s, string_split(sv, ':') AS f FROM svals),
calls AS (SELECT k, s, gt, CASE WHEN gt LIKE '%.%' THEN NULL ELSE list_transform(regexp_split_to_array(gt, '[/|]'), lambda x: x::INT) END AS g FROM gts),
labels AS (SELECT k, chrom, pos, 1 + len(string_split(alt, ',')) AS n_alleles FROM sites),
each AS (SELECT c.k, c.s, unnest(c.g) AS a FROM calls c WHERE g IS NOT NULL),
ac AS (SELECT l.k, l.chrom, l.pos, l.n_alleles, count(e.a) AS n, count(e.a) FILTER (e.a = 0) AS c0, count(e.a) FILTER (e.a = 1) AS c1, count(e.a) FILTER (e.a = 2) AS c2
  FROM labels l LEFT JOIN each e ON e.k = l.k AND e.a < l.n_alleles GROUP BY ALL),
pac AS (SELECT l.k, l.chrom, l.pos, p.p, count(e.a) AS n, count(e.a) FILTER (e.a = 0) AS c0, count(e.a) FILTER (e.a = 1) AS c1, count(e.a) FILTER (e.a = 2) AS c2
  FROM labels l CROSS JOIN (VALUES ('P1'), ('P2')) p(p) LEFT JOIN each e ON e.k = l.k AND e.a < l.n_alleles AND (CASE WHEN e.s < 8 THEN 'P1' ELSE 'P2' END) = p.p GROUP BY ALL)
""")


def register(name: str, sql: str | None, cte: bool = True):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = (_CTE if cte else "") + sql
        return f

    return add


def _filter(name: str, where: str, sql: str, cohort: bool = False, sample: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = t.cohort(spark, sf_dir) if cohort else t.sites(spark, sf_dir)
        return so.filter_sites(df, where, t.SAMPLES if cohort else None, sample).select(SITE)

    register(name, f"SELECT chrom, pos, id, ref, alt, qual, filter FROM info WHERE {sql}")(run)


_num = "try_cast({} AS DOUBLE)".format
_filter("filter_qual_pass", 'QUAL > 30 && FILTER == "PASS"', f"{_num('qual')} > 30 AND filter = 'PASS'")
_filter("filter_info_any", "INFO/AF < 0.1", "len(list_filter(string_split(af, ','), lambda x: x::DOUBLE < 0.1)) > 0")
_filter("filter_info_index", "AF[1] >= 0.05", "try_cast(string_split(af, ',')[2] AS DOUBLE) >= 0.05")
_filter("filter_info_string", 'INFO/MQ == "35"', "mq = '35'")
_filter("filter_missing_ne", "INFO/MQ != 40", f"mq <> '.' AND {_num('mq')} <> 40")
_filter("filter_or_parens", '(QUAL >= 45 || DP < 10) && CHROM != "chr2" && POS > 100', f"({_num('qual')} >= 45 OR dp::DOUBLE < 10) AND chrom <> 'chr2' AND pos > 100")
_filter("filter_format_sample", 'FORMAT/GT == "0/1" && FORMAT/DP > 20', "k IN (SELECT k FROM sv WHERE s = 2 AND f[1] = '0/1' AND try_cast(f[2] AS DOUBLE) > 20)", True, "S2")
_filter("filter_any", "ANY(FORMAT/DP > 55)", "k IN (SELECT k FROM sv WHERE try_cast(f[2] AS DOUBLE) > 55)", True)
_filter("filter_all", "ALL(FORMAT/GQ >= 3)", "k IN (SELECT k FROM sv GROUP BY k HAVING bool_and(try_cast(f[3] AS DOUBLE) >= 3))", True)
_filter("filter_npass", "N_PASS(FORMAT/AD[1] > 20) >= 8", "k IN (SELECT k FROM sv WHERE try_cast(string_split(f[4], ',')[2] AS DOUBLE) > 20 GROUP BY k HAVING count(*) >= 8)", True)


@register("region_filter", "SELECT chrom, pos, id, ref, alt, qual, filter FROM sites WHERE chrom = 'chr2' AND pos <= 2000 AND pos + length(ref) - 1 >= 500")
def region_filter(spark, sf_dir):
    return so.region(t.sites(spark, sf_dir), "chr2", 500, 2000).select(SITE)


_TEXT = "SELECT chrom AS CHROM, pos::VARCHAR AS POS, id AS ID, ref AS REF, alt AS ALT, qual AS QUAL, filter AS FILTER, dp AS \"INFO/DP\", af AS \"INFO/AF\" FROM info"


@register("convert_tsv", _TEXT)
def convert_tsv(spark, sf_dir):
    return so.export_text(t.sites(spark, sf_dir))


_TYPED = "SELECT chrom AS CHROM, pos AS POS, id AS ID, ref AS REF, alt AS ALT, nullif(qual, '.')::DOUBLE AS QUAL, filter AS FILTER, dp::BIGINT AS \"INFO/DP\", af AS \"INFO/AF\" FROM info"


@register("convert_parquet_typed", _TYPED)
def convert_parquet_typed(spark, sf_dir):
    return so.export_typed(t.sites(spark, sf_dir))


_LINE = _duck(f"WITH v AS (SELECT *, nullif(qual, '.')::DOUBLE AS q, regexp_extract(info, 'DP=([^;]*)', 1)::BIGINT AS dp FROM ({t.LINE_SITES}) x) ")


def _export_query(name: str, key: str, sql: str) -> None:
    register(name, _LINE + sql, cte=False)(lambda spark, sf_dir: so.query_export(so.export_typed(t.line_sites(spark, sf_dir)), key))


_export_query("sql_row_count", "row_count", "SELECT count(*) AS n FROM v")
_export_query("sql_qual_gt_30", "qual_gt_30", "SELECT count(*) AS n FROM v WHERE q > 30")
_export_query("sql_dp_gt_40", "dp_gt_40", "SELECT count(*) AS n FROM v WHERE dp > 40")
_export_query("sql_filter_pass", "filter_pass", "SELECT count(*) AS n FROM v WHERE filter = 'PASS'")
_export_query("sql_group_chrom_filter", "group_chrom_filter", "SELECT chrom AS CHROM, filter AS FILTER, count(*) AS n FROM v GROUP BY ALL")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    # adding 0.0 turns -0.0 into 0.0
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


_R = "round({}, 6) + 0.0".format


@register("stats_summary", f""", alts AS (SELECT k, ref, unnest(string_split(alt, ',')) AS a FROM sites),
kinds AS (SELECT count(*) FILTER (length(ref) = 1 AND length(a) = 1) AS snps, count(*) FILTER (NOT (length(ref) = 1 AND length(a) = 1)) AS indels,
  count(*) FILTER (ref || a IN ('AG','GA','CT','TC')) AS ti FROM alts),
afs AS (SELECT unnest(string_split(af, ','))::DOUBLE AS x FROM info)
SELECT (SELECT count(*) FROM sites) AS variants, snps, indels, (SELECT count(*) FROM sites WHERE filter = '.') AS missing_filter_values,
 (SELECT count(q) FROM (SELECT try_cast(qual AS DOUBLE) q FROM sites)) AS qual_count, (SELECT min(q) FROM (SELECT try_cast(qual AS DOUBLE) q FROM sites)) AS qual_min,
 (SELECT max(q) FROM (SELECT try_cast(qual AS DOUBLE) q FROM sites)) AS qual_max, (SELECT {_R('avg(q)')} FROM (SELECT try_cast(qual AS DOUBLE) q FROM sites)) AS qual_mean,
 (SELECT count(*) FROM afs) AS af_count, (SELECT min(x) FROM afs) AS af_min, (SELECT max(x) FROM afs) AS af_max, (SELECT {_R('avg(x)')} FROM afs) AS af_mean,
 {_R('ti::DOUBLE / (snps - ti)')} AS titv FROM kinds""")
def stats_summary(spark, sf_dir):
    return _rounded(so.stats(t.sites(spark, sf_dir)), "qual_mean", "af_mean", "titv")


@register("stats_by_chrom", "SELECT chrom, count(*) AS n FROM linesites GROUP BY chrom")
def stats_by_chrom(spark, sf_dir):
    return so.count_by(t.line_sites(spark, sf_dir), "chrom")


@register("stats_by_filter", "SELECT filter, count(*) AS n FROM linesites GROUP BY filter")
def stats_by_filter(spark, sf_dir):
    return so.count_by(t.line_sites(spark, sf_dir), "filter")


def _diff_sql(on: list[str], where: str = "true") -> str:
    keys = ", ".join(on)
    return f""", a AS (SELECT DISTINCT {keys}, 1 AS x FROM sites), b AS (SELECT DISTINCT {keys}, 1 AS y FROM sitesb),
d AS (SELECT CASE WHEN x IS NULL THEN 'only_in_b' WHEN y IS NULL THEN 'only_in_a' ELSE 'shared' END AS status, {keys} FROM a FULL JOIN b USING ({keys})) SELECT * FROM d WHERE {where}"""


def _diff(name: str, key: str, mode: str, where: str = "true") -> None:
    register(name, _diff_sql(so.KEYS[key], where))(lambda spark, sf_dir: so.diff(t.sites(spark, sf_dir), t.sites_b(spark, sf_dir), key, mode))


_diff("diff_all", "chrom-pos-ref-alt", "all")
_diff("diff_shared", "chrom-pos-ref-alt", "shared", "status = 'shared'")
_diff("diff_only_a", "chrom-pos-ref-alt", "only-a", "status = 'only_in_a'")
_diff("diff_only_b", "chrom-pos-ref-alt", "only-b", "status = 'only_in_b'")
_diff("diff_position", "position", "all")
_diff("diff_id_aware", "id-aware", "all")


@register("diff_counts", _diff_sql(so.KEYS["chrom-pos-ref-alt"]).replace("SELECT * FROM d WHERE true", "SELECT count(*) FILTER (status = 'shared') AS shared, count(*) FILTER (status = 'only_in_a') AS only_in_a, count(*) FILTER (status = 'only_in_b') AS only_in_b FROM d"))
def diff_counts(spark, sf_dir):
    return so.diff_counts(t.sites(spark, sf_dir), t.sites_b(spark, sf_dir))


_CHUNK = 256
_CHUNKS_SQL = f""", c AS (SELECT k // {_CHUNK} AS chunk, *, try_cast(qual AS DOUBLE) AS q FROM info), afs AS (SELECT chunk, unnest(string_split(af, ','))::DOUBLE AS x FROM c),
a AS (SELECT chunk, min(x) AS af_min, max(x) AS af_max FROM afs GROUP BY chunk),
st AS (SELECT chunk, min(k) AS first_record, count(*) AS record_count, string_agg(DISTINCT chrom, ',' ORDER BY chrom) AS chroms, min(pos) AS pos_min, max(pos) AS pos_max, min(q) AS qual_min, max(q) AS qual_max,
  string_agg(DISTINCT filter, ',' ORDER BY filter) AS filters, min(dp::DOUBLE) AS dp_min, max(dp::DOUBLE) AS dp_max FROM c GROUP BY chunk) """


@register("index_chunks", _CHUNKS_SQL + "SELECT st.*, af_min, af_max FROM st JOIN a USING (chunk)")
def index_chunks(spark, sf_dir):
    out = chunks.chunk_stats(t.sites(spark, sf_dir), _CHUNK)
    return out.select("chunk", "first_record", "record_count", F.array_join("chroms", ",").alias("chroms"), "pos_min", "pos_max", "qual_min", "qual_max", F.array_join("filters", ",").alias("filters"), F.col("DP_min").alias("dp_min"), F.col("DP_max").alias("dp_max"), F.col("AF_min").alias("af_min"), F.col("AF_max").alias("af_max"))


_PLAN = 'POS > 3000 && AF < 0.11'


@register("index_plan", _CHUNKS_SQL + "SELECT chunk, record_count, pos_max <= 3000 OR af_min >= 0.11 AS skip FROM st JOIN a USING (chunk)")
def index_plan(spark, sf_dir):
    return chunks.plan(chunks.chunk_stats(t.sites(spark, sf_dir), _CHUNK), _PLAN)


@register("index_pruned_filter", "SELECT chrom, pos, id, ref, alt, qual, filter FROM info WHERE pos > 4300")
def index_pruned_filter(spark, sf_dir):
    df = t.sites(spark, sf_dir)
    return chunks.pruned_filter(df, chunks.chunk_stats(df, _CHUNK), "POS > 4300", _CHUNK).select(SITE)


def _freq_sql(ac: str) -> str:
    f = lambda i: f"round(CASE WHEN {i} < n_alleles AND n > 0 THEN c{i} / n::DOUBLE END, 6) + 0.0"
    return f"SELECT chrom, pos, n_alleles, n AS n_chr, {f(0)} AS f0, {f(1)} AS f1, {f(2)} AS f2 FROM {ac}"


def _freqs(df: DataFrame) -> DataFrame:
    return _rounded(df.select("chrom", "pos", F.col("n_alleles").cast("bigint").alias("n_alleles"), "n_chr", *[F.get("freqs", F.lit(i)).alias(f"f{i}") for i in range(3)]), "f0", "f1", "f2")


@register("freq", _freq_sql("ac"))
def freq(spark, sf_dir):
    return _freqs(popgen.freq(t.cohort(spark, sf_dir)))


@register("sample_keep_remove_freq", """, kept AS (SELECT l.k, l.chrom, l.pos, l.n_alleles, count(e.a) AS n, count(e.a) FILTER (e.a = 0) AS c0, count(e.a) FILTER (e.a = 1) AS c1, count(e.a) FILTER (e.a = 2) AS c2
  FROM labels l LEFT JOIN each e ON e.k = l.k AND e.a < l.n_alleles AND e.s IN (1, 5, 9) GROUP BY ALL) """ + _freq_sql("kept"))
def sample_keep_remove_freq(spark, sf_dir):
    return _freqs(popgen.freq(t.cohort(spark, sf_dir), popgen.selection(t.SAMPLES, ["S1", "S3", "S5", "S9"], ["S3", "S4"])))


_SLOTS = ", slots AS (SELECT k, s, len(regexp_split_to_array(gt, '[/|]')) AS n, len(list_filter(regexp_split_to_array(gt, '[/|]'), lambda x: x IN ('', '.'))) AS m FROM gts) "


@register("missing_site", _SLOTS + f"SELECT chrom, pos, sum(n)::BIGINT AS n_data, sum(m)::BIGINT AS n_miss, {_R('sum(m) / sum(n)::DOUBLE')} AS f_miss FROM slots JOIN labels USING (k) GROUP BY k, chrom, pos")
def missing_site(spark, sf_dir):
    return _rounded(popgen.missing_by_site(t.cohort(spark, sf_dir)).drop("ord"), "f_miss")


@register("missing_sample", _SLOTS + f"SELECT 'S' || s AS sample, count(*) AS n_data, count(*) FILTER (m > 0) AS n_miss, {_R('count(*) FILTER (m > 0) / count(*)::DOUBLE')} AS f_miss FROM slots GROUP BY s")
def missing_sample(spark, sf_dir):
    return _rounded(popgen.missing_by_sample(t.cohort(spark, sf_dir), t.SAMPLES).drop("sample_no"), "f_miss")


_HARDY = """, dip AS (SELECT k, count(*) FILTER (g[1] + g[2] = 0) AS o0, count(*) FILTER (g[1] + g[2] = 1) AS o1, count(*) FILTER (g[1] + g[2] = 2) AS o2 FROM calls WHERE len(g) = 2 AND g[1] <= 1 AND g[2] <= 1 GROUP BY k),
h AS (SELECT chrom, pos, o0, o1, o2, (o0 + o1 + o2)::DOUBLE AS c, c0 / n::DOUBLE AS p, c1 / n::DOUBLE AS q FROM ac JOIN dip USING (k) WHERE n_alleles = 2 AND n > 0) """


@register("hardy", _HARDY + f"""SELECT chrom, pos, o0 AS obs_hom_ref, o1 AS obs_het, o2 AS obs_hom_alt, {_R('c*p*p')} AS e_hom_ref, {_R('c*2*p*q')} AS e_het, {_R('c*q*q')} AS e_hom_alt,
 {_R('CASE WHEN c*p*p > 0 THEN (o0-c*p*p)**2/(c*p*p) ELSE 0 END + CASE WHEN c*2*p*q > 0 THEN (o1-c*2*p*q)**2/(c*2*p*q) ELSE 0 END + CASE WHEN c*q*q > 0 THEN (o2-c*q*q)**2/(c*q*q) ELSE 0 END')} AS chisq FROM h""")
def hardy(spark, sf_dir):
    return _rounded(popgen.hardy(t.cohort(spark, sf_dir)).drop("ord"), "e_hom_ref", "e_het", "e_hom_alt", "chisq")


_PI = "n / (n - 1)::DOUBLE * (1 - (c0 / n::DOUBLE) ** 2 - (c1 / n::DOUBLE) ** 2 - (CASE WHEN n_alleles > 2 THEN c2 ELSE 0 END / n::DOUBLE) ** 2)"


@register("het", f""", x AS (SELECT c.s, g[1] = g[2] AS hom, 1 - ({_PI}) AS e FROM calls c JOIN ac USING (k) WHERE n_alleles = 2 AND n >= 2 AND len(g) = 2 AND g[1] <= 1 AND g[2] <= 1)
SELECT 'S' || s AS sample, count(*) FILTER (hom) AS o_hom, {_R('sum(e)')} AS e_hom, count(*) AS n_sites, {_R('(count(*) FILTER (hom) - sum(e)) / (count(*) - sum(e))')} AS f FROM x GROUP BY s""")
def het(spark, sf_dir):
    return _rounded(popgen.het(t.cohort(spark, sf_dir), t.SAMPLES).drop("sample_no"), "e_hom", "f")


_FST = """, ok AS (SELECT k, (CASE WHEN s < 8 THEN 1 ELSE 2 END) AS p, g FROM calls WHERE g IS NOT NULL AND len(list_filter(g, lambda x: x > 1)) = 0),
pp AS (SELECT k, p, sum(len(g)) AS n, sum(len(list_filter(g, lambda x: x = 1)))::DOUBLE AS a, count(*)::DOUBLE AS i, count(*) FILTER (g[1] <> g[2])::DOUBLE AS h FROM ok GROUP BY k, p) """


@register("fst_hudson", _FST + f""", w AS (SELECT chrom, pos, x.n::DOUBLE AS n1, y.n::DOUBLE AS n2, x.a / x.n AS p1, y.a / y.n AS p2 FROM labels JOIN pp x USING (k) JOIN pp y USING (k) WHERE x.p = 1 AND y.p = 2 AND x.n >= 2 AND y.n >= 2)
SELECT chrom, pos, {_R('((p1-p2)**2 - p1*(1-p1)/(n1-1) - p2*(1-p2)/(n2-1)) / (p1*(1-p2)+p2*(1-p1))')} AS fst FROM w WHERE p1*(1-p2)+p2*(1-p1) <> 0""")
def fst_hudson(spark, sf_dir):
    return _rounded(popgen.fst_hudson(t.cohort(spark, sf_dir), list(POPS.values())).drop("ord"), "fst")


#: sites that both operators take; they raise on others
_TWO = ", two AS (SELECT k FROM labels WHERE n_alleles = 2 AND k NOT IN (SELECT k FROM calls WHERE g IS NOT NULL AND (len(g) <> 2 OR len(list_filter(g, lambda x: x > 1)) > 0)))"


@register("fst_wc", _TWO + _FST + f""", base AS (SELECT k, chrom, pos, x.i AS n1, y.i AS n2, x.a/(2*x.i) AS p1, y.a/(2*y.i) AS p2, (x.h+y.h)/(x.i+y.i) AS hb, (x.i+y.i) AS nn, (x.i+y.i)/2 AS nb FROM labels JOIN pp x USING (k) JOIN pp y USING (k) WHERE x.p = 1 AND y.p = 2),
w AS (SELECT *, (n1*p1+n2*p2)/nn AS pb, nn-(n1*n1+n2*n2)/nn AS nc FROM base), w2 AS (SELECT *, (n1*(p1-pb)**2+n2*(p2-pb)**2)/nb AS sq FROM w),
w3 AS (SELECT k, (sq-(pb*(1-pb)-sq/2-hb/4)/(nb-1))*nb/nc AS a, (pb*(1-pb)-sq/2-hb*(2*nb-1)/(4*nb))*nb/(nb-1) AS b, hb/2 AS c FROM w2 WHERE nb > 1 AND nc <> 0)
SELECT l.chrom, l.pos, CASE WHEN a+b+c <> 0 THEN {_R('a/(a+b+c)')} END AS fst FROM labels l LEFT JOIN w3 USING (k) WHERE l.k IN (SELECT k FROM two)""")
def fst_wc(spark, sf_dir):
    return _rounded(popgen.fst_weir_cockerham(popgen.diploid_biallelic(t.cohort(spark, sf_dir)), list(POPS.values())).drop("ord"), "fst")


@register("pi_site", f"SELECT chrom, pos, {_R(_PI)} AS pi FROM ac WHERE n >= 2")
def pi_site(spark, sf_dir):
    return _rounded(popgen.pi_site(t.cohort(spark, sf_dir)).drop("ord"), "pi")


@register("pi_window", f""", w AS (SELECT chrom, ((pos - 1) // {WINDOW}) * {WINDOW} + 1 AS bin_start, c0*(n-c0) + c1*(n-c1) + CASE WHEN n_alleles > 2 THEN c2*(n-c2) ELSE 0 END AS m, n*(n-1) AS p FROM ac),
s AS (SELECT chrom, bin_start, count(*) FILTER (m > 0) AS n_variants, coalesce(sum(m) FILTER (m > 0), 0)::DOUBLE AS m, coalesce(sum(p) FILTER (m > 0), 0)::DOUBLE AS p FROM w GROUP BY ALL)
SELECT chrom, bin_start::BIGINT AS bin_start, (bin_start + {WINDOW - 1})::BIGINT AS bin_end, n_variants, {_R(f'm / (p + ({WINDOW} - n_variants) * 32 * 31)')} AS pi FROM s""")
def pi_window(spark, sf_dir):
    return _rounded(popgen.pi_window(t.cohort(spark, sf_dir), WINDOW, 16), "pi")


def _sfs(name: str, folded: bool) -> None:
    value, top = ("least(c1, n - c1)", "max(n) // 2") if folded else ("c1", "max(c1)")
    sql = f""", b AS (SELECT {value} AS bin, c1, n FROM ac WHERE n_alleles = 2 AND n > 0), top AS (SELECT {top} AS t FROM b)
SELECT r.range AS allele_count, (SELECT count(*) FROM b WHERE bin = r.range) AS n_sites FROM range(0, (SELECT coalesce(t, 0)::BIGINT + 1 FROM top)) r"""
    register(name, sql)(lambda spark, sf_dir: popgen.sfs(t.cohort(spark, sf_dir), folded))


_sfs("sfs_unfolded", False)
_sfs("sfs_folded", True)

_A1 = "(SELECT sum(1.0::DOUBLE / range) FROM range(1, 32))"
_A2 = "(SELECT sum(1.0::DOUBLE / (range * range)) FROM range(1, 32))"


@register("tajima_d", _TWO + f""", pt AS (SELECT chrom, (pos // {WINDOW}) * {WINDOW} AS bin_start, CASE WHEN c0 > 0 AND c1 > 0 THEN 2 * (c0 / n::DOUBLE) * (1 - c0 / n::DOUBLE) * 32 / 31.0::DOUBLE END AS x FROM ac WHERE k IN (SELECT k FROM two)),
bins AS (SELECT chrom, bin_start, count(x) AS s, coalesce(sum(x), 0) AS p FROM pt GROUP BY ALL),
spans AS (SELECT chrom, unnest(range(min(bin_start), max(bin_start) + 1, {WINDOW})) AS bin_start FROM bins GROUP BY chrom),
k AS (SELECT {_A1} AS a1, {_A2} AS a2), e AS (SELECT a1, (33 / 93.0::DOUBLE - 1 / a1) / a1 AS e1, (2 * (32 * 32 + 35) / (9 * 32 * 31)::DOUBLE - 34 / (a1 * 32) + a2 / (a1 * a1)) / (a1 * a1 + a2) AS e2 FROM k)
SELECT chrom, bin_start::BIGINT AS bin_start, coalesce(s, 0) AS n_snps, CASE WHEN s >= 1 THEN {_R('(p - s / a1) / sqrt(e1 * s + e2 * s * (s - 1))')} END AS d FROM spans LEFT JOIN bins USING (chrom, bin_start), e""")
def tajima_d(spark, sf_dir):
    return _rounded(popgen.tajima_d(popgen.diploid_biallelic(t.cohort(spark, sf_dir)), WINDOW, 16), "d")


@register("pixy_pi", f""", w AS (SELECT p AS pop, chrom, ((pos - 1) // {WINDOW}) * {WINDOW} + 1 AS ws, n, n * n - c0*c0 - c1*c1 - c2*c2 AS d FROM pac)
SELECT pop, chrom, ws::BIGINT AS window_start, (ws + {WINDOW - 1})::BIGINT AS window_end, {_R('sum(d) FILTER (n >= 2) / sum(n * (n - 1)) FILTER (n >= 2)::DOUBLE')} AS avg_pi, count(*) FILTER (n >= 2) AS no_sites,
 coalesce(sum(d // 2) FILTER (n >= 2), 0)::BIGINT AS count_diffs, coalesce(sum(n * (n - 1) // 2) FILTER (n >= 2), 0)::BIGINT AS count_comparisons FROM w GROUP BY ALL""")
def pixy_pi(spark, sf_dir):
    return _rounded(popgen.pixy_pi(t.cohort(spark, sf_dir), POPS, WINDOW).drop("ord", "pop_no"), "avg_pi")


@register("pixy_dxy", f""", w AS (SELECT x.chrom, ((x.pos - 1) // {WINDOW}) * {WINDOW} + 1 AS ws, x.n * y.n AS c, x.n * y.n - x.c0*y.c0 - x.c1*y.c1 - x.c2*y.c2 AS d FROM pac x JOIN pac y USING (k) WHERE x.p = 'P1' AND y.p = 'P2')
SELECT 'P1' AS pop1, 'P2' AS pop2, chrom, ws::BIGINT AS window_start, (ws + {WINDOW - 1})::BIGINT AS window_end, {_R('sum(d) / nullif(sum(c), 0)::DOUBLE')} AS avg_dxy, count(*) FILTER (c > 0) AS no_sites, sum(d)::BIGINT AS count_diffs, sum(c)::BIGINT AS count_comparisons FROM w GROUP BY ALL""")
def pixy_dxy(spark, sf_dir):
    return _rounded(popgen.pixy_dxy(t.cohort(spark, sf_dir), POPS, WINDOW).drop("ord", "pair_no"), "avg_dxy")


@register("ld_r2", f""", ds AS (SELECT c.k, l.chrom, l.pos, c.s, CASE WHEN g IS NOT NULL AND len(list_filter(g, lambda x: x > 1)) = 0 THEN len(list_filter(g, lambda x: x = 1)) END AS d FROM calls c JOIN labels l USING (k) WHERE n_alleles = 2),
dd AS (SELECT * FROM ds WHERE d IS NOT NULL),
pr AS (SELECT x.chrom, x.pos AS pos1, y.pos AS pos2, x.k AS k1, y.k AS k2, x.d::DOUBLE AS l, y.d::DOUBLE AS r FROM dd x JOIN dd y ON x.chrom = y.chrom AND x.s = y.s AND x.k < y.k AND y.pos - x.pos BETWEEN 0 AND 100),
m AS (SELECT chrom, pos1, pos2, k1, k2, count(*) AS n, sum(l*r) - sum(l)*sum(r)/count(*) AS cov, (sum(l*l) - sum(l)*sum(l)/count(*)) * (sum(r*r) - sum(r)*sum(r)/count(*)) AS den FROM pr GROUP BY ALL)
SELECT chrom, pos1, pos2, n AS n_indv, {_R('cov * cov / den')} AS r2 FROM m WHERE n >= 2 AND den > 0""")
def ld_r2(spark, sf_dir):
    return _rounded(popgen.ld(t.cohort(spark, sf_dir), 100).drop("ord1", "ord2"), "r2")


@register("population_sizes", ", m AS (SELECT CASE WHEN s < 8 THEN 'P1' ELSE 'P2' END AS population FROM samples) SELECT population, count(*) AS n FROM m GROUP BY population HAVING count(*) >= 2")
def population_sizes(spark, sf_dir):
    rows = spark.createDataFrame([(s, p) for p, own in POPS.items() for s in own], "s int, population string")
    return popgen.population_sizes(rows, 2)
