"""Queries over coverage, calls and their output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder
from varloom.operators import calls as K
from varloom.operators import clusters as C
from varloom.operators import coverage as V
from varloom.operators import vcf as W
from varloom.params import GENOTYPE_RATIO, ONT
from varloom.plans.registry import query
from varloom.sources.projections import reference
from varloom.sources.vcf_file import read_region, write_vcf

KEY = [*C.LOCUS, "pos"]


def _of(values: tuple) -> str:
    """A type's value in SQL."""
    return "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in values) + "][sv_type + 1]"


COV = """SELECT contig, w, sum(CASE WHEN w = pos // 100 THEN ((pos // 100 + 1) * 100 - pos) / CAST(100 AS DOUBLE) WHEN w = ref_end // 100 THEN (ref_end + 1 - (ref_end // 100) * 100) / CAST(100 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS cov
FROM (SELECT contig, pos, ref_end, unnest(generate_series(pos // 100, ref_end // 100)) AS w FROM aln WHERE (flag & 2304) = 0 AND mapq >= 20) GROUP BY contig, w"""
TOTAL = """SELECT contig_id, contig, contig_cov, sum(contig_cov * size) OVER w / sum(size) OVER w AS total_cov FROM (
 SELECT c.contig_id, c.contig, c.size, coalesce((SELECT sum(cov) FROM covw x WHERE x.contig = c.contig), 0) / (c.size // 100 + 1) AS contig_cov FROM contigs c) WINDOW w AS (ORDER BY contig_id)"""
CL = "SELECT *, begin_pos - begin_pos % 1000 AS locus FROM sig"
HPC = "SELECT contig, sv_type, locus, count(*) AS n, count(*) FILTER (WHERE hp = 0) AS hp0, count(*) FILTER (WHERE hp = 1) AS hp1, count(*) FILTER (WHERE hp = 2) AS hp2 FROM cl GROUP BY ALL"
CUT = f"""SELECT *, over_ AND one_sided AS drop_untagged,
 CASE WHEN over_ AND one_sided THEN 1 - {_of(ONT.homo_minus)} - {_of(ONT.homo_minus_ratio)} * (shp - {_of(ONT.hp_ratio)})
  WHEN over_ THEN 1 - {_of(ONT.other_minus)} - {_of(ONT.other_minus_ratio)} * (shp - {_of(ONT.hp_ratio)})
  ELSE 1 + ({_of(ONT.low_plus)} + {_of(ONT.low_plus_ratio)}) * ({_of(ONT.hp_ratio)} - shp) END AS co
FROM (SELECT *, (hp1 + hp2) / n AS shp, (hp1 + hp2) / n > {_of(ONT.hp_ratio)} AS over_, coalesce(greatest(hp1, hp2) / nullif(hp1 + hp2, 0) > {_of(ONT.homo_ratio)}, false) AS one_sided FROM hpc)"""
KR = """SELECT c.*, k.drop_untagged FROM cl c JOIN cut k ON k.contig = c.contig AND k.sv_type = c.sv_type AND k.locus = c.locus WHERE NOT (k.drop_untagged AND hp = 0)"""
SPELLED = """SELECT contig, sv_type, locus, arg_min(substr(ins_bases, 1, sv_len), r) AS bases FROM (
 SELECT *, row_number() OVER (PARTITION BY contig, sv_type, locus ORDER BY CASE WHEN drop_untagged THEN hp ELSE 0 END, begin_pos, length, quality DESC, template, end_pos) AS r,
 CAST(sum(length) OVER w // count(*) OVER w AS BIGINT) AS sv_len FROM kr WHERE sv_type = 1 WINDOW w AS (PARTITION BY contig, sv_type, locus)) WHERE strlen(ins_bases) >= sv_len GROUP BY ALL"""
MET = f"""SELECT m.*, u.n, hp0, hp1, hp2, shp, co, drop_untagged, CAST(floor(round(greatest(0.0, 100 - sd_length / sv_len * 100), 6)) AS BIGINT) AS ls, b.bases,
 st >= {ONT.precise_templates} AND round(sd_length, 6) < {ONT.precise_sd} AND round(sd_begin, 6) < {ONT.precise_sd} AND round(sd_end, 6) < {ONT.precise_sd} AS is_precise FROM (
 SELECT contig, sv_type, locus, count(*) AS ss, count(DISTINCT template) AS st, count(*) FILTER (WHERE tech = 1) AS ss2, count(DISTINCT template) FILTER (WHERE tech = 1) AS st2,
  CAST(sum(begin_pos) // count(*) AS BIGINT) AS pos, CAST(sum(length) // count(*) AS BIGINT) AS sv_len, stddev_pop(begin_pos) AS sd_begin, stddev_pop(end_pos) AS sd_end, stddev_pop(length) AS sd_length,
  bool_or(inv_left) AS inv_left, bool_or(inv_right) AS inv_right, max(cn) AS cn, CAST(min(contig_id) AS BIGINT) AS contig_id,
  min(length) AS shortest, list_sort(list(length))[count(*) // 2 + 1] AS middle, max(length) AS longest
 FROM kr GROUP BY ALL) m
JOIN cut u ON u.contig = m.contig AND u.sv_type = m.sv_type AND u.locus = m.locus LEFT JOIN spelled b ON b.contig = m.contig AND b.sv_type = m.sv_type AND b.locus = m.locus"""
KEPT = f"""SELECT c.*, t.contig_cov, CASE WHEN sv_type = 1 AND st >= 2 AND st2 <= 30 THEN sd_begin ELSE -1 END AS pstd,
 CASE WHEN st < 2 THEN false WHEN st2 > 30 THEN true WHEN sv_type >= 2 AND ss - st > st THEN false WHEN sv_type = 3 AND NOT (inv_left AND inv_right) THEN false
 WHEN st >= ({_of(ONT.base1)} + total_cov * {_of(ONT.multi1)}) * co AND ls >= {_of(ONT.score1)} * co THEN true
 ELSE st >= ({_of(ONT.base2)} + total_cov * {_of(ONT.multi2)}) * co AND ls >= {_of(ONT.score2)} * co END AS keep
FROM met c JOIN total t ON t.contig = c.contig"""
CV = """SELECT k.contig, k.sv_type, k.locus, CASE WHEN sv_type = 1 THEN
 (SELECT count(*) FROM aln a WHERE a.contig = k.contig AND (flag & 2304) = 0 AND a.pos <= greatest(k.pos - 400, 0) AND a.ref_end >= least(k.pos + 400, s.size - 1))
 ELSE CAST(floor(round(round((SELECT coalesce(sum(cov), 0) FROM covw x WHERE x.contig = k.contig AND w BETWEEN k.pos // 100 AND (k.pos + k.sv_len) // 100), 6) / ((k.pos + k.sv_len) // 100 - k.pos // 100 + 1), 6)) AS BIGINT) END AS cv
FROM kept k JOIN contigs s ON s.contig = k.contig"""
GENO = f"""SELECT k.*, v.cv, CASE WHEN v.cv = 0 OR st / v.cv >= {_of(tuple(GENOTYPE_RATIO[i] for i in range(4))).replace('[sv_type', '[k.sv_type')} THEN '1/1' ELSE '0/1' END AS gt
FROM kept k JOIN cvs v ON v.contig = k.contig AND v.sv_type = k.sv_type AND v.locus = k.locus"""
BAL = "SELECT CAST(coalesce(sum(least(hp1, hp2)), 0) AS BIGINT) AS small, CAST(coalesce(sum(greatest(hp1, hp2)), 0) AS BIGINT) AS big FROM geno WHERE keep AND gt <> '1/1'"
REGT = """SELECT * EXCLUDE (gt, p, tail, small, big), CASE WHEN shp > 0.8 AND tail < 2e-5 THEN '1/1' ELSE gt END AS gt FROM (
 SELECT *, CASE WHEN p = 0 THEN CASE WHEN least(hp1, hp2) = 0 THEN 1 ELSE 0 END ELSE
  coalesce(list_sum(list_transform(range(least(hp1, hp2), hp1 + hp2), lambda i: exp(lgamma(hp1 + hp2 + 1) - lgamma(i + 1) - lgamma(hp1 + hp2 - i + 1) + i * ln(p) + (hp1 + hp2 - i) * ln(1 - p)))), 1) END AS tail
 FROM (SELECT *, CASE WHEN big > 100 THEN small / (small + big) ELSE 0.015::DOUBLE END AS p FROM geno CROSS JOIN bal))"""
BASE = dict(cl=CL, hpc=HPC, cut=CUT, kr=KR, spelled=SPELLED, met=MET)
FILTER = dict(covw=COV, total=TOTAL, **BASE, kept=KEPT)
CALLS = dict(**FILTER, cvs=CV, geno=GENO)
FINAL = dict(**CALLS, bal=BAL, regt=REGT)
NAMES = """SELECT *, ['DEL', 'INS', 'DUP', 'INV'][sv_type + 1] AS kind, greatest(pos - 1, 0) AS p0 FROM regt WHERE keep"""
LINES = """SELECT *, p0 + 1 AS vcf_pos, CASE WHEN sv_type = 1 THEN p0 + 1 ELSE p0 + sv_len + 1 END AS vcf_end,
 substr(repeat('ACGT', 300), CAST(p0 % 4 AS INTEGER) + 1, CAST(CASE WHEN sv_type = 0 THEN sv_len + 1 ELSE 1 END AS INTEGER)) AS ref,
 CASE WHEN sv_type = 0 THEN substr('ACGT', CAST(p0 % 4 AS INTEGER) + 1, 1) WHEN sv_type = 1 AND bases IS NOT NULL THEN substr('ACGT', CAST(p0 % 4 AS INTEGER) + 1, 1) || bases ELSE '<' || kind || '>' END AS alt,
 'sv.' || kind || '.' || (row_number() OVER (PARTITION BY sv_type ORDER BY contig_id, pos, sv_len, locus) - 1) AS id FROM named"""
INFOS = """SELECT *, CASE WHEN sv_type = 3 THEN 'LR=' || CASE WHEN inv_left THEN 'L' ELSE '' END || CASE WHEN inv_right THEN 'R' ELSE '' END || ';' ELSE '' END
 || CASE WHEN is_precise THEN 'PRECISE' ELSE 'IMPRECISE' END || ';SVTYPE=' || kind || ';END=' || vcf_end
 || ';SVLEN=' || (CASE WHEN sv_type = 0 THEN -sv_len ELSE sv_len END) || CASE WHEN sv_type = 2 THEN ';CN=' || cn ELSE '' END || ';SS=' || ss || ';ST=' || st || ';LS=' || ls || ';CV=' || cv
 || ';SS2=' || ss2 || ';ST2=' || st2 || printf(';CC=%.6f', round(CAST(contig_cov AS DOUBLE), 6)) || ';CR=0.000000;M3L=' || shortest || ',' || middle || ',' || longest
 || printf(';PSTD=%.6f', round(CAST(pstd AS DOUBLE), 6)) || ';HPC=' || hp0 || ',' || hp1 || ',' || hp2 AS info FROM lined"""
OUTPUT = dict(**FINAL, named=NAMES, lined=LINES, infos=INFOS)


def _clusters(sig: DataFrame) -> DataFrame:
    return K.measured(C.with_clusters(sig, ONT, *K.USED), ONT)


def _filtered(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters with keep, coverage windows); both are used more than once, so both are tables."""
    folder = shared_folder(sig.sparkSession)
    cov = materialize(V.windows(aln, ONT), folder, "coverage", clean=True)
    return materialize(K.filtered(_clusters(sig), V.cumulative(cov, contigs, ONT), ONT), folder, "clusters", clean=True), cov


def _calls(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    kept, cov = _filtered(sig, aln, contigs)
    return K.genotyped(kept, aln, contigs, cov, ONT)


def _output(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    called = materialize(_calls(sig, aln, contigs), shared_folder(sig.sparkSession), "called")
    final = K.regenotyped(called).filter("keep")
    named = W.with_ids(W.resolved(final, reference(contigs, W.CHUNK), [*C.CLUSTER]))
    return named.withColumn("info", W.info())


@query("aln", sql="SELECT contig, w, round(cov, 6) AS cov FROM covw", covw=COV)
def coverage_windows(aln: DataFrame) -> DataFrame:
    return V.windows(aln, ONT).select("contig", "w", F.round("cov", 6).alias("cov"))


@query("aln", "contigs", sql="SELECT contig_id, contig, round(contig_cov, 6) AS contig_cov, round(total_cov, 6) AS total_cov FROM total", covw=COV, total=TOTAL)
def cumulative_coverage(aln: DataFrame, contigs: DataFrame) -> DataFrame:
    return V.cumulative(V.windows(aln, ONT), contigs, ONT).select("contig_id", "contig", F.round("contig_cov", 6).alias("contig_cov"), F.round("total_cov", 6).alias("total_cov"))


LOCI = "SELECT contig, sv_type, begin_pos - begin_pos % 1000 AS locus, CAST(min(begin_pos) AS BIGINT) AS b, CAST(max(end_pos) AS BIGINT) AS e FROM sig GROUP BY ALL"


@query("sig", "aln", sql="""SELECT l.contig, l.sv_type, l.locus, round(round(coalesce(sum(cov), 0), 6) / (l.e // 100 - l.b // 100 + 1), 4) AS average FROM loci l
LEFT JOIN covw c ON c.contig = l.contig AND c.w BETWEEN l.b // 100 AND l.e // 100 GROUP BY l.contig, l.sv_type, l.locus, l.b, l.e""", covw=COV, loci=LOCI)
def avg_coverage(sig: DataFrame, aln: DataFrame) -> DataFrame:
    spans = C.with_clusters(sig, ONT, "begin_pos", "end_pos").groupBy(*C.CLUSTER).agg(F.min("begin_pos").alias("b"), F.max("end_pos").alias("e"))
    return V.average(V.windows(aln, ONT), spans, F.col("b"), F.col("e"), ONT).select(*C.LOCUS, F.round("average", 4).alias("average"))


@query("sig", "aln", sql="SELECT l.contig, l.sv_type, l.locus, (SELECT count(*) FROM aln a WHERE a.contig = l.contig AND (flag & 2304) = 0 AND a.pos <= l.b AND a.ref_end >= l.e) AS n FROM loci l", loci=LOCI)
def span_count(sig: DataFrame, aln: DataFrame) -> DataFrame:
    spans = C.with_clusters(sig, ONT, "begin_pos", "end_pos").groupBy(*C.CLUSTER).agg(F.min("begin_pos").alias("b"), F.max("end_pos").alias("e"))
    return V.spanning(V.primary_segments(aln), spans, "b", "e").select(*C.LOCUS, "n")


@query("sig", sql="SELECT contig, sv_type, locus, hp0, hp1, hp2, drop_untagged, round(shp, 6) AS shp, round(co, 6) AS co FROM cut", cl=CL, hpc=HPC, cut=CUT)
def hp_cutoff(sig: DataFrame) -> DataFrame:
    cut = K.cutoffs(C.with_clusters(sig, ONT), ONT)
    return cut.select(*C.LOCUS, "hp0", "hp1", "hp2", "drop_untagged", F.round("shp", 6).alias("shp"), F.round("co", 6).alias("co"))


@query("sig", "aln", "contigs", sql="SELECT contig, sv_type, locus, pos, sv_len, ss, st, ss2, st2, ls, keep FROM kept", **FILTER)
def filter_calls(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    return _filtered(sig, aln, contigs)[0].select(*KEY, "sv_len", "ss", "st", "ss2", "st2", "ls", "keep")


@query("sig", "aln", "contigs", sql="SELECT contig, sv_type, locus, pos, cv, gt FROM geno", **CALLS)
def genotype(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    return _calls(sig, aln, contigs).select(*KEY, "cv", "gt")


@query("sig", "aln", "contigs", sql="""SELECT i.contig, i.sv_type, i.locus, i.pos, coalesce(ratio > 0.05 AND floor(sd_begin) >= 2 / ratio AND EXISTS (
 SELECT 1 FROM kept d WHERE d.sv_type = 2 AND d.contig = i.contig AND i.pos >= d.pos AND i.pos <= d.pos + d.sv_len AND i.sv_len <= d.sv_len), false) AS inside
FROM kept i JOIN (SELECT contig, count(*) FILTER (WHERE keep AND sv_type = 2) / nullif(count(*) FILTER (WHERE keep AND sv_type = 1), 0) AS ratio FROM kept GROUP BY contig) r ON r.contig = i.contig
WHERE i.sv_type = 1 AND keep""", **FILTER)
def dup_ins_antijoin(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    return K.flag_duplicated_insertions(_filtered(sig, aln, contigs)[0]).select(*KEY, "inside")


@query("sig", "aln", "contigs", sql="SELECT small, big FROM bal", **CALLS, bal=BAL)
def hap_balance(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    return K.balance(_calls(sig, aln, contigs))


@query("sig", "aln", "contigs", sql="SELECT contig, sv_type, locus, pos, gt FROM regt", **FINAL)
def hap_regenotype(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    return K.regenotyped(_calls(sig, aln, contigs)).select(*KEY, "gt")


@query("sig", "aln", "contigs", sql="SELECT contig, sv_type, locus, vcf_pos, vcf_end, ref, alt FROM lined", **FINAL, named=NAMES, lined=LINES)
def resolve_ref(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    return _output(sig, aln, contigs).select(*C.LOCUS, "vcf_pos", "vcf_end", "ref", "alt")


@query("sig", "aln", "contigs", sql="SELECT contig, sv_type, locus, id FROM lined", **FINAL, named=NAMES, lined=LINES)
def call_ids(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    return _output(sig, aln, contigs).select(*C.LOCUS, "id")


@query("sig", "aln", "contigs", sql="SELECT contig_id, contig, pos, sv_type, sv_len, st, ls, gt, id FROM lined ORDER BY contig_id, pos, sv_type, sv_len", **FINAL, named=NAMES, lined=LINES)
def sort_calls(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    return _output(sig, aln, contigs).select("contig_id", "contig", "pos", "sv_type", "sv_len", "st", "ls", "gt", "id").orderBy("contig_id", "pos", "sv_type", "sv_len")


@query("sig", "aln", "contigs", sql="SELECT id, info FROM infos", **OUTPUT)
def vcf_info(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    return _output(sig, aln, contigs).select("id", "info")


@query("sig", "aln", "contigs", sql="SELECT concat_ws(chr(9), contig, CAST(vcf_pos AS VARCHAR), id, ref, alt, '.', 'PASS', info, 'GT', gt) AS line FROM infos", **OUTPUT)
def vcf_lines(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    return _output(sig, aln, contigs).select(W.line().alias("line"))


#: What the header's lines name.
NAMED = ("sample", "acgt.fa", "20260101", "varloom", "call --preset ont")
TOP = " UNION ALL ".join(
    [f"SELECT {k - 3} AS n, '{s}' AS line" for k, s in enumerate(("##fileformat=VCFv4.2", "##fileDate=20260101", "##reference=acgt.fa"))]
    + ["SELECT contig_id, '##contig=<ID=' || contig || ',length=' || size || '>' FROM contigs"]
    + [f"""SELECT 1000000000 + {k}, '##INFO=<ID={i},Number={n},Type={t},Description="{d}">'""" for k, (i, n, t, d) in enumerate(W.INFO)]
    + [f"""SELECT 1000000018 + {k}, '##ALT=<ID={i},Description="{d}">'""" for k, (i, d) in enumerate(W.ALT)]
    + ["""SELECT 1000000020, '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'""", """SELECT 1000000021, '##SVCaller="varloom"'""", """SELECT 1000000022, '##CommandLine="call --preset ont"'"""]
    + ["SELECT 1000000023, concat_ws(chr(9), '#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO', 'FORMAT', 'sample')"]
)


@query("contigs", sql="SELECT CAST(n AS BIGINT) AS n, line FROM head", head=TOP)
def vcf_header(contigs: DataFrame) -> DataFrame:
    return W.header(contigs, *NAMED)


@query("sig", "aln", "contigs", sql="SELECT line FROM head UNION ALL SELECT concat_ws(chr(9), contig, CAST(vcf_pos AS VARCHAR), id, ref, alt, '.', 'PASS', info, 'GT', gt) FROM infos", **OUTPUT, head=TOP)
def vcf_document(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    return W.document(W.header(contigs, *NAMED), _output(sig, aln, contigs))


@query("sig", "aln", "contigs", sql="SELECT concat_ws(chr(9), contig, CAST(vcf_pos AS VARCHAR), id, ref, alt, '.', 'PASS', info, 'GT', gt) AS value FROM infos", **OUTPUT)
def vcf_file(sig: DataFrame, aln: DataFrame, contigs: DataFrame) -> DataFrame:
    """All calls written as one compressed file, and read back contig by contig through its index."""
    spark = sig.sparkSession
    calls = _output(sig, aln, contigs).select("contig_id", "contig", "vcf_pos", "vcf_end", "id", W.line().alias("line"))
    path = f"{shared_folder(spark)}/calls.vcf.gz"
    write_vcf(W.header(contigs, *NAMED), calls, path).count()
    names = [r["contig"] for r in contigs.select("contig").collect()]  # a row per contig
    return reduce(DataFrame.unionByName, [read_region(spark, path, c, 0, 1 << 29) for c in names])


@query("truth", "contigs", sql="SELECT truth_id, substr(repeat('ACGT', 300), CAST(pos % 4 AS INTEGER) + 1, CAST(sv_len AS INTEGER)) AS bases FROM truth")
def ref_fetch(truth: DataFrame, contigs: DataFrame) -> DataFrame:
    found = W.fetch(truth.select("truth_id", "contig", "pos", "sv_len"), reference(contigs.withColumn("size", F.col("size") + 10_000), W.CHUNK), F.col("pos"), F.col("pos") + F.col("sv_len"), ["truth_id"], "bases")
    return found.select("truth_id", "bases")


@query("sig", sql="""SELECT contig, sv_type, locus, round(log10(greatest(pow(0.9::DOUBLE, c0) * pow(0.1::DOUBLE, c1) / 3, 1e-300)), 6) AS gl00, round(log10(greatest(pow(0.5::DOUBLE, c0 + c1) / 3, 1e-300)), 6) AS gl01,
 round(log10(greatest(pow(0.1::DOUBLE, c0) * pow(0.9::DOUBLE, c1) / 3, 1e-300)), 6) AS gl11 FROM (SELECT contig, sv_type, locus, least(count(*) FILTER (WHERE hp <> 1), 100) AS c0, least(count(*) FILTER (WHERE hp = 1), 100) AS c1 FROM cl GROUP BY ALL)""", cl=CL)
def gl_genotype(sig: DataFrame) -> DataFrame:
    counts = C.with_clusters(sig, ONT).groupBy(*C.CLUSTER).agg(F.least(F.count_if(F.col("hp") != 1), F.lit(100)).alias("c0"), F.least(F.count_if(F.col("hp") == 1), F.lit(100)).alias("c1"))
    part = lambda p: F.round(F.log10(F.greatest(p / 3, F.lit(1e-300))), 6)
    likely = lambda r: F.pow(F.lit(1 - r), F.col("c0")) * F.pow(F.lit(r), F.col("c1"))
    return counts.select(*C.LOCUS, part(likely(0.1)).alias("gl00"), part(F.pow(F.lit(0.5), F.col("c0") + F.col("c1"))).alias("gl01"), part(F.pow(F.lit(0.1), F.col("c0")) * F.pow(F.lit(0.9), F.col("c1"))).alias("gl11"))
