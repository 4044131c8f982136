"""Queries over alignment records and CIGAR operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder
from varloom.functions import reads as R
from varloom.operators import signatures as S
from varloom.params import ONT
from varloom.plans.registry import query


@query("contigs", sql="SELECT contig_id, contig, size FROM contigs")
def contig_dim(contigs: DataFrame) -> DataFrame:
    return contigs.select("contig_id", "contig", "size")


@query("aln", sql="SELECT contig, pos, ref_end, mapq, flag, template, hp FROM aln WHERE contig IN ('A', 'R')")
def contig_filter(aln: DataFrame) -> DataFrame:
    return aln.filter(F.col("contig").isin("A", "R"))


@query("aln", sql="SELECT contig, pos, ref_end, mapq, flag, template, hp FROM aln WHERE contig = 'N' AND pos < 120000 AND ref_end > 40000")
def scan_region(aln: DataFrame) -> DataFrame:
    return aln.filter("contig = 'N' and pos < 120000 and ref_end > 40000")


PROBE = """SELECT contig, max(ref_end - pos) AS longest FROM (
  SELECT *, row_number() OVER (PARTITION BY contig ORDER BY pos, template, ref_end, mapq, flag) AS r FROM aln) WHERE r <= 10 GROUP BY contig"""


@query("aln", sql="SELECT contig, longest, CAST(CASE WHEN longest > 1000 THEN 0 ELSE 1 END AS BIGINT) AS tech FROM probe", probe=PROBE)
def tech_probe(aln: DataFrame) -> DataFrame:
    return S.probe_technology(aln)


@query("aln", sql="""
SELECT flag, (flag & 4) <> 0 AS unmapped, (flag & 1) <> 0 AS paired, (flag & 2304) = 0 AS is_primary, (flag & 256) <> 0 AS secondary,
 (flag & 2048) <> 0 AS supplementary, (flag & 16) <> 0 AS reverse, count(*) AS n FROM aln GROUP BY flag""")
def flag_predicates(aln: DataFrame) -> DataFrame:
    f = F.col("flag")
    bits = {"unmapped": R.UNMAPPED, "paired": R.PAIRED, "secondary": R.SECONDARY, "supplementary": R.SUPPLEMENTARY, "reverse": R.REVERSE}
    return aln.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).select("flag", "n", R.is_primary(f).alias("is_primary"), *(R.has(f, b).alias(k) for k, b in bits.items()))


@query("cigar_op", sql="SELECT read_id, op_idx, op, op_len FROM cigar_op")
def cigar_parse(ops: DataFrame) -> DataFrame:
    parsed = S.cigar_strings(ops).select("read_id", F.posexplode(R.cigar_ops(F.col("cigar"))).alias("op_idx", "o"))
    return parsed.select("read_id", F.col("op_idx").cast("long").alias("op_idx"), F.col("o.op").alias("op"), F.col("o.len").alias("op_len"))


@query("cigar_op", sql="""
SELECT read_id, CAST(sum(CASE WHEN op IN ('M', 'D', 'N') THEN op_len ELSE 0 END) AS BIGINT) AS ref_len,
 CAST(sum(CASE WHEN op IN ('M', 'I') THEN op_len ELSE 0 END) + 5 AS BIGINT) AS query_len,
 CAST(sum(CASE WHEN op IN ('M', 'I') THEN op_len ELSE 0 END) AS BIGINT) AS clipped_len,
 CAST(sum(CASE WHEN op IN ('M', 'I') THEN op_len ELSE 0 END) + 12 AS BIGINT) AS read_len FROM cigar_op GROUP BY read_id""")
def cigar_lengths(ops: DataFrame) -> DataFrame:
    # every read gets clips of known lengths
    o = R.cigar_ops(F.concat(F.lit("7H5S"), F.col("cigar")))
    return S.cigar_strings(ops).select("read_id", *S.cigar_lengths(o))


@query("cigar_op", sql="SELECT read_id, CAST(2 * mapq AS BIGINT) AS clip_len FROM cigar_op GROUP BY read_id, mapq")
def clip_length(ops: DataFrame) -> DataFrame:
    clipped = F.concat(F.col("mapq").cast("string"), F.lit("S"), F.col("cigar"), F.col("mapq").cast("string"), F.lit("H"))
    return S.cigar_strings(ops).select("read_id", R.cigar_sum(R.cigar_ops(clipped), ("S", "H")).alias("clip_len"))


OFFSETS = """SELECT *, CAST(coalesce(sum(CASE WHEN op IN ('M', 'D') THEN op_len ELSE 0 END) OVER w, 0) AS BIGINT) AS ref_off,
 CAST(coalesce(sum(CASE WHEN op IN ('M', 'I') THEN op_len ELSE 0 END) OVER w, 0) AS BIGINT) AS query_off FROM cigar_op
 WINDOW w AS (PARTITION BY read_id ORDER BY op_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
ADMITTED = "SELECT read_id FROM cigar_op GROUP BY read_id HAVING max(mapq) >= 20 AND sum(CASE WHEN op IN ('M', 'I') THEN op_len ELSE 0 END) >= 500"


@query("cigar_op", sql="SELECT read_id, op_idx, ref_off, query_off FROM offsets", offsets=OFFSETS)
def cigar_prefix_sums(ops: DataFrame) -> DataFrame:
    return S.with_offsets(ops).select("read_id", "op_idx", "ref_off", "query_off")


@query("cigar_op", sql="SELECT read_id FROM admitted", admitted=ADMITTED)
def cigar_admission(ops: DataFrame) -> DataFrame:
    return S.admitted_reads(ops, ONT)


@query("cigar_op", sql="""SELECT o.read_id, op_idx, pos + ref_off AS begin_pos, pos + ref_off + op_len AS end_pos, op_len AS length
FROM offsets o JOIN admitted a ON a.read_id = o.read_id WHERE op = 'D' AND op_len >= 30""", offsets=OFFSETS, admitted=ADMITTED)
def sig_del_cigar(ops: DataFrame) -> DataFrame:
    return S.cigar_signatures(ops, "D", ONT).select("read_id", "op_idx", "begin_pos", "end_pos", "length")


@query("cigar_op", sql="""SELECT o.read_id, op_idx, pos + ref_off AS begin_pos, pos + ref_off + op_len AS end_pos, op_len AS length
FROM offsets o JOIN admitted a ON a.read_id = o.read_id WHERE op = 'I' AND op_len >= 30""", offsets=OFFSETS, admitted=ADMITTED)
def sig_ins_cigar(ops: DataFrame) -> DataFrame:
    return S.cigar_signatures(ops, "I", ONT).select("read_id", "op_idx", "begin_pos", "end_pos", "length")


@query("sig", sql="SELECT contig, sv_type, begin_pos, end_pos, length, template, CAST(tech AS BIGINT) AS tech FROM sig")
def sig_checkpoint(sig: DataFrame) -> DataFrame:
    kept = materialize(sig, shared_folder(sig.sparkSession), "signatures")
    return kept.select("contig", "sv_type", "begin_pos", "end_pos", "length", "template", F.col("tech").cast("long").alias("tech"))


@query("sig", sql="SELECT contig, sv_type, begin_pos, template, least(end_pos, n) - greatest(begin_pos, m) AS shared FROM (SELECT *, begin_pos + 20 AS m, begin_pos + 60 AS n FROM sig)")
def overlap_len(sig: DataFrame) -> DataFrame:
    shared = R.overlap_length(F.col("begin_pos"), F.col("end_pos"), F.col("begin_pos") + 20, F.col("begin_pos") + 60)
    return sig.select("contig", "sv_type", "begin_pos", "template", shared.alias("shared"))


@query("sig", sql="SELECT CAST(tech AS BIGINT) AS tech, CAST(sig_type AS BIGINT) AS sig_type, CAST(CASE WHEN tech = 0 THEN 1 WHEN sig_type = 1 THEN 0 ELSE 2 END AS BIGINT) AS level, count(*) AS n FROM sig GROUP BY ALL")
def precision_level(sig: DataFrame) -> DataFrame:
    level = R.precision_level(F.col("tech"), F.col("sig_type")).cast("long").alias("level")
    return sig.groupBy(F.col("tech").cast("long").alias("tech"), F.col("sig_type").cast("long").alias("sig_type"), level).agg(F.count(F.lit(1)).alias("n"))


@query("sig", sql="SELECT sv_type, CAST(sig_type AS BIGINT) AS sig_type, CAST(tech AS BIGINT) AS tech, count(*) AS n FROM sig GROUP BY ALL")
def sig_census(sig: DataFrame) -> DataFrame:
    return sig.groupBy("sv_type", F.col("sig_type").cast("long").alias("sig_type"), F.col("tech").cast("long").alias("tech")).agg(F.count(F.lit(1)).alias("n"))


TOTAL = "begin_pos, length, quality DESC, template, end_pos, sv_type"


@query("sig", sql=f"""
SELECT contig, sv_type, begin_pos, end_pos, length, template, row_number() OVER (PARTITION BY contig, sv_type ORDER BY {TOTAL}) - 1 AS sig_id,
 coalesce(lag(begin_pos) OVER w = begin_pos AND lag(end_pos) OVER w = end_pos AND lag(template) OVER w = template AND lag(tech) OVER w = tech, false) AS repeated
FROM sig WINDOW w AS (PARTITION BY contig, sv_type ORDER BY {TOTAL})""")
def sig_sort_dedup(sig: DataFrame) -> DataFrame:
    return S.sorted_signatures(sig).select("contig", "sv_type", "begin_pos", "end_pos", "length", "template", "sig_id", "repeated")


@query("sig", sql="SELECT contig, sv_type, template, length, begin_pos FROM (SELECT *, row_number() OVER (PARTITION BY contig, sv_type, begin_pos - begin_pos % 1000, template ORDER BY length DESC, begin_pos, quality DESC) AS r FROM sig) WHERE r = 1")
def longest_per_read(sig: DataFrame) -> DataFrame:
    w = Window.partitionBy("contig", "sv_type", F.col("begin_pos") - F.col("begin_pos") % 1000, "template").orderBy(F.desc("length"), "begin_pos", F.desc("quality"))
    return sig.withColumn("r", F.row_number().over(w)).filter("r = 1").select("contig", "sv_type", "template", "length", "begin_pos")
