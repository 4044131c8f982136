"""Signatures from CIGAR operations, and the order of signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import reads as R
from varloom.operators.intervals import numbered
from varloom.params import Params


def probe_technology(aln: DataFrame) -> DataFrame:
    """(contig, longest, tech): technology by the longest of each contig's first ten records."""
    w = Window.partitionBy("contig").orderBy("pos", "template", "ref_end", "mapq", "flag")
    first = aln.withColumn("r", F.row_number().over(w)).filter("r <= 10")
    longest = first.groupBy("contig").agg(F.max(F.col("ref_end") - F.col("pos")).alias("longest"))
    return longest.withColumn("tech", F.when(F.col("longest") > 1000, 0).otherwise(1).cast("long"))


def cigar_strings(ops: DataFrame) -> DataFrame:
    """(read_id, mapq, cigar) of operation rows."""
    parts = F.array_sort(F.collect_list(F.struct("op_idx", F.concat(F.col("op_len").cast("string"), "op").alias("t"))))
    return ops.groupBy("read_id", "mapq").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("cigar"))


def cigar_lengths(ops: Column) -> list[Column]:
    """Reference length, query length, query length without clips, and full length with hard clips."""
    return [
        R.cigar_sum(ops, R.REFERENCE_OPS).alias("ref_len"),
        R.cigar_sum(ops, R.QUERY_OPS).alias("query_len"),
        R.cigar_sum(ops, tuple(o for o in R.QUERY_OPS if o != "S")).alias("clipped_len"),
        R.cigar_sum(ops, (*R.QUERY_OPS, "H")).alias("read_len"),
    ]


def with_offsets(ops: DataFrame) -> DataFrame:
    """Operation rows with the reference and query bases before them; skipped regions don't move the reference."""
    w = Window.partitionBy("read_id").orderBy("op_idx").rowsBetween(Window.unboundedPreceding, -1)
    moved = lambda which: F.coalesce(F.sum(F.when(F.col("op").isin(*which), F.col("op_len")).otherwise(0)).over(w), F.lit(0)).cast("long")
    return ops.withColumn("ref_off", moved(R.SIGNATURE_OPS)).withColumn("query_off", moved(R.QUERY_OPS))


def admitted_reads(ops: DataFrame, p: Params) -> DataFrame:
    """Ids of reads that map well enough and are long enough."""
    size = F.sum(F.when(F.col("op").isin(*R.QUERY_OPS), F.col("op_len")).otherwise(0))
    return ops.groupBy("read_id").agg(F.max("mapq").alias("q"), size.alias("n")).filter((F.col("q") >= p.min_mapq) & (F.col("n") >= p.min_template)).select("read_id")


def cigar_signatures(ops: DataFrame, op: str, p: Params) -> DataFrame:
    """Deletions (D) or insertions (I) of at least the least length, of admitted reads.

    Admission is a window over the read that the offsets need anyway, so one shuffle by read serves both.
    """
    whole = Window.partitionBy("read_id")
    size = F.sum(F.when(F.col("op").isin(*R.QUERY_OPS), F.col("op_len")).otherwise(0)).over(whole)
    found = with_offsets(ops.withColumn("_n", size)).filter((F.col("_n") >= p.min_template) & (F.col("mapq") >= p.min_mapq))
    found = found.filter((F.col("op") == op) & (F.col("op_len") >= p.min_sv_len))
    begin = F.col("pos") + F.col("ref_off")
    return found.select("read_id", "op_idx", "mapq", "query_off", begin.alias("begin_pos"), (begin + F.col("op_len")).alias("end_pos"), F.col("op_len").alias("length"))




def sorted_signatures(sig: DataFrame) -> DataFrame:
    """Signatures with their number in the total order of their contig and type, and whether the one before is equal."""
    order = [F.col("begin_pos"), F.col("length"), F.desc("quality"), F.col("template"), F.col("end_pos"), F.col("sv_type")]
    same = F.lit(True)
    near = Window.partitionBy("contig", "sv_type", "begin_pos").orderBy(*order)
    for c in ("end_pos", "template", "tech"):
        same = same & (F.lag(c).over(near) == F.col(c))
    return numbered(sig.withColumn("repeated", F.coalesce(same, F.lit(False))), ["contig", "sv_type"], "begin_pos", order, "sig_id")
