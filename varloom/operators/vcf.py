"""Reference bases, numbers and lines of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators.calls import type_name
from varloom.operators.intervals import numbered

#: Bases of a stored piece of the reference, and the longest call whose bases are written out.
CHUNK, LONGEST = 1_000, 1_000_000

# The header's entries.
INFO = [
    ("SVTYPE", "1", "String", "Type of structural variant"),
    ("END", "1", "Integer", "End position of the variant described in this record"),
    ("SVLEN", "1", "Integer", "Difference in length between REF and ALT alleles"),
    ("PRECISE", "0", "Flag", "Precise structural variant"),
    ("IMPRECISE", "0", "Flag", "Imprecise structural variant"),
    ("SS", "1", "Integer", "Number of supported signatures"),
    ("ST", "1", "Integer", "Number of supported templates"),
    ("SS2", "1", "Integer", "Number of supported NGS signatures"),
    ("ST2", "1", "Integer", "Number of supported NGS templates"),
    ("LS", "1", "Integer", "Length SD ratio score (100-ratio*100) of the cluster."),
    ("LR", "1", "String", "L,R,LR"),
    ("CV", "1", "Float", "Nearby coverage for genotyping."),
    ("CC", "1", "Float", "Average coverage of this contig."),
    ("CN", "1", "Float", "Copy number for duplication alleles(normal=1)."),
    ("CR", "1", "Float", "Core ratio."),
    ("M3L", "3", "Integer", "(min length, medium length, max length)."),
    ("PSTD", "1", "Float", "Position STD, -1 if not caclulated."),
    ("HPC", "3", "Integer", "HP counts:HP0,HP1,HP2."),
]
ALT = [("DEL", "Deletion"), ("DUP", "Duplication")]


def fetch(rows: DataFrame, chunks: DataFrame, begin: Column, end: Column, key: list[str], name: str) -> DataFrame:
    """``rows`` (unique by ``key``, with contig) with the reference bases from ``begin`` to ``end``, exclusive.

    Each row meets the chunks that it touches by equality.
    """
    first = F.floor(begin / CHUNK).cast("long")
    asked = rows.withColumn("_b", begin - first * CHUNK).withColumn("_n", end - begin).withColumn("chunk", F.explode(F.sequence(first, F.floor((end - 1) / CHUNK).cast("long"))))
    met = asked.join(chunks, ["contig", "chunk"]).groupBy(*key, "_b", "_n").agg(F.array_sort(F.collect_list(F.struct("chunk", "seq"))).alias("_p"))
    whole = F.array_join(F.transform("_p", lambda p: p["seq"]), "")
    return rows.join(met.select(*key, F.substring(whole, (F.col("_b") + 1).cast("int"), F.col("_n").cast("int")).alias(name)), key)


def resolved(calls: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    """``calls`` with vcf_pos, vcf_end, ref and alt: the base before a call, a deletion's bases and an insertion's, if it has any.

    Calls longer than LONGEST are told by their type alone.
    """
    before = F.greatest(F.col("pos") - 1, F.lit(0))
    short = F.col("sv_len") <= LONGEST
    end = F.when((F.col("sv_type") == 0) & short, before + F.col("sv_len")).otherwise(before) + 1
    rows = fetch(calls, chunks, before, end, key, "ref")
    inserted = F.when((F.col("sv_type") == 1) & short & (F.length("bases") > 0), F.concat(F.substring("ref", 1, 1), "bases"))
    alt = F.when((F.col("sv_type") == 0) & short, F.substring("ref", 1, 1)).otherwise(F.coalesce(inserted, F.concat(F.lit("<"), type_name(), F.lit(">"))))
    return rows.withColumn("alt", alt).withColumn("vcf_pos", before + 1).withColumn("vcf_end", F.when(F.col("sv_type") == 1, before).otherwise(before + F.col("sv_len")) + 1)


def with_ids(calls: DataFrame) -> DataFrame:
    """Calls with id: their type and running number in the order of contigs and places.

    Numbers run inside stretches of a contig; one row per contig carries what came before.
    """
    order = [F.col("pos"), F.col("sv_len"), F.col("locus"), F.col("cluster")]
    rows = numbered(calls, ["sv_type", "contig_id"], "pos", order, "_i")
    sizes = calls.groupBy("sv_type", "contig_id").agg(F.count(F.lit(1)).alias("_n"))
    # one row per type and contig
    earlier = Window.partitionBy("sv_type").orderBy("contig_id").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("sv_type", "contig_id", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = (F.col("_i") + F.col("_before")).cast("string")
    return rows.join(F.broadcast(before), ["sv_type", "contig_id"]).withColumn("id", F.concat(F.lit("sv."), type_name(), F.lit("."), number)).drop("_i", "_before")


def info() -> Column:
    """A call's INFO field."""
    pair = lambda k, v: F.concat(F.lit(f"{k}="), v.cast("string"))
    decimal = lambda k, v: F.concat(F.lit(f"{k}="), F.format_string("%.6f", F.round(v, 6).cast("double")))
    sides = F.concat(F.lit("LR="), F.when(F.col("inv_left"), "L").otherwise(""), F.when(F.col("inv_right"), "R").otherwise(""))
    return F.concat_ws(
        ";",
        F.when(F.col("sv_type") == 3, sides),
        F.when(F.col("is_precise"), "PRECISE").otherwise("IMPRECISE"),
        pair("SVTYPE", type_name()),
        pair("END", F.col("vcf_end")),
        pair("SVLEN", F.when(F.col("sv_type") == 0, -F.col("sv_len")).otherwise(F.col("sv_len"))),
        F.when(F.col("sv_type") == 2, pair("CN", F.col("cn"))),
        pair("SS", F.col("ss")),
        pair("ST", F.col("st")),
        pair("LS", F.col("ls")),
        pair("CV", F.col("cv")),
        pair("SS2", F.col("ss2")),
        pair("ST2", F.col("st2")),
        decimal("CC", F.col("contig_cov")),
        decimal("CR", F.col("cr")),
        pair("M3L", F.concat_ws(",", "shortest", "middle", "longest")),
        decimal("PSTD", F.col("pstd")),
        pair("HPC", F.concat_ws(",", "hp0", "hp1", "hp2")),
    )


def line() -> Column:
    """A call's line; contig, vcf_pos, id, ref, alt, info and gt are columns."""
    return F.concat_ws("\t", "contig", F.col("vcf_pos").cast("string"), "id", "ref", "alt", F.lit("."), F.lit("PASS"), "info", F.lit("GT"), "gt")


def header(contigs: DataFrame, sample: str, reference: str, date: str, caller: str, command: str) -> DataFrame:
    """(n, line) of the header; contigs' lines come in the order of their ids.  ``date`` is YYYYMMDD."""
    spark = contigs.sparkSession
    top = ["##fileformat=VCFv4.2", f"##fileDate={date}", f"##reference={reference}"]
    fields = [f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in INFO]
    fields += [f'##ALT=<ID={i},Description="{d}">' for i, d in ALT]
    last = ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', f'##SVCaller="{caller}"', f'##CommandLine="{command}"', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + sample]
    fixed = spark.createDataFrame([(k - len(top), s) for k, s in enumerate(top)] + [(1_000_000_000 + k, s) for k, s in enumerate(fields + last)], "n long, line string")
    own = contigs.select(F.col("contig_id").cast("long").alias("n"), F.concat(F.lit("##contig=<ID="), "contig", F.lit(",length="), F.col("size").cast("string"), F.lit(">")).alias("line"))
    return fixed.unionByName(own)


def document(head: DataFrame, calls: DataFrame) -> DataFrame:
    """(line) of a whole file: the header, then ``calls`` by contig and place."""
    first = head.select(F.lit(0).alias("part"), F.col("n").alias("at"), F.lit(0).cast("long").alias("then"), F.lit("").alias("id"), "line")
    rest = calls.select(F.lit(1).alias("part"), F.col("contig_id").cast("long").alias("at"), F.col("vcf_pos").cast("long").alias("then"), "id", line().alias("line"))
    return first.unionByName(rest).orderBy("part", "at", "then", "id").select("line")
