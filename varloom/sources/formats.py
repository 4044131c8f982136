"""Text formats of the field as DataFrames: SAM, FASTA with its index, BED, VCF, and their writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAM_FIELDS = ["qname", "flag", "contig", "pos", "mapq", "cigar", "mate_contig", "mate_pos", "isize", "seq", "qual"]
NUMBERS = {"flag", "pos", "mapq", "mate_pos", "isize"}


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records; positions from 0, tags as a map from name to value."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != ""))
    fields = [(parts[i].cast("long") if n in NUMBERS else parts[i]).alias(n) for i, n in enumerate(SAM_FIELDS)]
    tags = F.map_from_entries(F.transform(F.slice(parts, F.lit(12), F.size(parts)), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 30))))
    rows = lines.select(*fields, tags.alias("tags"))
    return rows.withColumns({"pos": F.col("pos") - 1, "mate_pos": F.col("mate_pos") - 1})


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    """(kind, fields): the header's lines as maps from tag to value."""
    lines = spark.read.text(path).filter(F.col("value").startswith("@"))
    parts = F.split("value", "\t")
    fields = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda t: F.substring(t, 3, 1) == ":")
    return lines.select(F.substring(parts[0], 2, 2).alias("kind"), F.map_from_entries(F.transform(fields, lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 4, 1 << 30)))).alias("fields"))


def sample_name(header: DataFrame, given: str = "*") -> str:
    """The first read group's sample, unless a name is given; without read groups the name is ``*``."""
    if given != "*":
        return given
    groups = header.filter((F.col("kind") == "RG") & F.col("fields")["SM"].isNotNull()).select(F.col("fields")["SM"]).limit(1).collect()
    return groups[0][0] if groups else "*"


def platform(header: DataFrame) -> str | None:
    """The first read group's platform."""
    groups = header.filter(F.col("kind") == "RG").select(F.col("fields")["PL"]).limit(1).collect()
    return groups[0][0] if groups else None


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(contig, size, offset, line_bases, line_width) of a FASTA index."""
    return spark.read.csv(path, sep="\t", schema="contig string, size long, offset long, line_bases int, line_width int")


def fasta_chunks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(contig, chunk, seq): a FASTA file's contigs in chunks of ``size`` bases, in capitals.

    Lines are read in the blocks into which Spark cuts the file.  Each line's contig and place follow from what stands before it
    in its block, and from one row for each earlier block.
    """
    source = ["file", "block"]
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    head = F.col("value").startswith(">")
    size_of = F.when(head, 0).otherwise(F.length(F.trim("value"))).cast("long")
    lines = text.withColumns({"head": head, "name": F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)), "bases": size_of})
    upto = Window.partitionBy(*source).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.sum(F.col("head").cast("int")).over(upto)).withColumn("own", F.last("name", ignorenulls=True).over(upto))
    before = Window.partitionBy(*source, "section").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", F.coalesce(F.sum("bases").over(before), F.lit(0)))
    # a row for each block: its last contig, and the bases behind that contig's head
    sections = lines.groupBy(*source, "section").agg(F.max("own").alias("name"), F.sum("bases").alias("bases"))
    ends = sections.groupBy(*source).agg(F.max(F.struct("section", "name", "bases")).alias("e")).select(*source, "e.*")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block")
    ends = ends.withColumn("run", F.sum(F.when(F.col("section") > 0, 1).otherwise(0)).over(whole)).withColumn("carried", F.last("name", ignorenulls=True).over(earlier))
    run = Window.partitionBy("file", "run").orderBy("block")
    summed = ends.withColumn("total", F.sum("bases").over(run)).withColumn("until", F.lag("total").over(whole))
    known = summed.select(*source, "carried", F.coalesce("until", F.lit(0)).alias("until"))
    placed = lines.filter(~head & (F.col("bases") > 0)).join(known, source)
    first = F.col("section") == 0
    placed = placed.select(F.when(first, F.col("carried")).otherwise(F.col("own")).alias("contig"), (F.col("at") + F.when(first, F.col("until")).otherwise(0)).alias("at"), F.upper(F.trim("value")).alias("value"))
    place = F.floor(F.col("at") / size).cast("long")
    last = F.floor((F.col("at") + F.length("value") - 1) / size).cast("long")
    parts = placed.withColumn("chunk", F.explode(F.sequence(place, last)))
    lo = F.greatest(F.col("chunk") * size - F.col("at"), F.lit(0)).cast("int")
    hi = F.least((F.col("chunk") + 1) * size - F.col("at"), F.length("value")).cast("int")
    parts = parts.select("contig", "chunk", "at", F.substring("value", lo + 1, hi - lo).alias("part"))
    pieces = F.array_sort(F.collect_list(F.struct("at", "part")))
    return parts.groupBy("contig", "chunk").agg(F.array_join(F.transform(pieces, lambda x: x["part"]), "").alias("seq"))


def read_bed(spark: SparkSession, path: str, more: str = "") -> DataFrame:
    """(contig, begin_pos, end_pos) and ``more`` columns."""
    schema = "contig string, begin_pos long, end_pos long" + (f", {more}" if more else "")
    return spark.read.csv(path, sep="\t", schema=schema, comment="#")


def write_bed(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep="\t", header=False)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Calls: contig, pos (from 0), id, ref, alt, filter, info as a map (flags are empty), gt of the first sample."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    p = F.split("value", "\t")
    pairs = F.transform(F.split(p[7], ";"), lambda e: F.struct(F.split_part(e, F.lit("="), F.lit(1)), F.split_part(e, F.lit("="), F.lit(2))))
    return lines.select(p[0].alias("contig"), (p[1].cast("long") - 1).alias("pos"), p[2].alias("id"), p[3].alias("ref"), p[4].alias("alt"), p[6].alias("filter"), F.map_from_entries(pairs).alias("info"), F.split_part(F.get(p, F.lit(9)), F.lit(":"), F.lit(1)).alias("gt"))


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(column).write.mode("overwrite").text(path)
