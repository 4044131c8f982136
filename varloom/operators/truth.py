"""Truth sets: matching, simulation helpers and their output."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators.calls import type_name
from varloom.operators.grouping import map_rows
from varloom.operators.intervals import islands

#: A call matches a truth within so many bases and with lengths at least so alike.
REACH, ALIKE = 500, 0.7
GENOME_BIN = 100_000


def best_matches(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """(truth_id, locus, apart): each truth's nearest call of its contig and type, if any is near and alike enough.

    Places are binned by REACH; a truth looks into its bin and the two beside it.
    """
    home = F.floor(F.col("pos") / REACH)
    asked = truth.withColumn("_bin", F.explode(F.array(home - 1, home, home + 1)))
    held = calls.select("contig", "sv_type", home.alias("_bin"), F.col("pos").alias("c_pos"), F.col("sv_len").alias("c_len"), "locus")
    apart, longer = F.abs(F.col("pos") - F.col("c_pos")), F.abs(F.col("sv_len") - F.col("c_len"))
    near = (apart <= REACH) & (F.least("sv_len", "c_len") >= ALIKE * F.greatest("sv_len", "c_len"))
    best = asked.join(held, ["contig", "sv_type", "_bin"]).filter(near).groupBy("truth_id").agg(F.min(F.struct(apart.alias("apart"), longer.alias("longer"), "locus")).alias("m"))
    return best.select("truth_id", F.col("m.locus").alias("locus"), F.col("m.apart").alias("apart"))


def unphased(gt: Column) -> Column:
    return F.when(gt == "1|1", "1/1").when(gt == "0|0", "0/0").otherwise("0/1")


def truth_line() -> Column:
    """A truth's VCF line."""
    length = F.when(F.col("sv_type") == 0, -F.col("sv_len")).otherwise(F.col("sv_len")).cast("string")
    info = F.concat(F.lit("SVTYPE="), type_name(), F.lit(";END="), (F.col("pos") + F.col("sv_len")).cast("string"), F.lit(";SVLEN="), length)
    name = F.concat(F.lit("truth."), F.col("truth_id").cast("string"))
    return F.concat_ws("\t", "contig", (F.col("pos") + 1).cast("string"), name, F.lit("N"), F.concat(F.lit("<"), type_name(), F.lit(">")), F.lit("."), F.lit("PASS"), info, F.lit("GT"), unphased(F.col("gt")))


def to_contigs(places: DataFrame, contigs: DataFrame, place: str) -> DataFrame:
    """``places`` with contig and pos: a position on the concatenated contigs, looked up by bins of the genome."""
    # one row per contig
    ends = contigs.withColumn("_end", F.sum("size").over(Window.orderBy("contig_id"))).withColumn("_start", F.col("_end") - F.col("size"))
    binned = ends.select("contig", "_start", "_end", F.explode(F.sequence(F.floor(F.col("_start") / GENOME_BIN), F.floor((F.col("_end") - 1) / GENOME_BIN))).alias("_bin"))
    found = places.withColumn("_bin", F.floor(F.col(place) / GENOME_BIN)).join(binned, "_bin").filter((F.col(place) >= F.col("_start")) & (F.col(place) < F.col("_end")))
    return found.withColumn("pos", F.col(place) - F.col("_start")).drop("_bin", "_start", "_end")


def both_chance(af: Column) -> Column:
    """Chance that a carrier has a variant of frequency ``af`` on both haplotypes."""
    return af * af / (1 - (1 - af) * (1 - af))


def without_overlaps(rows: DataFrame, start: str, end: str, key: str) -> DataFrame:
    """Greedy by start: a row stays if it begins behind the last one that stayed.

    Rows of different islands never overlap, so each island is folded on its own.
    """
    order = [F.col(start), F.col(end), F.col(key)]
    grouped = islands(rows.select("contig", start, end, key), ["contig"], start, order, F.col(end), "island")

    def run(group: list[dict]) -> Iterator[tuple]:
        last = None
        for row in group:
            if last is None or row[start] > last:
                last = row[end]
                yield row["contig"], row[start], row[end], row[key]

    return map_rows(grouped, ["contig", "island"], [start, end, key], run, f"contig string, {start} long, {end} long, {key} long")


def united(haplotypes: list[DataFrame]) -> DataFrame:
    """The distinct rows of two ``haplotypes`` (of equal columns), each with gt: which of the two have it.

    A row that one haplotype holds repeatedly counts once.
    """
    sides = [h.withColumn("_side", F.lit(k)) for k, h in enumerate(haplotypes)]
    has = lambda k: F.max((F.col("_side") == k).cast("int")).cast("string")
    return reduce(DataFrame.unionByName, sides).groupBy(*haplotypes[0].columns).agg(F.concat(has(0), F.lit("|"), has(1)).alias("gt"))


def single_variants(calls: list[DataFrame]) -> DataFrame:
    """(contig, pos, ref, alt, gt) of all ``calls``, by place: those with one other allele, which the sample has once or twice."""
    whole = reduce(DataFrame.unionByName, [c.select("contig", "pos", "ref", "alt", "gt") for c in calls])
    carried = F.size(F.filter(F.split("gt", "[/|]"), lambda a: ~a.isin("0", ".")))
    return whole.filter(~F.col("alt").contains(",") & (F.col("alt") != ".") & carried.between(1, 2)).orderBy("contig", "pos", "ref", "alt")
