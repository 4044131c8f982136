"""Queries over read pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import reads as R
from varloom.operators import library as L
from varloom.operators import records, sampling
from varloom.plans.registry import query

CDF = """SELECT size, CAST(round_even(below / total * 1000, 0) AS BIGINT) AS upto FROM (
 SELECT isize AS size, sum(count(*)) OVER (ORDER BY isize) AS below, sum(count(*)) OVER () AS total FROM pair GROUP BY isize)"""
BINS = "SELECT b AS bin, (SELECT min(size) FROM cdf WHERE upto > b) AS size FROM (SELECT unnest(generate_series(0, 999)) AS b)"
MOMENTS = "SELECT avg(size) AS mean, stddev_pop(size) AS sd FROM (SELECT greatest(CAST(ceil(i * 1000 / 10000) AS BIGINT) - 1, 0) AS bin FROM (SELECT unnest(generate_series(0, 10000)) AS i)) s JOIN bins USING (bin)"
ORIENT = """SELECT *, CASE WHEN reverse <> mate_reverse THEN CASE WHEN abs(pos - mate_pos) <= 2 THEN 'Rp' WHEN (CASE WHEN pos < mate_pos THEN reverse ELSE mate_reverse END) = 0 THEN 'Rp' ELSE 'Rm' END
 WHEN (pos < mate_pos) = (reverse = 0) THEN 'Fp' ELSE 'Fm' END AS orient FROM pair"""


@query("pair", sql="SELECT bin, size FROM bins", cdf=CDF, bins=BINS)
def isize_quantiles(pairs: DataFrame) -> DataFrame:
    return L.quantile_bins(pairs)


@query("pair", sql="SELECT round(mean, 6) AS mean, round(sd, 6) AS sd FROM moments", cdf=CDF, bins=BINS, moments=MOMENTS)
def isize_stats(pairs: DataFrame) -> DataFrame:
    return L.moments(pairs).select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


#: Two libraries: every other pair is 300 bases longer.
LIBS = "SELECT pair_id % 2 AS source_id, isize + 300 * (pair_id % 2) AS isize FROM pair"
LIB_CDF = """SELECT source_id, size, CAST(round_even(below / total * 1000, 0) AS BIGINT) AS upto FROM (
 SELECT source_id, isize AS size, sum(count(*)) OVER (PARTITION BY source_id ORDER BY isize) AS below, sum(count(*)) OVER (PARTITION BY source_id) AS total FROM libs GROUP BY source_id, isize)"""
LIB_BINS = "SELECT source_id, b AS bin, min(size) AS size FROM lib_cdf JOIN (SELECT unnest(generate_series(0, 999)) AS b) ON upto > b GROUP BY ALL"


@query("pair", sql="""SELECT source_id, round(avg(size), 6) AS mean, round(stddev_pop(size), 6) AS sd
FROM (SELECT greatest(CAST(ceil(i * 1000 / 10000) AS BIGINT) - 1, 0) AS bin FROM (SELECT unnest(generate_series(0, 10000)) AS i)) s JOIN lib_bins USING (bin) GROUP BY source_id""", libs=LIBS, lib_cdf=LIB_CDF, lib_bins=LIB_BINS)
def isize_by_source(pairs: DataFrame) -> DataFrame:
    """Each source's library measured by its own pairs, in one job."""
    rows = pairs.select((F.col("pair_id") % 2).alias("source_id"), (F.col("isize") + 300 * (F.col("pair_id") % 2)).alias("isize"))
    return L.moments(rows, ["source_id"]).select("source_id", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("pair", sql="SELECT isize AS size, count(*) AS n FROM pair WHERE isize <= (SELECT size FROM bins WHERE bin = 999) GROUP BY isize", cdf=CDF, bins=BINS)
def isize_trim(pairs: DataFrame) -> DataFrame:
    top = L.quantile_bins(pairs).filter(F.col("bin") == L.bin_of(F.lit(L.TOP))).select(F.col("size").alias("top"))
    return L.histogram(pairs).crossJoin(F.broadcast(top)).filter("size <= top").select("size", "n")


@query("pair", sql="SELECT pair_id, CASE WHEN abs(isize) > 1000 THEN abs(isize) // 10 * 10 ELSE abs(isize) END AS size FROM pair")
def frag_size(pairs: DataFrame) -> DataFrame:
    return pairs.select("pair_id", R.simple_size(F.col("isize")).alias("size"))


@query("pair", sql="SELECT pair_id, orient FROM oriented", oriented=ORIENT)
def pair_orient(pairs: DataFrame) -> DataFrame:
    return L.oriented(pairs).select("pair_id", "orient")


@query("pair", sql="SELECT contig, arg_max(orient, n) AS orient, max(n) AS n, CAST(sum(n) AS BIGINT) AS total, max(n) >= 0.9 * sum(n) AS clear FROM (SELECT contig, orient, count(*) AS n FROM oriented GROUP BY ALL) GROUP BY contig", oriented=ORIENT)
def orient_consensus(pairs: DataFrame) -> DataFrame:
    n = L.oriented(pairs).groupBy("contig", "orient").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("contig").agg(F.max_by("orient", "n").alias("orient"), F.sum("n").alias("total"), F.max("n").alias("most")).select("contig", "orient", F.col("most").alias("n"), "total", (F.col("most") >= 0.9 * F.col("total")).alias("clear"))


@query("aln", sql="""SELECT contig, count(*) AS total, CAST(0 AS BIGINT) AS paired, count(*) AS unpaired, count(*) FILTER (WHERE mapq = 0) AS unsure,
 count(*) FILTER (WHERE mapq < 20) AS low, count(*) FILTER (WHERE mapq >= 20) AS high FROM aln GROUP BY contig""")
def read_counters(aln: DataFrame) -> DataFrame:
    return L.counters(aln)


UPSTREAM = "SELECT pair_id FROM pair WHERE isize <> 0 AND reverse = 0 QUALIFY row_number() OVER (PARTITION BY contig, pos ORDER BY pair_id) = 1"


@query("pair", sql="SELECT pair_id, CAST(n AS BIGINT) AS read_no FROM up CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2)", up=UPSTREAM)
def pair_depth_filter(pairs: DataFrame) -> DataFrame:
    return L.depth_filtered(pairs)


@query("pair", sql="SELECT pair_id, contig, pos, isize FROM pair WHERE pair_id IN (SELECT pair_id FROM up)", up=UPSTREAM)
def mate_semi_join(pairs: DataFrame) -> DataFrame:
    return pairs.join(L.upstream_kept(pairs).select("pair_id"), "pair_id", "left_semi").select("pair_id", "contig", "pos", "isize")


#: Records of pairs: every 5th is a duplicate, every 7th is split, every 11th has a clip before its match, every 17th skips 50 bases.
FACTS = """SELECT *, pair_id % 5 = 0 AS dup, pair_id % 7 = 0 AS split, pair_id % 11 = 0 AS clipped, pair_id % 17 = 0 AS skips FROM pair"""
ONE = """SELECT pair_id, contig, pos, mate_pos, reverse, mapq, isize, skips FROM facts WHERE mapq > 0 AND NOT dup AND NOT split AND NOT (clipped AND reverse = 0)
UNION ALL SELECT pair_id, contig, mate_pos, pos, mate_reverse, mapq, isize, false FROM facts WHERE mapq > 0 AND NOT dup"""
UP = """SELECT pair_id FROM (SELECT *, row_number() OVER (PARTITION BY contig, pos ORDER BY 'p' || pair_id, reverse) AS r FROM one WHERE pos < mate_pos) WHERE r = 1 AND NOT skips"""


@query("pair", sql="""SELECT o.pair_id, o.pos, CASE WHEN n > 1000 THEN n // 10 * 10 ELSE n END AS size FROM (SELECT *, greatest(isize - CASE WHEN skips THEN 50 ELSE 0 END, 0) AS n FROM one) o
JOIN up u ON u.pair_id = o.pair_id WHERE o.pos > o.mate_pos""", facts=FACTS, one=ONE, up=UP)
def stats_read_filter(pairs: DataFrame) -> DataFrame:
    found = L.library_reads(records.prepared(_records(pairs)))
    return found.select(F.substring("qname", 2, 20).cast("long").alias("pair_id"), "pos", F.col("isize").alias("size"))


def _records(pairs: DataFrame) -> DataFrame:
    """Both records of each pair; what makes a pair unfit stands in the first one."""
    k = F.col("pair_id")
    flag = 1 + 16 * F.col("reverse") + 32 * F.col("mate_reverse")
    cigar = F.concat(F.when(k % 11 == 0, "5S").otherwise(""), F.when(k % 17 == 0, "40M50N60M").otherwise("100M"))
    tags = F.when(k % 7 == 0, F.create_map(F.lit("SA"), F.lit("A,1,+,9M,9,0;"))).otherwise(F.create_map().cast("map<string,string>"))
    same = [F.lit(0).cast("long").alias("source_id"), F.concat(F.lit("p"), k.cast("string")).alias("qname"), "contig", "mapq"]
    first = pairs.select(*same, (flag + F.when(k % 5 == 0, 1024).otherwise(0)).alias("flag"), "pos", "mate_pos", "isize", cigar.alias("cigar"), tags.alias("tags"))
    back = 1 + 32 * F.col("reverse") + 16 * F.col("mate_reverse")
    second = pairs.select(*same, (back + F.when(k % 5 == 0, 1024).otherwise(0)).alias("flag"), F.col("mate_pos").alias("pos"), F.col("pos").alias("mate_pos"), (-F.col("isize")).alias("isize"), F.lit("100M").alias("cigar"), F.create_map().cast("map<string,string>").alias("tags"))
    return first.unionByName(second).withColumn("mate_contig", F.lit("="))


#: One record of each pair, with the distance between the outer ends.
GAPS = """SELECT pair_id, contig, mapq, pos, isize, reverse, CASE WHEN reverse = 0 THEN isize ELSE pos + 100 - mate_pos END AS gap, CASE WHEN reverse = 0 THEN pos ELSE mate_pos END AS base FROM pair WHERE reverse <> mate_reverse"""
FOUND = """SELECT *, gap > mean + 5 * sd AS wide FROM gaps CROSS JOIN moments WHERE gap > mean + 5 * sd OR gap < mean - 3 * sd"""
DISCORDANT = """SELECT contig, CAST(CASE WHEN wide THEN 0 ELSE 2 END AS BIGINT) AS sv_type, CASE WHEN wide THEN base + CAST(trunc(mean / 2) AS BIGINT) ELSE pos END AS begin_pos,
 CASE WHEN wide THEN base + CAST(trunc(mean / 2) AS BIGINT) + CAST(trunc(gap - mean) AS BIGINT) ELSE pos + isize END AS end_pos,
 CASE WHEN wide THEN CAST(trunc(gap - mean) AS BIGINT) WHEN reverse = 0 THEN greatest(CAST(trunc(mean - isize) AS BIGINT), 0) ELSE isize END AS length,
 'p' || pair_id AS template, CAST(mapq AS DOUBLE) AS quality FROM found"""
DISCORDANTS = dict(cdf=CDF, bins=BINS, moments=MOMENTS, gaps=GAPS, found=FOUND, discordant=DISCORDANT)


def pair_records(pairs: DataFrame) -> DataFrame:
    """One record of each pair, plain and mapped."""
    flag = 1 + 16 * F.col("reverse") + 32 * F.col("mate_reverse")
    return pairs.select(
        F.concat(F.lit("p"), F.col("pair_id").cast("string")).alias("qname"), flag.alias("flag"), "contig", "pos", "mapq", F.lit("100M").alias("cigar"), F.lit("=").alias("mate_contig"),
        "mate_pos", "isize", F.lit(None).cast("string").alias("seq"), F.create_map().cast("map<string,string>").alias("tags"),
    )


@query("pair", sql="SELECT contig, sv_type, begin_pos, end_pos, length, template, quality FROM discordant", **DISCORDANTS)
def sig_discordant(pairs: DataFrame) -> DataFrame:
    rows = records.prepared(pair_records(pairs).withColumn("source_id", F.lit(0).cast("long"))).withColumn("tech", F.lit(1))
    return records.from_pairs(rows, L.moments(pairs)).select("contig", "sv_type", "begin_pos", "end_pos", "length", "template", "quality")


@query("pair")
def isize_sampled(pairs: DataFrame) -> DataFrame:
    """The moments of the smallest sample whose sizes have settled."""
    return L.moments(L.sampled(pairs, "pair_id")).select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("pair")
def isize_converged(pairs: DataFrame) -> DataFrame:
    """The moments of the pairs that face each other, taken in the order of contigs and places until their sizes settle."""
    found = sampling.facing(pairs)
    # one row per contig
    contigs = [(r["contig"], r["size"]) for r in pairs.groupBy("contig").agg((F.max("pos") + 1).alias("size")).orderBy("contig").collect()]
    taken = sampling.sample(sampling.of_table(found), contigs, [F.col("pair_id")])
    return L.moments(taken.frame(pairs.sparkSession)).select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.lit(taken.pairs).alias("pairs"), F.lit(taken.settled).alias("settled"))
