"""Queries over clusters of signatures."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators import clusters as C
from varloom.operators import intervals as I
from varloom.operators.calls import measured, weights
from varloom.operators.layers import two_layers, with_layers
from varloom.operators.signatures import sorted_signatures
from varloom.params import ONT
from varloom.plans.registry import query

CL = "SELECT *, begin_pos - begin_pos % 1000 AS locus FROM sig"
IDS = "SELECT *, row_number() OVER (PARTITION BY contig, sv_type ORDER BY begin_pos, length, quality DESC, template, end_pos, sv_type) - 1 AS sig_id FROM cl"


def stats(name: str, spark: str, sql: str) -> None:
    """A query of one row per cluster: expressions for Spark and for the oracle."""

    used = re.findall("[a-z_]+", spark)

    def run(sig: DataFrame) -> DataFrame:
        return C.with_clusters(sig, ONT, *used).groupBy(*C.CLUSTER).agg(*(F.expr(e) for e in spark.split("; "))).drop("cluster")

    run.__name__ = name
    query("sig", sql=f"SELECT contig, sv_type, locus, {sql} FROM cl GROUP BY contig, sv_type, locus", cl=CL)(run)


@query("sig", sql="SELECT contig, sv_type, begin_pos, template, length, locus FROM cl", cl=CL)
def cluster_islands(sig: DataFrame) -> DataFrame:
    return C.with_locus(sig, ONT).select("contig", "sv_type", "begin_pos", "template", "length", "locus")


@query("sig", sql="SELECT contig, sv_type, sig_id, min(sig_id) OVER (PARTITION BY contig, sv_type, locus) AS cluster FROM ids", cl=CL, ids=IDS)
def cluster_exact(sig: DataFrame) -> DataFrame:
    return C.exact_clusters(sorted_signatures(sig), ONT)


@query("sig")
def cluster_two_layer(sig: DataFrame) -> DataFrame:
    found = two_layers(sorted_signatures(sig), ONT)
    return found.select("contig", "sv_type", "sig_id", "cluster", "core")


def _per_type(values: tuple) -> str:
    return "[" + ", ".join(f"CAST({v} AS DOUBLE)" for v in values) + "][a.sv_type + 1]"


RATIO = f"CASE WHEN a.hp <> 0 AND a.hp = b.hp THEN {_per_type(ONT.hp_same)} WHEN a.hp <> 0 AND b.hp <> 0 THEN {_per_type(ONT.hp_diff)} ELSE 1.0::DOUBLE END"


@query("sig", sql=f"""
SELECT contig, sv_type, count(*) AS pairs, CAST(sum(x) AS BIGINT) AS first, CAST(sum(y) AS BIGINT) AS second FROM (
 SELECT a.contig, a.sv_type, a.sig_id AS x, b.sig_id AS y FROM ids a JOIN ids b ON a.contig = b.contig AND a.sv_type = b.sv_type AND a.sig_id < b.sig_id
 AND a.template <> b.template AND abs(a.begin_pos - b.begin_pos) < 5000
 AND ((abs(a.begin_pos - b.begin_pos) <= {_per_type(ONT.force)} * {RATIO} AND abs(a.end_pos - b.end_pos) <= {_per_type(ONT.force)} * {RATIO})
  OR (abs(a.begin_pos - b.begin_pos) <= least(a.length, b.length) * {_per_type(ONT.pos_ratio)} AND abs(a.end_pos - b.end_pos) <= least(a.length, b.length) * {_per_type(ONT.pos_ratio)}
   AND abs(a.length - b.length) <= floor(greatest({_per_type(ONT.length_min)}, floor(least(a.length, b.length) * {_per_type(ONT.length_ratio)})) * {RATIO})))) GROUP BY ALL""", cl=CL, ids=IDS)
def brother_pairs(sig: DataFrame) -> DataFrame:
    pairs = C.brother_pairs(sorted_signatures(sig), ONT)
    return pairs.groupBy("contig", "sv_type").agg(F.count(F.lit(1)).alias("pairs"), F.sum("a").alias("first"), F.sum("b").alias("second"))


@query("sig", sql="""SELECT contig, sv_type, begin_pos, template, length, max(CASE WHEN opens THEN begin_pos END) OVER (PARTITION BY contig, sv_type ORDER BY begin_pos) AS chain
FROM (SELECT *, coalesce(begin_pos - lag(begin_pos) OVER (PARTITION BY contig, sv_type ORDER BY begin_pos) > 200, true) AS opens FROM sig)""")
def chain_cluster(sig: DataFrame) -> DataFrame:
    order = [F.col("begin_pos"), F.col("length"), F.col("template"), F.desc("quality"), F.col("end_pos")]
    return I.islands(sig, C.KEYS, "begin_pos", order, F.col("begin_pos") + 200, "chain").select("contig", "sv_type", "begin_pos", "template", "length", "chain")


@query("aln", sql="SELECT contig, pos, ref_end, max(ref_end) OVER (PARTITION BY contig ORDER BY pos, ref_end) AS max_end FROM (SELECT DISTINCT contig, pos, ref_end FROM aln)")
def prefix_max_end(aln: DataFrame) -> DataFrame:
    rows = aln.select("contig", "pos", "ref_end").distinct()
    return I.running_max(rows, ["contig"], "pos", [F.col("pos"), F.col("ref_end")], F.col("ref_end"), "max_end")


@query("sig", sql="SELECT sv_type, count(*) AS n, CAST(sum(length) AS BIGINT) AS bases FROM sig GROUP BY sv_type")
def union_types(sig: DataFrame) -> DataFrame:
    parts = [sig.filter(F.col("sv_type") == t) for t in range(4)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("sv_type").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bases"))


stats("cluster_support", "count(*) ss; count(distinct template) st; count_if(tech = 1) ss2; count(distinct if(tech = 1, template, null)) st2",
      "count(*) AS ss, count(DISTINCT template) AS st, count(*) FILTER (WHERE tech = 1) AS ss2, count(DISTINCT template) FILTER (WHERE tech = 1) AS st2")
stats("cluster_site", "sum(begin_pos) div count(*) pos; sum(length) div count(*) sv_len",
      "CAST(sum(begin_pos) // count(*) AS BIGINT) AS pos, CAST(sum(length) // count(*) AS BIGINT) AS sv_len")
stats("cluster_sd", "round(stddev_pop(begin_pos), 4) sd_begin; round(stddev_pop(end_pos), 4) sd_end; round(stddev_pop(length), 4) sd_length",
      "round(stddev_pop(begin_pos), 4) AS sd_begin, round(stddev_pop(end_pos), 4) AS sd_end, round(stddev_pop(length), 4) AS sd_length")
stats("cluster_ls", "cast(floor(round(greatest(0.0d, 100 - stddev_pop(length) / (sum(length) div count(*)) * 100), 6)) as bigint) ls",
      "CAST(floor(round(greatest(0.0, 100 - stddev_pop(length) / (sum(length) // count(*)) * 100), 6)) AS BIGINT) AS ls")
stats("cluster_m3l", "min(length) shortest; element_at(array_sort(collect_list(length)), cast(count(*) div 2 + 1 as int)) middle; max(length) longest",
      "min(length) AS shortest, list_sort(list(length))[count(*) // 2 + 1] AS middle, max(length) AS longest")
SURE = f"round(stddev_pop(length), 6) < {ONT.precise_sd} AND round(stddev_pop(begin_pos), 6) < {ONT.precise_sd} AND round(stddev_pop(end_pos), 6) < {ONT.precise_sd}"
stats("cluster_precise", f"count(distinct template) >= {ONT.precise_templates} and {SURE} is_precise", f"count(DISTINCT template) >= {ONT.precise_templates} AND {SURE} AS is_precise")
stats("hp_counts", "count_if(hp = 0) hp0; count_if(hp = 1) hp1; count_if(hp = 2) hp2",
      "count(*) FILTER (WHERE hp = 0) AS hp0, count(*) FILTER (WHERE hp = 1) AS hp1, count(*) FILTER (WHERE hp = 2) AS hp2")
stats("dup_cn", "max(cn) cn", "max(cn) AS cn")
stats("inv_sides", "bool_or(inv_left) inv_left; bool_or(inv_right) inv_right", "bool_or(inv_left) AS inv_left, bool_or(inv_right) AS inv_right")
stats("weighted_site", "round(sum(begin_pos * cast(quality as double)) / sum(cast(quality as double)), 4) pos; round(sum(length * cast(quality as double)) / sum(cast(quality as double)), 4) sv_len",
      "round(sum(begin_pos * CAST(quality AS DOUBLE)) / sum(CAST(quality AS DOUBLE)), 4) AS pos, round(sum(length * CAST(quality AS DOUBLE)) / sum(CAST(quality AS DOUBLE)), 4) AS sv_len")


@query("sig", sql="SELECT contig, sv_type, locus, round(sum(q), 6) AS weight FROM (SELECT contig, sv_type, locus, template, max(CAST(quality AS DOUBLE)) AS q FROM cl GROUP BY ALL) GROUP BY ALL", cl=CL)
def weight_sum(sig: DataFrame) -> DataFrame:
    return weights(C.with_clusters(sig, ONT)).withColumn("weight", F.round("weight", 6)).drop("cluster")


@query("sig", sql=f"""SELECT contig, sv_type, locus, count(*) AS n, CAST(sum(begin_pos) AS BIGINT) AS begins FROM (
 SELECT *, row_number() OVER (PARTITION BY contig, sv_type, locus ORDER BY begin_pos, length, quality DESC, template, end_pos) - 1 AS r, count(*) OVER (PARTITION BY contig, sv_type, locus) AS m FROM cl)
WHERE m <= {ONT.max_cluster} OR (r >= m // 2 - {ONT.max_cluster} // 2 AND r < m // 2 - {ONT.max_cluster} // 2 + {ONT.max_cluster}) GROUP BY ALL""", cl=CL)
def cluster_cap(sig: DataFrame) -> DataFrame:
    kept = C.with_clusters(sig, ONT, "begin_pos").filter("within")
    return kept.groupBy(*C.CLUSTER).agg(F.count(F.lit(1)).alias("n"), F.sum("begin_pos").alias("begins")).drop("cluster")


#: The second layer on, with a range of its own.
LAYERED = replace(ONT, near=(0, 0, 0, 0))


@query("sig", sql="SELECT contig, sv_type, locus, CAST(1 AS DOUBLE) AS cr FROM cl GROUP BY contig, sv_type, locus", cl=CL)
def core_ratio(sig: DataFrame) -> DataFrame:
    """Calls of both layers: each cluster here is one part of the first layer, so all its rows are its core."""
    return measured(with_layers(sig, LAYERED), LAYERED).select(*C.LOCUS, "cr")


@query("sig", sql="""SELECT contig, sv_type, locus, arg_min(substr(ins_bases, 1, sv_len), r) AS bases FROM (
 SELECT *, row_number() OVER (PARTITION BY contig, sv_type, locus ORDER BY begin_pos, length, quality DESC, template, end_pos) AS r,
 CAST(sum(length) OVER (PARTITION BY contig, sv_type, locus) // count(*) OVER (PARTITION BY contig, sv_type, locus) AS BIGINT) AS sv_len FROM cl WHERE sv_type = 1) WHERE strlen(ins_bases) >= sv_len GROUP BY ALL""", cl=CL)
def ins_consensus(sig: DataFrame) -> DataFrame:
    # no haplotype is told apart here, so no row is dropped
    found = measured(C.with_clusters(sig.filter("sv_type = 1").withColumn("hp", F.lit(0).cast("long")), ONT), ONT)
    return found.select(*C.LOCUS, "bases")


@query("sig", sql="""SELECT contig, sv_type, locus, round(m1, 6) AS mean1, round(m2, 6) AS mean2, coalesce(abs(m1 - m2) > 3 * greatest(v1, v2), false) AS split FROM (
 SELECT contig, sv_type, locus, any_value(m1) AS m1, any_value(m2) AS m2, avg((length - m1) ** 2) FILTER (WHERE hp = 1) AS v1, avg((length - m1) ** 2) FILTER (WHERE hp = 2) AS v2 FROM (
  SELECT *, avg(length) FILTER (WHERE hp = 1) OVER w AS m1, avg(length) FILTER (WHERE hp = 2) OVER w AS m2 FROM cl WINDOW w AS (PARTITION BY contig, sv_type, locus)) GROUP BY contig, sv_type, locus)
WHERE m1 IS NOT NULL AND m2 IS NOT NULL""", cl=CL)
def hp_split(sig: DataFrame) -> DataFrame:
    # mean squares around haplotype 1's mean, from sums alone
    one, two = F.col("hp") == 1, F.col("hp") == 2
    square = F.col("length") * F.col("length")
    g = C.with_clusters(sig, ONT, "length", "hp").groupBy(*C.CLUSTER).agg(
        *(f(F.when(h, x)).alias(n) for h, k in ((one, "1"), (two, "2")) for f, x, n in ((F.avg, F.col("length"), f"m{k}"), (F.avg, square, f"q{k}")))
    )
    around = lambda k: F.col(f"q{k}") - 2 * F.col("m1") * F.col(f"m{k}") + F.col("m1") * F.col("m1")
    apart = F.abs(F.col("m1") - F.col("m2")) > 3 * F.greatest(around("1"), around("2"))
    return g.filter("m1 is not null and m2 is not null").select(*C.LOCUS, F.round("m1", 6).alias("mean1"), F.round("m2", 6).alias("mean2"), F.coalesce(apart, F.lit(False)).alias("split"))
