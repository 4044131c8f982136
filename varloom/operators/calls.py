"""Calls from clusters: haplotype-aware cut-offs, filters, genotypes, and checks between calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators import clusters as C
from varloom.operators import coverage as V
from varloom.operators.intervals import containing
from varloom.params import GENOTYPE_RATIO, TYPES, Params

#: Bases around an insertion that a record must span, and the tail probability of one haplotype below which a call is homozygous.
SCOPE, TAIL = 400, 2e-5


def with_cutoffs(rows: DataFrame, p: Params) -> DataFrame:
    """``rows`` (of :func:`clusters.with_clusters`) within their clusters' largest size, with shp (tagged share), drop_untagged and
    co (factor of the filter's limits)."""
    t = C.by_type
    tagged = F.col("hp1") + F.col("hp2")
    g = rows.filter("within").withColumn("shp", tagged / F.col("n"))
    above = F.col("shp") > t(p.hp_ratio)
    one_sided = F.greatest("hp1", "hp2") / F.when(tagged > 0, tagged) > t(p.homo_ratio)
    over, under = F.col("shp") - t(p.hp_ratio), t(p.hp_ratio) - F.col("shp")
    co = (
        F.when(above & one_sided, 1 - t(p.homo_minus) - t(p.homo_minus_ratio) * over)
        .when(above, 1 - t(p.other_minus) - t(p.other_minus_ratio) * over)
        .otherwise(1 + (t(p.low_plus) + t(p.low_plus_ratio)) * under)
    )
    return g.withColumn("drop_untagged", F.coalesce(above & one_sided, F.lit(False))).withColumn("co", co)


#: What :func:`measured` reads of signatures, beside what clusters are made of.
USED = ("quality", "tech", "inv_left", "inv_right", "cn", "contig_id", "ins_bases")
#: What belongs to a cluster as a whole, and stands in each of its rows.
SHARED = ("n", "hp0", "hp1", "hp2", "shp", "drop_untagged", "co")


def cutoffs(rows: DataFrame, p: Params) -> DataFrame:
    """Per cluster: hp0 to hp2, n, shp, drop_untagged and co."""
    return with_cutoffs(rows, p).groupBy(*C.CLUSTER).agg(*(F.first(c).alias(c) for c in SHARED))


def measured(rows: DataFrame, p: Params) -> DataFrame:
    """Clusters with their cut-offs, and support, site, spread and so on of the rows that the cut-offs keep.

    One grouping: the haplotype counts came with the clusters.  Only a filter by weight needs two more.  Lists of lengths and bases are bounded by the largest size.
    bases are those of the first insertion that is as long as the mean; without a column ins_bases there are none.
    """
    kept = with_cutoffs(rows, p).filter(~(F.col("drop_untagged") & (F.col("hp") == 0)))
    kept = kept if "ins_bases" in rows.columns else kept.withColumn("ins_bases", F.lit(None).cast("string"))
    sides = [F.bool_or("inv_left").alias("inv_left"), F.bool_or("inv_right").alias("inv_right"), F.max("cn").alias("cn"), F.min("contig_id").cast("long").alias("contig_id")]
    place = F.struct(F.when(F.col("drop_untagged"), F.col("hp")).otherwise(0).alias("hp"), "begin_pos", "length", (-F.col("quality")).alias("quality"), "template", "end_pos", F.col("ins_bases").alias("bases"))
    spelled = F.collect_list(F.when((F.col("sv_type") == 1) & F.col("ins_bases").isNotNull(), place)).alias("_spelled")
    core = F.count_if("core") if "core" in rows.columns else F.lit(0).cast("long")
    m = kept.groupBy(*C.CLUSTER).agg(
        *C.support(), *C.site(), *C.spread(), *sides, spelled, F.sort_array(F.collect_list("length")).alias("_lengths"), F.min("length").alias("shortest"), F.max("length").alias("longest"),
        core.alias("_core"), *(F.first(c).alias(c) for c in SHARED),
    )
    fitting = F.filter(F.array_sort("_spelled"), lambda x: F.length(x["bases"]) >= F.col("sv_len"))
    m = m.filter("sv_len > 0").withColumns({
        "ls": C.length_score(F.col("sd_length"), F.col("sv_len")),
        "middle": F.get("_lengths", F.floor(F.size("_lengths") / 2).cast("int")),
        "bases": F.substring(F.get(fitting, F.lit(0))["bases"], F.lit(1), F.col("sv_len").cast("int")),
        # whole, as a quotient of whole numbers
        "cr": F.floor(F.col("_core") / F.col("ss")).cast("double"),
        "is_precise": C.precise(p),
    })
    m = m.drop("_lengths", "_spelled", "_core")
    return m.join(weights(kept), C.CLUSTER) if p.weight_filter else m


def weights(rows: DataFrame) -> DataFrame:
    """Per cluster: weight, the sum of its templates' highest qualities."""
    best = rows.groupBy(*C.CLUSTER, "template").agg(F.max(F.col("quality").cast("double")).alias("q"))
    return best.groupBy(*C.CLUSTER).agg(F.sum("q").alias("weight"))


def filtered(calls: DataFrame, total: DataFrame, p: Params) -> DataFrame:
    """``calls`` (of :func:`measured`) with keep and pstd; ``total`` (contig, contig_cov, total_cov) has a row per contig.

    pstd is the spread of begins where it is looked at: of insertions, or of all types that ask for it, unless an earlier
    rule decides; else -1.
    """
    t = C.by_type
    rows = calls.join(F.broadcast(total.select("contig", "contig_cov", "total_cov")), "contig")
    score = F.col("weight") if p.weight_filter else F.col("st")
    passes = lambda base, multi, least: (score >= (t(base) + F.col("total_cov") * t(multi)) * F.col("co")) & (F.col("ls") >= t(least) * F.col("co"))
    wide = (t(p.min_pos_sd) != -1) & (F.col("sd_begin") > t(p.min_pos_sd))
    many = (F.col("st2") > 30) | F.lit(p.filter_2st)
    keep = (
        F.when(F.lit(p.no_filter), True)
        .when(F.col("st") < 2, False)
        .when(many, True)
        .when(wide, False)
        .when((F.col("sv_type") >= 2) & (F.col("ss") - F.col("st") > F.col("st")), False)
        .when((F.col("sv_type") == 3) & ~(F.col("inv_left") & F.col("inv_right")), False)
        .when(passes(p.base1, p.multi1, p.score1), True)
        .otherwise(passes(p.base2, p.multi2, p.score2))
    )
    looked = ~F.lit(p.no_filter) & (F.col("st") >= 2) & ~many & ((F.col("sv_type") == 1) | F.lit(p.calc_pos_sd) | (t(p.min_pos_sd) != -1))
    return rows.withColumn("keep", keep).withColumn("pstd", F.when(looked, F.col("sd_begin")).otherwise(-1.0))


def genotyped(calls: DataFrame, aln: DataFrame, contigs: DataFrame, cov: DataFrame, p: Params) -> DataFrame:
    """``calls`` with cv (records over the place) and gt.

    An insertion's are the primary segments that span it with SCOPE bases on both sides; the others' the mean coverage.
    """
    sized = calls.join(F.broadcast(contigs.select("contig", "size")), "contig")
    key = [*C.CLUSTER, "pos", "sv_len"]
    ins = sized.filter("sv_type = 1").select(*key, F.greatest(F.col("pos") - SCOPE, F.lit(0)).alias("from_pos"), F.least(F.col("pos") + SCOPE, F.col("size") - 1).alias("to_pos"))
    spans = V.spanning(V.primary_segments(aln), ins, "from_pos", "to_pos").select(*key, F.col("n").alias("cv"))
    rest = sized.filter("sv_type <> 1").select(*key)
    means = V.average(cov, rest, F.col("pos"), F.col("pos") + F.col("sv_len"), p).select(*key, F.floor(F.round("average", 6)).cast("long").alias("cv"))
    ratio = C.by_type(tuple(GENOTYPE_RATIO[k] for k in range(4)))
    gt = F.when((F.col("cv") == 0) | (F.col("st") / F.when(F.col("cv") > 0, F.col("cv")) >= ratio), "1/1").otherwise("0/1")
    return calls.join(spans.unionByName(means), key).withColumn("gt", gt)


def flag_duplicated_insertions(calls: DataFrame) -> DataFrame:
    """Insertions with inside: whether they lie in a duplication that is no shorter and are too widely spread to be their own.

    Only contigs with more than a duplication to 20 insertions are looked at.
    """
    kept = calls.groupBy("contig").agg(F.count_if(F.col("keep") & (F.col("sv_type") == 2)).alias("dups"), F.count_if(F.col("keep") & (F.col("sv_type") == 1)).alias("inss"))
    ratio = kept.select("contig", (F.col("dups") / F.when(F.col("inss") > 0, F.col("inss"))).alias("ratio")).filter("ratio > 0.05")
    ins = calls.filter("sv_type = 1 and keep").join(F.broadcast(ratio), "contig", "left")
    wide = ins.filter(F.col("ratio").isNotNull() & (F.floor("sd_begin") >= 2 / F.col("ratio")))
    dups = calls.filter("sv_type = 2").select("contig", F.col("pos").alias("begin_pos"), (F.col("pos") + F.col("sv_len")).alias("end_pos"))
    met = containing(wide.select(*C.CLUSTER, "pos", "sv_len"), dups, "pos", "pos")
    found = met.filter(F.col("sv_len") <= F.col("_e") - F.col("_b")).select(*C.CLUSTER).distinct().withColumn("inside", F.lit(True))
    return ins.drop("ratio").join(found, C.CLUSTER, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def balance(calls: DataFrame) -> DataFrame:
    """(small, big): rows of the lesser and the greater haplotype over all kept calls that aren't homozygous; one row."""
    some = calls.filter(F.col("keep") & (F.col("gt") != "1/1"))
    return some.agg(F.coalesce(F.sum(F.least("hp1", "hp2")), F.lit(0)).alias("small"), F.coalesce(F.sum(F.greatest("hp1", "hp2")), F.lit(0)).alias("big"))


def tail(n: Column, k: Column, p: Column) -> Column:
    """Probability of k to n - 1 successes in n draws, term by term from that of none."""
    step = lambda acc, i: F.struct(
        (acc["term"] * (n - i) / (i + 1) * p / (1 - p)).alias("term"), (acc["sum"] + F.when(i >= k, acc["term"]).otherwise(0.0)).alias("sum")
    )
    start = F.struct(F.pow(1 - p, n).alias("term"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), n - 1), start, step, lambda acc: acc["sum"])


def regenotyped(calls: DataFrame) -> DataFrame:
    """``calls`` with gt set to 1/1 where the lesser haplotype's share is too small to be chance."""
    b = F.broadcast(balance(calls))
    chance = F.when(F.col("big") > 100, F.col("small") / (F.col("small") + F.col("big"))).otherwise(F.lit(0.015))
    n, k = F.col("hp1") + F.col("hp2"), F.least("hp1", "hp2")
    rare = tail(n, k, F.col("_p")) < TAIL
    new = F.when((F.col("shp") > 0.8) & (n > 0) & rare, "1/1").otherwise(F.col("gt"))
    return calls.crossJoin(b).withColumn("_p", chance).withColumn("gt", new).drop("_p", "small", "big")


def type_name() -> Column:
    return F.element_at(F.array(*map(F.lit, TYPES)), F.col("sv_type").cast("int") + 1)
