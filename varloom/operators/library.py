"""Insert sizes of a read-pair library: distribution, quantiles, and pairs that don't fit it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import reads as R

#: Bins of the quantile function, steps of the mean, and the quantile above which sizes are dropped.
BINS, STEPS, TOP = 1000, 10_000, 0.9995
#: Samples that are tried before all pairs are taken; the first has one pair in 2 to the power of this.
SAMPLES = 10
#: Pairs of a sample that is looked at.
LEAST_PAIRS = 1_000


def histogram(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, size, n, below): counts by size and the count of sizes up to it, for each library that ``keys`` tell apart.

    ``pairs`` has isize, or size and n where sizes are counted already.
    """
    keys = keys or []
    if {"size", "n"} <= set(pairs.columns):
        counts = pairs.groupBy(*keys, "size").agg(F.sum("n").alias("n"))
    else:
        counts = pairs.groupBy(*keys, F.col("isize").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    # rows are sizes, not pairs
    return counts.withColumn("below", F.sum("n").over(Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)))


def quantile_bins(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, bin, size) for bins 0 to BINS - 1: a size fills the bins up to its rounded share of all."""
    keys = keys or []
    whole = Window.partitionBy(*keys)
    h = histogram(pairs, keys).withColumn("total", F.max("below").over(whole))
    upto = F.rint(F.col("below") / F.col("total") * BINS).cast("long")
    filled = h.withColumn("upto", upto).withColumn("start", F.coalesce(F.lag("upto").over(whole.orderBy("size")), F.lit(0)))
    return filled.filter("upto > start").select(*keys, F.explode(F.sequence("start", F.col("upto") - 1)).alias("bin"), "size")


def bin_of(share: Column) -> Column:
    return F.greatest(F.ceil(share * BINS) - 1, F.lit(0)).cast("long")


def moments(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(*keys, mean, sd) over the quantiles at 0, 1/STEPS, ..., 1: one row for each library that ``keys`` tell apart."""
    steps = pairs.sparkSession.range(STEPS + 1).select(F.greatest(F.ceil(F.col("id") * BINS / STEPS) - 1, F.lit(0)).cast("long").alias("bin"))
    # both sides have a row per step, or per bin and library
    return steps.join(quantile_bins(pairs, keys), "bin").groupBy(*(keys or [])).agg(F.avg("size").alias("mean"), F.stddev_pop("size").alias("sd"))


def sampled(pairs: DataFrame, key: str) -> DataFrame:
    """A sample of ``pairs`` by hashes of ``key``, large enough for its sizes to settle; all of them if none is.

    The sample doubles until two in a row agree: ten quantiles within a base, and the shares up to them within a thousandth.
    """
    last: list[tuple[int, float]] = []
    for part in range(SAMPLES):
        rows = pairs.filter(F.pmod(F.xxhash64(key), F.lit(1 << SAMPLES)) < (1 << part))
        shares = histogram(rows).withColumn("share", F.col("below") / F.max("below").over(Window.partitionBy()))
        quantile = [F.min(F.when(F.col("share") >= k / 10, F.struct("size", "share"))).alias(f"q{k}") for k in range(1, 11)]
        upto = [F.max(F.when(F.col("size") <= size, F.col("share"))).alias(f"s{i}") for i, (size, _) in enumerate(last)]
        # one row of numbers
        found = shares.agg(F.max("below").alias("n"), *quantile, *upto).first()
        now = [tuple(found[f"q{k}"]) for k in range(1, 11)] if (found["n"] or 0) >= LEAST_PAIRS else []
        settled = [abs(a[0] - b[0]) < 1 and abs((found[f"s{i}"] or 0.0) - b[1]) < 0.001 for i, (a, b) in enumerate(zip(now, last, strict=False))]
        if len(settled) == 10 and all(settled):
            return rows
        last = now
    return pairs


def oriented(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pos, reverse, mate_pos, mate_reverse) with orient."""
    return pairs.withColumn("orient", R.orientation(F.col("pos"), F.col("reverse") == 0, F.col("mate_pos"), F.col("mate_reverse") == 0))


def core_reads(records: DataFrame) -> DataFrame:
    """Records (with ops) that may tell a library's sizes: sound, mapped pairs that aren't split and have a plain shape."""
    f, split = F.col("flag"), F.col("tags")["SA"].isNotNull()
    sound = ~R.has(f, R.FAILED | R.DUPLICATE) & (split | ~R.has(f, R.SECONDARY | R.SUPPLEMENTARY))
    mapped = R.has(f, R.PAIRED) & ~R.has(f, R.UNMAPPED | R.MATE_UNMAPPED)
    return records.filter(sound & mapped & (F.col("mapq") > 0) & ~split & R.plain_shape(F.col("ops"), R.has(f, R.REVERSE)))


def library_reads(records: DataFrame) -> DataFrame:
    """The downstream reads of ``records`` (of core reads' columns) whose mates are kept, with isize as the fragment's size.

    Of the upstream reads that start at one place the first speaks, unless it skips reference; of a pair that starts at one
    place the read that comes second is the downstream one.  Skipped reference is taken off the size.
    """
    rows = core_reads(records).filter("isize <> 0").withColumn("_ahead", F.col("pos") - F.col("mate_pos"))
    first = Window.partitionBy("source_id", "contig", "qname").orderBy("pos", "flag")
    rows = rows.withColumn("_up", (F.col("_ahead") < 0) | ((F.col("_ahead") == 0) & (F.row_number().over(first) == 1)))
    at = Window.partitionBy("source_id", "contig", "pos").orderBy("qname", "flag")
    up = rows.filter("_up").withColumn("_r", F.row_number().over(at)).filter("_r = 1").filter(~F.exists("ops", lambda o: o["op"] == "N"))
    kept = up.select("source_id", "contig", "qname")
    down = rows.filter(~F.col("_up")).join(kept, ["source_id", "contig", "qname"], "left_semi")
    return down.withColumn("isize", R.simple_size(F.greatest(F.abs("isize") - R.cigar_sum(F.col("ops"), ("N",)), F.lit(0)))).drop("_ahead", "_up")


def upstream_kept(pairs: DataFrame) -> DataFrame:
    """Of the upstream mates that start at one place, the first; pairs without a size are none."""
    ahead = pairs.filter((F.col("isize") != 0) & (F.col("reverse") == 0))
    w = Window.partitionBy("contig", "pos").orderBy("pair_id")
    return ahead.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def depth_filtered(pairs: DataFrame) -> DataFrame:
    """(pair_id, read_no): kept upstream mates (1) and the mates downstream (2) of these."""
    kept = upstream_kept(pairs).select("pair_id")
    down = pairs.select("pair_id").join(kept, "pair_id", "left_semi")
    return kept.withColumn("read_no", F.lit(1).cast("long")).unionByName(down.withColumn("read_no", F.lit(2).cast("long")))


def counters(records: DataFrame) -> DataFrame:
    """Per contig: paired and unpaired records, those of no certainty, of low and of high."""
    sure, paired = F.col("mapq") >= 20, R.has(F.col("flag"), R.PAIRED)
    return records.groupBy("contig").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(paired).alias("paired"), F.count_if(~paired).alias("unpaired"),
        F.count_if(F.col("mapq") == 0).alias("unsure"), F.count_if(~sure).alias("low"), F.count_if(sure).alias("high"),
    )
