"""Coverage in windows, and what lies over an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import reads as R
from varloom.operators.intervals import STRETCH, containing
from varloom.params import Params

#: Windows of a block.
WINDOWS = 100


def primary_segments(aln: DataFrame) -> DataFrame:
    return aln.filter(R.is_primary(F.col("flag"))).select("contig", F.col("pos").alias("begin_pos"), F.col("ref_end").alias("end_pos"))


def windows(aln: DataFrame, p: Params) -> DataFrame:
    """(contig, w, cov) of well-mapped primary records."""
    return windowed(aln.filter(R.is_primary(F.col("flag")) & (F.col("mapq") >= p.min_mapq)), p)


def windowed(rows: DataFrame, p: Params) -> DataFrame:
    """(contig, w, cov): shares of the first and last window that ``rows`` (contig, pos, ref_end) cover, and 1 for those between.

    A row inside one window counts from its begin to the window's end.
    """
    size = p.window
    first, last = F.expr(f"pos div {size}"), F.expr(f"ref_end div {size}")
    # a row's borders, and where the windows that it covers whole begin and end: three rows, however long it is
    event = lambda w, part, step: F.struct(w.alias("w"), part.cast("long").alias("part"), F.lit(step).cast("long").alias("step"))
    head = (first + 1) * size - F.col("pos")
    inner = [event(first + 1, F.lit(0), 1), event(last, F.col("ref_end") + 1 - last * size, -1)]
    events = F.when(first == last, F.array(event(first, head, 0))).otherwise(F.array(event(first, head, 0), *inner))
    each = rows.filter(first <= last).select("contig", F.explode(events).alias("e"))
    changed = each.groupBy("contig", F.col("e.w").alias("w")).agg(F.sum("e.part").alias("part"), F.sum("e.step").alias("step"))
    changed = changed.withColumn("_s", F.floor(F.col("w") * size / STRETCH).cast("long"))
    # running sums inside stretches; a row for each stretch has what came before, and where the next one's windows begin
    by_stretch, inside = Window.partitionBy("contig").orderBy("_s"), Window.partitionBy("contig", "_s").orderBy("w")
    carried = changed.groupBy("contig", "_s").agg(F.sum("step").alias("_sum"), F.min("w").alias("_first"))
    carried = carried.select("contig", "_s", F.coalesce(F.sum("_sum").over(by_stretch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(by_stretch).alias("_next"))
    rows = changed.withColumns({"_open": F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_then": F.lead("w").over(inside)}).join(carried, ["contig", "_s"])
    rows = rows.select("contig", "w", "part", (F.col("_before") + F.col("_open")).alias("open"), F.coalesce("_then", "_next").alias("then"))
    until = F.when((F.col("open") > 0) & F.col("then").isNotNull(), F.col("then") - 1).otherwise(F.col("w"))
    spread = rows.select("contig", F.col("w").alias("_w"), "part", "open", F.explode(F.sequence("w", until)).alias("w"))
    return spread.select("contig", "w", (F.when(F.col("w") == F.col("_w"), F.col("part") / size).otherwise(0.0) + F.col("open")).alias("cov"))


def average(cov: DataFrame, spans: DataFrame, start: Column, end: Column, p: Params) -> DataFrame:
    """``spans`` with average: the mean over the windows from ``start`` to ``end``; windows without records count as 0.

    ``spans`` has unique rows of contig and other columns.  Whole blocks of windows are looked up as one; only the windows before
    the first and behind the last whole block by themselves.
    """
    first, last = F.floor(start / p.window).cast("long"), F.floor(end / p.window).cast("long")
    keys = spans.columns
    # whole blocks from _p to _q - 1
    asked = spans.withColumns({"_f": first, "_l": last}).withColumns({"_p": F.ceil(F.col("_f") / WINDOWS).cast("long"), "_q": F.floor((F.col("_l") + 1) / WINDOWS).cast("long")})
    whole = F.col("_p") < F.col("_q")
    ends = F.when(whole, F.concat(_upto(F.col("_f"), F.col("_p") * WINDOWS), _upto(F.col("_q") * WINDOWS, F.col("_l") + 1))).otherwise(_upto(F.col("_f"), F.col("_l") + 1))
    place = F.concat(F.transform(ends, lambda w: F.struct(F.lit(False).alias("block"), w.alias("w"))), F.transform(F.when(whole, _upto(F.col("_p"), F.col("_q"))).otherwise(F.array().cast("array<bigint>")), lambda w: F.struct(F.lit(True).alias("block"), w.alias("w"))))
    blocks = cov.groupBy("contig", F.floor(F.col("w") / WINDOWS).cast("long").alias("w")).agg(F.sum("cov").alias("cov"))
    both = cov.select("contig", F.lit(False).alias("block"), "w", "cov").unionByName(blocks.withColumn("block", F.lit(True)))
    rows = asked.withColumn("_at", F.explode(place)).withColumns({"block": F.col("_at.block"), "w": F.col("_at.w"), "_n": F.col("_l") - F.col("_f") + 1})
    found = rows.join(both, ["contig", "block", "w"], "left").groupBy(*keys, "_n")
    return found.agg((F.round(F.sum(F.coalesce("cov", F.lit(0.0))), 6) / F.col("_n")).alias("average")).drop("_n")


def _upto(start: Column, end: Column) -> Column:
    """Whole numbers from ``start`` to ``end``, exclusive."""
    return F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))


def cumulative(cov: DataFrame, contigs: DataFrame, p: Params) -> DataFrame:
    """(contig_id, contig, contig_cov, total_cov): a contig's mean, and the mean of all contigs up to it weighted by size."""
    sums = cov.groupBy("contig").agg(F.sum("cov").alias("s"))
    mean = F.coalesce("s", F.lit(0.0)) / (F.floor(F.col("size") / p.window) + 1)
    w = Window.orderBy("contig_id").rowsBetween(Window.unboundedPreceding, 0)
    # one row per contig
    means = contigs.join(sums, "contig", "left").withColumn("contig_cov", mean)
    total = F.sum(F.col("contig_cov") * F.col("size")).over(w) / F.sum("size").over(w)
    return means.select("contig_id", "contig", "contig_cov", total.alias("total_cov"))


def spanning(segments: DataFrame, spans: DataFrame, start: str, end: str) -> DataFrame:
    """``spans`` (unique rows) with n: how many segments contain them; those that none contains have 0."""
    keys = spans.columns
    found = containing(spans, segments, start, end).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return spans.join(found, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
