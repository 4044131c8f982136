"""Clusters of signatures: islands that no pair can cross, the exact rounds inside them, and statistics per cluster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder
from varloom.operators.graph import components
from varloom.operators.grouping import codes, map_groups, numbers
from varloom.operators.intervals import BIN, STRETCH, islands
from varloom.params import Params

KEYS = ["contig", "sv_type"]
#: What is told of a cluster: its contig, type and the thousand in which it begins.
LOCUS = ["contig", "sv_type", "locus"]
#: A cluster's key: several clusters may begin in one thousand.
CLUSTER = [*LOCUS, "cluster"]
#: What clusters are made of, and the order of signatures.
NEEDED = ["contig", "sv_type", "begin_pos", "end_pos", "length", "quality", "template", "hp"]
#: Pairs of rows compared at once.
PAIRS = 1 << 20
#: Rows of an island that one task takes whole; a larger island is dealt out by its components.
DENSE = 200_000


def by_type(values: tuple) -> Column:
    """The value that belongs to the row's sv_type."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.col("sv_type").cast("int") + 1)


def reach(p: Params) -> Column:
    """As far as any partner's begin may be: the fixed distance, or the length's share."""
    fixed = tuple(f * max(1.0, h) for f, h in zip(p.force, p.hp_diff, strict=True))
    return F.col("begin_pos") + F.greatest(by_type(fixed), F.col("length") * by_type(p.pos_ratio))


def with_islands(sig: DataFrame, p: Params) -> DataFrame:
    """Adds island: the first position of the row's island, which no pair of alike signatures leaves."""
    order = [F.col("begin_pos"), F.col("length"), F.desc("quality"), F.col("template"), F.col("end_pos")]
    return islands(sig, KEYS, "begin_pos", order, reach(p), "island")


def placed(sig: DataFrame, p: Params) -> DataFrame:
    """``sig`` with sig_id (the number in the order of its contig and type) and island, in one shuffle of the rows.

    Both are running values over the same stretches.  A row per stretch has what came before it: the rows, how far they reach,
    and the island that is open; the last needs one more pass, over begins and reaches alone.
    """
    order = [F.col("begin_pos"), F.col("length"), F.desc("quality"), F.col("template"), F.col("end_pos")]
    stretch = [*KEYS, "_s"]
    rows = sig.withColumns({"_s": F.floor(F.col("begin_pos") / STRETCH).cast("long"), "_r": reach(p)})
    before = Window.partitionBy(*KEYS).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*stretch).agg(F.count(F.lit(1)).alias("_n"), F.max("_r").alias("_m"))
    sums = sums.select(*stretch, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.max("_m").over(before).alias("_far"))

    def opened(part: DataFrame, inside, carried: DataFrame) -> DataFrame:
        """_opens: the row's begin, if no earlier row reaches it.  A row per stretch is broadcast: some thousands for a genome."""
        seen = part.withColumn("_i", F.max("_r").over(inside.rowsBetween(Window.unboundedPreceding, -1))).join(F.broadcast(carried), stretch)
        reached = F.greatest("_far", "_i")
        return seen.withColumn("_opens", F.when(reached.isNull() | (F.col("begin_pos") > reached), F.col("begin_pos")))

    # equal begins are of one island, whatever their order
    alone = opened(rows.select(*stretch, "begin_pos", "_r"), Window.partitionBy(*stretch).orderBy("begin_pos"), sums.drop("_before"))
    last = alone.groupBy(*stretch).agg(F.max("_opens").alias("_last")).select(*stretch, F.max("_last").over(before).alias("_open"))
    inside = Window.partitionBy(*stretch).orderBy(*order)
    found = opened(rows.withColumn("_k", F.row_number().over(inside)), inside, sums.join(last, stretch))
    island = F.greatest("_open", F.max("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return found.select(*sig.columns, (F.col("_before") + F.col("_k") - 1).cast("long").alias("sig_id"), island.alias("island"))


def most_rows(sig: DataFrame, p: Params) -> int:
    """A bound of the rows of an island: those of neighbouring stretches that rows reach over."""
    by = Window.partitionBy(*KEYS).orderBy("_s")
    sums = sig.groupBy(*KEYS, F.floor(F.col("begin_pos") / STRETCH).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.min("begin_pos").alias("_b"), F.max(reach(p)).alias("_m"))
    reached = F.max("_m").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = sums.withColumn("_cut", F.when(F.col("_b") <= reached, 0).otherwise(1)).withColumn("_run", F.sum("_cut").over(by))
    return cut.groupBy(*KEYS, "_run").agg(F.sum("_n").alias("n")).agg(F.max("n")).first()[0] or 0


def in_groups(sig: DataFrame, p: Params) -> DataFrame:
    """``sig`` (with sig_id) with island and part: the groups that the rounds can be run in one by one.

    A part is a whole island, whose part is 0.  In an island of more than DENSE rows it is a component of the graph of brothers: a
    cluster takes in what holds a brother, so no cluster leaves its component, and what rounds do in one doesn't
    depend on another.  Whether there may be such islands is told by the rows of stretches.
    """
    return in_parts(with_islands(sig, p), sig, p)


def in_parts(held: DataFrame, sig: DataFrame, p: Params) -> DataFrame:
    """``held`` (``sig`` with sig_id and island) with part; see :func:`in_groups`."""
    if most_rows(sig, p) <= DENSE:
        return held.withColumn("part", F.lit(0).cast("long"))
    folder = shared_folder(sig.sparkSession)
    held = materialize(held, folder, "islands")
    crowded = held.groupBy(*KEYS, "island").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > DENSE).select(*KEYS, "island", F.lit(True).alias("dense"))
    # fewer than one in DENSE rows
    marked = held.join(F.broadcast(crowded), [*KEYS, "island"], "left")
    found = components(brother_pairs(marked.filter("dense"), p), KEYS, folder).withColumnRenamed("node", "sig_id")
    # a row without brothers is a part of its own
    own = F.when(F.col("dense"), -1 - F.col("sig_id")).otherwise(0)
    return marked.join(found, [*KEYS, "sig_id"], "left").withColumn("part", F.coalesce("component", own).cast("long")).select(*held.columns, "part")


def with_locus(sig: DataFrame, p: Params) -> DataFrame:
    return with_islands(sig, p).withColumn("locus", F.col("island") - F.col("island") % 1000).drop("island")


def alike(a: str, b: str, p: Params) -> Column:
    """Whether rows of ``a`` and ``b`` of one type are brothers: near each other, or near for their length and about as long."""
    col = lambda t, c: F.col(f"{t}.{c}")
    gap = lambda c: F.abs(col(a, c) - col(b, c))
    of = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), col(a, "sv_type").cast("int") + 1)
    both = (col(a, "hp") != 0) & (col(b, "hp") != 0)
    ratio = F.when(both & (col(a, "hp") == col(b, "hp")), of(p.hp_same)).when(both, of(p.hp_diff)).otherwise(1.0)
    near = (gap("begin_pos") <= of(p.force) * ratio) & (gap("end_pos") <= of(p.force) * ratio)
    least = F.least(col(a, "length"), col(b, "length"))
    slack = F.greatest(of(p.length_min), F.floor(least * of(p.length_ratio))) * ratio
    scaled = (gap("begin_pos") <= least * of(p.pos_ratio)) & (gap("end_pos") <= least * of(p.pos_ratio)) & (gap("length") <= F.floor(slack))
    return (col(a, "template") != col(b, "template")) & (near | scaled)


def brother_pairs(sig: DataFrame, p: Params) -> DataFrame:
    """(contig, sv_type, a, b): numbers of brothers, a before b.

    Brothers begin within a bounded distance, so rows look for partners in their bin of begins and the next ones.
    """
    wide = F.ceil(F.greatest(by_type(tuple(f * h for f, h in zip(p.force, p.hp_diff, strict=True))), F.col("length") * by_type(p.pos_ratio)) / BIN).cast("long")
    home = F.floor(F.col("begin_pos") / BIN).cast("long")
    cols = ["contig", "sv_type", "sig_id", "begin_pos", "end_pos", "length", "template", "hp"]
    left = sig.select(*cols).withColumn("_bin", F.explode(F.sequence(home, home + wide))).alias("a")
    right = sig.select(*cols).withColumn("_bin", home).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*KEYS, "_bin")]
    after = F.col("a.sig_id") < F.col("b.sig_id")
    pairs = left.join(right, [*same, after]).filter(alike("a", "b", p))
    return pairs.select("a.contig", "a.sv_type", F.col("a.sig_id").alias("a"), F.col("b.sig_id").alias("b"))


def brothers(begin: np.ndarray, end: np.ndarray, length: np.ndarray, hp: np.ndarray, template: np.ndarray, sv_type: np.ndarray, group: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j), i before j, of all brothers among rows that come by group and begin.

    Brothers begin within a row's reach, so each row is compared with the rows of this stretch alone.
    """
    of = lambda values: np.array(values, np.float64)[sv_type]
    force, pos_ratio, length_ratio, length_min = of(p.force), of(p.pos_ratio), of(p.length_ratio), of(p.length_min)
    same, other = of(p.hp_same), of(p.hp_diff)
    reach = np.maximum(force * np.maximum(1, other), length * pos_ratio)
    lowest = begin.min(initial=0)
    wide = float(begin.max(initial=0) - lowest + reach.max(initial=0) + 2)
    place = group * wide + (begin - lowest)
    until = np.searchsorted(place, place + reach + 0.5, side="right")
    many = until - np.arange(len(begin)) - 1
    ends = np.cumsum(many)
    found, lo = [], 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        size = many[lo:hi]
        i = np.repeat(np.arange(lo, hi), size)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size)
        gap = lambda x: np.abs(x[i] - x[j])  # noqa: E731, B023
        tagged = (hp[i] != 0) & (hp[j] != 0)
        ratio = np.where(tagged & (hp[i] == hp[j]), same[i], np.where(tagged, other[i], 1.0))
        least = np.minimum(length[i], length[j])
        fixed = (gap(begin) <= force[i] * ratio) & (gap(end) <= force[i] * ratio)
        slack = np.floor(np.maximum(length_min[i], np.floor(least * length_ratio[i])) * ratio)
        scaled = (gap(begin) <= least * pos_ratio[i]) & (gap(end) <= least * pos_ratio[i]) & (gap(length) <= slack)
        link = (template[i] != template[j]) & (fixed | scaled)
        found.append((i[link], j[link]))
        lo = hi
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def gathered(i: np.ndarray, j: np.ndarray, group: np.ndarray, first: np.ndarray, last: np.ndarray, slack: np.ndarray, p: Params) -> np.ndarray:
    """A number for each row that tells clusters apart, from linked rows and the rows' extents.

    In each round, by their first begin, every cluster takes in the next one that holds a brother and isn't farther than
    ``slack``, once; rounds go on until one changes nothing.  The scan stops where clusters begin far behind the cluster's
    end.  What a cluster takes in begins no earlier, so the order stays; and it meets later clusters alone, so the links at
    a round's start are all that matter in it.
    """
    order = np.lexsort((first, group))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    into, (a, b) = np.arange(len(order)), (rank[i], rank[j])
    first, last, slack = first[order].astype(np.float64), last[order].astype(np.float64), slack[order]
    while True:
        x, y = into[a], into[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        pair = np.unique((x * len(order) + y)[x != y])
        x, y = pair // max(len(order), 1), pair % max(len(order), 1)
        open_ = first[y] <= last[x] + np.minimum(p.cluster_reach, 0.5 * (last[x] - first[x]))
        near = (first[y] <= last[x] + slack[x]) & (first[x] <= last[y] + slack[x])
        taken, done = {}, set()
        for k, m in zip(x[open_ & near].tolist(), y[open_ & near].tolist(), strict=True):
            if k not in done and k not in taken and m not in taken:
                taken[m] = k
                done.add(k)
        if not taken:
            return into[rank]
        gone, kept = np.array(list(taken), np.int64), np.array(list(taken.values()), np.int64)
        last[kept] = np.maximum(last[kept], last[gone])
        step = np.arange(len(order))
        step[gone] = kept
        into = step[into]


def slack_of(t: np.ndarray, p: Params) -> np.ndarray:
    """How far apart the extents of clusters may be that are taken together."""
    return np.array(p.force, np.float64)[t] + np.array(p.near, np.float64)[t]


def rounds(table: pa.Table, group: np.ndarray, p: Params) -> np.ndarray:
    """The clusters' numbers of signatures that come by group (an island of one type) and sig_id."""
    get = lambda c: numbers(table, c).astype(np.int64)
    t, begin, end = get("sv_type"), get("begin_pos"), get("end_pos")
    i, j = brothers(begin, end, get("length"), get("hp"), codes(table, "template"), t, group, p)
    return gathered(i, j, group, begin, end, slack_of(t, p), p)


def exact_clusters(sig: DataFrame, p: Params) -> DataFrame:
    """(contig, sv_type, sig_id, cluster): cluster is the smallest number of its members."""

    def run(table: pa.Table, group: np.ndarray) -> pa.Table:
        _, number = np.unique(rounds(table, group, p), return_inverse=True)
        name = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(name, number, numbers(table, "sig_id"))
        return table.select([*KEYS, "sig_id"]).append_column("cluster", pa.array(name[number]))

    held = in_groups(sig, p).select("contig", F.col("sv_type").cast("long"), "island", "part", "sig_id", "begin_pos", "end_pos", "length", "template", "hp")
    return map_groups(held, [*KEYS, "island", "part"], ["sig_id"], run, "contig string, sv_type long, sig_id long, cluster long")


def with_clusters(sig: DataFrame, p: Params, *used: str) -> DataFrame:
    """Adds sig_id, cluster (the smallest number of its members), locus (the thousand in which the cluster begins), within
    (whether a row is of the middle rows of a cluster above the largest size, or the cluster isn't above it), and the counts n
    and hp0 to hp2 of the cluster's rows within.

    With ``used`` only these columns stay beside those that clusters are made of, so only they are shuffled; quality then goes
    unless it is named.
    """
    rows = sig.select(*NEEDED, *(c for c in sig.columns if c in used and c not in NEEDED)) if used else sig
    held = in_parts(placed(rows, p), sig, p)
    held = held.drop("quality") if used and "quality" not in used else held
    added = {"locus": "bigint", "cluster": "bigint", "within": "boolean", "n": "bigint", "hp0": "bigint", "hp1": "bigint", "hp2": "bigint"}

    def run(table: pa.Table, group: np.ndarray) -> pa.Table:
        _, number = np.unique(rounds(table, group, p), return_inverse=True)
        name, first = (np.full(number.max() + 1, np.iinfo(np.int64).max) for _ in range(2))
        np.minimum.at(name, number, numbers(table, "sig_id"))
        np.minimum.at(first, number, numbers(table, "begin_pos").astype(np.int64))
        # rows come in the order of their numbers
        order = np.argsort(number, kind="stable")
        size = np.bincount(number)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        skip = (size // 2 - p.max_cluster // 2)[number]
        within = (size[number] <= p.max_cluster) | ((rank >= skip) & (rank < skip + p.max_cluster))
        hp = numbers(table, "hp").astype(np.int64)
        counts = [np.bincount(number, weights=within & (hp == h)).astype(np.int64)[number] for h in range(3)]
        values = [first[number] - first[number] % 1000, name[number], within, np.bincount(number, weights=within).astype(np.int64)[number], *counts]
        for column, value in zip(added, values, strict=True):
            table = table.append_column(column, pa.array(value))
        return table

    schema = held.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in added.items())).schema
    return map_groups(held, [*KEYS, "island", "part"], ["sig_id"], run, schema).drop("island", "part")


def support() -> list[Column]:
    """Signatures and templates; a cluster's rows within are bounded, and so are the sets of their templates."""
    ngs = F.col("tech") == 1
    return [
        F.count(F.lit(1)).alias("ss"), F.size(F.collect_set("template")).cast("long").alias("st"), F.count_if(ngs).alias("ss2"),
        F.size(F.collect_set(F.when(ngs, F.col("template")))).cast("long").alias("st2"),
    ]


def site() -> list[Column]:
    mean = lambda c: F.expr(f"sum({c}) div count(*)")
    return [mean("begin_pos").alias("pos"), mean("length").alias("sv_len")]


def spread() -> list[Column]:
    return [F.stddev_pop(c).alias(f"sd_{n}") for c, n in (("begin_pos", "begin"), ("end_pos", "end"), ("length", "length"))]


def length_score(sd: Column, sv_len: Column) -> Column:
    """100 less the spread of lengths in percent of the length; 0 at least."""
    return F.floor(F.round(F.greatest(F.lit(0.0), 100 - sd / sv_len * 100), 6)).cast("long")


def precise(p: Params) -> Column:
    """Whether a cluster of enough templates is hardly spread, by st and the sd columns."""
    flat = [F.round(f"sd_{c}", 6) < p.precise_sd for c in ("length", "begin", "end")]
    return (F.col("st") >= p.precise_templates) & flat[0] & flat[1] & flat[2]
