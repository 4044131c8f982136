"""Merging the pieces of one event inside a read."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder
from varloom.operators.grouping import map_rows
from varloom.operators.intervals import numbered, running_count, running_max
from varloom.params import Params

Segment = tuple[int, int]


def read_signatures(sigs: DataFrame) -> DataFrame:
    """(read_id, sigs): a read's signatures (op_idx, begin_pos, length) of one type in order."""
    parts = F.array_sort(F.collect_list(F.struct("op_idx", "begin_pos", "length")))
    return sigs.groupBy("read_id").agg(F.transform(parts, lambda s: F.struct(s["begin_pos"].alias("begin"), s["length"].alias("length"))).alias("sigs"))


def simple_merge(reads: DataFrame, p: Params, regional: bool = False) -> DataFrame:
    """(read_id, begin_pos, length, first, parts): neighbours whose gap is small for the length so far become one.

    first is the number of the first of its parts, which are neighbours.  A fold over the read's array: the state is the list
    of finished segments and the open one.  ``regional`` measures the gap from the open one's begin.
    """
    kind = "array<struct<begin:bigint,length:bigint,first:int,parts:int>>"

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        gap = s["begin"] - last["begin"] - (F.lit(0) if regional else last["length"])
        apart = gap >= F.greatest(last["length"] * p.merge_portion, F.lit(float(p.merge_distance)))
        begun = F.coalesce(last["first"] + last["parts"], F.lit(0))
        single = F.struct(s["begin"].alias("begin"), s["length"].alias("length"), begun.alias("first"), F.lit(1).alias("parts"))
        grown = F.struct(last["begin"].alias("begin"), (last["length"] + s["length"]).alias("length"), last["first"].alias("first"), (last["parts"] + 1).alias("parts"))
        return F.when((F.size(done) == 0) | apart, F.concat(done, F.array(single))).otherwise(F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown)))

    found = reads.select("read_id", F.explode(F.aggregate("sigs", F.array().cast(kind), step)).alias("m"))
    rows = found.select("read_id", F.col("m.begin").alias("begin_pos"), F.col("m.length").alias("length"), F.col("m.first").cast("long").alias("first"), F.col("m.parts").cast("long").alias("parts"))
    return rows.filter(F.col("length") >= p.min_sv_len)


def relevant_ranges(reads: DataFrame) -> DataFrame:
    """``reads`` (region, read_id, del_begin, del_end, begin) with their number and the range of numbers of reads that may matter.

    Reads stand in the order of their first deletion, those without one first (-1).  The range goes from the first whose running
    greatest deletion end lies behind the read's begin to the first whose first deletion does.
    """
    order = [F.col("del_begin"), F.col("read_id")]
    rows = numbered(reads, ["region"], "del_begin", order, "idx")
    # used five times from here on
    rows = materialize(running_max(rows, ["region"], "del_begin", order, F.col("del_end"), "max_end"), shared_folder(reads.sparkSession), "ranked")

    def upto(value: str, name: str) -> DataFrame:
        both = rows.select("region", F.col(value).alias("x"), F.lit(0).alias("asks"), "read_id").unionByName(rows.select("region", F.col("begin").alias("x"), F.lit(1).alias("asks"), "read_id"))
        counted = running_count(both, ["region"], "x", [F.col("x"), F.col("asks"), F.col("read_id")], F.col("asks") == 0, name)
        return counted.filter("asks = 1").select("region", "read_id", name)

    return rows.join(upto("max_end", "first"), ["region", "read_id"]).join(upto("del_begin", "after"), ["region", "read_id"])


def candidate_links(segs: list[tuple[int, int]], limit: int, most: int) -> list[int]:
    """Numbers i where segment i may be linked with the next, the nearest first, at most ``most``."""
    gaps = [(segs[i + 1][0] - segs[i][1], i) for i in range(len(segs) - 1)]
    return [i for gap, i in sorted(gaps) if gap < limit][:most]


def linked(segs: list[Segment], links: set[int], weight: int) -> tuple[list[Segment], int]:
    """(segments after linking, score): each link earns ``weight``, gaps cost; costs never fall below nothing on the way."""
    out: list[Segment] = []
    cost = 0
    for i, (begin, end) in enumerate(segs):
        if i - 1 in links:
            head, tail = out[-1]
            out[-1] = (head, tail + end - begin)
            cost = max(0, cost + begin - segs[i - 1][1])
        else:
            out.append((begin, end))
    return out, weight * len(links) - cost


def likeness(one: list[Segment], other: list[Segment], reach: int) -> int:
    """Sum over pairs that lie near each other and are about as long of how alike their lengths are."""
    total = 0
    for b1, e1 in one:
        for b2, e2 in other:
            apart = abs((e1 - b1) - (e2 - b2))
            if b2 <= b1 + reach and abs(b1 - b2) + abs(e1 - e2) <= reach and apart <= reach:
                total += reach - apart
    return total


def runs_of(segs: list[Segment]) -> dict[tuple[int, int], Segment]:
    """Every run of neighbouring segments, as the one segment that it makes when linked."""
    return {(i, j): (segs[i][0], segs[i][0] + sum(e - b for b, e in segs[i:j])) for i in range(len(segs)) for j in range(i + 1, len(segs) + 1)}


def best_cuts(gain: np.ndarray, n: int) -> np.ndarray:
    """For gains (choice, read, run) of reads with n segments: the greatest sum over all ways to cut these into runs."""
    place = {k: x for x, k in enumerate((i, j) for i in range(n) for j in range(i + 1, n + 1))}
    best = [np.zeros(gain.shape[:2], np.int64)]
    for j in range(1, n + 1):
        best.append(np.max([best[i] + gain[:, :, place[i, j]] for i in range(j)], axis=0))
    return best[n]


def omni(segs: list[Segment], others: list[list[Segment]], t: int, p: Params) -> list[Segment]:
    """The linking of a read's segments with the greatest score; the first of equals, fewer links first.

    A linking's segments are runs of the read's own, so the likeness of each own run to each run of another read is
    worked out once, and all linkings are scored together.
    """
    edges = candidate_links(segs, p.merge_distance, p.omni_edges)
    own = {k: i for i, k in enumerate(runs_of(segs))}
    choices = [{e for e, c in zip(edges, choice, strict=True) if c} for choice in product((False, True), repeat=len(edges))]
    uses = np.zeros((len(choices), len(own)), np.int64)
    for c, links in enumerate(choices):
        cuts = [0, *(i + 1 for i in range(len(segs) - 1) if i not in links), len(segs)]
        uses[c, [own[a] for a in zip(cuts, cuts[1:], strict=False)]] = 1
    alike = np.zeros(len(choices), np.int64)
    for n in sorted({len(o) for o in others}):
        some = [o for o in others if len(o) == n]
        gain = uses @ _likenesses(list(runs_of(segs).values()), [r for o in some for r in runs_of(o).values()], p.omni_b[t])
        if gain.any():
            alike += best_cuts(gain.reshape(len(choices), len(some), -1), n).sum(1)
    best, top = segs, None
    for links, more in zip(choices, alike.tolist(), strict=True):
        made, score = linked(segs, links, p.omni_a[t])
        score = int(score + more * p.omni_ratio)
        if top is None or score > top:
            best, top = made, score
    return best


def _likenesses(one: list[Segment], other: list[Segment], reach: int) -> np.ndarray:
    """:func:`likeness` of each segment with each."""
    a, b = np.array(one, np.int64).reshape(-1, 2), np.array(other, np.int64).reshape(-1, 2)
    apart = np.abs((a[:, 1] - a[:, 0])[:, None] - (b[:, 1] - b[:, 0])[None])
    ends = np.abs(a[:, None, 0] - b[None, :, 0]) + np.abs(a[:, None, 1] - b[None, :, 1])
    near = (b[None, :, 0] <= a[:, None, 0] + reach) & (ends <= reach) & (apart <= reach)
    return np.where(near, reach - apart, 0)


def omni_merge(reads: DataFrame, t: int, p: Params) -> DataFrame:
    """(read_id, begin_pos, length, first, parts) after merging, of ``reads`` (of :func:`relevant_ranges`, with sigs).

    Each read meets a sample of the reads in its range: every step-th one, omni_relevant + 1 at most.
    """
    step = F.greatest(F.lit(1).cast("long"), F.expr(f"(after - first) div {p.omni_relevant}"))
    gaps = F.transform(F.sequence(F.lit(1), F.size("sigs") - 1), lambda i: F.get("sigs", i)["begin"] - F.get("sigs", i - 1)["begin"] - F.get("sigs", i - 1)["length"])
    linkable = F.when(F.size("sigs") > 1, F.exists(gaps, lambda g: g < p.merge_distance)).otherwise(F.lit(False))
    # most reads have nothing to link, and stay as they are
    some = reads.filter((F.size("sigs") > 0) & linkable)
    plain = reads.filter((F.size("sigs") > 0) & ~linkable).select("read_id", F.posexplode("sigs").alias("k", "s"))
    plain = plain.select("read_id", F.col("s.begin").alias("begin_pos"), F.col("s.length").alias("length"), F.col("k").cast("long").alias("first"), F.lit(1).cast("long").alias("parts"))
    met = some.filter("after > first").select("region", "read_id", F.col("idx").alias("own"), F.explode(F.sequence(F.col("first"), F.col("after") - 1, step)).alias("idx")).filter("own <> idx")
    others = reads.select("region", "idx", F.col("sigs").alias("other")).filter(F.size("other") > 0)
    pairs = met.join(others, ["region", "idx"]).select("read_id", "idx", "other")
    rows = some.select("read_id", F.lit(-1).cast("long").alias("idx"), F.col("sigs").alias("other")).unionByName(pairs)
    begins, ends = F.transform("other", lambda s: s["begin"]), F.transform("other", lambda s: s["begin"] + s["length"])
    rows = rows.select("read_id", "idx", begins.alias("begins"), ends.alias("ends"))

    def run(group: list[dict]) -> Iterator[tuple]:
        parts = [list(zip(row["begins"], row["ends"], strict=True)) for row in group]
        first = 0
        for begin, end in omni(parts[0], parts[1 : p.omni_relevant + 2], t, p):
            # a segment's parts are neighbours, and their lengths make its own
            upto, length = first, 0
            while length < end - begin:
                length += parts[0][upto][1] - parts[0][upto][0]
                upto += 1
            yield group[0]["read_id"], begin, end - begin, first, upto - first
            first = upto

    return plain.unionByName(map_rows(rows, ["read_id"], ["idx"], run, "read_id long, begin_pos long, length long, first long, parts long"))
