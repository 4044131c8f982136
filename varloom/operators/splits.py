"""Signatures from split reads: a read's segments in the order in which the read passes them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators.grouping import map_rows
from varloom.params import Params

#: Segments further apart than this belong to no common event.
FAR = 1_000_000


def inner_coordinates(segs: DataFrame) -> DataFrame:
    """Adds read_len, and inner_pos and inner_end along the aligned strand: those of reverse segments count from the read's end."""
    size = F.max("fwd_end").over(Window.partitionBy("read_id"))
    forward = F.col("strand") == 1
    return (
        segs.withColumn("read_len", size)
        .withColumn("inner_pos", F.when(forward, F.col("fwd_pos")).otherwise(F.col("read_len") - F.col("fwd_end")))
        .withColumn("inner_end", F.when(forward, F.col("fwd_end")).otherwise(F.col("read_len") - F.col("fwd_pos")))
    )


def quality() -> Column:
    return 1 - F.col("nm") / (F.col("fwd_end") - F.col("fwd_pos"))


def supplementary_tags(segs: DataFrame) -> DataFrame:
    """(read_id, sa): every segment of a read as an entry of the tag, in order."""
    size = F.col("ref_end") - F.col("pos")
    entry = F.concat_ws(",", "contig", "pos", F.when(F.col("strand") == 1, "+").otherwise("-"), F.concat(size.cast("string"), F.lit("M")), F.lit("60"), "nm")
    parts = F.array_sort(F.collect_list(F.struct("idx", entry.alias("e"))))
    return segs.groupBy("read_id").agg(F.concat(F.array_join(F.transform(parts, lambda p: p["e"]), ";"), F.lit(";")).alias("sa"))


def parse_supplementary(reads: DataFrame, *more: str) -> DataFrame:
    """(read_id, ``more``, idx, contig, pos, strand, cigar, mapq, nm) of the tag's entries; empty entries are none."""
    entries = F.filter(F.split("sa", ";"), lambda e: e != "")
    f = F.split("e", ",")
    return reads.select("read_id", *more, F.posexplode(entries).alias("idx", "e")).select(
        "read_id", *more, F.col("idx").cast("long").alias("idx"), f[0].alias("contig"), f[1].cast("long").alias("pos"),
        F.when(f[2] == "+", 1).otherwise(0).cast("long").alias("strand"), f[3].alias("cigar"), f[4].cast("long").alias("mapq"), f[5].cast("long").alias("nm"),
    )


def next_on_strand(segs: DataFrame) -> DataFrame:
    """Each segment with the read's next one on its contig and strand within FAR, as columns of ``former`` and ``latter``.

    former is the one that lies first on the reference in the direction of the strand.  A read's segments of one strand are
    an array, in which each looks ahead.
    """
    cols = ["idx", "pos", "ref_end", "fwd_pos", "fwd_end", "quality"]
    held = segs if "quality" in segs.columns else segs.withColumn("quality", quality())
    reads = held.groupBy("read_id", "contig", "strand").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("s"))
    each = reads.filter(F.size("s") > 1).select("read_id", "contig", "strand", "s", F.posexplode("s").alias("k", "a"))
    ahead = F.filter(F.slice("s", F.col("k") + 2, F.size("s")), lambda x: F.abs(x["pos"] - F.col("a.pos")) <= FAR)
    pairs = each.withColumn("b", F.get(ahead, F.lit(0))).filter("b is not null")
    forward = F.col("strand") == 1
    pick = lambda c, one, two: F.when(forward, F.col(f"{one}.{c}")).otherwise(F.col(f"{two}.{c}"))
    return pairs.select(
        "read_id", "contig", F.col("a.idx").alias("a_idx"), (F.col("b.fwd_pos") - F.col("a.fwd_end")).alias("inner_gap"),
        pick("ref_end", "a", "b").alias("former_end"), pick("pos", "b", "a").alias("latter_pos"), ((F.col("a.quality") + F.col("b.quality")) / 2).alias("quality"),
    )


def split_deletions(segs: DataFrame, p: Params) -> DataFrame:
    """The reference has more bases than the read between two segments."""
    gap = F.col("latter_pos") - F.col("former_end")
    extra = gap - F.col("inner_gap")
    found = next_on_strand(segs).filter((gap > 0) & (extra >= p.min_sv_len) & (gap <= 2 * extra))
    return found.select("read_id", "contig", "a_idx", F.col("former_end").alias("begin_pos"), F.col("latter_pos").alias("end_pos"), "quality")


def split_insertions(segs: DataFrame, sizes: DataFrame, p: Params) -> DataFrame:
    """The read has more bases than the reference between two segments; ``sizes`` gives the contigs' sizes."""
    extra = F.col("inner_gap") - (F.col("latter_pos") - F.col("former_end"))
    found = next_on_strand(segs).filter((F.col("former_end") < F.col("latter_pos") + p.ins_clip_tolerance) & (extra >= p.min_sv_len))
    begin = F.floor((F.col("former_end") + F.col("latter_pos")) / 2).cast("long")
    # a row per contig
    found = found.withColumn("begin_pos", begin).withColumn("extra", extra).join(F.broadcast(sizes), "contig")
    return found.select("read_id", "contig", "a_idx", "begin_pos", F.least(F.col("size") - 1, F.col("begin_pos") + F.col("extra")).alias("end_pos"), "quality")


def _alike(s1: float, e1: float, s2: float, e2: float) -> bool:
    """Two duplications of about the same length around about the same middle."""
    l1, l2 = e1 - s1, e2 - s2
    longest = max(l1, l2)
    return abs(l1 - l2) / min(200, longest) + abs((s1 + e1) / 2 - (s2 + e2) / 2) / longest < 0.3


def fold_duplications(rows: list[dict], least: int) -> Iterator[dict]:
    """Runs of neighbouring overlaps of one read: alike ones count as further copies of one duplication."""
    run: dict | None = None
    for a, b in zip(rows, rows[1:], strict=False):
        if a["contig"] != b["contig"] or a["strand"] != b["strand"] or abs(a["pos"] - b["pos"]) > FAR:
            continue
        former, latter = (a, b) if a["strand"] == 1 else (b, a)
        start, end = latter["pos"], former["ref_end"]
        if end - start < least:
            continue
        here, quality = (a["contig"], a["strand"]), 0.5 * (former["quality"] + latter["quality"])
        if run and run["here"] == here and _alike(run["start"], run["end"], start, end):
            n = run["copies"]
            mean = lambda old, new: old * (n / (n + 1)) + new * (1 / (n + 1))  # noqa: B023, E731
            run |= {"start": int(mean(run["start"], start)), "end": int(mean(run["end"], end)), "quality": mean(run["quality"], quality), "copies": n + 1}
            continue
        if run and run["end"] - run["start"] > least:
            yield run
        run = {"here": here, "start": start, "end": end, "quality": quality, "copies": 2}
    if run and run["end"] - run["start"] >= least:
        yield run


def split_duplications(segs: DataFrame, p: Params) -> DataFrame:
    """(read_id, contig, begin_pos, end_pos, copies, quality): the read passes a stretch of the reference again.

    The fold depends on its own running means, so each read's few segments are handled in order.
    """

    def run(rows: list[dict]) -> Iterator[tuple]:
        for d in fold_duplications(rows, p.min_sv_len):
            yield rows[0]["read_id"], d["here"][0], d["start"], d["end"], d["copies"], d["quality"]

    held = segs if "quality" in segs.columns else segs.withColumn("quality", quality())
    return map_rows(held, ["read_id"], ["idx"], run, "read_id long, contig string, begin_pos long, end_pos long, copies long, quality double")


def _goes_on(former: dict, latter: dict) -> bool:
    return abs(former["pos"] - latter["pos"]) <= FAR and latter["pos"] + 1000 >= former["ref_end"] and latter["pos"] > former["pos"]


def scan_inversions(rows: list[dict]) -> Iterator[tuple[dict, bool, bool, float]]:
    """(segment, left end seen, right end seen, quality) of one read's strand flips."""
    i = 0
    while i < len(rows) - 1:
        a, b = rows[i], rows[i + 1]
        former, latter = (a, b) if a["strand"] == 1 else (b, a)
        if a["strand"] != b["strand"] and a["contig"] == b["contig"] and _goes_on(former, latter):
            back = (c for c in rows[i + 2 :] if c["contig"] == a["contig"] and c["strand"] != b["strand"])
            third = next((c for c in back if (_goes_on(b, c) if a["strand"] == 1 else _goes_on(c, b))), None)
            if third:
                yield b, True, True, (a["quality"] + b["quality"] + third["quality"]) / 3
                i += 1
            else:
                both = 0.5 * (former["quality"] + latter["quality"])
                yield former, False, True, both
                yield latter, True, False, both
        i += 1


def split_inversions(segs: DataFrame) -> DataFrame:
    """(read_id, contig, begin_pos, end_pos, inv_left, inv_right, quality): a stretch is read on the other strand."""

    def run(rows: list[dict]) -> Iterator[tuple]:
        for s, left, right, sure in scan_inversions(rows):
            yield s["read_id"], s["contig"], s["pos"], s["ref_end"], left, right, sure

    held = segs if "quality" in segs.columns else segs.withColumn("quality", quality())
    return map_rows(held, ["read_id"], ["idx"], run, "read_id long, contig string, begin_pos long, end_pos long, inv_left boolean, inv_right boolean, quality double")
