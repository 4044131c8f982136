"""Calls against a truth set: one-to-one matches inside confident regions, and precision and recall by type."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.grouping import map_groups, numbers
from varloom.operators.intervals import containing, islands
from varloom.operators.truth import ALIKE, REACH

_OUT = "contig string, sv_type long, truth_id long, call_id long, apart long"


def inside(rows: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """``rows`` (unique by ``key``, with contig, sv_type, pos, sv_len) that lie wholly in one of ``regions`` (contig, begin_pos, end_pos).

    An insertion lies where it begins.
    """
    end = F.col("pos") + F.when(F.col("sv_type") == 1, 0).otherwise(F.col("sv_len"))
    met = containing(rows.select(key, "contig", "pos", end.alias("_end")), regions, "pos", "_end").select(key)
    return rows.join(met, key, "left_semi")


def _pairs(pos: np.ndarray, length: np.ndarray, group: np.ndarray, truth: np.ndarray, reach: int, alike: float) -> tuple[np.ndarray, np.ndarray]:
    """(truths, calls) that may match: near each other and about as long.  Rows come by group and pos."""
    wide = int(pos.max(initial=0) - pos.min(initial=0)) + 2 * reach + 2
    place = group * wide + (pos - pos.min(initial=0))
    t, c = np.flatnonzero(truth), np.flatnonzero(~truth)
    lo, hi = np.searchsorted(place[c], place[t] - reach, side="left"), np.searchsorted(place[c], place[t] + reach, side="right")
    i = np.repeat(t, hi - lo)
    j = c[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)] if len(i) else np.zeros(0, np.int64)
    good = np.minimum(length[i], length[j]) >= alike * np.maximum(length[i], length[j])
    return i[good], j[good]


def assigned(truth: DataFrame, calls: DataFrame, reach: int = REACH, alike: float = ALIKE) -> DataFrame:
    """(contig, sv_type, truth_id, call_id, apart): every truth and every call once, matched ones in one row.

    ``truth`` has truth_id and ``calls`` call_id (unique in a contig and type), both contig, sv_type, pos and sv_len.  Of all pairs that are near and alike
    the nearest is matched first (then the one of nearest lengths, then the smaller ids), and neither of its sides again.
    Pairs never leave an island of places, so each island is worked on by itself.
    """
    cols = ["contig", F.col("sv_type").cast("long").alias("sv_type"), F.col("pos").cast("long").alias("pos"), F.col("sv_len").cast("long").alias("sv_len")]
    rows = truth.select(*cols, F.col("truth_id").alias("id"), F.lit(True).alias("truth")).unionByName(calls.select(*cols, F.col("call_id").alias("id"), F.lit(False).alias("truth")))
    keys = ["contig", "sv_type"]
    grouped = islands(rows, keys, "pos", [F.col("pos"), F.col("truth"), F.col("id")], F.col("pos") + reach, "island")

    def run(table: pa.Table, group: np.ndarray) -> pa.Table:
        pos, length, ids, is_truth = numbers(table, "pos"), numbers(table, "sv_len"), numbers(table, "id"), table["truth"].to_numpy()
        i, j = _pairs(pos, length, group, is_truth, reach, alike)
        order = np.lexsort((ids[j], ids[i], np.abs(length[i] - length[j]), np.abs(pos[i] - pos[j])))
        with_ = np.full(len(ids), -1, np.int64)
        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            if with_[a] < 0 and with_[b] < 0:
                with_[a], with_[b] = b, a
        rows = np.flatnonzero(is_truth | (with_ < 0))
        matched, own = with_[rows] >= 0, is_truth[rows]
        other = np.where(matched, with_[rows], rows)
        return pa.table({
            "contig": table["contig"].take(pa.array(rows)), "sv_type": table["sv_type"].take(pa.array(rows)),
            "truth_id": pa.array(ids[rows], pa.int64(), mask=~own), "call_id": pa.array(ids[other], pa.int64(), mask=own & ~matched),
            "apart": pa.array(np.abs(pos[rows] - pos[other]), pa.int64(), mask=~matched),
        })

    return map_groups(grouped, [*keys, "island"], ["pos", "truth", "id"], run, _OUT)


def scores(found: DataFrame) -> DataFrame:
    """(sv_type, tp, fp, fn, precision, recall, f1) of :func:`assigned` rows; a share of nothing is null."""
    both, t, c = F.col("truth_id").isNotNull() & F.col("call_id").isNotNull(), F.col("truth_id").isNotNull(), F.col("call_id").isNotNull()
    n = found.groupBy("sv_type").agg(F.count_if(both).alias("tp"), F.count_if(c & ~t).alias("fp"), F.count_if(t & ~c).alias("fn"))
    share = lambda x, of: F.when(of > 0, x / of)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})
