"""Insert sizes sampled in a file's order until they settle.

Pairs are taken in buffers.  A buffer with many long pairs is dropped and a part of its contig passed over; after a number of
pairs the sampling goes on at the next contig, and stops when two looks in a row agree.  Where a buffer begins depends on
all that was dropped before it, so the state (sizes taken, the open buffer, a place per contig) goes from window to window.
Inside a window Spark numbers the pairs, deals them out to buffers and counts their sizes; only these counts, of a bounded number
of buffers and of sizes with few digits, come back.  Windows after the last look are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import reads as R
from varloom.operators.intervals import STRETCH, numbered
from varloom.operators.library import BINS, library_reads, oriented
from varloom.operators.records import prepared, scan
from varloom.sources.bam import read_bam

#: (contig, start, end) -> pairs with pos and isize whose pos lies between, the end exclusive.
Window = Callable[[str, int, int], DataFrame]


@dataclass(frozen=True)
class Rule:
    """Pairs of a buffer, pairs between two looks, pairs after which sampling stops anyway, the size from which a pair is long,
    the share of long pairs from which a buffer is dropped, and the part of a contig (one in so many) that is passed over."""

    buffer: int = 1_000
    look: int = 100_000
    most: int = 5_000_000
    long: int = 5_000
    share: float = 0.01
    parts: int = 100

    def __post_init__(self):
        if self.look % self.buffer:
            raise ValueError("a look must come after whole buffers")

    def sound(self, sizes: Counter) -> bool:
        n = sizes.total()
        return n > 0 and sum(k for size, k in sizes.items() if size >= self.long) / n < self.share


@dataclass
class Sampled:
    """Sizes taken so far with their numbers, the open buffer's, those of the last look, and whether the last two looks agreed."""

    sizes: Counter = field(default_factory=Counter)
    buffer: Counter = field(default_factory=Counter)
    last: Counter | None = None
    settled: bool = False

    @property
    def pairs(self) -> int:
        return self.sizes.total()

    def look(self) -> None:
        self.settled = self.last is not None and agree(self.last, self.sizes)
        self.last = self.sizes.copy()

    def frame(self, spark: SparkSession) -> DataFrame:
        """(size, n), for :func:`varloom.operators.library.moments`."""
        return spark.createDataFrame(sorted(self.sizes.items()), "size long, n long")


def agree(a: Counter, b: Counter) -> bool:
    """Whether ten quantiles of two samples lie within a base, and the shares up to them within a thousandth."""
    (size_a, upto_a), (size_b, upto_b) = _shares(a), _shares(b)
    for at in range(BINS // 20 - 1, BINS, BINS // 10):
        one, other = (s[np.searchsorted(np.rint(u * BINS), at, side="right")] for s, u in ((size_a, upto_a), (size_b, upto_b)))
        below = [u[k - 1] if (k := np.searchsorted(s, other, side="right")) else 0.0 for s, u in ((size_a, upto_a), (size_b, upto_b))]
        if abs(int(one) - int(other)) >= 1 or abs(below[0] - below[1]) >= 0.001:
            return False
    return True


def _shares(sizes: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Sizes in order, and the share of pairs up to each."""
    size = np.array(sorted(sizes))
    n = np.cumsum([sizes[s] for s in size.tolist()])
    return size, n / n[-1]


def _read(pairs: DataFrame, order: list[Column], state: Sampled, buffers: int, rule: Rule) -> tuple[list[tuple[Counter, int]], bool]:
    """The next ``buffers`` buffers at most, of which the first begins with the open one: [(sizes, last place)], and whether they
    are all full."""
    rows = pairs.select("pos", R.simple_size(F.col("isize")).alias("size"), *(c.alias(f"_o{i}") for i, c in enumerate(order)))
    rows = numbered(rows, [], "pos", [F.col("pos"), *(F.col(f"_o{i}") for i in range(len(order)))], "_i")
    of = F.floor((F.col("_i") + state.buffer.total()) / rule.buffer)
    counts = rows.withColumn("buffer", of).filter(F.col("buffer") < buffers).groupBy("buffer", "size").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))
    found = {0: state.buffer.copy()}
    last: dict[int, int] = {}
    # at most look / buffer buffers with as many sizes as pairs, so fewer than ``rule.look`` rows
    for r in counts.collect():
        found.setdefault(r["buffer"], Counter())[r["size"]] += r["n"]
        last[r["buffer"]] = max(last.get(r["buffer"], -1), r["last"])
    out = [(found[k], last.get(k, -1)) for k in sorted(found)]
    return out, len(out) == buffers and out[-1][0].total() == rule.buffer


def sample(window: Window, contigs: Iterable[tuple[str, int]], order: list[Column] | None = None, rule: Rule = Rule(), width: int = STRETCH) -> Sampled:
    """Sizes of the pairs that ``window`` gives, by ``rule``.  ``contigs`` are names and sizes, in the file's order.

    Pairs come by pos, those at one place by ``order``.  A window is ``width`` bases wide at first, and twice as wide after each
    that holds too few pairs.  No pairs give no sizes.
    """
    state, contigs = Sampled(), list(contigs)
    place = {name: 0 for name, _ in contigs}
    done = False
    while not done and any(place[name] < size for name, size in contigs):
        for name, size in contigs:
            jump, start, region, ended = max(1, size // rule.parts), place[name], place[name], False
            while start < size and not ended:
                end = min(start + width, size)
                buffers, full = _read(window(name, start, end), order or [], state, (rule.look - state.pairs % rule.look) // rule.buffer, rule)
                start = end
                state.buffer = Counter()
                for sizes, at in buffers:
                    if sizes.total() < rule.buffer:
                        state.buffer = sizes
                    elif rule.sound(sizes):
                        state.sizes += sizes
                    else:
                        start = region = at + jump + 1
                        break
                else:
                    if full:
                        state.look()
                        ended, done = True, state.settled or state.pairs > rule.most
                        # a region of one place is passed over like a dropped one
                        start = at + 1 + (jump if at <= region else 0)
                    else:
                        width *= 2
            place[name] = start
            if done:
                break
    if rule.sound(state.buffer):
        state.sizes += state.buffer
    state.buffer = Counter()
    return state


def facing(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (pos, reverse, mate_pos, mate_reverse) those whose reads face each other."""
    return oriented(pairs).filter("orient = 'Rp'")


def of_table(pairs: DataFrame) -> Window:
    """Windows of a table of pairs (contig, pos, isize); the places reach its scan as filters."""
    return lambda contig, start, end: pairs.filter((F.col("contig") == contig) & (F.col("pos") >= start) & (F.col("pos") < end))


def of_file(spark: SparkSession, path: str, apart: int = STRETCH) -> Window:
    """Windows of an indexed alignment file, of which only the parts that hold them are read.

    A pair counts by its downstream read; its upstream read is looked for up to ``apart`` bases before the window, so pairs
    further apart don't count.
    """

    def window(contig: str, start: int, end: int) -> DataFrame:
        records = prepared(scan([read_bam(spark, path, regions=[(contig, max(start - apart, 0), end)])]))
        f = F.col("flag")
        pairs = library_reads(records).withColumns({"reverse": R.has(f, R.REVERSE).cast("int"), "mate_reverse": R.has(f, R.MATE_REVERSE).cast("int")})
        return facing(pairs).filter((F.col("pos") >= start) & (F.col("pos") < end))

    return window
