"""Indexes of alignment files: both formats, which parts of a file a region may be in, and writing one.

Both formats put records into bins: a bin at level 0 is a whole contig, and each level's bins are an eighth as wide as those above.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from varloom.sources.bgzf import Stream

# The widths of the older format, and its bin that holds counts.
SHIFT, DEPTH = 14, 5
MOST = 1 << SHIFT + 3 * DEPTH
#: A place behind all others.
END = (1 << 63) - 1


def first_bin(level: int) -> int:
    """The number of a level's first bin."""
    return ((1 << 3 * level) - 1) // 7


def bin_of(begin: int, end: int, shift: int = SHIFT, depth: int = DEPTH) -> int:
    """The narrowest bin that holds [begin, end)."""
    last, s = end - 1, shift
    for level in range(depth, 0, -1):
        if begin >> s == last >> s:
            return first_bin(level) + (begin >> s)
        s += 3
    return 0


def bins_over(begin: int, end: int, shift: int, depth: int) -> list[tuple[int, int]]:
    """(first, last) number of each level's bins that touch [begin, end)."""
    found = []
    for level in range(depth + 1):
        s = shift + 3 * (depth - level)
        found.append((first_bin(level) + (begin >> s), first_bin(level) + ((end - 1) >> s)))
    return found


@dataclass
class Contig:
    """One contig's chunks by bin, and from which place on records of each window (or bin) lie."""

    bins: dict[int, np.ndarray]
    windows: np.ndarray
    least: dict[int, int]


@dataclass
class Index:
    shift: int
    depth: int
    contigs: list[Contig]

    def places(self) -> np.ndarray:
        """Places at which records begin."""
        found = [c[:, 0] for contig in self.contigs for c in contig.bins.values()] + [contig.windows for contig in self.contigs]
        places = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return places[places > 0]

    def _from(self, contig: Contig, begin: int) -> int:
        """A place before which no record of the contig reaches ``begin``."""
        if len(contig.windows):
            return int(contig.windows[min(begin >> SHIFT, len(contig.windows) - 1)])
        level = self.depth
        number = first_bin(level) + (begin >> self.shift)
        while number and number not in contig.least:
            number = (number - 1) >> 3
        return contig.least.get(number, 0)

    def chunks(self, contig: int, begin: int, end: int) -> list[tuple[int, int]]:
        """Parts (from, until) of the file that hold all records over [begin, end) of a contig; they don't overlap."""
        whole = 1 << (self.shift + 3 * self.depth)
        begin, end = max(begin, 0), min(end, whole)
        if not 0 <= contig < len(self.contigs) or begin >= end:
            return []
        held = self.contigs[contig]
        ranges = bins_over(begin, end, self.shift, self.depth)
        some = [c for number, c in held.bins.items() if any(lo <= number <= hi for lo, hi in ranges)]
        if not some:
            return []
        least = self._from(held, begin)
        both = np.concatenate(some)
        out: list[tuple[int, int]] = []
        for lo, hi in both[np.argsort(both[:, 0])].tolist():
            lo = max(lo, least)
            if lo >= hi:
                continue
            # parts that end and begin in one block are read as one
            if out and lo >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(out[-1][1], hi))
            else:
                out.append((lo, hi))
        return out


def parse(data: bytes) -> Index:
    """An index of either format."""
    if data[:4] == b"BAI\1":
        return _parse(data, 4, SHIFT, DEPTH, False)
    if data[:2] == b"\x1f\x8b":
        import io

        stream, parts = Stream(io.BytesIO(data), 0), []
        while stream.have(1):
            parts.append(stream.take(len(stream.data) - stream.at))
        data = b"".join(parts)
    if data[:4] != b"CSI\1":
        raise ValueError("not an index of alignments")
    shift, depth, aux = struct.unpack_from("<iii", data, 4)
    return _parse(data, 16 + aux, shift, depth, True)


def _parse(data: bytes, at: int, shift: int, depth: int, wide: bool) -> Index:
    # the bin behind the last level's holds counts
    counts = first_bin(depth + 1) + 1
    n, at = struct.unpack_from("<i", data, at)[0], at + 4
    contigs = []
    for _ in range(n):
        bins, least = {}, {}
        size, at = struct.unpack_from("<i", data, at)[0], at + 4
        for _ in range(size):
            if wide:
                number, first, chunks = struct.unpack_from("<IQi", data, at)
                at += 16
            else:
                number, chunks = struct.unpack_from("<Ii", data, at)
                first, at = 0, at + 8
            if number != counts:
                bins[number] = np.frombuffer(data, "<u8", 2 * chunks, at).reshape(-1, 2).astype(np.int64)
                least[number] = first
            at += 16 * chunks
        windows = np.zeros(0, np.int64)
        if not wide:
            count, at = struct.unpack_from("<i", data, at)[0], at + 4
            windows = np.frombuffer(data, "<u8", count, at).astype(np.int64)
            at += 8 * count
        contigs.append(Contig(bins, windows, least if wide else {}))
    return Index(shift, depth, contigs)


def packed(contigs: int, chunks: list[tuple[int, int, int, int]], windows: list[tuple[int, int, int]]) -> bytes:
    """An index of the older format: of (contig, bin, from, until), ordered, and of the first place (contig, window, place)."""
    by: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(contigs)]
    for contig, number, lo, hi in chunks:
        held = by[contig].setdefault(number, [])
        if held and held[-1][1] >> 16 >= lo >> 16:
            held[-1] = (held[-1][0], max(hi, held[-1][1]))
        else:
            held.append((lo, hi))
    first: list[dict[int, int]] = [{} for _ in range(contigs)]
    for contig, window, place in windows:
        first[contig][window] = min(place, first[contig].get(window, END))
    out = [b"BAI\1", struct.pack("<i", contigs)]
    for held, least in zip(by, first, strict=True):
        out.append(struct.pack("<i", len(held)))
        for number in sorted(held):
            out.append(struct.pack("<Ii", number, len(held[number])) + b"".join(struct.pack("<QQ", *c) for c in held[number]))
        size, known = max(least, default=-1) + 1, 0
        filled = []
        for w in range(size):
            known = least.get(w, known)
            filled.append(known)
        out.append(struct.pack(f"<i{size}Q", size, *filled))
    return b"".join(out)
