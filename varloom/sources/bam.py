"""Binary alignment files (BAM) as records, in the columns of :func:`formats.read_sam`: whole, by region, with or without an index.

A whole file is cut into stretches of bytes.  A stretch's task looks for the first block in it, and in the blocks' content for the
first place at which a chain of sound records begins; it owns the records that begin in its blocks, wherever they end.  So no
index is needed, and a file is split whatever its size.  A region is read by an index's parts alone.  Missing indexes are
built as a distributed table: each stretch sums up its records by bin, and a task per file writes the sums.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession

from varloom.sources import bam_index
from varloom.sources.bam_index import END, Index
from varloom.sources.bgzf import Stream, find_block

#: Compressed bytes of a stretch, and records of a batch.
STRETCH, ROWS = 32 << 20, 5_000
#: Records in a row that have to be sound for the first one to be taken for a record, and bytes that one may have.
CHAIN, LONGEST_RECORD = 4, 1 << 28

# The letters of operations and bases, the sizes and formats of tags' numbers, and which operations take reference.
OPERATIONS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
ON_REFERENCE = {0, 2, 3, 7, 8}

RECORD = "qname string, flag bigint, contig string, pos bigint, mapq bigint, cigar string, mate_contig string, mate_pos bigint, isize bigint, seq string, qual string, tags map<string,string>"
_NAMES = [f.split()[0] for f in RECORD.split(", ")]
_ARROW = pa.schema(list(zip(_NAMES, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())], strict=True)))
_PAIRS = [BASES[b >> 4] + BASES[b & 15] for b in range(256)]
_HEAD = struct.Struct("<iiBBHHHiiii")


def header(stream: Stream) -> tuple[str, list[str]]:
    """(the header's text, the contigs' names)."""
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = stream.take(struct.unpack("<i", stream.take(4))[0]).rstrip(b"\0").decode()
    names = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        names.append(stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode())
        stream.take(4)
    return text, names


def _tags(data: bytes) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            of, n = NUMBERS[chr(data[at])], struct.unpack_from("<i", data, at + 1)[0]
            value = ",".join([chr(data[at]), *map(str, struct.unpack_from(f"<{n}{of}", data, at + 5))])
            at += 5 + n * struct.calcsize(of)
        else:
            of = NUMBERS[kind]
            value, at = str(struct.unpack_from(f"<{of}", data, at)[0]), at + struct.calcsize(of)
        out.append((name, value))
    return out


def _operations(codes: tuple[int, ...], size: int, tags: bytes) -> tuple[tuple[int, ...], bool]:
    """(a record's operations, whether they stood in its CG tag).

    A record has room for 65,535 operations.  One with more clips its whole read, skips the reference, and holds them in CG.
    """
    if len(codes) == 2 and codes[0] & 15 == 4 and codes[0] >> 4 == size and codes[1] & 15 == 3:
        at = tags.find(b"CGBI")
        while at >= 0:
            n = struct.unpack_from("<I", tags, at + 4)[0]
            if at + 8 + 4 * n <= len(tags):
                found = struct.unpack_from(f"<{n}I", tags, at + 8)
                # the letters may stand in another tag's value: what is found has to be as long as the read
                if all(c & 15 <= 8 for c in found) and sum(c >> 4 for c in found if c & 15 in (0, 1, 4, 7, 8)) == size:
                    return found, True
            at = tags.find(b"CGBI", at + 1)
    return codes, False


def _record(data: bytes, names: list[str]) -> tuple:
    ref, pos, name_size, mapq, _, operations, flag, size, mate, mate_pos, isize = _HEAD.unpack_from(data)
    at = 32 + name_size
    codes = struct.unpack_from(f"<{operations}I", data, at)
    at += 4 * operations
    seq = "".join(map(_PAIRS.__getitem__, data[at : at + (size + 1) // 2]))[:size]
    at += (size + 1) // 2
    raw = data[at : at + size]
    qual = "*" if not size or raw[0] == 255 else bytes(q + 33 for q in raw).decode()
    contig = names[ref] if ref >= 0 else "*"
    other = "*" if mate < 0 else "=" if mate == ref else names[mate]
    codes, moved = _operations(codes, size, data[at + size :])
    tags = _tags(data[at + size :])
    cigar = "".join(f"{c >> 4}{OPERATIONS[c & 15]}" for c in codes) or "*"
    return data[32 : 31 + name_size].decode(), flag, contig, pos, mapq, cigar, other, mate_pos, isize, seq or "*", qual, [t for t in tags if not (moved and t[0] == "CG")]


def _extent(data: bytes) -> tuple[int, int, int]:
    """(contig's number, begin, end) of a record; one without reference bases takes one."""
    ref, pos, name_size, _, _, operations, _, size, _, _, _ = _HEAD.unpack_from(data)
    codes = struct.unpack_from(f"<{operations}I", data, 32 + name_size)
    codes, _ = _operations(codes, size, data[32 + name_size + 4 * operations + (size + 1) // 2 + size :])
    return ref, pos, pos + max(1, sum(c >> 4 for c in codes if c & 15 in ON_REFERENCE))


def _sound(stream: Stream, k: int, contigs: int) -> int | None:
    """The bytes of what may be a record ``k`` bytes ahead in the stream, its length field included; None if it can't be one."""
    if not stream.have(k + 36):
        return None
    at = stream.at + k
    size = struct.unpack_from("<i", stream.data, at)[0]
    if not 33 <= size <= LONGEST_RECORD:
        return None
    ref, pos, name_size, _, _, operations, _, letters, mate, mate_pos, _ = _HEAD.unpack_from(stream.data, at + 4)
    if not (-1 <= ref < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1 and name_size and letters >= 0):
        return None
    if 32 + name_size + 4 * operations + (letters + 1) // 2 + letters > size:
        return None
    if not stream.have(k + 36 + name_size + 4 * operations):
        return None
    at = stream.at + k
    name = stream.data[at + 36 : at + 36 + name_size]
    if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return None
    codes = struct.unpack_from(f"<{operations}I", stream.data, at + 36 + name_size)
    return size + 4 if all(c & 15 <= 8 for c in codes) else None


def _chain(file, place: int, contigs: int) -> bool:
    """Whether CHAIN sound records, or fewer up to the file's end, stand from ``place`` on."""
    stream = Stream(file, place)
    for _ in range(CHAIN):
        if not stream.have(1):
            return stream.ends
        size = _sound(stream, 0, contigs)
        if size is None or not stream.have(size):
            return False
        stream.at += size
    return True


def first_record(file, begin: int, end: int, contigs: int) -> int | None:
    """The place of the first record that begins in a block of [begin, end); None without one."""
    block = find_block(file, begin, end)
    while block is not None and block < end:
        stream = Stream(file, block << 16)
        if not stream.blocks:
            return None
        following = stream.next
        for at in range(len(stream.data)):
            # heads may reach into further blocks, which the stream then takes in behind
            if _sound(stream, at, contigs) is not None and _chain(file, block << 16 | at, contigs):
                return block << 16 | at
        block = following
    return None


def _fs(path: str):
    return FileSystem.from_uri(path)


def opened(path: str):
    fs, at = _fs(path)
    return fs.open_input_file(at)


def load_index(path: str) -> Index | None:
    """The index beside a file: x.bam.bai, x.bai, x.bam.csi or x.csi."""
    fs, at = _fs(path)
    stem = at.removesuffix(".bam")
    for name in (f"{at}.bai", f"{stem}.bai", f"{at}.csi", f"{stem}.csi"):
        if fs.get_file_info(name).type == FileType.File:
            with fs.open_input_file(name) as file:
                return bam_index.parse(file.read())
    return None


def records_between(file, begin: int, end: int) -> Iterator[bytes]:
    """The records (without their length) that begin at places from ``begin`` to ``end``."""
    stream = Stream(file, begin)
    while stream.have(4) and stream.place() < end:
        yield stream.take(struct.unpack("<i", stream.take(4))[0])


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def read_part(path: str, begin: int, end: int, names: list[str], region: tuple[int, int, int] | None) -> Iterator[pa.RecordBatch]:
    """Batches of the records between two places; with a ``region`` (contig's number, begin, end) those over it."""
    rows: list[tuple] = []
    with opened(path) as file:
        for data in records_between(file, begin, end):
            if region is not None:
                ref, lo, hi = _extent(data)
                if ref != region[0] or lo >= region[2]:
                    # records are ordered: nothing behind lies over the region
                    if ref < 0 or ref > region[0] or (ref == region[0] and lo >= region[2]):
                        break
                    continue
                if hi <= region[1]:
                    continue
            rows.append(_record(data, names))
            if len(rows) >= ROWS:
                yield batch_of(rows)
                rows = []
    if rows:
        yield batch_of(rows)


def cut_parts(index: Index, region: tuple[int, int, int], stretch: int) -> list[tuple[int, int]]:
    """The parts of a file that hold a region, the long ones cut at places where records begin."""
    places, out = index.places(), []
    for lo, hi in index.chunks(*region):
        for place in places[np.searchsorted(places, lo, side="right") : np.searchsorted(places, hi)].tolist():
            if (place >> 16) - (lo >> 16) >= stretch:
                out.append((lo, place))
                lo = place
        out.append((lo, hi))
    return out


_PARTS = "path string, begin long, end long, names array<string>, ref int, lo long, hi long"


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bam").load(path).select("path", "length")


def _stretches(spark: SparkSession, path: str | list[str], stretch: int) -> DataFrame:
    """(path, begin, end, names): byte ranges of the files, with their contigs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                with opened(name) as file:
                    _, names = header(Stream(file, 0))
                begins = list(range(0, size, stretch))
                n = len(begins)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(begins), pa.array([min(b + stretch, size) for b in begins]), pa.array([names] * n, pa.list_(pa.string()))], names=["path", "begin", "end", "names"])

    return _files(spark, path).mapInArrow(cut, "path string, begin long, end long, names array<string>")


def _owned(file, begin: int, end: int, contigs: int) -> tuple[int, int]:
    """Places between which the records of the stretch [begin, end) of bytes begin."""
    if begin == 0:
        stream = Stream(file, 0)
        header(stream)
        first = stream.place() if stream.have(1) else None
        if first is not None and first >> 16 >= end:
            first = None
    else:
        first = first_record(file, begin, end, contigs)
    return (END, END) if first is None else (first, end << 16)


def read_bam(spark: SparkSession, path: str, stretch: int = STRETCH, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Alignment records below ``path``; positions from 0, tags as a map from name to value.

    With ``regions`` (contig, begin, end) only the records over them, each once for every region that it lies over; files then
    need an index (:func:`ensure_indexes` builds it), and only its parts are read.  Contigs that a file doesn't have give no rows.
    """
    if regions is None:
        parts = _stretches(spark, path, stretch)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    with opened(row["path"]) as file:
                        begin, end = _owned(file, row["begin"], row["end"], len(row["names"]))
                    if begin < END:
                        yield from read_part(row["path"], begin, end, row["names"], None)

        return parts.repartition(max(1, parts.count())).mapInArrow(whole, RECORD)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as file:
                    _, names = header(Stream(file, 0))
                index = load_index(name)
                if index is None:
                    raise FileNotFoundError(f"{name} has no index; ensure_indexes builds one")
                rows = [(name, b, e, names, names.index(contig), lo, hi) for contig, lo, hi in regions if contig in names for b, e in cut_parts(index, (names.index(contig), lo, hi), stretch)]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _PARTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from read_part(row["path"], row["begin"], row["end"], row["names"], (row["ref"], row["lo"], row["hi"]))

    # a task for each part
    parts = _files(spark, path).mapInArrow(cut, _PARTS)
    return parts.repartition(max(1, parts.count())).mapInArrow(run, RECORD)


def index_rows(spark: SparkSession, path: str | list[str], stretch: int = STRETCH) -> DataFrame:
    """What an index holds, of files ordered by contig and position: (path, contigs, ref, bin, window, begin, until).

    Rows with a bin are chunks, summed up inside a stretch; rows with a window tell where the first record over it begins.
    """
    parts = _stretches(spark, path, stretch)
    schema = "path string, contigs int, ref int, bin int, window int, begin long, until long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunks: list[list[int]] = []
                windows: dict[tuple[int, int], int] = {}
                with opened(row["path"]) as file:
                    begin, end = _owned(file, row["begin"], row["end"], len(row["names"]))
                    stream = Stream(file, begin) if begin < END else None
                    while stream and stream.have(4) and stream.place() < end:
                        place = stream.place()
                        ref, lo, hi = _extent(stream.take(struct.unpack("<i", stream.take(4))[0]))
                        if hi > bam_index.MOST:
                            raise ValueError("this format of an index ends at 512 Mb")
                        until = stream.place() if stream.have(1) else stream.next << 16
                        if ref < 0 or lo < 0:
                            continue
                        number = bam_index.bin_of(lo, hi)
                        if chunks and chunks[-1][:2] == [ref, number]:
                            chunks[-1][3] = until
                        else:
                            chunks.append([ref, number, place, until])
                        for w in range(lo >> bam_index.SHIFT, (hi - 1 >> bam_index.SHIFT) + 1):
                            windows.setdefault((ref, w), place)
                n, none = len(chunks) + len(windows), None
                rows = [(ref, number, none, lo, hi) for ref, number, lo, hi in chunks] + [(ref, none, w, place, none) for (ref, w), place in windows.items()]
                if rows:
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*[pa.int32()] * 3, pa.int64(), pa.int64()], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * n), pa.array([len(row["names"])] * n, pa.int32()), *cols], names=[f.split()[0] for f in schema.split(", ")])

    return parts.repartition(max(1, parts.count())).mapInArrow(run, schema)


def ensure_indexes(spark: SparkSession, path: str, stretch: int = STRETCH) -> DataFrame:
    """Write x.bam.bai beside each file below ``path`` that has no index; (path, bytes) of those written.

    Chunks are summed up where the records are; an index, some MB whatever the file's size, is put together by one task.  It
    is written under another name and then renamed, so a task that runs again does no harm.
    """

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [n for n in batch.column(0).to_pylist() if load_index(n) is None]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["path"])

    def write(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        chunks = [(r["ref"], r["bin"], r["begin"], r["until"]) for r in rows if r["bin"] is not None]
        data = bam_index.packed(rows[0]["contigs"], sorted(chunks, key=lambda c: (c[0], c[2])), [(r["ref"], r["window"], r["begin"]) for r in rows if r["window"] is not None])
        fs, at = _fs(key[0].as_py())
        with fs.open_output_stream(f"{at}.bai.tmp") as file:
            file.write(data)
        fs.move(f"{at}.bai.tmp", f"{at}.bai")
        return pa.table({"path": pa.array([key[0].as_py()]), "bytes": pa.array([len(data)], pa.int64())})

    wanted = [r["path"] for r in _files(spark, path).select("path").mapInArrow(missing, "path string").collect()]  # names of files
    if not wanted:
        return spark.createDataFrame([], "path string, bytes long")
    done = index_rows(spark, wanted, stretch).groupBy("path").applyInArrow(write, "path string, bytes long").collect()
    return spark.createDataFrame(done, "path string, bytes long")


def bam_header(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the lines of the files' headers, as in their text form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as file:
                    lines = header(Stream(file, 0))[0].splitlines()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(lines, pa.string())], names=["path", "value"])

    return _files(spark, path).select("path").mapInArrow(run, "path string, value string")
