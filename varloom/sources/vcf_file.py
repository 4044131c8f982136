"""Calls as one compressed, indexed file: x.vcf.gz and x.vcf.gz.tbi.

Lines are ordered by ranges; each task compresses its own into blocks and tells what its part holds for the index, in places inside
the part.  Parts' sizes then say where each part begins in the file, so places need no second look at the lines.  One
task copies the parts behind each other, a piece at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder
from varloom.sources import bam_index
from varloom.sources.bgzf import CONTENT, TAIL, Stream, deflate

#: Bytes copied at once.
PIECE = 1 << 22
# Fixed values of the index's head: a format of calls, columns of contig and position, the comments' letter, no lines to skip.
_HEAD = (2, 1, 2, 0, ord("#"), 0)
_ROW = "part int, file string, size long, contig_id long, contig string, bin int, window int, lo long, hi long"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_KINDS = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


class _Blocks:
    """A file of blocks that is being written; places are those of the next byte."""

    def __init__(self, out):
        self.out, self.data, self.size = out, bytearray(), 0

    def place(self) -> int:
        return self.size << 16 | len(self.data)

    def write(self, data: bytes) -> None:
        self.data += data
        while len(self.data) >= CONTENT:
            self._cut(CONTENT)

    def _cut(self, n: int) -> None:
        block = deflate(bytes(self.data[:n]))
        self.out.write(block)
        self.size += len(block)
        del self.data[:n]

    def close(self) -> None:
        if self.data:
            self._cut(len(self.data))


def write_vcf(head: DataFrame, calls: DataFrame, path: str) -> DataFrame:
    """Write ``head`` (n, line) and ``calls`` (contig_id, contig, vcf_pos from 1, vcf_end, id, line) to ``path``; (path, bytes, index_bytes).

    Calls come by contig_id, vcf_pos and id.  A call lies over [vcf_pos - 1, vcf_end), one base at least.
    """
    spark = calls.sparkSession
    folder, path = shared_folder(spark), _uri(path)
    top = "".join(f"{r['line']}\n" for r in head.orderBy("n").select("line").collect())  # a line per contig
    keys = ["contig_id", "vcf_pos", "id"]
    rows = calls.select(F.col("contig_id").cast("long"), "contig", F.col("vcf_pos").cast("long"), F.col("vcf_end").cast("long"), "id", "line").repartitionByRange(*keys).sortWithinPartitions(*keys)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(f"{base}/parts", recursive=True)
        # a task that runs again writes another file, and only the one that its rows name counts
        name = f"{base}/parts/{task.partitionId():06d}-{task.taskAttemptId()}"
        found: list[list] = []
        windows: set[tuple[int, int]] = set()
        with fs.open_output_stream(name) as out:
            blocks = _Blocks(out)
            for batch in batches:
                for contig_id, contig, pos, end, _, line in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                    lo, begin = blocks.place(), pos - 1
                    blocks.write(line.encode() + b"\n")
                    end = max(end, pos)
                    number = bam_index.bin_of(begin, end)
                    if found and found[-1][3:6] == [contig_id, contig, number]:
                        found[-1][8] = blocks.place()
                    else:
                        found.append([task.partitionId(), name, 0, contig_id, contig, number, None, lo, blocks.place()])
                    for w in range(begin >> bam_index.SHIFT, (end - 1 >> bam_index.SHIFT) + 1):
                        if (contig_id, w) not in windows:
                            windows.add((contig_id, w))
                            found.append([task.partitionId(), name, 0, contig_id, contig, None, w, lo, None])
            blocks.close()
        for row in found:
            row[2] = blocks.size
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), _KINDS, strict=True)], names=_NAMES)

    made = materialize(rows.mapInArrow(compress, _ROW), folder, "parts-index")
    # a row for each part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = made.select("part", "size").distinct().withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = made.join(F.broadcast(offsets.select("part", "offset")), "part").select("offset", *_NAMES)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist() if r["file"]), key=lambda r: (r["part"], r["lo"]))
        fs, at = FileSystem.from_uri(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(f"{at}.tmp") as out:
            blocks = _Blocks(out)
            blocks.write(top.encode())
            blocks.close()
            start = blocks.size
            for name in dict.fromkeys(r["file"] for r in rows):
                with FileSystem.from_uri(folder)[0].open_input_stream(name) as part:
                    while piece := part.read(PIECE):
                        out.write(piece)
            out.write(TAIL)
        names = list(dict.fromkeys(r["contig"] for r in rows))
        number = {n: k for k, n in enumerate(names)}
        whole = lambda r, c: ((r[c] >> 16) + start + r["offset"]) << 16 | (r[c] & 0xFFFF)
        chunks = [(number[r["contig"]], r["bin"], whole(r, "lo"), whole(r, "hi")) for r in rows if r["bin"] is not None]
        windows = [(number[r["contig"]], r["window"], whole(r, "lo")) for r in rows if r["window"] is not None]
        spelled = b"".join(n.encode() + b"\0" for n in names)
        index = b"TBI\1" + struct.pack("<i6ii", len(names), *_HEAD, len(spelled)) + spelled + bam_index.packed(len(names), chunks, windows)[8:]
        packed = b"".join(deflate(index[k : k + CONTENT]) for k in range(0, len(index), CONTENT)) + TAIL
        with fs.open_output_stream(f"{at}.tbi") as out:
            out.write(packed)
        fs.move(f"{at}.tmp", at)
        yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [fs.get_file_info(at).size], "index_bytes": [len(packed)]})

    # rows are the index's, not the calls'; one more row brings a task where there are no calls
    none = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in placed.schema))
    return materialize(placed.unionByName(none).coalesce(1).mapInArrow(join, "path string, bytes long, index_bytes long"), folder, "written")


def _index(path: str) -> tuple[bam_index.Index, list[str]]:
    import io

    fs, at = FileSystem.from_uri(path)
    with fs.open_input_file(f"{at}.tbi") as file:
        raw = file.read()
    stream, parts = Stream(io.BytesIO(raw), 0), []
    while stream.have(1):
        parts.append(stream.take(len(stream.data) - stream.at))
    data = b"".join(parts)
    n, size = struct.unpack_from("<i", data, 4)[0], struct.unpack_from("<i", data, 32)[0]
    names = data[36 : 36 + size].decode().split("\0")[:-1]
    return bam_index.parse(b"BAI\1" + struct.pack("<i", n) + data[36 + size :]), names


def read_region(spark: SparkSession, path: str, contig: str, begin: int, end: int) -> DataFrame:
    """(value): the lines of a written file that begin in [begin, end) (from 0) of a contig, or may reach into it, from the index's parts alone."""
    path = _uri(path)
    index, names = _index(path)
    parts = index.chunks(names.index(contig), begin, end) if contig in names else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = FileSystem.from_uri(path)
                lines = []
                with fs.open_input_file(at) as file:
                    stream = Stream(file, lo)
                    while stream.have(1) and stream.place() < hi:
                        size = stream.data.find(b"\n", stream.at) - stream.at
                        if size < 0:
                            if not stream._more():
                                break
                            continue
                        lines.append(stream.take(size + 1)[:-1].decode())
                kept = [s for s in lines if s.split("\t", 1)[0] == contig and int(s.split("\t", 2)[1]) - 1 < end]
                yield pa.RecordBatch.from_pydict({"value": pa.array(kept, pa.string())})

    return spark.createDataFrame(parts, "lo long, hi long").repartition(max(1, len(parts))).mapInArrow(run, "value string")
