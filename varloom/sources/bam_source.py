"""``spark.read.format("bam")``: filters on contig and pos reach the index, so a region reads only its own parts of a file.

Register it once with ``register(spark)``.  Spark applies the filters again, so what is read may be more than asked for.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from varloom.sources import bam
from varloom.sources.bam_index import MOST
from varloom.sources.bgzf import Stream


@dataclass
class Part(InputPartition):
    """Places of one file between which a task reads; bytes of a stretch where there is no index."""

    path: str
    begin: int
    end: int
    names: list[str] = field(default_factory=list)
    region: tuple[int, int, int] | None = None
    raw: bool = False


class BamReader(DataSourceReader):
    def __init__(self, path: str, stretch: int):
        self.path, self.stretch = path, stretch
        self.contigs: set[str] | None = None
        self.low, self.high = -1, MOST

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Notes which contigs and begins are asked for; all filters stay Spark's to apply."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("contig",) and isinstance(f, EqualTo | In):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.contigs = some if self.contigs is None else self.contigs & some
            elif name == ("pos",) and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif name == ("pos",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == ("pos",) and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            yield f

    def _paths(self) -> list[tuple[str, int]]:
        fs, at = bam._fs(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(at, recursive=True))
        prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        return sorted((prefix + i.path, i.size) for i in found if i.type == FileType.File and i.path.endswith(".bam"))

    def partitions(self) -> list[Part]:
        """Parts of the files that may hold what is asked for.  Reads each file's header and index, some MB, on the planner."""
        parts: list[Part] = []
        for path, size in self._paths():
            with bam.opened(path) as file:
                _, names = bam.header(Stream(file, 0))
            # records without a contig stand in no index
            index = bam.load_index(path) if self.contigs is not None and "*" not in self.contigs else None
            if index is None:
                parts += [Part(path, b, min(b + self.stretch, size), names, None, True) for b in range(0, size, self.stretch)]
                continue
            for contig in sorted(self.contigs & set(names)):
                region = (names.index(contig), self.low, self.high)
                parts += [Part(path, b, e, names, region) for b, e in bam.cut_parts(index, region, self.stretch)]
        return parts or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        begin, end = partition.begin, partition.end
        if not partition.path:
            return
        if partition.raw:
            with bam.opened(partition.path) as file:
                begin, end = bam._owned(file, begin, end, len(partition.names))
            if begin == bam.END:
                return
        yield from bam.read_part(partition.path, begin, end, partition.names, partition.region)


class BamSource(DataSource):
    """Options: path (a file or a folder, or what load() is given), stretch (compressed bytes a task reads at least)."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return bam.RECORD

    def reader(self, schema) -> BamReader:
        path = self.options["path"]
        return BamReader(path if "://" in path or path.startswith("file:") else f"file://{path}", int(self.options.get("stretch", bam.STRETCH)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
