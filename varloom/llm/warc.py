"""WARC archives: writing pages as gzip members, and a splittable reader.

Every record is a gzip member of its own.  The reader's tasks take byte ranges of the files.  A task looks
for gzip magic in its range, takes a place for a member only if it inflates to the head of a WARC record,
and owns the records that start inside its range, however far they reach.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder
from varloom.llm.common import column, lookup

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range that one task scans, and bytes read at once.
RANGE_BYTES, READ_BYTES = 16 << 20, 1 << 20
#: Tasks that read ranges, at most; beyond, a task reads several ranges.
MOST_TASKS = 10_000
#: Records with shorter payloads are never revisits.
LEAST_PAYLOAD = 100

# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def filesystem(uri: str):
    """(file system, path) of a URI; a path without a scheme is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def record(kind: str, page_id: int | None, url: str | None, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    head = HTTP_HEAD % len(payload)
    block = head + (payload if kind == "response" else b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        fields += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``, a file per task; (path, records, bytes) of the files.

    Of records with equal payloads of at least LEAST_PAYLOAD bytes, those with the smallest page_id are
    responses and the others revisits; an id of null comes after all others.  A null html is an empty payload.
    A task that runs again writes the same bytes and renames them over the former file.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("size")
    )
    firsts = rows.filter(F.col("size") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    fs, base = filesystem(folder)
    fs.create_dir(f"{base}/archives", recursive=True)  # without pages there are no files, but a folder
    marked = lookup(rows, materialize(firsts, folder, "firsts"), ["digest"])

    def run(batches):
        fs, base = filesystem(folder)
        task = TaskContext.get()
        path = f"{base}/archives/part-{task.partitionId():06d}.warc.gz"
        held = f"{path}.{task.taskAttemptId()}"
        fs.create_dir(os.path.dirname(path), recursive=True)
        count = size = 0
        with fs.open_output_stream(held) as out:
            for batch in batches:
                first = column(batch, "first")
                cols = [column(batch, c) for c in ("page_id", "url", "html", "digest")]
                for i in range(batch.num_rows):
                    page_id, url, html, digest = (c[i].as_py() for c in cols)
                    to = first[i].as_py()
                    kind = "response" if to is None or to == page_id else "revisit"
                    data = record(kind, page_id, url, digest, html.encode(), to)
                    out.write(data)
                    count, size = count + 1, size + len(data)
        if count:
            fs.move(held, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})
        else:
            fs.delete_file(held)

    return materialize(marked.mapInArrow(run, "path string, records long, bytes long"), folder, "manifest")


class _Window:
    """A file's bytes from a moving place on, read in pieces."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data, self.pos = file, at, b"", 0
        file.seek(at)

    def more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.data, self.pos = self.data[self.pos :] + got, 0
        return bool(got)

    def held(self) -> int:
        return len(self.data) - self.pos

    def skip(self, n: int) -> None:
        self.pos, self.at = self.pos + n, self.at + n


def _member(window: _Window) -> tuple[bytes, int] | None:
    """(content, compressed size) of a gzip member that starts the window and holds a WARC record."""
    inflate, parts, used, known = zlib.decompressobj(31), [], 0, False
    while True:
        if used == window.held() and not window.more():
            return None
        piece = window.data[window.pos + used : window.pos + used + (1 << 16)]
        try:
            parts.append(inflate.decompress(piece))
        except zlib.error:
            return None
        used += len(piece) - len(inflate.unused_data)
        if not known:
            start = b"".join(parts)[:7]
            if start != b"WARC/1."[: len(start)]:
                return None
            known = len(start) == 7
        if inflate.eof:
            return (b"".join(parts), used) if known else None


def records_of(file, begin: int, end: int):
    """(offset, content) of the records that start in [begin, end)."""
    window = _Window(file, begin)
    while window.at < end:
        reach = end - window.at + len(MAGIC) - 1
        place = window.data.find(MAGIC, window.pos, window.pos + reach)
        if place < 0:
            if window.held() >= reach:
                return
            window.skip(max(0, window.held() - len(MAGIC) + 1))
            if not window.more():
                return
            continue
        window.skip(place - window.pos)
        found = _member(window)
        if found is None:
            window.skip(1)
            continue
        yield window.at, found[0]
        window.skip(found[1])


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-case name, block) of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields.get("content-length", "0"))]


def _page(value: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value)
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records below ``path``: path, offset, record_type, uri, page_id, refers_to, stated digest and payload.

    Files are listed without their contents and cut into ranges of ``range_bytes``; records come out once each,
    whatever the ranges.  Damaged members are passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    ranges = files.filter("length > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes))).alias("begin"))

    def run(batches):
        for batch in batches:
            for name, begin in zip(column(batch, "path").to_pylist(), column(batch, "begin").to_pylist(), strict=True):
                fs, at = filesystem(name)
                with fs.open_input_file(at) as file:
                    rows: list[tuple] = []
                    held = 0
                    for offset, content in records_of(file, begin, begin + range_bytes):
                        fields, block = parse(content)
                        payload = block.partition(b"\r\n\r\n")[2] if "application/http" in fields.get("content-type", "") else block
                        rows.append((name, offset, fields.get("warc-type"), fields.get("warc-target-uri"), _page(fields.get("warc-record-id", "")), _page(fields.get("warc-refers-to", "")), fields.get("warc-payload-digest", "").rpartition(":")[2], payload))
                        held += len(payload)
                        if held > READ_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    schema = "path string, offset long, record_type string, uri string, page_id long, refers_to long, stated_digest string, payload binary"
    # a task for each range: the rows are tiny, and would else come to one task
    tasks = min(max(1, ranges.count()), MOST_TASKS)
    return ranges.repartition(tasks).mapInArrow(run, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["path", "offset", "record_type", "uri", "page_id", "refers_to", "stated_digest", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Pages written as archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are those of the payload read; a revisit has those of the response that it
    refers to.  Repeated rows give a record each; rows that share the smallest page_id of a payload are all responses.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark)
    write_archives(pages, folder)
    read = read_archives(spark, f"{folder}/archives").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to", "stated_digest"
    )
    read = materialize(read, folder, "records")
    responses = read.filter("record_type = 'response' and page_id is not null")
    known = responses.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated_digest")).agg(F.max("payload_bytes").alias("full_bytes"))
    revisits = lookup(read.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "stated_digest"), known, ["refers_to", "stated_digest"])
    return (
        read.filter("record_type = 'response'")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
        .unionByName(revisits.select("page_id", F.col("full_bytes").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to"))
    )


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
