"""ISO media containers as a column: writing payloads as 8-bit samples, and reading tracks from the boxes.

Reading walks the nested boxes and decodes the sample tables; codec, duration and keyframe byte ranges come
from these alone, and no sample is decoded.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import column, quoted

#: Bytes of an access unit, units of a chunk, units from one keyframe to the next, samples a second.
UNIT, PER_CHUNK, KEY_EVERY, RATE = 64, 64, 16, 8000

# Fixed values of the container format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta"}

MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, *parts: bytes) -> bytes:
    """A box with version 0 and no flags."""
    return box(kind, bytes(4), *parts)


def write_container(payload: bytes) -> bytes:
    """A file with one audio track of 8-bit samples; the payload is a positive multiple of UNIT bytes."""
    units = len(payload) // UNIT
    chunks = -(-units // PER_CHUNK)
    runs = [(1, min(units, PER_CHUNK), 1)]
    if units % PER_CHUNK and chunks > 1:
        runs.append((chunks, units % PER_CHUNK, 1))
    keys = np.arange(1, units + 1, KEY_EVERY, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"qt  ")
    span = units * UNIT

    def moov(offset: int) -> bytes:
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, units, UNIT)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", UNIT, units)),
            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stco", struct.pack(">I", chunks), (offset + np.arange(chunks) * UNIT * PER_CHUNK).astype(">u4").tobytes()),
        )
        reference = full_box(b"dref", struct.pack(">I", 1), box(b"url ", struct.pack(">I", 1)))
        minf = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", reference), stbl)
        mdia = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, span, 0x55C4, 0)),
            full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
            minf,
        )
        tkhd = box(b"tkhd", struct.pack(">I", 7), struct.pack(">IIIII", 0, 0, 1, 0, span), bytes(16), MATRIX, bytes(8))
        head = struct.pack(">IIIIIH", 0, 0, RATE, span, 0x10000, 0x100) + bytes(10) + MATRIX + bytes(24) + struct.pack(">I", 2)
        return box(b"moov", full_box(b"mvhd", head), box(b"trak", tkhd, mdia))

    size = len(moov(0))
    return ftyp + moov(len(ftyp) + size + 8) + box(b"mdat", payload)


def walk(data: bytes, begin: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, body begin, body end) of every box, parents first; a box that leaves its parent ends the walk."""
    end = len(data) if end is None else end
    while begin + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1:
            if begin + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            return
        yield (*path, kind), begin + head, begin + size
        if kind in CONTAINERS:
            yield from walk(data, begin + head, begin + size, (*path, kind))
        begin += size


def _table(data: bytes, at: int, end: int, width: int, kind: str = ">u4") -> np.ndarray:
    count = struct.unpack_from(">I", data, at)[0]
    size = np.dtype(kind).itemsize
    count = min(count, (end - at - 4) // (size * width))
    return np.frombuffer(data, kind, count * width, at + 4).astype(np.int64).reshape(count, width)


def read_tracks(data: bytes) -> list[dict]:
    """Of each track: codec, timescale, duration, byte ranges of its samples and which are keyframes.

    Malformed tracks are left out; bytes that aren't a container give no tracks.
    """
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, begin, end in walk(data):
        if path[-1] == b"trak":
            tracks.append({})
        elif tracks and b"trak" in path:
            tracks[-1].setdefault(path[-1], (begin, end))
    out = []
    for t in tracks:
        try:
            out.append(_track(data, t))
        except (KeyError, struct.error, ValueError, IndexError):
            continue
    return out


def _track(data: bytes, t: dict[bytes, tuple[int, int]]) -> dict:
    at, _ = t[b"mdhd"]
    scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
    codec = data[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16].decode("latin-1")
    at, end = t[b"stsz"]
    fixed, count = struct.unpack_from(">II", data, at + 4)
    if fixed:
        count = min(count, len(data) // fixed + 1)
        sizes = np.full(count, fixed, np.int64)
    else:
        sizes = _table(data, at + 8, end, 1)[:, 0]
    chunk = _table(data, t[b"stco"][0] + 4, t[b"stco"][1], 1)[:, 0] if b"stco" in t else _table(data, t[b"co64"][0] + 4, t[b"co64"][1], 1, ">u8")[:, 0]
    runs = _table(data, t[b"stsc"][0] + 4, t[b"stsc"][1], 3)
    per = np.zeros(len(chunk), np.int64)
    for k, (first, n, _) in enumerate(runs):
        last = runs[k + 1][0] - 1 if k + 1 < len(runs) else len(chunk)
        per[first - 1 : last] = n
    owner = np.repeat(np.arange(len(chunk)), per)[: len(sizes)]
    sizes = sizes[: len(owner)]
    ends = np.cumsum(sizes)
    first_of = np.searchsorted(owner, np.arange(len(chunk)))
    before = np.concatenate(([0], ends))[np.minimum(first_of, len(ends))]
    begins = chunk[owner] + ends - sizes - before[owner]
    keys = _table(data, t[b"stss"][0] + 4, t[b"stss"][1], 1)[:, 0] - 1 if b"stss" in t else np.arange(len(sizes))
    return {"codec": codec, "timescale": scale, "duration": duration, "begin": begins, "end": begins + sizes, "keys": keys[keys < len(sizes)]}


def samples(data: bytes, track: dict) -> bytes:
    """The track's stored bytes, in order; neighbouring ranges are read at once."""
    begin, end = track["begin"], track["end"]
    if not len(begin):
        return b""
    cut = np.flatnonzero(begin[1:] != end[:-1]) + 1
    starts, stops = begin[np.concatenate(([0], cut))], end[np.concatenate((cut - 1, [len(end) - 1]))]
    return b"".join(data[a:b] for a, b in zip(starts, stops, strict=True))


def probe(media: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """One row per track: id, track, codec, timescale, duration, keyframes (array of begin and end bytes).

    Null or malformed media have no rows.
    """
    key = media.schema[id_column].dataType
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for i, data in enumerate(column(batch, "media")):
                for k, t in enumerate(read_tracks(data.as_py() or b"")):
                    ranges = [{"begin": int(t["begin"][x]), "end": int(t["end"][x])} for x in t["keys"]]
                    rows.append((i, k, t["codec"], t["timescale"], t["duration"], ranges))
            if rows:
                i, k, codec, scale, duration, ranges = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "id").take(pa.array(i)), pa.array(k, pa.int32()), pa.array(codec), pa.array(scale, pa.int64()), pa.array(duration, pa.int64()), pa.array(ranges, kind)],
                    names=["id", "track", "codec", "timescale", "duration", "keyframes"],
                )

    found = ["track", "codec", "timescale", "duration", "keyframes"]
    schema = f"id {key.simpleString()}, track int, codec string, timescale long, duration long, keyframes array<struct<begin:long,end:long>>"
    rows = media.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(media_column)).alias("media"))
    return rows.mapInArrow(run, schema).toDF(id_column, *found)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text in UTF-8, padded with bytes 0 to a positive multiple of UNIT.

    A null text is empty.  Rows keep their ids, null or repeated ones too.
    """

    def run(batches):
        for batch in batches:
            texts = column(batch, "text").cast(pa.binary())
            for lo in range(0, batch.num_rows, 256):
                sizes, media = [], []
                for raw in texts.slice(lo, 256):
                    data = raw.as_py() or b""
                    sizes.append(len(data))
                    media.append(write_container(data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\0")))
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id").slice(lo, 256), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Digest columns of stored media: the payload as read through the sample tables, the file itself, a feature.

    The feature names the codec, the duration, and the count and outer bounds of the keyframes' byte ranges.  Media that are null
    or hold no track have nulls but for their own size and digest.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for raw in column(batch, "media"):
                data = raw.as_py() or b""
                tracks = read_tracks(data)
                if not tracks:
                    rows.append((None, None, None, len(data), hashlib.sha256(data).hexdigest(), None))
                    continue
                track = tracks[0]
                payload = samples(data, track)
                keys = track["keys"]
                begin, end = track["begin"][keys], track["end"][keys]
                feature = f"codec={track['codec'].strip()};timescale={track['timescale']};duration={track['duration']};keyframes={len(keys)};ranges={begin[0]}-{end[-1]}:{zlib.crc32(begin.astype('<i8').tobytes() + end.astype('<i8').tobytes())}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            if rows:
                size, digest, crc, whole, media_digest, feature = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id"), column(batch, "n_bytes"), pa.array(size, pa.int64()), pa.array(digest, pa.string()), pa.array(crc, pa.int64()), pa.array(whole, pa.int64()), pa.array(media_digest), pa.array(feature, pa.string())],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(run, schema)
