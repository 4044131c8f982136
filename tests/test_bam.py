"""Binary alignment files against the same records as text."""

import random
import struct
import zlib

import pytest

from varloom.sources import bam, formats

HEAD = "@HD\tVN:1.6\n@SQ\tSN:c1\tLN:100000\n@SQ\tSN:c2\tLN:5000\n@RG\tID:1\tPL:ONT\tSM:me\n"


def alignments(n):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        size = rng.randrange(1, 400)
        tags = [f"NM:i:{rng.randrange(300)}", f"SA:Z:c2,{i},+,{size}M,60,1;", "XA:A:q"][: rng.randrange(4)]
        mate = rng.choice([("*", 0), ("=", 7), ("c2", 9)])
        rows.append([f"read{i}", rng.choice([0, 16, 99]), "c1", 20_000 * i // n + 1, rng.randrange(61), f"{size}M", *mate, rng.randrange(-500, 500), "".join(rng.choices("ACGTN", k=size)), "I" * size if i % 3 else "*", *tags])
    rows.append(["lost", 4, "*", 0, 0, "*", "*", 0, 0, "ACG", "*"])
    return rows


def encoded(row):
    name, flag, contig, pos, mapq, cigar, mate, mate_pos, isize, seq, qual, *tags = row
    ref = {"c1": 0, "c2": 1, "*": -1}
    ops = [] if cigar == "*" else [int(cigar[:-1]) << 4]
    codes = ["=ACMGRSVTWYHKDBN".index(b) for b in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    body = struct.pack("<iiBBHHHiiii", ref[contig], pos - 1, len(name) + 1, mapq, 0, len(ops), flag, len(seq), ref[contig if mate == "=" else mate], mate_pos - 1, isize)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", o) for o in ops) + packed + (b"\xff" * len(seq) if qual == "*" else bytes(ord(q) - 33 for q in qual))
    for tag in tags:
        key, kind, value = tag.split(":", 2)
        body += key.encode() + {"i": lambda v: b"S" + struct.pack("<H", int(v)), "Z": lambda v: b"Z" + v.encode() + b"\0", "A": lambda v: b"A" + v.encode()}[kind](value)
    return struct.pack("<i", len(body)) + body


def block(data):
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write(folder, rows, size):
    """The file in blocks of ``size`` bytes, with an index of one bin and of windows of 16,384 bases."""
    head = b"BAM\1" + struct.pack("<i", len(HEAD)) + HEAD.encode() + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in (("c1", 100_000), ("c2", 5_000)))
    places, data, out = [], head, b""
    starts = []
    for row in rows:
        starts.append(len(data))
        data += encoded(row)
    at = {}
    for lo in range(0, len(data), size):
        at[lo // size] = len(out)
        out += block(data[lo : lo + size])
    places = [at[s // size] << 16 | s % size for s in starts]
    (folder / "a.bam").write_bytes(out + block(b""))
    windows = [next(p for p, r in zip(places, rows, strict=True) if r[2] == "c1" and r[3] > 16_384 * w) for w in range(2)]
    first = struct.pack("<iIi", 1, 4681, 3) + b"".join(struct.pack("<QQ", places[len(rows) * k // 4], 0) for k in range(3)) + struct.pack("<i", 2) + struct.pack("<QQ", *windows)
    (folder / "a.bam.bai").write_bytes(b"BAI\1" + struct.pack("<i", 2) + first + struct.pack("<ii", 0, 0))


@pytest.mark.parametrize(("size", "stretch"), [(50_000, 1 << 20), (300, 4_000)])
def test_bam_is_read_like_its_text(spark, tmp_path, size, stretch):
    rows = alignments(200)
    write(tmp_path, rows, size)
    (tmp_path / "a.sam").write_text(HEAD + "".join("\t".join(map(str, r)) + "\n" for r in rows))
    plain = lambda df: sorted((r["qname"], *(tuple(sorted(r[c].items())) if c == "tags" else r[c] for c in df.columns)) for r in df.collect())
    got = bam.read_bam(spark, str(tmp_path), stretch)
    assert plain(got) == plain(formats.read_sam(spark, str(tmp_path / "a.sam")).select(got.columns))
    assert [r["value"] for r in bam.bam_header(spark, str(tmp_path)).collect()] == HEAD.splitlines()
