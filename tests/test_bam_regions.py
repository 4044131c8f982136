"""Alignment files by region, without an index, with long CIGARs, and as a Spark format."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from test_bam import HEAD, alignments, block, encoded

from varloom.sources import bam, bam_index, bam_source, bgzf


def write(path, rows, size=3_000, tail=True):
    head = b"BAM\1" + struct.pack("<i", len(HEAD)) + HEAD.encode() + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", s) for n, s in (("c1", 100_000), ("c2", 5_000)))
    data = head + b"".join(encoded(r) if isinstance(r, list) else r for r in rows)
    path.write_bytes(b"".join(block(data[k : k + size]) for k in range(0, len(data), size)) + (block(b"") if tail else b""))


def sorted_rows(n):
    rng = random.Random(n)
    rows = [r for r in alignments(n) if r[2] == "c1"]
    more = [[f"other{k}", 0, "c2", 10 * k + 1, 60, f"{rng.randrange(1, 90)}M", "*", 0, 0, "ACGT", "*"] for k in range(n // 2)]
    lost = [["lost", 4, "*", 0, 0, "*", "*", 0, 0, "ACG", "*"]] * 3
    return [*rows, *more, *lost]


def key(r):
    return (r["qname"], r["contig"], r["pos"], r["cigar"], r["seq"], tuple(sorted(r["tags"].items())))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bam")
    write(path / "a.bam", sorted_rows(600))
    written = bam.ensure_indexes(spark, str(path), stretch=20_000).collect()
    assert len(written) == 1 and written[0]["bytes"] == (path / "a.bam.bai").stat().st_size
    assert bam.ensure_indexes(spark, str(path)).count() == 0
    return path


@pytest.mark.parametrize("size", [70, 1_000, 60_000])
def test_any_cut_yields_each_record_once(spark, tmp_path, size):
    """Stretches of every length, blocks that hold many records or a part of one, records over many blocks."""
    rows = sorted_rows(120)
    rows[5][9:11] = ["ACGTN" * 4_000, "*"]
    rows[5][5] = "20000M"
    write(tmp_path / "a.bam", rows, size, tail=size != 1_000)
    whole = (tmp_path / "a.bam").stat().st_size
    with open(tmp_path / "a.bam", "rb") as file:
        for stretch in (whole + 1, whole // 3, 977):
            found = []
            for lo in range(0, whole, stretch):
                begin, end = bam._owned(file, lo, min(lo + stretch, whole), 2)
                if begin < bam.END:
                    found += [d[32 : 31 + d[8]].decode() for d in bam.records_between(file, begin, end)]
            assert found == [r[0] for r in rows]


def test_blocks_are_found_from_any_byte(tmp_path):
    rng = random.Random(1)
    fake = bgzf.MAGIC + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, 40)
    parts = [bgzf.deflate(bytes(rng.randrange(256) for _ in range(rng.randrange(1, 900))) + fake) for _ in range(40)]
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p)
    (tmp_path / "x").write_bytes(b"".join(parts))
    with open(tmp_path / "x", "rb") as file:
        for k in range(0, at, 41):
            assert bgzf.find_block(file, k, at) == next((s for s in starts if s >= k), None)


REGIONS = [("c1", 0, 100_000), ("c1", 3_000, 3_001), ("c1", 16_383, 16_385), ("c1", 19_900, 50_000), ("c2", 0, 17), ("c2", 4_000, 4_001), ("c9", 0, 5), ("c1", 7, 7)]


@pytest.mark.parametrize("stretch", [4_000, 1 << 20])
def test_regions_agree_with_filtered_scans(spark, folder, stretch):
    whole = bam.read_bam(spark, str(folder)).collect()
    end = lambda r: r["pos"] + max(1, int(r["cigar"].removesuffix("M"))) if r["contig"] != "*" else 0
    want = [key(r) for contig, lo, hi in REGIONS for r in whole if r["contig"] == contig and r["pos"] < hi and end(r) > lo and lo < hi]
    assert sorted(map(key, bam.read_bam(spark, str(folder), stretch, REGIONS).collect())) == sorted(want)


def test_a_region_reads_only_its_blocks(folder):
    path = f"file://{folder}/a.bam"
    index = bam.load_index(path)
    whole = (folder / "a.bam").stat().st_size
    for region in ((0, 3_000, 3_100), (1, 100, 200)):
        read = 0
        with bam.opened(path) as file:
            for begin, end in bam.cut_parts(index, region, 1 << 20):
                stream = bgzf.Stream(file, begin)
                while stream.have(4) and stream.place() < end:
                    ref, lo, _ = bam._extent(stream.take(struct.unpack("<i", stream.take(4))[0]))
                    if (ref, lo) >= (region[0], region[2]):
                        break
                read += stream.read_bytes()
        assert 0 < read < whole / 2


def test_both_formats_of_an_index(folder, tmp_path):
    """The same bins written in the newer format, compressed, give the same parts."""
    old = bam_index.parse((folder / "a.bam.bai").read_bytes())
    out = [b"CSI\1", struct.pack("<iiii", 14, 5, 0, len(old.contigs))]
    for contig in old.contigs:
        out.append(struct.pack("<i", len(contig.bins) + 1))
        for number, chunks in contig.bins.items():
            level = max(k for k in range(6) if bam_index.first_bin(k) <= number)
            window = (number - bam_index.first_bin(level)) << 3 * (5 - level)
            least = int(contig.windows[min(window, len(contig.windows) - 1)])
            out.append(struct.pack("<IQi", number, least, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks.tolist()))
        out.append(struct.pack("<IQi", 37450, 0, 1) + struct.pack("<QQ", 7, 7))
    new = bam_index.parse(bgzf.deflate(b"".join(out)) + bgzf.TAIL)
    assert (new.shift, new.depth) == (14, 5)
    for region in ((0, 0, 100_000), (0, 3_000, 3_100), (0, 17_000, 18_000), (1, 0, 5_000)):
        lo, hi = old.chunks(*region), new.chunks(*region)
        assert lo[0][0] >= hi[0][0] and lo[-1][1] == hi[-1][1]
    for name in ("a.bai", "a.csi", "a.bam.csi"):
        folder_ = tmp_path / name
        folder_.mkdir()
        (folder_ / "a.bam").write_bytes((folder / "a.bam").read_bytes())
        (folder_ / name).write_bytes((folder / "a.bam.bai").read_bytes() if name.endswith("bai") else bgzf.deflate(b"".join(out)) + bgzf.TAIL)
        assert bam.load_index(f"file://{folder_}/a.bam") is not None
    assert bam.load_index(f"file://{tmp_path}/none.bam") is None


def test_filters_reach_the_index(spark, folder):
    bam_source.register(spark)
    table = spark.read.format("bam").option("stretch", 20_000).load(str(folder))
    whole = bam.read_bam(spark, str(folder)).cache()
    for f in ((F.col("contig") == "c1") & (F.col("pos") > 5_000) & (F.col("pos") <= 5_600), F.col("contig").isin("c1", "*"), F.col("flag") == 16, F.col("contig") == "none"):
        assert sorted(map(key, table.filter(f).collect())) == sorted(map(key, whole.filter(f).collect()))
    reader = bam_source.BamReader(f"file://{folder}", 2_000)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    list(reader.pushFilters([EqualTo(("contig",), "c1"), GreaterThanOrEqual(("pos",), 17_000), LessThan(("pos",), 17_200)]))
    parts = reader.partitions()
    assert all(p.region == (0, 17_000, 17_200) for p in parts)
    assert sum((p.end >> 16) - (p.begin >> 16) for p in parts) < (folder / "a.bam").stat().st_size / 2


def test_long_cigars_come_from_their_tag(spark, tmp_path):
    """A record of more operations than fit holds them in CG; a placeholder's letters in another tag don't count."""
    codes = [10 << 4 | 0, 3 << 4 | 2] * 40_000 + [5 << 4 | 1]
    size = sum(c >> 4 for c in codes if c & 15 in (0, 1))
    reach = sum(c >> 4 for c in codes if c & 15 in (0, 2))
    body = struct.pack("<iiBBHHHiiii", 0, 100, 5, 60, 0, 2, 0, size, -1, -1, 0) + b"long\0" + struct.pack("<II", size << 4 | 4, reach << 4 | 3)
    body += b"\x11" * ((size + 1) // 2) + b"\xff" * size + b"XZZnoCGBI\1\0\0\0\0\0\0\0\0".replace(b"\0", b"!") + b"\0" + b"CGBI" + struct.pack(f"<I{len(codes)}I", len(codes), *codes) + b"NMC\7"
    write(tmp_path / "a.bam", [struct.pack("<i", len(body)) + body, ["next", 0, "c1", 200, 60, "4M", "*", 0, 0, "ACGT", "*"]], 60_000)
    long, other = sorted(bam.read_bam(spark, str(tmp_path)).collect(), key=lambda r: r["pos"])
    assert long["cigar"] == "10M3D" * 40_000 + "5I" and set(long["tags"]) == {"XZ", "NM"} and len(long["seq"]) == size
    assert other["cigar"] == "4M"
    bam.ensure_indexes(spark, str(tmp_path))
    assert bam.read_bam(spark, str(tmp_path), regions=[("c1", reach + 99, reach + 100)]).count() == 1
