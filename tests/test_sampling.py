"""Sampling in a file's order against a plain loop over its pairs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_bam_regions import write

from varloom.operators import library, sampling
from varloom.operators.records import prepared, scan
from varloom.operators.sampling import Rule
from varloom.sources import bam

RULE = Rule(buffer=10, look=50, most=400, long=5_000, share=0.2, parts=20)


def plain_cut(size):
    zeros = 0
    while size > 1000:
        size, zeros = size // 10, zeros + 1
    return size * 10**zeros


def plain_bins(sizes):
    total, below, bins = sum(sizes.values()), 0, []
    for size in sorted(sizes):
        below += sizes[size]
        bins += [size] * (round(below / total * 1000) - len(bins))
    return bins


def plain_share(sizes, upto):
    return sum(n for s, n in sizes.items() if s <= upto) / sum(sizes.values())


def plain_agree(a, b):
    x, y = plain_bins(a), plain_bins(b)
    return all(abs(x[k] - y[k]) < 1 and abs(plain_share(a, y[k]) - plain_share(b, y[k])) < 0.001 for k in range(49, 1000, 100))


def plain_sample(pairs, contigs, rule):
    """One pair after another: (sizes, settled, buffers dropped, turns of the contigs)."""
    rows = {c: sorted((p, i, plain_cut(s)) for i, (c_, p, s) in enumerate(pairs) if c_ == c) for c, _ in contigs}
    highest = {c: -1 for c, _ in contigs}
    taken, buffer, last, settled, stop, dropped, turns = Counter(), [], None, False, False, 0, 0

    def sound():
        return bool(buffer) and sum(s >= rule.long for s in buffer) / len(buffer) < rule.share

    active = True
    while active and not stop:
        active, turns = False, turns + 1
        for c, size in contigs:
            ended = False
            while not stop and not ended and (first := highest[c] + 1) < size:
                for p, _, s in rows[c]:
                    if p < first:
                        continue
                    highest[c], active = p, True
                    buffer.append(s)
                    if len(buffer) < rule.buffer:
                        continue
                    if not sound():
                        buffer, dropped = [], dropped + 1
                        highest[c] += max(1, size // rule.parts)
                        break
                    taken.update(buffer)
                    buffer = []
                    if sum(taken.values()) % rule.look == 0:
                        settled = last is not None and plain_agree(last, taken)
                        last, ended = Counter(taken), True
                        stop = settled or sum(taken.values()) > rule.most
                        break
                if highest[c] <= first:
                    highest[c] += max(1, size // rule.parts)
    if sound():
        taken.update(buffer)
    return taken, settled, dropped, turns


def made(seed, n, spread, bad):
    """Pairs of three contigs, with stretches of long ones; many start at one place."""
    rng = random.Random(seed)
    contigs = [("b", 9_000), ("a", 4_000), ("none", 500), ("c", 700)]
    out = []
    for _ in range(n):
        c, size = rng.choice(contigs[:2] + contigs[3:])
        p = rng.randrange(size // 3) * 3
        out.append((c, p, rng.randrange(4_000, 90_000) if p // 100 % 10 < bad else 300 + rng.randrange(spread)))
    return out, contigs


@pytest.mark.parametrize("seed,n,spread,bad,width", [(1, 900, 40, 3, 500), (2, 900, 1, 0, 500), (3, 300, 400, 1, 10**6), (4, 60, 5, 5, 2_000), (5, 7, 5, 0, 10**6), (6, 900, 2, 2, 10**6)])
def test_sampling_in_order(spark, seed, n, spread, bad, width):
    pairs, contigs = made(seed, n, spread, bad)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "pair_id long, contig string, pos long, isize long").repartition(5)
    got = sampling.sample(sampling.of_table(df), contigs, [F.col("pair_id")], RULE, width)
    sizes, settled, *_ = plain_sample(pairs, contigs, RULE)
    assert (got.sizes, got.settled) == (sizes, settled)


def test_fixture_drops_jumps_and_stops():
    found = {k: plain_sample(*made(*k), RULE) for k in ((1, 900, 40, 3), (2, 900, 1, 0), (3, 300, 400, 1), (6, 900, 2, 2))}
    assert max(dropped for _, _, dropped, _ in found.values()) > 5 and max(turns for *_, turns in found.values()) > 2
    assert found[2, 900, 1, 0][1] and found[2, 900, 1, 0][0].total() == 100
    assert any(sizes.total() > RULE.most for sizes, *_ in found.values()) or any(not settled for _, settled, *_ in found.values())


def test_no_pairs(spark):
    df = spark.createDataFrame([], "pair_id long, contig string, pos long, isize long")
    got = sampling.sample(sampling.of_table(df), [("c", 100)], rule=RULE)
    assert got.pairs == 0 and not got.settled and got.frame(spark).count() == 0
    assert sampling.sample(sampling.of_table(df), []).pairs == 0
    with pytest.raises(ValueError):
        Rule(buffer=7, look=50)


def test_counted_sizes_have_the_same_moments(spark):
    df = spark.createDataFrame([(s,) for s in (300, 300, 310, 280, 295)], "isize long")
    counted = spark.createDataFrame([(300, 2), (310, 1), (280, 1), (295, 1)], "size long, n long")
    assert library.moments(df).collect() == library.moments(counted).collect()


def test_windows_of_a_file_read_their_part(spark, tmp_path):
    """Sampling an indexed file equals sampling the table of its pairs."""
    rng, rows = random.Random(5), []
    for k in range(400):
        pos, gap = 1 + 200 * k + rng.randrange(150), 6_000 if 100 < k < 130 else 250 + rng.randrange(3)
        rows.append([f"p{k}", 99, "c1", pos, 60, "50M", "=", pos + gap - 50, gap, "ACGT", "*"])
        rows.append([f"p{k}", 147, "c1", pos + gap - 50, 60, "50M", "=", pos, -gap, "ACGT", "*"])
    rows.sort(key=lambda r: r[3])
    write(tmp_path / "p.bam", rows)
    bam.ensure_indexes(spark, str(tmp_path)).collect()
    contigs = [("c1", 100_000), ("c2", 5_000)]
    whole = library.library_reads(prepared(scan([bam.read_bam(spark, str(tmp_path))]))).collect()
    pairs = [(r["contig"], r["pos"], r["isize"]) for r in sorted(whole, key=lambda r: (r["pos"], r["qname"]))]
    got = sampling.sample(sampling.of_file(spark, str(tmp_path)), contigs, [F.col("qname")], RULE, 20_000)
    sizes, settled, dropped, _ = plain_sample(pairs, contigs, RULE)
    assert dropped > 0 and (got.sizes, got.settled) == (sizes, settled) and got.pairs > 100
