"""Operators that SQL can't express, against plain rules, and the helpers against their definitions."""

import itertools
import random
import re
from dataclasses import replace
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from varloom import params
from varloom.functions import reads
from varloom.operators import adjacent, calls, clusters, coverage, intervals, layers, library, merge, records, splits, truth, vcf
from varloom.operators.signatures import sorted_signatures
from varloom.params import ONT
from varloom.plans import registry
from varloom.sources import formats


def signatures(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        begin, length = rng.randrange(3000), rng.choice([31, 40, 60, 200, 900])
        rows.append(("c", rng.randrange(4), 0, begin, begin + length, length, f"t{rng.randrange(40)}", 1.0, rng.randrange(3)))
    return rows


SCHEMA = "contig string, sv_type long, tech int, begin_pos long, end_pos long, length long, template string, quality double, hp long"


def plain_clusters(rows, p):
    """The rule for one type, pair by pair over everything: lists of row numbers."""
    t = rows[0]["sv_type"]

    def brothers(x, y):
        if x["template"] == y["template"]:
            return False
        both = x["hp"] and y["hp"]
        ratio = (p.hp_same[t] if x["hp"] == y["hp"] else p.hp_diff[t]) if both else 1.0
        starts, ends = abs(x["begin_pos"] - y["begin_pos"]), abs(x["end_pos"] - y["end_pos"])
        if starts <= p.force[t] * ratio and ends <= p.force[t] * ratio:
            return True
        least = min(x["length"], y["length"])
        if starts > least * p.pos_ratio[t] or ends > least * p.pos_ratio[t]:
            return False
        return abs(x["length"] - y["length"]) <= int(max(p.length_min[t], int(least * p.length_ratio[t])) * ratio)

    return plain_rounds(rows, brothers, p.force[t] + p.near[t], p)


def plain_rounds(things, brothers, slack, p):
    found = [{"in": [i], "first": r["begin_pos"], "last": r["end_pos"]} for i, r in enumerate(things)]
    again = True
    while again:
        again = False
        found.sort(key=lambda c: c["first"])
        k = 0
        while k < len(found):
            a = found[k]
            for m in range(k + 1, len(found)):
                b = found[m]
                if a["last"] + min(p.cluster_reach, 0.5 * (a["last"] - a["first"])) < b["first"]:
                    break
                apart = b["first"] > a["last"] + slack or a["first"] > b["last"] + slack
                if not apart and any(brothers(things[x], things[y]) for x in a["in"] for y in b["in"]):
                    a["in"] += b["in"]
                    a["first"], a["last"] = min(a["first"], b["first"]), max(a["last"], b["last"])
                    del found[m]
                    again = True
                    break
            k += 1
    return [c["in"] for c in found]


def plain_adjacent(rows, p):
    """One type's rows, in order, after pieces of reads are merged: pair by pair over everything."""
    if rows[0]["sv_type"] != 1:
        return rows
    count = {}
    for part in plain_clusters(rows, p):
        count |= {i: len(part) for i in part}
    reads = {}
    for i, r in enumerate(rows):
        if count[i] == 1:
            reads.setdefault(r["template"], []).append(r)
    both = [r | {"made": False, "count": count[i]} for i, r in enumerate(rows)]
    for name, pieces in reads.items():
        start, more = pieces[0]["begin_pos"], []
        for x in pieces[1:]:
            if start <= x["begin_pos"] < start + 500:
                more.append(len(x.get("ins_bases", "")))
                continue
            if more:
                both.append({"sv_type": 1, "begin_pos": start, "end_pos": start + sum(more), "length": sum(more), "template": name, "hp": 0, "made": True, "count": 0})
            start, more = x["begin_pos"], []
    both.sort(key=lambda r: (r["begin_pos"], r["made"], r.get("sig_id", -1), r["end_pos"], r["template"]))
    left, new = [r for r in both if not r["made"]], []
    for part in sorted(plain_clusters(both, p), key=lambda part: (min(both[i]["begin_pos"] for i in part), min(part))):
        first, last, end = min(both[i]["begin_pos"] for i in part), min(both[i]["end_pos"] for i in part), max(both[i]["end_pos"] for i in part)
        if not 50 <= last - first <= 2000:
            continue
        around = {}
        for r in left:
            if first - 500 <= r["begin_pos"] <= end + 500 and r["count"] <= 5:
                around.setdefault(r["template"], []).append(r)
        fits = []
        for pieces in around.values():
            best = None
            for i in range(len(pieces)):
                total, at = pieces[i]["length"], pieces[i]["begin_pos"]
                for j in range(i + 1, len(pieces)):
                    if pieces[j]["begin_pos"] == at:
                        continue
                    if pieces[j]["begin_pos"] < at + 200:
                        break
                    total += pieces[j]["length"]
                    behind = 2 * at + total - first - last
                    if total <= max(last - first + 10, 2 * (last - first)) and 0 <= behind < 200 and (best is None or behind < best[0]):
                        best = (behind, pieces[i : j + 1], total)
            if best:
                fits.append(best)
        if len(fits) >= (2 if all(both[i]["made"] for i in part) else 1):
            for _, run, total in fits:
                left = [r for r in left if not any(r is x for x in run)]
                new.append(run[0] | {"length": total, "end_pos": run[0]["begin_pos"] + total, "ins_bases": "".join(x.get("ins_bases", "") for x in run)})
    out = sorted([*left, *new], key=lambda r: (r["begin_pos"], r["length"], -r["quality"], r["template"], r["end_pos"]))
    return [r | {"sig_id": k} for k, r in enumerate(out)]


def plain_layers(rows, p):
    """(row's number: (cluster, core)) of one type's rows after both layers."""
    t = rows[0]["sv_type"]
    mean = lambda part, c: sum(rows[i][c] for i in part) / len(part)
    parts = [{"rows": part, "begin_pos": min(rows[i]["begin_pos"] for i in part), "end_pos": max(rows[i]["end_pos"] for i in part), "name": min(rows[i]["sig_id"] for i in part)} for part in plain_clusters(rows, p)]
    parts.sort(key=lambda x: (x["begin_pos"], x["name"]))

    def brothers(x, y):
        a, b = x["rows"], y["rows"]
        n, length = min(len(a), len(b)), (mean(a, "length") + mean(b, "length")) / 2
        if abs(mean(a, "begin_pos") - mean(b, "begin_pos")) >= 200 or abs(mean(a, "end_pos") - mean(b, "end_pos")) >= 200:
            return False
        close = abs(mean(a, "length") - mean(b, "length")) < p.force2[t] / n
        if len(a) == len(b) == 1:
            return close
        if not close and abs(mean(a, "length") - length) / length >= p.length_ratio2[t] / n:
            return False
        return not {rows[i]["template"] for i in a} & {rows[i]["template"] for i in b}

    out = {}
    for found in plain_rounds(parts, brothers, p.force[t] + p.near[t], p):
        members = [parts[k] for k in found]
        top = max(members, key=lambda x: (len(x["rows"]), -x["name"]))
        name, total = min(x["name"] for x in members), sum(len(x["rows"]) for x in members)
        for x in members:
            core = x is top and len(x["rows"]) >= 0.7 * total
            out |= {rows[i]["sig_id"]: (name, core) for i in x["rows"]}
    return out


def plainly_clustered(sig, p):
    by_type = {}
    for r in sig.orderBy("sv_type", "sig_id").collect():
        by_type.setdefault(r["sv_type"], []).append(r.asDict())
    out = {}
    for t, rows in by_type.items():
        for found in plain_clusters(rows, p):
            name = min(rows[i]["sig_id"] for i in found)
            out |= {(t, rows[i]["sig_id"]): name for i in found}
    return out


@pytest.mark.parametrize(("seed", "preset"), [(0, ONT), (1, ONT), (2, ONT), (3, params.CLR), (4, params.CCS), (5, ONT)])
def test_exact_clusters(spark, seed, preset):
    """Islands, bands and rounds over links give what the rule gives over everything."""
    sig = sorted_signatures(spark.createDataFrame(signatures(seed), SCHEMA))
    got = {(r["sv_type"], r["sig_id"]): r["cluster"] for r in clusters.exact_clusters(sig, preset).collect()}
    assert got == plainly_clustered(sig, preset)


def test_dense_loci_are_called_by_cluster(spark):
    """Clusters, not loci: sites, supports and haplotype counts of dense signatures against plain sums over plain clusters."""
    rows = [(*r, True, True, 1, 0) for r in signatures(11, 400)]
    sig = spark.createDataFrame(rows, SCHEMA + ", inv_left boolean, inv_right boolean, cn long, contig_id long")
    numbered = sorted_signatures(sig)
    name = plainly_clustered(numbered, ONT)
    members = {}
    for r in numbered.collect():
        members.setdefault((r["sv_type"], name[r["sv_type"], r["sig_id"]]), []).append(r)
    p = replace(ONT, max_cluster=6, weight_filter=True)
    got = {(r["sv_type"], r["cluster"]): r for r in calls.measured(clusters.with_clusters(sig, p), p).collect()}
    assert set(got) == set(members) and len({r["locus"] for r in got.values()}) < len(got)
    for key, rows in members.items():
        rows.sort(key=lambda r: r["sig_id"])
        if len(rows) > 6:
            skip = len(rows) // 2 - 3
            rows = rows[skip : skip + 6]
        r = got[key]
        assert [r["hp0"], r["hp1"], r["hp2"]] == [sum(x["hp"] == h for x in rows) for h in range(3)] and r["n"] == len(rows)
        kept = [x for x in rows if x["hp"] or not r["drop_untagged"]]
        lengths = sorted(x["length"] for x in kept)
        assert (r["ss"], r["st"]) == (len(kept), len({x["template"] for x in kept}))
        assert (r["pos"], r["sv_len"]) == (sum(x["begin_pos"] for x in kept) // len(kept), sum(lengths) // len(kept))
        assert (r["shortest"], r["middle"], r["longest"]) == (lengths[0], lengths[len(lengths) // 2], lengths[-1])
        assert r["weight"] == pytest.approx(len({x["template"] for x in kept}))


def test_cluster_cap_keeps_all_rows_up_to_the_cap(spark, tmp_path):
    """The query cluster_cap keeps whole clusters of up to 1,000 rows, and the middle 1,000 rows of larger ones."""
    sizes = {1: 25, 2: 1_003}
    # all of a part's rows are alike but for their orders, and begin at one of ten places
    rows = [(1_000 * k + i, 10 * k, i % 10, 2, "A", "O", 20.0, 0.05, 0.04) for k, n in sizes.items() for i in range(n)]
    line = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_returnflag string, l_linestatus string, l_quantity double, l_discount double, l_tax double")
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["locus"]: (r["n"], r["begins"]) for r in registry.queries()["cluster_cap"](spark, str(tmp_path)).collect()}
    want = {}
    for k, n in sizes.items():
        begins = sorted(1_000 * k + i % 10 for i in range(n))
        skip = max(0, n // 2 - 500)
        want[1_000 * k] = (min(n, 1_000), sum(begins[skip : skip + 1_000]) if n > 1_000 else sum(begins))
    assert got == want


def test_filter_rules(spark):
    """The rules that stand before the tiers, each switched on for itself."""
    rows = [(i, "c", 1, *x) for i, x in enumerate([(1, 1, 0, 5.0), (2, 2, 0, 5.0), (9, 9, 0, 5.0), (9, 9, 0, 400.0), (9, 40, 31, 400.0)])]
    df = spark.createDataFrame(rows, "i long, contig string, sv_type long, ss long, st long, st2 long, sd_begin double")
    df = df.selectExpr("*", "100L as ls", "1.0d as co", "1.5d as weight", "true as inv_left", "true as inv_right")
    total = spark.createDataFrame([("c", 10.0, 10.0)], "contig string, contig_cov double, total_cov double")
    keep = lambda p: [r["keep"] for r in calls.filtered(df, total, p).orderBy("i").collect()]
    assert keep(ONT) == [False, True, True, True, True]
    assert keep(replace(ONT, no_filter=True)) == [True] * 5
    assert keep(replace(ONT, filter_2st=True)) == [False, True, True, True, True]
    assert keep(replace(ONT, min_pos_sd=(-1, 100, -1, -1))) == [False, True, True, False, True]
    assert keep(replace(ONT, weight_filter=True, base2=(0, 9, 0, 0), base1=(0, 9, 0, 0))) == [False, False, False, False, True]
    spread = {r["i"]: r["pstd"] for r in calls.filtered(df, total, ONT).collect()}
    assert spread == {0: -1.0, 1: 5.0, 2: 5.0, 3: 400.0, 4: -1.0}


def test_spelled_calls(spark):
    """A deletion at the very start, a spelled insertion, one without bases, and a call too long to spell."""
    rows = [(1, 0, 0, 4, None), (2, 1, 10, 3, "TTT"), (3, 1, 10, 3, None), (4, 0, 10, 2_000_000, None), (5, 2, 10, 5, None)]
    df = spark.createDataFrame([(k, "c", *r) for k, *r in rows], "k long, contig string, sv_type long, pos long, sv_len long, bases string")
    chunks = spark.createDataFrame([("c", 0, "ACGT" * 250)], "contig string, chunk long, seq string")
    got = {r["k"]: (r["vcf_pos"], r["vcf_end"], r["ref"], r["alt"]) for r in vcf.resolved(df, chunks, ["k"]).collect()}
    assert got == {1: (1, 5, "ACGTA", "A"), 2: (10, 10, "C", "CTTT"), 3: (10, 10, "C", "<INS>"), 4: (10, 2_000_010, "C", "<DEL>"), 5: (10, 15, "C", "<DUP>")}


def test_two_events_of_one_island_are_two_calls(spark):
    """Deletions of 60 and of 400 bases whose reads begin at alike places lie in one island and give two calls."""
    rows = [("c", 0, 0, 5000 + 40 * i, 5000 + 40 * i + n, n, f"{n}-{i}", 1.0, 0, False, False, 0, 0) for i in range(8) for n in (60, 400)]
    sig = spark.createDataFrame(rows, SCHEMA + ", inv_left boolean, inv_right boolean, cn long, contig_id long")
    assert clusters.with_islands(sig, ONT).select("island").distinct().count() == 1
    found = calls.measured(clusters.with_clusters(sig, ONT), ONT).collect()
    assert sorted((r["sv_len"], r["st"], r["ls"]) for r in found) == [(60, 8, 100), (400, 8, 100)]
    assert {r["locus"] for r in found} == {5000}


def test_running_values_cross_stretches(spark):
    rng = random.Random(1)
    rows = [("c", rng.randrange(5_000_000), rng.randrange(1000), i) for i in range(500)]
    df = spark.createDataFrame(rows, "contig string, p long, v long, i long")
    order = [F.col("p"), F.col("i")]
    out = intervals.running_max(df, ["contig"], "p", order, F.col("v"), "m")
    out = intervals.numbered(out, ["contig"], "p", order, "n").orderBy("n").collect()
    rows.sort(key=lambda r: (r[1], r[3]))
    best = 0
    for k, (r, o) in enumerate(zip(rows, out, strict=True)):
        best = max(best, r[2])
        assert (o["n"], o["i"], o["m"]) == (k, r[3], best)


def test_tail_agrees_with_fractions(spark):
    grid = [(n, k) for n in range(1, 61, 7) for k in range(n // 2 + 1)]
    df = spark.createDataFrame(grid, "n long, k long").withColumn("t", calls.tail(F.col("n"), F.col("k"), F.lit(0.015)))
    p = Fraction(15, 1000)
    for r in df.collect():
        exact = sum(comb(r["n"], i) * p**i * (1 - p) ** (r["n"] - i) for i in range(r["k"], r["n"]))
        assert abs(r["t"] - float(exact)) <= 1e-9
        assert (r["t"] < calls.TAIL) == (exact < Fraction(2, 100_000))


def segment(idx, contig, strand, pos, end):
    return {"idx": idx, "contig": contig, "strand": strand, "pos": pos, "ref_end": end, "quality": 1 - idx / 10}


def test_inversions_full_and_half():
    full = [segment(0, "c", 1, 0, 1000), segment(1, "c", 0, 1200, 2000), segment(2, "c", 1, 2100, 3000)]
    assert [(s["pos"], a, b, round(q, 6)) for s, a, b, q in splits.scan_inversions(full)] == [(1200, True, True, 0.9)]
    half = list(splits.scan_inversions(full[:2]))
    assert [(s["pos"], a, b, round(q, 6)) for s, a, b, q in half] == [(0, False, True, 0.95), (1200, True, False, 0.95)]


def test_alike_overlaps_are_copies():
    rows = [segment(i, "c", 1, 1000 + i % 2, 2000) for i in range(4)]
    assert [(d["start"], d["copies"]) for d in splits.fold_duplications(rows, 30)] == [(1000, 4)]


def test_omni_takes_the_best_linking():
    """Brute force over the stated score."""
    rng = random.Random(3)
    for _ in range(40):
        segs, at = [], 0
        for _ in range(rng.randrange(1, 5)):
            at += rng.randrange(10, 700)
            segs.append((at, at + rng.randrange(30, 90)))
            at = segs[-1][1]
        others = [[(b + rng.randrange(-40, 40), e + rng.randrange(-40, 40)) for b, e in segs] for _ in range(3)]

        def cuts(n):
            return [[]] if n == 0 else [c + [(i, n)] for i in range(n) for c in cuts(i)]

        def value(links):
            made, own = merge.linked(segs, links, ONT.omni_a[0])
            alike = sum(max(sum(merge.likeness(made, [merge.runs_of(o)[c]], ONT.omni_b[0]) for c in cut) for cut in cuts(len(o))) for o in others)
            return int(own + alike * ONT.omni_ratio)

        edges = merge.candidate_links(segs, ONT.merge_distance, ONT.omni_edges)
        all_links = [{e for k, e in enumerate(edges) if mask >> k & 1} for mask in range(1 << len(edges))]
        made = merge.omni(segs, others, 0, ONT)
        top = max(value(x) for x in all_links)
        assert made in [merge.linked(segs, x, ONT.omni_a[0])[0] for x in all_links if value(x) == top]


def test_greedy_rows_do_not_overlap(spark):
    rng = random.Random(5)
    rows = sorted({("c", s, s + rng.randrange(1, 400), i) for i, s in enumerate(rng.sample(range(10_000), 200))}, key=lambda r: (r[1], r[2], r[3]))
    got = sorted(r["k"] for r in truth.without_overlaps(spark.createDataFrame(rows, "contig string, b long, e long, k long"), "b", "e", "k").collect())
    want, last = [], None
    for _, b, e, k in rows:
        if last is None or b > last:
            want.append(k)
            last = e
    assert got == sorted(want)


def test_formats_round_trip(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n@RG\tID:1\tPL:ONT\tSM:me\nr1\t16\tchr1\t101\t60\t5M2D3M\t*\t0\t0\tACGTACGT\t*\tSA:Z:chr2,5,+,8M,60,0;\tHP:i:1\n")
    row = formats.read_sam(spark, str(tmp_path / "a.sam")).first()
    assert (row["qname"], row["pos"], row["tags"]["HP"]) == ("r1", 100, "1")
    group = [r["fields"] for r in formats.sam_header(spark, str(tmp_path / "a.sam")).collect() if r["kind"] == "RG"][0]
    assert group["PL"] == "ONT" and group["SM"] == "me"
    (tmp_path / "a.fa").write_text(">chr1 first\nACGT\nacg\n>chr2\nTTT\n")
    assert sorted(map(tuple, formats.fasta_chunks(spark, str(tmp_path / "a.fa"), 100).collect())) == [("chr1", 0, "ACGTACG"), ("chr2", 0, "TTT")]
    (tmp_path / "a.fa.fai").write_text("chr1\t7\t12\t4\t5\n")
    assert formats.read_fai(spark, str(tmp_path / "a.fa.fai")).first()["size"] == 7
    (tmp_path / "a.vcf").write_text("##x\n#CHROM\nchr1\t11\tid\tA\t<DEL>\t.\tPASS\tPRECISE;SVLEN=-40\tGT\t0/1\n")
    call = formats.read_vcf(spark, str(tmp_path / "a.vcf")).first()
    assert (call["pos"], call["info"]["SVLEN"], call["gt"]) == (10, "-40", "0/1")
    assert formats.sample_name(formats.sam_header(spark, str(tmp_path / "a.sam"))) == "me"


@pytest.mark.parametrize("seed", range(3))
def test_two_layers(spark, seed):
    """Both layers against the rules over everything, with the second one's range."""
    p = replace(ONT, near=(100, 50, 300, 100))
    sig = sorted_signatures(spark.createDataFrame(signatures(seed, 80), SCHEMA))
    got = {(r["sv_type"], r["sig_id"]): (r["cluster"], r["core"]) for r in layers.two_layers(sig, p).collect()}
    want = {}
    for t in range(4):
        rows = plain_adjacent([r.asDict() for r in sig.filter(F.col("sv_type") == t).orderBy("sig_id").collect()], p)
        want |= {(t, i): x for i, x in plain_layers(rows, p).items()}
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_adjacent_pieces(spark, seed):
    """Broken insertions of reads around whole ones: merged as the rule does it over everything, then clustered in two layers."""
    rng = random.Random(seed)
    rows = []
    for locus in (2_000, 4_000, 9_000, 40_000, 1_000_300):
        for k in range(5):
            at, size = locus + rng.randrange(-60, 60), rng.choice([240, 260, 300])
            rows.append((at, size, f"w{locus % 7}{k}", rng.randrange(3)))
        for k in range(rng.randrange(1, 5)):
            at = locus + rng.randrange(-50, 120)
            for piece in range(rng.randrange(2, 4)):
                rows.append((at, rng.choice([60, 80, 120, 140]), f"b{locus % 7}{k}", 0))
                at += rng.choice([0, 40, 210, 260, 480, 700])
        rows.append((locus + 3000, 35, rng.choice(["b20", "b21", "b40"]), 0))
    rows += [(rng.randrange(12_000), rng.choice([31, 90, 300]), f"b{rng.randrange(7)}{rng.randrange(4)}", 1) for _ in range(60)]
    rows = [("c", 1, 0, at, at + n, n, t, 1 - rng.randrange(5) / 10, hp, "".join(rng.choice("ACGT") for _ in range(n))) for at, n, t, hp in rows]
    rows += [(*r, "") for r in signatures(seed, 30) if r[1] != 1]
    p = replace(ONT, near=(100, 50, 300, 100))
    sig = sorted_signatures(spark.createDataFrame(rows, SCHEMA + ", ins_bases string"))
    got = {(r["sv_type"], r["sig_id"]): (r["begin_pos"], r["length"], r["template"], r["ins_bases"], r["cluster"], r["core"]) for r in layers.two_layers(sig, p).collect()}
    want, merged = {}, 0
    for t in range(4):
        before = [r.asDict() for r in sig.filter(F.col("sv_type") == t).orderBy("sig_id").collect()]
        after = plain_adjacent(before, p)
        merged += len(before) - len(after)
        named = plain_layers(after, p)
        want |= {(t, r["sig_id"]): (r["begin_pos"], r["length"], r["template"], r["ins_bases"], *named[r["sig_id"]]) for r in after}
    assert got == want and merged > 0


def test_best_fit_takes_the_least_lag():
    assert adjacent.best_fit([100, 150, 400], [100, 100, 100], 90, 300) == (1, 3, 200)  # the first piece's next one is too near
    assert adjacent.best_fit([100, 300, 600], [100, 100, 100], 90, 290) == (0, 2, 200)
    assert adjacent.best_fit([100, 100, 300], [50, 60, 100], 90, 250) == (0, 3, 150)  # what begins with the first doesn't count
    assert adjacent.best_fit([80, 300], [100, 100], 90, 290) is None  # begins before the event and ends before it


def test_custom_parameters():
    p = params.with_filter(ONT, 1, "1,*,50,2,0.5,*")
    assert (p.base1[1], p.multi1[1], p.score1[1], p.base2[1], p.multi2[1], p.base1[0]) == (1, ONT.multi1[1], 50, 2, 0.5, ONT.base1[0])
    with pytest.raises(ValueError, match="6 fields"):
        params.with_filter(ONT, 0, "1,2")
    p = params.with_cluster(ONT, 0, "60,*,5,0.4,100,20,0.3")
    assert (p.force[0], p.pos_ratio, p.length_min[0], p.length_ratio[0], p.near[0], p.force2[0], p.length_ratio2[0]) == (60, ONT.pos_ratio, 5, 0.4, 100, 20, 0.3)
    for text in ("70,*,5,0.4", "70,*,5,0.4,300"):
        q = params.with_cluster(p, 0, text)
        assert (q.force[0], q.near[0], q.force2[0]) == (70, -1, 20) and isinstance(q.force[0], int)


def test_presets():
    """The values that the presets must have, one by one."""
    fields = ("pos_ratio", "force", "length_ratio", "length_min", "near", "force2", "length_ratio2", "base1", "base2", "multi1", "multi2", "score1", "score2")
    same = ((-1, -1, -1, -1), (10, 50, 500, 100), (0.5, 0.3, 0.1, 0.5))
    want = {
        "ONT": ((1.5, 0.5, 0.2, 0.1), (50, 150, 0, 100), (0.3, 0.1, 0.1, 0.1), (10, 20, 0, 0), *same, (1, 1, 0, 2), (0, 0, 1, 1), (0.28, 0.19, 0.23, 0), (0.16, 0.14, 0.12, 0.18), (70, 60, 90, 98), (95, 90, 96, 0)),
        "CLR": ((1.5, 1.2, 0.2, 0.1), (50, 10, 0, 100), (0.3, 0.3, 0.1, 0.1), (60, 0, 0, 0), *same, (1, 2, 4, 2), (0, 0, 0, 1), (0.13, 0.12, 0.13, 0), (0.12, 0.5, 0.1, 0.18), (65, 50, 85, 98), (95, 95, 99, 0)),
        "CCS": ((2.0, 2.5, 0.2, 0.1), (100, 200, 0, 100), (0.5, 0.5, 0.1, 0.1), (10, 50, 0, 0), *same, (0, 0, 4, 2), (0, 0, 0, 1), (0.31, 0.33, 0.13, 0), (0.1, 0.13, 0.1, 0.18), (55, 55, 85, 98), (95, 95, 99, 0)),
    }
    for name, values in want.items():
        for field, value in zip(fields, values, strict=True):
            assert getattr(getattr(params, name), field) == value, (name, field)


def test_record_shapes(spark):
    """Matches, one skip at most, clips behind the matches only, as the read runs; for a reverse read from the right."""
    plain = {"100M": (True, True), "90M10S": (True, False), "10S90M": (False, True), "40M50N60M": (True, True), "10M5N10M5N10M": (False, False), "50M2I50M": (False, False), "50=1X49=": (True, True), "5H95M": (False, False), "100S": (False, False)}
    df = spark.createDataFrame([(c, r) for c in plain for r in (False, True)], "cigar string, reverse boolean")
    got = {(r["cigar"], r["reverse"]): r["ok"] for r in df.withColumn("ok", reads.plain_shape(reads.cigar_ops(F.col("cigar")), F.col("reverse"))).collect()}
    assert got == {(c, r): ok[r] for c, ok in plain.items() for r in (False, True)}


def test_records_of_a_file(spark, tmp_path):
    """A SAM file with one record for each branch, and its header's platform."""
    line = lambda *f: "\t".join(map(str, f))
    seq = "ACGT" * 300
    (tmp_path / "a.sam").write_text("\n".join([
        "@HD\tVN:1.6", "@SQ\tSN:c\tLN:100000", "@RG\tID:1\tPL:ONT\tSM:me",
        line("indel", 0, "c", 101, 60, "500M40D500M50I50M", "*", 0, 0, seq[:1100], "*", "AS:i:550", "HP:i:2"),
        line("low", 0, "c", 101, 10, "500M40D500M", "*", 0, 0, seq[:1000], "*"),
        line("split", 0, "c", 1001, 60, "600M400S", "*", 0, 0, seq[:1000], "*", "SA:Z:c,2500,+,600S400M,60,40;", "NM:i:0", "HP:i:1"),
    ]) + "\n")
    rows = records.scan([formats.read_sam(spark, str(tmp_path / "a.sam"))])
    platforms = spark.createDataFrame([(0, formats.platform(formats.sam_header(spark, str(tmp_path / "a.sam"))))], "source_id long, platform string")
    tech = records.technologies(records.prepared(rows), platforms)
    sizes = spark.createDataFrame([("c", 100_000)], "contig string, size long")
    moments = spark.createDataFrame([(300.0, 10.0)], "mean double, sd double")
    got = {(r["template"], r["sv_type"]): r for r in records.signatures(rows, tech, sizes, ONT, moments).collect()}
    assert set(got) == {("indel", 0), ("indel", 1), ("split", 0)}
    gone, more, split = got["indel", 0], got["indel", 1], got["split", 0]
    assert (gone["begin_pos"], gone["end_pos"], gone["hp"], gone["quality"]) == (600, 640, 2, 550 / 1100)
    assert (more["begin_pos"], more["length"], more["ins_bases"]) == (1140, 50, seq[1000:1050])
    assert (split["begin_pos"], split["end_pos"], split["hp"], round(split["quality"], 6)) == (1600, 2500, 1, 0.95)
    read = records.prepared(rows).withColumn("tech", F.lit(0))
    cover = sorted(tuple(r) for r in records.covering(read, sizes, ONT).collect())
    assert cover == [("c", 100, 1190), ("c", 1000, 1600), ("c", 2500, 2900)]


@pytest.mark.parametrize("how", [None, "simple", "regional", "omni"])
def test_repeated_records_count_each(spark, how):
    """n copies of a record give n times its signatures, by every branch and every merge."""
    seq = "ACGT" * 600
    one = [
        ("indel", 0, "c", 100, 60, "400M60D400M50I300M", "*", -1, 0, {"AS": "900", "HP": "1"}),
        ("split", 0, "c", 1000, 60, "600M400S", "*", -1, 0, {"SA": "c,2501,+,600S400M,60,40;", "NM": "0"}),
        ("dup", 0, "c", 9000, 60, "600M400S", "*", -1, 0, {"SA": "c,9201,+,600S400M,60,0;", "NM": "0"}),
    ]
    rows = [(*r[:6], r[6], r[7], r[8], seq, r[9]) for r in one]
    schema = "qname string, flag long, contig string, pos long, mapq long, cigar string, mate_contig string, mate_pos long, isize long, seq string, tags map<string,string>"
    sizes = spark.createDataFrame([("c", 100_000)], "contig string, size long")
    tech = spark.createDataFrame([(0, 0)], "source_id long, tech long")
    moments = spark.createDataFrame([(300.0, 10.0)], "mean double, sd double")

    def found(copies):
        df = records.scan([spark.createDataFrame(rows * copies, schema)])
        out = {}
        for r in records.signatures(df, tech, sizes, ONT, moments, how).collect():
            out[tuple(r)] = out.get(tuple(r), 0) + 1
        return out

    single = found(1)
    assert len(single) >= 4 and set(single.values()) == {1}
    assert found(3) == {k: 3 for k in single}


def test_each_source_has_its_own_library(spark):
    """Pairs of 300 and of 600 bases in one call set: what is wide for the one is usual for the other."""
    rows = []
    for source, size in ((0, 300), (1, 600)):
        for k in range(400):
            gap = size + k % 7 - 3 + (900 if k == 50 else 0)
            rows += [(f"p{source}{k}", 99, "c", 1000 * k, 60, "100M", "=", 1000 * k + gap - 100, gap, None, {}, source), (f"p{source}{k}", 147, "c", 1000 * k + gap - 100, 60, "100M", "=", 1000 * k, -gap, None, {}, source)]
    df = spark.createDataFrame(rows, "qname string, flag long, contig string, pos long, mapq long, cigar string, mate_contig string, mate_pos long, isize long, seq string, tags map<string,string>, source_id long")
    tech = spark.createDataFrame([(0, 1), (1, 1)], "source_id long, tech long")
    sizes = spark.createDataFrame([("c", 1_000_000)], "contig string, size long")
    one = library.moments(library.library_reads(records.prepared(df)), ["source_id"]).collect()
    assert {r["source_id"]: round(r["mean"] / 10) for r in one} == {0: 30, 1: 60}
    got = {(r["template"], r["sv_type"], r["length"]) for r in records.signatures(df, tech, sizes, ONT).collect()}
    assert {t for t, _, _ in got} == {"p050", "p150"} and all(abs(n - 900) < 10 and kind == 0 for _, kind, n in got)


def test_coverage_by_differences(spark):
    """Border shares and running steps against a count window by window, over stretches, in one window, and next to each other."""
    rng = random.Random(8)
    rows = [("c", a, a + rng.choice([0, 30, 99, 100, 101, 250, 40_000])) for a in (rng.randrange(5_000) for _ in range(80))]
    rows += [("c", 999_950, 1_000_010), ("c", 900_000, 2_100_050), ("c", 2_000_000, 2_000_000), ("d", 7, 8)]
    want = {}
    for contig, lo, hi in rows:
        for w in range(lo // 100, hi // 100 + 1):
            share = (lo // 100 + 1) * 100 - lo if w == lo // 100 else hi + 1 - w * 100 if w == hi // 100 else 100
            want[contig, w] = want.get((contig, w), 0) + share
    got = {(r["contig"], r["w"]): round(100 * r["cov"]) for r in coverage.windowed(spark.createDataFrame(rows, "contig string, pos long, ref_end long"), ONT).collect()}
    assert got == want


def plain_omni(segs, others, t, p):
    """(begin, length, first, parts) of the best linking, by every linking of the read and every cut of every other read."""
    n = len(segs)
    gaps = sorted((segs[i + 1][0] - segs[i][1], i) for i in range(n - 1))
    edges = [i for gap, i in gaps if gap < p.merge_distance][: p.omni_edges]

    def runs(s, links):
        out = []
        for i, (b, e) in enumerate(s):
            if i - 1 in links:
                out[-1] = (out[-1][0], out[-1][1] + e - b)
            else:
                out.append((b, b + e - b))
        return out

    def near(own, other):
        r, total = p.omni_b[t], 0
        for b1, e1 in own:
            for b2, e2 in other:
                apart = abs((e1 - b1) - (e2 - b2))
                if b2 <= b1 + r and abs(b1 - b2) + abs(e1 - e2) <= r and apart <= r:
                    total += r - apart
        return total

    best = None
    for choice in itertools.product((False, True), repeat=len(edges)):
        links = {e for e, c in zip(edges, choice) if c}
        cost = 0
        for i in sorted(links):
            cost = max(0, cost + segs[i + 1][0] - segs[i][1])
        alike = 0
        for other in others:
            ways = itertools.product((False, True), repeat=len(other) - 1)
            alike += max(near(runs(segs, links), runs(other, {i for i, c in enumerate(w) if c})) for w in ways)
        score = int(p.omni_a[t] * len(links) - cost + alike * p.omni_ratio)
        if best is None or score > best[0]:
            best = (score, links)
    out, first = [], 0
    for b, e in runs(segs, best[1]):
        last = first
        while last in best[1]:
            last += 1
        out.append((b, e - b, first, last - first + 1))
        first = last + 1
    return out


def test_omni_merge_of_a_whole_table(spark):
    """Signatures of many reads with broken events, by their ranges and samples, with haplotypes, qualities and bases."""
    rng = random.Random(12)
    rows = []
    for k in range(70):
        pos, cigar, size = rng.randrange(0, 4_000), f"{rng.randrange(200, 700)}M", 0
        for _ in range(rng.randrange(1, 5)):
            cigar += f"{rng.choice([35, 40, 60, 90])}{rng.choice('DDI')}{rng.choice([20, 80, 300, 900])}M"
        size = sum(int(n) for n, o in re.findall(r"(\d+)([MI])", cigar))
        rows.append((f"r{k}", 0, "c" if k % 9 else "d", pos, 60, cigar, "*", -1, 0, "".join(rng.choice("ACGT") for _ in range(size)), {"HP": str(k % 3), "AS": str(size - k)}))
    schema = "qname string, flag long, contig string, pos long, mapq long, cigar string, mate_contig string, mate_pos long, isize long, seq string, tags map<string,string>"
    df = records.prepared(records.scan([spark.createDataFrame(rows, schema)])).withColumn("tech", F.lit(0))
    reads = {r["qname"]: r for r in records.cigar_reads(df, ONT).collect()}
    want, linked = [], 0
    for contig in "cd":
        some = [r for r in reads.values() if r["contig"] == contig]
        of = lambda r, name: [(s["begin"], s["begin"] + s["length"]) for s in r[name]]
        some = sorted(some, key=lambda r: (min((b for b, _ in of(r, "gone")[:1]), default=-1), r["read_id"]))
        starts = [of(r, "gone")[0][0] if r["gone"] else -1 for r in some]
        ends, top = [], -1
        for r in some:
            top = max([top, *(e for _, e in of(r, "gone"))])
            ends.append(top)
        for i, r in enumerate(some):
            begin = min(b for b, _ in of(r, "gone") + of(r, "more"))
            first, after = sum(e <= begin for e in ends), sum(s <= begin for s in starts)
            for t, name in enumerate(("gone", "more")):
                segs = of(r, name)
                if not segs:
                    continue
                step = max(1, (after - first) // ONT.omni_relevant)
                others = [of(some[j], name) for j in range(first, after, step) if j != i and some[j][name]][: ONT.omni_relevant + 1]
                found = plain_omni(segs, others, t, ONT)
                linked += len(segs) - len(found)
                for b, n, f, parts in found:
                    bases = "".join(s["bases"] for s in r[name][f : f + parts]) if t else None
                    want.append((contig, t, b, b + n, n, r["qname"], round(r["quality"], 9), r["hp"], bases))
    got = [(r["contig"], r["sv_type"], r["begin_pos"], r["end_pos"], r["length"], r["template"], round(r["quality"], 9), r["hp"], r["ins_bases"]) for r in records.merged(df, ONT, "omni").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and linked > 20


def test_sample_grows_until_it_settles(spark):
    """Sizes that hardly differ settle in a part, many different ones in none."""
    one = spark.range(20_000).select(F.col("id").alias("pair_id"), F.lit(300).alias("isize"))
    some = library.sampled(one, "pair_id")
    assert 0 < some.count() < 20_000 and library.moments(some).first()["mean"] == 300
    many = spark.range(500).select(F.col("id").alias("pair_id"), (F.col("id") * 37).alias("isize"))
    assert library.sampled(many, "pair_id").count() == 500 and library.sampled(many.limit(0), "pair_id").count() == 0


@pytest.mark.parametrize("block", ["1m", "64"])
def test_fasta_chunks(spark, tmp_path, block):
    """Chunks of a reference whose lines are read in any blocks."""
    rng = random.Random(5)
    contigs = {f"chr{i}": "".join(rng.choices("ACGTacgtN", k=n)) for i, n in enumerate((0, 7, 95, 250))}
    text = "".join(f">{c} some words\n" + "".join(s[i : i + 30] + "\n" for i in range(0, len(s), 30)) for c, s in contigs.items())
    (tmp_path / "a.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        got = {(r["contig"], r["chunk"]): r["seq"] for r in formats.fasta_chunks(spark, str(tmp_path / "a.fa"), 40).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(c, i // 40): s[i : i + 40].upper() for c, s in contigs.items() for i in range(0, len(s), 40)}
