"""Components and dense islands, matching with a truth set, one VCF file, and the store that calls start from."""

import gzip
import random

import pytest
from pyspark.sql import functions as F
from test_operators import SCHEMA, plainly_clustered, signatures

from varloom.operators import benchmark, clusters, graph, store, truth
from varloom.operators.signatures import sorted_signatures
from varloom.params import ONT
from varloom.sources import vcf_file


def test_components(spark, tmp_path):
    """Chains, stars and rings, under equal numbers of two keys, against union by hand."""
    rng = random.Random(2)
    edges = [("x", k, k + 1) for k in range(60)] + [("y", 100, k) for k in range(40, 70)] + [("x", a, b) for a, b in ((200, 300), (300, 250), (250, 200))]
    edges += [(rng.choice("xy"), rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    label = {(c, n): n for c, a, b in edges for n in (a, b)}
    again = True
    while again:
        again = False
        for c, a, b in edges:
            least = min(label[c, a], label[c, b])
            again |= label[c, a] != least or label[c, b] != least
            label[c, a] = label[c, b] = least
    df = spark.createDataFrame(edges, "k string, a long, b long")
    got = {(r["k"], r["node"]): r["component"] for r in graph.components(df, ["k"], f"file://{tmp_path}/c").collect()}
    assert got == label


@pytest.mark.parametrize("seed", [0, 5])
def test_dense_islands_are_dealt_out(spark, monkeypatch, seed):
    """Islands above the size go by components of brothers, with the same clusters, and into several groups."""
    monkeypatch.setattr(clusters, "DENSE", 8)
    sig = sorted_signatures(spark.createDataFrame(signatures(seed, 90), SCHEMA))
    groups = clusters.in_groups(sig, ONT).groupBy("sv_type", "island").agg(F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("n")).collect()
    assert any(r["n"] > 8 and r["parts"] > 2 for r in groups) and all(r["parts"] == 1 for r in groups if r["n"] <= 8)
    got = {(r["sv_type"], r["sig_id"]): r["cluster"] for r in clusters.exact_clusters(sig, ONT).collect()}
    assert got == plainly_clustered(sig, ONT)


def test_rows_are_placed_in_one_shuffle(spark):
    """Numbers and islands over borders of stretches are those of the steps one by one; columns that a query doesn't ask for stay behind."""
    rng = random.Random(5)
    rows = [(c, t, b, b + n, n, rng.random(), f"r{rng.randrange(90)}", rng.randrange(3), "A" * 50, 0) for c in "xy" for t in range(4)
            for b, n in ((rng.choice((999_000, 1_999_500, 5_000_000)) + rng.randrange(1500), rng.choice((40, 400, 1_200_000))) for _ in range(60))]
    sig = spark.createDataFrame(rows, "contig string, sv_type long, begin_pos long, end_pos long, length long, quality double, template string, hp long, ins_bases string, tech int")
    want = clusters.with_islands(sorted_signatures(sig), ONT).drop("repeated")
    got = clusters.placed(sig, ONT).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    largest = want.groupBy("contig", "sv_type", "island").count().agg({"count": "max"}).first()[0]
    assert clusters.most_rows(sig, ONT) >= largest
    assert not {"ins_bases", "quality"} & set(clusters.with_clusters(sig, ONT, "length").columns)


def test_matches_are_one_to_one(spark):
    """Crossing candidates, ties, regions' borders, other types and contigs, against all pairs sorted by hand."""
    rng = random.Random(6)
    place = lambda: (rng.choice("cd"), rng.randrange(3), rng.randrange(0, 9_000, 25), rng.choice([50, 60, 70, 400]))
    truth = [(k, *place()) for k in range(150)]
    calls = [(k, *place()) for k in range(170)]
    regions = [("c", 100, 4_000), ("c", 3_900, 8_000), ("d", 0, 2_000), ("d", 5_000, 9_500)]
    schema = "contig string, sv_type long, pos long, sv_len long"
    confident = spark.createDataFrame(regions, "contig string, begin_pos long, end_pos long")
    within = lambda r: any(r[1] == c and lo <= r[3] and r[3] + (0 if r[2] == 1 else r[4]) <= hi for c, lo, hi in regions)
    t = benchmark.inside(spark.createDataFrame(truth, f"truth_id long, {schema}"), confident, "truth_id")
    c = benchmark.inside(spark.createDataFrame(calls, f"call_id long, {schema}"), confident, "call_id")
    some_truth, some_calls = [r for r in truth if within(r)], [r for r in calls if within(r)]
    pairs = sorted((abs(a[3] - b[3]), abs(a[4] - b[4]), a[0], b[0]) for a in some_truth for b in some_calls if a[1:3] == b[1:3] and abs(a[3] - b[3]) <= 500 and min(a[4], b[4]) >= 0.7 * max(a[4], b[4]))
    left, right = {}, set()
    for apart, _, a, b in pairs:
        if a not in left and b not in right:
            left[a] = (b, apart)
            right.add(b)
    found = benchmark.assigned(t, c)
    rows = found.collect()
    assert {r["truth_id"]: (r["call_id"], r["apart"]) for r in rows if r["truth_id"] is not None} == {a[0]: left.get(a[0], (None, None)) for a in some_truth}
    assert sorted(r["call_id"] for r in rows if r["truth_id"] is None) == sorted(b[0] for b in some_calls if b[0] not in right)
    assert len(left) < len({a for _, _, a, _ in pairs})  # some lose their candidate to another
    for r in benchmark.scores(found).collect():
        tp = sum(1 for a in some_truth if a[2] == r["sv_type"] and a[0] in left)
        fn, fp = sum(a[2] == r["sv_type"] for a in some_truth) - tp, sum(b[2] == r["sv_type"] for b in some_calls) - tp
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn)
        assert (r["precision"], r["recall"], r["f1"]) == (tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn))


def test_one_vcf_file(spark, tmp_path):
    """The file reads back in order, and a region by its index alone."""
    rng = random.Random(3)
    rows = []
    for k in range(5_000):
        contig, pos, size = rng.randrange(3), rng.randrange(1, 3_000_000), rng.choice([1, 60, 40_000])
        rows.append((contig, f"chr{contig}", pos, pos + size, f"id{k}", f"chr{contig}\t{pos}\tid{k}\tN\t<DEL>\t.\tPASS\tEND={pos + size};X={'x' * rng.randrange(60)}\tGT\t0/1"))
    calls = spark.createDataFrame(rows, "contig_id long, contig string, vcf_pos long, vcf_end long, id string, line string").repartition(7)
    head = spark.createDataFrame([(1, "#CHROM\tPOS"), (0, "##fileformat=VCFv4.2")], "n long, line string")
    path = str(tmp_path / "calls.vcf.gz")
    done = vcf_file.write_vcf(head, calls, path).first()
    want = [r[5] for r in sorted(rows, key=lambda r: (r[0], r[2], r[4]))]
    assert gzip.open(path, "rt").read().splitlines() == ["##fileformat=VCFv4.2", "#CHROM\tPOS", *want]
    assert done["bytes"] == (tmp_path / "calls.vcf.gz").stat().st_size and gzip.open(path + ".tbi").read(4) == b"TBI\1"
    for contig, lo, hi in (("chr1", 0, 5_000), ("chr2", 1_000_000, 1_000_400), ("chr0", 2_999_000, 3_000_001)):
        got = [r["value"] for r in vcf_file.read_region(spark, path, contig, lo, hi).collect()]
        over = [r[5] for r in rows if r[1] == contig and r[2] - 1 < hi and max(r[3], r[2]) > lo]
        assert set(over) <= set(got) and len(got) == len(set(got)) < 2_000
    assert vcf_file.read_region(spark, path, "none", 0, 5).count() == 0
    empty = str(tmp_path / "empty.vcf.gz")
    vcf_file.write_vcf(head, calls.limit(0), empty)
    assert gzip.open(empty, "rt").read().splitlines() == ["##fileformat=VCFv4.2", "#CHROM\tPOS"]


def test_a_store_is_tied_to_its_parameters(spark, tmp_path):
    from dataclasses import replace

    path = f"file://{tmp_path}/store"
    windows = spark.createDataFrame([(c, w, 1.0 * w) for c in "abc" for w in range(5)], "contig string, w long, cov double")
    segments = spark.createDataFrame([(c, k, k + 9) for c in "abc" for k in range(4)], "contig string, begin_pos long, end_pos long")
    sig = spark.createDataFrame([r for r in signatures(1, 50)], SCHEMA)
    store.save(path, ONT, windows, segments, sig, sources="x.bam")
    held = store.load(spark, path, ONT, sources="x.bam")
    for name, table in zip(store.TABLES, (windows, segments, sig), strict=True):
        assert sorted(map(str, held[name].select(table.columns).collect())) == sorted(map(str, table.collect()))
    direct = clusters.exact_clusters(sorted_signatures(sig), ONT)
    again = clusters.exact_clusters(sorted_signatures(held["signatures"]), ONT)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, direct.collect()))
    some = store.load(spark, path, replace(ONT, base1=(9, 9, 9, 9)), ["a", "c"], sources="x.bam")["windows"]
    assert {r["contig"] for r in some.collect()} == {"a", "c"} and len(some.inputFiles()) >= 1
    assert "PartitionFilters: [contig" in some._jdf.queryExecution().toString()
    for p, more in ((replace(ONT, min_mapq=30), {"sources": "x.bam"}), (ONT, {}), (ONT, {"sources": "y.bam"})):
        with pytest.raises(ValueError, match="other parameters"):
            store.load(spark, path, p, **more)


def test_haplotypes_unite(spark):
    """Rows of one or of both haplotypes, repeated ones too, and an empty haplotype."""
    rows = lambda ids: spark.createDataFrame([("c", 10 * i, i) for i in ids], "contig string, pos long, truth_id long")
    got = {r["truth_id"]: r["gt"] for r in truth.united([rows([1, 2, 2]), rows([2, 3, 3])]).collect()}
    assert got == {1: "1|0", 2: "1|1", 3: "0|1"}
    assert [r["gt"] for r in truth.united([rows([]), rows([5])]).collect()] == ["0|1"]
    assert truth.united([rows([]), rows([])]).count() == 0
