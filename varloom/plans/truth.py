"""Queries over truth sets, merges inside reads, and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder
from varloom.operators import benchmark as B
from varloom.operators import clusters as C
from varloom.operators import merge as M
from varloom.operators import signatures as S
from varloom.operators import truth as T
from varloom.params import ONT
from varloom.plans.reads import ADMITTED, OFFSETS
from varloom.plans.registry import query
from varloom.sources import formats

SITES = "SELECT contig, sv_type, begin_pos - begin_pos % 1000 AS locus, CAST(sum(begin_pos) // count(*) AS BIGINT) AS c_pos, CAST(sum(length) // count(*) AS BIGINT) AS c_len FROM sig GROUP BY ALL"


@query("truth", "sig", sql="""SELECT truth_id, locus, abs(pos - c_pos) AS apart FROM truth t JOIN sites s ON s.contig = t.contig AND s.sv_type = t.sv_type AND abs(pos - c_pos) <= 500
 AND least(sv_len, c_len) >= 0.7 * greatest(sv_len, c_len) QUALIFY row_number() OVER (PARTITION BY truth_id ORDER BY abs(pos - c_pos), abs(sv_len - c_len), locus) = 1""", sites=SITES)
def truth_match(truth: DataFrame, sig: DataFrame) -> DataFrame:
    return T.best_matches(truth, C.with_clusters(sig, ONT).groupBy(*C.CLUSTER).agg(*C.site()))


#: Confident regions: the first 15,000 bases of every 20,000 in which a signature begins.
CONFIDENT = "SELECT DISTINCT contig, begin_pos - begin_pos % 20000 AS r FROM sig"
SURE_TRUTH = "SELECT t.* FROM truth t JOIN confident c ON c.contig = t.contig AND c.r = pos - pos % 20000 WHERE pos + CASE WHEN sv_type = 1 THEN 0 ELSE sv_len END <= r + 15000"
SURE_CALLS = "SELECT s.* FROM sites s JOIN confident c ON c.contig = s.contig AND c.r = c_pos - c_pos % 20000 WHERE c_pos + CASE WHEN sv_type = 1 THEN 0 ELSE c_len END <= r + 15000"
PAIRED = """SELECT t.contig, t.sv_type, truth_id, locus, row_number() OVER (PARTITION BY t.contig, t.sv_type ORDER BY abs(pos - c_pos), abs(sv_len - c_len), truth_id, locus) AS k
FROM sure_truth t JOIN sure_calls s ON s.contig = t.contig AND s.sv_type = t.sv_type AND abs(pos - c_pos) <= 500 AND least(sv_len, c_len) >= 0.7 * greatest(sv_len, c_len)"""
TAKEN = """SELECT contig, sv_type, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ts, CAST([] AS BIGINT[]) AS cs FROM (SELECT DISTINCT contig, sv_type FROM paired)
UNION ALL SELECT contig, sv_type, k, CASE WHEN free THEN list_append(ts, truth_id) ELSE ts END, CASE WHEN free THEN list_append(cs, locus) ELSE cs END
FROM (SELECT x.contig, x.sv_type, p.k, ts, cs, p.truth_id, p.locus, NOT list_contains(ts, p.truth_id) AND NOT list_contains(cs, p.locus) AS free FROM taken x JOIN paired p ON p.contig = x.contig AND p.sv_type = x.sv_type AND p.k = x.k + 1)"""


@query("truth", "sig", sql="""SELECT sv_type, tp, calls - tp AS fp, truths - tp AS fn, round(tp / calls, 6) AS precision, round(tp / truths, 6) AS recall, round(2 * tp / (calls + truths), 6) AS f1 FROM (
 SELECT t.sv_type, truths, calls, CAST(coalesce(tp, 0) AS BIGINT) AS tp FROM (SELECT sv_type, count(*) AS truths FROM sure_truth GROUP BY sv_type) t JOIN (SELECT sv_type, count(*) AS calls FROM sure_calls GROUP BY sv_type) c ON c.sv_type = t.sv_type
 LEFT JOIN (SELECT sv_type, sum(n) AS tp FROM (SELECT contig, sv_type, max(len(ts)) AS n FROM taken GROUP BY contig, sv_type) GROUP BY sv_type) m ON m.sv_type = t.sv_type)""",
 sites=SITES, confident=CONFIDENT, sure_truth=SURE_TRUTH, sure_calls=SURE_CALLS, paired=PAIRED, taken=TAKEN)
def truth_bench(truth: DataFrame, sig: DataFrame) -> DataFrame:
    """Calls against the truth: one-to-one inside confident regions, with precision, recall and F1."""
    folder = shared_folder(sig.sparkSession)
    begin = F.col("begin_pos") - F.col("begin_pos") % 20_000
    regions = sig.select("contig", begin.alias("begin_pos"), (begin + 15_000).alias("end_pos")).distinct()
    sites = C.with_clusters(sig, ONT).groupBy(*C.CLUSTER).agg(*C.site())
    sites = materialize(sites.withColumn("call_id", F.xxhash64(*C.CLUSTER)), folder, "sites")
    # of equal candidates the cluster that comes first wins
    kept = B.inside(sites, regions, "call_id").withColumn("call_id", F.col("cluster"))
    found = B.assigned(B.inside(truth, regions, "truth_id"), kept)
    share = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return B.scores(found).select("sv_type", "tp", "fp", "fn", *share)


@query("truth", sql="SELECT truth_id, contig, sv_type, pos FROM truth WHERE sv_type NOT IN (2, 3)")
def type_exclude(truth: DataFrame) -> DataFrame:
    return truth.filter(~F.col("sv_type").isin(2, 3)).select("truth_id", "contig", "sv_type", "pos")


@query("truth", sql="""SELECT contig, pos, 'A' AS ref, 'C' AS alt, CASE WHEN truth_id % 3 = 0 THEN '0|0' ELSE gt END AS gt FROM truth WHERE truth_id % 5 <> 0 AND truth_id % 3 <> 0 ORDER BY contig, pos""")
def snp_view(truth: DataFrame) -> DataFrame:
    rows = truth.select("contig", "pos", F.lit("A").alias("ref"), F.when(F.col("truth_id") % 5 == 0, "C,T").otherwise("C").alias("alt"), F.when(F.col("truth_id") % 3 == 0, "0|0").otherwise(F.col("gt")).alias("gt"))
    return T.single_variants([rows.filter(F.col("contig") == c) for c in ("A", "N", "R")])


@query("truth", sql="SELECT truth_id, CASE gt WHEN '1|1' THEN '1/1' WHEN '0|0' THEN '0/0' ELSE '0/1' END AS gt FROM truth")
def unphase(truth: DataFrame) -> DataFrame:
    return truth.select("truth_id", T.unphased(F.col("gt")).alias("gt"))


@query("truth", sql="""SELECT concat_ws(chr(9), contig, CAST(pos + 1 AS VARCHAR), 'truth.' || truth_id, 'N', '<' || kind || '>', '.', 'PASS',
 'SVTYPE=' || kind || ';END=' || (pos + sv_len) || ';SVLEN=' || (CASE WHEN sv_type = 0 THEN -sv_len ELSE sv_len END), 'GT', CASE gt WHEN '1|1' THEN '1/1' ELSE '0/1' END) AS line
FROM (SELECT *, ['DEL', 'INS', 'DUP', 'INV'][sv_type + 1] AS kind FROM truth)""")
def truth_vcf(truth: DataFrame) -> DataFrame:
    folder = shared_folder(truth.sparkSession)
    formats.write_lines(truth.select(T.truth_line().alias("line")), f"{folder}/truth.vcf")
    return truth.sparkSession.read.text(f"{folder}/truth.vcf").withColumnRenamed("value", "line")


@query("truth", "contigs", sql="""SELECT truth_id, contig, place - start AS pos FROM (SELECT truth_id, truth_id * 37 % (SELECT CAST(sum(size) AS BIGINT) FROM contigs) AS place FROM truth) p
JOIN (SELECT contig, CAST(sum(size) OVER (ORDER BY contig_id) - size AS BIGINT) AS start, size FROM contigs) c ON place >= start AND place < start + size""")
def genome_to_contig(truth: DataFrame, contigs: DataFrame) -> DataFrame:
    total = F.broadcast(contigs.agg(F.sum("size").alias("total")))
    places = truth.select("truth_id").crossJoin(total).select("truth_id", (F.col("truth_id") * 37 % F.col("total")).alias("place"))
    return T.to_contigs(places, contigs, "place").select("truth_id", "contig", "pos")


@query("truth", sql="""SELECT truth_id, round(p, 6) AS p, CASE WHEN (truth_id * 7919) % 1000 < 1000 * p THEN '1|1' WHEN truth_id % 2 = 0 THEN '0|1' ELSE '1|0' END AS gt
FROM (SELECT truth_id, af * af / (1 - (1 - af) * (1 - af)) AS p FROM (SELECT truth_id, (truth_id % 10 + 1) / CAST(11 AS DOUBLE) AS af FROM truth))""")
def hap_assign(truth: DataFrame) -> DataFrame:
    p = T.both_chance((F.col("truth_id") % 10 + 1) / F.lit(11.0))
    gt = F.when((F.col("truth_id") * 7919) % 1000 < 1000 * p, "1|1").when(F.col("truth_id") % 2 == 0, "0|1").otherwise("1|0")
    return truth.select("truth_id", F.round(p, 6).alias("p"), gt.alias("gt"))


@query("truth", sql="SELECT contig, max(sv_len) AS longest, min(truth_id) FILTER (WHERE sv_len = m) AS truth_id FROM (SELECT *, max(sv_len) OVER (PARTITION BY contig) AS m FROM truth) GROUP BY contig")
def max_dims(truth: DataFrame) -> DataFrame:
    return truth.groupBy("contig").agg(F.max("sv_len").alias("longest"), F.max_by("truth_id", F.struct("sv_len", -F.col("truth_id"))).alias("truth_id"))


@query("truth", sql="SELECT contig, pos - 1 AS begin_pos, pos AS end_pos, 'SNP' AS kind FROM truth WHERE gt LIKE '1|%'")
def snp_hap_bed(truth: DataFrame) -> DataFrame:
    return truth.filter(F.col("gt").rlike(r"^1\|")).select("contig", (F.col("pos") - 1).alias("begin_pos"), F.col("pos").alias("end_pos"), F.lit("SNP").alias("kind"))


@query("truth", sql="SELECT contig, pos AS begin_pos, pos + sv_len AS end_pos, truth_id FROM truth")
def bed_scan(truth: DataFrame) -> DataFrame:
    folder = shared_folder(truth.sparkSession)
    formats.write_bed(truth.select("contig", "pos", F.col("pos") + F.col("sv_len"), "truth_id"), f"{folder}/truth.bed")
    return formats.read_bed(truth.sparkSession, f"{folder}/truth.bed", "truth_id long")


PLACED = "SELECT *, pos + sv_len AS end_pos, row_number() OVER (PARTITION BY contig ORDER BY pos, pos + sv_len, truth_id) AS r FROM truth"
GREEDY = """SELECT contig, pos, end_pos, truth_id, r, end_pos AS last, true AS stays FROM placed WHERE r = 1
UNION ALL SELECT p.contig, p.pos, p.end_pos, p.truth_id, p.r, CASE WHEN p.pos > g.last THEN p.end_pos ELSE g.last END, p.pos > g.last FROM greedy g JOIN placed p ON p.contig = g.contig AND p.r = g.r + 1"""


@query("truth", sql="SELECT contig, pos, end_pos, truth_id FROM greedy WHERE stays", placed=PLACED, greedy=GREEDY)
def sim_deoverlap(truth: DataFrame) -> DataFrame:
    return T.without_overlaps(truth.withColumn("end_pos", F.col("pos") + F.col("sv_len")), "pos", "end_pos", "truth_id")


@query("truth", sql="""SELECT contig, pos, end_pos, truth_id, (truth_id % 3 <> 1)::INT || '|' || (truth_id % 3 <> 2)::INT AS gt FROM greedy WHERE stays""", placed=PLACED, greedy=GREEDY)
def hap_union(truth: DataFrame) -> DataFrame:
    """Two simulated haplotypes as one set without overlaps, with the genotypes that follow."""
    rows = truth.select("contig", "pos", (F.col("pos") + F.col("sv_len")).alias("end_pos"), "truth_id")
    both = T.united([rows.filter("truth_id % 3 <> 1"), rows.filter("truth_id % 3 <> 2")])
    return T.without_overlaps(both, "pos", "end_pos", "truth_id").join(both.select("truth_id", "gt"), "truth_id").select("contig", "pos", "end_pos", "truth_id", "gt")


def _sigs(ops: DataFrame, op: str) -> DataFrame:
    return M.read_signatures(S.cigar_signatures(ops, op, ONT))


SIGS = "SELECT o.read_id, op_idx, op, pos + ref_off AS b, op_len AS n FROM offsets o JOIN admitted a ON a.read_id = o.read_id WHERE op IN ('D', 'I') AND op_len >= 30"
# a recursive walk over each read's deletions
FOLD = """SELECT read_id, begin_pos, max(length) AS length, max(parts) AS parts FROM (
 WITH RECURSIVE ordered AS (SELECT read_id, b, n, row_number() OVER (PARTITION BY read_id ORDER BY op_idx) AS r FROM sigs WHERE op = 'D'),
 walk AS (
  SELECT read_id, r, b AS begin_pos, n AS length, CAST(1 AS BIGINT) AS parts FROM ordered WHERE r = 1
  UNION ALL
  SELECT o.read_id, o.r, CASE WHEN apart THEN o.b ELSE o.begin_pos END, CASE WHEN apart THEN o.n ELSE o.length + o.n END, CASE WHEN apart THEN 1 ELSE o.parts + 1 END
  FROM (SELECT o.read_id, o.r, o.b, o.n, w.begin_pos, w.length, w.parts, o.b - w.begin_pos - w.length >= greatest(w.length * 0.2, 500) AS apart
   FROM walk w JOIN ordered o ON o.read_id = w.read_id AND o.r = w.r + 1) o)
 SELECT * FROM walk) GROUP BY read_id, begin_pos"""


@query("cigar_op", sql="SELECT read_id, begin_pos, CAST(length AS BIGINT) AS length, CAST(parts AS BIGINT) AS parts FROM fold", offsets=OFFSETS, admitted=ADMITTED, sigs=SIGS, fold=FOLD)
def simple_merge(ops: DataFrame) -> DataFrame:
    return M.simple_merge(_sigs(ops, "D"), ONT).drop("first")


@query("cigar_op", sql="SELECT read_id, begin_pos, CAST(length AS BIGINT) AS length, CAST(parts AS BIGINT) AS parts FROM fold", offsets=OFFSETS, admitted=ADMITTED, sigs=SIGS, fold=FOLD.replace("- w.begin_pos - w.length >=", "- w.begin_pos >="))
def regional_merge(ops: DataFrame) -> DataFrame:
    return M.simple_merge(_sigs(ops, "D"), ONT, regional=True).drop("first")


def _ranged(ops: DataFrame) -> DataFrame:
    """Reads with the extents of their deletions and insertions; a region is an eighth of the reads."""
    both = S.cigar_signatures(ops, "D", ONT).withColumn("gone", F.lit(True)).unionByName(S.cigar_signatures(ops, "I", ONT).withColumn("gone", F.lit(False)))
    low = lambda c, f: F.coalesce(f(F.when(F.col("gone"), F.col(c))), F.lit(-1)).cast("long")
    reads = both.groupBy("read_id").agg(low("begin_pos", F.min).alias("del_begin"), low("end_pos", F.max).alias("del_end"), F.min("begin_pos").alias("begin"))
    reads = materialize(reads.withColumn("region", F.col("read_id") % 8), shared_folder(ops.sparkSession), "extents")
    return M.relevant_ranges(reads)


EXTENTS = "SELECT read_id, read_id % 8 AS region, coalesce(min(b) FILTER (WHERE op = 'D'), -1) AS del_begin, coalesce(max(b + n) FILTER (WHERE op = 'D'), -1) AS del_end, min(b) AS begin FROM sigs GROUP BY read_id"
RANKED = "SELECT *, row_number() OVER w - 1 AS idx, max(del_end) OVER w AS max_end FROM extents WINDOW w AS (PARTITION BY region ORDER BY del_begin, read_id)"


@query("cigar_op", sql="""SELECT q.region, q.read_id, q.idx, count(*) FILTER (WHERE x.max_end <= q.begin) AS first, count(*) FILTER (WHERE x.del_begin <= q.begin) AS after
FROM ranked q JOIN ranked x ON x.region = q.region GROUP BY ALL""", offsets=OFFSETS, admitted=ADMITTED, sigs=SIGS, extents=EXTENTS, ranked=RANKED)
def relevant_reads(ops: DataFrame) -> DataFrame:
    return _ranged(ops).select("region", "read_id", "idx", "first", "after")


def _with_sigs(ops: DataFrame, op: str) -> DataFrame:
    empty = F.array().cast("array<struct<begin:bigint,length:bigint>>")
    return _ranged(ops).join(_sigs(ops, op), "read_id", "left").withColumn("sigs", F.coalesce("sigs", empty))


@query("cigar_op")
def omni_merge(ops: DataFrame) -> DataFrame:
    ops = materialize(ops, shared_folder(ops.sparkSession), "operations")
    return M.omni_merge(_with_sigs(ops, "D"), 0, ONT).withColumn("sv_type", F.lit(0).cast("long")).unionByName(M.omni_merge(_with_sigs(ops, "I"), 1, ONT).withColumn("sv_type", F.lit(1).cast("long")))


@query("cigar_op", sql="""SELECT a.read_id, CAST(sum(CASE WHEN b.b <= a.b + 800 AND abs(a.b - b.b) + abs(a.b + a.n - b.b - b.n) <= 800 AND abs(a.n - b.n) <= 800 THEN 800 - abs(a.n - b.n) ELSE 0 END) AS BIGINT) AS score
FROM (SELECT * FROM sigs WHERE op = 'D') a JOIN (SELECT * FROM sigs WHERE op = 'D') b ON b.read_id = a.read_id GROUP BY a.read_id""", offsets=OFFSETS, admitted=ADMITTED, sigs=SIGS)
def score_b(ops: DataFrame) -> DataFrame:
    # how alike a read's deletions are to themselves, natively over its array
    pairs = F.transform("sigs", lambda a: F.aggregate("sigs", F.lit(0).cast("long"), lambda acc, b: acc + _pair(a, b)))
    return _sigs(ops, "D").select("read_id", F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("score"))


def _pair(a, b):
    reach = ONT.omni_b[0]
    longer = F.abs(a["length"] - b["length"])
    ends = F.abs(a["begin"] - b["begin"]) + F.abs(a["begin"] + a["length"] - b["begin"] - b["length"])
    return F.when((b["begin"] <= a["begin"] + reach) & (ends <= reach) & (longer <= reach), reach - longer).otherwise(0)
