"""Queries over split reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import reads as R
from varloom.operators import coverage as V
from varloom.operators import library as L
from varloom.operators import records
from varloom.operators import signatures as C
from varloom.operators import splits as S
from varloom.params import ONT
from varloom.plans.library import DISCORDANTS, pair_records
from varloom.plans.reads import ADMITTED, OFFSETS
from varloom.plans.registry import query


@query("split_seg", sql="""SELECT read_id, idx, CASE WHEN strand = 1 THEN fwd_pos ELSE n - fwd_end END AS inner_pos,
 CASE WHEN strand = 1 THEN fwd_end ELSE n - fwd_pos END AS inner_end FROM (SELECT *, max(fwd_end) OVER (PARTITION BY read_id) AS n FROM split_seg)""")
def segment_coords(segs: DataFrame) -> DataFrame:
    return S.inner_coordinates(segs).select("read_id", "idx", "inner_pos", "inner_end")


@query("split_seg", sql="SELECT read_id, idx, round(1 - nm / (fwd_end - fwd_pos), 6) AS quality FROM split_seg")
def aln_quality(segs: DataFrame) -> DataFrame:
    return segs.select("read_id", "idx", F.round(S.quality(), 6).alias("quality"))


@query("split_seg", sql="SELECT read_id, idx, contig, pos, strand, CAST(ref_end - pos AS VARCHAR) || 'M' AS cigar, CAST(60 AS BIGINT) AS mapq, nm FROM split_seg")
def sa_parse(segs: DataFrame) -> DataFrame:
    return S.parse_supplementary(S.supplementary_tags(segs))


@query("split_seg", sql="SELECT read_id, idx, contig, pos, ref_end, strand, fwd_pos, count(*) OVER (PARTITION BY read_id) AS segments FROM split_seg")
def split_segments(segs: DataFrame) -> DataFrame:
    w = Window.partitionBy("read_id")
    ranked = segs.withColumn("idx", F.row_number().over(w.orderBy("fwd_pos")).cast("long") - 1).withColumn("segments", F.count(F.lit(1)).over(w))
    return ranked.select("read_id", "idx", "contig", "pos", "ref_end", "strand", "fwd_pos", "segments")


@query("split_seg", sql="""SELECT read_id, idx, lag(contig) OVER w = contig AS same_contig, lag(strand) OVER w = strand AS same_strand, pos - lag(ref_end) OVER w AS gap
FROM split_seg WINDOW w AS (PARTITION BY read_id ORDER BY idx)""")
def neighbour_compare(segs: DataFrame) -> DataFrame:
    w = Window.partitionBy("read_id").orderBy("idx")
    before = lambda c: F.lag(c).over(w)
    return segs.select("read_id", "idx", (before("contig") == F.col("contig")).alias("same_contig"), (before("strand") == F.col("strand")).alias("same_strand"), (F.col("pos") - before("ref_end")).alias("gap"))


PAIRS = """SELECT a.read_id, a.contig, a.idx AS a_idx, b.fwd_pos - a.fwd_end AS inner_gap, 0.5 * (2 - a.nm / CAST(a.fwd_end - a.fwd_pos AS DOUBLE) - b.nm / CAST(b.fwd_end - b.fwd_pos AS DOUBLE)) AS q,
 CASE WHEN a.strand = 1 THEN a.ref_end ELSE b.ref_end END AS fe, CASE WHEN a.strand = 1 THEN b.pos ELSE a.pos END AS lp
FROM split_seg a JOIN split_seg b ON a.read_id = b.read_id AND a.contig = b.contig AND a.strand = b.strand AND b.idx > a.idx AND abs(a.pos - b.pos) <= 1000000
QUALIFY row_number() OVER (PARTITION BY a.read_id, a.idx ORDER BY b.idx) = 1"""


@query("split_seg", sql="SELECT read_id, contig, a_idx, fe AS begin_pos, lp AS end_pos FROM pairs WHERE fe < lp AND lp - fe - inner_gap >= 30 AND lp - fe <= 2 * (lp - fe - inner_gap)", pairs=PAIRS)
def sig_del_split(segs: DataFrame) -> DataFrame:
    return S.split_deletions(segs, ONT).drop("quality")


@query("split_seg", sql="""SELECT read_id, p.contig, a_idx, (fe + lp) // 2 AS begin_pos, least(size - 1, (fe + lp) // 2 + inner_gap - (lp - fe)) AS end_pos
FROM pairs p JOIN (SELECT contig, max(ref_end) + 1000 AS size FROM split_seg GROUP BY contig) s ON s.contig = p.contig WHERE fe < lp + 10 AND inner_gap - (lp - fe) >= 30""", pairs=PAIRS)
def sig_ins_split(segs: DataFrame) -> DataFrame:
    sizes = segs.groupBy("contig").agg((F.max("ref_end") + 1000).alias("size"))
    return S.split_insertions(segs, sizes, ONT).drop("quality")


SEGS = "SELECT *, 1 - nm / CAST(fwd_end - fwd_pos AS DOUBLE) AS q FROM split_seg"
#: Neighbours that overlap, numbered by read.
OVER = """SELECT read_id, contig, strand, s, e, q, row_number() OVER (PARTITION BY read_id ORDER BY idx) AS k FROM (
 SELECT a.read_id, a.idx, a.contig, a.strand, 0.5 * (a.q + b.q) AS q, CASE WHEN a.strand = 1 THEN b.pos ELSE a.pos END AS s, CASE WHEN a.strand = 1 THEN a.ref_end ELSE b.ref_end END AS e
 FROM segs a JOIN segs b ON a.read_id = b.read_id AND b.idx = a.idx + 1 AND a.contig = b.contig AND a.strand = b.strand AND abs(a.pos - b.pos) <= 1000000) WHERE e - s >= 30"""
FOLD = """SELECT read_id, k, contig, strand, s, e, q, 2 AS n, CAST(NULL AS STRUCT(contig VARCHAR, s BIGINT, e BIGINT, n INTEGER, q DOUBLE)) AS done FROM over_ WHERE k = 1
UNION ALL
SELECT read_id, k, c, st, CASE WHEN same THEN CAST(trunc(s * (n / (n + 1)) + s2 * (1 / (n + 1))) AS BIGINT) ELSE s2 END, CASE WHEN same THEN CAST(trunc(e * (n / (n + 1)) + e2 * (1 / (n + 1))) AS BIGINT) ELSE e2 END,
 CASE WHEN same THEN q * (n / (n + 1)) + q2 * (1 / (n + 1)) ELSE q2 END, CASE WHEN same THEN n + 1 ELSE 2 END,
 CASE WHEN NOT same AND e - s > 30 THEN {'contig': contig, 's': s, 'e': e, 'n': n, 'q': q} END FROM (
 SELECT f.*, o.contig AS c, o.strand AS st, o.s AS s2, o.e AS e2, o.q AS q2, f.contig = o.contig AND f.strand = o.strand
  AND abs((f.e - f.s) - (o.e - o.s)) / least(200, greatest(f.e - f.s, o.e - o.s)) + abs((f.s + f.e) / 2 - (o.s + o.e) / 2) / greatest(f.e - f.s, o.e - o.s) < 0.3 AS same
 FROM (SELECT * EXCLUDE (k, done), k + 1 AS k FROM fold) f JOIN over_ o ON o.read_id = f.read_id AND o.k = f.k)"""
DUPS = """SELECT read_id, done.contig AS contig, done.s AS begin_pos, done.e AS end_pos, CAST(done.n AS BIGINT) AS copies, done.q AS q FROM fold WHERE done IS NOT NULL
UNION ALL SELECT read_id, contig, s, e, CAST(n AS BIGINT), q FROM (SELECT *, max(k) OVER (PARTITION BY read_id) AS m FROM fold) WHERE k = m AND e - s >= 30"""
GOES = lambda x, y: f"abs({x}.pos - {y}.pos) <= 1000000 AND {y}.pos + 1000 >= {x}.ref_end AND {y}.pos > {x}.pos"
FLIPS = f"""SELECT a.read_id, a.idx, a.contig, a.strand, a.q AS qa, b.q AS qb, b.pos AS b_pos, b.ref_end AS b_end, a.pos AS a_pos, a.ref_end AS a_end,
 (SELECT arg_min(c.q, c.idx) FROM segs c WHERE c.read_id = a.read_id AND c.idx > b.idx AND c.contig = a.contig AND c.strand <> b.strand AND CASE WHEN a.strand = 1 THEN {GOES("b", "c")} ELSE {GOES("c", "b")} END) AS qc
FROM segs a JOIN segs b ON a.read_id = b.read_id AND b.idx = a.idx + 1 AND a.contig = b.contig AND a.strand <> b.strand AND CASE WHEN a.strand = 1 THEN {GOES("a", "b")} ELSE {GOES("b", "a")} END"""
#: A whole inversion takes two segments, so the walk over a read steps over the second.
WALK = """SELECT read_id, CAST(0 AS BIGINT) AS idx FROM segs GROUP BY read_id
UNION ALL SELECT w.read_id, w.idx + CASE WHEN f.qc IS NOT NULL THEN 2 ELSE 1 END FROM walk w LEFT JOIN flips f ON f.read_id = w.read_id AND f.idx = w.idx
 WHERE w.idx < (SELECT max(idx) FROM segs s WHERE s.read_id = w.read_id)"""
INVS = """SELECT f.read_id, f.contig, b_pos AS begin_pos, b_end AS end_pos, true AS inv_left, true AS inv_right, (qa + qb + qc) / 3 AS q FROM flips f JOIN walk w ON w.read_id = f.read_id AND w.idx = f.idx WHERE qc IS NOT NULL
UNION ALL SELECT f.read_id, f.contig, CASE WHEN strand = 1 THEN a_pos ELSE b_pos END, CASE WHEN strand = 1 THEN a_end ELSE b_end END, false, true, 0.5 * (qa + qb) FROM flips f JOIN walk w ON w.read_id = f.read_id AND w.idx = f.idx WHERE qc IS NULL
UNION ALL SELECT f.read_id, f.contig, CASE WHEN strand = 1 THEN b_pos ELSE a_pos END, CASE WHEN strand = 1 THEN b_end ELSE a_end END, true, false, 0.5 * (qa + qb) FROM flips f JOIN walk w ON w.read_id = f.read_id AND w.idx = f.idx WHERE qc IS NULL"""
FOLDS = dict(segs=SEGS, over_=OVER, fold=FOLD, dups=DUPS)
SCANS = dict(segs=SEGS, flips=FLIPS, walk=WALK, invs=INVS)


@query("split_seg", sql="SELECT read_id, contig, begin_pos, end_pos, copies, round(q, 6) AS quality FROM dups", **FOLDS)
def sig_dup_split(segs: DataFrame) -> DataFrame:
    return S.split_duplications(segs, ONT).withColumn("quality", F.round("quality", 6))


@query("split_seg", sql="SELECT read_id, contig, begin_pos, end_pos, inv_left, inv_right, round(q, 6) AS quality FROM invs", **SCANS)
def sig_inv_split(segs: DataFrame) -> DataFrame:
    return S.split_inversions(segs).withColumn("quality", F.round("quality", 6))


def split_records(segs: DataFrame) -> DataFrame:
    """A primary record of each read's first segment, with the others in its tag; the CIGARs have the segments' lengths."""
    rows = segs.withColumn("n", F.max("fwd_end").over(Window.partitionBy("read_id")))
    r, q, forward = F.col("ref_end") - F.col("pos"), F.col("fwd_end") - F.col("fwd_pos"), F.col("strand") == 1
    part = lambda size, op: F.when(size > 0, F.concat(size.cast("string"), F.lit(op))).otherwise("")
    head, tail = F.when(forward, F.col("fwd_pos")).otherwise(F.col("n") - F.col("fwd_end")), F.when(forward, F.col("n") - F.col("fwd_end")).otherwise(F.col("fwd_pos"))
    cigar = F.concat(part(head, "S"), part(F.least(r, q), "M"), part(r - q, "D"), part(q - r, "I"), part(tail, "S"))
    rows = rows.withColumn("cigar", cigar)
    entry = F.concat_ws(",", "contig", "pos", F.when(forward, "+").otherwise("-"), "cigar", F.lit("60"), "nm")
    others = F.array_sort(F.collect_list(F.when(F.col("idx") > 0, F.struct("idx", entry.alias("e")))))
    sa = rows.groupBy("read_id").agg(F.concat(F.array_join(F.transform(others, lambda x: x["e"]), ";"), F.lit(";")).alias("sa"))
    hp = (F.col("read_id") % 3).cast("string")
    return rows.filter("idx = 0").join(sa, "read_id").select(
        F.concat(F.lit("s"), F.col("read_id").cast("string")).alias("qname"), F.when(forward, 0).otherwise(16).cast("long").alias("flag"), "contig", "pos", F.lit(0).cast("long").alias("mapq"), "cigar",
        F.lit("*").alias("mate_contig"), F.lit(-1).cast("long").alias("mate_pos"), F.lit(0).cast("long").alias("isize"), F.lit(None).cast("string").alias("seq"),
        F.create_map(F.lit("SA"), "sa", F.lit("NM"), F.col("nm").cast("string"), F.lit("HP"), hp).alias("tags"),
    )


def cigar_records(ops: DataFrame) -> DataFrame:
    """A record of each read of CIGAR operations, whose bases repeat ACGT."""
    rows = C.cigar_strings(ops).join(ops.groupBy("read_id").agg(F.max("pos").alias("pos")), "read_id")
    size = R.cigar_sum(R.cigar_ops(F.col("cigar")), R.QUERY_OPS)
    tags = F.create_map(F.lit("HP"), (F.col("read_id") % 3).cast("string"), F.lit("AS"), (size - F.col("read_id") % 100).cast("string"))
    return rows.select(
        F.concat(F.lit("c"), F.col("read_id").cast("string")).alias("qname"), F.lit(0).cast("long").alias("flag"), F.lit("A").alias("contig"), "pos", "mapq", "cigar", F.lit("*").alias("mate_contig"),
        F.lit(-1).cast("long").alias("mate_pos"), F.lit(0).cast("long").alias("isize"), F.repeat(F.lit("ACGT"), F.ceil(size / 4).cast("int")).alias("seq"), tags.alias("tags"),
    )


WHOLE = """
SELECT contig, sv_type, CAST(tech AS BIGINT) AS tech, CAST(sig_type AS BIGINT) AS sig_type, begin_pos, end_pos, length, template, round(q, 6) AS quality, hp, cn, inv_left, inv_right, ins_bases FROM (
 SELECT 'A' AS contig, CAST(CASE op WHEN 'D' THEN 0 ELSE 1 END AS BIGINT) AS sv_type, 0 AS tech, 0 AS sig_type, pos + ref_off AS begin_pos, pos + ref_off + op_len AS end_pos, op_len AS length, 'c' || o.read_id AS template,
  (n - o.read_id % 100) / n AS q, o.read_id % 3 AS hp, CAST(-1 AS BIGINT) AS cn, false AS inv_left, false AS inv_right,
  CASE op WHEN 'I' THEN substr(repeat('ACGT', 40), CAST(query_off % 4 AS INTEGER) + 1, CAST(op_len AS INTEGER)) END AS ins_bases
 FROM offsets o JOIN (SELECT read_id, sum(CASE WHEN op IN ('M', 'I') THEN op_len ELSE 0 END) AS n FROM cigar_op GROUP BY read_id HAVING max(mapq) >= 20) a ON a.read_id = o.read_id WHERE op IN ('D', 'I') AND op_len >= 30 AND n >= 500
 UNION ALL SELECT contig, sv_type, 1, 1, begin_pos, end_pos, length, template, quality, 0, -1, false, false, NULL FROM discordant
 UNION ALL SELECT p.contig, 0, 0, 2, fe, lp, lp - fe, 's' || p.read_id, q, p.read_id % 3, -1, false, false, NULL FROM pairs p WHERE fe < lp AND lp - fe - inner_gap >= 30 AND lp - fe <= 2 * (lp - fe - inner_gap)
 UNION ALL SELECT contig, 1, 0, 2, b, e, e - b, 's' || read_id, q, read_id % 3, -1, false, false, NULL FROM (
  SELECT p.*, (fe + lp) // 2 AS b, least(size - 1, (fe + lp) // 2 + inner_gap - (lp - fe)) AS e FROM pairs p JOIN (SELECT contig, max(ref_end) + 1000 AS size FROM split_seg GROUP BY contig) s ON s.contig = p.contig
  WHERE fe < lp + 10 AND inner_gap - (lp - fe) >= 30)
 UNION ALL SELECT contig, 2, 0, 2, begin_pos, end_pos, end_pos - begin_pos, 's' || read_id, q, read_id % 3, copies, false, false, NULL FROM dups
 UNION ALL SELECT contig, 3, 0, 2, begin_pos, end_pos, end_pos - begin_pos, 's' || read_id, q, read_id % 3, -1, inv_left, inv_right, NULL FROM invs)"""


def _sources(ops: DataFrame, segs: DataFrame, pairs: DataFrame) -> DataFrame:
    return records.prepared(records.scan([cigar_records(ops), split_records(segs), pair_records(pairs)]))


def _platforms(rows: DataFrame) -> DataFrame:
    """The third source's header names no platform."""
    return rows.sparkSession.createDataFrame([(0, "ONT"), (1, "PACBIO")], "source_id long, platform string")


SOURCES = """SELECT CAST(0 AS BIGINT) AS source_id, count(DISTINCT read_id) AS n, CAST(sum(CASE WHEN op IN ('M', 'D', 'N') THEN op_len ELSE 0 END) AS BIGINT) AS bases FROM cigar_op
UNION ALL SELECT 1, count(*), CAST(sum(ref_end - pos) AS BIGINT) FROM split_seg WHERE idx = 0 UNION ALL SELECT 2, count(*), 100 * count(*) FROM pair"""


@query("cigar_op", "split_seg", "pair", sql="SELECT * FROM sources", sources=SOURCES)
def multi_source_union(ops: DataFrame, segs: DataFrame, pairs: DataFrame) -> DataFrame:
    return _sources(ops, segs, pairs).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ref_len").alias("bases"))


@query("cigar_op", "split_seg", "pair", sql="SELECT source_id, CAST(CASE source_id WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS tech FROM sources", sources=SOURCES)
def tech_detect(ops: DataFrame, segs: DataFrame, pairs: DataFrame) -> DataFrame:
    rows = _sources(ops, segs, pairs)
    return records.technologies(rows, _platforms(rows))


@query("cigar_op", sql="""SELECT o.read_id, pos + ref_off AS begin_pos, substr(repeat('ACGT', 40), CAST(query_off % 4 AS INTEGER) + 1, CAST(op_len AS INTEGER)) AS bases
FROM offsets o JOIN admitted a ON a.read_id = o.read_id WHERE op = 'I' AND op_len >= 30""", offsets=OFFSETS, admitted=ADMITTED)
def ins_bases(ops: DataFrame) -> DataFrame:
    rows = records.from_cigars(records.prepared(records.scan([cigar_records(ops)])).withColumn("tech", F.lit(0)), ONT)
    return rows.filter("sv_type = 1").select(F.substring("template", 2, 20).cast("long").alias("read_id"), "begin_pos", F.col("ins_bases").alias("bases"))


@query("cigar_op", "split_seg", "pair", sql=WHOLE, offsets=OFFSETS, pairs=PAIRS, **(FOLDS | SCANS | DISCORDANTS))
def all_signatures(ops: DataFrame, segs: DataFrame, pairs: DataFrame) -> DataFrame:
    sizes = segs.groupBy("contig").agg((F.max("ref_end") + 1000).alias("size"))
    rows = records.scan([cigar_records(ops), split_records(segs), pair_records(pairs)])
    tech = records.technologies(records.prepared(rows), _platforms(rows))
    return records.signatures(rows, tech, sizes, ONT, L.moments(pairs), merge=None).withColumn("quality", F.round("quality", 6))


@query("split_seg", sql="""SELECT contig, w, round(sum(CASE WHEN w = pos // 100 THEN ((pos // 100 + 1) * 100 - pos) / CAST(100 AS DOUBLE) WHEN w = e // 100 THEN (e + 1 - (e // 100) * 100) / CAST(100 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END), 6) AS cov
FROM (SELECT *, unnest(generate_series(pos // 100, e // 100)) AS w FROM (
 SELECT s.contig, s.pos, CASE WHEN s.ref_end > z.size THEN z.size - 1 ELSE s.ref_end END AS e FROM split_seg s JOIN split_seg f ON f.read_id = s.read_id AND f.idx = 0 AND f.contig = s.contig
 JOIN (SELECT contig, max(ref_end) - 500 AS size FROM split_seg GROUP BY contig) z ON z.contig = s.contig WHERE s.idx > 0) WHERE e > pos) GROUP BY contig, w""")
def split_coverage(segs: DataFrame) -> DataFrame:
    sizes = segs.groupBy("contig").agg((F.max("ref_end") - 500).alias("size"))
    rows = records.prepared(records.scan([split_records(segs)])).withColumn("tech", F.lit(0))
    return V.windowed(records.covering(rows, sizes, ONT), ONT).select("contig", "w", F.round("cov", 6).alias("cov"))


#: A walk over each read's signatures of one kind.
LISTED = """SELECT o.read_id, op, pos + ref_off AS b, op_len AS n, (t.n - o.read_id % 100) / t.n AS q, CASE op WHEN 'I' THEN substr(repeat('ACGT', 40), CAST(query_off % 4 AS INTEGER) + 1, CAST(op_len AS INTEGER)) END AS bases,
 row_number() OVER (PARTITION BY o.read_id, op ORDER BY op_idx) AS r FROM offsets o JOIN (
 SELECT read_id, sum(CASE WHEN op IN ('M', 'I') THEN op_len ELSE 0 END) AS n FROM cigar_op GROUP BY read_id HAVING max(mapq) >= 20) t ON t.read_id = o.read_id WHERE op IN ('D', 'I') AND op_len >= 30 AND t.n >= 500"""
JOINED = """SELECT read_id, op, r, b AS begin_pos, n AS length, bases, q, r AS run FROM listed WHERE r = 1
UNION ALL SELECT l.read_id, l.op, l.r, CASE WHEN apart THEN l.b ELSE l.begin_pos END, CASE WHEN apart THEN l.n ELSE l.length + l.n END, CASE WHEN apart THEN l.bases ELSE l.all_ || l.bases END, l.q, CASE WHEN apart THEN l.r ELSE l.run END
FROM (SELECT l.*, w.begin_pos, w.length, w.bases AS all_, w.run, l.b - w.begin_pos - w.length >= greatest(w.length * 0.2, 500) AS apart FROM joined w JOIN listed l ON l.read_id = w.read_id AND l.op = w.op AND l.r = w.r + 1) l"""


@query("cigar_op", sql="""SELECT CAST(CASE op WHEN 'D' THEN 0 ELSE 1 END AS BIGINT) AS sv_type, begin_pos, CAST(length AS BIGINT) AS length, 'c' || read_id AS template, round(q, 6) AS quality, bases AS ins_bases
FROM (SELECT *, row_number() OVER (PARTITION BY read_id, op, run ORDER BY r DESC) AS last FROM joined) WHERE last = 1""", offsets=OFFSETS, listed=LISTED, joined=JOINED)
def merged_signatures(ops: DataFrame) -> DataFrame:
    rows = records.prepared(records.scan([cigar_records(ops)])).withColumn("tech", F.lit(0))
    return records.merged(rows, ONT, "simple").select("sv_type", "begin_pos", "length", "template", F.round("quality", 6).alias("quality"), "ins_bases")
