"""What alignment records contribute: primary segments, coverage, and signatures of all kinds.

Records have source_id, qname, flag, contig, pos (from 0), mapq, cigar, mate_contig, mate_pos, isize, seq and tags (a map from
name to value).  Each branch reads a record by itself, without a shuffle; only the splits of one read are grouped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder
from varloom.functions import reads as R
from varloom.operators import library as L
from varloom.operators import merge as M
from varloom.operators import splits as S
from varloom.params import Params

#: Records of a source that are probed for its technology, and the query length above which reads are long.
PROBED, LONG = 10, 1000
#: The columns of signatures.
FIELDS = ["contig", "sv_type", "tech", "sig_type", "begin_pos", "end_pos", "length", "template", "quality", "hp", "cn", "inv_left", "inv_right", "ins_bases"]


def scan(sources: list[DataFrame]) -> DataFrame:
    """All sources' records, with source_id by their place in the list."""
    return reduce(DataFrame.unionByName, [s.withColumn("source_id", F.lit(k).cast("long")) for k, s in enumerate(sources)])


def prepared(records: DataFrame) -> DataFrame:
    """Adds ops, ref_len, hp (0 without a tag) and read_id, a hash that equal records share
    (:func:`told_apart` gives each its own)."""
    return records.withColumns({
        "ops": R.cigar_ops(F.col("cigar")),
        "hp": F.coalesce(F.col("tags")["HP"].cast("long"), F.lit(0).cast("long")),
        "read_id": F.xxhash64("source_id", "qname", "contig", "pos", "flag", "cigar"),
    }).withColumn("ref_len", R.cigar_sum(F.col("ops"), R.REFERENCE_OPS))


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with a read_id of its own for every record: a record that is in a file twice counts twice.

    Equal records share their hash, so they are numbered, and the number goes into the id of all but the first.
    """
    alike = Window.partitionBy("read_id").orderBy(*(c for c in rows.columns if c != "read_id"))
    nth = rows.withColumn("_nth", F.row_number().over(alike))
    return nth.withColumn("read_id", F.when(F.col("_nth") == 1, F.col("read_id")).otherwise(F.xxhash64("read_id", "_nth"))).drop("_nth")


def technologies(records: DataFrame, platforms: DataFrame) -> DataFrame:
    """(source_id, tech): by the platform (source_id, platform) of the source's first read group, else by its first records.

    0 are long reads, 1 short ones.  ``records`` are of :func:`prepared`; the first ones are those that come first by place.
    """
    first = Window.partitionBy("source_id").orderBy("contig", "pos", "qname", "flag")
    some = records.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= PROBED)
    probe = some.groupBy("source_id").agg(F.when(F.max(R.cigar_sum(F.col("ops"), R.QUERY_OPS)) > LONG, 0).otherwise(1).alias("probed"))
    known = F.when(F.col("platform") == "ILLUMINA", 1).when(F.col("platform").isin("PACBIO", "ONT"), 0)
    # a row per source
    return probe.join(F.broadcast(platforms), "source_id", "left").select("source_id", F.coalesce(known, "probed").cast("long").alias("tech"))


def primary_segments(records: DataFrame) -> DataFrame:
    return records.filter(R.is_primary(F.col("flag"))).select("contig", F.col("pos").alias("begin_pos"), (F.col("pos") + F.col("ref_len")).alias("end_pos"))


def covering(records: DataFrame, sizes: DataFrame, p: Params) -> DataFrame:
    """(contig, pos, ref_end) of what counts as coverage: well-mapped primary records of long reads, and the supplementary
    segments on the record's own contig; cut to the contig, of which ``sizes`` (contig, size) has a row."""
    primary = records.filter(R.is_primary(F.col("flag")))
    own = primary.filter((F.col("tech") == 0) & (F.col("mapq") >= p.min_mapq)).select("contig", "pos", (F.col("pos") + F.col("ref_len")).alias("ref_end"))
    others = primary.filter(F.col("tags")["SA"].isNotNull()).select("read_id", F.col("contig").alias("home"), F.col("tags")["SA"].alias("sa"))
    parsed = S.parse_supplementary(others, "home").filter("contig = home")
    other = parsed.select("contig", "pos", (F.col("pos") + R.cigar_sum(R.cigar_ops(F.col("cigar")), R.REFERENCE_OPS)).alias("ref_end"))
    cut = own.unionByName(other).join(F.broadcast(sizes.select("contig", "size")), "contig")
    cut = cut.withColumn("ref_end", F.when(F.col("ref_end") > F.col("size"), F.col("size") - 1).otherwise(F.col("ref_end")))
    return cut.filter("ref_end > pos").select("contig", "pos", "ref_end")


def _signature(rows: DataFrame, sv_type: Column, sig_type: int, **values: Column) -> DataFrame:
    """Rows of FIELDS; what isn't among ``values`` is a column of ``rows`` or has its plain value."""
    plain = {
        "tech": F.col("tech").cast("long"), "sig_type": F.lit(sig_type).cast("long"), "length": F.col("end_pos") - F.col("begin_pos"), "hp": F.col("hp").cast("long"), "template": F.col("qname"),
        "cn": F.lit(-1).cast("long"), "inv_left": F.lit(False), "inv_right": F.lit(False), "ins_bases": F.lit(None).cast("string"),
    }
    made = plain | {"sv_type": sv_type.cast("long")} | values
    return rows.select(*(made.get(c, F.col(c)).alias(c) for c in FIELDS))


def cigar_reads(records: DataFrame, p: Params) -> DataFrame:
    """Well-mapped, long enough records with their deletions (gone) and insertions (more), by one pass over the operations.

    Both are arrays of (begin, length, bases).
    """
    query, size = R.cigar_sum(F.col("ops"), R.QUERY_OPS), R.cigar_sum(F.col("ops"), tuple(o for o in R.QUERY_OPS if o != "S"))
    rows = records.filter((F.col("mapq") >= p.min_mapq) & (query >= p.min_template))
    found = "array<struct<op:string,begin:bigint,at:bigint,len:bigint>>"
    start = F.struct(F.col("pos").alias("ref"), F.lit(0).cast("long").alias("query"), F.array().cast(found).alias("found"))

    def step(state: Column, o: Column) -> Column:
        wanted = o["op"].isin("D", "I") & (o["len"] >= p.min_sv_len)
        here = F.struct(o["op"].alias("op"), state["ref"].alias("begin"), state["query"].alias("at"), o["len"].alias("len"))
        return F.struct(
            (state["ref"] + F.when(o["op"].isin(*R.SIGNATURE_OPS), o["len"]).otherwise(0)).alias("ref"),
            (state["query"] + F.when(o["op"].isin(*R.QUERY_OPS), o["len"]).otherwise(0)).alias("query"),
            F.when(wanted, F.concat(state["found"], F.array(here))).otherwise(state["found"]).alias("found"),
        )

    score = F.coalesce(F.col("tags")["AS"].cast("double"), F.lit(0.0)) / F.when(size > 0, size)
    rows = rows.withColumns({"_found": F.aggregate("ops", start, step, lambda a: a["found"]), "quality": score})
    # letters that stand for several bases count as unknown ones
    bases = lambda s: F.translate(F.substring("seq", (s["at"] + 1).cast("int"), s["len"].cast("int")), "=MRSVWYHKDB", "NNNNNNNNNNN")
    none = F.lit(None).cast("string")
    kind = lambda op, spell: F.transform(F.filter("_found", lambda s: s["op"] == op), lambda s: F.struct(s["begin"].alias("begin"), s["len"].alias("length"), spell(s).alias("bases")))
    rows = rows.withColumns({"gone": kind("D", lambda s: none), "more": kind("I", bases)})
    return rows.filter((F.size("gone") > 0) | (F.size("more") > 0)).select("read_id", "contig", "qname", "hp", "tech", "quality", "gone", "more")


def from_cigars(records: DataFrame, p: Params) -> DataFrame:
    """Deletions and insertions as the operations have them, without merging."""
    rows = cigar_reads(records, p)
    parts = []
    for kind, name in enumerate(("gone", "more")):
        each = rows.withColumn("s", F.explode(name)).withColumns({"begin_pos": F.col("s.begin"), "end_pos": F.col("s.begin") + F.col("s.length")})
        parts.append(_signature(each, F.lit(kind), 0, ins_bases=F.col("s.bases")))
    return parts[0].unionByName(parts[1])


def merged(records: DataFrame, p: Params, how: str = "omni") -> DataFrame:
    """Deletions and insertions whose pieces inside a read are put together: ``how`` is omni, simple or regional.

    What is put together has the quality of the read and all its pieces' bases; only omni keeps the haplotype.
    """
    # read several times from here on
    rows = materialize(told_apart(cigar_reads(records, p)), shared_folder(records.sparkSession), "reads")
    ends = F.transform("gone", lambda s: s["begin"] + s["length"])
    low = F.array_min(F.transform(F.concat("gone", "more"), lambda s: s["begin"]))
    extents = rows.select("read_id", F.col("contig").alias("region"), F.coalesce(F.get("gone", F.lit(0))["begin"], F.lit(-1)).alias("del_begin"), F.coalesce(F.array_max(ends), F.lit(-1)).alias("del_end"), low.alias("begin"))
    ranged = M.relevant_ranges(extents) if how == "omni" else None
    parts = []
    for kind, name in enumerate(("gone", "more")):
        sigs = rows.select("read_id", F.transform(name, lambda s: F.struct(s["begin"].alias("begin"), s["length"].alias("length"))).alias("sigs"))
        found = M.omni_merge(ranged.join(sigs, "read_id"), kind, p) if how == "omni" else M.simple_merge(sigs, p, regional=how == "regional")
        each = found.join(rows, "read_id").withColumn("end_pos", F.col("begin_pos") + F.col("length"))
        bases = F.array_join(F.transform(F.slice(name, (F.col("first") + 1).cast("int"), F.col("parts").cast("int")), lambda s: s["bases"]), "")
        more = {} if how == "omni" else {"hp": F.lit(0).cast("long")}
        parts.append(_signature(each, F.lit(kind), 0, ins_bases=F.when(F.lit(kind == 1), bases), **more))
    return parts[0].unionByName(parts[1])


def from_pairs(records: DataFrame, moments: DataFrame) -> DataFrame:
    """Deletions where a pair of short reads spans far more than the library's inserts, duplications where far less.

    Pairs point to each other or away from each other, on one contig; the record with the inner distance speaks for both.
    ``moments`` (mean, sd) has one row for all sources, or with a source_id one for each.
    """
    flag = F.col("flag")
    both = R.has(flag, R.PAIRED) & ~R.has(flag, R.UNMAPPED) & ~R.has(flag, R.MATE_UNMAPPED) & (F.col("mate_contig").isin("=") | (F.col("mate_contig") == F.col("contig")))
    rows = records.filter((F.col("tech") == 1) & both & (F.col("isize") >= 0) & (R.has(flag, R.REVERSE) != R.has(flag, R.MATE_REVERSE)))
    rows = rows.join(F.broadcast(moments.select("source_id", "mean", "sd")), "source_id") if "source_id" in moments.columns else rows.crossJoin(F.broadcast(moments.select("mean", "sd")))
    ahead = ~R.has(flag, R.REVERSE)
    pick = lambda one, two: F.when(ahead, one).otherwise(two)
    rows = rows.withColumn("_from", pick(F.col("pos"), F.col("mate_pos"))).withColumn("_gap", pick(F.col("isize"), F.col("pos") + F.col("ref_len") - F.col("mate_pos")))
    wide, narrow = F.col("_gap") > F.col("mean") + 5 * F.col("sd"), F.col("_gap") < F.col("mean") - 3 * F.col("sd")
    whole = lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")
    rows = rows.filter(wide | narrow).withColumns({
        "_len": F.when(wide, whole(F.col("_gap") - F.col("mean"))).otherwise(pick(F.greatest(whole(F.col("mean") - F.col("isize")), F.lit(0).cast("long")), F.col("isize"))),
        "begin_pos": F.when(wide, F.col("_from") + whole(F.col("mean") / 2)).otherwise(F.col("pos")),
    }).withColumn("end_pos", F.when(wide, F.col("begin_pos") + F.col("_len")).otherwise(F.col("pos") + F.col("isize")))
    return _signature(rows, F.when(wide, 0).otherwise(2), 1, length=F.col("_len"), quality=F.col("mapq").cast("double"), hp=F.lit(0).cast("long"))


def split_records(records: DataFrame) -> DataFrame:
    """Primary records with supplementary segments, told apart, with what :func:`segments` needs and whose signatures they are."""
    split = records.filter(R.is_primary(F.col("flag")) & F.col("tags")["SA"].isNotNull())
    more = [c for c in ("hp", "tech") if c in records.columns]
    return told_apart(split.select("read_id", "qname", "flag", "contig", "pos", "cigar", F.col("tags")["SA"].alias("sa"), F.coalesce(F.col("tags")["NM"].cast("long"), F.lit(0)).alias("nm"), *more))


def segments(split: DataFrame) -> DataFrame:
    """The segments of ``split`` (of :func:`split_records`), in the order in which the read passes them, with what :mod:`splits` needs."""
    own = split.select("read_id", F.lit(-1).cast("long").alias("at"), "contig", "pos", (~R.has(F.col("flag"), R.REVERSE)).cast("long").alias("strand"), "cigar", "nm")
    other = S.parse_supplementary(split.select("read_id", "sa")).select("read_id", F.col("idx").alias("at"), "contig", "pos", "strand", "cigar", "nm")
    rows = own.unionByName(other).withColumn("ops", R.cigar_ops(F.col("cigar")))
    first = F.get("ops", F.lit(0))
    inner = F.when(first["op"].isin("H", "S"), first["len"]).otherwise(0)
    size = R.cigar_sum(F.col("ops"), tuple(o for o in R.QUERY_OPS if o != "S"))
    rows = rows.withColumns({"_inner": inner, "_size": size, "_read": R.cigar_sum(F.col("ops"), (*R.QUERY_OPS, "H"))})
    ahead = F.col("strand") == 1
    rows = rows.withColumns({
        "fwd_pos": F.when(ahead, F.col("_inner")).otherwise(F.col("_read") - F.col("_inner") - F.col("_size")),
        "fwd_end": F.when(ahead, F.col("_inner") + F.col("_size")).otherwise(F.col("_read") - F.col("_inner")),
        "ref_end": F.col("pos") + R.cigar_sum(F.col("ops"), R.REFERENCE_OPS),
    })
    order = Window.partitionBy("read_id").orderBy("fwd_pos", "at")
    rows = rows.withColumn("idx", F.row_number().over(order).cast("long") - 1)
    return rows.select("read_id", "idx", "contig", "strand", "pos", "ref_end", "fwd_pos", "fwd_end", "nm").withColumn("quality", S.quality())


def from_splits(records: DataFrame, sizes: DataFrame, p: Params) -> DataFrame:
    """Signatures of all types from the segments of split records."""
    folder = shared_folder(records.sparkSession)
    split = materialize(split_records(records), folder, "split")
    # read by every kind of signature
    segs = materialize(segments(split), folder, "segments")
    names = split.select("read_id", "qname", "hp", "tech")
    parts = [
        (S.split_deletions(segs, p), F.lit(0), {}),
        (S.split_insertions(segs, sizes, p), F.lit(1), {}),
        (S.split_duplications(segs, p), F.lit(2), {"cn": F.col("copies")}),
        (S.split_inversions(segs), F.lit(3), {"inv_left": F.col("inv_left"), "inv_right": F.col("inv_right")}),
    ]
    return reduce(DataFrame.unionByName, [_signature(found.join(names, "read_id"), kind, 2, **more) for found, kind, more in parts])


def signatures(records: DataFrame, tech: DataFrame, sizes: DataFrame, p: Params, moments: DataFrame | None = None, merge: str | None = "omni") -> DataFrame:
    """All that the records show, as rows of FIELDS.  ``tech`` has a row per source, ``sizes`` one per contig.

    ``moments`` are those of the short reads' libraries; by default each source's are measured on its own records.  ``merge`` tells how
    pieces inside a read are put together (:func:`merged`), or None.
    """
    rows = prepared(records).join(F.broadcast(tech), "source_id")
    moments = L.moments(L.library_reads(rows.filter("tech = 1")), ["source_id"]) if moments is None else moments
    inside = merged(rows, p, merge) if merge else from_cigars(rows, p)
    return inside.unionByName(from_pairs(rows, moments)).unionByName(from_splits(rows, sizes, p))
