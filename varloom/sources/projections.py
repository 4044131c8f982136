"""Projections of the star-schema tables into alignment and signature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Each in the SQL that Spark and the oracle share; braces name the tables.
SQL = {
    "sig": """
SELECT l_returnflag AS contig, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS contig_id,
 CAST(l_linenumber % 4 AS BIGINT) AS sv_type, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS tech,
 CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 2 END AS sig_type,
 (l_partkey - l_partkey % 10) * 100 + l_suppkey % 40 AS begin_pos,
 (l_partkey - l_partkey % 10) * 100 + l_suppkey % 40 + CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber % 4 < 2 THEN 30 ELSE 1000 END AS end_pos,
 CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber % 4 < 2 THEN 30 ELSE 1000 END AS length,
 CAST(l_orderkey AS VARCHAR(20)) AS template, 1 - l_discount AS quality,
 CAST(CASE WHEN l_orderkey % 10 = 0 THEN 0 WHEN (l_partkey - l_partkey % 10) % 20 = 0 THEN 1 ELSE 1 + l_orderkey % 2 END AS BIGINT) AS hp,
 l_tax >= 0.02 AS inv_left, l_tax <= 0.06 AS inv_right,
 CAST(CASE WHEN l_linenumber % 4 = 2 THEN 2 + l_suppkey % 3 ELSE -1 END AS BIGINT) AS cn,
 CASE WHEN l_linenumber % 4 = 1 THEN substr(repeat('ACGT', 40), CAST(l_suppkey % 40 % 4 + 1 AS INT), CAST(l_quantity AS INT) + 30) END AS ins_bases
FROM {lineitem}""",
    "aln": """
SELECT l_returnflag AS contig, (l_partkey - l_partkey % 10) * 100 + l_suppkey % 40 AS pos,
 (l_partkey - l_partkey % 10) * 100 + l_suppkey % 40 + CAST(l_quantity AS BIGINT) * 20 AS ref_end,
 CAST(l_quantity AS BIGINT) AS mapq,
 CAST(CASE WHEN l_linenumber = 7 THEN 2048 WHEN l_linenumber = 6 THEN 256 ELSE 0 END + CASE WHEN l_suppkey % 2 = 1 THEN 16 ELSE 0 END AS BIGINT) AS flag,
 CAST(l_orderkey AS VARCHAR(20)) AS template, CAST(l_orderkey % 3 AS BIGINT) AS hp
FROM {lineitem}""",
    "contigs": """
SELECT l_returnflag AS contig, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS contig_id,
 max((l_partkey - l_partkey % 10) * 100 + l_suppkey % 40 + CAST(l_quantity AS BIGINT) * 20) + 1000 AS size
FROM {lineitem} GROUP BY l_returnflag""",
    "cigar_op": """
SELECT r.o_orderkey AS read_id, r.o_custkey * 100 AS pos, CAST(20 + r.o_orderkey % 40 AS BIGINT) AS mapq,
 CAST(l.rn * 2 + k.k AS BIGINT) AS op_idx,
 CASE WHEN k.k = 0 THEN 'M' WHEN l.l_returnflag = 'A' THEN 'I' WHEN l.l_returnflag = 'N' THEN 'N' ELSE 'D' END AS op,
 CAST(CASE WHEN k.k = 0 THEN l.l_partkey % 400 + 200 ELSE 10 + CAST(l.l_quantity AS BIGINT) END AS BIGINT) AS op_len
FROM {orders} r
JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS rn FROM {lineitem}) l ON l.l_orderkey = r.o_orderkey
CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) k""",
    "split_seg": """
SELECT o_custkey AS read_id, o_orderstatus AS contig, CAST(o_orderkey % 2 AS BIGINT) AS strand,
 CAST(floor(o_totalprice) AS BIGINT) AS pos, CAST(floor(o_totalprice) AS BIGINT) + 500 + o_orderkey % 700 AS ref_end,
 CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS idx,
 CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 900 AS BIGINT) AS fwd_pos,
 CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * 900 + 500 + o_orderkey % 350 AS BIGINT) AS fwd_end,
 CAST(o_orderkey % 20 AS BIGINT) AS nm
FROM {orders}""",
    "pair": """
SELECT o_orderkey AS pair_id, o_orderstatus AS contig, CAST(floor(o_totalprice) AS BIGINT) AS pos,
 300 + o_custkey % 200 + CASE WHEN o_orderkey % 97 = 0 THEN 3000 ELSE 0 END AS isize,
 CAST(o_orderkey % 2 AS BIGINT) AS reverse, CAST(o_custkey % 60 AS BIGINT) AS mapq,
 CAST(CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 2 ELSE 1 - o_orderkey % 2 END AS BIGINT) AS mate_reverse,
 CAST(floor(o_totalprice) AS BIGINT) + (300 + o_custkey % 200 + CASE WHEN o_orderkey % 97 = 0 THEN 3000 ELSE 0 END - 100) * (1 - 2 * (o_orderkey % 2)) AS mate_pos
FROM {orders}""",
    "truth": """
SELECT CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS contig, CAST(p_size % 4 AS BIGINT) AS sv_type, p_partkey * 100 AS pos,
 CAST(p_size AS BIGINT) + CASE WHEN p_size % 4 < 2 THEN 30 ELSE 1000 END AS sv_len,
 CASE p_partkey % 3 WHEN 0 THEN '1|1' WHEN 1 THEN '0|1' ELSE '1|0' END AS gt, p_partkey AS truth_id
FROM {part}""",
}
TABLES = ("lineitem", "orders", "part")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection over the tables below ``sf_dir``."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in SQL[name]}
    return spark.sql(SQL[name], **used)


def with_views(names: tuple[str, ...], body: str, **more: str) -> str:
    """``body`` in SQL, after the projections ``names`` and further named subqueries, which may use them and each other."""
    parts = {n: SQL[n].format(**{t: t for t in TABLES}) for n in names} | more
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in parts.items()) + "\n" + body


def reference(contigs: DataFrame, size: int) -> DataFrame:
    """(contig, chunk, seq): a reference of ACGT repeated over the contigs' sizes, in chunks of ``size`` bases."""
    chunks = contigs.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / size).cast("long"))).alias("chunk"))
    return chunks.withColumn("seq", F.repeat(F.lit("ACGT"), F.lit(size // 4)))
