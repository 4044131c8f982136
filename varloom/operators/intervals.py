"""Interval operators that keep their partitions small: running values, islands, and range joins over bins.

A running value over a whole contig would put the contig into one task.  Here positions are cut into stretches of
STRETCH bases; values run inside a stretch, and one row per stretch carries what came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a stretch, and of a bin of range joins.
STRETCH, BIN = 1_000_000, 1_000
#: Levels of bins, and how much wider each one's are; the last level's take a whole genome.
LEVELS, WIDER = 7, 16


def _stretched(df: DataFrame, position: str) -> DataFrame:
    return df.withColumn("_s", F.floor(F.col(position) / STRETCH).cast("long"))


def numbered(df: DataFrame, keys: list[str], position: str, order: list[Column], name: str) -> DataFrame:
    """Rows with their number from 0 in ``order`` (which starts with ``position``) within ``keys``."""
    rows = _stretched(df, position)
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order))
    return rows.withColumn("_r", inside).join(counts, [*keys, "_s"]).withColumn(name, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_s", "_r", "_before")


def running_max(df: DataFrame, keys: list[str], position: str, order: list[Column], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Rows with the greatest ``value`` up to (or before) them in ``order`` within ``keys``."""
    rows = _stretched(df, position).withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "_s").agg(F.max("_v").alias("_m")).withColumn("_c", F.max("_m").over(before)).drop("_m")
    w = Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumn("_i", F.max("_v").over(w)).join(carried, [*keys, "_s"]).withColumn(name, F.greatest("_c", "_i")).drop("_s", "_v", "_c", "_i")


def islands(df: DataFrame, keys: list[str], position: str, order: list[Column], reach: Column, name: str) -> DataFrame:
    """Rows with the position of their island's first row; an island ends where no earlier row's ``reach`` gets."""
    seen = running_max(df, keys, position, order, reach, "_seen", inclusive=False)
    opens = F.when(F.col("_seen").isNull() | (F.col(position) > F.col("_seen")), F.col(position))
    return running_max(seen, keys, position, order, opens, name).drop("_seen")


def _level(length: Column) -> Column:
    """The level whose bins are as wide as ``length``, or wider: BIN bases, and WIDER times that at each further level."""
    return F.least(F.greatest(F.ceil(F.log(float(WIDER), F.greatest(length, F.lit(1)) / BIN)), F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def _width(level: Column) -> Column:
    return (F.lit(BIN) * F.pow(F.lit(float(WIDER)), level)).cast("long")


def containing(points: DataFrame, segments: DataFrame, start: str, end: str) -> DataFrame:
    """Pairs of ``points`` (contig, ``start``, ``end``) and ``segments`` (contig, begin_pos, end_pos) that contain them.

    A segment goes into the one or two bins that it touches at the level of its length; a point looks into the bin of its
    start at each level, so each pair is met once, and no segment makes many rows.
    """
    level = _level(F.col("end_pos") - F.col("begin_pos"))
    sized = segments.select("contig", F.col("begin_pos").alias("_b"), F.col("end_pos").alias("_e"), level.alias("_level"))
    width = _width(F.col("_level"))
    held = sized.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_b") / width), F.floor(F.greatest("_e", "_b") / width))))
    asked = points.withColumn("_level", F.explode(F.array(*map(F.lit, range(LEVELS))))).withColumn("_bin", F.floor(F.col(start) / _width(F.col("_level"))))
    return asked.join(held, ["contig", "_level", "_bin"]).filter((F.col("_b") <= F.col(start)) & (F.col("_e") >= F.col(end))).drop("_bin", "_level")


def running_count(df: DataFrame, keys: list[str], position: str, order: list[Column], counted: Column, name: str) -> DataFrame:
    """Rows with how many rows up to them in ``order`` within ``keys`` are ``counted``."""
    rows = _stretched(df, position).withColumn("_v", F.when(counted, 1).otherwise(0))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "_s").agg(F.sum("_v").alias("_m")).withColumn("_c", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    w = Window.partitionBy(*keys, "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_i", F.sum("_v").over(w)).join(carried, [*keys, "_s"]).withColumn(name, (F.col("_c") + F.col("_i")).cast("long")).drop("_s", "_v", "_c", "_i")
