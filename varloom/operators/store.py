"""What a scan finds, stored for calls to start from: coverage windows, primary segments and signatures, by contig.

A store knows the parameters that it was made with, and is refused when others are asked for.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.params import Params

TABLES = ("windows", "segments", "signatures")
#: Raised when the tables' columns or meaning change.
FORMAT = 1
# Parameters that a scan depends on; clustering, cut-offs and genotypes may change over one store.
SCAN = ("min_sv_len", "min_mapq", "min_template", "merge_distance", "merge_portion", "window", "ins_clip_tolerance", "omni_a", "omni_b", "omni_edges", "omni_relevant", "omni_ratio")


def fingerprint(p: Params, **more: str) -> str:
    """A digest of what a scan depends on; ``more`` may name its sources and reference."""
    values = {k: v for k, v in asdict(p).items() if k in SCAN} | {"format": FORMAT} | more
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()


def save(path: str, p: Params, windows: DataFrame, segments: DataFrame, signatures: DataFrame, **more: str) -> None:
    """Write the three tables (all with contig) below ``path``, a folder for each contig.  The fingerprint comes last: a store without is none."""
    spark = windows.sparkSession
    for name, table in zip(TABLES, (windows, segments, signatures), strict=True):
        # rows of a contig go to as many tasks as they need, not to one
        table.repartition("contig", F.floor(F.col("w" if name == "windows" else "begin_pos") / 1_000_000)).write.mode("overwrite").partitionBy("contig").parquet(f"{path}/{name}")
    spark.createDataFrame([(fingerprint(p, **more),)], "fingerprint string").coalesce(1).write.mode("overwrite").json(f"{path}/fingerprint")


def load(spark: SparkSession, path: str, p: Params, contigs: list[str] | None = None, **more: str) -> dict[str, DataFrame]:
    """The tables of a store, or of some of its ``contigs``: only their folders are read.  ValueError if it was made with other parameters."""
    held = spark.read.schema("fingerprint string").json(f"{path}/fingerprint").first()
    if held is None or held[0] != fingerprint(p, **more):
        raise ValueError(f"the store at {path} was made with other parameters")
    tables = {name: spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}") for name in TABLES}
    if contigs is not None:
        tables = {name: t.filter(F.col("contig").isin(contigs)) for name, t in tables.items()}
    return {name: t.withColumn("contig", F.col("contig").cast("string")) for name, t in tables.items()}
