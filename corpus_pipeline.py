"""The corpus pipeline: its stages run one after the other over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``.  ``run`` writes what each stage returns and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder, ship_package
from varloom.llm import langid, mixing, pieces, pii
from varloom.llm.common import crc_rest
from varloom.llm.minhash import near_duplicates

#: Documents of a batch that goes to Python: few enough for a batch of long texts to stay small.
BATCH_DOCS = 2_000


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_DOCS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that are as near to all languages' codewords as to any."""
    _prepare(spark)
    model = langid.train(docs, crc_rest(F.col("doc_id"), 3) != 1)
    found = langid.predict(docs, model)
    even = F.col("ambiguous") & (F.col("score") * len(model.languages) < 1.2)
    return found.filter((F.col("lang_pred") != "und") & ~even).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id, once.

    Groups are those of five-word shingles and a similarity of at least 0.8.  A row without a doc_id goes by its text, behind
    all that have one.  Of rows that share a doc_id one for each different text stays, if the doc_id does.
    """
    _prepare(spark)
    text = F.xxhash64("text")
    behind = text.bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), behind), "_text": text})
    near = near_duplicates(keyed.select(F.col("_id").alias("doc_id"), "text"), words=5, percent=80)
    kept = near.filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return keyed.join(kept, "_id", "left_semi").dropDuplicates(["_id", "_text"]).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets; n_chars follows the new text."""
    _prepare(spark)
    found = pii.find(docs)
    return found.withColumn("text", F.col("masked")).withColumn("n_chars", F.length("masked").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as often as the mix takes it; those that it doesn't take go."""
    _prepare(spark)
    copies = mixing.mix(docs).filter("copies > 0").select("doc_id", "copies")
    taken = docs.join(copies, docs["doc_id"].eqNullSafe(copies["doc_id"])).drop(copies["doc_id"])
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces' ids and the figures of the best segmentations."""
    _prepare(spark)
    return pieces.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", deduplicate),
    ("personal_data", mask_personal_data),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL expresses neither the classifiers nor the lattice search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages, each written and read again."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, folder, name)
    return docs
