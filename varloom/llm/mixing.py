"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source has the copy count target / size of its source.  The whole part is taken; the fraction is
a probability.  Two documents with fractional probabilities meet and move words between them, in a random
direction whose expected change is zero, until one probability is 0 or 1.  Each document keeps its probability, and
the words that a source takes stay at their target but for the one document that remains.

The pairing is a reduction tree: documents are dealt into groups by hash, each group leaves one unresolved
document per source at most, and these go to the next level's groups, until one remains per source.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder
from varloom.llm.common import by_group, lookup, word_count

#: Documents of a group of the tree.
GROUP = 4096
#: A target is at most so many times its source's size.
MOST = 3
#: Probabilities this near to 0 or 1 are integral.
TINY = 1e-9


def targets(sizes: DataFrame, folder: str) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, source_size), one row per source.

    Sources in order of code points, null last, weigh 1, 2, 3, repeating.  Targets share all words by weight;
    those above MOST times their source's size stop there, and the rest is shared anew until none is above.
    """
    ranked = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranked = materialize(ranked.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1] % 3 + 1)).toDF("source string, source_size long, weight long"), folder, "weights")
    share = ranked.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    level = (share["t"] or 0) / max(share["w"] or 1, 1)
    while True:
        # sources whose weighted share is above their limit
        above = F.col("weight") * level > MOST * F.col("source_size")
        now = ranked.agg(
            F.sum(F.when(above, MOST * F.col("source_size")).otherwise(0)).alias("held"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("w")
        ).first()
        new = ((share["t"] or 0) - (now["held"] or 0)) / now["w"] if now["w"] else level
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(float(level)), (MOST * F.col("source_size")).cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def settle(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> int | None:
    """Make ``p`` integral in place, all but one entry at most, and return that entry's index.

    Pairs move words until one of the two is integral.  A document so much larger than all later ones that
    pairs with them wouldn't decide it moves words to or from all of them at once, in proportion.
    """
    n = len(p)

    def spread() -> np.ndarray:
        return np.append(np.cumsum((size**2 * p * (1 - p))[::-1])[::-1], 0.0)

    rest, current, i = spread(), None, 0
    while True:
        if current is None:
            if i >= n:
                return None
            current, i = i, i + 1
        if p[current] < TINY or p[current] > 1 - TINY:
            p[current], current = round(p[current]), None
            continue
        if i >= n:
            return current
        s, q = size[current], p[current]
        if s * s * q * (1 - q) > rest[i] / 4:
            later, have = p[i:], size[i:]
            give, take = (have * later).sum(), (have * (1 - later)).sum()
            if give >= s * (1 - q) and take >= s * q:
                if rng.random() < q:
                    p[current] = 1.0
                    later *= 1 - s * (1 - q) / give
                else:
                    p[current] = 0.0
                    later += (1 - later) * (s * q / take)
                rest, current = spread(), None
                continue
        other, i = i, i + 1
        t, r = size[other], p[other]
        up, down = min(s * (1 - q), t * r), min(s * q, t * (1 - r))
        moved = up if rng.random() * (up + down) < down else -down
        p[current], p[other] = q + moved / s, r - moved / t
        for k in (current, other):
            if p[k] < TINY or p[k] > 1 - TINY:
                p[k] = round(p[k])
        current = current if 0 < p[current] < 1 else other if 0 < p[other] < 1 else None


def _fold(seed: int, level: int):
    """Settle one group of (source_key, group, row_key, size, p)."""

    def run(table: pa.Table) -> pa.RecordBatch:
        keys, size = table["row_key"].to_numpy(), table["size"].to_numpy()
        order = np.lexsort((keys, -size))
        keys, size = keys[order], size[order]
        p = table["p"].to_numpy()[order].copy()
        source, group = table["source_key"][0].as_py(), table["group"][0].as_py()
        left = settle(size.astype(np.float64), p, np.random.default_rng([seed, level, source & 0xFFFFFFFF, group]))
        done = np.ones(len(p), bool)
        if left is not None:
            done[left] = False
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(p), source)), pa.array(keys), pa.array(size), pa.array(p), pa.array(done)], names=["source_key", "row_key", "size", "p", "done"])

    return run


def mix(docs: DataFrame, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``docs`` has doc_id, text and source.  Sizes are words; a null text has none, and a document without
    words takes no copy.  copies is the whole or the next whole number of target / source_size; taken is copies times
    size.  The result depends on the rows and the seed alone: rows that share doc_id, source and size are
    decided together, as one document of their joint size.
    """
    folder = shared_folder(docs.sparkSession)
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), folder, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, folder)
    # null is a source of its own, and joins as one
    tagged = goal.select(F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("source_key"), "source_size", "target")
    keyed = rows.withColumn("source_key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    full = lookup(keyed, tagged, ["source_key"])
    full = full.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(F.lit(0.0)))
    full = materialize(full.withColumn("row_key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "source_key", "size")), folder, "rated")
    part = F.col("rate") - F.floor("rate")
    left = (
        full.filter((F.col("size") > 0) & (part > 1e-9) & (part < 1 - 1e-9))
        .groupBy("source_key", "row_key")
        .agg(F.sum("size").alias("size"), F.first(part).alias("p"))
    )
    left = materialize(left, folder, "left-0")
    decided, level = [], 0
    while True:
        # each source has as many groups as its undecided documents need
        held = materialize(left.groupBy("source_key").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("long").alias("groups")), folder, f"groups-{level}")
        most = held.agg(F.max("groups")).first()[0]
        if not most:
            break
        deal = F.pmod(F.xxhash64("row_key", F.lit(level)), F.col("groups")).cast("long")
        dealt = lookup(left, held, ["source_key"]).withColumn("group", deal)
        dealt = dealt.select("source_key", "group", "row_key", "size", "p")
        out = by_group(dealt, ["source_key", "group"], _fold(seed, level), "source_key long, row_key long, size long, p double, done boolean")
        out = materialize(out, folder, f"level-{level}")
        decided.append(out.filter("done").select("row_key", "p"))
        left = out.filter("not done").select("source_key", "row_key", "size", "p")
        if most == 1:
            # one document per source remains at most: rounded, it keeps the source nearest to its target
            decided.append(left.select("row_key", F.round("p").alias("p")))
            break
        level += 1
    whole = F.when(part < 1 - 1e-9, F.floor("rate")).otherwise(F.floor("rate") + 1)
    if decided:
        extra = decided[0]
        for more in decided[1:]:
            extra = extra.unionByName(more)
        full = full.join(extra.withColumnRenamed("p", "extra"), "row_key", "left")
    else:
        full = full.withColumn("extra", F.lit(0.0))
    copies = F.when(F.col("size") > 0, whole + F.coalesce("extra", F.lit(0.0))).otherwise(F.lit(0)).cast("long")
    full = full.withColumn("copies", copies)
    return full.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
