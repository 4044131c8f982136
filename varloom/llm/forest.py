"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Each tree splits the unit vectors at the median of a random projection, down to leaves of LEAF_ROWS vectors or MAX_DEPTH
levels.  The splits are fitted on a bounded hash sample of about SAMPLE_ROWS vectors, so that trees can be broadcast; every
row is indexed.

A query descends all trees through one shared priority queue, nearest boundary first, until its leaves hold enough
candidates; these are reranked by the exact cosine.  Rows with equal vectors are one candidate with its smallest ids, so
copies neither crowd a leaf nor are lost.  Every cut to the best goes by the exact cosine and then the smaller id, so ties
are kept as they must be.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder
from varloom.llm.common import by_group, column, lists

#: Trees, rows of a leaf aimed at, most levels, rows of the sample.
TREES, LEAF_ROWS, MAX_DEPTH, SAMPLE_ROWS = 16, 64, 8, 20_000
#: A query's leaves hold as many rows as this share of all (a row counts once per tree that finds it).
SEARCH_SHARE = 1.0
#: Rows and queries of a leaf that one task compares; pairs measured exactly at once; a margin above rounding.
PART_ROWS, PART_QUERIES, EXACT_PAIRS, MARGIN = 4_096, 1_024, 1 << 16, 1e-9


@dataclass
class Tree:
    """Inner nodes by level order: a plane and a threshold each; leaves are numbered from the left."""

    depth: int
    planes: np.ndarray
    cuts: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            right = np.einsum("ij,ij->i", x, self.planes[node]) > self.cuts[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def grow(sample: np.ndarray, depth: int, seed: int) -> Tree:
    """A tree whose planes are random directions, cut at the sample's medians."""
    rng = np.random.default_rng(seed)
    inner = (1 << depth) - 1
    dim = sample.shape[1]
    planes, cuts = np.zeros((inner, dim), np.float32), np.zeros(inner, np.float32)
    held = {0: np.arange(len(sample))}
    for node in range(inner):
        rows = held.pop(node, np.zeros(0, np.int64))
        if len(rows) >= 2:
            # the direction from one point to another, which follows the data's spread
            a, b = sample[rng.choice(rows, 2, replace=False)]
            plane = a - b
        else:
            plane = rng.standard_normal(dim)
        size = np.linalg.norm(plane)
        plane = plane / size if size > 0 else rng.standard_normal(dim) / np.sqrt(dim)
        z = sample[rows] @ plane
        cut = float(np.median(z)) if len(rows) else 0.0
        planes[node], cuts[node] = plane, cut
        held[2 * node + 1], held[2 * node + 2] = rows[z <= cut], rows[z > cut]
    return Tree(depth, planes, cuts)


def search(trees: list[Tree], sizes: list[np.ndarray], x: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """(tree, leaf) pairs for one query, most promising first, until they hold ``wanted`` rows."""
    margins = [(t.planes @ x - t.cuts).tolist() for t in trees]
    queue = [(-np.inf, k, 0) for k in range(len(trees))]
    found, held = [], 0
    while queue and held < wanted:
        worst, k, node = heapq.heappop(queue)
        first = (1 << trees[k].depth) - 1
        while node < first:
            m = margins[k][node]
            near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (max(worst, abs(m)), k, far))
            node = near
        if sizes[k][node - first]:
            found.append((k, node - first))
            held += int(sizes[k][node - first])
    return found


def _unit(values: np.ndarray) -> np.ndarray:
    return (values / np.linalg.norm(values, axis=1, keepdims=True)).astype(np.float32)


def _matrix(array: pa.Array) -> np.ndarray:
    values, offsets = lists(array)
    return values.astype(np.float64).reshape(len(offsets) - 1, -1) if len(offsets) > 1 else np.zeros((0, 1))


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector isn't null, empty or zero and has finite components only."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, search_share: float = SEARCH_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` nearest other rows found, by cosine.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id.  Ties go to the smaller vec_id.  Vectors that
    are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id.  The cosine is
    that of vectors of one length, so rows of each length are searched apart.  Rows that share a vec_id are one row; of
    different vectors it has the least, component by component.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    rows = usable(vectors, "embedding").filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumns({"key": F.xxhash64("v"), "key2": F.hash("v")})
    rows = materialize(rows, folder, "rows")
    lengths = [r["d"] for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_nearest(rows.filter(F.size("v") == d), d, is_query, k, search_share, f"{folder}/{d}") for d in lengths]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(rows: DataFrame, length: int, is_query: Column, k: int, search_share: float, folder: str) -> DataFrame:
    """(query_id, vec_id, score): all rows of one length that may be among the ``k`` nearest.

    A class of equal vectors goes by its smallest id.  A query's own class may hold nothing but itself, so k + 1 classes
    and k + 1 ids of each are enough.
    """
    spark = rows.sparkSession
    element = rows.schema["v"].dataType.elementType.simpleString()
    distinct = materialize(rows.groupBy("key", "key2", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("vec_id")), folder, "distinct")
    total = distinct.count()
    part = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 24)) < int((1 << 24) * min(1.0, SAMPLE_ROWS / total))
    picked = distinct.filter(part).select("vec_id", "v").orderBy("vec_id").limit(2 * SAMPLE_ROWS).collect()
    sample = _unit(np.array([r["v"] for r in picked], dtype=np.float64).reshape(-1, length))
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(total / LEAF_ROWS, 1))))))
    trees = [grow(sample, depth, seed) for seed in range(TREES)]
    forest = spark.sparkContext.broadcast(trees)

    def index(batches):
        for batch in batches:
            x = _unit(_matrix(column(batch, "v")))
            for t, tree in enumerate(forest.value):
                place = pa.array(tree.leaves(x).astype(np.int32))
                yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "v"), pa.array(np.full(len(x), t, np.int32)), place], names=["vec_id", "v", "tree", "leaf"])

    placed = distinct.select("vec_id", "v").mapInArrow(index, f"vec_id long, v array<{element}>, tree int, leaf int")
    sizes = [np.zeros(1 << depth, np.int64) for _ in trees]
    for r in placed.groupBy("tree", "leaf").count().collect():
        sizes[r["tree"]][r["leaf"]] = r["count"]
    known = spark.sparkContext.broadcast(sizes)
    wanted = int(np.ceil(search_share * total))

    def descend(batches):
        for batch in batches:
            x, own, v = _unit(_matrix(column(batch, "v"))), column(batch, "vec_id"), column(batch, "v")
            for i in range(len(x)):
                t, leaf = (np.array(c, np.int32) for c in zip(*search(forest.value, known.value, x[i], wanted), strict=True))
                same = pa.array(np.full(len(t), i))
                yield pa.RecordBatch.from_arrays([own.take(same), v.take(same), pa.array(t), pa.array(leaf)], names=["vec_id", "v", "tree", "leaf"])

    queries = materialize(rows.filter(is_query).select("vec_id", "v"), folder, "queries")
    # the rows are few and small, but the descents are work: they are dealt to as many tasks as any shuffle's
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    visits = queries.repartition(tasks, "vec_id").mapInArrow(descend, f"vec_id long, v array<{element}>, tree int, leaf int")
    asked = visits.groupBy("tree", "leaf").count().collect()
    if not asked:
        return spark.createDataFrame([], "query_id long, vec_id long, score double")
    # at most trees times leaves rows: how many parts each leaf's rows and queries make
    plan = [(r["tree"], r["leaf"], -(-int(sizes[r["tree"]][r["leaf"]]) // PART_ROWS), -(-r["count"] // PART_QUERIES)) for r in asked]
    plan = F.broadcast(spark.createDataFrame(plan, "tree int, leaf int, parts int, asks int"))
    here, ask = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("vec_id"), F.col("asks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["tree", "leaf", "part", "ask", "kind", "vec_id", "v"]
    kept = placed.join(plan, ["tree", "leaf"]).withColumn("part", here).withColumn("ask", every("asks")).withColumn("kind", F.lit(0)).select(*cols)
    sent = visits.join(plan, ["tree", "leaf"]).withColumn("ask", ask).withColumn("part", every("parts")).withColumn("kind", F.lit(1)).select(*cols)
    found = by_group(kept.unionByName(sent), ["tree", "leaf", "part", "ask"], _compare(k + 1), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.distinct().withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")
    top = materialize(top.join(distinct.select("vec_id", "n", "key", "key2"), "vec_id"), folder, "top")
    first = Window.partitionBy("key", "key2").orderBy("vec_id")
    copied = rows.select("key", "key2", "vec_id").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).drop("r")
    several = top.filter("n > 1").select("query_id", "key", "key2", "score").join(copied, ["key", "key2"])
    cols = ["query_id", "vec_id", "score"]
    return top.filter("n = 1").select(*cols).unionByName(several.select(*cols)).filter("vec_id <> query_id")


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _compare(keep: int):
    """The best rows of a part of a leaf for each query of a part: by the exact cosine, then by the smaller id.

    The product of unit vectors tells all but those within rounding of the last place apart.
    """

    def run(table: pa.Table) -> pa.RecordBatch | None:
        batch = table.combine_chunks().to_batches()[0]
        kind, ids = np.asarray(column(batch, "kind")), np.asarray(column(batch, "vec_id"))
        x = _matrix(column(batch, "v"))
        rows, asks = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if not len(rows) or not len(asks):
            return None
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit[asks] @ unit[rows].T
        n = min(keep, len(rows))
        least = np.partition(near, len(rows) - n, axis=1)[:, len(rows) - n] - MARGIN
        close = near >= least[:, None]
        out, step = [], max(1, EXACT_PAIRS // len(rows))
        for lo in range(0, len(asks), step):
            q, r = np.nonzero(close[lo : lo + step])
            q, r = asks[q + lo], rows[r]
            score = _cosine(x[q], x[r])
            order = np.lexsort((ids[r], -score, q))
            q, r, score = q[order], r[order], score[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            out.append((ids[q[place < keep]], ids[r[place < keep]], score[place < keep]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run
