"""Toxicity scores: logistic regression over character n-grams scaled by naive Bayes log-count ratios.

N-grams lie inside lower-cased words with their boundaries and are hashed into BUCKETS buckets.  A document's feature is 1
where it has the n-gram, times the n-gram's log-count ratio between toxic and other documents.

The model is fitted on a bounded sample of labelled rows: at most TOXIC_ROWS and OTHER_ROWS documents,
those with the smallest hashes of their ids, whatever the size of the corpus.  Every n-gram of these is kept.  The sample's
features are a Spark table; each step of the fit (L-BFGS) sums the tasks' gradients.  Scoring covers every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.cluster import materialize, shared_folder
from varloom.llm.common import beside, column, list_array

ORDERS = (4, 5, 6)
#: Bounds of the labelled sample; bits of an n-gram's bucket.
TOXIC_ROWS, OTHER_ROWS, BUCKET_BITS = 4_000, 8_000, 22
BUCKETS = 1 << BUCKET_BITS
#: Standard errors by which log-count ratios are drawn to 0; weight of the squared coefficients against one document's loss;
#: steps, and pairs of steps that L-BFGS remembers.
ERRORS, RIDGE, STEPS, MEMORY = 1.0, 0.3, 10, 6
#: Buckets of which one row of a gradient holds the sums.
STRIP = 1 << 16


def gram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the character n-grams of a text's words, boundaries included; repeats too."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(codes):
        return np.zeros(0, np.uint64)
    codes = np.concatenate((np.full(1, 32, np.uint64), codes, np.full(1, 32, np.uint64)))
    gap = (codes == 32) | ((codes >= 9) & (codes <= 13))
    codes[gap] = 32
    gaps = np.concatenate(([0], np.cumsum(gap)))
    out = []
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            continue
        h = np.full(n, order, np.uint64)
        for i in range(order):
            h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        # no white space but at the two ends
        inner = gaps[order - 1 : order - 1 + n] - gaps[1 : 1 + n]
        out.append(h[inner == 0])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def buckets(text: str) -> np.ndarray:
    """The distinct buckets of a text's n-grams, ascending."""
    found = np.sort((gram_hashes(text) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
    return found[np.diff(found, prepend=-1) > 0]


@dataclass
class Model:
    """Buckets with weights (ratio times coefficient), and the intercept."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        """The weights of all buckets."""
        full = np.zeros(BUCKETS, np.float32)
        full[self.places] = self.weights
        return full

    def score(self, text: str, table: np.ndarray) -> float:
        found = (gram_hashes(text) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        found = np.sort(found[table[found] != 0])
        z = self.bias + table[found[np.diff(found, prepend=-1) > 0]].sum(dtype=np.float64)
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def _sample(docs: DataFrame, labels: DataFrame, learn: Column, folder: str) -> DataFrame:
    """(doc_id, toxic, text) of the bounded sample."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(learn)
    order = F.xxhash64("doc_id", F.lit(5))
    toxic = known.filter("toxic = 1").orderBy(order, "doc_id").limit(TOXIC_ROWS)
    other = known.filter("toxic <> 1").orderBy(order, "doc_id").limit(OTHER_ROWS)
    ids = materialize(toxic.unionByName(other), folder, "sample-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    return materialize(rows.select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")), folder, "sample")


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """Fit on the sample of ``docs`` (doc_id, text) whose ``labels`` (doc_id, toxic) may be learned.

    ``learn`` is a condition on doc_id.  A document with several labels is toxic if any of them says so; null
    labels count for nothing; of several rows with a doc_id one is learned from.  Without labels of both kinds all scores are
    the share of toxic labels, or 0.
    """
    folder = shared_folder(docs.sparkSession)
    rows = _sample(docs, labels, learn, folder)

    def extract(batches):
        for batch in batches:
            found = [buckets(t.as_py()) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "toxic"), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "f"])

    features = materialize(rows.mapInArrow(extract, "toxic int, f array<int>"), folder, "features")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ups, downs = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    base = labels.filter(learn & F.col("toxic").isNotNull()).agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()["p"]
    if not ups or not downs:
        p = min(max(base or 0.0, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(p / (1 - p))))
    places, up, down = _counts(features)
    ratio = np.log((up + 1) / (ups + 2)) - np.log((down + 1) / (downs + 2))
    ratio = np.sign(ratio) * np.maximum(0, np.abs(ratio) - ERRORS * np.sqrt(1 / (up + 1) + 1 / (down + 1)))
    places, ratio = places[ratio != 0], ratio[ratio != 0]
    features = materialize(_numbered(features, places), folder, "numbered")
    # each kind weighs as much as among all labels
    weight = np.maximum(1e-3, [(1 - base) * (ups + downs) / downs, base * (ups + downs) / ups]) / (ups + downs)
    w, b = _fitted(features, ratio, weight, float(np.log(max(base, 1e-6) / max(1 - base, 1e-6))), RIDGE / (ups + downs))
    return Model(places, (ratio * w).astype(np.float32), b)


def _parts(batches):
    """(whether toxic, each feature's row, features) of each batch."""
    for batch in batches:
        y = (np.asarray(column(batch, "toxic")) == 1).astype(np.float64)
        f = column(batch, "f")
        o = f.offsets.to_numpy()
        yield y, np.repeat(np.arange(len(y)), np.diff(o)), f.values.to_numpy()[o[0] : o[-1]]


def _counts(features: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, toxic documents, other documents) of all buckets that a document has.

    Tasks count in memory and send strips of buckets, which are added up by strip.
    """
    names, schema = ["lo", "at", "up", "down"], "lo long, at array<int>, up array<long>, down array<long>"

    def strip(lo: int, up: np.ndarray, down: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(up + down)
        values = ([lo], [at.astype(np.int32)], [up[at]], [down[at]])
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    def run(batches):
        up, down = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for y, row, f in _parts(batches):
            toxic = y[row] == 1
            up += np.bincount(f[toxic], minlength=BUCKETS)
            down += np.bincount(f[~toxic], minlength=BUCKETS)
        for lo in range(0, BUCKETS, STRIP):
            yield strip(lo, up[lo : lo + STRIP], down[lo : lo + STRIP])

    def add(key, table):
        up, down = np.zeros(STRIP, np.int64), np.zeros(STRIP, np.int64)
        for at, a, b in zip(table["at"], table["up"], table["down"], strict=True):
            up[at.values] += a.values.to_numpy()
            down[at.values] += b.values.to_numpy()
        return pa.Table.from_batches([strip(key[0].as_py(), up, down)])

    out = []
    for batch in features.mapInArrow(run, schema).groupBy("lo").applyInArrow(add, schema).toArrow().to_batches():
        for lo, at, a, b in zip(*(column(batch, n) for n in names), strict=True):
            out.append((at.values.to_numpy() + lo.as_py(), a.values.to_numpy(), b.values.to_numpy()))
    places, up, down = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(places)
    return places[order], up[order], down[order]


def _numbered(features: DataFrame, places: np.ndarray) -> DataFrame:
    """``features`` as numbers of ``places``, without other buckets."""
    send = features.sparkSession.sparkContext.broadcast(places)

    def run(batches):
        number = np.full(BUCKETS, -1, np.int32)
        number[send.value] = np.arange(len(send.value), dtype=np.int32)
        for batch in batches:
            for y, row, f in _parts([batch]):
                at = number[f]
                size = np.bincount(row[at >= 0], minlength=len(y))
                yield pa.RecordBatch.from_arrays([column(batch, "toxic"), list_array(at[at >= 0], np.concatenate(([0], np.cumsum(size))), pa.int32())], names=["toxic", "f"])

    return features.mapInArrow(run, features.schema)


def _fitted(features: DataFrame, ratio: np.ndarray, weight: np.ndarray, start: float, ridge: float) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of the ridge logistic regression, by L-BFGS.

    A step asks the tasks for the loss and gradient at one point, which the sample bounds; the intercept is the last coefficient.
    """
    spark = features.sparkSession
    n = len(ratio)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        send = spark.sparkContext.broadcast((ratio * x[:-1], float(x[-1])))

        def run(batches):
            w, b = send.value
            grad, lost, slope = np.zeros(n), 0.0, 0.0
            for y, row, f in _parts(batches):
                z = b + np.bincount(row, weights=w[f], minlength=len(y))
                share = weight[y.astype(np.int64)]
                g = share * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
                lost += float((share * (np.logaddexp(0, z) - y * z)).sum())
                slope += float(g.sum())
                grad += np.bincount(f, weights=g[row], minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array([grad.tobytes()]), pa.array([lost]), pa.array([slope])], names=["grad", "lost", "slope"])

        total, lost, slope = np.zeros(n), 0.0, 0.0
        for r in features.mapInArrow(run, "grad binary, lost double, slope double").collect():
            total += np.frombuffer(r["grad"])
            lost, slope = lost + r["lost"], slope + r["slope"]
        send.unpersist()
        grad = np.append(total * ratio + ridge * x[:-1], slope)
        return lost + ridge / 2 * float(x[:-1] @ x[:-1]), grad

    x = np.append(np.zeros(n), start)
    value, grad = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        step = -_curved(grad, moves)
        size = 1.0 if moves else min(1.0, 1.0 / max(np.linalg.norm(grad), 1e-12))
        for _ in range(5):
            new, new_grad = loss(x + size * step)
            if new <= value + 1e-4 * size * float(grad @ step):
                break
            size /= 4
        else:
            break
        if float(size * step @ (new_grad - grad)) > 1e-12:
            moves = [*moves[1 - MEMORY :], (size * step, new_grad - grad)]
        done = value - new < 1e-5 * max(value, 1e-9)
        x, value, grad = x + size * step, new, new_grad
        if done:
            break
    return x[:-1], float(x[-1])


def _curved(grad: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient by the inverse curvature that the last moves show."""
    q, rates = grad.copy(), []
    for s, y in reversed(moves):
        rates.append(float(s @ q) / float(s @ y))
        q -= rates[-1] * y
    if moves:
        s, y = moves[-1]
        q *= float(s @ y) / float(y @ y)
    for (s, y), rate in zip(moves, reversed(rates), strict=True):
        q += s * (rate - float(y @ q) / float(s @ y))
    return q


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5), from the text alone; a null text is empty."""
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = send.value
        table = m.table()
        for batch in batches:
            score = np.array([m.score(t.as_py() or "", table) for t in column(batch, "_t")])
            keep = [n for n in batch.schema.names if n != "_t"]
            yield pa.RecordBatch.from_arrays(
                [column(batch, n) for n in keep] + [pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=[*keep, "score", "predicted"]
            )

    rows, fields, names = beside(docs, "text", "score", "predicted")
    return rows.mapInArrow(run, T.StructType(fields).add("score", "double").add("predicted", "integer")).toDF(*names, "score", "predicted")
