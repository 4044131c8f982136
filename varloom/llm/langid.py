"""Language identification with error-correcting output codes.

Each language has a codeword; a binary n-gram classifier predicts each bit.  Decoding weighs each bit's loss by how
well its classifier does on the language in question, takes the nearest codeword, and flags texts that lie
almost as near to another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm.common import beside, column

#: Hashed n-gram features, and the orders of n-grams.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Labelled documents (a hash sample) from which the bits' reliability is measured, at most about so many.
CALIBRATION_DOCS = 20_000
#: A text is ambiguous if its best two languages' losses differ by less than this share.
AMBIGUOUS = 0.05
#: Smoothing of n-gram counts.
PRIOR = 0.5

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """Feature numbers of a text's n-grams: lower-cased letters, every run of other characters being one space.

    Empty if the text has no letter.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.where(letter, codes, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.concatenate((np.full(1, 32, np.uint64), codes[keep], np.full(1, 32, np.uint64)))
    out = []
    for order in ORDERS:
        if len(codes) < order:
            continue
        h = np.full(len(codes) - order + 1, order, np.uint64)
        for i in range(order):
            h = (h + codes[i : len(codes) - order + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append((h % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(out)


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language: all splits of few languages, else the best of some random codes."""
    if languages <= 6:
        bits = max(1, 2 ** (languages - 1) - 1)
        rows = np.array([[1 if (k + 1 >> i) & 1 else -1 for k in range(bits)] for i in range(max(languages - 1, 0))] + [[-1] * bits], np.int64)
        return rows.reshape(languages, bits)
    bits = int(np.ceil(10 * np.log2(languages)))
    best, distance = None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).choice([-1, 1], (languages, bits))
        apart = (bits - code @ code.T) // 2 + bits * np.eye(languages, dtype=np.int64)
        if apart.min() > distance and (np.abs(code.sum(0)) < languages).all():
            best, distance = code, apart.min()
    return best


@dataclass
class Model:
    """languages, their codewords, a column of n-gram weights per bit, and each bit's weight per language."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray | None:
        """The bits' margins; None without a letter."""
        g = grams(text)
        if not len(g):
            return None
        if len(g) > BUCKETS // 4:
            total = np.bincount(g, minlength=BUCKETS).astype(np.float32) @ self.weights
        else:
            total = self.weights[g].sum(0)
        return np.asarray(total, np.float64) / np.sqrt(len(g))

    def decide(self, text: str) -> tuple[str, float, bool]:
        """(language or und, score, ambiguous)."""
        m = self.margins(text)
        if m is None:
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = (self.trust * np.exp(-np.clip(self.code * (m / self.scale), -4, 4))).sum(1)
        order = np.argsort(loss, kind="stable")
        best, second = loss[order[0]], loss[order[1]]
        share = np.exp(-3 * (loss - best) / max(second, 1e-9))
        return self.languages[order[0]], float(1 / share.sum()), bool(second - best < AMBIGUOUS * second)


def _count(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n): n-gram counts of all rows."""

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(column(batch, "lang"), column(batch, "text"), strict=True):
                lang = lang.as_py()
                g = grams(text.as_py())
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS + 1, np.int64)
                if len(g) > 20_000:
                    totals[lang][:BUCKETS] += np.bincount(g, minlength=BUCKETS)
                else:
                    np.add.at(totals[lang], g, 1)
                totals[lang][BUCKETS] += 1
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn: Column) -> Model:
    """Fit on the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds, text and lang aren't null.

    N-grams are counted over all such rows.  What reaches the driver is BUCKETS counts per language.
    """
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = _count(rows).toPandas()
    languages = sorted(counted["lang"].unique())
    table = np.zeros((len(languages), BUCKETS + 1))
    table[np.searchsorted(languages, counted["lang"]), counted["bucket"]] = counted["n"]
    total, table = table[:, BUCKETS].sum(), table[:, :BUCKETS]
    code = codewords(len(languages)) if languages else np.zeros((0, 1), np.int64)
    share = (table + PRIOR) / (table.sum(1, keepdims=True) + PRIOR * BUCKETS)
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        up, down = share[code[:, b] > 0], share[code[:, b] < 0]
        if len(up) and len(down):
            weights[:, b] = np.log(up.mean(0)) - np.log(down.mean(0))
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))
    if len(languages) > 1:
        part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 20)) < int((1 << 20) * min(1, CALIBRATION_DOCS / max(total, 1)))
        _calibrate(rows.filter(part), model)
    return model


def _calibrate(rows: DataFrame, model: Model) -> None:
    """Each bit's scale, and its share of right signs on each language as weights that sum to 1 per language."""

    def run(batches):
        n = np.zeros(len(model.languages))
        right, size = np.zeros(model.code.shape), np.zeros(model.code.shape)
        for batch in batches:
            for lang, text in zip(column(batch, "lang"), column(batch, "text"), strict=True):
                m = model.margins(text.as_py())
                at = model.languages.index(lang.as_py())
                if m is not None:
                    n[at] += 1
                    right[at] += m * model.code[at] > 0
                    size[at] += np.abs(m)
        yield pa.RecordBatch.from_pydict({"n": [n.tolist()], "right": [right.ravel().tolist()], "size": [size.ravel().tolist()]})

    got = rows.select("lang", "text").mapInArrow(run, "n array<double>, right array<double>, size array<double>")
    parts = [got.select(F.lit(k).alias("kind"), F.posexplode(c).alias("i", "x")) for k, c in enumerate(("n", "right", "size"))]
    flat = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("kind", "i").agg(F.sum("x").alias("x")).collect()
    table = {(r["kind"], r["i"]): r["x"] for r in flat}
    langs, bits = model.code.shape
    n = np.array([table.get((0, i), 0.0) for i in range(langs)])[:, None]
    right, size = (np.array([table.get((k, i), 0.0) for i in range(langs * bits)]).reshape(langs, bits) for k in (1, 2))
    sure = np.clip((right + 1) / (n + 2), 0.05, 1)
    model.trust = sure / sure.sum(1, keepdims=True)
    model.scale = np.maximum(size.sum(0) / max(n.sum(), 1), 1e-6) / 1.5


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous, from the text alone.

    A text that is null or has no letter is und, with score 0; so are all texts if nothing could be learned.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = broadcast.value
        for batch in batches:
            found = [m.decide(t.as_py() or "") if m.languages else ("und", 0.0, False) for t in column(batch, "_t")]
            lang, score, unsure = zip(*found, strict=True) if found else ((), (), ())
            keep = [n for n in batch.schema.names if n != "_t"]
            yield pa.RecordBatch.from_arrays(
                [column(batch, n) for n in keep] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())],
                names=[*keep, "lang_pred", "score", "ambiguous"],
            )

    added = ("lang_pred", "score", "ambiguous")
    rows, fields, names = beside(docs, "text", *added)
    schema = T.StructType(fields).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return rows.mapInArrow(run, schema).toDF(*names, *added)
