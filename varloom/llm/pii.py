"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

The fixed patterns' matches are the seed entities.  Their contexts and those of all words that look like identifiers (with a
digit or a sign inside) make the pattern-instance graph: a lexical pattern is the two words before, the words on both
sides, or the two words after.  In each round a pattern that stands at SUPPORT known entities scores the share of its
occurrences that are believed to be entities; an unseen instance is believed as its best pattern scores, and from
CONFIDENCE on it is an entity that induces patterns in the next round.  Patterns that end above CONFIDENCE find further
identifiers, at places where no fixed pattern matched.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.cluster import materialize, shared_folder
from varloom.llm.common import column, quoted, trim
from varloom.llm.textsets import blocks, mix64, word_bounds, word_hashes

#: Distinct entities that a pattern needs, its least score, and rounds.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.8, 3
#: Bits of a pattern by which words are looked up before the join with all patterns; patterns applied in one pass.
SIEVE_BITS, SLICE = 20, 1 << 20

# The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns' matches, kind by kind."""
    found = []
    if "@" in text:
        found += [(0, *m.span()) for m in EMAIL.finditer(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
                found.append((3, *m.span()))
    return found


_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
#: Bytes of which plain words are made.
_PLAIN = _DIGIT | ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) | (_BYTES >= 128) | (_BYTES == 39) | (_BYTES == 45)
_EDGE = np.isin(_BYTES, list(EDGE.encode()))


class _Words:
    """A block's words: bounds in bytes, rows, hashes, and which of them look like identifiers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.start, self.end, self.row = word_bounds(data, offsets)
        self.hash = word_hashes(data, self.start, self.end)
        plain = _PLAIN[data]
        opens = plain.copy()
        opens[1:] &= ~plain[:-1]
        count = lambda mask: np.concatenate((np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)))
        runs, digits = count(opens), count(_DIGIT[data])
        first = plain[self.start] & ~opens[self.start] if len(self.start) else np.zeros(0, bool)
        self.odd = (runs[self.end] - runs[self.start] + first > 1) | (digits[self.end] > digits[self.start])

    def patterns(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(patterns, whether they exist) around the words from ``first`` to ``last``, a row for each kind of pattern."""
        n = len(self.hash)
        out, there = np.zeros((3, len(first)), np.uint64), np.zeros((3, len(first)), bool)
        for kind, (a, b) in enumerate(((first - 2, first - 1), (first - 1, last + 1), (last + 1, last + 2))):
            ok = (a >= 0) & (b < n)
            ok[ok] &= (self.row[a[ok]] == self.row[first[ok]]) & (self.row[b[ok]] == self.row[first[ok]])
            there[kind] = ok
            out[kind, ok] = mix64(self.hash[a[ok]] * np.uint64(0xD1342543DE82EF95) + mix64(self.hash[b[ok]] + np.uint64(kind)))
        return out.view(np.int64), there

    def instances(self, texts: list[str], first_row: int, spans: list[list[tuple[int, int, int]]]):
        """(seeds, candidates): (row, kind, first word, last word, start, end) of the spans and of other odd words; starts and
        ends are code points."""
        seeds, covered = [], np.zeros(len(self.start), bool)
        for r, found in enumerate(spans):
            if not found:
                continue
            text = texts[first_row + r]
            base = int(self.offsets[r])
            for kind, a, b in found:
                x, y = (a, b) if text.isascii() else (len(text[:a].encode()), len(text[:b].encode()))
                i, j = (int(np.searchsorted(self.start, base + at, side="right")) - 1 for at in (x, y - 1))
                covered[i : j + 1] = True
                if _EDGE[self.data[self.start[i] : base + x]].all() and _EDGE[self.data[base + y : self.end[j]]].all():
                    seeds.append((r, kind, i, j, a, b))
        candidates = []
        for i in np.flatnonzero(self.odd & ~covered).tolist():
            raw = self.data[self.start[i] : self.end[i]].tobytes()
            lead = len(raw) - len(raw.lstrip(EDGE.encode()))
            value = raw.strip(EDGE.encode()).decode("utf-8", "replace")
            kinds = fits(value)
            if kinds:
                r = int(self.row[i])
                text, at = texts[first_row + r], int(self.start[i] - self.offsets[r]) + lead
                at = at if text.isascii() else len(text.encode()[:at].decode("utf-8", "replace"))
                candidates += [(r, kind, i, i, at, at + len(value)) for kind in kinds]
        return seeds, candidates


def fits(value: str) -> list[int]:
    """Numbers of the kinds whose shape an unseen identifier may have."""
    digits, letters = sum(ch.isdigit() for ch in value), sum(ch.isalpha() for ch in value)
    runs = len(re.findall(r"[^\W_]+", value))
    shapes = (letters >= 2 and (runs > 1 or digits > 0), digits >= 4 and digits > letters and runs >= 4, digits >= 12 and digits > letters, 7 <= digits <= 15 and digits > letters)
    return [kind for kind, ok in enumerate(shapes) if ok]


def _identity(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parts(texts: pa.Array):
    """(texts, first row, the words, the fixed patterns' spans) of a batch, block by block."""
    plain = [t or "" for t in texts.to_pylist()]
    for first, end, data, offsets in blocks(texts):
        words = _Words(data, offsets)
        yield plain, first, words, [base_spans(t) for t in plain[first:end]]


def _graph(docs: DataFrame) -> DataFrame:
    """(pattern, kind, entity, seed, n): how often an instance of a kind stands in a pattern."""

    def run(batches):
        for batch in batches:
            for texts, first_row, words, spans in _parts(column(batch, "text")):
                seeds, candidates = words.instances(texts, first_row, spans)
                both = seeds + candidates
                if not both:
                    continue
                row, kind, first, last, a, b = (np.array(c, np.int64) for c in zip(*both, strict=True))
                pattern, there = words.patterns(first, last)
                entity = np.array([_identity(texts[first_row + r][x:y]) for r, x, y in zip(row.tolist(), a.tolist(), b.tolist(), strict=True)], np.int64)
                seed = np.arange(len(both)) < len(seeds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*((pattern[k][ok], kind[ok].astype(np.int32), entity[ok], seed[ok]) for k, ok in enumerate(there)), strict=True)],
                    names=["pattern", "kind", "entity", "seed"],
                )
        trim()

    found = docs.select("text").mapInArrow(run, "pattern long, kind int, entity long, seed boolean")
    return found.groupBy("pattern", "kind", "entity").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))


def _totals(docs: DataFrame, patterns: DataFrame, folder: str) -> DataFrame:
    """(pattern, total) of ``patterns``: at how many words of all texts each stands.

    Words pass by some bits of their patterns, a bounded table, and are counted and then joined with the patterns themselves.
    """
    low = F.col("pattern").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    bits = patterns.select(low.alias("low")).distinct().toPandas()["low"].to_numpy(np.int64)
    send = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[send.value] = True
        for batch in batches:
            for _, _, data, offsets in blocks(column(batch, "text")):
                words = _Words(data, offsets)
                every = np.arange(len(words.start))
                pattern, there = words.patterns(every, every)
                found, n = np.unique(pattern[there & sieve[pattern & ((1 << SIEVE_BITS) - 1)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["pattern", "n"])
        trim()

    found = docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return found.join(patterns, "pattern", "left_semi")


def learn(docs: DataFrame) -> DataFrame:
    """(pattern, kind, score): the confident patterns of ``docs`` (text), each with the number of the kind that it finds."""
    folder = shared_folder(docs.sparkSession)
    graph = materialize(_graph(docs), folder, "graph")
    able = materialize(graph.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= SUPPORT).select("pattern", "kind"), folder, "able")
    totals = materialize(_totals(docs, able.select("pattern").distinct(), folder), folder, "totals")
    # a pattern or an entity may have most rows; such joins are split by the engine, as the other side has one row for each
    edges = materialize(graph.join(able.join(totals, "pattern"), ["pattern", "kind"]), folder, "edges")
    scored = None
    for r in range(ROUNDS + 1):
        if scored is None:
            known = edges.withColumn("belief", F.lit(0.0))
        else:
            best = edges.filter("not seed").join(scored, ["pattern", "kind"]).groupBy("entity", "kind").agg(F.max("score").alias("belief"))
            known = edges.join(best, ["entity", "kind"], "left")
        known = known.withColumn("belief", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0))))
        scored = known.groupBy("pattern", "kind").agg(
            F.count_if(F.col("belief") >= CONFIDENCE).alias("support"), F.sum(F.col("n") * F.col("belief")).alias("hits"), F.sum("n").alias("n"), F.first("total").alias("total")
        )
        score = F.when(F.col("support") >= SUPPORT, F.col("hits") / F.greatest("n", "total")).otherwise(0.0)
        scored = materialize(scored.select("pattern", "kind", score.alias("score")), folder, f"scores-{r}")
    best = F.max_by("kind", F.struct("score", -F.col("kind")))
    return materialize(scored.filter(F.col("score") >= CONFIDENCE).groupBy("pattern").agg(best.alias("kind"), F.max("score").alias("score")), folder, "confident")


def all_spans(texts: list[str], first_row: int, words: _Words, base: list[list[tuple[int, int, int]]], sure: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int, int, int, float]]:
    """(row, kind, start, end, score) of the candidates in one of the patterns ``sure`` (sorted; kinds; scores)."""
    if not len(sure[0]):
        return []
    _, candidates = words.instances(texts, first_row, base)
    if not candidates:
        return []
    row, kind, first, last, a, b = (np.array(c, np.int64) for c in zip(*candidates, strict=True))
    pattern, there = words.patterns(first, last)
    at = np.minimum(np.searchsorted(sure[0], pattern), len(sure[0]) - 1)
    hit = there & (sure[0][at] == pattern) & (sure[1][at] == kind)
    score = np.where(hit, sure[2][at], 0.0).max(axis=0)
    return [(int(row[i]), int(kind[i]), int(a[i]), int(b[i]), float(score[i])) for i in np.flatnonzero(score > 0)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with its spans replaced by their kinds; overlapping spans become one, named by the first."""
    out, at, end = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0])):
        if a >= end:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
        at = end
    return "".join(out) + text[at:]


def find(docs: DataFrame) -> DataFrame:
    """``docs`` (with text) plus base_spans, more_spans (each array of kind, start, end) and masked.

    A null text has no spans and a null masked text.  Offsets are code points, ends exclusive.  Patterns are learned
    from all rows, repeated ones included; every text is searched whole.  Of the kinds that contexts give an identifier,
    the one with the best pattern counts, and of equals the first.
    """
    spark = docs.sparkSession
    sure = learn(docs)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    scored = pa.list_(pa.struct([("row_kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    kept = T.StructType([f for f in docs.schema if f.name not in ("base_spans", "more_spans", "masked")])
    slices = max(1, -(-sure.count() // SLICE))
    names = [f.name for f in kept]
    # plain names inside, as mapInArrow takes no quoted ones
    rows = docs.select(*(F.col(quoted(n)).alias(f"c{i}") for i, n in enumerate(names)), F.col("text").alias("_t"), F.expr("cast(array() as array<struct<row_kind:int,start:bigint,end:bigint,score:double>>)").alias("_more"))

    def searching(send, last: bool):
        def run(batches):
            for batch in batches:
                texts, more = column(batch, "_t"), column(batch, "_more").to_pylist()
                base: list = []
                for plain, first, words, spans in _parts(texts):
                    base += spans
                    for r, kind, a, b, score in all_spans(plain, first, words, spans, send.value):
                        more[first + r].append({"row_kind": kind, "start": a, "end": b, "score": score})
                keep = [batch.column(i) for i in range(batch.num_columns - 2)]
                if not last:
                    yield pa.RecordBatch.from_arrays([*keep, texts, pa.array(more, scored)], names=batch.schema.names)
                    continue
                found, masked = [], []
                for raw, b, m in zip(texts, base, more, strict=True):
                    best: dict[tuple[int, int], tuple[float, int]] = {}
                    for x in m:
                        place = (x["start"], x["end"])
                        best[place] = max(best.get(place, (-1.0, 0)), (x["score"], -x["row_kind"]))
                    m = [(-k, *place) for place, (_, k) in best.items()]
                    by_start = lambda s: (s[1], s[0])
                    found.append((sorted(b, key=by_start), sorted(m, key=by_start)))
                    text = raw.as_py()
                    masked.append(None if text is None else mask(text, b + m))
                out = [pa.array([[{"kind": KINDS[k], "start": x, "end": y} for k, x, y in f[i]] for f in found], span) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keep, *out, pa.array(masked, pa.string())], names=[*batch.schema.names[:-2], "base_spans", "more_spans", "masked"])
            trim()

        return run

    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    for k in range(slices):
        part = sure.filter(F.pmod(F.xxhash64("pattern"), F.lit(slices)) == k).orderBy("pattern").toPandas()
        send = spark.sparkContext.broadcast((part["pattern"].to_numpy(np.int64), part["kind"].to_numpy(np.int64), part["score"].to_numpy(np.float64)))
        last = k == slices - 1
        schema = T.StructType([*rows.schema[: len(names)], *(T.StructField(n, t) for n, t in (("base_spans", spans), ("more_spans", spans), ("masked", T.StringType())))]) if last else rows.schema
        rows = rows.mapInArrow(searching(send, last), schema)
    return rows.toDF(*names, "base_spans", "more_spans", "masked")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of :func:`find`'s rows."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    both = F.array_sort(F.transform(F.concat("base_spans", "more_spans"), lambda s: F.struct(s["start"], F.array_position(names, s["kind"]).alias("place"), s["end"], s["kind"])))

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.array_join(F.transform("base_spans", text), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform(both, text), ",").alias("spans"))
