"""Spelling variant grouping by pivotal grams.

Words are the runs of letters of all texts.  Two words are near if one inserted, deleted or replaced letter makes them
equal.  A word's positional bigrams are ordered by how many words have them, rarest first; its prefix is its three rarest ones and
all that are as rare as the third, and its pivots are two bigrams of the prefix that share no letter, chosen by dynamic
programming to be the rarest such pair.  One edit leaves one of two disjoint bigrams whole, so of two near words one has a
pivot that is in the other's prefix: in the one whose prefix ends with the rarer bigram, a pivot that survives
is no commoner than what ends the other's prefix.  Pivots are therefore met with prefixes only, never with all bigrams.

The survivor's place is limited.  If the edit is behind it, all before it is equal, and so is one half of what follows; if the
edit is before it, all behind it is equal, and so is one half of what goes before.  Those parts are the keys of the index.
What meets is verified by its edit distance.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.cluster import materialize, shared_folder
from varloom.llm.common import column, lookup, trim

#: Words have at least so many letters and occurrences.
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: A form stands at least so many times as often as its variant.
FORM_RATIO = 2
#: Runs that an error hits: one in so many, by a crc of document and run.
ERROR_SHARE = 97
#: Bytes of text handled at once (one longer document forms a block of its own), and words that a task holds before it hands them on.
BLOCK_BYTES, HELD_WORDS = 4 << 20, 200_000
#: Runs of more bytes have their crc computed one by one.
LONG_RUN = 48

#: All letters [A-Za-zÀ-ÿ] are one byte each in Latin-1; A-Z become a-z, anything else a blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _crc_table() -> np.ndarray:
    """What a zero byte makes of the low byte of a crc."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_ZERO = _crc_table()


def _tokens(data: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs of non-blanks of ``data`` as a dictionary array, and where each starts."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], codes != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(codes[inside[1:-1]])])
    return words.dictionary_encode(), start


def _hashes(prefix: np.ndarray, doc: np.ndarray, word: np.ndarray, spelled: list[bytes]) -> np.ndarray:
    """crc32 of each document's prefix followed by the word, from the two crcs: that of the prefix moves on by the word's length."""
    size = np.array([len(w) for w in spelled], np.int64)
    own = np.array([zlib.crc32(w) for w in spelled], np.uint32)
    moved = [prefix]
    for _ in range(min(int(size.max(initial=0)), LONG_RUN)):
        last = moved[-1]
        moved.append((last >> np.uint32(8)) ^ _ZERO[last & np.uint32(255)])
    out = np.stack(moved)[np.minimum(size[word], LONG_RUN), doc] ^ own[word]
    for i in np.flatnonzero(size[word] > LONG_RUN):
        out[i] = zlib.crc32(spelled[word[i]], int(prefix[doc[i]]))
    return out


def _count_block(ids: list, texts: list[bytes], least: int, into: dict[bytes, int]) -> None:
    """Add the words of a block's texts, errors made."""
    found, start = _tokens(b" ".join(texts))
    if not len(found):
        return
    word, letters = np.asarray(found.indices), found.dictionary.to_pylist()
    begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
    doc = np.searchsorted(begin, start, side="right") - 1
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    spelled = [w if w.isascii() else w.decode("latin-1").encode() for w in letters]
    h = _hashes(prefix, doc, word, spelled)
    hit = h % ERROR_SHARE == 0
    count = np.bincount(word[~hit], minlength=len(letters)).tolist()
    for w, n in zip(letters, count, strict=True):
        if n and len(w) >= least:
            into[w] = into.get(w, 0) + n
    for i, at in zip(word[hit].tolist(), h[hit].tolist(), strict=True):
        w = letters[i]
        k = at % len(w)
        if len(w) > least:
            w = w[:k] + w[k + 1 :]
            into[w] = into.get(w, 0) + 1


def count_words(docs: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """(word, n) of the runs of letters of ``docs`` (doc_id, text), A-Z lower-cased, that have at least ``least`` letters.

    In runs that the crc32 of ``<doc_id>:<run>`` picks, one letter is lost.  A null text has no runs, a null doc_id is
    empty; equal rows count each.  Tasks add up their words before they hand them on.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        ids: list = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for i, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text"), strict=True):
                if (text := text.as_py()) is None:
                    continue
                if texts and size + len(text) > BLOCK_BYTES:
                    _count_block(ids, texts, least, held)
                    ids, texts, size = [], [], 0
                    if len(held) > HELD_WORDS:
                        yield _counts(held)
                        held = {}
                ids.append(i)
                texts.append(text.encode("latin-1", "replace").translate(_LETTERS))
                size += len(text)
        if texts:
            _count_block(ids, texts, least, held)
        if held:
            yield _counts(held)
        trim()

    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _counts(held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(held.values(), pa.int64())], names=["word", "n"])


def choose(word: str, weight: dict[str, int]) -> tuple[list[int], list[int]]:
    """(places of the two pivots, places of the prefix) of a word of four letters or more.

    Bigrams go by (weight, bigram).  The rarest disjoint pair is found in one pass by places: the best single bigram that ended
    before a place, and the best pair so far.
    """
    grams = [(weight[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1)]
    last = sorted(grams)[2][:2]
    prefix = [g for g in grams if g[:2] <= last]
    single = pair = None
    ended = 0
    for cost, gram, i in prefix:
        while prefix[ended][2] <= i - 2:
            other = prefix[ended]
            if single is None or other < single:
                single = other
            ended += 1
        if single is not None and (pair is None or single[0] + cost < pair[0]):
            pair = (single[0] + cost, single[2], i)
    return [pair[1], pair[2]], [i for _, _, i in prefix]


def pivots(words: DataFrame) -> DataFrame:
    """``words`` (word, n) with the places of their pivots and of their prefix.

    The bigrams' weights come to the driver: words over an alphabet of m letters have at most m * m, which is 8,100 here.
    """
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    weight = {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    send = words.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [choose(w, send.value) for w in column(batch, "word").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "word"), column(batch, "n"), pa.array([b[0] for b in both], pa.list_(pa.int32())), pa.array([b[1] for b in both], pa.list_(pa.int32()))],
                names=["word", "n", "pivots", "prefix"],
            )

    return words.mapInArrow(run, "word string, n long, pivots array<int>, prefix array<int>")


def _keys(length: Column) -> Column:
    """Keys of the bigram at place ``i`` of ``word``, for a partner of ``length`` letters (for its own: of its own length).

    Parts are laid out in the partner: first the edit behind the bigram (all up to it, and the first or the last half of the
    rest), then the edit before it (all from it on, and the last or the first half of what goes before).
    """
    word, i, own = F.col("word"), F.col("i"), F.length("word")
    head = i + 2
    middle = head + F.floor((length - head) / 2).cast("int")
    back = own - i
    half = F.floor((length - back) / 2).cast("int")
    left = lambda n: F.substr(word, F.lit(1), n)
    right = lambda n: F.substr(word, own - n + 1, n)
    key = lambda kind, *parts: F.xxhash64(F.lit(kind), length, *parts)
    return F.array(
        key(1, i, left(middle)),
        key(2, i, left(head), right(length - middle)),
        F.when(length >= back, key(3, back, right(F.least(length - half, own)))),
        F.when(length >= back, key(4, back, left(half), right(back))),
    )


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of ``words`` (word, n; each word once, four letters or more) at an edit distance of 1, a < b, once each."""
    placed = words if "pivots" in words.columns else pivots(words)
    mine = placed.select("word", "n", F.explode("pivots").alias("i")).select("word", "n", "i", F.explode(F.array(*(F.length("word") + d for d in (-1, 0, 1)))).alias("size"))
    mine = mine.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(_keys(F.col("size"))).alias("key")).filter("key is not null")
    other = placed.select("word", "n", F.explode("prefix").alias("i"))
    other = other.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.explode(_keys(F.length("word"))).alias("key")).filter("key is not null")
    # 24 and 12 rows a word, which Spark sizes as one: neither may be broadcast
    met = mine.join(other.hint("merge"), (mine["key"] == other["key"]) & (F.levenshtein("a", "b", 1) == 1))
    turned = F.col("a") > F.col("b")
    pick = lambda x, y, name: F.when(turned, F.col(x)).otherwise(F.col(y)).alias(name)
    return met.select(pick("b", "a", "a"), pick("a", "b", "b"), pick("n_b", "n_a", "n_a"), pick("n_a", "n_b", "n_b")).distinct()


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of ``forms`` (word, form): where following forms ends.

    Ways double in length each round.  A form stands at least FORM_RATIO times as often as its word, so a way has at most
    62 steps and six rounds are enough, whatever the input.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), folder, "roots-0")
    for k in itertools.count(1):
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # many words may have one root
        new = lookup(now, step, ["root"]).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = materialize(new, folder, f"roots-{k}")
        now = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return now


def group_variants(words: DataFrame, spark: SparkSession, ratio: int = FORM_RATIO) -> DataFrame:
    """``words`` (word, n) with form, root, n_near and form_n.

    n_near counts a word's near words.  Its form is its near word of largest n (ties: the smallest in code-point
    order) if that n is at least ``ratio`` times its own, else null; its root is what following forms ends with, itself without
    one; form_n is its form's n.
    """
    if ratio < 2:
        raise ValueError("a form must stand at least twice as often as its word")
    folder = shared_folder(spark)
    words = materialize(words.select("word", "n"), folder, "words")
    pairs = materialize(near_words(words), folder, "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
    best = both.groupBy(F.col("a").alias("word"), F.col("n_a").alias("n")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best")
    )
    form_n = -F.col("best.less")
    has = form_n >= ratio * F.col("n")
    best = materialize(best.select("word", "n_near", F.when(has, F.col("best.form")).alias("form"), F.when(has, form_n).alias("form_n")), folder, "best")
    known = roots(best.filter("form is not null"), folder)
    # both grow with the words, and are sized by their packed files
    return (
        words.join(best.hint("merge"), "word", "left")
        .join(known.hint("merge"), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


def variants(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """The words of all ``docs`` (doc_id, text) that stand at least ``least_count`` times, grouped; see ``group_variants``."""
    return group_variants(count_words(docs).filter(F.col("n") >= least_count), docs.sparkSession)
