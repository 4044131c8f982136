"""A hierarchical Pitman-Yor language model of words after words, over characters.

Each word is the context of the next one: a restaurant for each context, in which the following words sit.  Their parent is
one restaurant of words, whose customers are the contexts' tables.  Its base measure is a character model: a restaurant
for each context of up to ORDER bytes of the word so far, whose parent is the restaurant of the context without its
first byte.  A new table in the word restaurant is a word drawn from the character model, which therefore learns from
tables, not tokens.  A text's first word and its end token have the end token and the last word as contexts.

Seating follows the Chinese-restaurant process and is resampled in Gibbs sweeps: each sweep reseats every word's and every
context's customers given the rest.  Predictive probabilities are averaged over the sweeps.

Pairs are counted by 64-bit hashes: each chunk of documents deals out its pairs' sorted hashes as packed arrays, and hears what
other chunks hold too.  Words are dealt out by their hashes into the lexicon's parts.  In a sweep each part answers every chunk with
what it knows of the chunk's words; a chunk seats the pairs that it counts, and sends its words' new tables back.  A pair's seating
depends on its hash, its count and its words alone, so a chunk that holds a pair which another one counts seats it just so.

Counts of pairs and words, vocabulary and all seating of words are distributed tables that grow with the corpus.  The character
model holds every pair of context and symbol; with ORDER bytes of context there are fewer than 17 million of them whatever
the corpus, which bounds what is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.cluster import forget, materialize, shared_folder
from varloom.llm.common import by_group, column, trim
from varloom.llm.textsets import blocks, mix64, word_bounds, word_hashes

#: Bytes of context, sweeps averaged, sweeps inside the character model.
ORDER, SAMPLES, CHAR_SWEEPS = 2, 3, 3
STRENGTH = 1.0
#: Share of the base measure that is uniform over the known words and one unknown word; the rest spells words.
CLOSED = 0.9
#: Documents and bytes of text whose words are looked up together.
CHUNK_DOCS, CHUNK_BYTES = 4096, 16 << 20
#: Words handled at once, dishes seated at once.
WORD_ROWS, SEATED = 20_000, 16_384
#: Words and tokens of chunks in a part, until there are 2^PART_BITS parts.
PART_WORDS, PART_TOKENS, PART_BITS = 100_000, 200_000, 12

END = 256
SYMBOLS = 257


# -- seating ----------------------------------------------------------------------------------------------


def uniform(ids: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the ids and the salt alone."""
    return (salted(ids, *salt) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def salted(ids: np.ndarray, *salt: int) -> np.ndarray:
    h = ids.view(np.uint64) if ids.dtype == np.int64 else ids.astype(np.uint64, copy=False)
    for s in salt:
        h = mix64(h + np.uint64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
    return h


def seat(ids: np.ndarray, customers: np.ndarray, pull: np.ndarray, discount: float, sweep: int) -> np.ndarray:
    """Tables after ``customers`` of a dish have come: each starts a table with odds pull : seated - discount * tables.

    ``pull`` is (strength + discount * the restaurant's tables) * the parent's probability.  Customers come in batches of a
    sixteenth of those seated, or one by one while that is less.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    several = np.flatnonzero(customers > 1)
    several = several[np.argsort(-customers[several])]
    for lo in range(0, len(several), SEATED):
        # the dishes with most customers first, so those that still have some to seat are the first ones
        at = several[lo : lo + SEATED]
        c, drawn, open_, t = -customers[at], salted(ids[at], sweep), pull[at], np.ones(len(at))
        seated, step, left = 1, 0, len(at)
        while left:
            batch = max(1, seated // 16)
            n = np.minimum(batch, -c[:left] - seated)
            chance = open_[:left] / (open_[:left] + np.maximum(seated - discount * t[:left], 1e-9))
            t[:left] += np.floor(n * chance + uniform(drawn[:left], step))
            seated, step = seated + batch, step + 1
            left = int(np.searchsorted(c[:left], -seated))
        tables[at] = t
    return np.minimum(tables, customers)


def discount_of(customers: np.ndarray) -> float:
    """The usual estimate from dishes seen once and twice."""
    once, twice = (customers == 1).sum(), (customers == 2).sum()
    return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))


def _heads(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate((np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1])))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct keys, a place of each, each key's number among them)."""
    order = np.argsort(keys)
    ordered = keys[order]
    head = _heads(ordered)
    at = np.empty(len(keys), np.int32)
    at[order] = np.repeat(np.arange(len(head), dtype=np.int32), np.diff(np.append(head, len(keys))))
    return ordered[head], order[head], at


# -- the character model ----------------------------------------------------------------------------------


def cells_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(key, word number) of each symbol of each word; a key is the ORDER bytes before it and the symbol."""
    words = words.cast(pa.binary())
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    start = np.concatenate(([0], np.cumsum(size + ORDER + 1)))
    tape = np.zeros(start[-1], np.int64)
    owner = np.repeat(np.arange(n), size)
    tape[np.arange(len(data)) - (offsets[:-1] - offsets[0])[owner] + start[owner] + ORDER] = data
    tape[start[1:] - 1] = END
    of = np.repeat(np.arange(n), size + 1)
    first = np.concatenate(([0], np.cumsum(size + 1)))
    place = np.arange(first[-1]) - first[of] + start[of] + ORDER
    key = np.zeros(len(place), np.int64)
    for back in range(ORDER, 0, -1):
        key = (key << 8) | tape[place - back]
    return (key << 9) | tape[place], of


@dataclass
class Level:
    """Restaurants of one context length: sorted cells with their discounted share, contexts with what goes to the parent."""

    cells: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def shorter(keys: np.ndarray, length: int) -> np.ndarray:
    """Cells with contexts cut to their last ``length`` bytes."""
    return keys & ((1 << (8 * length + 9)) - 1)


class Characters:
    """The character model after some sweeps."""

    def __init__(self, keys: np.ndarray, customers: np.ndarray, sweep: int):
        order = np.argsort(keys)
        self.levels: list[Level] = []
        cells, n = keys[order], customers[order].astype(np.float64)
        tables: dict[int, np.ndarray] = {}
        for turn in range(CHAR_SWEEPS + 1):
            # customers of each level: those of the words at the top, the tables of longer contexts below
            state = []
            key, c = cells, n
            for length in range(ORDER, -1, -1):
                d = discount_of(c)
                t = tables.get(length)
                context, at = np.unique(key >> 9, return_inverse=True)
                if t is None or len(t) != len(key):
                    t = np.minimum(c, 1.0)
                elif self.levels:
                    total = np.bincount(at, weights=t, minlength=len(context))
                    parent = self._probability(shorter(key, max(length - 1, 0)), length - 1)
                    t = seat(key, c, (STRENGTH + d * total[at]) * parent, d, 1000 * sweep + turn * 10 + length)
                tables[length] = t
                state.append((length, key, c, t, d, context, at))
                if length:
                    down, into = np.unique(shorter(key, length - 1), return_inverse=True)
                    key, c = down, np.bincount(into, weights=t, minlength=len(down))
            self.levels = []
            for _, key_, c_, t_, d_, context, at in reversed(state):
                people, open_ = np.bincount(at, weights=c_, minlength=len(context)), np.bincount(at, weights=t_, minlength=len(context))
                self.levels.append(Level(key_, (c_ - d_ * t_) / (STRENGTH + people[at]), context, (STRENGTH + d_ * open_) / (STRENGTH + people)))

    def _probability(self, keys: np.ndarray, length: int) -> np.ndarray:
        p = np.full(len(keys), 1 / SYMBOLS)
        for k in range(length + 1):
            level, key = self.levels[k], shorter(keys, k)
            p = _find(level.cells, level.share, key, 0.0) + _find(level.contexts, level.backoff, key >> 9, 1.0) * p
        return p

    def log_words(self, words: pa.Array) -> np.ndarray:
        """Natural logarithm of each word's probability."""
        key, of = cells_of(words)
        distinct, _, at = _distinct(key)
        return np.bincount(of, weights=np.log(self._probability(distinct, ORDER))[at], minlength=len(words))


@dataclass
class Sample:
    """A sweep's state: the character model, the tables that seating started from, and those that it ended with."""

    characters: Characters
    before: float
    tables: float = 0.0


@dataclass
class Totals:
    tokens: int
    types: int
    discount: float

    def seated(self, words: pa.Array, ids: np.ndarray, c: np.ndarray, sample: Sample, sweep: int) -> tuple[np.ndarray, np.ndarray]:
        """(tables, base probability) of each word in a sweep."""
        base = CLOSED / (self.types + 1) + (1 - CLOSED) * np.exp(sample.characters.log_words(words))
        return seat(ids, c, (STRENGTH + self.discount * sample.before) * base, self.discount, sweep), base

    def predictive(self, c: np.ndarray, tables: np.ndarray, base: np.ndarray, sample: Sample) -> np.ndarray:
        below = STRENGTH + self.tokens
        return ((c - self.discount * tables) + (STRENGTH + self.discount * sample.tables) * base) / below


# -- jobs -------------------------------------------------------------------------------------------------


def _table(df: DataFrame, folder: str, name: str) -> DataFrame:
    return materialize(df, folder, name, clean=True, codec="zstd")


def _pack(numbers: np.ndarray, sizes: tuple[int, ...] = (1, 2, 3, 4, 8)) -> bytes:
    """Numbers in the least of ``sizes`` bytes that holds them all: the size, then all first bytes, all second ones and so on."""
    most = int(numbers.max(initial=0))
    size = next((n for n in sizes if most < 1 << (8 * n)), 8)
    return bytes([size]) + numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    size = data[0]
    out = np.zeros(((len(data) - 1) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, offset=1).reshape(size, -1).T
    return out.view("<u8").ravel()


def _counts(data: bytes) -> np.ndarray:
    return _unpack(data).astype(np.int64)


def _steps(numbers: np.ndarray, sizes: tuple[int, ...] = (1, 2, 3, 4, 8), begin: int = 0) -> bytes:
    """Ascending numbers as their differences."""
    return _pack(np.diff(numbers, prepend=numbers.dtype.type(begin)), sizes)


def _climb(data: bytes, begin: int = 0) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64) + np.uint64(begin)


def _bits(total: int, share: int) -> int:
    """Binary logarithm of the number of parts, for parts of some ``share``."""
    return int(np.clip(np.ceil(np.log2(max(total, 1) / share)), 4, PART_BITS))


def _cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of the parts that sorted ``keys`` fall into by their first bits."""
    cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(cuts))
    return list(zip(used.tolist(), cuts[used].tolist(), cuts[used + 1].tolist(), strict=True))


@cache
def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in kinds.items()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_arrow(schema))


def _joined(blobs: list[bytes], dtype: str | None = None) -> np.ndarray:
    """Packed numbers (or plain ones of a type) of several rows, one after another."""
    parts = [np.frombuffer(b, dtype) if dtype else _counts(b) for b in blobs]
    return np.concatenate(parts) if parts else np.zeros(0, dtype or np.int64)


def _unlettered(letters: bytes, lengths: bytes) -> pa.Array:
    """Words from their letters and lengths."""
    size = _counts(lengths)
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters)])


def _letters(words: pa.Array) -> tuple[bytes, bytes]:
    """(letters, packed lengths) of words."""
    words = words.cast(pa.binary())
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = words.buffers()[2]
    data = memoryview(raw)[offsets[0] : offsets[-1]].tobytes() if raw is not None else b""
    return data, _pack(np.diff(offsets))


class Chunk:
    """Some documents' pairs of neighbouring words, in the order of the pairs' hashes.

    ids are the hashes of the chunk's words, ascending, the end token's (0) the first; first and second are the pairs' words by their
    numbers, seen the pairs' occurrences in training texts, owner and at each token's document and pair.
    """

    def __init__(self, row: dict):
        self.ids = _climb(row["hashes"])
        self.held = np.frombuffer(row["held"], np.bool_)
        tape, size = _counts(row["tape"]), _counts(row["sizes"])
        self.owner = np.repeat(np.arange(len(size)), size)
        before = np.zeros_like(tape)
        before[1:] = tape[:-1]
        key = self.ids_of(self.ids, before, tape)
        self.key, place, self.at = _distinct(key)
        self.first, self.second = before[place], tape[place]
        self.seen = np.bincount(self.at, weights=~self.held[self.owner], minlength=len(self.key)).astype(np.int64)

    @staticmethod
    def ids_of(ids: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Hashes of pairs of words."""
        return mix64(ids[first] + mix64(ids + np.uint64(1))[second])

    def counted(self, shared: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(occurrences in all training texts, whether the pair is this chunk's to count), by what other chunks hold too."""
        total, mine = self.seen.copy(), np.ones(len(self.seen), bool)
        for row in shared:
            at = _climb(row["places"]).astype(np.int64)
            total[at] = _counts(row["totals"])
            mine[at] = np.unpackbits(np.frombuffer(row["own"], np.uint8), count=len(at)).astype(bool)
        return total, mine


_DEALT = "part long, chunk long, start long, steps binary, seen binary"
_SHARED = "chunk long, places binary, totals binary, own binary"


def _scatter(bits: int):
    """For mapInArrow: a chunk's pairs dealt out by the first bits of their hashes, as steps and occurrences."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                yield _batch(
                    [
                        {"part": k, "chunk": row["chunk"], "start": a, "steps": _steps(chunk.key[a:b], (5, 6, 7, 8), k << (64 - bits)), "seen": _pack(chunk.seen[a:b])}
                        for k, a, b in _cuts(chunk.key, bits)
                    ],
                    _DEALT,
                )
                del chunk
        trim()

    return run


def _gathered(bits: int):
    """For groups of a part: what several chunks hold, as (places in the chunk, occurrences in all, whether it counts them)."""

    def run(table: pa.Table) -> pa.RecordBatch | None:
        begin = table["part"][0].as_py() << (64 - bits)
        keys = [_climb(x.as_py(), begin) for x in table["steps"]]
        size = np.array([len(k) for k in keys])
        key = np.concatenate(keys)
        seen = _joined(table["seen"].to_pylist())
        order = np.argsort(key)
        head = _heads(key[order])
        many = np.diff(np.append(head, len(key)))
        total, held, own = np.empty(len(key), np.int64), np.empty(len(key), bool), np.zeros(len(key), bool)
        total[order], held[order] = np.repeat(np.add.reduceat(seen[order], head), many), np.repeat(many > 1, many)
        own[order[head]] = True
        made, lo = [], 0
        for chunk, start, n in zip(table["chunk"].to_pylist(), table["start"].to_pylist(), size.tolist(), strict=True):
            at = np.flatnonzero(held[lo : lo + n])
            if len(at):
                made.append({"chunk": chunk, "places": _steps(at + start), "totals": _pack(total[lo + at]), "own": np.packbits(own[lo + at]).tobytes()})
            lo += n
        return _batch(made, _SHARED) if made else None

    return run


#: Two kinds of rows: a chunk's words, and its documents.
_BAGS = (
    "chunk long, hashes binary, n_train binary, lengths binary, letters binary, "
    "doc_ids array<long>, held binary, sizes binary, tape binary, n_words long, n_tokens long"
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(_LOWER[data[at]].tobytes())])


def _chunk_rows(chunk: int, ids: pa.Array, held: np.ndarray, texts: pa.Array) -> list[pa.RecordBatch]:
    """A row of a chunk's distinct words, and a row of its documents as their words' numbers; number 0 is the end token's."""
    hashes, words, inverse, rows = [], [], [], []
    known = 0
    for first, _, data, offsets in blocks(texts):
        start, end, row = word_bounds(data, offsets)
        u, at, inv = _distinct(word_hashes(data, start, end))
        hashes.append(u)
        words.append(_words(data, start[at], end[at]))
        inverse.append(inv + known)
        rows.append(row + first)
        known += len(u)
    u, at, inv = _distinct(np.concatenate(hashes))
    lid, row = inv[np.concatenate(inverse)] + 1, np.concatenate(rows)
    n = len(texts)
    word = pa.concat_arrays([pa.array([b""], pa.binary()), pa.concat_arrays(words).take(pa.array(at))])
    train = np.bincount(lid, weights=~held[row], minlength=len(u) + 1).astype(np.int64)
    train[0] = (~held).sum()
    # every text with its end token
    size = np.bincount(row, minlength=n) + 1
    tape = np.zeros(size.sum(), np.int64)
    inner = np.ones(len(tape), bool)
    inner[np.cumsum(size) - 1] = False
    tape[inner] = lid
    ids_ = _steps(np.append(np.uint64(0), u), (5, 6, 7, 8))
    letters, lengths = _letters(word)
    return [
        _batch([{"chunk": chunk, "hashes": ids_, "n_train": _pack(train), "lengths": lengths, "letters": letters}], _BAGS),
        _batch(
            [{"chunk": chunk, "doc_ids": ids.to_pylist(), "held": held.tobytes(), "hashes": ids_, "sizes": _pack(size), "tape": _pack(tape), "n_words": len(word), "n_tokens": len(tape)}], _BAGS
        ),
    ]


def _bags(batches):
    seq = TaskContext.get().partitionId() << 32
    for batch in batches:
        texts = column(batch, "text").cast(pa.string()).fill_null("")
        held, ids = column(batch, "held_out").to_numpy(zero_copy_only=False).astype(bool), column(batch, "doc_id")
        size = np.cumsum(np.asarray(pa.compute.binary_length(texts)).astype(np.int64))
        lo = 0
        while lo < len(texts):
            before = size[lo - 1] if lo else 0
            hi = min(lo + CHUNK_DOCS, max(lo + 1, int(np.searchsorted(size, before + CHUNK_BYTES, side="right"))), len(texts))
            yield from _chunk_rows(seq, ids.slice(lo, hi - lo), held[lo:hi], texts.slice(lo, hi - lo))
            seq, lo = seq + 1, hi
    trim()


def word_ids(words: pa.Array) -> np.ndarray:
    words = words.cast(pa.binary())
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return word_hashes(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]) if len(data) else np.zeros(n, np.uint64)


_DEALT_WORDS = "part long, chunk long, steps binary, n binary, lengths binary, letters binary"
#: A part's words, with the training tokens, the pairs seen once that end and begin with them, and what each chunk holds of them.
#: people and opened: customers and tables of the contexts, before each sweep and after the last.
_LEXICON = (
    "part long, lengths binary, letters binary, n_types long, n_tokens long, c binary, chunks array<long>, places array<binary>, "
    "single binary, single_opened binary, people array<binary>, opened array<binary>"
)


def _scatter_words(bits: int):
    """For mapInArrow: a chunk's words dealt out by the first bits of their hashes."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                key, n, words = _climb(row["hashes"]), _unpack(row["n_train"]), _unlettered(row["letters"], row["lengths"])
                made = []
                for k, a, b in _cuts(key, bits):
                    letters, lengths = _letters(words[a:b])
                    made.append({"part": k, "chunk": row["chunk"], "steps": _steps(key[a:b], (5, 6, 7, 8), k << (64 - bits)), "n": _pack(n[a:b]), "lengths": lengths, "letters": letters})
                yield _batch(made, _DEALT_WORDS)
        trim()

    return run


def _part(table: pa.Table) -> pa.RecordBatch:
    """A part of the lexicon from what chunks hold of it."""
    rows = table.to_pylist()
    keys = [_climb(r["steps"]) for r in rows]
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    head = _heads(key[order])
    at = np.empty(len(key), np.int64)
    at[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key))))
    c = np.add.reduceat(_joined([r["n"] for r in rows])[order], head)
    letters, lengths = _letters(pa.concat_arrays([_unlettered(r["letters"], r["lengths"]) for r in rows]).take(pa.array(order[head])))
    ends = np.cumsum([len(k) for k in keys])[:-1]
    places = [_steps(x) for x in np.split(at, ends)]
    return _batch(
        [{"part": rows[0]["part"], "lengths": lengths, "letters": letters, "n_types": int((c > 0).sum()), "n_tokens": int(c.sum()), "c": _pack(c), "chunks": [r["chunk"] for r in rows], "places": places, "people": [], "opened": []}],
        _LEXICON,
    )


#: What a chunk counts of a part's words; its pairs that it counts and that occur more than once.
_SUMS = "part long, chunk long, people binary, single binary, opened binary, single_opened binary"
_OFTEN = "chunk long, hashes binary, first binary, second binary, c binary, twice long"
_FACTS = _SUMS + _OFTEN.removeprefix("chunk long")


def _facts(bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_batch([], _FACTS)]
        for row in left.to_pylist():
            chunk = Chunk(row)
            total, mine = chunk.counted(right.to_pylist())
            n = len(chunk.ids)
            all_, once = mine & (total > 0), mine & (total == 1)
            sums = {"people": chunk.second[all_], "single": chunk.second[once], "opened": chunk.first[all_], "single_opened": chunk.first[once]}
            sums = {k: np.bincount(v, minlength=n) for k, v in sums.items()}
            out.append(_batch([{"part": k, "chunk": row["chunk"], **{name: _pack(v[a:b]) for name, v in sums.items()}} for k, a, b in _cuts(chunk.ids, bits)], _FACTS))
            at = np.flatnonzero(mine & (total > 1))
            at = at[np.lexsort((chunk.second[at], chunk.first[at]))]
            pairs = {"first": _steps(chunk.first[at]), "second": _pack(chunk.second[at]), "c": _pack(total[at])}
            out.append(_batch([{"chunk": row["chunk"], "hashes": row["hashes"], **pairs, "twice": int((total[at] == 2).sum())}], _FACTS))
        trim()
        return pa.Table.from_batches(out)

    return run


def _begun(left: pa.Table, right: pa.Table) -> pa.Table:
    """A part with its chunks' sums, before the first sweep."""
    out = []
    for row in left.to_pylist():
        sums = _summed(row, right.to_pylist(), ("people", "single", "opened", "single_opened"))
        row |= {k: _pack(sums[k]) for k in ("single", "single_opened")} | {k: [_pack(sums[k])] for k in ("people", "opened")}
        out.append(row)
    return pa.Table.from_pylist(out, schema=_arrow(_LEXICON))


def _grown(left: pa.Table, right: pa.Table) -> pa.Table:
    """A part with the tables of one more sweep."""
    out = []
    for row in left.to_pylist():
        sums = _summed(row, right.to_pylist(), ("people", "opened"))
        for k, once in (("people", "single"), ("opened", "single_opened")):
            row[k].append(_pack(_counts(row[once]) + sums[k]))
        out.append(row)
    return pa.Table.from_pylist(out, schema=_arrow(_LEXICON))


def _summed(row: dict, sums: list[dict], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The sums of chunks over a part's words."""
    out = {k: np.zeros((len(row["lengths"]) - 1) // row["lengths"][0], np.int64) for k in names}
    places = dict(zip(row["chunks"], row["places"], strict=True))
    for one in sums:
        at = _climb(places[one["chunk"]]).astype(np.int64)
        for k in names:
            out[k][at] += _counts(one[k])
    return out


def _sweep(lexicon: DataFrame, totals: Totals, samples: list[Sample], folder: str) -> None:
    """Seat all words by the last sample (if any), note its tables, and fit the next sample's character model."""
    send = lexicon.sparkSession.sparkContext.broadcast((totals, samples[-1] if samples else None, len(samples) - 1))

    def run(batches):
        t_, sample, sweep = send.value
        tables = 0.0
        held_k, held_n, size = [], [], 0
        for row in (r for batch in batches for r in batch.to_pylist()):
            people, all_ = _counts(row["last"]), _unlettered(row["letters"], row["lengths"])
            used = np.flatnonzero(people > 0)
            for lo in range(0, len(used), WORD_ROWS):
                at = used[lo : lo + WORD_ROWS]
                words, c = all_.take(pa.array(at)), people[at]
                t = np.ones(len(c)) if sample is None else t_.seated(words, word_ids(words), c, sample, sweep)[0]
                tables += t.sum()
                key, of = cells_of(words)
                k, _, at = _distinct(key)
                held_k.append(k)
                held_n.append(np.bincount(at, weights=t[of]))
                size += len(k)
                if size > 1_000_000:
                    k, at = np.unique(np.concatenate(held_k), return_inverse=True)
                    held_k, held_n, size = [k], [np.bincount(at, weights=np.concatenate(held_n))], len(k) // 2
        if held_k:
            k, at = np.unique(np.concatenate(held_k), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(held_n))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(n, tables))], names=["cell", "n"])

    got = lexicon.select("lengths", "letters", F.element_at("people", -1).alias("last")).mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    got = _table(got, folder, f"cells-{len(samples)}")
    tables = got.filter("cell < 0").agg(F.sum("n")).first()[0] or 0.0
    if samples:
        samples[-1].tables = float(tables)
    if len(samples) < SAMPLES:
        best = got.filter("cell >= 0").orderBy("cell").toPandas()
        characters = Characters(best["cell"].to_numpy(np.int64), np.round(best["n"].to_numpy(np.float64)), len(samples))
        samples.append(Sample(characters, float(tables)))


#: What a part answers a chunk: its words' training tokens, probabilities without a context by sweep, and tables of the contexts.
_ANSWERS = "chunk long, part long, c binary, ps array<binary>, opened array<binary>"


def _answers(lexicon: DataFrame, state: list[tuple[Totals, Sample]], sweeps: range) -> DataFrame:
    """The parts' answers to all chunks: for each of ``sweeps`` probabilities, and tables before each and after the last if it stands."""
    send = lexicon.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        held = send.value
        for row in (r for batch in batches for r in batch.to_pylist()):
            words = _unlettered(row["letters"], row["lengths"])
            ps = [np.empty(len(words)) for _ in sweeps]
            for p, sweep in zip(ps, sweeps, strict=True):
                t_, sample = held[sweep]
                people = _counts(row["people"][sweep])
                for lo in range(0, len(words), WORD_ROWS):
                    some, c = words[lo : lo + WORD_ROWS], people[lo : lo + WORD_ROWS]
                    tables, base = t_.seated(some, word_ids(some), c, sample, sweep)
                    p[lo : lo + WORD_ROWS] = np.maximum(t_.predictive(c, tables, base, sample), 1e-300)
            opened, n = [_counts(x) for x in row["opened"][sweeps[0] :]], _counts(row["c"])
            made, size = [], 0
            for chunk, places in zip(row["chunks"], row["places"], strict=True):
                at = _climb(places).astype(np.int64)
                made.append({"chunk": chunk, "part": row["part"], "c": _pack(n[at]), "ps": [p[at].tobytes() for p in ps], "opened": [_pack(x[at]) for x in opened]})
                size += len(at)
                if size > WORD_ROWS:
                    yield _batch(made, _ANSWERS)
                    made, size = [], 0
            yield _batch(made, _ANSWERS)
        trim()

    return lexicon.select("part", "letters", "lengths", "c", "chunks", "places", "people", "opened").mapInArrow(run, _ANSWERS)


def _seated(discount: float, sweep: int):
    """For a chunk's pairs and the answers to it: the tables that its words' contexts and its contexts get in a sweep."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.sort_by("part").to_pylist()
        sizes = [len(a["ps"][0]) // 8 for a in answers]
        p, opened = _joined([a["ps"][0] for a in answers], "<f8"), _joined([a["opened"][0] for a in answers])
        out = [_batch([], _SUMS)]
        for row in left.to_pylist():
            first, second, c = _climb(row["first"]).astype(np.int64), _counts(row["second"]), _counts(row["c"])
            t = seat(Chunk.ids_of(_climb(row["hashes"]), first, second), c, (STRENGTH + discount * opened[first]) * p[second], discount, 100 + sweep)
            sums = {k: np.bincount(at, weights=t, minlength=len(p)).astype(np.int64) for k, at in (("people", second), ("opened", first))}
            lo = 0
            made = []
            for a, n in zip(answers, sizes, strict=True):
                made.append({"part": a["part"], "chunk": row["chunk"], **{k: _pack(v[lo : lo + n]) for k, v in sums.items()}})
                lo += n
            out.append(_batch(made, _SUMS))
        trim()
        return pa.Table.from_batches(out)

    return run


def _tallies(lexicon: DataFrame) -> tuple[int, ...]:
    """(customers of the word restaurant, words with one, words with two, pairs seen once)."""

    def run(batches):
        for row in (r for batch in batches for r in batch.to_pylist()):
            people = _counts(row["last"])
            made = people.sum(), (people == 1).sum(), (people == 2).sum(), _counts(row["single"]).sum()
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in made], names=["people", "one", "two", "single"])

    got = lexicon.select(F.element_at("people", -1).alias("last"), "single").mapInArrow(run, "people long, one long, two long, single long")
    return tuple(int(x) for x in got.agg(*(F.coalesce(F.sum(n), F.lit(0)) for n in got.columns)).first())


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``docs`` has doc_id and text; rows where ``held_out`` doesn't hold train the model.  A text is its words (A-Z
    lower-cased) and one end token; a null text is the end token alone.  base_score is the smoothed unigram
    score and score the model's, both log10 of the whole text's probability.  Ids may be null or repeat.
    Without training rows the character model is uniform.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    bags = _table(rows.mapInArrow(_bags, _BAGS), folder, "bags")
    n_words, n_tokens = bags.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    word_bits, pair_bits = _bits(n_words, PART_WORDS), _bits(n_tokens, PART_TOKENS)
    dealt = bags.filter("letters is not null").select("chunk", "hashes", "n_train", "lengths", "letters").mapInArrow(_scatter_words(word_bits), _DEALT_WORDS)
    words = _table(by_group(dealt, ["part"], _part, _LEXICON), folder, "words")
    texts = _table(bags.filter("tape is not null").select("chunk", "doc_ids", "held", "hashes", "sizes", "tape"), folder, "texts")
    forget(spark, folder, "bags")
    tokens, types = (int(x or 0) for x in words.agg(F.sum("n_tokens"), F.sum("n_types")).first())

    dealt = texts.select("chunk", "held", "hashes", "sizes", "tape").mapInArrow(_scatter(pair_bits), _DEALT)
    shared = _table(by_group(dealt, ["part"], _gathered(pair_bits), _SHARED), folder, "shared")
    slim = texts.select("chunk", "held", "hashes", "sizes", "tape")
    facts = _table(slim.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_facts(word_bits), _FACTS), folder, "facts")
    often = facts.filter("part is null").select("chunk", "hashes", "first", "second", "c")
    sums = facts.filter("part is not null").select(*(x.split()[0] for x in _SUMS.split(", ")))
    lexicon = _table(words.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(_begun, _LEXICON), folder, "lexicon")
    forget(spark, folder, "words")
    twice = facts.agg(F.coalesce(F.sum("twice"), F.lit(0))).first()[0]
    once = _tallies(lexicon)[3]
    discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))

    # a pair seen once has one table in every sweep; only the others are reseated
    samples: list[Sample] = []
    state: list[tuple[Totals, Sample]] = []
    for sweep in range(SAMPLES):
        people, one, two, _ = _tallies(lexicon)
        totals = Totals(people, types, float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95)))
        if not samples:
            _sweep(lexicon, totals, samples, folder)
        _sweep(lexicon, totals, samples, folder)
        state.append((totals, samples[sweep]))
        answers = _answers(lexicon, state, range(sweep, sweep + 1))
        seated = often.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_seated(discount, sweep), _SUMS)
        lexicon = _table(lexicon.groupBy("part").cogroup(seated.groupBy("part")).applyInArrow(_grown, _LEXICON), folder, f"lexicon-{sweep}")
        # what the next sweep doesn't read
        forget(spark, folder, f"cells-{sweep}", f"lexicon-{sweep - 1}" if sweep else "lexicon")
    forget(spark, folder, "facts")

    kinds = dict(x.split() for x in ", ".join((_ANSWERS, _SHARED.removeprefix("chunk long, "))).split(", "))
    alike = lambda df: df.select(*(F.col(n) if n in df.columns else F.lit(None).cast(k).alias(n) for n, k in kinds.items()))
    local = alike(_answers(lexicon, state, range(SAMPLES))).unionByName(alike(shared))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = right.to_pylist()
        chunk = Chunk(row)
        total, _ = chunk.counted(left.filter(left["places"].is_valid()).to_pylist())
        answers = left.filter(left["c"].is_valid()).sort_by("part").to_pylist()
        c = _joined([a["c"] for a in answers])
        base = np.log10((c + 0.5) / (tokens + 0.5 * (types + 1)))
        mine = np.where(total > 0, total - discount, 0.0)
        first, second = chunk.first, chunk.second
        # every context is followed as often as it occurs
        below = STRENGTH + c
        ps = np.stack([_joined([a["ps"][k] for a in answers], "<f8") for k in range(SAMPLES)], 1)
        opened = np.stack([_joined([a["opened"][k] for a in answers]) for k in range(SAMPLES + 1)], 1)
        backs = (STRENGTH + discount * opened[:, 1:]) / below[:, None] / SAMPLES
        at = np.flatnonzero(total > 1)
        ids, n = chunk.key[at], total[at]
        for k in range(SAMPLES):
            t = seat(ids, n, (STRENGTH + discount * opened[:, k])[first[at]] * ps[:, k][second[at]], discount, 100 + k)
            mine[at] -= discount * (t - 1) / SAMPLES
        p = np.empty(len(total))
        for lo in range(0, len(p), WORD_ROWS):
            some = slice(lo, lo + WORD_ROWS)
            x, y = first[some], second[some]
            p[some] = np.log10(np.maximum(mine[some] / below[x] + np.einsum("ij,ij->i", backs[x], ps[y]), 1e-300))
        word = second[chunk.at]
        summed = lambda values: np.bincount(chunk.owner, weights=values, minlength=len(chunk.held))
        counts, knowns = np.bincount(chunk.owner, minlength=len(chunk.held)), summed(c[word] > 0).astype(np.int64)
        out = pa.Table.from_arrays(
            [pa.array(row["doc_ids"], pa.int64()), pa.array(chunk.held), *map(pa.array, (counts, knowns, np.full(len(counts), tokens), summed(base[word]), summed(p[chunk.at])))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )
        del chunk
        trim()
        return out

    return local.groupBy("chunk").cogroup(texts.withColumnRenamed("chunk", "of_chunk").groupBy("of_chunk")).applyInArrow(
        look_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
