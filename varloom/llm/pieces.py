"""SentencePiece encoding and decoding with the N best segmentations over the piece lattice.

A text's lattice has an edge for every piece that matches at a place, with the piece's score; characters without a piece
fall back to bytes.  A text is cut before a space that follows a character which no piece has before a space, and around
characters that no piece holds: no piece reaches over these places, so the lattice is a chain of segments, and short ones
unless the vocabulary has pieces of several words.  Forward Viterbi scores are computed for all distinct
segments of a block at once, and those of segments that a worker has met before are kept.  A segment's second-best score tells how cheaply it can deviate; the N best paths of
a text deviate only in its N - 1 cheapest segments.  Over the chain of these, the forward scores are an exact heuristic,
and A* backwards from the end gives the N best paths in order.

Encoding is lossless: a literal U+2581 is spelled in bytes, so decoding gives the text back.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm.common import beside, column, list_array, trim
from varloom.llm.textsets import _power_tables, mix64

#: Where the public vocabulary file is; callers may give another.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of text handled at once, and segmentations asked for.
BLOCK_CHARS, BEST = 1 << 20, 4
#: Segments whose results a worker keeps; beyond it starts anew, which costs time alone.
KEPT_SEGMENTS = 300_000
#: What a byte costs beyond the least likely piece.
BYTE_PENALTY = 10.0

SPACE = 0x2581
_SPELLED = 0x110000
_SLOT_BITS = 19
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces, scores, and the id of each byte; read on the driver, small enough to broadcast."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    usable: list[bool]

    @staticmethod
    def load(path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        number = {p: i for i, p in enumerate(pieces)}
        usable = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        return Vocabulary(pieces, [model.get_score(i) for i in range(n)], [number[f"<0x{b:02X}>"] for b in range(256)], usable)


def _values(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(1))


class Lattice:
    """Matching tables of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.scores = np.array(v.scores, np.float32)  # as the model holds them
        ids = [i for i in range(len(v.pieces)) if v.usable[i] and v.pieces[i]]
        codes = [np.frombuffer(v.pieces[i].encode("utf-32-le"), np.uint32) for i in ids]
        size = np.array([len(c) for c in codes])
        flat = np.concatenate(codes)
        self.longest = int(size.max())
        start = np.concatenate(([0], np.cumsum(size)))
        up, down = _power_tables(len(flat) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_values(flat) * up[: len(flat)], dtype=np.uint64)))
        h = self._key((sums[start[1:]] - sums[start[:-1]]) * down[start[:-1]], size)
        order = np.argsort(h)
        self.keys, self.ids = h[order], np.array(ids, np.int32)[order]
        # slots of the hash tables, each with at most one piece; those whose slot is taken go to the next table
        self.tables, left = [], np.arange(len(self.keys))
        while len(left):
            slot = self._slot(self.keys[left])
            table = np.full(1 << _SLOT_BITS, -1, np.int32)
            table[slot[::-1]] = left[::-1]
            self.tables.append(table)
            left = left[table[slot] != left]
        #: characters that are pieces, those that any piece holds, and those that a piece has before a space
        self.known, self.held, self.before_space = (np.zeros(_SPELLED + 1, bool) for _ in range(3))
        self.known[[int(c[0]) for c in codes if len(c) == 1]] = True
        self.held[flat] = True
        space = np.flatnonzero(flat == SPACE)
        self.before_space[flat[space[~np.isin(space, start)] - 1]] = True
        self.byte_ids = np.array(v.byte_ids)
        self.byte_score = float(min(self.scores[i] for i in ids if self.scores[i] > -1e8)) - BYTE_PENALTY
        # decoding: each piece's bytes
        raw = [v.pieces[i].replace("▁", " ").encode() if v.usable[i] else b"" for i in range(len(v.pieces))]
        for b, i in enumerate(v.byte_ids):
            raw[i] = bytes([b])
        self.raw_start = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.store = Store()

    @staticmethod
    def _key(poly: np.ndarray, size) -> np.ndarray:
        return (poly + np.uint64(1) * np.asarray(size).astype(np.uint64)) * _SPREAD

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all pieces, where each piece ends)."""
        size = self.raw_start[ids + 1] - self.raw_start[ids]
        return self.raw[_ragged(self.raw_start[ids], size)], np.cumsum(size)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a text's pieces, without the space put before it."""
        return self.spell(ids)[0].tobytes()[1:]


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    begin = np.cumsum(size) - size
    return np.repeat(start - begin, size) + np.arange(int(size.sum()))


class Store:
    """Best paths of the segments that were met so far, by the segments' keys; rows stay where they are."""

    def __init__(self):
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.best, self.loss = np.zeros(0), np.zeros(0)
        self.flat, self.flat_of = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of ``keys``; -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def add(self, keys: np.ndarray, found: Solution) -> np.ndarray:
        """Rows of new segments, whose ``keys`` ascend."""
        rows = len(self.best) + np.arange(len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows)
        self.best, self.loss = np.concatenate((self.best, found.best)), np.concatenate((self.loss, found.loss))
        self.flat_of = np.concatenate((self.flat_of, found.flat_of[1:] + len(self.flat)))
        self.flat = np.concatenate((self.flat, found.flat.astype(np.int32)))
        return rows


class Block:
    """Some texts' segments, with all segmentations' scores."""

    def __init__(self, lattice: Lattice, texts: list[str]):
        self.lattice = lattice
        parts, size = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                c = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                parts += [np.full(1, SPACE, np.uint32), np.where(c == SPACE, np.uint32(_SPELLED), np.where(c == 32, np.uint32(SPACE), c))]
                size[i] = len(c) + 1
        codes = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        del parts
        text_start = np.concatenate(([0], np.cumsum(size)))
        n = len(codes)
        cut = np.zeros(n + 1, bool)
        cut[text_start] = True
        if n:
            odd = ~lattice.held[codes]
            cut[:-1] |= odd
            cut[1:] |= odd
            cut[1:-1] |= (codes[1:] == SPACE) & ~lattice.before_space[codes[:-1]]
        bounds = np.flatnonzero(cut)
        seg_start, seg_end = (bounds[:-1], bounds[1:]) if n else (bounds[:0], bounds[:0])
        up, down = _power_tables(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_values(codes) * up[:n], dtype=np.uint64)))
        key = lattice._key((sums[seg_end] - sums[seg_start]) * down[seg_start], seg_end - seg_start)
        del sums
        keys, first, self.distinct = np.unique(key, return_index=True, return_inverse=True)
        #: segments of each text: text i has those from seg_of[i] to seg_of[i + 1]
        self.seg_of = np.searchsorted(seg_start, text_start)
        self.codes, self.start, self.size = codes, seg_start[first], (seg_end - seg_start)[first]
        if len(lattice.store.best) > KEPT_SEGMENTS:
            lattice.store = Store()
        self.store = lattice.store
        rows = self.store.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self.store.add(keys[new], self._solved(new))
        #: each segment's row in the store
        self.kind = rows[self.distinct]
        self.length = self.store.flat_of[self.kind + 1] - self.store.flat_of[self.kind]

    def _solved(self, distinct: np.ndarray) -> Solution:
        size = self.size[distinct]
        return Solution(self.lattice, self.codes[_ragged(self.start[distinct], size)], size)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts' best segmentations, where each text's begin)."""
        ends = np.concatenate(([0], np.cumsum(self.length)))
        return self.store.flat[_ragged(self.store.flat_of[self.kind], self.length)], ends[self.seg_of]

    def nbest(self, n: int) -> list[list[tuple[float, dict[int, list[int]]]]]:
        """For each text (score, changed segments' ids by their place) of the ``n`` best segmentations, the best first."""
        totals, few = [], []
        for lo, hi in zip(self.seg_of[:-1], self.seg_of[1:], strict=True):
            kind = self.kind[lo:hi]
            totals.append(float(self.store.best[kind].sum()))
            loss = self.store.loss[kind]
            # the n - 1 cheapest to change, the first of equals
            k = min(n - 1, len(loss))
            if k > 0:
                most = np.partition(loss, k - 1)[k - 1]
                at = np.flatnonzero(loss <= most)
                at = np.sort(at[np.argsort(loss[at], kind="stable")][:k])
                few.append(at[np.isfinite(loss[at])])
            else:
                few.append(np.zeros(0, np.int64))
        wanted = np.unique(np.concatenate([self.distinct[lo + at] for lo, at in zip(self.seg_of[:-1], few, strict=True)])) if few else np.zeros(0, np.int64)
        solved = self._solved(wanted)
        edges = np.argsort(solved.seg, kind="stable")
        first = np.searchsorted(solved.seg[edges], np.arange(len(wanted) + 1))
        out = []
        for lo, at, total in zip(self.seg_of[:-1], few, totals, strict=True):
            chain = [solved.edges(k, edges[first[k] : first[k + 1]]) for k in np.searchsorted(wanted, self.distinct[lo + at]).tolist()]
            out.append(self._best_first(int(lo), _backward(chain, at.tolist(), total, n)) if chain else [(total, {})])
        return out

    def _best_first(self, lo: int, found: list[tuple[float, dict[int, list[int]]]]) -> list[tuple[float, dict[int, list[int]]]]:
        """``found`` with the segmentation of :meth:`ids` as the first of those that score the same."""
        own = lambda k: self.store.flat[self.store.flat_of[k] : self.store.flat_of[k + 1]].tolist()
        same = (all(ids == own(self.kind[lo + p]) for p, ids in changes.items()) for _, changes in found)
        k = next((k for k, is_own in enumerate(same) if is_own), len(found) - 1)
        ways = [{}, *(c for j, (_, c) in enumerate(found) if j != k)]
        return [(s, c) for (s, _), c in zip(found, ways, strict=True)]

    def stretches(self, text: int, changes: dict[int, list[int]]) -> list[tuple[int, int, list[int]]]:
        """(begin, end, ids instead) of the best segmentation's ids, for one that differs from it in some segments."""
        if not changes:
            return []
        length = self.length[self.seg_of[text] : self.seg_of[text + 1]]
        ends = np.cumsum(length)
        return [(int(ends[p] - length[p]), int(ends[p]), changes[p]) for p in sorted(changes)]

    def path(self, text: int, ids: memoryview, changes: dict[int, list[int]]) -> list:
        """Stretches of the ids of a segmentation that differs from the best one (``ids``, four bytes each) in some segments."""
        parts, at = [], 0
        for begin, end, instead in self.stretches(text, changes):
            parts += [ids[4 * at : 4 * begin], np.array(instead, "<i4").tobytes()]
            at = end
        return [*parts, ids[4 * at :]]


class Solution:
    """Forward scores, edges, best path and second-best score of each of some segments."""

    def __init__(self, lat: Lattice, codes: np.ndarray, size: np.ndarray):
        m, n = len(size), len(codes)
        start = np.concatenate(([0], np.cumsum(size)))
        owner = np.repeat(np.arange(m, dtype=np.int32), size)
        up, down = _power_tables(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_values(codes) * up[:n], dtype=np.uint64)))
        room = (start[owner + 1] - np.arange(n)).astype(np.int32)
        froms, sizes, pieces = [], [], []
        at = np.arange(n, dtype=np.int32)
        for width in range(1, lat.longest + 1):
            at = at[room[at] >= width]
            key = lat._key((sums[at + width] - sums[at]) * down[at], width)
            slot = lat._slot(key)
            place = np.full(len(at), -1, np.int32)
            for table in lat.tables:
                got = table[slot]
                hit = np.flatnonzero(got >= 0)
                hit = hit[lat.keys[got[hit]] == key[hit]]
                place[hit] = got[hit]
            near = np.flatnonzero(place >= 0)
            froms.append(at[near])
            sizes.append(np.full(len(near), width, np.int32))
            pieces.append(lat.ids[place[near]])
        # a character that is no piece has an edge spelled in bytes, whose piece is -1 less the character
        del sums, room, at
        odd = np.flatnonzero(~lat.known[codes]).astype(np.int32)
        chars = np.where(codes[odd] == _SPELLED, SPACE, codes[odd]).astype(np.int32)
        froms.append(odd)
        sizes.append(np.ones(len(odd), np.int32))
        pieces.append(-1 - chars)
        begin, width, piece = np.concatenate(froms), np.concatenate(sizes), np.concatenate(pieces)
        del froms, sizes, pieces
        score = lat.scores[np.maximum(piece, 0)]
        odd = np.flatnonzero(piece < 0)
        score[odd] = lat.byte_score * (1 + np.searchsorted([0x80, 0x800, 0x10000], -1 - piece[odd], side="right"))
        seg = owner[begin]
        # nodes: a segment of k characters has k + 1
        self.node = (start[:-1] + np.arange(m)).astype(np.int32)
        tail, head = begin + seg, begin + width + seg
        last = self.node + size.astype(np.int32)
        depth_head, depth_tail = head - self.node[seg], tail - self.node[seg]
        alpha, beta = np.full(n + m, -np.inf), np.full(n + m, -np.inf)
        alpha[self.node], beta[last] = 0.0, 0.0
        back = np.full(n + m, -1, np.int32)
        # edges by depth and width: a node has one edge of each width, and a tie goes to the longest piece
        for e in _runs(depth_head * (lat.longest + 1) + lat.longest - width):
            h, got = head[e], alpha[tail[e]] + score[e]
            up_ = got > alpha[h]
            h, e = h[up_], e[up_]
            alpha[h], back[h] = got[up_], e
        for e in _runs((depth_tail.max(initial=0) - depth_tail) * (lat.longest + 1) + width):
            beta[tail[e]] = np.maximum(beta[tail[e]], beta[head[e]] + score[e])
        del depth_head, depth_tail
        # best paths, backwards over all segments at once
        chosen = np.zeros(len(begin), bool)
        current, live = last.copy(), np.flatnonzero(size > 0)
        while len(live):
            e = back[current[live]]
            chosen[e] = True
            current[live] = tail[e]
            live = live[current[live] > self.node[live]]
        self.best = alpha[last]
        other = np.where(chosen, -np.inf, alpha[tail] + score + beta[head])
        second = np.full(m, -np.inf)
        np.maximum.at(second, seg, other)
        del other, beta
        self.loss = self.best - second
        self.alpha, self.tail, self.head, self.score, self.piece, self.size, self.seg = alpha, tail, head, score, piece, size, seg
        self.byte_ids = lat.byte_ids
        # ids of best paths
        path = np.flatnonzero(chosen)
        path = path[np.argsort(begin[path])]
        ids, of = piece[path], seg[path]
        spelled = np.flatnonzero(ids < 0)
        count = np.ones(len(ids), np.int64)
        raw = [chr(-1 - p).encode() for p in ids[spelled].tolist()]
        count[spelled] = [len(r) for r in raw]
        flat = np.repeat(ids, count)
        if len(spelled):
            flat[flat < 0] = lat.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        self.flat = flat
        self.flat_of = np.concatenate(([0], np.cumsum(np.bincount(of, weights=count, minlength=m).astype(np.int64))))

    def edges(self, kind: int, edges: np.ndarray) -> tuple[list[float], dict[int, list[tuple[int, float, list[int]]]], int]:
        """(forward scores, incoming edges by node with their ids, last node) of a segment, nodes from 0."""
        node, size = self.node[kind], int(self.size[kind])
        into: dict[int, list[tuple[int, float, list[int]]]] = {}
        for a, b, w, p in zip((self.tail[edges] - node).tolist(), (self.head[edges] - node).tolist(), self.score[edges].tolist(), self.piece[edges].tolist(), strict=True):
            into.setdefault(b, []).append((a, w, [p] if p >= 0 else [int(self.byte_ids[x]) for x in chr(-1 - p).encode()]))
        return self.alpha[node : node + size + 1].tolist(), into, size


def _runs(key: np.ndarray):
    """Numbers of the entries with equal keys, keys ascending."""
    if not len(key):
        return
    if key.max(initial=0) < 1 << 16:
        key = key.astype(np.uint16)  # sorted by radix
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    for lo, hi in zip(cuts, np.append(cuts[1:], len(key)), strict=True):
        yield order[lo:hi]


def _backward(chain: list, places: list[int], total: float, n: int) -> list[tuple[float, dict[int, list[int]]]]:
    """A* from the last node of the last segment to the first node of the first.

    The heuristic at a node is the forward Viterbi score: that of its segment plus the best of all segments before.
    """
    best = [alpha[size] for alpha, _, size in chain]
    before = [sum(best[:k]) for k in range(len(chain))]
    fixed = total - sum(best)
    k = len(chain) - 1
    count = 0
    queue = [(-(before[k] + best[k]), count, 0.0, k, chain[k][2], None)]
    found = []
    while queue and len(found) < n:
        f, _, gone, k, node, path = heapq.heappop(queue)
        if node == 0:
            if k == 0:
                ids: dict[int, list[int]] = {p: [] for p in places}
                while path is not None:
                    place, pieces, path = path
                    ids[place] += pieces
                found.append((fixed - f, ids))
                continue
            k -= 1
            node = chain[k][2]
        alpha, into, _ = chain[k]
        for a, w, p in into.get(node, ()):
            count += 1
            heapq.heappush(queue, (-(before[k] + alpha[a] + w + gone), count, gone + w, k, a, (places[k], p, path)))
    return found


_lattices: dict[int, Lattice] = {}


def _lattice(vocabulary: Vocabulary) -> Lattice:
    key = hash(tuple(tuple(x) for x in (vocabulary.pieces, vocabulary.scores, vocabulary.byte_ids, vocabulary.usable)))
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(vocabulary)
    return _lattices[key]


def encode(docs: DataFrame, model_path: str = MODEL_PATH, n: int = BEST) -> DataFrame:
    """``docs`` (with text) plus ids, n_pieces, best_score, nbest_changes, nbest_scores, nbest_sha256, decoded_sha256, round_trip.

    ids is the best segmentation of the whole text; nbest_changes, nbest_scores and nbest_sha256 (of little-endian 32-bit ids)
    tell of the ``n`` best ones, or all if there are fewer, best first.  nbest_changes has the stretches of ids, from begin to
    end, that others take the place of; :func:`nbest_ids` spells them out.  decoded_sha256 is that of the ids decoded again, and
    round_trip whether each of the segmentations, decoded, gives the text.  A null text is empty: no ids, one segmentation of
    score 0.
    """
    send = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    added = ["ids", "n_pieces", "best_score", "nbest_changes", "nbest_scores", "nbest_sha256", "decoded_sha256", "round_trip"]
    rows, fields, names = beside(docs, "text", *added)

    def run(batches):
        lattice = _lattice(send.value)
        for batch in batches:
            texts = column(batch, "_t")
            size = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            keep = [c for c in batch.schema.names if c != "_t"]
            lo = 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + size[hi] <= BLOCK_CHARS):
                    chars += size[hi]
                    hi += 1
                part = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
                block = Block(lattice, part)
                best = block.nbest(n)
                flat, start = block.ids()
                raw, ends = lattice.spell(flat)
                ends = np.concatenate(([0], ends))[start].tolist()
                flat = flat.astype("<i4")
                scores, digests, decoded, good = [], [], [], []
                changed, others, texts_of, ways_of, ids_of = [], [], [0], [0], [0]
                for i, t in enumerate(part):
                    mine = memoryview(flat[start[i] : start[i + 1]].tobytes())
                    scores.append([s for s, _ in best[i]])
                    found = [b"".join(block.path(i, mine, c)) for _, c in best[i]]
                    for _, c in best[i]:
                        for begin, end, instead in block.stretches(i, c):
                            changed.append((begin, end))
                            ids_of.append(ids_of[-1] + len(instead))
                            others += instead
                        ways_of.append(len(changed))
                    texts_of.append(len(ways_of) - 1)
                    digests.append([hashlib.sha256(x).hexdigest() for x in found])
                    back, whole = raw[ends[i] : ends[i + 1]].tobytes()[1:], t.encode()
                    decoded.append(hashlib.sha256(back).hexdigest())
                    good.append(back == whole and all(lattice.decode(np.frombuffer(x, "<i4")) == whole for x in found[1:]))
                count = np.diff(start)
                begins, ends = np.array(changed, np.int32).reshape(-1, 2).T
                stretches = pa.StructArray.from_arrays([pa.array(begins), pa.array(ends), list_array(others, ids_of, pa.int32())], names=["begin", "end", "ids"])
                ways = pa.ListArray.from_arrays(pa.array(ways_of, pa.int32()), stretches)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column(batch, c).slice(lo, hi - lo) for c in keep),
                        list_array(flat, start, pa.int32()),
                        pa.array(count, pa.int64()),
                        pa.array([s[0] for s in scores], pa.float64()),
                        pa.ListArray.from_arrays(pa.array(texts_of, pa.int32()), ways),
                        pa.array(scores, pa.list_(pa.float64())),
                        pa.array(digests, pa.list_(pa.string())),
                        pa.array(decoded),
                        pa.array(good),
                    ],
                    names=[*keep, *added],
                )
                lo = hi
        trim()

    array = lambda kind: T.ArrayType(kind)
    change = T.StructType().add("begin", "integer").add("end", "integer").add("ids", array(T.IntegerType()))
    kinds = [array(T.IntegerType()), T.LongType(), T.DoubleType(), array(array(change)), array(T.DoubleType()), array(T.StringType()), T.StringType(), T.BooleanType()]
    schema = T.StructType([*fields, *(T.StructField(n, k) for n, k in zip(added, kinds, strict=True))])
    return rows.mapInArrow(run, schema).toDF(*names, *added)


def nbest_ids(encoded: DataFrame) -> DataFrame:
    """``encoded`` with nbest_ids: the ids of each of the best segmentations."""

    def spelled(way: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids"))
        kept = lambda at, end: F.slice("ids", at + 1, end - at)
        step = lambda done, c: F.struct(c["end"].alias("at"), F.concat(done["ids"], kept(done["at"], c["begin"]), c["ids"]).alias("ids"))
        return F.aggregate(way, none, step, lambda done: F.concat(done["ids"], kept(done["at"], F.size("ids"))))

    return encoded.withColumn("nbest_ids", F.transform("nbest_changes", spelled))


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """``encoded`` with the text of its ids as column decoded; null ids give null."""
    send = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    rows, fields, names = beside(encoded, "ids", "decoded")

    def run(batches):
        lattice = _lattice(send.value)
        for batch in batches:
            out = [None if x.as_py() is None else lattice.decode(np.array(x.as_py(), np.int64)).decode("utf-8", "replace") for x in column(batch, "_t")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*batch.schema.names[:-1], "decoded"])

    return rows.mapInArrow(run, T.StructType(fields).add("decoded", "string")).toDF(*names, "decoded")
