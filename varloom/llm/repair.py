"""Conversation structure repair: the cheapest edits that give turns their legal order, with the least audit among them.

A conversation's rows pass through a dynamic program over four places in the legal order (nothing yet, after a system row, after
a user row, after an assistant row).  Each place holds the cost of the best way there and its audit, the string of its
edits.  Audits are persistent: a node has its last edit and a link to the audit before it, so ways that part late share all that
came before.  Nodes hold rolling hashes and ancestors at powers of two; of two ways at one cost the audits are compared by a
search for their longest common prefix, which is then verified edit by edit as far as the chains differ.

Rows come as a stream.  What all ways share is settled and its nodes are given up, and every place has its own running hash of
the repaired text, so no conversation's texts are held.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm.common import column

_PRIME = (1 << 61) - 1
_BASE = 0x1F3D5B79A8C6E42
#: Nodes after which shared beginnings are settled.
SETTLE_NODES = 1 << 16

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role's initial leads from each place.
_LEADS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NAMES = {"u": "user", "a": "assistant"}
_LEGAL = ("su", "ua", "au")


@dataclass(frozen=True)
class Costs:
    """Prices of the edits; inserting must cost something, else an audit has no end."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Audits:
    """Strings of edits as nodes that share their beginnings; node 0 is the empty one."""

    def __init__(self) -> None:
        self.clear()
        self.settled: list[str] = []

    def clear(self) -> None:
        self.letter, self.depth, self.hash = array("B", [0]), array("q", [0]), array("q", [0])
        self.up = [array("q", [0])]  # up[k][x]: the ancestor 2**k edits before x, 0 where there is none

    def add(self, parent: int, letter: str) -> int:
        node = len(self.letter)
        self.letter.append(ord(letter))
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * _BASE + ord(letter)) % _PRIME)
        up = self.up
        up[0].append(parent)
        for k in range(1, len(up)):
            up[k].append(up[k - 1][up[k - 1][node]])
        if self.depth[node] >> len(up):
            last = up[-1]
            up.append(array("q", [last[x] for x in last]))
        return node

    def ancestor(self, node: int, depth: int) -> int:
        """The beginning of ``node`` that has ``depth`` edits."""
        rest = self.depth[node] - depth
        k = 0
        while rest:
            if rest & 1:
                node = self.up[k][node]
            rest >>= 1
            k += 1
        return node

    def same(self, a: int, b: int) -> bool:
        """Equality of two audits of one length, letter by letter as far as the chains differ."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[0][a], self.up[0][b]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether audit ``a`` comes before audit ``b``; a beginning comes before what it begins."""
        n = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, n), self.ancestor(b, n)
        if self.hash[x] == self.hash[y] and self.same(x, y):
            return self.depth[a] < self.depth[b]
        return self._first(x, y)

    def _first(self, a: int, b: int) -> bool:
        """For unequal audits of one length: whether ``a`` has the smaller edit at the first place where they differ."""
        x, y = a, b
        for k in range(len(self.up) - 1, -1, -1):
            p, q = self.up[k][x], self.up[k][y]
            if self.hash[p] != self.hash[q]:
                x, y = p, q
        # here the hashes of the audits before x and y agree: that they are equal is verified
        p, q = self.up[0][x], self.up[0][y]
        if self.letter[x] != self.letter[y] and self.same(p, q):
            return self.letter[x] < self.letter[y]
        return self.spelled(a) < self.spelled(b)  # two different strings with one hash

    def spelled(self, node: int) -> str:
        """The edits of ``node`` since what is settled."""
        parts = []
        while node:
            parts.append(chr(self.letter[node]))
            node = self.up[0][node]
        return "".join(reversed(parts))

    def text(self, node: int) -> str:
        return "".join(self.settled) + self.spelled(node)

    def _shared(self, a: int, b: int) -> int:
        """The last node that both chains have."""
        n = min(self.depth[a], self.depth[b])
        a, b = self.ancestor(a, n), self.ancestor(b, n)
        for k in range(len(self.up) - 1, -1, -1):
            if self.up[k][a] != self.up[k][b]:
                a, b = self.up[k][a], self.up[k][b]
        return a if a == b else self.up[0][a]

    def settle(self, live: list[int]) -> list[int]:
        """Give up all nodes but the chains of ``live`` after what they share; the nodes that stand for them now."""
        root = live[0]
        for x in live[1:]:
            root = self._shared(root, x)
        chains = []
        for x in live:
            chain = []
            while x != root:
                chain.append((x, chr(self.letter[x])))
                x = self.up[0][x]
            chains.append(chain[::-1])
        self.settled.append(self.spelled(root))
        self.clear()
        known = {root: 0}
        out = []
        for chain in chains:
            at = 0
            for x, letter in chain:
                if x not in known:
                    known[x] = self.add(at, letter)
                at = known[x]
            out.append(at)
        return out


class Repair:
    """The dynamic program over one conversation's rows."""

    def __init__(self, costs: Costs):
        self.costs, self.audits = costs, Audits()
        self.limit = SETTLE_NODES
        #: place: (cost, audit, running hash of the repaired text)
        self.ways = {NOTHING: (0, 0, hashlib.sha256())}
        self._insert()

    def _better(self, best: dict, place: int, cost: int, node: int, letter: str, source: int, piece: bytes | None) -> None:
        """Keep the cheaper way to ``place``, of two at one cost that with the smaller audit."""
        old = best.get(place)
        if old is not None and old[0] < cost:
            return
        new = self.audits.add(node, letter)
        if old is None or cost < old[0] or self.audits.less(new, old[1]):
            best[place] = (cost, new, source, piece)

    def _insert(self) -> None:
        """Ways that insert empty rows here: two at most, since a third would lead to where one was before."""
        for _ in range(2):
            for q, initial in ((NOTHING, "u"), (SYSTEM, "u"), (ASSISTANT, "u"), (USER, "a")):
                if q not in self.ways:
                    continue
                cost, node, digest = self.ways[q]
                to = _LEADS[initial][q]
                old = self.ways.get(to)
                cost += self.costs.insert
                if old is not None and old[0] < cost:
                    continue
                new = self.audits.add(node, "I")
                if old is None or cost < old[0] or self.audits.less(new, old[1]):
                    self.ways[to] = (cost, new, _extended(digest, q, f"{_NAMES[initial]}:".encode()))

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        c, best = self.costs, {}
        more = c.truncated if truncated else 0
        for q, (cost, node, _) in self.ways.items():
            self._better(best, q, cost + c.delete, node, "D", q, None)
            if must_go:
                continue
            to = _LEADS.get(role[:1], {}).get(q)
            if to is not None:
                self._better(best, to, cost + more, node, "K", q, f"{role}:{text}".encode())
            initial = "a" if q == USER else "u"
            self._better(best, _LEADS[initial][q], cost + c.rerole + more, node, "R", q, f"{_NAMES[initial]}:{text}".encode())
        # a way that another one beats whatever follows: after a system row all is as after an assistant row, but for the end;
        # from the beginning one row, a system row, can be kept that must be deleted after an assistant row
        after = best.get(ASSISTANT)
        if after is not None:
            if SYSTEM in best and best[SYSTEM][0] > after[0]:
                del best[SYSTEM]
            if NOTHING in best and best[NOTHING][0] > after[0] + c.delete:
                del best[NOTHING]
        self.ways = {
            to: (cost, node, self.ways[q][2] if piece is None else _extended(self.ways[q][2], q, piece))
            for to, (cost, node, q, piece) in best.items()
        }
        self._insert()
        if len(self.audits.letter) > self.limit:
            live = self.audits.settle([w[1] for w in self.ways.values()])
            self.ways = {q: (w[0], x, w[2]) for (q, w), x in zip(self.ways.items(), live, strict=True)}
            self.limit = max(SETTLE_NODES, 2 * len(self.audits.letter))

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, repaired_sha256)."""
        best = None
        for q in (NOTHING, ASSISTANT):
            if q in self.ways:
                way = self.ways[q]
                if best is None or way[0] < best[0] or (way[0] == best[0] and self.audits.less(way[1], best[1])):
                    best = way
        return best[0], self.audits.text(best[1]), best[2].hexdigest()


def _extended(digest, place: int, piece: bytes):
    """The running hash with one more row; all but the first follow a line end."""
    out = digest.copy()
    if place != NOTHING:
        out.update(b"\n")
    out.update(piece)
    return out


class _Conversation:
    """Figures of one conversation, row by row."""

    def __init__(self, conv: int | None, costs: Costs):
        self.conv, self.repair = conv, Repair(costs)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initial = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, seen: bool, truncated: bool) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in _LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        seen = seen and not blank
        truncated = truncated and not blank and not seen
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + seen, self.truncated + truncated
        self.repair.row(role, text, blank or seen, truncated)

    def row(self) -> tuple:
        cost, audit, digest = self.repair.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


_OUT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after a damage that the crc of ``conv_id:turn`` decides.

    Nulls in role, text and the crc's text are one space.  Dropped rows have 0 copies, so that their conversation is known.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    hit = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), space), F.coalesce(F.col("role"), space)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit.isin(0, 1), "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def _flags(text: Column) -> tuple[Column, Column]:
    """(blank, truncated): no character besides white space; the last such character ends no sentence."""
    return ~text.rlike(r"[^\x20\x09-\x0D]"), ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def repair(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text, copies): its faults and the cheapest edits that mend it.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  Rows go by turn (nulls
    first), then by role and text; each stands ``copies`` times.  Rows without a conv_id are one conversation.  A conversation
    without rows costs nothing.  One shuffle by conv_id serves the search for duplicates and the order; both sort
    outside memory, and a conversation of any length passes its task as a stream.
    """
    if costs.insert <= 0:
        raise ValueError("inserting must cost something")
    blank, truncated = _flags(F.col("text"))
    turn = F.asc_nulls_first("turn")
    here = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies").repartition("conv_id")
    # rows that are dropped are no earlier ones
    alike = Window.partitionBy("conv_id", "role", "text", F.col("copies") > 0).orderBy(turn)
    ranked = here.withColumn("nth", F.row_number().over(alike)).withColumns({"blank": blank, "truncated": truncated})
    ordered = ranked.sortWithinPartitions("conv_id", turn, "role", "text", "nth")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        done: list[tuple] = []
        for batch in batches:
            cols = [column(batch, c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "nth", "blank", "truncated")]
            for conv, at, role, text, copies, nth, empty, cut in zip(*cols, strict=True):
                if now is None or conv != now.conv:
                    done += [now.row()] if now else []
                    now = _Conversation(conv, costs)
                for k in range(copies):
                    now.add(at, role, text, empty, nth + k > 1, cut)
            if done:
                yield _batch(done)
                done = []
        if now:
            yield _batch([now.row()])

    return ordered.mapInArrow(run, ", ".join(f"{n} {_kind(n)}" for n in _OUT))


def _kind(name: str) -> str:
    return "string" if name in ("audit", "repaired_sha256") else "long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[_kind(n)]) for n, c in zip(_OUT, zip(*rows, strict=True), strict=True)], names=_OUT)
