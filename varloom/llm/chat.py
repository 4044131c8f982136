"""Chat formatting, assembled from tokens.

Every text is encoded by itself, with a tokenizer that knows no reserved strings, and the template's reserved ids are put
around the segments.  So no text can make a reserved id, and tokens never span two segments.  Strings in a text that look like
the template's controls are escaped as well, so that the formatted text is as unambiguous as the tokens:

    <s> [SYS]system text[/SYS] [INST]user text[/INST] assistant text</s> [ROLE]other role[/ROLE]text</s>

(without the blanks).  The loss mask is 1 over the tokens of assistant texts alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import column, list_array

#: Where the public rank file is, and the pattern that goes with it; callers may give others.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens after which a conversation's next turn begins another chunk; a longer turn is a chunk of its own.
CHUNK_TOKENS = 1 << 16
#: White space longer than this is encoded in parts: the pattern's matcher has a stack of bounded depth.
LONGEST_BLANK = 4096

#: Fixed values of the template; their ids follow the vocabulary's in this order.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]")
START, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END = range(len(CONTROLS))

_PLAIN = re.compile(r"(<(?=\\*/?s>)|\[(?=\\*/?(?:INST|SYS|ROLE)\]))")
_ESCAPED = re.compile(r"(<(?=\\+/?s>)|\[(?=\\+/?(?:INST|SYS|ROLE)\]))\\")
_BLANK = re.compile(rf"\s{{{LONGEST_BLANK + 1},}}")


def escape(text: str) -> str:
    """Put one more backslash behind the bracket of every control string, escaped or not."""
    return _PLAIN.sub(r"\1\\", text)


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """Bytes to tokens and back; reserved ids begin at ``first``."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.first = max(table.values()) + 1
        self.raw = [b""] * self.first
        for piece, i in table.items():
            self.raw[i] = piece
        self.raw += [c.encode() for c in CONTROLS]
        self.kind = np.dtype("<u2" if len(self.raw) <= 1 << 16 else "<u4")
        self.tokenizer = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ordinary tokens of a whole text."""
        ids, at = [], 0
        for blank in _BLANK.finditer(text):
            ids += self.tokenizer.encode_ordinary(text[at : blank.start()])
            for k in range(blank.start(), blank.end(), LONGEST_BLANK):
                ids += self.tokenizer.encode_ordinary(text[k : min(k + LONGEST_BLANK, blank.end())])
            at = blank.end()
        return ids + self.tokenizer.encode_ordinary(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode()

    def turn(self, role: str, text: str) -> bytes:
        """A turn's tokens, reserved ones included, packed; both strings are escaped here."""
        c, body = self.first, self.encode(escape(text))
        if role == "user":
            ids = [c + USER, *body, c + USER_END]
        elif role == "system":
            ids = [c + SYSTEM, *body, c + SYSTEM_END]
        elif role == "assistant":
            ids = [*body, c + END]
        else:
            ids = [c + ROLE, *self.encode(escape(role)), c + ROLE_END, *body, c + END]
        return np.array(ids, self.kind).tobytes()


_codecs: dict[int, Codec] = {}


def _codec(ranks: bytes, pattern: str) -> Codec:
    """A worker builds each vocabulary once."""
    key = hash((ranks, pattern))
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


class _Chunks:
    """Turns of conversations, in order, to rows of (conv_id, chunk, n_turns, ids, loss)."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.head = np.array([codec.first + START], codec.kind).tobytes()
        self.conv, self.seen = None, False
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, conv: int | None, role: str, turn: bytes) -> None:
        if not self.seen or conv != self.conv:
            self.cut()
            self.conv, self.seen, self.chunk = conv, True, 0
            self.parts, self.tokens, self.marks = [self.head], 1, []
        n = len(turn) // self.codec.kind.itemsize
        if self.marks and self.tokens + n > CHUNK_TOKENS:
            self.cut()
            self.parts, self.tokens, self.marks, self.chunk = [], 0, [], self.chunk + 1
        self.parts.append(turn)
        self.marks.append((self.tokens, self.tokens + n - 1) if role == "assistant" else (0, 0))
        self.tokens += n

    def cut(self) -> None:
        if self.seen:
            self.rows.append((self.conv, self.chunk, self.marks, b"".join(self.parts)))
            self.held += self.tokens

    def batch(self) -> pa.RecordBatch:
        """All cut chunks.  The mask is the prefix sum of +1 where an assistant's text begins and -1 where it ends."""
        flat = np.frombuffer(b"".join(r[3] for r in self.rows), self.codec.kind)
        start = np.concatenate(([0], np.cumsum([len(r[3]) // self.codec.kind.itemsize for r in self.rows]))).astype(np.int64)
        step = np.zeros(len(flat) + 1, np.int64)
        for base, row in zip(start, self.rows, strict=False):
            span = base + np.array(row[2], np.int64)
            np.add.at(step, span[:, 0], 1)
            np.add.at(step, span[:, 1], -1)
        loss = np.cumsum(step[:-1]) > 0
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in self.rows], pa.int64()),
                pa.array([r[1] for r in self.rows], pa.int32()),
                pa.array([len(r[2]) for r in self.rows], pa.int32()),
                list_array(flat.astype(np.int32), start, pa.int32()),
                list_array(loss, start, pa.bool_()),
            ],
            names=["conv_id", "chunk", "n_turns", "ids", "loss"],
        )
        self.rows, self.held = [], 0
        return out


def format_chats(conversations: DataFrame, ranks_path: str = RANKS_PATH, pattern: str = PATTERN) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) as token chunks: conv_id, chunk, n_turns, ids, loss.

    Turns go by turn (nulls first), role and tokens; equal rows are turns each.  A null role or text is empty, rows
    without a conv_id are one conversation, other columns are left out.  Texts are encoded where they lie; only packed ids
    are shuffled.  A conversation's chunks stand in order in one partition, and a task holds one chunk of it at a time.
    """
    with open(ranks_path, "rb") as file:
        send = conversations.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(send.value, pattern)
        for batch in batches:
            turns = [codec.turn(r, t) for r, t in zip(column(batch, "role").to_pylist(), column(batch, "text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, "conv_id"), column(batch, "turn"), column(batch, "role"), pa.array(turns, pa.binary())], names=["conv_id", "turn", "role", "ids"])

    def assemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(_codec(send.value, pattern))
        for batch in batches:
            for row in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "role", "ids")), strict=True):
                chunks.add(*row)
                if chunks.held > CHUNK_TOKENS:
                    yield chunks.batch()
        chunks.cut()
        if chunks.rows:
            yield chunks.batch()

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = rows.mapInArrow(encode, "conv_id long, turn long, role string, ids binary")
    return (
        turns.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "ids")
        .mapInArrow(assemble, "conv_id long, chunk int, n_turns int, ids array<int>, loss array<boolean>")
    )


def parse(codec: Codec, ids: np.ndarray) -> Iterator[tuple[str, str]]:
    """(role, text) of a chunk's turns, told by the reserved ids alone."""
    c = codec.first
    marks = np.flatnonzero(ids >= c).tolist()
    flat = ids.tolist()
    at = k = 0
    while at < len(flat):
        head = flat[at] - c
        if head == START:
            at, k = at + 1, k + 1
            continue
        role = "assistant"
        if head in (USER, SYSTEM):
            role, at, k = ("user" if head == USER else "system"), at + 1, k + 1
        elif head == ROLE:
            end = marks[k + 1]
            role, at, k = unescape(codec.decode(flat[at + 1 : end])), end + 1, k + 2
        end = marks[k]
        yield role, unescape(codec.decode(flat[at:end]))
        at, k = end + 1, k + 1


class _Reading:
    """What is read of one conversation."""

    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, codec: Codec, ids: np.ndarray, loss: np.ndarray) -> None:
        for role, text in parse(codec, ids):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        self.chars += len(codec.decode(ids.tolist()))
        edge = np.flatnonzero(np.diff(loss.astype(np.int8), prepend=0, append=0))
        for lo, hi in edge.reshape(-1, 2).tolist():
            text = unescape(codec.decode(ids[lo:hi].tolist()))
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, ranks_path: str = RANKS_PATH, pattern: str = PATTERN, ordered: bool = True) -> DataFrame:
    """Per conversation of ``formatted``: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from ids and masks alone.

    turns_sha256 is over role, line end, text, line end of each turn; the loss columns are over the text under the mask.
    ``ordered`` says that chunks come as ``format_chats`` returns them; chunks from a stored table don't.
    """
    with open(ranks_path, "rb") as file:
        send = formatted.sparkSession.sparkContext.broadcast(file.read())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(send.value, pattern)
        now: _Reading | None = None
        done: list[tuple] = []
        for batch in batches:
            convs, all_ids, all_loss = (column(batch, c) for c in ("conv_id", "ids", "loss"))
            for i, conv in enumerate(convs.to_pylist()):
                if now is None or conv != now.conv:
                    done += [now.row()] if now else []
                    now = _Reading(conv)
                now.add(codec, np.asarray(all_ids[i].values), all_loss[i].values.to_numpy(zero_copy_only=False))
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in done], schema=schema)
                done = []
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip(names, now.row(), strict=True))], schema=schema)

    schema = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in names])
    rows = formatted.select("conv_id", "chunk", "ids", "loss")
    if not ordered:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return rows.mapInArrow(run, ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names))
