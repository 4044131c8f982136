"""Blocked gzip files: bytes from a place on, and blocks found from any byte."""

from __future__ import annotations

import struct
import zlib

#: The first bytes of every block: a gzip member with an extra field.
MAGIC = b"\x1f\x8b\x08\x04"
#: No block is longer; more bytes than this hold a whole one.
LONGEST = 1 << 16


def block_size(head: bytes) -> int | None:
    """The size that a block's head states; None if ``head`` begins no block.  A head of 18 bytes is enough as a rule."""
    if head[:4] != MAGIC or len(head) < 12:
        return None
    n = struct.unpack_from("<H", head, 10)[0]
    k, end = 12, min(12 + n, len(head))
    while k + 4 <= end:
        size = struct.unpack_from("<H", head, k + 2)[0]
        if head[k : k + 2] == b"BC" and size == 2 and k + 6 <= end:
            return struct.unpack_from("<H", head, k + 4)[0] + 1
        k += 4 + size
    return None


def inflate(block: bytes) -> bytes:
    """A whole block's content; zlib.error or ValueError if it isn't sound."""
    start = 12 + struct.unpack_from("<H", block, 10)[0]
    data = zlib.decompress(block[start:-8], -15)
    crc, size = struct.unpack("<II", block[-8:])
    if size != len(data) or crc != zlib.crc32(data):
        raise ValueError("a block's content doesn't agree with its sums")
    return data


def find_block(file, begin: int, end: int) -> int | None:
    """Where the first block at ``begin`` or behind starts, before ``end``.

    A place with the magic bytes is a block only if it inflates and its sums agree, so bytes that look like a head inside
    compressed data aren't taken for one.
    """
    at, held = begin, b""
    while at < end:
        file.seek(at)
        held = file.read(2 * LONGEST)
        place = held.find(MAGIC)
        if place < 0:
            if len(held) < 2 * LONGEST:
                return None
            at += len(held) - len(MAGIC) + 1
            continue
        if at + place >= end:
            return None
        if place:
            at += place
            continue
        size = block_size(held)
        if size is not None and size <= len(held):
            try:
                inflate(held[:size])
                return at
            except (ValueError, zlib.error, struct.error):
                pass
        at += 1
    return None


def deflate(data: bytes) -> bytes:
    """A block of at most 65,280 bytes of content."""
    packed = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packed.compress(data) + packed.flush()
    return MAGIC + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


#: The empty block that ends a file.
TAIL = deflate(b"")
#: Bytes of content that go into a block.
CONTENT = 0xFF00


class Stream:
    """The bytes of a file's blocks from a place (a block's offset and 16 bits inside it) on."""

    def __init__(self, file, place: int):
        self.file, self.next, self.data, self.at = file, place >> 16, b"", 0
        self.start, self.ends = self.next, False
        #: (where a block begins in the data, its place in the file), the oldest first
        self.blocks: list[tuple[int, int]] = []
        if self._more():
            self.at = place & 0xFFFF

    def _more(self) -> bool:
        self.file.seek(self.next)
        head = self.file.read(18)
        if len(head) < 12:
            self.ends = True
            return False
        size = block_size(head)
        if size is None:  # other fields stand before the size
            head += self.file.read(12 + struct.unpack_from("<H", head, 10)[0] - len(head)) if head[:4] == MAGIC else b""
            size = block_size(head)
        if size is None:
            raise ValueError(f"no block at {self.next}")
        block = head + self.file.read(size - len(head))
        self.data, self.blocks = self.data[self.at :], [(a - self.at, c) for a, c in self.blocks]
        self.at = 0
        self.blocks = [b for k, b in enumerate(self.blocks) if k + 1 == len(self.blocks) or self.blocks[k + 1][0] > 0]
        self.blocks.append((len(self.data), self.next))
        self.data += zlib.decompress(block[12 + struct.unpack_from("<H", block, 10)[0] : -8], -15)
        self.next += size
        return True

    def have(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            if not self._more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.have(n):
            raise ValueError("the file ends inside a record")
        self.at += n
        return self.data[self.at - n : self.at]

    def place(self) -> int:
        """The place of the next byte; at a block's end that of the next block."""
        begin, where = [b for b in self.blocks if b[0] <= self.at][-1]
        return where << 16 | (self.at - begin)

    def read_bytes(self) -> int:
        """Compressed bytes read so far."""
        return self.next - self.start
