"""Files of gzip blocks (block gzip): each block is a gzip member of 64 kB at most that says how long it is, so a file
can be cut anywhere and read from the next block on.  Alignments are always kept so, raw reads often."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

#: The largest block, compressed; its first bytes and the name of its size field: fixed values of the format.
LARGEST = 1 << 16
MAGIC, FIELD = b"\x1f\x8b\x08\x04", b"BC"
#: Blocks that have to follow each other before a place counts as the beginning of one.
CHAIN = 3


def block_size(raw: bytes, at: int = 0) -> int | None:
    """The size of the block that begins in ``raw`` at ``at``; None if none does, or its head isn't whole."""
    if raw[at : at + 4] != MAGIC or len(raw) < at + 12:
        return None
    end = at + 12 + struct.unpack_from("<H", raw, at + 10)[0]
    at += 12
    while at + 6 <= min(end, len(raw)):
        size = struct.unpack_from("<H", raw, at + 2)[0]
        if raw[at : at + 2] == FIELD and size == 2:
            return struct.unpack_from("<H", raw, at + 4)[0] + 1
        at += 4 + size
    return None


def is_blocked(f) -> bool:
    """Whether the file begins with a block."""
    f.seek(0)
    return block_size(f.read(LARGEST)) is not None


def first_block(f, start: int, size: int) -> int:
    """The offset of the first block that begins at ``start`` or later in a file of ``size`` bytes; ``size`` if none."""
    if start == 0:
        return 0
    f.seek(start)
    raw = f.read((CHAIN + 1) * LARGEST)
    at = raw.find(MAGIC)
    while 0 <= at < LARGEST:
        here, left = at, CHAIN
        while left and here < len(raw) and (n := block_size(raw, here)):
            here, left = here + n, left - 1
        if not left or start + here == size:
            return start + at
        at = raw.find(MAGIC, at + 1)
    return size


def blocks(f, at: int) -> Iterator[tuple[int, bytes]]:
    """(offset, unpacked bytes) of the blocks from the one at ``at`` on."""
    f.seek(at)
    while head := f.read(18):
        n = block_size(head)
        if n is None:  # further fields before the size
            head += f.read(LARGEST - len(head))
            n = block_size(head)
            if n is None:
                raise ValueError(f"no block at byte {at}")
        raw = head[:n] if len(head) >= n else head + f.read(n - len(head))
        if len(raw) < n:
            raise ValueError(f"the block at byte {at} isn't whole")
        data = zlib.decompress(raw[12 + struct.unpack_from("<H", raw, 10)[0] : -8], -15)
        if (zlib.crc32(data), len(data)) != struct.unpack_from("<II", raw, n - 8):
            raise ValueError(f"the block at byte {at} is damaged")
        yield at, data
        if len(head) > n:
            f.seek(at + n)
        at += n


class Unpacked:
    """The unpacked bytes from a block on, to be read in order; ``own`` of them, as far as blocks have been read, come
    from blocks that begin before ``end``."""

    def __init__(self, f, at: int, end: int) -> None:
        self.blocks, self.end = blocks(f, at), end
        self.own = self.place = 0
        self.reached = -1
        self.held = bytearray()

    def more(self) -> bool:
        """Takes in the next block; False at the end of the file."""
        for at, data in self.blocks:
            if at < self.end:
                self.own += len(data)
            self.reached = at
            self.held += data
            return True
        return False

    def sure_of(self, place: int) -> None:
        """Reads as many blocks as it takes to tell whether the byte at ``place`` is an own one."""
        while self.own <= place and self.reached < self.end and self.more():
            pass

    def begins_inside(self) -> bool:
        """Whether the next byte is an own one."""
        self.sure_of(self.place)
        return self.place < self.own

    def follows_inside(self) -> bool:
        """Whether the byte before the next one is an own one, or there is none before."""
        self.sure_of(self.place)
        return self.place <= self.own

    def read(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.place += len(out)
        return out

    def unread(self, raw: bytes) -> None:
        self.held[:0] = raw
        self.place -= len(raw)

    def readline(self) -> bytes:
        at = 0
        while (found := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            if not self.more():
                return self.read(len(self.held))
        return self.read(found + 1)
