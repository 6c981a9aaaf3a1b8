"""Gzip data with faults, inflated as a stream: wrong checksums, a cut end, damaged members between whole ones."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

MAGIC = b"\x1f\x8b\x08"  # fixed by the format: two magic bytes and the only method
STEP = 1 << 20
HEADER = 1 << 16  # a member's header is sought in so many bytes
TRIAL = 1 << 15  # bytes that a place found after a fault must give before it counts as a member


class Source:
    """Bytes of a file from a place on, read in steps; what lies before the place is forgotten."""

    def __init__(self, read: Callable[[int], bytes], step: int = STEP):
        self.read, self.step, self.data, self.ended = read, step, b"", False

    def hold(self, size: int) -> bytes:
        """At least ``size`` bytes from here, fewer only at the end."""
        while len(self.data) < size and not self.ended:
            more = self.read(self.step)
            self.ended = not more
            self.data += more
        return self.data

    def skip(self, size: int) -> None:
        self.data = self.data[size:]


def body(data: bytes) -> int | None:
    """Where the compressed bytes of a member begin, None where no whole header stands."""
    if data[:3] != MAGIC or len(data) < 10 or data[3] & 0xE0:
        return None
    flags, at = data[3], 10
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            end = data.find(b"\0", at)
            if end < 0:
                return None
            at = end + 1
    at += 2 * bool(flags & 2)
    return at if at < len(data) else None


def sound(data: bytes) -> bool:
    """Whether data begins with a member that can be inflated for a while, or to its end."""
    at = body(data)
    if at is None:
        return False
    unpack = zlib.decompressobj(-zlib.MAX_WBITS)
    try:
        return len(unpack.decompress(data[at:], TRIAL)) > 0 or unpack.eof
    except zlib.error:
        return False


def inflate(read: Callable[[int], bytes], step: int = STEP) -> Iterator[bytes]:
    """The contents of all members in pieces of ``step`` at most, whatever their checksums; a member that breaks off gives what stands before
    the fault, and the next place that holds a member is sought behind it. A line that a fault has cut ends there."""
    source, faulty = Source(read, step), False
    while source.hold(HEADER):
        at = body(source.data) if not faulty or sound(source.data) else None
        if at is None:
            place = source.data.find(MAGIC, 1)
            # the last two bytes may be the beginning of a place
            source.skip(place if place > 0 else max(1, len(source.data) - 2))
            continue
        source.skip(at)
        unpack, faulty, check, last = zlib.decompressobj(-zlib.MAX_WBITS), False, 0, b"\n"
        while not unpack.eof and source.hold(1):
            given, source.data = source.data, b""
            try:
                piece = unpack.decompress(given, step)
            except zlib.error:
                source.data, faulty = given[1:], True
                break
            source.data = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            if piece:
                check, last = zlib.crc32(piece, check), piece[-1:]
                yield piece
        right = unpack.eof and int.from_bytes(source.hold(8)[:4], "little") == check
        if unpack.eof:
            source.skip(8)
        # a line goes on in the next member only behind a whole one
        if not right and last != b"\n":
            yield b"\n"


def lines(pieces: Iterator[bytes]) -> Iterator[list[str]]:
    """Lines of inflated pieces, in lists; bytes that are no UTF-8 are replaced."""
    held = b""
    for piece in pieces:
        *whole, held = (held + piece).split(b"\n")
        if whole:
            yield [x.rstrip(b"\r").decode("utf-8", "replace") for x in whole]
    if held:
        yield [held.decode("utf-8", "replace")]
