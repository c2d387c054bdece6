"""Bytes of files at given places, read by tasks through a file system that all executors share (any URI that pyarrow opens).

A plain file is read by position, a compressed one forward only, inflated as it streams by; either way a task holds a
window of it and never the whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyarrow import fs

#: Bytes read at a time where little is asked for, and the largest range that several frames are read as.
WINDOW, MERGED = 1 << 18, 8 << 20
#: Bytes between two frames that are read along rather than skipped.
GAP = 1 << 16


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of what Spark or a user calls a file."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def is_compressed(path: str) -> bool:
    return path.lower().endswith(".gz")


class Plain:
    """A file read by position, through one window."""

    def __init__(self, path: str) -> None:
        store, inner = located(path)
        self.file = store.open_input_file(inner)
        self.length = self.file.size()
        self.at, self.held = 0, b""

    def read(self, at: int, size: int) -> bytes:
        """``size`` bytes from ``at``, fewer only at the end of the file."""
        start = at - self.at
        if start < 0 or start + size > len(self.held):
            if size >= WINDOW:
                return self.range(at, size)
            self.at, self.held, start = at, self.range(at, WINDOW), 0
        return self.held[start : start + size]

    def range(self, at: int, size: int) -> bytes:
        return self.file.read_at(min(size, self.length - at), at) if at < self.length else b""

    def close(self) -> None:
        self.file.close()


class Inflated:
    """A gzip file read forward: places may skip, and go back no further than the last one asked for."""

    def __init__(self, path: str) -> None:
        store, inner = located(path)
        self.file = store.open_input_stream(inner, compression=None)
        self.inflater = zlib.decompressobj(wbits=31)
        self.at, self.held = 0, bytearray()

    def read(self, at: int, size: int) -> bytes:
        if at < self.at:
            raise ValueError("a compressed file is read forward only")
        while self.at + len(self.held) < at + size and not self.inflater.eof:
            self._forget(at)
            packed = self.inflater.unconsumed_tail or self.file.read(WINDOW)
            more = self.inflater.decompress(packed, WINDOW)
            if not packed and not more:
                raise zlib.error("Error -5 while decompressing data: incomplete or truncated stream")
            self.held += more
        self._forget(at)
        return bytes(self.held[at - self.at : at - self.at + size])

    def _forget(self, at: int) -> None:
        """Lets go what stands before ``at``."""
        gone = min(len(self.held), at - self.at)
        if gone > 0:
            del self.held[:gone]
            self.at += gone

    def close(self) -> None:
        self.file.close()


def opened(path: str) -> Plain | Inflated:
    return Inflated(path) if is_compressed(path) else Plain(path)


def merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, start, stop): runs of (offset, size), in order, that lie close enough to be read as one range of bytes."""
    first = 0
    while first < len(spans):
        start, stop, last = spans[first][0], sum(spans[first]), first + 1
        while last < len(spans) and 0 <= spans[last][0] - stop <= GAP and sum(spans[last]) - start <= MERGED:
            stop, last = sum(spans[last]), last + 1
        yield first, last, start, stop
        first = last


def payloads(source: Plain | Inflated, spans: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each (offset, size), in order; fewer than asked for is an error."""
    for first, last, start, stop in merged(spans):
        data = source.read(start, stop - start)
        for offset, size in spans[first:last]:
            piece = data[offset - start : offset - start + size]
            if len(piece) < size:
                raise EOFError(f"{size} bytes at {offset} asked for, {len(piece)} there")
            yield piece
