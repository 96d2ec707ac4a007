"""Bytes by ranges: files of any size in any store, parts of them, and packed streams, at constant memory.

Ranged stands in for bytes where walks jump about: it has a length, slices, single bytes, find and rfind, and
holds one window. Forward is read from front to back: it takes, passes over and searches for line ends in what a
Ranged or an iterator of blocks gives.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator

WINDOW, BLOCK = 1 << 18, 1 << 22
Marks = bytes | tuple[bytes, ...]


class Ranged:
    """size bytes, of which read(at, n) gives n from at on."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size
        self.low, self.held = 0, b""

    @classmethod
    def of(cls, data: bytes) -> Ranged:
        return cls(lambda at, n: data[at : at + n], len(data))

    def __len__(self) -> int:
        return self.size

    def part(self, start: int, size: int) -> Ranged:
        """size bytes from start on, as far as there are any; nothing is copied."""
        size = max(0, min(size, self.size - start))
        return Ranged(lambda at, n: self.read(start + at, max(0, min(n, size - at))), size)

    def _at(self, at: int, n: int) -> bytes:
        i = at - self.low
        if i < 0 or i + n > len(self.held):
            if n > WINDOW:
                return self.read(at, n)
            self.low, self.held, i = at, self.read(at, min(WINDOW, self.size - at)), 0
        return self.held[i : i + n]

    def __getitem__(self, at: int | slice):
        if isinstance(at, slice):
            start, stop, _ = at.indices(self.size)
            return self._at(start, stop - start) if stop > start else b""
        i = at - self.low
        if 0 <= i < len(self.held):
            return self.held[i]
        if not -self.size <= at < self.size:
            raise IndexError(at)
        return self._at(at % self.size, 1)[0]

    def startswith(self, marks: Marks) -> bool:
        return self[:64].startswith(marks)

    def find(self, mark: bytes, start: int = 0, end: int | None = None) -> int:
        end = self.size if end is None else min(end, self.size)
        at, step = start, WINDOW
        while at + len(mark) <= end:
            n = min(step + len(mark) - 1, end - at)
            got = self._at(at, n).find(mark)
            if got >= 0:
                return at + got
            at, step = at + n - len(mark) + 1, min(step * 4, BLOCK)
        return -1

    def rfind(self, mark: bytes, start: int = 0) -> int:
        end = self.size
        while end - start >= len(mark):
            low = max(start, end - BLOCK)
            got = self._at(low, end - low).rfind(mark)
            if got >= 0:
                return low + got
            if low == start:
                return -1
            end = low + len(mark) - 1
        return -1

    def blocks(self, at: int = 0, size: int = BLOCK) -> Iterator[bytes]:
        while at < self.size:
            block = self.read(at, min(size, self.size - at))
            if not block:
                raise OSError(f"the file ends at {at} of {self.size} bytes")
            yield block
            at += len(block)

    def file(self) -> io.BufferedReader:
        return io.BufferedReader(_File(self), WINDOW)


class _File(io.RawIOBase):
    def __init__(self, data: Ranged):
        self.data, self.at = data, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, len(self.data))[whence])
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, into) -> int:
        got = self.data.read(self.at, min(len(into), max(0, len(self.data) - self.at)))
        into[: len(got)] = got
        self.at += len(got)
        return len(got)


class Forward:
    """Bytes from front to back. at: how many were taken or passed over; last: the final 16 of those read so far."""

    KEEP = 4096

    def __init__(self, blocks: Iterator[bytes], source: Ranged | None = None):
        self.source, self.next = source, blocks
        self.held, self.i, self.base, self.last = b"", 0, 0, b""

    @classmethod
    def over(cls, data: bytes | Ranged) -> Forward:
        data = data if isinstance(data, Ranged) else Ranged.of(data)
        return cls(data.blocks(0, WINDOW), data)

    @property
    def at(self) -> int:
        return self.base + self.i

    def _more(self) -> bool:
        """The next block in the place of the one held, which must be used up."""
        block = next(self.next, b"")
        self.base, self.i, self.held = self.base + len(self.held), 0, block
        self.last = (self.last + block)[-16:]
        return bool(block)

    def peek(self, n: int) -> bytes:
        """Up to n bytes, which remain to be read."""
        got = [self.held[self.i :]]
        size = len(got[0])
        while size < n and (block := next(self.next, b"")):
            got.append(block)
            self.last = (self.last + block)[-16:]
            size += len(block)
        if len(got) > 1:
            self.base, self.i, self.held = self.base + self.i, 0, b"".join(got)
        return self.held[self.i : self.i + n]

    def byte(self) -> int | None:
        if self.i == len(self.held) and not self._more():
            return None
        self.i += 1
        return self.held[self.i - 1]

    def take(self, n: int) -> bytes:
        """n bytes, or those that are left."""
        got = self.held[self.i : self.i + n]
        self.i += len(got)
        while len(got) < n and self._more():
            part = self.held[: n - len(got)]
            self.i, got = len(part), got + part
        return got

    def skip(self, n: int) -> bool:
        """Passes over n bytes, without reading them where the source allows; whether there were so many."""
        left = n - (len(self.held) - self.i)
        if left <= 0:
            self.i += n
            return True
        if self.source is not None:
            to = self.at + n
            if to >= len(self.source):
                self.base, self.i, self.held, self.next = len(self.source), 0, b"", iter(())
                return to == len(self.source)
            self.base, self.i, self.held, self.next = to, 0, b"", self.source.blocks(to, WINDOW)
            return True
        while self._more():
            if left <= len(self.held):
                self.i = left
                return True
            left -= len(self.held)
        return False

    def line(self) -> bytes | None:
        """What comes before the next newline, which is passed over; only the first KEEP bytes of it. Null if there is no newline."""
        got = b""
        while True:
            end = self.held.find(b"\n", self.i)
            got = (got + self.held[self.i : end if end >= 0 else None])[: self.KEEP] if len(got) < self.KEEP else got
            if end >= 0:
                self.i = end + 1
                return got
            if not self._more():
                return None

    def rest(self) -> bytes:
        """Reads to the end; the last 16 bytes of all."""
        if self.source is not None:
            return self.source[-16:]
        while self._more():
            pass
        return self.last


class _Local:
    """A local file, closed when nothing can read it any more."""

    def __init__(self, path: str):
        self.fd = os.open(path, os.O_RDONLY)
        self.size = os.fstat(self.fd).st_size

    def read(self, at: int, n: int) -> bytes:
        return os.pread(self.fd, n, at)

    def __del__(self) -> None:
        if hasattr(self, "fd"):
            os.close(self.fd)


def opened(path: str) -> Ranged:
    """The file at a path or, by its scheme, in a store that pyarrow reaches."""
    if "://" not in path and not path.startswith("file:"):
        file = _Local(path)
        return Ranged(file.read, file.size)
    fs, inner = store(path)
    file = fs.open_input_file(inner)
    return Ranged(lambda at, n: file.read_at(n, at), file.size())


def store(url: str):
    """The file system of a URL and the path in it."""
    from pyarrow import fs

    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(url)
