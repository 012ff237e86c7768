"""Byte ranges of files, read and written by tasks: local paths and every store that Arrow's file systems know."""

from __future__ import annotations

from collections.abc import Callable
from typing import BinaryIO

from pyarrow import fs

#: Bytes that are read at once while headers are walked.
AHEAD = 1 << 16


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. ``file:/a`` and ``file:///a`` are local."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def open_ranged(path: str) -> BinaryIO:
    """A file to seek in; nothing is read on opening."""
    store, at = located(path)
    return store.open_input_file(at)


def reader(f: BinaryIO, length: int) -> Callable[[int, int], bytes]:
    """``read(at, n)`` over a file of this length, shorter at its end; small reads come from a window."""
    window, start = b"", 0

    def read(at: int, n: int) -> bytes:
        nonlocal window, start
        n = max(0, min(n, length - at))
        if not start <= at <= at + n <= start + len(window):
            f.seek(at)
            got = f.read(max(n, min(AHEAD, length - at)))
            if n > AHEAD:
                return got[:n]
            window, start = got, at
        return window[at - start : at - start + n]

    return read
