"""Binary files in the shared folder, written and mapped by workers.

A worker writes under a name of its own and renames the file when it is whole, either
to a name that it returns, so that files of lost or repeated tasks are never read, or to
one that follows from its contents, where a repeated task leaves the same file again.
Folders can be any file system that pyarrow opens.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np


def filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class Writer:
    """A file that appears under its final name when it is closed."""

    def __init__(self, folder: str, name: str, exact: bool = False):
        own = uuid.uuid4().hex
        self.uri = f"{folder.rstrip('/')}/{name}" + ("" if exact else f"-{own}")
        self.fs, self.path = filesystem(self.uri)
        self.part = f"{self.path}-{own}.part"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append and return the place of the first byte."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.uri


def write_arrays(folder: str, name: str, arrays: Iterable[np.ndarray]) -> str:
    """A file of that name with the arrays side by side and their places after them."""
    w, places = Writer(folder, name, exact=True), []
    for a in arrays:
        w.write(b"\0" * (-w.size % 8))
        places.append([w.write(np.ascontiguousarray(a).tobytes()), len(a), a.dtype.str])
    tail = json.dumps(places).encode()
    w.write(tail + len(tail).to_bytes(8, "little"))
    return w.close()


def mapped_arrays(uri: str) -> list[np.ndarray]:
    """The arrays of a file of `write_arrays`; none if there is no such file."""
    from pyarrow import fs

    files, path = filesystem(uri)
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return []
    data = local_map(uri)
    n = int.from_bytes(data[-8:].tobytes(), "little")
    return [view(data, at, size, kind) for at, size, kind in json.loads(data[-8 - n:-8].tobytes())]


def local_map(uri: str) -> np.ndarray:
    """The file's bytes, memory-mapped.  A file of a remote file system is copied once
    for all workers of a machine, under a name that follows from its own, to their
    temporary folder, which goes with the application."""
    from pyarrow import fs

    files, path = filesystem(uri)
    if not files.get_file_info(path).size:
        return np.zeros(0, np.uint8)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    own = os.path.join(tempfile.gettempdir(), f"vellum-{hashlib.md5(uri.encode()).hexdigest()}")
    if not os.path.exists(own):
        fd, part = tempfile.mkstemp()
        with os.fdopen(fd, "wb") as out, files.open_input_stream(path) as src:
            while chunk := src.read(1 << 22):
                out.write(chunk)
        os.replace(part, own)  # of several workers the last one wins, with the same bytes
    return np.memmap(own, np.uint8, "r")


def view(mapped: np.ndarray, at: int, n: int, dtype: str) -> np.ndarray:
    """n numbers of a type that start at a byte of a mapped file."""
    return mapped[at:at + n * np.dtype(dtype).itemsize].view(dtype)
