"""Byte files in the shared folder, from tasks: anything that pyarrow has a file system for."""

from __future__ import annotations

import contextlib
import posixpath
from collections.abc import Iterator

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def created(uri: str) -> Iterator:
    """A new file under its name only once it is whole: a lost task leaves no half file that a reader could take for one."""
    system, path = resolve(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    with system.open_output_stream(f"{path}.part", compression=None) as out:
        yield out
    system.move(f"{path}.part", path)
