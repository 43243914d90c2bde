"""Single files in any file system that executors reach, local or remote."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it of a path or address; a plain path is one that all machines mount."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def opened(path: str):
    """A file to read from, with seeking."""
    system, inner = _at(path)
    return system.open_input_file(inner)


def exists(path: str) -> bool:
    system, inner = _at(path)
    return system.get_file_info(inner).type == fs.FileType.File


def put(path: str, data: bytes) -> str:
    """``data`` as a whole file at ``path``, whatever a task that was stopped halfway left there; returns ``path``."""
    system, inner = _at(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    beside = f"{inner}.{uuid.uuid4().hex}"
    with system.open_output_stream(beside) as out:
        out.write(data)
    system.move(beside, inner)
    return path
