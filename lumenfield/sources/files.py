"""Files through pyarrow's file systems, so that any task reads its own range of a file in shared storage."""

from __future__ import annotations

import os

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def fetch(path: str, offset: int = 0, size: int | None = None) -> bytes:
    system, name = locate(path)
    with system.open_input_file(name) as f:
        f.seek(offset)
        return f.read(size) if size is not None else f.read()


def length(path: str) -> int:
    system, name = locate(path)
    info = system.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def exists(path: str) -> bool:
    """Whether a file or folder is there, in any file system that pyarrow knows."""
    system, name = locate(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def store(path: str, pieces) -> None:
    system, name = locate(path)
    parent = name.rpartition("/")[0]
    if parent:
        system.create_dir(parent, recursive=True)
    with system.open_output_stream(name, compression=None) as out:
        for p in pieces:
            out.write(p)
