"""Files by byte ranges on any file system that Arrow knows: local, HDFS, object stores."""

from __future__ import annotations

import re

import numpy as np
from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the name in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class ByteFile:
    """Positioned reads of one file."""

    def __init__(self, path: str) -> None:
        system, name = resolve(path)
        self.path, self.file = path, system.open_input_file(name)
        self.size = self.file.size()

    def __enter__(self) -> ByteFile:
        return self

    def __exit__(self, *error) -> None:
        self.file.close()

    def array(self, kind: str, count: int, at: int) -> np.ndarray:
        """``count`` numbers from byte ``at``; an error if the file ends before."""
        item = np.dtype(kind)
        got = np.frombuffer(self.file.read_at(count * item.itemsize, at), item)
        if len(got) != count:
            raise ValueError(f"{self.path}: ends early")
        return got


def is_folder(path: str) -> bool:
    system, name = resolve(path)
    return system.get_file_info(name).type == fs.FileType.Directory


def exists(path: str) -> bool:
    system, name = resolve(path)
    return system.get_file_info(name).type != fs.FileType.NotFound


def remove(path: str) -> None:
    system, name = resolve(path)
    kind = system.get_file_info(name).type
    if kind == fs.FileType.Directory:
        system.delete_dir(name)
    elif kind != fs.FileType.NotFound:
        system.delete_file(name)


def move(source: str, target: str) -> None:
    """Replaces ``target``."""
    remove(target)
    system, name = resolve(source)
    system.move(name, resolve(target)[1])


def make_folder(path: str) -> None:
    system, name = resolve(path)
    system.create_dir(name, recursive=True)


def write(path: str):
    """A stream to a new file, to be closed."""
    system, name = resolve(path)
    return system.open_output_stream(name)
