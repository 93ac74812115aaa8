"""Raw files in the shared folder, written and read by tasks.

Any store that pyarrow can open by its address works: file, hdfs, s3, gs.
"""

from __future__ import annotations

import posixpath
import uuid
from contextlib import contextmanager

from pyarrow import fs

TEMPORARY = ".tmp-"


def store(address: str) -> tuple[fs.FileSystem, str]:
    if address.startswith("/"):
        return fs.LocalFileSystem(), address
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(address)


def sizes(folder: str, suffix: str) -> list[tuple[str, int]]:
    """Name and bytes of the finished files of a folder."""
    where, path = store(folder)
    found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.base_name.endswith(suffix) and TEMPORARY not in f.base_name)


def make_folder(folder: str) -> None:
    where, path = store(folder)
    where.create_dir(path, recursive=True)


def drop_temporary(folder: str) -> None:
    """Remove what lost attempts of tasks have left."""
    where, path = store(folder)
    for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if TEMPORARY in f.base_name:
            where.delete_file(f.path)


@contextmanager
def committed(folder: str, name: str):
    """A stream to a file that appears under its name only when complete. Attempts of
    the same task write the same bytes, so it does not matter whose rename is last."""
    where, path = store(folder)
    final, temporary = posixpath.join(path, name), posixpath.join(path, f"{TEMPORARY}{uuid.uuid4().hex}-{name}")
    with where.open_output_stream(temporary, compression=None) as out:
        yield out
    try:
        where.move(temporary, final)
    except OSError:
        if where.get_file_info(final).type != fs.FileType.File:
            raise
        where.delete_file(temporary)


def open_file(folder: str, name: str):
    where, path = store(folder)
    return where.open_input_file(posixpath.join(path, name))
