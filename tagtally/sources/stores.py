"""Files of any store, by byte range, for tasks that run outside Spark's own scans."""

from __future__ import annotations

import re
from urllib.parse import unquote


def store_of(path: str):
    """The store of a path and the path in it. Local paths may have a ``file:`` scheme; others need one that pyarrow knows (hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    if re.match(r"^file:", path) or not re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return fs.LocalFileSystem(), unquote(re.sub(r"^file:(//[^/]*)?", "", path)) if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


def opened(path: str):
    """A file for reading at any place."""
    store, name = store_of(path)
    return store.open_input_file(name)


def create(path: str):
    """A new file, with its folders where the store has such."""
    store, name = store_of(path)
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(name)


def rename(old: str, new: str) -> None:
    store, name = store_of(old)
    store.move(name, store_of(new)[1])


def remove(path: str) -> None:
    """A file or folder goes, if it is there."""
    from pyarrow import fs

    store, name = store_of(path)
    kind = store.get_file_info(name).type
    if kind == fs.FileType.Directory:
        store.delete_dir(name)
    elif kind == fs.FileType.File:
        store.delete_file(name)


def exists(path: str) -> bool:
    from pyarrow import fs

    store, name = store_of(path)
    return store.get_file_info(name).type != fs.FileType.NotFound
