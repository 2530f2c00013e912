"""Files read and written piecewise from Python tasks, by place and length."""

from __future__ import annotations

import os
from urllib.parse import quote, urlsplit

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    scheme, _, rest = uri.partition(":") if ":/" in uri else ("", "", uri)
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if scheme else rest
    parts = urlsplit(uri)
    return fs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}{quote(parts.path)}")


def reachable(uri: str) -> bool:
    """Whether Python tasks can open the store at all; if not, only Spark's own readers can."""
    try:
        files, path = store(uri)
        return files.get_file_info(path).type != fs.FileType.NotFound
    except Exception:  # no driver for the scheme, or no access to it from here
        return False


def listed(uris: list[str], suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """URIs and sizes of the files below these folders whose names end so."""
    found = []
    for uri in uris:
        files, path = store(uri)
        root = uri.rstrip("/")
        for f in files.get_file_info(fs.FileSelector(path, recursive=True)):
            if f.type == fs.FileType.File and f.base_name.endswith(suffixes):
                found.append((root + f.path[len(path.rstrip("/")) :], f.size))
    return sorted(found)


def below(uri: str) -> tuple[list[str], bool]:
    """URIs of the folders directly below a folder, and whether it holds files of its own."""
    files, path = store(uri)
    if files.type_name == "local":  # the names alone tell, without a look at each
        with os.scandir(path) as entries:
            found = [(e.name, e.is_dir()) for e in entries]
    else:
        found = [(f.base_name, f.type == fs.FileType.Directory) for f in files.get_file_info(fs.FileSelector(path))]
    return sorted(f"{uri.rstrip('/')}/{name}" for name, folder in found if folder), not all(folder for _, folder in found)


def read_at(uri: str, start: int, length: int) -> bytes:
    files, path = store(uri)
    with files.open_input_file(path) as f:
        return f.read_at(length, start)


def read_all(uri: str) -> bytes:
    files, path = store(uri)
    with files.open_input_stream(path) as f:
        return f.read()
