"""Files that executors write and read at any address PyArrow knows (file, hdfs, s3, gs), with atomic names."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(uri: str):
    """The file system and path of an address."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


def write(uri: str, data: bytes) -> None:
    """Write under a temporary name, then rename: readers see whole files only, and a repeated task replaces its like."""
    system, path = at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path.rpartition('/')[0]}/_temporary-{uuid.uuid4().hex}"
    with system.open_output_stream(temporary, compression=None) as f:
        f.write(data)
    system.move(temporary, path)


def read(uri: str) -> bytes:
    system, path = at(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()
