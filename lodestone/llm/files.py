"""Files in any store that pyarrow reaches (local folders, HDFS, object stores), for use inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, parts) -> int:
    """Writes under a name of its own, then renames: a repeated or lost task never leaves half a file.

    Some stores don't rename onto a file that is there.  One that is there is
    whole and was written by an earlier attempt from the same rows: it stays.
    """
    system, path = store(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    n = 0
    with system.open_output_stream(own) as out:
        for part in parts:
            out.write(part)
            n += len(part)
    try:
        system.move(own, path)
    except OSError:
        if system.get_file_info(path).type != fs.FileType.File:
            raise
        system.delete_file(own)
    return n


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = store(uri)
    with system.open_input_file(path) as f:
        return f.read_at(length, offset)
