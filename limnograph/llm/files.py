"""Binary files on whatever store the shared folder is on."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyarrow import fs


def write_whole(uri: str, pieces: Iterable[bytes]) -> int:
    """Write a file under a name of its own and then give it its final name; returns its bytes.

    A task that is run again, or twice at the same time, replaces the file by an equal one.
    """
    store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with store.open_output_stream(part) as out:
        for piece in pieces:
            out.write(piece)
            size += len(piece)
    store.move(part, path)
    return size
