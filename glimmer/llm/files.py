"""Files in the shared folder, written by executors."""

from __future__ import annotations

import re
import uuid


def _at(uri: str):
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def put(folder: str, name: str, data: bytes) -> None:
    """Write folder/name whole or not at all: a task that is run again replaces the file by an equal one."""
    store, base = _at(folder)
    store.create_dir(base, recursive=True)
    part = f"{base}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    from pyarrow import fs

    target = f"{base}/{name}"
    if type(store).__name__ != "LocalFileSystem" and store.get_file_info(target).type != fs.FileType.NotFound:
        store.delete_file(target)
    store.move(part, target)


def get(folder: str, name: str, start: int = 0, size: int | None = None) -> bytes:
    """size bytes of folder/name from start on; all from there where size is None."""
    store, base = _at(folder)
    with store.open_input_file(f"{base}/{name}") as f:
        f.seek(start)
        return f.read(size)
