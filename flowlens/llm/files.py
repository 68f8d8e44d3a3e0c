"""Files in the shared folder, written and read by tasks."""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


@contextlib.contextmanager
def whole_output(uri: str) -> Iterator[pa.NativeFile]:
    """A file that appears under its name only when it is complete; a task that runs again replaces it by equal bytes."""
    mark = f".{uuid.uuid4().hex}.tmp"
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with pa.OSFile(path + mark, "wb") as out:
            yield out
        os.replace(path + mark, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path + mark) as out:
        yield out
    store.move(path + mark, path)


@contextlib.contextmanager
def mapped_input(uri: str) -> Iterator[pa.NativeFile]:
    """A file for random access; mapped into memory, not read, where it is local."""
    if path := _local(uri):
        with pa.memory_map(path) as source:
            yield source
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        yield source
