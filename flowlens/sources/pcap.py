"""Captures as a Spark data source: batch and streaming reader, and writer.

`spark.read.format("pcap").load(path)` gives a row for each frame; one partition per file, as records chain. A file that
breaks off, or has a record beyond its own limit, ends there; with the option `reasons` its last row says why. The column
`arrived` is the latest time in the file so far: with it frames of several captures are one stream in order of time, in
which each capture keeps its own order.
"""

from __future__ import annotations

import contextlib
import glob
import itertools
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from flowlens.schemas import CAPTURED

MAGIC = 0xA1B2C3D4
LARGEST = 65535
#: Snapshot length that a written file names when none is given.
SNAPLEN = 262144
ETHERNET = 1


class CaptureError(ValueError):
    """A file that is no capture that can be read."""


def _plain(path: str) -> str:
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme == "file" else path


def _open(path: str):
    if urlparse(path).scheme in ("", "file"):
        return open(_plain(path), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _arrived(path: str) -> list[tuple[int, str]]:
    """The captures at a path with the time each came under its name, in that order."""
    if urlparse(path).scheme in ("", "file"):
        # a rename sets the time of change, not that of modification
        found = [(os.stat(p).st_ctime_ns, p) for p in (files_at(path) if os.path.isdir(_plain(path)) or glob.glob(_plain(path)) else [])]
    else:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(path)
        found = [(store.get_file_info(fs.FileSystem.from_uri(p)[1]).mtime_ns or 0, p) for p in files_at(path)]
    return sorted(found)


def files_at(path: str) -> list[str]:
    """The captures that a path, folder or pattern names, in order of name."""
    path = _plain(path)
    if urlparse(path).scheme:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.Directory:
            root = path.rstrip("/")
            return sorted(f"{root}/{x.base_name}" for x in store.get_file_info(fs.FileSelector(inner)) if x.is_file and not x.base_name.startswith((".", "_")))
        return [path]
    if os.path.isdir(path):
        return sorted(e.path for e in os.scandir(path) if e.is_file() and not e.name.startswith((".", "_")))
    found = sorted(glob.glob(path))
    if not found:
        raise CaptureError(f"no capture at {path}")
    return found


def read_frames(path: str, reasons: bool = False, count: int | None = None) -> Iterator[tuple]:
    """Rows of a capture."""
    with _open(path) as f:
        head = f.read(24)
        order = next((o for o in "<>" if len(head) == 24 and struct.unpack_from(f"{o}I", head)[0] == MAGIC), None)
        if order is None:
            raise CaptureError(f"not a capture with microsecond records: {path}")
        snaplen, network = struct.unpack_from(f"{order}II", head, 16)
        frame, arrived = 0, 0
        while count is None or frame < count:
            record = f.read(16)
            why = None
            if len(record) < 16:
                why = "truncated record header" if record else None
                data = None
            else:
                sec, usec, kept, original = struct.unpack(f"{order}IIII", record)
                if kept > snaplen or kept > LARGEST:
                    why, data = "record too long", None
                else:
                    data = f.read(kept)
                    if len(data) < kept:
                        why, data = "truncated record", None
            if data is None:
                if reasons and why:
                    yield (path, frame, None, None, None, None, network, None, arrived, why)
                return
            arrived = max(arrived, sec * 1_000_000 + usec)
            row = (path, frame, sec, usec, kept, original, network, data, arrived)
            yield (*row, None) if reasons else row
            frame += 1


def header(link_type: int = ETHERNET, snaplen: int = 0) -> bytes:
    return struct.pack("<IHHiIII", MAGIC, 2, 4, 0, 0, snaplen or SNAPLEN, link_type)


def record(sec: int, usec: int, data: bytes) -> bytes:
    return struct.pack("<IIII", sec, usec, len(data), len(data)) + data


@dataclass
class _File(InputPartition):
    path: str


class PcapSource(DataSource):
    """Options: path; reasons (a column `why` for what ended a file); count (frames of each file at most); snaplen;
    maxFilesPerTrigger (files of a stream's batch)."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return CAPTURED + (", why string" if self._reasons() else "")

    def _reasons(self) -> bool:
        return str(self.options.get("reasons", "false")).lower() == "true"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise CaptureError("no path given")
        return self.options["path"]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._path(), self._reasons(), self.options.get("count"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        most = self.options.get("maxFilesPerTrigger")
        return _Arrivals(self._path(), self._reasons(), None if most is None else int(most))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self._path(), schema.names, int(self.options.get("snaplen", 0)), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, path: str, reasons: bool, count: str | None):
        self.path, self.reasons, self.count = path, reasons, None if count is None else int(count)

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in files_at(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return read_frames(partition.path, self.reasons, self.count)


class _Arrivals(DataSourceStreamReader):
    """Captures that come into a folder, in order of arrival; a finished file must come under its name at once, by a rename.

    An offset is the time and name of the last file taken, so a file of any name that comes later is later, and a
    restarted query asks for the same files again; tasks read a file each. A batch takes at most `most` files.
    """

    def __init__(self, path: str, reasons: bool, most: int | None):
        self.path, self.reasons, self.most, self.taken = path, reasons, most, (0, "")

    def initialOffset(self) -> dict:
        return {"time": 0, "after": ""}

    def latestOffset(self) -> dict:
        new = [x for x in _arrived(self.path) if x > self.taken][: self.most]
        time, after = new[-1] if new else self.taken
        return {"time": time, "after": after}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = (start["time"], start["after"]), (end["time"], end["after"])
        self.taken = max(self.taken, last)
        return [_File(p) for t, p in _arrived(self.path) if first < (t, p) <= last]

    def read(self, partition: _File) -> Iterator[tuple]:
        return read_frames(partition.path, self.reasons)


@dataclass
class _Written(WriterCommitMessage):
    temporary: str | None
    final: str | None


class _Writer(DataSourceWriter):
    """One capture per partition, under its name only once all are complete; frames in the order they come.

    The folder is any that pyarrow reaches, so executors elsewhere write to the same place as the driver.
    """

    def __init__(self, path: str, names: list[str], snaplen: int, overwrite: bool):
        self.path, self.names, self.snaplen, self.overwrite = path, names, snaplen, overwrite
        self.job = uuid.uuid4().hex[:8]

    def _store(self):
        from pyarrow import fs

        if urlparse(self.path).scheme in ("", "file"):
            return fs.LocalFileSystem(), os.path.abspath(_plain(self.path))
        return fs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, folder = self._store()
        store.create_dir(folder, recursive=True)
        row = next(rows, None)
        if row is None:
            return _Written(None, None)
        temporary = f"{folder}/.part-{part:05d}-{self.job}-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as f:
            link = row["link_type"] if "link_type" in self.names else None
            f.write(header(ETHERNET if link is None else link, self.snaplen))
            for row in itertools.chain([row], rows):
                f.write(record(row["ts_sec"] or 0, row["ts_usec"] or 0, bytes(row["data"])))
        return _Written(temporary, f"{folder}/part-{part:05d}-{self.job}.pcap")

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, folder = self._store()
        store.create_dir(folder, recursive=True)
        old = [x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.path.endswith(".pcap")] if self.overwrite else []
        for m in messages:
            if m and m.final:
                store.move(m.temporary, m.final)
        for p in old:
            store.delete_file(p)

    def abort(self, messages: list) -> None:
        store, _ = self._store()
        for m in messages:
            if m and m.temporary:
                with contextlib.suppress(FileNotFoundError):
                    store.delete_file(m.temporary)


def register(spark) -> None:
    spark.dataSource.register(PcapSource)
