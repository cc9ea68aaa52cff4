"""A folder as a stream of changes, by a streaming data source.

Every trigger is a poll. A task lists one directory below the watched folder
and compares it with what the batch before has seen of it. What a batch sees is
written to a state folder before any row of it is given away: a batch that runs
again, after a failure or a restart, finds that and gives the same rows. So a
change is in exactly one batch, whatever happens in between; offsets are only
moments, and the snapshots stay out of the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from hashlib import sha256

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from pipelens.functions.paths import IGNORED_DIRS
from pipelens.sources.archives import _opened

SCHEMA = "path string, mtime timestamp, size long, change string"


@dataclass
class Directory(InputPartition):
    """A directory below the watched folder ("" is the folder's own files), and the moments of the batch before and of this one."""

    name: str
    before: int
    now: int


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.state = options["path"], options["state"]
        self.ignored = tuple(x for x in options.get("ignored", ",".join(IGNORED_DIRS)).split(",") if x)
        self.last = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        """The moment of this poll, later than all before it and than any snapshot that is kept."""
        self.last = max(int(time.time() * 1000), self.last + 1, 1 + max(self._kept(), default=0))
        return {"at": self.last}

    def _kept(self) -> list[int]:
        fs, root = _opened(self.state)
        return [int(x.base_name) for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.base_name.isdigit()]

    def _seen(self, at: int) -> set[str]:
        """The directories that have a snapshot of a moment."""
        fs, root = _opened(self.state)
        out = set()
        for x in fs.get_file_info(pafs.FileSelector(f"{root}/{at}", allow_not_found=True)):
            if x.base_name.endswith(".json"):
                with fs.open_input_stream(x.path) as f:
                    out.add(json.loads(f.read(1 << 20).split(b"\n", 1)[0])["directory"])
        return out

    def partitions(self, start: dict, end: dict) -> list[Directory]:
        fs, root = _opened(self.path)
        there = [x.base_name for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.type == pafs.FileType.Directory and x.base_name not in self.ignored]
        names = {"", *there} | self._seen(start["at"]) | self._seen(end["at"])
        return [Directory(n, start["at"], end["at"]) for n in sorted(names)]

    def _listed(self, name: str) -> dict[str, list[int]]:
        """mtime (microseconds) and size of the files of a directory, by path; ignored directories are not entered."""
        fs, root = _opened(self.path)
        out, waiting = {}, [f"{root}/{name}" if name else root]
        while waiting:
            try:
                found = fs.get_file_info(pafs.FileSelector(waiting.pop(), allow_not_found=True))
            except NotADirectoryError:  # a file has taken the directory's place
                continue
            for x in found:
                if x.type == pafs.FileType.Directory:
                    if name and x.base_name not in self.ignored:
                        waiting.append(x.path)
                elif x.type == pafs.FileType.File:
                    out[x.path[len(root) :].lstrip("/")] = [x.mtime_ns // 1000, x.size]
        return out

    def _snapshot(self, name: str, at: int) -> str:
        return f"{_opened(self.state)[1]}/{at}/{sha256(name.encode()).hexdigest()[:32]}.json"

    def _read_snapshot(self, name: str, at: int) -> dict[str, list[int]] | None:
        fs, _ = _opened(self.state)
        place = self._snapshot(name, at)
        if fs.get_file_info(place).type == pafs.FileType.NotFound:
            return None
        with fs.open_input_stream(place) as f:
            return {k: v for k, *v in map(json.loads, f.read().split(b"\n")[1:])}

    def _write_snapshot(self, name: str, at: int, files: dict[str, list[int]]) -> None:
        fs, root = _opened(self.state)
        place, made = self._snapshot(name, at), f"{root}/{at}/{uuid.uuid4().hex}.part"
        fs.create_dir(f"{root}/{at}", recursive=True)
        with fs.open_output_stream(made) as f:
            f.write("\n".join([json.dumps({"directory": name}), *(json.dumps([k, *v]) for k, v in sorted(files.items()))]).encode())
        fs.move(made, place)

    def read(self, partition: Directory) -> Iterator[tuple]:
        old = self._read_snapshot(partition.name, partition.before) or {}
        if self._read_snapshot(partition.name, partition.now) is None:
            self._write_snapshot(partition.name, partition.now, self._listed(partition.name))
        new = self._read_snapshot(partition.name, partition.now) or {}
        when = lambda at: datetime.fromtimestamp(at / 1e6, timezone.utc)
        for path, (at, size) in new.items():
            if path not in old:
                yield path, when(at), size, "new"
            elif at > old[path][0] or size != old[path][1]:
                yield path, when(at), size, "changed"
        for path in old.keys() - new.keys():
            yield path, when(old[path][0]), old[path][1], "deleted"

    def commit(self, end: dict) -> None:
        """Drop the snapshots that no batch starts from any more."""
        fs, root = _opened(self.state)
        for at in self._kept():
            if at < end["at"]:
                fs.delete_dir(f"{root}/{at}")


class FolderSource(DataSource):
    """``folder_changes``: options ``path``, ``state`` (a shared folder of the stream's own) and ``ignored`` (directory names)."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options)


def folder_changes(spark: SparkSession, path: str, state: str, ignored: tuple[str, ...] | None = None) -> DataFrame:
    """A stream (path, mtime, size, change) of the files below ``path``: new, changed (later mtime or other size) or deleted.

    The first batch has all files as new. ``state`` holds the snapshots; it
    belongs to the query's checkpoint, and both go or stay together. Paths are
    relative to the folder, and ``ignored`` directories are not looked into. A
    folder that is not there is an empty one. Deleted files come with what they
    last had. Listings of one directory are one task's, so keep speculation off.
    """
    spark.dataSource.register(FolderSource)
    reader = spark.readStream.format("folder_changes").option("path", path).option("state", state)
    return (reader if ignored is None else reader.option("ignored", ",".join(ignored))).load()
