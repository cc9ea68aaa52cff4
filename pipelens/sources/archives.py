"""Tar archives as a data source: read member by member, written whole or not at all.

A read streams an archive through one task, a piece at a time, so neither the
archive nor a member has to fit in memory; small archives share a task. The
schema that is asked for decides the work: contents are kept only where
``content`` is in it, digests taken only where ``sha256`` is.

A write gives each archive of its rows a file of its own, with members in the
order of the rows and headers that say nothing of the time or the machine, so
the same rows make the same bytes. Tasks write to a folder beside the archives;
what they name when the job commits is moved, all else goes.

Paths are those of ``pyarrow.fs``: a folder that all machines mount, or a store
that it can open.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from hashlib import sha256

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed value: the member that describes an archive.
MANIFEST = "capsule.json"
SCHEMA = "archive string, path string, size long, mode int, mtime timestamp, sha256 string, content binary, error string"
#: Bytes of archives that a task reads at least, bytes of a member that are read at a time, and the largest content that a row holds.
TASK_BYTES, PIECE, CONTENT = 64 << 20, 1 << 20, 64 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Ends:
    """A stream that remembers its length and last kilobyte; behind its members a whole tar archive has an empty one."""

    def __init__(self, raw):
        self.raw, self.tail, self.length = raw, b"", 0

    def read(self, n: int = -1) -> bytes:
        data = self.raw.read(n)
        self.tail, self.length = (self.tail + data)[-1024:], self.length + len(data)
        return data


@dataclass
class Archives(InputPartition):
    names: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.path = schema.names, options["path"]
        self.most = int(options.get("contentlimit", CONTENT))
        self.suffixes = tuple(x for x in options.get("suffixes", "").split(",") if x)

    def partitions(self) -> list[Archives]:
        """Archives in byte order, small ones together."""
        fs, root = _opened(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File]
        found = sorted((x.path, x.size) for x in found if x.path.endswith(self.suffixes or "") and not x.path.rsplit("/", 1)[-1].startswith(("_", ".")) and "/_" not in x.path[len(root) :])
        out, held = [], 0
        for name, size in found:
            if not out or held >= TASK_BYTES:
                out.append(Archives([]))
                held = 0
            out[-1].names.append(name)
            held += size
        return out or [Archives([])]

    def read(self, partition: Archives) -> Iterator[tuple]:
        fs, root = _opened(self.path)
        for name in partition.names:
            archive = name[len(root) :].lstrip("/") or name.rsplit("/", 1)[-1]
            with fs.open_input_stream(name, compression=None, buffer_size=PIECE) as raw:
                for row in self._members(raw):
                    yield tuple({"archive": archive, **row}.get(c) for c in self.columns)

    def _members(self, raw) -> Iterator[dict]:
        """A row for each file of an archive; what cannot be read is a row with ``error``, after all that could be."""
        head = raw.read(2)
        whole = _Joined(head, raw)
        stream = _Ends(gzip.GzipFile(fileobj=io.BufferedReader(whole, PIECE)) if head == b"\x1f\x8b" else io.BufferedReader(whole, PIECE))
        row, end = {}, 0
        try:
            with tarfile.open(fileobj=stream, mode="r|", bufsize=PIECE) as tar:
                for member in tar:
                    end = member.offset_data + (-(-member.size // 512) * 512 if member.isfile() else 0)
                    if not member.isfile():
                        continue
                    row = {"path": member.name, "size": member.size, "mode": member.mode, "mtime": datetime.fromtimestamp(member.mtime, timezone.utc)}
                    row |= self._contents(tar.extractfile(member), member.size)
                    yield row
                    row = {}
            while stream.read(PIECE):  # up to the check of the whole
                pass
            if stream.tail.strip(b"\0") or stream.length < end + 1024:
                yield {"error": "the archive ends without its end mark"}
        except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
            yield {k: v for k, v in row.items() if k in ("path", "size", "mode", "mtime")} | {"error": f"{type(e).__name__}: {e}"}

    def _contents(self, data, size: int) -> dict:
        """Read a member in pieces to its end, whatever of it is asked for, so that a cut one is noticed."""
        digest, keep = sha256() if "sha256" in self.columns else None, [] if "content" in self.columns and size <= self.most else None
        left = size
        while piece := data.read(PIECE):
            left -= len(piece)
            if digest:
                digest.update(piece)
            if keep is not None:
                keep.append(piece)
        if left:
            raise EOFError(f"{left} bytes are missing")
        return {"sha256": digest and digest.hexdigest(), "content": None if keep is None else b"".join(keep)}


class _Joined(io.RawIOBase):
    """A stream with what was already read of it in front."""

    def __init__(self, head: bytes, raw):
        self.head, self.raw = head, raw

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.head[: len(buffer)] or self.raw.read(len(buffer))
        self.head = self.head[len(buffer) :]
        buffer[: len(data)] = data
        return len(data)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArchiveWriter(DataSourceWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        for c in ("archive", "path", "content"):
            if c not in schema.names:
                raise ValueError(f"archives are written from archive, path and content; {c} is missing")
        self.path, self.overwrite, self.job = options["path"], overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        """Archives from rows that come by archive."""
        fs, root = _opened(self.path)
        fs.create_dir(f"{root}/{self.job}", recursive=True)
        files, name, out, tar, seen = [], None, None, None, set()

        def close() -> None:
            if tar is not None:
                tar.close()
                out[1].close()
                out[0].close()

        try:
            for row in rows:
                if row["archive"] is None or row["path"] is None:
                    raise ValueError("a member without an archive or a path")
                if row["archive"] != name or tar is None:
                    close()
                    name = row["archive"]
                    if name in seen:
                        raise ValueError(f"rows of {name} are not together; sort them by archive")
                    seen.add(name)
                    made = f"{root}/{self.job}/{uuid.uuid4().hex}"
                    files.append((made, f"{root}/{name}"))
                    raw = fs.open_output_stream(made, compression=None)
                    packed = gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0)
                    out, tar = (raw, packed), tarfile.open(fileobj=packed, mode="w|", format=tarfile.PAX_FORMAT, bufsize=PIECE)
                data = bytes(row["content"] or b"")
                member = tarfile.TarInfo(row["path"])
                member.size, member.mode, member.mtime = len(data), 0o644, 0
                tar.addfile(member, io.BytesIO(data))
            close()
        except BaseException:
            for made, _ in files:
                try:
                    fs.delete_file(made)
                except OSError:
                    pass
            raise
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = _opened(self.path)
        moves = [x for m in messages if m for x in m.files]
        names = [to for _, to in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two tasks wrote an archive of one name; deal the rows out by archive")
        if not self.overwrite and (there := [x.path for x in fs.get_file_info(names) if x.type != pafs.FileType.NotFound]):
            self.abort(messages)
            raise FileExistsError(there[0])
        for made, to in moves:
            fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
            fs.move(made, to)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, root = _opened(self.path)
        if fs.get_file_info(f"{root}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.job}")


class ArchiveSource(DataSource):
    """``tar_archive``: options ``path``, ``suffixes`` (of the archives in a folder) and ``contentLimit``."""

    @classmethod
    def name(cls) -> str:
        return "tar_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(schema, self.options, overwrite)


def read_archives(spark: SparkSession, path: str, columns: tuple[str, ...] = ("archive", "path", "size", "sha256", "error"), **options) -> DataFrame:
    """A row for each file in the tar archives, gzip-compressed or not, at ``path``; the ``columns`` of ``SCHEMA`` alone are worked out.

    A file whose archive ends or breaks within it has an ``error`` and no
    digest; an archive that breaks between files has a row without a path.
    Repeated names are rows of their own, and contents of more than
    ``contentLimit`` bytes are null. An empty folder gives no row.
    """
    spark.dataSource.register(ArchiveSource)
    kinds = dict(x.rsplit(" ", 1) for x in SCHEMA.split(", "))
    reader = spark.read.format("tar_archive").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def with_manifests(files: DataFrame, **fields: str) -> DataFrame:
    """``files`` (archive, path, content) and for each archive a manifest row: its files' digests by path, and ``fields``, as JSON.

    The list of one archive's files is one row, as the archive is one file.
    Null contents are empty files.
    """
    files = files.withColumn("content", F.coalesce("content", F.lit(b"")))
    hashed = files.select("archive", F.struct("path", F.sha2("content", 256).alias("sha256")).alias("f"))
    lists = hashed.groupBy("archive").agg(F.map_from_entries(F.array_sort(F.array_distinct(F.collect_list("f")))).alias("output_hashes"))
    body = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in sorted(fields.items())), "output_hashes"))
    return files.select("archive", "path", "content").union(lists.select("archive", F.lit(MANIFEST), body.cast("binary")))


def write_archives(files: DataFrame, path: str, mode: str = "append") -> None:
    """Write (archive, path, content) as one gzip-compressed tar archive for each ``archive``, a name below ``path``.

    Members come in byte order of their paths, the manifest before all others;
    headers are fixed, so the same rows make the same bytes. ``append`` refuses
    names that are there, ``overwrite`` replaces them. Null contents are empty files.
    """
    files.sparkSession.dataSource.register(ArchiveSource)
    ordered = files.select("archive", "path", "content").repartition("archive").sortWithinPartitions("archive", F.col("path") != MANIFEST, "path", "content")
    ordered.write.format("tar_archive").option("path", path).mode(mode).save()


def manifests(spark: SparkSession, path: str, **options) -> DataFrame:
    """(archive, path, sha256): what the manifests of the archives at ``path`` say of their files."""
    held = read_archives(spark, path, ("archive", "path", "content"), **options).where(F.col("path") == MANIFEST)
    said = F.from_json(F.col("content").cast("string"), "output_hashes map<string,string>")["output_hashes"]
    return held.select("archive", F.explode(said).alias("path", "sha256"))


def verified(spark: SparkSession, path: str, **options) -> DataFrame:
    """(archive, path, status, valid) of every file that an archive holds or its manifest names: ok, mismatch, missing, extra, or broken."""
    said = manifests(spark, path, **options).withColumnRenamed("sha256", "said")
    held = read_archives(spark, path, ("archive", "path", "sha256", "error"), **options).where(F.coalesce(F.col("path") != MANIFEST, F.lit(True)))
    status = (
        F.when(F.col("error").isNotNull(), "broken").when(F.col("said").isNull(), "extra").when(F.col("sha256").isNull(), "missing")
        .when(F.col("said") == F.col("sha256"), "ok").otherwise("mismatch")
    )
    return held.join(said, ["archive", "path"], "full_outer").select("archive", "path", status.alias("status")).withColumn("valid", F.col("status").isin("ok", "extra"))

