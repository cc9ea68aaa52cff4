"""The archive source and sink against ``tarfile``."""

import gzip
import hashlib
import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from pipelens.sources import archives


def packed(path, files, mode="w:gz"):
    with tarfile.open(path, mode) as tar:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size, info.mtime, info.mode = len(data), 1000, 0o600
            tar.addfile(info, io.BytesIO(data))
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)


FILES = [("a.txt", b"hello"), ("d/" + "long" * 60 + "/é.bin", os.urandom(300_000)), ("empty", b""), ("a.txt", b"again"), ("z", b"\0" * 70_000)]


def test_reader_gives_what_tarfile_gives(spark, tmp_path, monkeypatch):
    (tmp_path / "in/sub").mkdir(parents=True)
    packed(tmp_path / "in/one.tar.gz", FILES)
    packed(tmp_path / "in/sub/two.tar", FILES[:3], "w")
    packed(tmp_path / "in/none.tgz", [])
    (tmp_path / "in/_writing").write_text("no archive")
    everything = tuple(x.split(" ")[0] for x in archives.SCHEMA.split(", "))
    got = archives.read_archives(spark, str(tmp_path / "in"), everything).collect()
    want = [(a, n, len(d), 0o600, hashlib.sha256(d).hexdigest(), d, None) for a, fs in (("one.tar.gz", FILES), ("sub/two.tar", FILES[:3])) for n, d in fs]
    assert sorted((r.archive, r.path, r.size, r.mode, r.sha256, bytes(r.content), r.error) for r in got) == sorted(want)
    assert {r.mtime.timestamp() for r in got} == {1000}
    few = archives.read_archives(spark, f"file://{tmp_path}/in/one.tar.gz", ("path", "size"))
    assert few.columns == ["path", "size"] and sorted(map(tuple, few.collect())) == sorted((n, len(d)) for n, d in FILES)
    small = archives.read_archives(spark, str(tmp_path / "in"), ("size", "content"), contentLimit=5, suffixes=".gz").collect()
    assert all((r.content is None) == (r.size > 5) for r in small) and len(small) == 5
    with pytest.raises(Exception, match="FileNotFoundError"):
        archives.read_archives(spark, str(tmp_path / "nowhere")).collect()


def test_asked_columns_decide_the_work():
    rows = lambda *columns: archives.ArchiveReader(archives.StructType([archives.StructType.fromDDL(archives.SCHEMA)[c] for c in columns]), {"path": "x"})._contents(io.BytesIO(b"abc"), 3)
    assert rows("path") == {"sha256": None, "content": None}
    assert rows("sha256") == {"sha256": hashlib.sha256(b"abc").hexdigest(), "content": None}
    assert rows("content")["content"] == b"abc"


@pytest.mark.parametrize("zipped", [True, False])
def test_cut_archives_are_reported_wherever_they_end(spark, tmp_path, zipped):
    packed(tmp_path / "whole", FILES, "w:gz" if zipped else "w")
    data = (tmp_path / "whole").read_bytes()
    full = [(n, hashlib.sha256(d).hexdigest()) for n, d in FILES]
    (tmp_path / "cut").mkdir()
    with tarfile.open(tmp_path / "whole") as tar:
        last = tar.getmembers()[-1].offset + 512  # behind it a tar archive has its end mark, of a kilobyte at least
    for n, at in enumerate([0, 1, 600, 1024, len(data) // 2, *([len(data) - 12_000, len(data) - 1500, len(data) - 5] if zipped else [last - 512, last, last + 700])]):
        (tmp_path / f"cut/{n}").write_bytes(data[:at])
    flipped = bytearray(data)
    flipped[len(data) // 3] ^= 255
    if zipped:
        (tmp_path / "cut/flipped").write_bytes(bytes(flipped))
    got = archives.read_archives(spark, str(tmp_path / "cut")).collect()
    for name in os.listdir(tmp_path / "cut"):
        rows = [r for r in got if r.archive == name]
        assert sum(r.error is not None for r in rows) == 1, (name, rows)
        assert all((r.path, r.sha256) in full for r in rows if r.error is None) or name == "flipped"


def test_members_of_more_than_two_gigabytes(spark, tmp_path):
    """Zeros that compress to little: nothing of them is held."""
    size = (1 << 31) + 10

    class Zeros(io.RawIOBase):
        def read(self, n=-1):
            return bytes(n)

    with gzip.open(tmp_path / "large.tar.gz", "wb", compresslevel=1) as out, tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT) as tar:
        info = tarfile.TarInfo("large")
        info.size = size
        tar.addfile(info, Zeros())
        info = tarfile.TarInfo("after")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"end"))
    got = {r.path: (r.size, r.sha256) for r in archives.read_archives(spark, str(tmp_path / "large.tar.gz")).collect()}
    digest = hashlib.sha256()
    for _ in range(size // (1 << 20)):
        digest.update(bytes(1 << 20))
    digest.update(bytes(size % (1 << 20)))
    assert got == {"large": (size, digest.hexdigest()), "after": (3, hashlib.sha256(b"end").hexdigest())}


def frame(spark, seed=1):
    rows = [(f"p{i % 3}.tar.gz" if i % 3 else "deep/p0.tar.gz", f"f/{i * 7 % 40:02}", f"text {i}".encode() if i % 5 else None) for i in range(40)]
    return spark.createDataFrame(rows, "archive string, path string, content binary").repartition(seed)


def test_writer_makes_the_same_bytes_and_verifies(spark, tmp_path):
    for n in (1, 5):
        archives.write_archives(archives.with_manifests(frame(spark, n), version="1.0"), str(tmp_path / f"out{n}"))
    names = sorted(str(p.relative_to(tmp_path / "out1")) for p in (tmp_path / "out1").rglob("*") if p.is_file())
    assert names == ["deep/p0.tar.gz", "p1.tar.gz", "p2.tar.gz"]
    for x in names:
        assert (tmp_path / "out1" / x).read_bytes() == (tmp_path / "out5" / x).read_bytes()
        with tarfile.open(tmp_path / "out1" / x) as tar:
            members = tar.getnames()
            assert members[0] == archives.MANIFEST and members[1:] == sorted(members[1:]) and len(members) >= 14
    report = archives.verified(spark, str(tmp_path / "out1")).collect()
    assert len(report) == 40 and {r.status for r in report} == {"ok"}


def test_verification_finds_what_was_changed(spark, tmp_path):
    whole = archives.with_manifests(frame(spark))
    other = whole.where("path <> 'f/07'").withColumn("content", F.when(F.col("path") == "f/14", F.lit(b"other")).otherwise(F.col("content"))).union(spark.createDataFrame([("p1.tar.gz", "new", b"x")], whole.schema))
    archives.write_archives(other, str(tmp_path / "out"))
    status = {r.path: (r.status, r.valid) for r in archives.verified(spark, str(tmp_path / "out")).collect() if r.status != "ok"}
    assert status == {"f/07": ("missing", False), "f/14": ("mismatch", False), "new": ("extra", True)}


def test_failed_writes_leave_nothing(spark, tmp_path):
    out = tmp_path / "out"
    archives.write_archives(frame(spark), str(out))
    before = {p: p.read_bytes() for p in out.rglob("*") if p.is_file()}
    with pytest.raises(Exception, match="p1.tar.gz|p2.tar.gz|p0.tar.gz"):  # names that are there
        archives.write_archives(frame(spark).withColumn("content", F.lit(b"x")), str(out))
    bad = frame(spark).withColumn("archive", F.concat(F.lit("new-"), "archive")).union(spark.createDataFrame([("new-z", None, b"")], "archive string, path string, content binary"))
    with pytest.raises(Exception, match="without an archive or a path"):
        archives.write_archives(bad, str(out))
    assert {p: p.read_bytes() for p in out.rglob("*") if p.is_file()} == before and not list(out.glob("_writing*"))
    archives.write_archives(frame(spark).withColumn("content", F.lit(b"x")), str(out), "overwrite")
    assert {r.sha256 for r in archives.read_archives(spark, str(out)).collect()} == {hashlib.sha256(b"x").hexdigest()}
