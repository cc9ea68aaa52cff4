"""A watched folder over polls, restarts and batches that run again."""

import os
import shutil

import pytest

from pipelens.streaming import folders


@pytest.fixture
def place(tmp_path):
    for d in ("ws/src/deep", "ws/.git", "ws/docs/node_modules"):
        (tmp_path / d).mkdir(parents=True)
    put(tmp_path, "src/a.go", "a", 100)
    put(tmp_path, "src/deep/b.go", "b", 100)
    put(tmp_path, "top.txt", "t", 100)
    put(tmp_path, ".git/HEAD", "x", 100)
    put(tmp_path, "docs/node_modules/x.js", "x", 100)
    return tmp_path


def put(root, name, text, at):
    p = root / "ws" / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    os.utime(p, (at, at))


def test_changes_over_restarts(spark, place):
    """Each start of the query is a new reader, as after a restart; every change is in one batch."""
    seen = []

    def poll():
        got = []
        stream = folders.folder_changes(spark, str(place / "ws"), f"file://{place}/state")
        q = stream.writeStream.foreachBatch(lambda df, n: got.extend((n, r.path, r.size, r.change, r.mtime.timestamp()) for r in df.collect())).option("checkpointLocation", str(place / "ck")).trigger(once=True).start()
        q.awaitTermination(120)
        seen.append(sorted(x[1:4] for x in got))
        return got

    first = poll()
    assert seen[0] == [("src/a.go", 1, "new"), ("src/deep/b.go", 1, "new"), ("top.txt", 1, "new")] and {x[4] for x in first} == {100}
    poll()
    assert seen[1] == []
    put(place, "src/a.go", "longer", 100)  # another size
    put(place, "top.txt", "u", 200)  # a later time
    put(place, "src/deep/b.go", "c", 50)  # an earlier time is no change
    put(place, "new/z.go", "zz", 100)
    poll()
    assert seen[2] == [("new/z.go", 2, "new"), ("src/a.go", 6, "changed"), ("top.txt", 1, "changed")]
    shutil.rmtree(place / "ws/src")
    os.remove(place / "ws/top.txt")
    poll()
    assert seen[3] == [("src/a.go", 6, "deleted"), ("src/deep/b.go", 1, "deleted"), ("top.txt", 1, "deleted")]
    shutil.rmtree(place / "ws")
    poll()
    assert seen[4] == [("new/z.go", 2, "deleted")]
    assert len([x for x in os.listdir(place / "state") if x.isdigit()]) <= 2


def test_a_batch_that_failed_runs_again_with_the_same_rows(spark, place):
    """The sink fails after the listing; files change before the restart, and the batch still gives what it had seen."""
    got = []

    def start(sink):
        stream = folders.folder_changes(spark, str(place / "ws"), str(place / "state"))
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(place / "ck")).trigger(once=True).start()

    def broken(df, n):
        got.append((n, sorted((r.path, r.change) for r in df.collect())))
        raise RuntimeError("sink is gone")

    q = start(broken)
    with pytest.raises(Exception, match="sink is gone"):
        q.awaitTermination(120)
    os.remove(place / "ws/src/a.go")
    put(place, "src/late.go", "l", 300)
    keep = lambda df, n: got.append((n, sorted((r.path, r.change) for r in df.collect())))
    start(keep).awaitTermination(120)
    start(keep).awaitTermination(120)
    assert got[0] == got[1]
    assert got[2][1] == [("src/a.go", "deleted"), ("src/late.go", "new")] and got[2][0] == got[1][0] + 1


def test_a_reader_replays_and_orders_its_moments(place):
    reader = folders.FolderReader({"path": str(place / "ws"), "state": str(place / "state")})
    a, b = reader.latestOffset(), reader.latestOffset()
    assert reader.initialOffset()["at"] < a["at"] < b["at"]
    rows = lambda r, x, y: sorted(row[::3] for p in r.partitions(x, y) for row in r.read(p))
    first = rows(reader, reader.initialOffset(), a)
    put(place, "src/a.go", "changed", 500)
    assert rows(reader, reader.initialOffset(), a) == first and len(first) == 3
    again = folders.FolderReader({"path": str(place / "ws"), "state": str(place / "state")})
    assert again.latestOffset()["at"] > a["at"]
    assert rows(again, a, b) == [("src/a.go", "changed")]
    again.commit(b)
    assert again._kept() == [b["at"]]
