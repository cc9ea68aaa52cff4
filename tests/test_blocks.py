"""First differences of files and values against comparing them whole."""

import os
import random

import pytest

from pipelens.operators import blocks


def plain(a, b):
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return -1 if a == b else n


def pairs():
    rng = random.Random(3)
    out = {"empty": (b"", b""), "one": (b"x", b""), "same": (b"ab" * 500, b"ab" * 500), "longer": (b"z" * 64, b"z" * 65), "edge": (b"z" * 128, b"z" * 64 + b"y" + b"z" * 63)}
    for n in range(25):
        a = bytes(rng.choices(b"ab", k=rng.randrange(3000)))
        b = bytearray(a[: rng.choice([len(a), len(a) // 2])] + bytes(rng.choices(b"ab", k=rng.choice([0, 0, 70]))))
        for _ in range(rng.choice([0, 1, 3])):
            if b:
                b[rng.randrange(len(b))] ^= 1
        out[f"d/{n}"] = (a, bytes(b))
    return out


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "TASK_BYTES", 2048)
    both = {n: s for n, s in pairs().items() if not n.startswith("d/") or len(n) == 3}
    for name, sides in both.items():
        for side, data in zip("ab", sides):
            p = tmp_path / side / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(data)
    (tmp_path / "a/only").write_bytes(b"here")
    got = {r.path: r.offset for r in blocks.file_differences(spark, str(tmp_path / "a"), f"file://{tmp_path}/b", 64).collect()}
    assert got == {n: plain(*s) for n, s in both.items()} | {"only": 0}


def test_values_over_several_levels(spark):
    both = pairs()
    tables = [spark.createDataFrame([(n, s[i]) for n, s in both.items()], "path string, content binary") for i in (0, 1)]
    got = {r.path: r.offset for r in blocks.value_differences(*tables, block=8, fanout=3).collect()}
    assert got == {n: plain(*s) for n, s in both.items()}


def test_only_the_first_block_that_differs_is_read(spark, tmp_path):
    """Files above two gigabytes, sparse on the disk: with stored trees one block of each is read."""
    size = (2 << 30) + 12_345
    for side, at in (("a", None), ("b", size - 5000)):
        (tmp_path / side).mkdir()
        with open(tmp_path / side / "large", "wb") as f:
            f.truncate(size)
            if at:
                f.seek(at)
                f.write(b"x")
    trees = tuple(blocks.digest_tree(blocks.file_blocks(spark, str(tmp_path / s), 16 << 20)) for s in "ab")
    assert trees[0].count() == 129 + 1 + 1 + 1 + 1
    first = blocks.first_blocks(*trees).collect()
    assert [tuple(r) for r in first] == [("large", (size - 5000) // (16 << 20))]
    for side in "ab":  # nothing before the block is needed any more
        with open(tmp_path / side / "large", "r+b") as f:
            f.write(os.urandom(100))
    got = blocks.file_differences(spark, str(tmp_path / "a"), str(tmp_path / "b"), 16 << 20, trees).collect()
    assert [tuple(r) for r in got] == [("large", size - 5000)]
    with pytest.raises(Exception, match="FileNotFoundError"):
        blocks.file_blocks(spark, str(tmp_path / "none")).collect()
