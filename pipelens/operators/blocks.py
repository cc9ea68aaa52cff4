"""Where two large files first differ, from trees of block digests.

A file is blocks of one size; a node of the next level is the digest of up to
``FANOUT`` digests below it. Two trees are compared from the top: per file one
join a level looks at the children of a single node, so stored trees of two
builds are compared without their blocks, and of the files themselves only the
first block that differs is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pipelens.plans.lineage import cut, large
from pipelens.sources.archives import _opened

#: Bytes of a block, children of a node, levels above the blocks (256**4 blocks, 4 PB), and bytes that a task digests.
BLOCK, FANOUT, LEVELS, TASK_BYTES = 1 << 20, 256, 4, 64 << 20
#: Bytes of a row of a digest tree, about.
NODE_BYTES = 128


# ---------------------------------------------------------------- reading


@dataclass
class Blocks(InputPartition):
    name: str
    first: int
    last: int


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.block = options["path"], int(options.get("blocksize", BLOCK))

    def partitions(self) -> list[Blocks]:
        """Ranges of blocks, so that one large file is read by many tasks; an empty file has one empty block."""
        fs, root = _opened(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File]
        step = max(1, TASK_BYTES // self.block)
        return [Blocks(x.path, a, min(a + step, n)) for x in found for n in [max(1, -(-x.size // self.block))] for a in range(0, n, step)] or [Blocks("", 0, 0)]

    def read(self, partition: Blocks) -> Iterator[tuple]:
        if partition.first == partition.last:
            return
        fs, root = _opened(self.path)
        name = partition.name[len(root) :].lstrip("/") or partition.name.rsplit("/", 1)[-1]
        with fs.open_input_file(partition.name) as f:
            for n in range(partition.first, partition.last):
                data = f.read_at(self.block, n * self.block)
                yield name, n, len(data), sha256(data).hexdigest()


class BlockSource(DataSource):
    """``file_blocks``: options ``path`` and ``blockSize``."""

    @classmethod
    def name(cls) -> str:
        return "file_blocks"

    def schema(self) -> str:
        return "path string, block long, size long, sha256 string"

    def reader(self, schema: StructType) -> BlockReader:
        return BlockReader(self.options)


def file_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(path, block, size, sha256) of the blocks of a file, or of all files below a folder; paths are relative to it."""
    spark.dataSource.register(BlockSource)
    return spark.read.format("file_blocks").option("path", path).option("blockSize", block).load()


def value_blocks(files: DataFrame, block: int = BLOCK, path: str = "path", content: str = "content") -> DataFrame:
    """(path, block, size, sha256) of binary values, as ``file_blocks`` gives them of files; a null is empty."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length("data") / block) - 1, F.lit(0)).cast("int"))
    rows = files.select(F.col(path).alias("path"), F.coalesce(F.col(content).cast("binary"), F.lit(b"")).alias("data"))
    pieces = rows.select("path", F.posexplode(F.transform(parts, lambda n: F.substring("data", n * block + 1, F.lit(block)))).alias("block", "piece"))
    return pieces.select("path", F.col("block").cast("long").alias("block"), F.octet_length("piece").cast("long").alias("size"), F.sha2("piece", 256).alias("sha256"))


def block_at(wanted: DataFrame, root: str, block: int = BLOCK) -> DataFrame:
    """``wanted`` (path, block) with ``content``: that block of that file below ``root``, and no other byte; null if the file or the block is not there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _opened(root)
        for batch in batches:
            for path, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                info = fs.get_file_info(f"{top}/{path}")
                data = None
                if info.type == pafs.FileType.File and info.size > n * block:
                    with fs.open_input_file(info.path) as f:
                        data = f.read_at(block, n * block)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["path", "block", "content"])

    return wanted.select("path", "block").mapInArrow(read, "path string, block long, content binary")


# ---------------------------------------------------------------- trees


def _parts(spark: SparkSession, size: int) -> int:
    """Parts for ``size`` bytes to be exchanged, so that what a task reads does not grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def digest_tree(blocks: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(path, level, node, digest) of the blocks (level 0) and ``levels`` levels above them; the top has one node for each path.

    A node's digest covers its children's in order and their sizes; at most
    ``fanout`` meet in a group. Files of more than ``fanout ** levels`` blocks
    have several nodes at the top, which are all compared. Blocks are read
    once; the tree is a checkpoint, to be stored as a table where it is kept.
    """
    now = cut(blocks.select("path", F.lit(0).alias("level"), F.col("block").alias("node"), F.concat_ws(":", "size", "sha256").alias("digest")))
    out = now
    parts = _parts(blocks.sparkSession, now.count() * NODE_BYTES)
    for level in range(1, levels + 1):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: c["digest"]), ",")
        now = now.withColumn("up", F.floor(F.col("node") / fanout)).repartition(max(1, parts // fanout ** (level - 1)), "path", "up").groupBy("path", "up").agg(F.sha2(children.cast("binary"), 256).alias("digest"))
        now = cut(now.select("path", F.lit(level).alias("level"), F.col("up").alias("node"), "digest"))
        out = out.union(now)
    return out


def first_blocks(a: DataFrame, b: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(path, block) of two digest trees: the first block in which they differ, null if they are equal; paths of one tree alone have block 0."""

    def differing(level: int, of: DataFrame | None) -> DataFrame:
        sides = [t.where(F.col("level") == level).select("path", "node", F.col("digest").alias(c)) for t, c in ((a, "x"), (b, "y"))]
        if of is not None:  # only the children of the node that differs
            up = of.select("path", F.col("node").alias("up"))
            sides = [s.join(up, "path").where(F.floor(F.col("node") / fanout) == F.col("up")).drop("up") for s in sides]
        other = ~F.col("x").eqNullSafe(F.col("y"))
        return sides[0].join(sides[1], ["path", "node"], "full_outer").where(other).groupBy("path").agg(F.min("node").alias("node"))

    found = None
    for level in range(levels, -1, -1):
        found = cut(differing(level, found))
    every = a.where(F.col("level") == levels).select("path").union(b.where(F.col("level") == levels).select("path")).distinct()
    return every.join(found, "path", "left").select("path", F.col("node").alias("block"))


def byte_offset(block: Column, x: Column, y: Column, size: int = BLOCK) -> Column:
    """The first byte that differs, from the first block that does and what both sides have there; -1 without such a block."""
    from pipelens.functions.hashing import first_byte_difference  # makes a function that only a driver can make

    none = F.lit(b"")
    return F.when(block.isNull(), F.lit(-1).cast("long")).otherwise(block * size + first_byte_difference(F.coalesce(x, none), F.coalesce(y, none)))


def file_differences(spark: SparkSession, one: str, other: str, block: int = BLOCK, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(path, offset) of the files below two folders: the first byte that differs, the shorter length if one begins the other, -1 if equal.

    A file that is in one folder only differs at 0, or is equal to nothing at
    all if it is empty: -1 is given for that too. ``trees`` are the stored
    digest trees of both; they are made from the files otherwise.
    """
    a, b = trees or tuple(digest_tree(file_blocks(spark, p, block)) for p in (one, other))
    first = first_blocks(a, b)
    wanted = first.where("block IS NOT NULL")
    x, y = (block_at(wanted, p, block).select("path", F.col("content").alias(c)) for p, c in ((one, "x"), (other, "y")))
    both = first.join(x, "path", "left").join(y, "path", "left")
    return both.select("path", byte_offset(F.col("block"), F.col("x"), F.col("y"), block).alias("offset"))


def value_differences(one: DataFrame, other: DataFrame, block: int = BLOCK, fanout: int = FANOUT) -> DataFrame:
    """(path, offset) of two tables (path, content), as ``file_differences`` says; only the blocks that differ are compared byte by byte."""
    a, b = (digest_tree(value_blocks(t, block), fanout) for t in (one, other))
    piece = lambda t, c: t.select("path", F.col("content").cast("binary").alias(c))
    first = first_blocks(a, b, fanout)
    parts = _parts(one.sparkSession, a.union(b).where("level = 0").count() * block)
    both = first.repartition(parts, "path")
    for side in (piece(one, "x"), piece(other, "y")):
        both = both.join(large(side.repartition(parts, "path")), "path", "left")
    part = lambda c: F.substring(F.col(c), (F.col("block") * block + 1).cast("int"), F.lit(block))
    return both.select("path", byte_offset(F.col("block"), part("x"), part("y"), block).alias("offset"))

