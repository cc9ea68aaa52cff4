"""What the operators of this folder share: shared storage, fresh names, packed chunks."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text: a run of anything but the space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, as
    in tests, a folder below the warehouse takes its place; that may be a
    machine's own, so only a local session may leave the setting out.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it (case ignored)."""
    there = {x.lower() for x in taken}
    while name.lower() in there:
        name = "_" + name
    return name


def trim() -> None:
    """Give memory that a worker has freed back to the system, where the C library can; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


_KEPT: dict = {}


def kept(name: str, make):
    """What a worker process keeps between tasks under ``name``; one thing at a time, so that operators in turn do not add up."""
    if name not in _KEPT:
        _KEPT.clear()
        trim()
        _KEPT[name] = make()
    return _KEPT[name]


def forget() -> None:
    """Drop what an operator before this one has kept in the worker process."""
    if _KEPT:
        _KEPT.clear()
        trim()


def crc_mod(column: str, n: int):
    """crc32 of a column as text, modulo n; a null counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")), F.lit(n))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; a null is the empty text."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()]


def flat_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts in one list, A-Z lower-cased, and how many each text has."""
    each = [t.lower().split() for t in texts]
    return [w for words in each for w in words], np.fromiter(map(len, each), dtype=np.int64, count=len(each))


def vocabulary(joined: list[bytes], ascending: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words of texts whose words are one space apart, ascending or as they come; of every word which of these it is, and the text it is of."""
    there = np.flatnonzero(np.fromiter(map(len, joined), dtype=np.int64, count=len(joined)))
    flat = np.frombuffer(b" ".join(joined[i] for i in there.tolist()), dtype=np.uint8)
    if not len(flat):
        return [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    gaps = np.flatnonzero(flat == 32)
    edges = np.concatenate(([0], gaps - np.arange(len(gaps)), [len(flat) - len(gaps)]))
    words = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(flat[flat != 32])])
    coded = words.dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy()
    if ascending:
        in_order = pc.sort_indices(names).to_numpy().astype(np.int64)
        rank = np.empty(len(in_order), dtype=np.int64)
        rank[in_order] = np.arange(len(in_order))
        names, code = names.take(pa.array(in_order)), rank[code]
    n = np.fromiter((joined[i].count(b" ") + 1 for i in there.tolist()), dtype=np.int64, count=len(there))
    return names.to_pylist(), code, np.repeat(there, n)


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        part = np.cumsum(size) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(int(a), int(b - a))
    trim()
