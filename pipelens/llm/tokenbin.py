"""Token-ID output in patched frame-of-reference blocks.

A file is a sequence of blocks of ``BLOCK`` ids (the last may be shorter, the
rest is padding), then a footer. Of a block the minimum is subtracted and the
residuals are packed at the width that ``SHARE`` of them fit in; what does not
fit is an exception, stored with its place behind the block. The footer holds
the start of every block, the documents and their lengths, so a reader can
start at any block.

    block   u32 minimum, u8 width, u16 exceptions, packed words (u64, little
            endian, 4 lanes interleaved), then u8 place and u32 high bits each
    footer  u64 block starts; i64 document ids; u8 null marks; i64 lengths
    trailer u64 blocks, u64 documents, u64 ids, 8 bytes magic

Documents are range-partitioned and sorted by id, or stay in the order that
their table has; every task writes files of its own and reports them, and first
ids follow from the reported lengths.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipelens.llm.common import kept, shared_path, slices, texts_of, vocabulary

MAGIC = b"PFORIDS1"
BLOCK = 256
#: Share of a block's residuals that its width must hold.
SHARE = 0.95
END_ID = 1
#: Ids of a file after which the next document begins another.
FILE_IDS = 32 << 20
#: Ids that the encoder works on at a time.
BATCH_IDS = 1 << 18
#: Bytes of text whose different words are looked up together, about.
SLICE = 8 << 20
#: Words whose ids a worker keeps; beyond that the last third goes, as frequent words come early.
KEPT_WORDS = 1_000_000
#: What parts words that are encoded together: a character of a token of its own, which words seldom have.
PART = "\x01"
#: Ends of the last tokens of pieces, and punctuation that makes one piece behind letters.
WORD_END = "</w>"
STOPS = ".,;:!?"


# ---------------------------------------------------------------- blocks


def _widths(residuals: np.ndarray) -> np.ndarray:
    """Bits that ``SHARE`` of each row fit in."""
    at = int(np.ceil(SHARE * residuals.shape[1])) - 1
    edge = np.partition(residuals, at, axis=1)[:, at]
    return np.where(edge > 0, np.floor(np.log2(np.maximum(edge, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``BLOCK`` values below 2**width as rows of little-endian words: value 4 i + l is the i-th of lane l."""
    n = len(values)
    lanes = values.reshape(n, BLOCK // 4, 4).astype(np.uint64)
    out = np.zeros((n, width, 4), dtype=np.uint64)
    for i in range(BLOCK // 4):
        word, shift = divmod(i * width, 64)
        out[:, word] |= lanes[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return out.reshape(n, -1)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    words = words.reshape(n, width, 4)
    out = np.zeros((n, BLOCK // 4, 4), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK // 4):
        word, shift = divmod(i * width, 64)
        out[:, i] = words[:, word] >> np.uint64(shift)
        if shift + width > 64:
            out[:, i] |= words[:, word + 1] << np.uint64(64 - shift)
        out[:, i] &= mask
    return out.reshape(n, BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ids (unsigned 32 bits); the last is padded with its own last id."""
    if not len(ids):
        return []
    short = -len(ids) % BLOCK
    rows = np.concatenate((ids, np.full(short, ids[-1], dtype=ids.dtype))).astype(np.int64).reshape(-1, BLOCK)
    least = rows.min(axis=1)
    residuals = rows - least[:, None]
    widths = _widths(residuals)
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        res = residuals[at]
        packed = _packed(res & ((1 << width) - 1), width) if width else np.zeros((len(at), 0), dtype=np.uint64)
        high = res >> width
        for j, b in enumerate(at.tolist()):
            places = np.flatnonzero(high[j])
            out[b] = struct.pack("<IBH", int(least[b]), width, len(places)) + packed[j].astype("<u8").tobytes() + places.astype(np.uint8).tobytes() + high[j, places].astype("<u4").tobytes()
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` of ``data``, padding included."""
    raw = np.frombuffer(data, dtype=np.uint8)
    heads = raw[starts[:, None] + np.arange(7)]
    least = np.ascontiguousarray(heads[:, :4]).view("<u4").ravel().astype(np.int64)
    widths, n_out = heads[:, 4].astype(np.int64), np.ascontiguousarray(heads[:, 5:7]).view("<u2").ravel().astype(np.int64)
    out = np.zeros((len(starts), BLOCK), dtype=np.int64)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        if width:
            words = np.ascontiguousarray(raw[(starts[at] + 7)[:, None] + np.arange(width * 32)]).view("<u8")
            out[at] = _unpacked(words, width)
    for b in np.flatnonzero(n_out).tolist():
        a, n, width = int(starts[b]) + 7 + int(widths[b]) * 32, int(n_out[b]), int(widths[b])
        places = raw[a : a + n]
        out[b, places] |= raw[a + n : a + 5 * n].view(np.uint8).copy().view("<u4").astype(np.int64) << width
    return (out + least[:, None]).ravel().astype(np.uint32)


# ---------------------------------------------------------------- files


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a folder's address names; no scheme is the local one, for tests and shared mounts."""
    local = re.sub(r"^file:/*(?=/)", "", path)
    return pafs.FileSystem.from_uri(path) if ":/" in local else (pafs.LocalFileSystem(), local)


class Writer:
    """One file. A temporary name becomes the final one when the file is whole, so a second attempt replaces it."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _store(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.temp, self.name = f"{root}/{name}", f"{root}/_{name}-{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}", name
        self.out = self.fs.open_output_stream(self.temp)
        self.rest, self.waiting, self.at, self.starts = [], 0, 0, []
        self.ids, self.lengths = [], []
        self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= BATCH_IDS:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, dtype=np.uint32)
        n = len(ids) if last else len(ids) // BLOCK * BLOCK
        blocks = encode_blocks(ids[:n])
        sizes = np.fromiter(map(len, blocks), dtype=np.int64, count=len(blocks))
        self.starts.append(self.at + np.cumsum(sizes) - sizes)
        self.out.write(b"".join(blocks))
        self.at += int(sizes.sum())
        self.rest, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> tuple[str, int, int]:
        self._write(True)
        starts = np.concatenate(self.starts)
        nulls = np.array([x is None for x in self.ids], dtype=np.uint8)
        ids = np.array([x or 0 for x in self.ids], dtype="<i8")
        self.out.write(starts.astype("<u8").tobytes() + ids.tobytes() + nulls.tobytes() + np.array(self.lengths, dtype="<i8").tobytes())
        self.out.write(struct.pack("<QQQ", len(starts), len(ids), self.total) + MAGIC)
        self.out.close()
        self.fs.move(self.temp, self.path)
        return self.name, len(self.ids), self.total


def read_file(folder: str, name: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file: id and token ids, in order; blocks are read in pieces."""
    fs, root = _store(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        size = f.size()
        f.seek(size - 32)
        tail = f.read(32)
        if tail[24:] != MAGIC:
            raise ValueError(f"{name} is not a whole file of this format")
        n_blocks, n_docs, total = struct.unpack("<QQQ", tail[:24])
        foot = size - 32 - 8 * n_blocks - 17 * n_docs
        f.seek(foot)
        data = f.read(size - 32 - foot)
        starts = np.frombuffer(data, dtype="<u8", count=n_blocks).astype(np.int64)
        ids = np.frombuffer(data, dtype="<i8", count=n_docs, offset=8 * n_blocks)
        nulls = np.frombuffer(data, dtype=np.uint8, count=n_docs, offset=8 * n_blocks + 8 * n_docs)
        lengths = np.frombuffer(data, dtype="<i8", count=n_docs, offset=8 * n_blocks + 9 * n_docs)
        ends = np.concatenate((starts, [foot]))
        step, block = BATCH_IDS // BLOCK, 0
        held, have, left = [], 0, total
        for doc_id, null, length in zip(ids.tolist(), nulls.tolist(), lengths.tolist()):
            while have < length:
                to = min(block + step, n_blocks)
                f.seek(int(starts[block]))
                got = decode_blocks(f.read(int(ends[to] - starts[block])), starts[block:to] - starts[block])[: left]
                held.append(got)
                have, left, block = have + len(got), left - len(got), to
            flat = held[0] if len(held) == 1 else np.concatenate(held) if held else np.zeros(0, dtype=np.uint32)
            yield (None if null else doc_id), flat[:length]
            held, have = [flat[length:]], have - length


# ---------------------------------------------------------------- tokenizing


def _plain(word: str) -> bool:
    """Whether a word is letters, of scripts whose letters every Unicode version agrees on, and still is when lower-cased (a dotted capital I is not)."""
    return word.isalpha() and max(word) < "\u0500" and word.lower().isalpha()


class WordCache:
    """Token ids of texts by the tokenizers library, each different run between ASCII spaces encoded once.

    Exact for tokenizers whose pieces never hold white space and whose
    normalizer works within such runs, as that of the word-level vocabulary.
    Ids are put together from parts only where the parts are plain letters and
    stops (``_plain``); the tests compare with whole texts of any characters,
    in any order of learning.
    """

    def __init__(self, path: str, most: int | None = None):
        from tokenizers import Tokenizer

        self.most = most or KEPT_WORDS

        self.tokenizer = Tokenizer.from_file(path)
        alone = self._ids(PART)
        self.part = int(alone[0]) if len(alone) == 1 else None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        # A-Z can be lower-cased first where the tokenizer does it anyway, outside of special tokens
        self.lowers = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"]) and not any(c in t.content for t in self.tokenizer.get_added_tokens_decoder().values() for c in ascii_uppercase)
        self.of: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, dtype=np.uint32), 0
        self.start, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _learn(self, new: list[bytes]) -> None:
        """Encode new words, many at a time.

        Plain letters alone are one piece of the tokenizer, before punctuation
        two, and every piece has one token that ends it; so where
        a joined text has as many ends as that makes, the ends part its words.
        Other words have ``PART`` between. What does not part is encoded word
        by word.
        """
        words = [w.decode() for w in new]
        kinds = [1 if _plain(w) else 2 if _plain(w.rstrip(STOPS)) else 0 for w in words]
        for kind in (1, 2, 0):
            of_kind = [i for i, k in enumerate(kinds) if k == kind]
            if kind == 2:
                of_kind = self._stopped(new, of_kind)
            for a in range(0, len(of_kind), 1000):
                at = of_kind[a : a + 1000]
                part = [words[i] for i in at]
                ids, size = self._parted(part, kind)
                if size is None:
                    each = [self._ids(w) for w in part]
                    ids, size = np.concatenate(each), np.array([len(x) for x in each])
                self._keep([new[i] for i in at], ids, size)

    def _stopped(self, new: list[bytes], at: list[int]) -> list[int]:
        """Of words with punctuation behind, keep those whose letters are known: their ids and those of the punctuation. The rest."""
        by_stop: dict[bytes, tuple[list[bytes], list[int]]] = {}
        rest, stops = [], STOPS.encode()
        for i in at:
            letters = new[i].rstrip(stops)
            known = self.of.get(letters)
            if known is None:
                rest.append(i)
            else:
                words, stems = by_stop.setdefault(new[i][len(letters) :], ([], []))
                words.append(new[i])
                stems.append(known)
        for stop, (words, stems) in by_stop.items():
            tail = self._ids(stop.decode())
            size = self.size[stems] + len(tail)
            ends = np.cumsum(size)
            ids = np.empty(int(ends[-1]), dtype=np.uint32)
            own = np.ones(len(ids), dtype=bool)
            places = ends[:, None] - len(tail) + np.arange(len(tail))
            own[places.ravel()] = False
            ids[places] = tail
            ids[own] = self._gather(np.array(stems))
            self._keep(words, ids, size)
        return rest

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of kept words, one word after the other."""
        size, start = self.size[at], self.start[at]
        before = np.cumsum(size) - size
        return self.flat[np.arange(int(size.sum())) + np.repeat(start - before, size)]

    def _parted(self, words: list[str], pieces: int) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Ids of words encoded as one text and how many each has; None if the words can't be told apart."""
        if pieces:
            ids = self._ids(" ".join(words))
            ends = np.flatnonzero(self.is_end[ids])
            if len(ends) != pieces * len(words):
                return None, None
            return ids, np.diff(np.concatenate(([-1], ends[pieces - 1 :: pieces])))
        if self.part is None or any(PART in w for w in words):
            return None, None
        ids = self._ids(f" {PART} ".join(words) + f" {PART}")
        ends = np.flatnonzero(ids == self.part)
        return (ids[ids != self.part], np.diff(np.concatenate(([-1], ends))) - 1) if len(ends) == len(words) else (None, None)

    def _keep(self, words: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        k = len(self.of)
        while k + len(words) > len(self.start):
            self.start, self.size = (np.concatenate((x, np.zeros(len(x), dtype=np.int64))) for x in (self.start, self.size))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(len(self.flat), dtype=np.uint32)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + len(words)] = self.used + np.cumsum(size) - size
        self.size[k : k + len(words)] = size
        self.used += len(ids)
        self.of.update(zip(words, range(k, k + len(words))))

    def encode(self, texts: list[bytes], end: int | None) -> list[np.ndarray]:
        if len(self.of) > self.most:
            stay = self.most * 2 // 3
            while len(self.of) > stay:
                self.of.popitem()  # the latest
            self.used = int(self.start[stay])
        # the cache is asked for different words only
        joined = [b" ".join((t.lower() if self.lowers and b"<" not in t else t).split()) for t in texts]
        words, code, of = vocabulary(joined, ascending=False)
        place = np.fromiter(map(self.of.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        lacking = np.flatnonzero(place < 0).tolist()
        if lacking:
            new = list(map(words.__getitem__, lacking))
            self._learn(new)
            place[lacking] = np.fromiter(map(self.of.__getitem__, new), dtype=np.int64, count=len(new))
        at = place[code]
        size, ids = self.size[at], self._gather(at)
        n_words = np.bincount(of, minlength=len(texts))
        cuts = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(n_words)))]
        tail = np.array([] if end is None else [end], dtype=np.uint32)
        return [np.concatenate((ids[a:b], tail)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _writer(tokenizer: str, folder: str, end: int | None, keep_words: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, now, first, follows = TaskContext.get().partitionId(), 0, None, None, None
        cache, done = kept(f"words {tokenizer} {keep_words}", lambda: WordCache(tokenizer, keep_words)), []
        for batch in slices(batches, SLICE):
            places = zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))) if batch.num_columns > 2 else repeat(None)
            for doc_id, place, ids in zip(batch.column(0).to_pylist(), places, cache.encode(texts_of(batch), end)):
                if now is not None and (now.total >= FILE_IDS or place != follows):
                    done.append((task, made, *first, *now.close()))
                    made, now = made + 1, None
                if now is None:
                    now, first = Writer(folder, f"part-{task:06d}-{made:04d}.pfor"), place or (task, "", made)
                now.add(doc_id, ids)
                follows = place and (*place[:2], place[2] + 1)
        if now is not None:
            done.append((task, made, *first, *now.close()))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(list(zip(*done)) or [()] * 8, kinds)], ["task", "made", "part", "file", "row", "name", "docs", "ids"])

    return write


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int | None = END_ID, id_col: str = "doc_id", text: str = "text", keep_words: int = KEPT_WORDS, as_it_is: bool = False) -> tuple[str, list]:
    """Encode and write all documents in ascending id order; the folder, and (name, docs, ids, start) of each file in order.

    Null ids come first; documents of one id follow the hash of their text,
    so reruns agree. A null text is the empty one. An empty table writes no file.
    ``keep_words`` bounds the words whose ids a worker keeps, which changes
    its memory and time but no id.

    With ``as_it_is`` documents keep the order of their table and are moved
    nowhere: of a table read from files that is by file (the number behind
    ``part-``, then the name) and row, of any other by partition and row.
    """
    folder = folder or shared_path(docs.sparkSession, "token-ids")
    picked = [F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")]
    if as_it_is:
        place = [F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-([0-9]+)", 1).try_cast("long"), F.lit(-1)).alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
        parts = docs.select(*picked, *(place if _is_files(docs) else []))
    else:
        order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
        parts = docs.select(*picked, F.xxhash64(text).alias("tie")).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    written = parts.mapInArrow(_writer(tokenizer, folder, end, keep_words), "task int, made int, part long, file string, row long, name string, docs long, ids long").collect()
    start, out = 0, []
    for f in sorted(written, key=lambda f: (f.part, f.file, f.row)):
        out.append((f.name, f.docs, f.ids, start))
        start += f.ids
    return folder, out


def _is_files(docs: DataFrame) -> bool:
    """Whether a table is read from Parquet files as it is; rows of anything made from one have other places."""
    plan = docs._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().lower()


def read(spark: SparkSession, folder: str, files: list) -> DataFrame:
    """The documents of written files: doc_id, start, n_tokens, ids_crc32 and the file; each task reads files of its own."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for doc_id, ids in read_file(folder, name):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    listed = spark.createDataFrame([(f[0], f[3]) for f in files], "name string, start long").repartition(max(1, len(files)))
    return listed.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, **kwargs) -> DataFrame:
    """Write ``docs`` and read the files back: a row per document, as ``read`` gives it."""
    folder, files = write(docs, tokenizer, folder, **kwargs)
    return read(docs.sparkSession, folder, files)
