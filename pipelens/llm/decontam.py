"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage with block-max bounds.

A document holds an item if it has ``OVERLAP`` of the word shingles of the whole
item or, as questions leak without their answers, of a question of ``QUESTION``
words or more, wherever they stand; an answer alone tells nothing. Retrieval
asks for no more than that: an item's need is the least BM25 sum that the terms
of a document can have that still holds so many shingles of the whole, or of
the question if that is less. What the missing shingles can take away is bounded by a
fractional knapsack: a term is gone only if all shingles with it are, and a
shingle of k words is in k terms at most. So no item that the confirmation
would accept is below its need, and every item at or above it is retrieved.

The passages of a document are its runs of words that are all terms of the
index, as long as a shingle or longer; other words can be part of no shingle.
The terms of all its passages are one query. Items, ordered by need, are in
blocks of ``BLOCK``; postings lead from an essential term to the blocks that
have it and the largest contribution it makes there. Terms of more than
``COMMON`` of the items are not essential: whatever a document has of them,
they add no more to an item than the item's own sum over them, which is taken
off the need of its block. Only blocks whose bound over the essential terms
reaches that (the pivots) are scored, item by item over all their terms.

The index is built by executors, with document frequencies of the whole
benchmark, and is broadcast. Beyond ``SHARD`` items or ``POSTINGS`` postings it
is cut into parts of that size, each of which costs one more scan.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm.common import cut, forget, slices, texts_of

K1, B = 1.2, 0.75
#: Words of a shingle, and the share of an item's shingles that a document must have.
SHINGLE, OVERLAP = 5, 0.8
#: Words of a question from which on it counts without its answer.
QUESTION = 10
BLOCK = 8
#: Items and postings of one part of the index, about.
SHARD, POSTINGS = 1 << 16, 1 << 22
#: Share of the items from which on a term is common.
COMMON = 0.025
#: What normalisation removes, besides the case of A-Z.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, without ASCII punctuation."""
    return text.lower().translate(None, PUNCTUATION).split()


def shingles_of(words: list[bytes], k: int = SHINGLE) -> set[bytes]:
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def impacts(words: list[bytes], df: dict[bytes, int], n: int, mean: float) -> dict[bytes, float]:
    """What each different word of an item adds to its BM25 score; ``df`` is of ``n`` items of ``mean`` words."""
    norm = K1 * (1 - B + B * len(words) / mean)
    return {w: float(np.log1p((n - df[w] + 0.5) / (df[w] + 0.5))) * c * (K1 + 1) / (c + norm) for w, c in Counter(words).items()}


def need_of(words: list[bytes], impact: dict[bytes, float]) -> float:
    """The least score of a document that has ``OVERLAP`` of the shingles of ``words``, an item or a part of it."""
    impact = {w: impact[w] for w in dict.fromkeys(words)}
    k = min(SHINGLE, len(words))
    wanted = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    n, missing = len(wanted), int((1 - OVERLAP) * len(wanted)) + 1
    while (n - missing) / n < OVERLAP:
        missing -= 1
    within = Counter(w for s in wanted for w in set(s))
    room, lost = float(k * missing), 0.0
    for w in sorted(impact, key=lambda w: -impact[w] / within[w]):
        share = min(1.0, room / within[w])
        lost += share * impact[w]
        room -= share * within[w]
        if room <= 0:
            break
    return max(0.0, (sum(impact.values()) - lost) * (1 - 1e-9) - 1e-9)


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``n`` of them each, in one array."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def least_need(q: list[bytes], a: list[bytes], impact: dict[bytes, float]) -> float:
    """What a document that holds an item scores at least: the weaker of the whole and a question that counts alone."""
    whole = need_of(q + a, impact)
    return min(whole, need_of(q, impact)) if len(q) >= QUESTION else whole


class Group:
    """Items whose shingles have ``k`` words: needs, blocks, postings. Terms are numbers, the essential ones first."""

    def __init__(self, k: int, rows: list[tuple], term: dict[bytes, int], n_essential: int):
        self.k = k
        found = []
        for item, q, a, impact in rows:
            common = sum(x for w, x in impact.items() if term[w] > n_essential)
            need = least_need(q, a, impact)
            found.append((need - common, need, item, q, a, impact))
        found.sort(key=lambda x: x[0])
        self.items = [x[2:5] for x in found]
        self.need = np.array([x[1] for x in found])
        size = np.array([len(x[5]) for x in found], dtype=np.int64)
        self.edges = np.concatenate(([0], np.cumsum(size)))
        self.terms = np.fromiter((term[w] for x in found for w in x[5]), dtype=np.int32, count=int(size.sum()))
        self.impact = np.fromiter((v for x in found for v in x[5].values()), dtype=np.float64, count=int(size.sum()))
        self.least = np.array([found[a][0] for a in range(0, len(found), BLOCK)])
        self.mine = np.zeros(len(term) + 1, dtype=bool)
        self.mine[self.terms] = True
        block = np.repeat(np.arange(len(found)) // BLOCK, size)
        some = self.terms <= n_essential
        key, at = np.unique(self.terms[some].astype(np.int64) * len(self.least) + block[some], return_inverse=True)
        self.best = np.zeros(len(key))
        np.maximum.at(self.best, at, self.impact[some])
        self.block = (key % len(self.least)).astype(np.int32)
        self.first = np.searchsorted(key // len(self.least), np.arange(len(term) + 2))

    def retrieved(self, ids: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(text, items at or above their need) from the term (0: none) and the text of each word; texts ascend."""
        good = self.mine[ids]
        if not good.any():
            return
        edge = np.flatnonzero(np.concatenate(([True], (good[1:] != good[:-1]) | (text[1:] != text[:-1]))))
        length = np.diff(np.concatenate((edge, [len(ids)])))
        passage = np.repeat(good[edge] & (length >= self.k), length)
        n_terms = len(self.mine)
        pair = np.unique(text[passage] * n_terms + ids[passage])
        of, term = pair // n_terms, pair % n_terms
        n = self.first[term + 1] - self.first[term]
        posting = _spans(self.first[term], n)
        key, at = np.unique(np.repeat(of, n) * len(self.least) + self.block[posting], return_inverse=True)
        bound = np.bincount(at, weights=self.best[posting], minlength=len(key)) * (1 + 1e-9)
        pivots = key[bound >= self.least[key % len(self.least)]]
        open_ = np.flatnonzero(self.least <= 0)  # blocks that common terms alone can reach
        if len(open_):
            pivots = np.union1d(pivots, (np.unique(of)[:, None] * len(self.least) + open_).ravel())
        has = np.zeros(n_terms)
        start = 0
        while start < len(pivots):
            t = pivots[start] // len(self.least)
            end = int(np.searchsorted(pivots, (t + 1) * len(self.least)))
            own = term[np.searchsorted(of, t) : np.searchsorted(of, t, side="right")]
            has[own] = 1.0
            hit: list[int] = []
            for b in (pivots[start:end] % len(self.least)).tolist():
                lo, hi = b * BLOCK, min((b + 1) * BLOCK, len(self.items))
                x, y = self.edges[lo], self.edges[hi]
                score = np.add.reduceat(self.impact[x:y] * has[self.terms[x:y]], self.edges[lo:hi] - x)
                hit += (np.flatnonzero(score >= self.need[lo:hi]) + lo).tolist()
            has[own] = 0.0
            if hit:
                yield int(t), hit
            start = end


class Index:
    """One part of the index, from rows (item, question words, answer words, document frequencies)."""

    def __init__(self, rows: list[tuple], n: int, mean: float):
        df: dict[bytes, int] = {}
        for _, _, _, own in rows:
            df.update(own)
        common = max(1.0, COMMON * n)
        self.term = {w: i + 1 for i, w in enumerate(sorted(df, key=lambda w: (df[w] > common, w)))}
        n_essential = sum(d <= common for d in df.values())
        by_k: dict[int, list[tuple]] = {}
        for item, q, a, own in rows:
            by_k.setdefault(min(SHINGLE, len(q) + len(a)), []).append((item, q, a, impacts(q + a, own, n, mean)))
        self.groups = [Group(k, x, self.term, n_essential) for k, x in sorted(by_k.items())]

    def hits(self, texts: list[list[bytes]]) -> list[list[tuple]]:
        """For each text, (item, question overlap, answer overlap, overlap) of the items that its words hold."""
        out: list[list[tuple]] = [[] for _ in texts]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        words = [w for t in texts for w in t]
        ids = np.fromiter(map(self.term.get, words, repeat(0)), dtype=np.int64, count=len(words))
        text = np.repeat(np.arange(len(texts)), sizes)
        for group in self.groups:
            for t, found in group.retrieved(ids, text):
                out[t] += confirmed(texts[t], [group.items[i] for i in found])
        return out


def confirmed(words: list[bytes], items: list[tuple]) -> list[tuple]:
    """Of retrieved items those of which the text has ``OVERLAP``, of the whole or of a question that counts alone."""
    out, have = [], {}

    def share(part: list[bytes]) -> float:
        """Of the shingles of a part, those that the text has; parts of fewer words are one shingle. 1 for no words."""
        size = min(SHINGLE, len(part))
        if not size:
            return 1.0
        if size not in have:
            have[size] = shingles_of(words, size)
        wanted = shingles_of(part)
        return len(wanted & have[size]) / len(wanted)

    for i, q, a in items:
        overlap, question = share(q + a), share(q)
        if overlap >= OVERLAP or (len(q) >= QUESTION and question >= OVERLAP):
            out.append((i, question, share(a), overlap))
    return out


def indexes(benchmark: DataFrame, id_col: str = "item_id", text: str = "text", answer: str | None = None) -> Iterator[Index]:
    """The parts of the index. Without an ``answer`` column the last sentence of an item counts as its answer.

    Items without words are left out; of repeated texts all ids count. An item
    of fewer words than a shingle is one shingle, so a document holds it only
    whole, and one of a single word wherever that word is.
    """
    picked = benchmark.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("item"), F.col(text).alias("text"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for q, a in zip(texts_of(batch), batch.column(3).cast(pa.large_binary()).to_pylist()):
                if a is None and not answer:
                    head, dot, tail = q.rstrip(b" .\n\t\r").rpartition(b". ")
                    q, a = (head + dot, tail) if dot else (q, b"")
                parts.append((words_of(q), words_of(a or b"")))
            columns = [pa.array([b" ".join(x[j]) for x in parts], pa.binary()) for j in range(2)]
            different = pa.array([sorted(set(q + a)) for q, a in parts], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, pa.array([len(q) + len(a) for q, a in parts], pa.int64()), different], ["row", "item", "q", "a", "n", "words"])

    items = cut(picked.mapInArrow(parse, "row long, item long, q binary, a binary, n long, words array<binary>").where("n > 0"))
    n, mean, postings = items.agg(F.count("*"), F.avg("n"), F.sum(F.size("words"))).first()
    if not n:
        return
    shards = max(-(-n // SHARD), -(-postings // POSTINGS))
    posted = items.select("row", F.explode("words").alias("word"))
    frequent = posted.groupBy("word").agg(F.count("*").alias("df"))
    with_df = posted.join(frequent, "word").groupBy("row").agg(F.collect_list(F.struct("word", "df")).alias("df"))

    def build(rows: pa.Table) -> pa.Table:
        found = [(i, q.split(), a.split(), {x["word"]: x["df"] for x in df}) for i, q, a, df in zip(*(rows.column(c).to_pylist() for c in ("item", "q", "a", "df")))]
        return pa.table({"index": pa.array([zstandard.compress(pickle.dumps(Index(found, n, mean)))], pa.binary())})

    dealt = items.drop("words").join(with_df, "row").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(shards)))
    for r in dealt.groupBy("part").applyInArrow(build, "index binary").toLocalIterator():
        yield pickle.loads(zstandard.decompress(r["index"]))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **items) -> DataFrame:
    """(doc_id, item_id, question_overlap, answer_overlap, overlap) of every item that a document holds.

    It does where ``overlap``, over question and answer together, or the
    ``question_overlap`` of a question of ``QUESTION`` words or more reaches
    ``OVERLAP``. Null and empty texts hold
    none; repeated rows give repeated rows; null ids are kept. An empty
    benchmark or an empty table gives no rows.
    """
    schema = "doc_id long, item_id long, question_overlap double, answer_overlap double, overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for index in indexes(benchmark, **items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in slices(batches):
                rows = [(i, *hit) for i, found in zip(batch.column(0).to_pylist(), sent.value.hits([words_of(t) for t in texts_of(batch)])) for hit in found]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(list(zip(*rows)) or [()] * 5, kinds)], ["doc_id", "item_id", "question_overlap", "answer_overlap", "overlap"])

        out = out.union(chosen.mapInArrow(scan, schema))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", **items) -> DataFrame:
    """``docs`` without those that hold a test item; rows are filtered where they are, nothing is joined.

    Null and empty texts stay, as do all rows if the benchmark is empty;
    repeated rows go or stay together; all columns are kept as they are.
    """
    for index in indexes(benchmark, **items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            forget()
            for batch in slices(batches, column=text):
                found = sent.value.hits([words_of(t) for t in texts_of(batch, text)])
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
