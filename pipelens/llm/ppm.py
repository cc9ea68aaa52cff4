"""LM scoring by prediction by partial matching over bytes, beside a word-unigram base.

The coded sequence of a document is its words, A-Z lower-cased and joined by
one space, and then an end symbol: 257 symbols, of which each is coded in the
context of the ``ORDER`` symbols before it. The model is a trie of contexts
trained once over all training documents (escape method C, with symbol
exclusion). All orders follow from the counts of the longest n-grams: lower
orders are sums over their suffixes, and what a longer context excludes is its
own set of symbols, so a context's exclusions need only the mass that its
symbols have in the next shorter context.

Neither the vocabulary nor the trie is ever held in one place. Documents are
packed into chunks; every chunk asks for the words and n-grams it has, once
each and sorted, in one packed row for each part of the trie. A part has all
n-grams of the contexts whose last three symbols have its hash. The rows of a
part are merged in a tree, ``FAN`` at a time, until its different n-grams and
words are left with their counts; costs are computed once for each of these,
and the chunks' rows then stream past them for their answers, which are packed
as well. Broadcast are only the counts of symbol triples, of which the shorter
contexts follow; there are 257 x 257 x 257 at most.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm.common import crc_mod, cut, slices, vocabulary

#: Symbols before the coded one that the longest contexts have.
ORDER = 5
SYMBOLS = 257
END = 256
BITS = 9
#: Bytes of text in a chunk, about.
CHUNK = 16 << 20
#: Bytes of text whose n-grams are made at a time, about.
PIECE = 2 << 20
#: Bytes of text for each part of the trie, about.
PART_BYTES = 16 << 20
#: Packed rows of one part that a merge takes, about, and chunks that one task answers.
FAN, ANSWERS = 64, 256
#: N-grams whose costs are computed, or merged, at a time, about.
BLOCK = 1 << 20


# ---------------------------------------------------------------- packing


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    made, held, size = 0, [], 0

    def chunk():
        ids, train, texts = zip(*held)
        joined = [b" ".join(t.lower().split()) for t in texts]
        blob = zstandard.compress(pickle.dumps((ids, train, joined), protocol=5), 4)
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | made], pa.int64()), pa.array([blob], pa.binary()), pa.array([size], pa.int64())], ["chunk", "blob", "bytes"])

    for batch in slices(batches):
        ids, train = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, learns, text in zip(ids, train, batch.column(2).cast(pa.large_binary()).to_pylist()):
            held.append((i, learns, text or b""))
            size += len(held[-1][2]) + 64
            if size >= CHUNK:
                yield chunk()
                made, held, size = made + 1, [], 0
    if held:
        yield chunk()


def _unpack(blob: bytes) -> tuple[tuple, tuple, tuple]:
    return pickle.loads(zstandard.decompress(blob))


def pieces(joined: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``PIECE`` bytes together, one text at least."""
    start = size = 0
    for i, text in enumerate(joined):
        size += len(text) + 1
        if size >= PIECE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(joined):
        yield start, len(joined)


def grams_of(joined: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All (order + 1)-grams, one for each byte and end of each text, and the text each is of. Before a text are ends."""
    sizes = np.fromiter(map(len, joined), dtype=np.int64, count=len(joined))
    ends = np.cumsum(sizes + order + 1) - 1  # every text has `order` end symbols before it and one behind it
    symbols = np.full(int(ends[-1]) + 1 if len(ends) else 0, END, dtype=np.int64)
    flat = np.frombuffer(b"".join(joined), dtype=np.uint8)
    place = np.arange(len(flat)) + np.repeat(ends - np.cumsum(sizes), sizes)
    symbols[place] = flat
    coded = np.zeros(len(symbols), dtype=bool)
    coded[place] = True
    coded[ends] = True
    gram = np.zeros(max(0, len(symbols) - order), dtype=np.int64)
    for j in range(order + 1):
        gram <<= BITS
        gram |= symbols[j : len(symbols) - order + j]
    return gram[coded[order:]], np.repeat(np.arange(len(joined)), sizes + 1)


# ---------------------------------------------------------------- packed tables


def _planes(a: np.ndarray) -> bytes:
    """The bytes of eight-byte numbers, first bytes first: neighbours are alike then, and most are zero."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(data: bytes, kind=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(kind).ravel()


def _packed(grams: np.ndarray, n: np.ndarray, words: list[bytes], counts: np.ndarray) -> bytes:
    """Ascending n-grams and words with their counts."""
    return zstandard.compress(pickle.dumps((_planes(np.diff(grams, prepend=0)), _planes(n.astype(np.int64)), b" ".join(words), _planes(counts.astype(np.int64)))), 3)


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    grams, n, words, counts = pickle.loads(zstandard.decompress(blob))
    return np.cumsum(_numbers(grams)), _numbers(n), words.split(b" ") if words else [], _numbers(counts)


def _hashed(grams: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the last three symbols, two for contexts of two, before each n-gram's last."""
    near = (grams >> BITS) & ((1 << BITS * min(order, 3)) - 1)
    return (near.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)


def _by_part(grams: np.ndarray, words: list[bytes], order: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Orders of n-grams and of words by part, and the parts' edges in both."""
    g = (_hashed(grams, order) % np.uint64(parts)).astype(np.int64)
    w = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % parts
    in_g, in_w = np.argsort(g, kind="stable"), np.argsort(w, kind="stable")
    each = np.arange(parts + 1)
    return in_g, np.searchsorted(g[in_g], each), in_w, np.searchsorted(w[in_w], each)


def distinct(joined: list[bytes], order: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The different n-grams of texts, ascending; for every piece of the texts, which each of its n-grams is and the text it is of."""
    found, held = [np.zeros(0, dtype=np.int64)], []
    for a, b in pieces(joined):
        grams, of = grams_of(joined[a:b], order)
        code, some = pd.factorize(grams)
        held.append((code.astype(np.int32), len(some), (of + a).astype(np.int32)))
        found.append(some)
    number, grams = pd.factorize(np.concatenate(found))  # much faster than sorting all that pieces have found
    in_order = np.argsort(grams)
    rank = np.empty(len(grams), dtype=np.int32)
    rank[in_order] = np.arange(len(grams), dtype=np.int32)
    number, at, out = rank[number], 0, []
    for code, n, of in held:
        out.append((number[at : at + n][code], of))
        at += n
    return grams[in_order], out


def _ask(order: int, parts: int):
    """Of every chunk, for every part: its words and n-grams, and how often training documents have each; as part -1 its symbol triples."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, train, joined = _unpack(blob)
                learns = np.asarray(train, dtype=float)
                grams, held = distinct(joined, order)
                n = np.zeros(len(grams))
                for at, of in held:
                    n += np.bincount(at, weights=learns[of], minlength=len(grams))
                del held
                triples, at = np.unique(grams & ((1 << 3 * BITS) - 1), return_inverse=True)
                total = np.bincount(at, weights=n, minlength=len(triples))
                rows = [(-1, _packed(triples[total > 0], total[total > 0], [], np.zeros(0)))]
                words, code, of = vocabulary(joined)
                counts = np.bincount(code, weights=learns[of], minlength=len(words)).astype(np.int64)
                in_g, g, in_w, w = _by_part(grams, words, order, parts)
                for p in range(parts):
                    own = in_w[w[p] : w[p + 1]].tolist()
                    at = in_g[g[p] : g[p + 1]]
                    if own or len(at):
                        rows.append((p, _packed(grams[at], n[at], [words[i] for i in own], counts[own])))
                for a in range(0, len(rows), 64):
                    some = rows[a : a + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array([x for _, x in some], pa.binary())], ["part", "chunk", "blob"])

    return ask


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, group, blob), sorted by both: for each its different n-grams, and the words that training has, with the sums of their counts."""
    now, grams, waiting, words = None, None, [], Counter()

    def summed():
        g, n = (np.concatenate([grams[j], *(x[j] for x in waiting)]) for j in range(2))
        some, at = np.unique(g, return_inverse=True)
        return some, np.bincount(at, weights=n, minlength=len(some)).astype(np.int64)

    def row():
        g, n = summed()
        names = sorted(words)
        counts = np.fromiter(map(words.__getitem__, names), dtype=np.int64, count=len(names))
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([_packed(g, n, names, counts)], pa.binary()), pa.array([len(names)], pa.int64())], ["part", "group", "blob", "words"])

    for batch in batches:
        for part, group, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if (part, group) != now:
                if now is not None:
                    yield row()
                now, grams, waiting, words = (part, group), (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), [], Counter()
            g, n, names, counts = _opened(blob)
            waiting.append((g, n))
            words.update({names[i]: int(counts[i]) for i in np.flatnonzero(counts).tolist()})
            if sum(len(x[0]) for x in waiting) > max(BLOCK, len(grams[0])):
                grams, waiting = summed(), []
    if now is not None:
        yield row()


# ---------------------------------------------------------------- the model


class Base:
    """Counts of contexts of up to two symbols, from ascending symbol triples and their counts."""

    def __init__(self, triples: np.ndarray, n: np.ndarray):
        self.triples, self.n = triples, n.astype(np.float64)
        low = triples & ((1 << 2 * BITS) - 1)
        self.pairs = np.bincount((low >> BITS) * SYMBOLS + (low & (2**BITS - 1)), weights=self.n, minlength=SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS)
        self.context, at = np.unique(triples >> BITS, return_inverse=True)
        below = self.pairs[(low >> BITS), low & (2**BITS - 1)]
        self.of_context = [np.bincount(at, weights=w, minlength=len(self.context)) for w in (self.n, np.ones(len(at)), below)]


def _looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of ascending keys, 0 for what they lack."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def costs(grams: np.ndarray, counts: np.ndarray, base: Base, order: int) -> np.ndarray:
    """log10 probability of each gram's last symbol after the symbols before it.

    ``grams`` are different and hold, with their training ``counts``, all
    grams that share three symbols of context with any of them.
    """
    index, n_sym, n_ctx, d_ctx, m_ctx = {}, {}, {}, {}, {}  # by order, for every gram
    pairs = base.pairs
    for k in range(order, 2, -1):
        seen, at = np.unique(grams & ((1 << BITS * (k + 1)) - 1), return_inverse=True)
        index[k] = (seen, at, np.bincount(at, weights=counts, minlength=len(seen)))
    for k in range(order, 2, -1):
        seen, at, total = index[k]
        ctx, ctx_at = np.unique(seen >> BITS, return_inverse=True)
        there = total > 0
        if k > 3:
            shorter, _, short_total = index[k - 1]
            below = short_total[np.searchsorted(shorter, seen & ((1 << BITS * k) - 1))]
        else:
            below = _looked_up(base.triples, base.n, seen & ((1 << BITS * k) - 1))
        sums = [np.bincount(ctx_at, weights=w, minlength=len(ctx)) for w in (total, there, below * there)]
        n_sym[k] = total[at]
        n_ctx[k], d_ctx[k], m_ctx[k] = (x[ctx_at[at]] for x in sums)
    low = grams & ((1 << 3 * BITS) - 1)
    n_sym[2] = _looked_up(base.triples, base.n, low)
    n_ctx[2], d_ctx[2], m_ctx[2] = (_looked_up(base.context, x, low >> BITS) for x in base.of_context)
    singles = pairs.sum(axis=0)
    symbol, before = grams & (2**BITS - 1), (grams >> BITS) & (2**BITS - 1)
    there = pairs > 0
    n_sym[1], n_ctx[1], d_ctx[1] = pairs[before, symbol], pairs.sum(axis=1)[before], there.sum(axis=1)[before]
    m_ctx[1] = (there * singles).sum(axis=1)[before]
    n_sym[0], n_ctx[0], d_ctx[0] = singles[symbol], np.full(len(grams), singles.sum()), np.full(len(grams), (singles > 0).sum())
    out, open_ = np.zeros(len(grams)), np.ones(len(grams), dtype=bool)
    shut_n, shut_d = np.zeros(len(grams)), np.zeros(len(grams))  # mass and number of what is excluded at this order
    for k in range(order, -1, -1):
        live = open_ & (n_ctx[k] > 0)
        mass, kinds = n_ctx[k] - shut_n, d_ctx[k] - shut_d
        # where every symbol of the context is excluded, going on costs nothing
        some = live & (kinds > 0)
        left = SYMBOLS - d_ctx[k]
        escape = np.where(left > 0, kinds, 0)
        hit = some & (n_sym[k] > 0)
        out[hit] += np.log10(n_sym[k][hit] / (mass + escape)[hit])
        miss = some & (n_sym[k] == 0)
        out[miss] += np.log10(escape[miss] / (mass + escape)[miss])
        open_ &= ~hit
        if k:
            # a context that training does not have excludes nothing, and no longer one was there either
            shut_n = np.where(n_ctx[k] > 0, m_ctx[k], 0.0)
            shut_d = np.where(n_ctx[k] > 0, d_ctx[k], 0.0)
    out[open_] -= np.log10(SYMBOLS - d_ctx[0][open_])
    return out


def priced(grams: np.ndarray, counts: np.ndarray, base: Base, order: int) -> np.ndarray:
    """``costs`` of any number of grams, those of a context together and about ``BLOCK`` at a time."""
    blocks = len(grams) // BLOCK + 1
    if blocks == 1:
        return costs(grams, counts, base, order)
    block = ((_hashed(grams, order) >> np.uint64(7)) % np.uint64(blocks)).astype(np.int64)
    out = np.zeros(len(grams))
    for b in range(blocks):
        at = np.flatnonzero(block == b)
        out[at] = costs(grams[at], counts[at], base, order)
    return out


def _answer(sent, order: int):
    """Rows (part, cell, side, chunk, blob), sorted by the first three: of each cell first a part of the trie, then what chunks ask of it."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table = Base(*sent.value), (np.zeros(0, dtype=np.int64), np.zeros(0), {})
        for batch in batches:
            parts, chunks, blobs = [], [], []
            for part, side, chunk, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "side", "chunk", "blob"))):
                grams, n, names, counts = _opened(blob)
                if not side:
                    table = (grams, priced(grams, n.astype(np.float64), base, order), dict(zip(names, counts.tolist())))
                    continue
                cost = table[1][np.searchsorted(table[0], grams)]
                known = np.fromiter(map(table[2].get, names, repeat(0)), dtype=np.int64, count=len(names))
                code, some = pd.factorize(cost)  # many n-grams cost the same
                parts.append(part)
                chunks.append(chunk)
                blobs.append(zstandard.compress(pickle.dumps((code.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), _planes(some), _planes(known))), 3))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], ["part", "chunk", "answer"])

    return answer


def _told(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Costs of n-grams and counts of words, as a chunk asked for them."""
    code, some, known = pickle.loads(zstandard.decompress(blob))
    code = np.ascontiguousarray(np.frombuffer(code, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return _numbers(some, np.float64)[code], _numbers(known)


# ---------------------------------------------------------------- scoring


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, score double, n_part long"


def _scored(blob: bytes, told: list[bytes], order: int, parts: int) -> pa.RecordBatch:
    """The documents of a chunk with their counts and scores, from its texts and the answers in the order of the parts."""
    ids, train, joined = _unpack(blob)
    grams, held = distinct(joined, order)
    names, code, word_of = vocabulary(joined)
    in_g, _, in_w, _ = _by_part(grams, names, order, parts)
    # answers come as the questions went
    cost, count = np.zeros(len(grams)), np.zeros(len(names), dtype=np.int64)
    x = y = 0
    for answer in told:
        c, k = _told(answer)
        cost[in_g[x : x + len(c)]] = c
        count[in_w[y : y + len(k)]] = k
        x, y = x + len(c), y + len(k)
    total = np.zeros(len(joined))
    for at, of in held:
        total += np.bincount(of, weights=cost[at], minlength=len(joined))
    n_words = np.bincount(word_of, minlength=len(joined))
    known = np.bincount(word_of, weights=count[code] > 0, minlength=len(joined)).astype(np.int64)
    known_log = np.bincount(word_of, weights=np.log10(count + 1.0)[code], minlength=len(joined)).astype(np.float64)
    n_part = np.zeros(len(joined), dtype=np.int64)
    n_part[0] = n_words[np.asarray(train, dtype=bool)].sum()
    columns = [pa.array(ids, pa.int64()), pa.array([not x for x in train]), *map(pa.array, (n_words.astype(np.int64), known, known_log, total, n_part))]
    return pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in RESULT.split(", ")])


def _score(order: int, parts: int):
    """Rows (chunk, side, part, blob), sorted by the first three: of each chunk first its texts, then what it was told."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, told = None, b"", []
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if chunk == now:
                    told.append(blob)
                    continue
                if now is not None:
                    yield _scored(texts, told, order, parts)
                now, texts, told = chunk, blob, []
        if now is not None:
            yield _scored(texts, told, order, parts)

    return score


def score(docs: DataFrame, held_mod: int = 7, held_is: int = 2, order: int = ORDER, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of every whole document by the trie and by the word-unigram base.

    Documents learn unless crc32 of their id as text, modulo ``held_mod``, is
    ``held_is``. Returned: doc_id, held_out, n_tokens (words and one end),
    n_known (tokens that training has), train_tokens, base_score (log10, add-one)
    and score (log10 by the trie, of the same sequence of tokens). A null text
    is the empty one, whose only token is the end; null ids count as the empty
    id; repeated rows count and score each on their own; an empty table gives
    no rows. Without training documents the trie is uniform.
    """
    if order < 2:
        raise ValueError("contexts of 2 symbols at least")
    chosen = docs.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, held_mod) != held_is).alias("train"), F.col(text).alias("text"))
    spark = docs.sparkSession
    packed = cut(chosen.mapInArrow(_pack, "chunk long, blob binary, bytes long"))
    chunks, size, tasks = packed.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max(F.shiftright("chunk", 32)) + 1, F.lit(0))).first()
    parts = max(size // PART_BYTES, min(size // (1 << 20), int(spark.conf.get("spark.sql.shuffle.partitions")))) + 1
    asks = cut(packed.select("chunk", "blob").mapInArrow(_ask(order, parts), "part int, chunk long, blob binary"))
    merged, groups = asks, chunks
    while merged is asks or groups > 1:
        groups = -(-groups // FAN)
        by = F.pmod(F.xxhash64("chunk"), F.lit(max(1, groups))).alias("group")
        level = merged.select("part", by, "blob").repartition(parts, "part", "group").sortWithinPartitions("part", "group")
        merged = cut(level.mapInArrow(_merge, "part int, group long, blob binary, words long").withColumn("chunk", F.col("group")))
    triples = merged.where("part = -1").select("blob").first()
    sent = spark.sparkContext.broadcast(_opened(triples[0])[:2] if triples else (np.zeros(0, dtype=np.int64), np.zeros(0)))
    # the chunks that ask are dealt to as many cells of a part as there are hundreds of them
    cells = -(-chunks // ANSWERS) or 1
    tables = merged.where("part >= 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("chunk"), "blob")
    asked = asks.where("part >= 0").select("part", F.pmod(F.xxhash64("chunk"), F.lit(cells)).cast("int").alias("cell"), F.lit(1).alias("side"), "chunk", "blob")
    answers = tables.union(asked).repartition(parts * cells, "part", "cell").sortWithinPartitions("part", "cell", "side").mapInArrow(_answer(sent, order), "part int, chunk long, answer binary")
    # chunks are numbered by task, so that, of tasks with equally many, each has a partition of its own
    each = -(-chunks // max(1, tasks))
    number = F.shiftright("chunk", 32) * each + F.col("chunk").bitwiseAND(F.lit((1 << 32) - 1))
    texts = packed.select("chunk", F.lit(0).alias("side"), F.lit(-1).alias("part"), "blob")
    both = texts.union(answers.select("chunk", F.lit(1), "part", "answer"))
    n_parts = max(1, tasks * each)
    dealt = both.repartitionById(n_parts, F.pmod(number, F.lit(n_parts)).cast("int")).sortWithinPartitions("chunk", "side", "part")
    scored = cut(dealt.mapInArrow(_score(order, parts), RESULT))
    different = merged.where("part >= 0").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    known = scored.agg(F.coalesce(F.sum("n_part"), F.lit(0)), F.count(F.when(~F.col("held_out"), 1))).first()
    # the end token: once in every training document
    n, v, ends = known[0] + known[1], different + (known[1] > 0), known[1]
    scale = math.log10(n + v + 1)
    return scored.select(
        "doc_id", "held_out",
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("known_log") + F.lit(math.log10(ends + 1)) - (F.col("n_tokens") + 1) * F.lit(scale)).alias("base_score"),
        "score",
    )
