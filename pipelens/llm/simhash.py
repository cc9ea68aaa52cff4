"""SimHash near-duplicates by the generalised pigeonhole principle.

The bits of the fingerprints are put into partitions so that correlated bits
share one. Partition i gets a threshold t_i with sum(t_i) = bits - parts + 1,
so two fingerprints within ``bits`` agree on some partition i up to t_i bits.
The number of partitions and the thresholds, unequal where partitions are
unequally selective, come from dynamic programming over candidate counts that
are estimated on a bounded sample. Every fingerprint is indexed under its exact
partition values, probes with all values within t_i, and is verified on all
bits. The result does not depend on the allocation, only the work does.

Copies meet in one fingerprint first. What is emitted of a bucket is a spanning
forest of its links, never all pairs, and buckets above ``BLOCK`` rows are cut
into pairs of blocks that different tasks compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.llm.common import cut, forget, slices, texts_of, trim

SEED = 42
#: Fingerprints that the estimates are made from, at most.
SAMPLE = 2_000
#: Rows of one partition value that one group compares.
BLOCK = 1 << 15
#: Links that a task holds before it reduces them to a spanning forest.
MOST_LINKS = 1 << 17
#: Pairs of one text that are compared in one place, about.
HUB = 256
#: Rows from which on a group is broadcast instead of meeting in one task, and how many such groups at most.
MANY, MOST_BUSY = 256, 200_000
#: Buckets of text digests: what is known of a bucket is broadcast, so that most texts need not move.
BUCKETS = 1 << 20
#: Texts whose shingles tell which are common: this share, or about this many, if that is more; how many of those texts a common one is in, at least; most common shingles.
SAMPLE_SHARE, SAMPLE_TEXTS, COMMON_TEXTS, MOST_COMMON = 1 / 8, 8_000, 3, 200_000
#: Pairs of one shingle's texts that a task makes at a time, about.
PAIRS = 1 << 19
#: Edges that a task reduces to stars, about.
STAR_EDGES = 1 << 18
#: Estimated costs of a probe row and of a verified pair, in seconds.
PROBE_S, VERIFY_S = 1e-5, 3e-9
#: Rows of the probe table that a task takes, about.
TASK_ROWS = 1 << 20


# ---------------------------------------------------------------- fingerprints


def features(text: bytes, shingle: int) -> list[bytes]:
    """Word shingles of a text, repeats included; ``shingle`` 0: its different words."""
    words = text.lower().split()
    if not shingle:
        return list(set(words))
    if len(words) <= shingle:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[: len(words) - shingle])).tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]


def fingerprint(text: bytes, shingle: int) -> int:
    """64 bits: bit j is 1 if set in over half of the features' XXH64; 0 without features."""
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in features(text, shingle)], dtype="<u8")
    if not len(hashes):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[a : a + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, name: str, shingle: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with a long column ``name`` that holds the fingerprint's bits. A null text counts as empty."""
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, column=text):
            found = np.array([fingerprint(t, shingle) for t in texts_of(batch, text)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return docs.mapInArrow(add, schema)


# ---------------------------------------------------------------- allocation


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """64 bit positions in ``parts`` groups: each group takes, again and again, the bit most correlated with it."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    bits -= bits.mean(axis=0)
    norm = np.sqrt((bits * bits).sum(axis=0))
    corr = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-12)
    left, groups = list(range(64)), []
    for g in range(parts):
        width = 64 // parts + (g < 64 % parts)
        group = [left.pop(0)]
        while len(group) < width:
            best = max(left, key=lambda b: (corr[b, group].mean(), -b))
            left.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def values_of(prints: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of a group, packed into an integer."""
    out = np.zeros(len(prints), dtype=np.int64)
    for j, b in enumerate(group):
        out |= ((prints >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << j
    return out


def allocate(sample: np.ndarray, n: int, bits: int) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and a threshold for each (-1: not probed) of least estimated cost for ``n`` fingerprints."""
    best = None
    for parts in range(2, bits + 2):
        groups = bit_groups(sample, parts)
        costs = []
        for group in groups:
            v = values_of(sample, group)
            apart = np.bincount(np.bitwise_count(v[:, None] ^ v[None, :]).ravel(), minlength=len(group) + 1).astype(float)
            apart[0] -= len(v)
            share = np.cumsum(np.maximum(apart, 0.5)) / max(1, len(v) * (len(v) - 1))
            # a uniform part is the least that a larger input can show
            share = np.maximum(share, np.cumsum([comb(len(group), d) for d in range(len(group) + 1)]) / 2.0 ** len(group))
            probes = np.cumsum([comb(len(group), d) for d in range(len(group) + 1)])
            costs.append([0.0] + [n * float(probes[t]) * PROBE_S + float(n) * n * float(share[t]) * VERIFY_S for t in range(min(bits, len(group)) + 1)])
        # least[s]: the cheapest thresholds so far whose (t + 1) sum to s
        need = bits + 1
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for cost in costs:
            now: dict[int, tuple[float, list[int]]] = {}
            for s, (spent, chosen) in least.items():
                for j in range(min(len(cost) - 1, need - s) + 1):
                    if s + j not in now or spent + cost[j] < now[s + j][0]:
                        now[s + j] = (spent + cost[j], [*chosen, j - 1])
            least = now
        if need in least and (best is None or least[need][0] < best[0]):
            best = (least[need][0], groups, least[need][1])
    return best[1], best[2]


# ---------------------------------------------------------------- links


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of links that span the same components, nearest links first (Kruskal)."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    up, keep = list(range(len(nodes))), []
    x, y = ends[: len(a)].tolist(), ends[len(a) :].tolist()
    for i in np.argsort(d, kind="stable").tolist():
        p, q = x[i], y[i]
        while up[p] != p:
            up[p] = p = up[up[p]]
        while up[q] != q:
            up[q] = q = up[up[q]]
        if p != q:
            up[p] = q
            keep.append(i)
    return np.array(keep, dtype=np.int64)


def nearest_tree(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimum spanning forest of the links within ``bits`` (Prim), in memory proportional to the rows."""
    left = prints[1:].copy()
    near = np.bitwise_count(left ^ prints[0]).astype(np.int64)
    source = np.full(len(left), prints[0])
    a, b, d = [], [], []
    while len(left):
        i = int(near.argmin())
        p = left[i]
        if near[i] <= bits:
            a.append(source[i]), b.append(p), d.append(int(near[i]))
        left[i], near[i], source[i] = left[-1], near[-1], source[-1]
        left, near, source = left[:-1], near[:-1], source[:-1]
        apart = np.bitwise_count(left ^ p)
        closer = apart < near
        near[closer], source[closer] = apart[closer], p
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), np.array(d, dtype=np.int64)


def bucket_links(key: np.ndarray, prints: np.ndarray, home: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links within ``bits`` of rows with one key, of which one is at home there; a spanning forest of them."""
    order = np.lexsort((~home, key))
    key, prints, home = key[order], prints[order], home[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    homes = np.add.reduceat(home.astype(np.int64), starts) if len(key) else sizes
    out: list = []
    waiting = 0

    def spanned() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not out:
            none = np.zeros(0, dtype=np.uint64)
            return none, none, np.zeros(0, dtype=np.int64)
        a, b, d = (np.concatenate([x[j] for x in out]) for j in range(3))
        keep = forest(a, b, d)
        return a[keep], b[keep], d[keep]

    for s, n, h in zip(starts.tolist(), sizes.tolist(), homes.tolist()):
        if n < 2 or not h:
            continue
        rows = prints[s : s + n]
        if h > 64:
            out.append(nearest_tree(np.unique(rows), bits))
        else:
            x, y = np.repeat(rows[:h], n), np.tile(rows, h)
            apart = np.bitwise_count(x ^ y)
            ok = (apart <= bits) & (x != y)
            if not ok.any():
                continue
            out.append((x[ok], y[ok], apart[ok].astype(np.int64)))
        waiting += len(out[-1][0])
        if waiting > MOST_LINKS:  # what is held stays within the number of rows and this
            out = [spanned()]
            waiting = 0
    return spanned()


def links(prints: DataFrame, bits: int) -> DataFrame:
    """Spanning links (a, b, apart) of different fingerprints, from a table of one long column without repeats.

    They connect exactly what the links within ``bits`` connect. An empty
    table has none.
    """
    name, spark = prints.columns[0], prints.sparkSession
    n = prints.count() if bits > 0 else 0
    sample = np.array([r[0] for r in prints.orderBy(F.xxhash64(name)).limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    if n < 2:
        return spark.createDataFrame([], "a long, b long, apart int")
    groups, limits = allocate(sample, n, bits)
    masks = []  # of each probed group: what to flip in its packed value, nothing first
    for group, t in zip(groups, limits):
        masks.append(np.array([sum(1 << j for j in flip) for d in range(t + 1) for flip in combinations(range(len(group)), d)], dtype=np.int64) if t >= 0 else None)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                own = batch.column(0).to_numpy(zero_copy_only=False)
                for g, (group, flips) in enumerate(zip(groups, masks)):
                    if flips is None:
                        continue
                    key = (values_of(own.view(np.uint64), group)[:, None] ^ flips) * len(groups) + g
                    home = np.broadcast_to(flips == 0, key.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(own, len(flips))), pa.array(home.ravel())], ["key", "p", "home"])

    each = sum(len(x) for x in masks if x is not None)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * each // TASK_ROWS + 1)
    # a group's packed value times the number of groups stays below 2**62: 64 bits are in 2 groups or more
    rows = prints.repartition(max(2, min(parts, n // 2048 + 1))).mapInArrow(probes, "key long, p long, home boolean")
    # keys with more than BLOCK rows: at most one for every BLOCK rows
    hot = rows.groupBy("key").count().where(F.col("count") > BLOCK).select(F.col("key").alias("hot_key"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    own_block = F.pmod(F.xxhash64("p"), F.col("blocks")).cast("int")
    pairs = F.when(
        F.col("blocks") > 1,
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, own_block) * F.col("blocks") + F.greatest(o, own_block)),
    ).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hot, F.col("key") == F.col("hot_key"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).select("key", "p", "home", F.explode(pairs).alias("pair"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        key, p, home, pair = (x.to_numpy() for x in pa.Table.from_batches(held).columns)
        order = np.lexsort((pair, key))
        key, pair, p, home = key[order], pair[order], p[order], home[order]
        group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1]))))
        a, b, d = bucket_links(group, p.view(np.uint64), home, bits)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d.astype(np.int32))], ["a", "b", "apart"])
        trim()

    found = dealt.repartition(parts, "key", "pair").mapInArrow(compare, "a long, b long, apart int")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "apart").distinct()


# ---------------------------------------------------------------- components


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges (a, b) that a task has, the forest of what they connect: (node, smallest node) without the smallest ones."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    a, b = (x.to_numpy() for x in pa.Table.from_batches(held).columns)
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    up = list(range(len(nodes)))
    for p, q in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist()):
        while up[p] != p:
            up[p] = p = up[up[p]]
        while up[q] != q:
            up[q] = q = up[up[q]]
        if p != q:
            up[max(p, q)] = min(p, q)
    root = np.array(up, dtype=np.int64)
    while (root[root] != root).any():
        root = root[root]
    some = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], ["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the component's smallest node.

    In each round tasks reduce ``STAR_EDGES`` edges each to a forest of stars;
    edges that one task holds are settled with that. Else a large-star and a
    small-star step follow, until nothing changes. Rounds are written to the
    shared folder. Minima are aggregated before the shuffle and joined back,
    so a hub's neighbours never meet in one group.
    """
    now = cut(edges.select("a", "b").where("a <> b"))
    before = None
    for _ in range(most_rounds):
        parts = now.count() // STAR_EDGES + 1
        now = cut(now.repartition(parts).mapInArrow(stars, "a long, b long"))
        if parts == 1:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(lowest, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = cut(small)
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # settled: every edge leads from a node to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id.

    Documents whose fingerprints differ in ``bits`` bits or fewer are linked;
    component_id is the smallest id that links reach, the document itself
    included. Null and empty texts have fingerprint zero and are linked like
    any other; null ids are kept and ignored as component ids (null if a
    component has no other); repeated rows give repeated rows.
    """
    named = with_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), "fp", shingle).select("doc_id", "fp")
    held = cut(named)
    least = cut(held.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(least.select("fp"), bits))
    classes = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = classes.join(ids, "root").select(F.col("fp").alias("l_fp"), "component_id")
    return held.join(labelled, F.col("fp") == F.col("l_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- deduplication


def _shingles(text: bytes, k: int) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh64_intdigest(x) for x in features(text, k)], dtype=np.uint64))


def similar_tree(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span what pairs of sets with that Jaccard similarity connect, by breadth-first search.

    A set is compared, through the postings of its elements, with those that
    are not reached yet. Reached sets leave the postings, so a group of near
    copies costs little more than one comparison each.
    """
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    element = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.zeros(0, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    own = [element[a : a + n] for a, n in zip(first, sizes)]
    owner = np.repeat(np.arange(len(sets)), sizes)
    n_elements = int(element.max()) + 1 if len(element) else 0
    open_ = np.ones(len(sets), dtype=bool)
    links: list[tuple[int, int]] = []

    def postings():
        live = open_[owner]
        order = np.argsort(element[live], kind="stable")
        held = owner[live][order]
        ends = np.cumsum(np.bincount(element[live], minlength=n_elements))
        return held, np.concatenate(([0], ends)), int(open_.sum())

    held, edges, indexed = postings()
    empty: int | None = None
    for start in range(len(sets)):
        if not open_[start]:
            continue
        open_[start] = False
        if not sizes[start]:  # empty sets are alike
            if empty is not None:
                links.append((empty, start))
            empty = start
            continue
        todo = [start]
        while todo:
            node = todo.pop()
            if open_.sum() * 2 < indexed:
                held, edges, indexed = postings()
            a, n = edges[own[node]], edges[own[node] + 1] - edges[own[node]]
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            met, common = np.unique(held[at], return_counts=True)
            near = met[open_[met] & (common >= similarity * (sizes[met] + sizes[node] - common))]
            open_[near] = False
            links += [(node, int(x)) for x in near]
            todo += near.tolist()
    return links


def parity(s: np.ndarray) -> bytes:
    """Whether an odd number of the elements of a set fall on each bit, of twice as many bits as there are elements or more.

    Every element that one of two sets has alone changes one bit, so sets
    differ in no fewer elements than their parities in bits.
    """
    bits = 1 << max(6, (2 * len(s)).bit_length())
    odd = np.bincount(((s >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ, the longer folded to the shorter."""
    a, b = int.from_bytes(x, "little"), int.from_bytes(y, "little")
    n, least = max(len(x), len(y)) * 8, min(len(x), len(y)) * 8
    if len(x) < len(y):
        a, b = b, a
    while n > least:
        n //= 2
        a = (a >> n) ^ (a & ((1 << n) - 1))
    return (a ^ b).bit_count()


def possible(cells: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those pairs of ``cells`` (hub, key, cell) whose sizes and parities allow that similarity; none that has it is left out."""
    own = lambda name, n, p: texts.select(F.col("key").alias(name), F.col("size").alias(n), F.col("parity").alias(p))
    hubs = cells.select("hub", "cell").distinct().join(own("hub", "n_hub", "p_hub"), "hub")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, m, p, q in zip(*(batch.column(c).to_pylist() for c in ("n_hub", "n", "p_hub", "p"))):
                ok.append(apart(p, q) <= (n + m) * (1 - similarity) / (1 + similarity) + 1e-6)
            yield batch.select(["hub", "key", "cell"]).filter(pa.array(ok, pa.bool_()))

    return cells.join(hubs, ["hub", "cell"]).join(own("key", "n", "p"), "key").mapInArrow(look, "hub long, key long, cell long")


def with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` joined by root with ``groups`` (root, n and more), n the rows of each; groups of many rows, of which there are few, are broadcast."""
    busy = groups.where(F.col("n") > MANY)
    if busy.limit(MOST_BUSY + 1).count() > MOST_BUSY:
        return rows.join(groups, "root")
    rest = rows.join(F.broadcast(busy.select("root")), "root", "left_anti").join(groups.where(F.col("n") <= MANY), "root")
    return rest.unionByName(rows.join(F.broadcast(busy), "root"))


def _bucket():
    return F.pmod(F.xxhash64("md"), F.lit(BUCKETS)).alias("bucket")


def _buckets(texts: DataFrame) -> DataFrame:
    """The buckets of texts, ``BUCKETS`` at most, to be broadcast."""
    return F.broadcast(texts.select(_bucket()).distinct())


def in_cells(pairs: DataFrame) -> DataFrame:
    """(hub, key, cell) of ``pairs`` (a, b) without repeats: the text with more pairs is the hub, and every ``HUB`` of its pairs, about, make a cell.

    Only texts with more pairs than that are looked up, which are few.
    """
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b"))
    busy = cut(ends.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HUB))
    n_a, n_b = F.coalesce("n_a", F.lit(1)), F.coalesce("n_b", F.lit(1))
    found = pairs.join(busy.toDF("a", "n_a"), "a", "left").join(busy.toDF("b", "n_b"), "b", "left")
    turned = F.when(n_a >= n_b, F.struct(F.col("a").alias("hub"), F.col("b").alias("key"), n_a.alias("n"))).otherwise(F.struct(F.col("b").alias("hub"), F.col("a").alias("key"), n_b.alias("n")))
    return found.select(turned.alias("t")).select("t.hub", "t.key", F.pmod(F.xxhash64("t.key"), F.ceil(F.col("t.n") / HUB)).alias("cell"))


def confirmed(cells: DataFrame, texts: DataFrame, rows: DataFrame, k: int, similarity: float, tree: bool = False) -> DataFrame:
    """Those pairs of ``cells`` (hub, key, cell) whose texts have that Jaccard similarity, as (a, b).

    ``texts`` (key, md, id) names the row of ``rows`` (md, id, text) that has
    a text. Of a cell the hub is read first and the others stream past it. With
    ``tree`` all texts of a cell are compared with each other and links that
    span what they connect come back.
    """
    firsts = cells.select("hub", "cell").distinct().select("hub", F.col("hub").alias("key"), "cell", F.lit(0).alias("side"))
    members = firsts.union(cells.select("hub", "key", "cell", F.lit(1).alias("side")))
    named = texts.join(members.select("key").distinct(), "key", "left_semi").select("key", "md", "id")
    # a row of ``rows`` may be repeated; keys, join and reduction share one partitioning
    near = rows.withColumn("bucket", _bucket()).join(_buckets(named), "bucket", "left_semi")
    found = near.join(named, ["md", "id"]).dropDuplicates(["md", "id"]).select("key", "text")
    met = members.join(found, "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, keys, sets = None, [], []

        def linked() -> list[tuple[int, int]]:
            return [(keys[i], keys[j]) for i, j in similar_tree(sets, similarity)] if tree and len(keys) > 1 else []

        for batch in (x for whole in batches for x in slices(iter([whole]))):
            out: list[tuple[int, int]] = []
            for hub, key, c, text in zip(*(batch.column(x).to_pylist() for x in ("hub", "key", "cell")), texts_of(batch)):
                own = _shingles(text, k)
                if (hub, c) != cell:
                    out += linked()
                    cell, keys, sets = (hub, c), [key], [own]
                elif tree:
                    keys.append(key)
                    sets.append(own)
                else:
                    common = len(np.intersect1d(sets[0], own, assume_unique=True))
                    if common >= similarity * (len(sets[0]) + len(own) - common):
                        out.append((hub, key))
            yield _links(out)
        yield _links(linked())
        trim()

    return met.repartition("hub", "cell").sortWithinPartitions("hub", "cell", "side", "key").mapInArrow(compare, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], pa.int64()) for j in range(2)], ["a", "b"])


def common_shingles(docs: DataFrame, k: int, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that are frequent in a sample of the different texts, ascending, and their counts.

    The sample is a constant share of a large table: so a shingle counts as
    common from the same number of texts on, whatever the size of the table,
    and the pairs of those that do not grow no faster than the texts. It is
    counted by shingle, in as many tasks as there are; the most frequent ones
    come back, at most ``MOST_COMMON``.
    """
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_TEXTS / max(1, docs.count())))
    hashed = docs.select(F.col(text).alias("text"), F.xxhash64(_normal(text)).alias("key"))
    sample = hashed.where(F.pmod("key", F.lit(1 << 20)) < round(share * (1 << 20))).dropDuplicates(["key"]).select("text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            e, n = np.unique(np.concatenate([_shingles(t, k) for t in texts_of(batch)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)), pa.array(n)], ["e", "n"])
        trim()

    often = sample.mapInArrow(counted, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_TEXTS)
    rows = often.orderBy(F.desc("n"), "e").limit(MOST_COMMON).toArrow()
    e, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("e", "n"))
    e = e.view(np.uint64)
    order = np.argsort(e)
    return e[order], n[order]


def ranks(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The counts of the elements of a set among the common ones, 0 for all others."""
    if not len(common[0]):
        return np.zeros(len(s), dtype=np.int64)
    at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
    return np.where(common[0][at] == s, common[1][at], 0)


def prefix(s: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first elements of a set, common ones last: sets with that Jaccard similarity share one of these.

    Any order that all sets have in common will do; the counts only save work.
    """
    n = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1 if len(s) else 0
    return s[np.lexsort((s, ranks(s, common)))][:n]


def sharing_pairs(element: np.ndarray, key: np.ndarray, root: np.ndarray, size: np.ndarray, at: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of texts of different roots that share a prefix element, as arrays (a, b, size a, size b, at a, at b).

    Left out is what sizes and places rule out: if an element at places i and j
    of their orders is the first that two texts share, they share at most what
    follows. Similar texts keep the first elements that they share.
    """
    order = np.lexsort((key, root, element))
    element, key, root, size, at = (x[order] for x in (element, key, root, size, at))
    if len(key):
        once = np.concatenate(([True], (element[1:] != element[:-1]) | (key[1:] != key[:-1])))
        element, key, root, size, at = (x[once] for x in (element, key, root, size, at))
    n = len(key)
    last = np.flatnonzero(np.concatenate((element[1:] != element[:-1], [True]))) if n else np.zeros(0, dtype=np.int64)
    ends = np.repeat(last + 1, np.diff(np.concatenate(([-1], last))))
    same = np.flatnonzero(np.concatenate(((element[1:] != element[:-1]) | (root[1:] != root[:-1]), [True]))) if n else last
    starts = np.repeat(same + 1, np.diff(np.concatenate(([-1], same))))  # texts of one root need no further link
    many = ends - starts
    rows = np.flatnonzero(many)
    total = np.cumsum(many[rows])
    edges = [0, *(np.flatnonzero(np.diff(total // PAIRS)) + 1), len(rows)] if len(rows) else [0]
    for x, y in zip(edges, edges[1:]):
        part = rows[x:y]
        m = many[part]
        i = np.repeat(part, m)
        j = np.repeat(starts[part] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        i, j = np.where(key[i] < key[j], i, j), np.where(key[i] < key[j], j, i)
        most = np.minimum(size[i] - at[i], size[j] - at[j])
        ok = most * (1 + similarity) >= similarity * (size[i] + size[j]) - 1e-6
        i, j = i[ok], j[ok]
        yield key[i], key[j], size[i], size[j], at[i], at[j]


def _pack(element: np.ndarray, doc: np.ndarray, at: np.ndarray, key: np.ndarray, root: np.ndarray, size: np.ndarray) -> bytes:
    """Elements with their texts and places as bytes, a text's own numbers once; high halves apart, as they are mostly zero."""
    used, own = np.unique(doc, return_inverse=True)
    halves = [np.ascontiguousarray(x.astype("<u4").view("<u2").reshape(-1, 2).T) for x in (own, at, size[used])]
    columns = [np.array([len(used), len(element)], dtype="<i8"), element, key[used], root[used] ^ key[used], *halves]
    return b"".join(x.tobytes() for x in columns)


def _unpack(held: pa.Buffer) -> tuple[np.ndarray, ...]:
    """What ``_pack`` has packed: element, key, root, size and place of each element."""
    texts, n = np.frombuffer(held, dtype="<i8", count=2).tolist()
    place = 16

    def take(count: int, halves: bool = False) -> np.ndarray:
        nonlocal place
        out = np.frombuffer(held, dtype="<u2" if halves else "<i8", count=count * (2 if halves else 1), offset=place)
        place += out.nbytes
        return np.ascontiguousarray(out.reshape(2, -1).T).view("<i4").ravel() if halves else out

    element, key, root = take(n), take(texts), take(texts)
    own, at, size = take(n, True), take(n, True), take(texts, True)
    return element, key[own], (root ^ key)[own], size[own], at


def missed_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``texts`` (key, root, size, prefix) of different roots that can have that similarity, by prefix filtering: none is left out.

    Texts whose prefixes share an element are paired; places and the number of
    shared elements bound what two texts can have in common.
    """
    spark = texts.sparkSession
    elements = texts.agg(F.coalesce(F.sum(F.length("prefix") / 8), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(elements) // TASK_ROWS + 1)
    placed = texts.select("key", "root", "size", "prefix")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for x in range(0, whole.num_rows, 4096):
                key, root, size, held = whole.slice(x, 4096).columns
                key, root, size = (c.to_numpy(zero_copy_only=False) for c in (key, root, size))
                sets = [np.frombuffer(v, dtype=np.uint64) for v in held.to_pylist()]
                n = np.array([len(v) for v in sets], dtype=np.int64)
                if not n.sum():
                    continue
                element = np.concatenate(sets)
                doc, at = np.repeat(np.arange(len(n)), n), np.arange(len(element)) - np.repeat(np.cumsum(n) - n, n)
                part = (element % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                packed = [_pack(element[o], doc[o], at[o], key, root, size) for o in np.split(order, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(part[order][np.concatenate(([0], cuts))]), pa.array(packed, pa.binary())], ["part", "packed"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(x.as_buffer()) for b in batches for x in b.column(1)]
        if not held:
            return
        for found in sharing_pairs(*(np.concatenate(x) for x in zip(*held)), similarity):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "n_a", "n_b", "at_a", "at_b"])
        trim()

    met = placed.mapInArrow(spread, "part long, packed binary").repartition(parts, "part").mapInArrow(compare, "a long, b long, n_a int, n_b int, at_a int, at_b int")
    # the elements that a pair was made of are the first that its texts share; the rest come after the last of these
    shared = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.max("at_a").alias("i"), F.max("at_b").alias("j"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    most = F.col("c") + F.least(F.col("n_a") - F.col("i"), F.col("n_b") - F.col("j")) - 1
    return shared.where(most * (1 + similarity) >= similarity * (F.col("n_a") + F.col("n_b")) - 1e-6).select("a", "b")


def deduplicate(docs: DataFrame, bits: int = 9, shingle: int = 0, verify: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near duplicates: of each group the row with the smallest id stays.

    Texts are linked whose sets of ``verify``-word shingles have a Jaccard
    similarity of ``similarity`` or more; what links connect is a group.
    Fingerprints of the texts' different words (``shingle`` 0) within ``bits``
    propose spanning links, and in every group that these make a link from each
    text to the one with the fewest rare shingles: of copies that were edited
    in different places that is the original. Only links count that the texts
    confirm. What fingerprints miss, as between texts of which one has a passage more,
    is found between the groups so far by prefix filtering (``missed_pairs``)
    and confirmed in the same way, so all links are found. Texts are
    identified by 128 bits of a digest, A-Z lower-cased.

    A null id stays only if its group has no other; of rows repeated with
    their id one stays. Null and empty texts are one group. Column names that
    clash with internal ones are left alone.
    """
    common = common_shingles(docs, verify, text)
    md = F.md5(_normal(text).cast("binary")).alias("md")
    # never null, so that joins and reductions by both share one partitioning
    name = lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("")).alias("id")
    rows = docs.select(md, name(F.col(id_col)), F.col(text).alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            held = texts_of(batch)
            prints = np.array([fingerprint(t, shingle) for t in held], dtype=np.uint64).view(np.int64)
            found = [_shingles(t, verify) for t in held]
            firsts = pa.array([prefix(s, similarity, common).tobytes() for s in found], pa.binary())
            rare = pa.array([int((ranks(s, common) == 0).sum()) for s in found], pa.int32())
            odd = pa.array([parity(s) for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(prints), pa.array([len(s) for s in found], pa.int32()), rare, odd, firsts], ["doc_id", "md", "fp", "size", "rare", "parity", "prefix"])

    id_type = docs.schema[id_col].dataType.simpleString()
    marked = docs.select(F.col(id_col).alias("doc_id"), md, F.col(text).alias("text")).mapInArrow(mark, f"doc_id {id_type}, md string, fp long, size int, rare int, parity binary, prefix binary")
    own = ["fp", "size", "rare", "parity", "prefix"]
    once = marked.groupBy("md").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in own))
    texts = cut(once.select(F.monotonically_increasing_id().alias("key"), "md", "least", name(F.col("least")), "copies", *own))

    # one text stands for each fingerprint; others of the same are linked to it
    prints = cut(texts.groupBy("fp").agg(F.min("key").alias("one")))
    near = links(prints.select("fp"), bits).select("a", "b")
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a").join(prints.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b").select("x", "y")
    same = texts.select("fp", "key").join(prints, "fp").where("key <> one").select("one", "key")
    near = cut(near.union(same).toDF("a", "b"))
    groups = components(near)
    groups = cut(groups)
    middle = groups.join(texts.select(F.col("key").alias("node"), "rare"), "node").groupBy("root").agg(F.min(F.struct("rare", "node")).alias("m"), F.count("*").alias("n")).select("root", F.col("m.node").alias("middle"), "n")
    spokes = with_group(groups, cut(middle)).where("node <> middle").select(F.least("node", "middle").alias("a"), F.greatest("node", "middle").alias("b"))
    proposed = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(spokes).distinct()
    proposed = cut(possible(in_cells(cut(proposed)), texts, similarity))
    roots = components(confirmed(proposed, texts, rows, verify, similarity, tree=True))
    classes = cut(texts.select("key", "least", "size", "prefix").join(roots, F.col("key") == F.col("node"), "left").select("key", "least", "size", "prefix", F.coalesce("root", "key").alias("root")))
    missed = confirmed(cut(possible(in_cells(cut(missed_pairs(classes, similarity))), texts, similarity)), texts, rows, verify, similarity)
    of = classes.select("key", "root")
    across = missed.join(of.toDF("a", "r_a"), "a").join(of.toDF("b", "r_b"), "b").select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))
    more = components(across).withColumnsRenamed({"root": "top"})
    final = classes.select("key", "least", "root").join(more, F.col("root") == F.col("node"), "left").select("key", "least", F.coalesce("top", "root").alias("root"))
    final = cut(final)
    kept = final.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("no"), "least", "key")).alias("k")).select(F.col("k.key").alias("key"))
    stay = texts.join(kept, "key", "left_semi").select("md", "id")
    # only rows in a bucket with a text that has copies, exact or near, have to meet others; all else stays where it is
    # a group's root is one of its texts
    others = final.where("key <> root")
    grouped = others.select("key").union(others.select("root")).union(texts.where("copies > 1").select("key")).distinct()
    some = cut(texts.join(grouped, "key", "left_semi").select(_bucket()).distinct())
    whole = docs.select(md, name(F.col(id_col)), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("bucket", _bucket())
    met = whole.join(F.broadcast(some), "bucket", "left_semi").join(stay, ["md", "id"], "left_semi").dropDuplicates(["md", "id"])
    alone = whole.join(F.broadcast(some), "bucket", "left_anti")
    return alone.select("row").union(met.select("row")).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def _normal(text: str):
    """A text for comparison: no null, A-Z lower-cased."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
