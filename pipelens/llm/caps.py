"""Near duplicates of embeddings by spherical-cap filters.

A filter is a direction, and holds the vectors whose cosine with it exceeds
``height``. Directions are random product codes: after a random rotation (sign
flips and Hadamard transforms) the space is parted into blocks, each with unit
code vectors of its own, and every choice of one from each block is a
direction. A vector is list-decoded to all directions that it exceeds, block by
block, dropping partial choices that the best remaining ones cannot lift above
the height; it never looks at all directions.

The height follows from the number of vectors, so that a filter holds about
``MEMBERS`` of them, and the number of directions from the chance that both
vectors of a pair at the threshold exceed one: ``COMMON`` are expected. The
directions of one code hang together, so they are spread over ``TURNS``
rotations with codes of their own; of simulated pairs at the threshold less
than one in a thousand shares none, of closer ones far fewer. Pairs that meet are verified in double precision. They are
counted in the first filter that both have and nowhere else, so neither pairs
nor links are emitted: a cell of a filter gives sums and a spanning forest.

Equal vectors are one with a multiplicity. Filters of more than ``CELL`` rows
are parted into blocks, and pairs of blocks meet in cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipelens.llm.ann import dots, matrix
from pipelens.llm.common import cut, forget, trim
from pipelens.llm.simhash import components

#: Directions that a pair at the threshold shares, expected, and rotations that they come from.
COMMON, TURNS = 20, 16
#: Vectors of a filter, about; rows of a block of a filter, about; rows of a task.
MEMBERS, CELL, TASK_ROWS = 64, 2048, 1 << 17
#: Code vectors of a block, at most; the number of blocks follows.
CODES = 1 << 14


# ---------------------------------------------------------------- filters


def share(height: float, angle: float, dim: int) -> float:
    """Of all directions, the share that two vectors at ``angle`` both exceed by ``height`` (0: one vector)."""
    r = np.linspace(max(height, 1e-9), 1.0, 4001)
    y = r * np.power(np.clip(1 - r * r, 0, None), (dim - 4) / 2) * np.clip(2 * np.arccos(np.clip(height / r, -1, 1)) - angle, 0, None)
    return (dim - 2) / (2 * pi) * float(np.sum((y[1:] + y[:-1]) / 2 * np.diff(r)))


class Filters:
    """The directions for ``n`` vectors of ``dim`` components and pairs of a cosine of ``similarity`` or more."""

    def __init__(self, n: int, dim: int, similarity: float, seed: int = 13):
        self.dim, self.room = dim, 16
        while self.room < dim:
            self.room *= 2
        aim, low, high = min(0.1, MEMBERS / max(n, 1)), 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if share(middle, 0.0, self.room) > aim else (low, middle)
        self.height = low
        count = COMMON / TURNS / share(self.height, acos(min(1.0, similarity)), self.room)
        self.blocks = 2
        while count ** (1 / self.blocks) > CODES and self.blocks < self.room // 4:
            self.blocks *= 2
        self.codes = ceil(count ** (1 / self.blocks))
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], size=(TURNS, 3, self.room))
        code = rng.standard_normal((TURNS, self.blocks, self.codes, self.room // self.blocks))
        self.code = code / np.sqrt((code * code).sum(axis=3, keepdims=True))

    def rotated(self, rows: np.ndarray, turn: int) -> np.ndarray:
        out = np.zeros((len(rows), self.room))
        out[:, : self.dim] = rows
        for signs in self.signs[turn]:
            out *= signs
            width = 1
            while width < self.room:
                parts = out.reshape(len(rows), -1, 2, width)
                out = np.stack((parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]), axis=2).reshape(len(rows), self.room)
                width *= 2
            out /= np.sqrt(self.room)
        return out

    def decoded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) for all directions that the unit vectors exceed, by row and direction."""
        found = [self._decoded(unit, turn) for turn in range(TURNS)]
        row, code = np.concatenate([r for r, _ in found]), np.concatenate([c + turn * self.codes**self.blocks for turn, (_, c) in enumerate(found)])
        by = np.lexsort((code, row))
        return row[by], code[by]

    def _decoded(self, unit: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        n, b = len(unit), self.codes
        turned = self.rotated(unit, turn).reshape(n, self.blocks, -1)
        scores = np.einsum("nmd,mbd->nmb", turned, self.code[turn], optimize=True)
        need = self.height * np.sqrt(self.blocks)
        best = scores.max(axis=2)
        rest = np.cumsum(best[:, ::-1], axis=1)[:, ::-1] - best  # what the blocks behind can add
        row, code, total = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n)
        for m in range(self.blocks):
            order = np.argsort(-scores[:, m], axis=1)
            falling = np.take_along_axis(scores[:, m], order, axis=1)
            # codes of a block lie in falling order: those that can still exceed come first
            asked = need - total - rest[row, m]
            keys = (np.arange(n)[:, None] * 4.0 - falling).ravel()
            many = np.clip(np.searchsorted(keys, row * 4.0 - np.clip(asked, -1.5, 1.5), side="right") - row * b, 0, b)
            at = np.repeat(np.arange(len(row)), many)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            row, code, total = row[at], code[at] * b + order[row[at], nth], total[at] + falling[row[at], nth]
        some = total >= need
        return row[some], code[some]


def _units(column: pa.Array, dim: int) -> np.ndarray:
    rows = matrix(column, dim).astype(np.float64)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


# ---------------------------------------------------------------- cells


def _linked(rows: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of rows whose cosine is ``similarity`` or more, in double precision; near the threshold by sums from the first component to the last."""
    norm = np.sqrt(dots(rows, rows))
    unit = rows / norm[:, None]
    for lo in range(0, len(rows), 256):
        about = unit[lo : lo + 256] @ unit[lo:].T
        i, j = np.nonzero(about >= similarity - 1e-9)
        near = about[i, j] < similarity + 1e-9
        i, j = i + lo, j + lo
        some = i < j
        i, j, near = i[some], j[some], near[some]
        keep = np.ones(len(i), dtype=bool)
        keep[near] = dots(rows[i[near]], rows[j[near]]) / (norm[i[near]] * norm[j[near]]) >= similarity
        yield i[keep], j[keep]


def _rooted(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that links reach, for each of ``n``."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        after = root.copy()
        for end in (i, j, root[i], root[j]):
            np.minimum.at(after, end, least)
        while (after[after] != after).any():
            after = after[after]
        if (after == root).all():
            return root
        root = after


def _cell(node: np.ndarray, many: np.ndarray, block: np.ndarray, earlier: pa.Array, rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors of a cell: nodes and the links they have first here, edges that span these."""
    # of each vector the filters before this one, as bits; only those that two have
    flat = pc.list_flatten(earlier).to_numpy()
    sizes = np.diff(earlier.offsets.to_numpy())
    names, which, held = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(held > 1) - 1
    some = held[which] > 1
    bits = np.zeros((len(node), -(-int((held > 1).sum()) // 8)), dtype=np.uint8)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(node)), sizes)[some], place[which[some]] // 8), (1 << (place[which[some]] % 8)).astype(np.uint8))
    count, from_, to = np.zeros(len(node), dtype=np.int64), [], []
    for i, j in _linked(rows, similarity):
        if block.any():  # a cell of two blocks: only pairs between them
            i, j = i[block[i] != block[j]], j[block[i] != block[j]]
        for lo in range(0, len(i), 1 << 16):
            a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
            first = ~(bits[a] & bits[b]).any(axis=1)
            a, b = a[first], b[first]
            np.add.at(count, a, many[b])
            np.add.at(count, b, many[a])
            from_.append(a)
            to.append(b)
        if sum(map(len, from_)) > 1 << 20:  # a forest holds as much
            root = _rooted(len(node), np.concatenate(from_), np.concatenate(to))
            from_, to = [np.flatnonzero(root != np.arange(len(node)))], [root[root != np.arange(len(node))]]
    root = _rooted(len(node), np.concatenate(from_), np.concatenate(to)) if from_ else np.arange(len(node))
    tied = np.flatnonzero(root != np.arange(len(node)))
    return np.flatnonzero(count), count[count > 0], tied, root[tied]


def links(vectors: DataFrame, similarity: float, dim: int, most: int) -> DataFrame:
    """(a, b, n) of a table (node, label, many, v): sums n of links of a (b null), and edges a-b that span all links (n null).

    ``node`` is different in every row, ``many`` the weight of a vector as a
    partner; ``most`` is the largest number of rows of a label.
    """
    spark = vectors.sparkSession
    filters = Filters(most, dim, similarity)
    label, kind = vectors.schema["label"].dataType, vectors.schema["v"].dataType
    spread = T.StructType([T.StructField("label", label), T.StructField("filter", T.LongType()), T.StructField("node", T.LongType()), T.StructField("many", T.LongType()), T.StructField("earlier", T.ArrayType(T.LongType())), T.StructField("v", kind)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                v = batch.column(batch.schema.get_field_index("v"))
                row, code = filters.decoded(_units(v, dim))
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                ends = np.concatenate(([0], np.cumsum(nth)))
                at = np.arange(ends[-1]) - np.repeat(ends[:-1], nth) + np.repeat(np.arange(len(row)) - nth, nth)
                taken = pa.array(row)
                get = lambda name: batch.column(batch.schema.get_field_index(name)).take(taken)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([get("label"), pa.array(code), get("node"), get("many"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(code[at])), v.take(taken)], spread.names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # sorted, so that a task that runs again decodes the same batches to the same last bit
    rows = vectors.select("label", "node", "many", "v").repartition(parts, "node").sortWithinPartitions("node").mapInArrow(decode, spread)
    # filters with more than CELL rows: at most one for every CELL rows
    hot = rows.groupBy("label", "filter").count().where(F.col("count") > CELL).select(F.col("label").alias("hot_label"), F.col("filter").alias("hot_filter"), F.ceil(F.col("count") / CELL).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.when(F.col("blocks") > 1, F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(hot, (F.col("label") == F.col("hot_label")) & (F.col("filter") == F.col("hot_filter")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # block: which of the two blocks of a cell, 0 for all rows of a cell of one
    dealt = dealt.select("label", "filter", F.explode(cells).alias("pair"), "node", "many", "earlier", "v", own.alias("own"), "blocks")
    dealt = dealt.withColumn("block", F.when(F.floor(F.col("pair") / F.col("blocks")) == F.col("pair") % F.col("blocks"), 0).otherwise(F.col("own") + 1)).drop("own", "blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            if table.num_rows < 2:
                return
            get = lambda name: table.column(name).combine_chunks()
            node = get("node").to_numpy()
            a, n, tied, root = _cell(node, get("many").to_numpy(), get("block").to_numpy(), get("earlier"), matrix(get("v"), dim).astype(np.float64), similarity)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node[a], node[tied]))), pa.array(np.concatenate((np.zeros(len(a), dtype=np.int64), node[root])), mask=np.arange(len(a) + len(tied)) < len(a)), pa.array(np.concatenate((n, np.zeros(len(tied), dtype=np.int64))), mask=np.arange(len(a) + len(tied)) >= len(a))], ["a", "b", "n"])

        key = None
        for batch in batches:  # rows come by cell
            names = [batch.schema.get_field_index(c) for c in ("label", "filter", "pair")]
            code, f, p = pc.dictionary_encode(batch.column(names[0])).indices.to_numpy(), batch.column(names[1]).to_numpy(), batch.column(names[2]).to_numpy()
            edges = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (f[1:] != f[:-1]) | (p[1:] != p[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                now = (batch.column(names[0])[lo].as_py(), int(f[lo]), int(p[lo]))
                if held and now != key:
                    yield from done()
                key = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done()
        trim()

    tasks = max(parts, 2 * COMMON * vectors.count() // TASK_ROWS + 1)
    met = dealt.repartition(tasks, "label", "filter", "pair").sortWithinPartitions("label", "filter", "pair")
    return met.mapInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, similarity: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row for each row of ``vectors``: vec_id, label, n_links, component_id and kept.

    Rows of equal label, not null, are linked where they are found to have a
    cosine of ``similarity`` or more; none below it is. n_links counts other
    rows, copies each; component_id is the smallest id that links reach, the
    row's own included; kept rows have it as their id. A null label, a null
    vector, a zero one, one with null or non-finite components and one of
    another length than most usable ones (of lengths equally frequent the
    longer) have no links. Repeated ids are rows of their own. A null id takes
    no part in the smallest, and is not kept.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    held = rows.withColumn("usable", usable)
    counted = held.where("usable").groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    alone = held.select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = (F.col("vec_id") == F.col("component_id")) & F.col("vec_id").isNotNull()
    if not counted:
        return alone.withColumn("kept", F.coalesce(kept, F.lit(False)))
    dim = counted["dim"]
    fits = F.col("usable") & (F.size("v") == dim)
    # adding zero makes minus zero zero, so equal vectors are equal bytes
    same = held.where(fits).withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast("float" if single else "double")))
    distinct = same.groupBy("label", "v").agg(F.count("*").alias("many"), F.min("vec_id").alias("least"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()))  # numbers hold once the table is written
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0]
    found = cut(links(nodes, similarity, dim, most))
    sums = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("partners"))
    roots = components(found.where("b is not null").select("a", "b"))
    placed = nodes.join(sums, nodes.node == sums.a, "left").drop("a").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    placed = placed.select("label", "v", "least", (F.coalesce("partners", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(ids, "root").select(F.col("label").alias("l"), F.col("v").alias("w"), "n_links", "component_id")
    back = same.join(named, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("vec_id", "label", "n_links", "component_id")
    rest = held.where(~F.coalesce(fits, F.lit(False))).select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return back.union(rest).withColumn("kept", F.coalesce(kept, F.lit(False)))
