"""Nearest neighbours by cosine: a block matrix join of int8 product tiles with error bounds.

Vectors are scaled to unit length and rounded to int8 with a scale of their
own. The product of two rounded vectors, exact in integers, is off the true
cosine by at most a bound that follows from the measured rounding errors of
both. A tile of candidates against a block of queries is one matrix product;
a pair survives if its upper bound reaches the query's k-th best lower bound of
the tile, its own rows left out, and its k-th best score so far. Survivors are
computed again in double precision. Per cell and query a heap of the k best is
kept; the heaps of all cells are merged in the end. Nothing that could belong
to the answer is dropped, so the answer is exact.

The cells of the join are (part of the candidates, block of the queries): both
sides are dealt to them by key, nothing goes through the driver, and a task
reads its queries first and then streams candidates past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block, about, and candidates of a part, at most about.
QUERY_BLOCK, PART_ROWS = 1 << 14, 1 << 19
#: Queries and candidates of a product tile.
TILE_QUERIES, TILE_ROWS = 2048, 1024
#: Pairs that are computed again at a time.
PAIRS = 1 << 16


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` doubles, each times the power of two that brings its largest component to 0.5 at least.

    Cosines stay the same to the last bit, and no square or product of large
    or small components leaves the range of doubles.
    """
    rows = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products, summed from the first component to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows of the unit vectors, scale, and length and rounding error of the rounded vectors."""
    peak = np.maximum(np.abs(rows).max(axis=1, initial=0), 1e-300)[:, None]
    unit = rows / peak
    unit = unit / np.maximum(np.sqrt(np.einsum("ij,ij->i", unit, unit)), 1e-300)[:, None]
    scale = np.maximum(np.abs(unit).max(axis=1), 1e-300) / 127.0
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    back = whole * scale[:, None]
    return whole, scale, np.sqrt(np.einsum("ij,ij->i", back, back)), np.sqrt(np.einsum("ij,ij->i", unit - back, unit - back))


class Block:
    """Vectors with their rounded forms."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        whole, self.scale, self.length, self.error = quantised(rows)
        # integers below 2**24 for up to 1040 dimensions: exact in single precision; else in double
        self.whole = whole.astype(np.float32 if rows.shape[1] <= 1040 else np.float64)
        self.norm = np.sqrt(dots(rows, rows))


def survivors(q: Block, c: Block, at: slice, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query of ``at``, candidate) that can still be among the k best; ``worst`` has the queries' k-th scores so far."""
    about = (q.whole[at] @ c.whole.T).astype(np.float64) * q.scale[at, None] * c.scale
    # |q.c - q'.c'| <= |q| |c - c'| + |q - q'| |c'|, and a little for rounding in doubles
    error = (1.0 + 1e-9) * c.error + q.error[at, None] * c.length + 1e-9
    about[q.ids[at, None] == c.ids] = -np.inf
    floor = worst
    if len(c.ids) >= k:
        lower = about - error
        floor = np.maximum(floor, np.partition(lower, len(c.ids) - k, axis=1)[:, len(c.ids) - k])
    return np.nonzero((about + error >= floor[:, None]) & (about > -np.inf))


class Heaps:
    """The k best (score, id) of every query; ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        """Merge pairs in: for the queries concerned, old and new are sorted together and the first k stay."""
        if not len(query):
            return
        touched = np.unique(query)
        q = np.concatenate((query, np.repeat(touched, self.k)))
        s = np.concatenate((score, self.score[touched].ravel()))
        v = np.concatenate((vec, self.id[touched].ravel()))
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        first = np.searchsorted(q, touched)
        at = first[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = s[at], v[at]


def _search(dim: int, k: int):
    def block_of(table: pa.Table) -> Block:
        return Block(table.column("vec_id").to_numpy(), matrix(table.column("v").combine_chunks(), dim))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, asked, heaps = None, [], None, None

        def best() -> pa.RecordBatch:
            q, j = np.nonzero(np.isfinite(heaps.score))
            return pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(heaps.id[q, j]), pa.array(heaps.score[q, j])], ["query_id", "vec_id", "score"])

        for batch in batches:
            # rows come by cell, in each the queries first
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if key[a] // 2 != cell:
                    if heaps is not None:
                        yield best()
                    cell, queries, asked, heaps = key[a] // 2, [], None, None
                if key[a] % 2 == 0:
                    queries.append(batch.slice(a, b - a))
                    continue
                if not queries:
                    continue
                if asked is None:
                    asked = block_of(pa.Table.from_batches(queries))
                    heaps = Heaps(len(asked.ids), k)
                for lo in range(a, b, TILE_ROWS):
                    tile = block_of(pa.Table.from_batches([batch.slice(lo, min(TILE_ROWS, b - lo))]))
                    for first in range(0, len(asked.ids), TILE_QUERIES):
                        at = slice(first, first + TILE_QUERIES)
                        q_at, c_at = survivors(asked, tile, at, heaps.score[at, -1], k)
                        for x in range(0, len(q_at), PAIRS):
                            q, c = q_at[x : x + PAIRS] + first, c_at[x : x + PAIRS]
                            heaps.add(q, dots(asked.rows[q], tile.rows[c]) / (asked.norm[q] * tile.norm[c]), tile.ids[c])
        if heaps is not None:
            yield best()

    return search


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of every row that the condition ``is_query`` marks: query_id, rank, vec_id, score.

    Score is the cosine in double precision of the original vectors; ties go
    to the smaller id, and fewer than k candidates give as many rows. Rows
    with the query's own id are not its candidates. Null ids take no part, nor
    do vectors that are null, zero, hold null or non-finite components, or are
    of another length than most that have none of these (of lengths equally
    frequent the longer counts). Rows that repeat an id are candidates of
    their own; of queries that do, one (the greatest vector) counts. No query
    gives no row.
    """
    spark = vectors.sparkSession
    asks = F.lit(is_query) if isinstance(is_query, bool) else is_query
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(asks, F.lit(False)).alias("q"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    usable = rows.where(F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    counted = usable.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("q").alias("q")).orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if not counted or not counted["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, n_queries = counted
    usable = usable.where(F.size("v") == dim)
    blocks = -(-n_queries // QUERY_BLOCK)
    # as many parts as there are tasks to fill, but none of a few rows, and none above PART_ROWS
    parts = max(-(-n // PART_ROWS), min(-(-n // (4 * TILE_ROWS)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = usable.where("q").groupBy("vec_id").agg(F.max("v").alias("v"))
    queries = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), every(parts).alias("part"), F.lit(0).alias("side"))
    # in turn, so that neither a hot id nor a hot vector makes a large part
    candidates = usable.select("vec_id", "v", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("part"))
    candidates = candidates.select("vec_id", "v", every(blocks).alias("block"), "part", F.lit(1).alias("side"))
    cell = (F.col("part") * blocks + F.col("block")).cast("long").alias("cell")
    met = queries.select(cell, "side", "vec_id", "v").union(candidates.select(cell, "side", "vec_id", "v"))
    found = met.repartition(parts * blocks, "cell").sortWithinPartitions("cell", "side").mapInArrow(_search(dim, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
