"""Which sources of a language use other words than the language, and than each other.

Terms are counted once, by (lang, source); a language keeps the terms that
enough of its documents have. Probabilities are whole numbers, so every value
is exact.

* Pairs of sources come from postings: the terms that two sources share meet in
  their term's list, where a task adds them up by pair. What only one of the two
  has follows from how many of its terms have which probability, and the terms
  that neither has from the number of kept terms.
* The terms that set a group apart come from a search by upper bounds: a group's
  terms are parted by count, and a bucket's largest probability in the group
  with its smallest in the language bounds what any of its terms can reach.
  Buckets are evaluated best bound first, until every bound that is left is
  strictly below the group's ``k``-th value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelens.llm.common import cut, forget, slices, trim, vocabulary

#: Buckets of counts for each doubling, and buckets that the first round evaluates of each group; every round takes twice as many.
STEPS, FIRST = 4, 4
#: Rows of postings that a task takes at a time, at least, and sums of pairs that it holds, at most about.
ROWS, SUMS = 1 << 16, 1 << 20
#: A-Z as a-z, other letters and what is not ASCII as they are, the rest as spaces.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in slices(batches, 1 << 23):
        joined = [b" ".join((t or b"").translate(_LETTERS).split()) for t in batch.column(2).cast(pa.large_binary()).to_pylist()]
        names, code, doc = vocabulary(joined, ascending=False)
        if not names:
            continue
        langs, sources = (batch.column(i).dictionary_encode() for i in (0, 1))
        pairs, group = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
        width = len(names)
        cell, n = np.unique(group[doc] * width + code, return_counts=True)
        once = np.unique(doc * width + code)
        _, docs = np.unique(group[once // width] * width + once % width, return_counts=True)
        of = pairs[cell // width]
        yield pa.RecordBatch.from_arrays([
            langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))),
            pa.array(names, pa.binary()).take(pa.array(cell % width)).cast(pa.string()), pa.array(n), pa.array(docs),
        ], ["lang", "source", "term", "n", "docs"])
    trim()


def kept_terms(docs: DataFrame, least: int = 10) -> DataFrame:
    """(lang, source, term, n, all, first): occurrences in the group and in the language of the terms that ``least`` documents of the language have; first marks one row of each."""
    counted = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    each = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    rows = each.select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("all"), (F.min("source").over(term) == F.col("source")).alias("first"))
    return rows.where(F.col("docs") >= least).drop("docs")


def probability(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10**9 (count + 2) / (n + 2 v)), without rounding; null if there are no terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    numerator, denominator = whole(count + 2) * F.lit(1_000_000_000).cast("decimal(10,0)"), whole(n + 2 * v)
    return F.when(v > 0, F.call_function("div", numerator, denominator) + 1)


def value(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)) of whole numbers below 2**31."""
    p, q = p.cast("long"), q.cast("long")
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _shared(rows: int, most: int):
    """Of postings (lang, term, source, p, zero), by lang and term: (lang, a, b, value), what shared terms add to the pair of a < b."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: list[pa.RecordBatch] = []
        sums: dict[tuple[str, str, str], int] = {}

        def add(table: pa.Table) -> None:
            table = table.combine_chunks()
            lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
            langs, names = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            by_name = np.argsort(np.argsort(np.array([x.encode() for x in names], dtype=object)))
            own, code = lang.indices.to_numpy().astype(np.int64), by_name[source.indices.to_numpy()].astype(np.int64)
            in_order = sorted(names, key=lambda x: x.encode())
            term = np.cumsum(np.concatenate(([0], _changes(table))))
            p, zero = table.column("p").to_numpy(), table.column("zero").to_numpy()
            i = np.arange(len(term))
            step = 0
            while True:  # rows a step apart in the same list, a step more each time
                step += 1
                i = i[i + step < len(term)]
                i = i[term[i] == term[i + step]]
                if not len(i):
                    return
                j = i + step
                a, b = np.where(code[i] < code[j], i, j), np.where(code[i] < code[j], j, i)
                gain = _f(p[a], p[b]) - _f(p[a], zero[b]) - _f(zero[a], p[b]) + _f(zero[a], zero[b])
                pair, at = np.unique((own[a] * len(names) + code[a]) * len(names) + code[b], return_inverse=True)
                total = np.zeros(len(pair), dtype=np.int64)
                np.add.at(total, at, gain)
                for x, t in zip(pair.tolist(), total.tolist()):
                    key = (langs[x // len(names) ** 2], in_order[x // len(names) % len(names)], in_order[x % len(names)])
                    sums[key] = sums.get(key, 0) + t

        def emit() -> pa.RecordBatch:
            found = [(*k, t) for k, t in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["lang", "a", "b", "value"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held).combine_chunks()
                ends = np.flatnonzero(_changes(table)) + 1
                if len(ends):  # the last list may go on
                    add(table.slice(0, int(ends[-1])))
                    held = table.slice(int(ends[-1])).to_batches()
                if len(sums) > most:
                    yield emit()
        if held:
            add(pa.Table.from_batches(held))
        if sums:
            yield emit()
        trim()

    return shared


def _changes(table: pa.Table) -> np.ndarray:
    """Where a row's lang or term differs from the row's before."""
    codes = [table.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term")]
    return (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])


def pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways round."""
    tasks = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    postings = kept.select("lang", "term", "source", "p", "zero").repartition(tasks, "lang", "term").sortWithinPartitions("lang", "term")
    both = postings.mapInArrow(_shared(ROWS, SUMS), "lang string, a string, b string, value long")
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    # neither has the term, for all kept terms; corrected where a source has it
    neither = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", F.coalesce(F.col("v") * value(F.col("zero"), F.col("other_zero")), F.lit(0)).alias("value"))
    alike = kept.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("m"))
    gain = F.col("m") * (value(F.col("p"), F.col("other_zero")) - value(F.col("zero"), F.col("other_zero")))
    one = alike.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(gain).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    shared = both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    parts = neither.union(one).union(turned(one)).union(shared).union(turned(shared))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def distinctive_terms(kept: DataFrame, k: int = 10) -> DataFrame:
    """(lang, source, term, value, rank) of each group's ``k`` terms of greatest value that are likelier in it than in the language."""
    above = kept.where("p > q").select("lang", "source", "term", "p", "q", F.floor(F.log2("n") * STEPS).cast("int").alias("bucket"))
    group = Window.partitionBy("lang", "source")
    bounds = above.groupBy("lang", "source", "bucket").agg(value(F.max("p"), F.min("q")).alias("bound"))
    # a group has at most STEPS buckets for each doubling of a count
    waiting = cut(bounds.withColumn("nth", F.row_number().over(group.orderBy(F.col("bound").desc(), "bucket"))))
    best, limit = None, FIRST
    while waiting.take(1):
        chosen = waiting.where(F.col("nth") <= limit).select("lang", "source", "bucket")
        found = above.join(chosen, ["lang", "source", "bucket"]).select("lang", "source", "term", value(F.col("p"), F.col("q")).alias("value"))
        found = found if best is None else found.union(best.drop("rank"))
        best = cut(found.withColumn("rank", F.row_number().over(group.orderBy(F.col("value").desc(), "term"))).where(F.col("rank") <= k))
        least = best.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("least"))
        left = waiting.where(F.col("nth") > limit).join(least, ["lang", "source"], "left")
        waiting = cut(left.where(F.col("bound") >= F.coalesce("least", F.lit(0))).drop("least"))
        limit *= 2
    if best is None:
        return above.select("lang", "source", "term", F.lit(0).cast("long").alias("value"), F.lit(0).alias("rank")).limit(0)
    return best


def audit(docs: DataFrame, least: int = 10, k: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group of ``docs``.

    Part ``pair`` has all other sources of the language as items, part ``term``
    the group's ``k`` most distinctive terms. Terms are runs of ASCII letters
    and of what is not ASCII, A-Z lower-cased. Nulls in any of the three
    columns count as the empty text; a group without kept terms has pairs and
    no terms; in a language without kept terms all pairs have the value 0.
    Ties go to the item that is first in UTF-8. Repeated rows are documents of
    their own, other columns play no part, and an empty table gives no row.
    """
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))))
    kept = cut(kept_terms(own, least))
    by_lang = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("lang_n"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = own.select("lang", "source").distinct().join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left").na.fill(0, ["v", "lang_n", "n"])
    groups = cut(groups.withColumn("zero", probability(F.lit(0), F.col("n"), F.col("v"))))
    of = groups.select("lang", "source", "v", "lang_n", F.col("n").alias("group_n"), "zero")
    kept = kept.join(of, ["lang", "source"]).select("lang", "source", "term", "n", "zero", probability(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), probability(F.col("all"), F.col("lang_n"), F.col("v")).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = pairs(kept, groups).withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    term = distinctive_terms(kept, k).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pair.union(term)
