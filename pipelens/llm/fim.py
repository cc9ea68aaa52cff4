"""Fill-in-middle: texts cut into prefix, middle and suffix at units that an automaton finds in parallel.

Units (code points, words, lines) and the marks that a text must not hold are
one deterministic automaton over bytes. A text is scanned in chunks that know
nothing of each other: a chunk emits, for every state it may be entered in, the
state it is left in and how many units and marks start or end in it. These
functions compose associatively, so the entry state and the first unit of every
chunk follow, and a cut is looked for only in the one chunk that holds it.

Within a task the same is done with blocks of ``BLOCK`` bytes: all blocks of a
batch step through the automaton together, once for each state. Texts of more
than ``CHUNK`` bytes are dealt to tasks as chunks; only functions and cuts are
put together in between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipelens.llm.common import cut, forget, fresh, slices

#: Bytes of a chunk, and of the blocks of a chunk that a task steps through together.
CHUNK, BLOCK = 1 << 16, 64
#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The byte that fills blocks up: it changes no state and starts nothing.
PAD = 256
_ADDED = ("n", "form", "prefix_units", "middle_units", "output")

# ---------------------------------------------------------------- automata


def code_points(state: int, byte: int) -> tuple[int, bool]:
    """State: bytes that are still missing of a code point. A stray byte is a unit of its own."""
    if byte & 0xC0 == 0x80:
        return (state - 1, False) if state else (0, True)
    return (0 if byte < 0xC0 or byte >= 0xF8 else 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3), True


def words(state: int, byte: int) -> tuple[int, bool]:
    """A word with the white space behind it; white space at the start of a text belongs to its first word."""
    space = byte == 32 or 9 <= byte <= 13
    if state == 0:  # nothing read yet
        return (3 if space else 1), True
    if state == 3:  # white space at the start
        return (3 if space else 1), False
    return (2 if space else 1), state == 2 and not space


def lines(state: int, byte: int) -> tuple[int, bool]:
    """A line with its newline."""
    return (0 if byte == 10 else 1), state == 0


class Automaton:
    """The product of a unit automaton (state 0 first) and a matcher of ``marks``, with the states that can be reached.

    ``follow[byte, state]`` is the next state; ``weight[byte, state]`` is 1 if
    a unit starts at the byte, plus 2**32 if a mark ends there.
    """

    def __init__(self, unit: Callable[[int, int], tuple[int, bool]], marks: tuple[bytes, ...]):
        self.unit, self.marks = unit, marks

    def _after(self, seen: bytes, byte: int) -> tuple[bytes, bool]:
        """The longest end of what was read that begins a mark, and whether a mark ends here."""
        seen += bytes([byte])
        if any(seen.endswith(m) for m in self.marks):
            return b"", True
        return next(seen[i:] for i in range(len(seen) + 1) if any(m.startswith(seen[i:]) for m in self.marks) or i == len(seen)), False

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        number, waiting, rows = {(0, b""): 0}, [(0, b"")], []
        while waiting:
            state, seen = waiting.pop(0)
            row = []
            for byte in range(256):
                to, starts = self.unit(state, byte)
                after, ends = self._after(seen, byte)
                if (to, after) not in number:
                    number[to, after] = len(number)
                    waiting.append((to, after))
                row.append((number[to, after], int(starts) + (int(ends) << 32)))
            rows.append(row)
        both = np.array(rows, dtype=np.int64).transpose(1, 0, 2)  # byte, state, (next, weight)
        states = np.arange(len(rows))
        return np.vstack((both[:, :, 0], states[None])).astype(np.int32), np.vstack((both[:, :, 1], 0 * states[None]))


class Scan:
    """The blocks of some texts with their functions: ``moves`` and ``weights`` by block and entry state."""

    def __init__(self, automaton: Automaton, texts: list[bytes]):
        follow, weight = automaton.tables
        self.follow, self.weight, self.states = follow, weight, follow.shape[1]
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.n = -(-self.size // BLOCK)
        self.first = np.cumsum(self.n) - self.n
        shift = np.repeat(self.first * BLOCK - (np.cumsum(self.size) - self.size), self.size)
        symbols = np.full(int(self.n.sum()) * BLOCK, PAD, dtype=np.int32)
        symbols[np.arange(len(shift)) + shift] = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.symbols = symbols.reshape(-1, BLOCK)
        self.moves = np.tile(np.arange(self.states, dtype=np.int32), (len(self.symbols), 1))
        self.weights = np.zeros(self.moves.shape, dtype=np.int64)
        flat_follow, flat_weight = follow.ravel(), weight.ravel()
        for j in range(BLOCK):
            at = self.symbols[:, j, None] * self.states + self.moves
            self.weights += flat_weight[at]
            self.moves = flat_follow[at]

    def _by_length(self) -> Iterator[np.ndarray]:
        """For each position of a block, the texts that have one there."""
        order = np.argsort(-self.n, kind="stable")
        falling = -self.n[order]
        for t in range(int(self.n.max(initial=0))):
            yield order[: np.searchsorted(falling, -t)]

    def composed(self) -> tuple[np.ndarray, np.ndarray]:
        """The function of each text: the state it is left in and its weight, by entry state."""
        state = np.tile(np.arange(self.states, dtype=np.int32), (len(self.n), 1))
        total = np.zeros(state.shape, dtype=np.int64)
        for t, at in enumerate(self._by_length()):
            block = (self.first[at] + t)[:, None]
            total[at] += self.weights[block, state[at]]
            state[at] = self.moves[block, state[at]]
        return state, total

    def entered(self, start: np.ndarray) -> np.ndarray:
        """The state that each block is entered in, if the texts are entered in ``start``."""
        state, entry = start.astype(np.int32), np.zeros(len(self.moves), dtype=np.int32)
        for t, at in enumerate(self._by_length()):
            block = self.first[at] + t
            entry[block] = state[at]
            state[at] = self.moves[block, state[at]]
        return entry

    def selected(self, entry: np.ndarray, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The byte at which unit ``k`` (from 0) of a text starts; the text's end, if it has no more than ``k``."""
        units = self.weights[np.arange(len(entry)), entry] & 0xFFFFFFFF
        ends = np.cumsum(units)
        before = np.concatenate(([0], ends))[self.first[text]]
        total = np.concatenate(([0], ends))[self.first[text] + self.n[text]] - before
        out, some = self.size[text].copy(), k < total
        block = np.searchsorted(ends, (before + k)[some], side="right")
        state, left = entry[block], (before + k)[some] - (ends[block] - units[block])
        place = np.full(len(block), -1, dtype=np.int64)
        for j in range(BLOCK):
            symbol = self.symbols[block, j]
            starts = self.weight[symbol, state] & 1
            place[(starts == 1) & (left == 0) & (place < 0)] = j
            left -= starts
            state = self.follow[symbol, state]
        out[some] = (block - self.first[text[some]]) * BLOCK + place
        return out


# ---------------------------------------------------------------- forms


def _forms(n: np.ndarray, marks: np.ndarray, h: np.ndarray, plain: int, spm: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Form, and the units before the middle and before the suffix."""
    a, b = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    form = np.where((n == 0) | (marks > 0) | (h[:, 2] % 100 >= plain), "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm"))
    return form, np.minimum(a, b), np.maximum(a, b)


def _put(text: bytes, form: str, a: int, b: int) -> bytes:
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if form == "plain":
        return text
    if form == "psm":
        return b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return b"".join((s, text[b:], p, text[:a], m, text[a:b]))


def restored(output: Column, form: Column) -> Column:
    """The exact text from output and form.

    No part holds a mark, and a mark's ``<`` comes nowhere else in it, so the
    first three marks of the output are those that were put in.
    """
    parts = F.split(output, "<[PSM]>", -1)
    prefix, suffix = F.when(form == "psm", parts[1]).otherwise(parts[2]), F.when(form == "psm", parts[2]).otherwise(parts[1])
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def _result(form: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, outputs: list[bytes]) -> list[pa.Array]:
    split = form != "plain"
    return [
        pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(a, mask=~split), pa.array(b - a, mask=~split),
        pa.array(outputs, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
    ]


def transform(docs: DataFrame, unit: Callable[[int, int], tuple[int, bool]] = code_points, seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with n (units), form, prefix_units, middle_units and output.

    Two cuts, by the first two of four numbers from a hash of ``seed`` and the
    id, part a text into prefix, middle and suffix. ``psm`` and ``spm`` name
    the order of the output, ``plain`` is the text itself: of empty texts, of
    texts that hold a mark, and of those whose third number modulo 100 is
    ``plain_from`` or more; ``spm`` has a fourth number modulo 100 below
    ``spm_below``.

    A null text counts as empty and a null id as the empty text. Repeated rows
    give repeated rows, an empty table gives none. Columns of ``docs`` that
    have the name of an added one are replaced. The text of one row is put
    together in one task; everything before that is dealt out by chunks.
    """
    automaton = Automaton(unit, tuple(x.encode() for x in (PREFIX, SUFFIX, MIDDLE)))
    automaton.tables  # noqa: B018  built once, here
    rows = docs.drop(*(c for c in docs.columns if c.lower() in _ADDED and c.lower() != text.lower()))
    h, key, part, rest = (fresh(x, rows.columns) for x in ("h", "key", "part", "rest"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = rows.withColumn(text, F.coalesce(text, F.lit(""))).withColumn(h, F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))))
    own, chunk = [c for c in rows.columns if c != h], CHUNK
    large = F.octet_length(text) > chunk
    schema = rows.drop(h).schema.add("n", "long").add("form", "string").add("prefix_units", "long").add("middle_units", "long").add("output", "string")

    def numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
        return np.asarray(batch.column(batch.schema.get_field_index(column)).flatten().to_numpy(), dtype=np.int64).reshape(-1, 4)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, column=text):
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
            scan = Scan(automaton, texts)
            entry = scan.entered(np.zeros(len(texts), dtype=np.int32))
            sums = np.concatenate(([0], np.cumsum(scan.weights[np.arange(len(entry)), entry])))
            total = sums[scan.first + scan.n] - sums[scan.first]
            n = total & 0xFFFFFFFF
            form, a, b = _forms(n, total >> 32, numbers(batch, h), plain_from, spm_below)
            every = np.arange(len(texts))
            at = scan.selected(entry, np.concatenate((every, every)), np.concatenate((a, b))).reshape(2, -1)
            outputs = [_put(t, f, i, j) for t, f, i, j in zip(texts, form.tolist(), at[0].tolist(), at[1].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in own] + _result(form, n, a, b, outputs), schema.names)

    small = rows.where(~large).mapInArrow(whole, schema)

    # texts of many chunks: the numbers of rows and chunks hold once the table is written
    data = F.col(text).cast("binary")
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(text) - 1) / chunk).cast("int")), lambda i: F.struct(i.alias("part"), F.substring(data, i * chunk + 1, F.lit(chunk)).alias("bytes")))
    others = [c for c in own if c != text]
    counted = rows.where(large).withColumn(key, F.monotonically_increasing_id())
    dealt = counted.select(key, F.struct(h, *others).alias(rest), F.explode(cuts).alias(part))
    pieces = cut(dealt.select(F.col(key).alias("key"), F.col(f"{part}.part").alias("part"), F.col(f"{part}.bytes").alias("bytes"), F.when(F.col(f"{part}.part") == 0, F.col(rest)).alias("rest")))

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, column="bytes"):
            scan = Scan(automaton, batch.column(2).cast(pa.large_binary()).to_pylist())
            state, total = scan.composed()
            flat = np.arange(0, state.size + 1, scan.states, dtype=np.int32)
            columns = [batch.column(0), batch.column(1), pa.array(scan.size)]
            columns += [pa.ListArray.from_arrays(flat, x.ravel().astype(np.int64)) for x in (state, total)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "part", "size", "moves", "weights"])

    def resolved(group: pa.Table) -> pa.Table:
        """Entry states by composition from the first chunk on; a row for each cut. A text has at most 2**31 / CHUNK chunks."""
        group = group.sort_by("part")
        moves, weights = group.column("moves").to_pylist(), group.column("weights").to_pylist()
        entry, base, state, total = [], [], 0, 0
        for m, w in zip(moves, weights):
            entry.append(state)
            base.append(total)
            total += w[state]
            state = m[state]
        n, marks = total & 0xFFFFFFFF, total >> 32
        numbered = np.array([group.column("h")[0].as_py()], dtype=np.int64)
        form, a, b = _forms(np.array([n]), np.array([marks]), numbered, plain_from, spm_below)
        starts = np.array(base, dtype=np.int64) & 0xFFFFFFFF
        out = []
        for k in (int(a[0]), int(b[0])):
            at = int(np.searchsorted(starts, k, side="right")) - 1 if k < n else len(base) - 1
            out.append({"key": group.column("key")[0].as_py(), "n": n, "form": str(form[0]), "a": int(a[0]), "b": int(b[0]), "k": k, "part": at, "entry": entry[at], "left": k - int(starts[at])})
        return pa.Table.from_pylist(out, _SOUGHT)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="bytes"):
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            scan = Scan(automaton, get("bytes").cast(pa.large_binary()).to_pylist())
            entry = scan.entered(get("entry").to_numpy())
            place = scan.selected(entry, np.arange(batch.num_rows), get("left").to_numpy()) + get("part").to_numpy().astype(np.int64) * chunk
            yield pa.RecordBatch.from_arrays([get(c) for c in ("key", "n", "form", "a", "b", "k")] + [pa.array(place)], ["key", "n", "form", "a", "b", "k", "place"])

    def assembled(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        row = {c: group.column(c)[0].as_py() for c in ("key", "n", "form", "a", "b", "from", "to")}
        whole_text = b"".join(group.column("bytes").to_pylist())
        output = _put(whole_text, row["form"], row["from"], row["to"])
        arrays = _result(np.array([row["form"]]), np.array([row["n"]]), np.array([row["a"]]), np.array([row["b"]]), [output])
        return pa.Table.from_arrays([pa.array([row["key"]], pa.int64()), pa.array([whole_text], pa.binary()).cast(pa.string()), *arrays], ["key", "whole", *_ADDED])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_chunks = pieces.select("key", "part", "bytes").repartition(parts, "key", "part").mapInArrow(functions, "key long, part int, size long, moves array<long>, weights array<long>")
    numbered = pieces.where("part = 0").select("key", F.col(f"rest.{h}").alias("h"))
    sought = of_chunks.join(numbered, "key").groupBy("key").applyInArrow(resolved, "key long, n long, form string, a long, b long, k long, part int, entry int, left long")
    places = sought.join(pieces.select("key", "part", "bytes"), ["key", "part"]).mapInArrow(found, "key long, n long, form string, a long, b long, k long, place long")
    plan = places.groupBy("key", "n", "form", "a", "b").agg(F.min("place").alias("from"), F.max("place").alias("to"))
    out = pieces.select("key", "part", "bytes").join(plan, "key").groupBy("key").applyInArrow(assembled, "key long, whole string, n long, form string, prefix_units long, middle_units long, output string")
    back = pieces.where("part = 0").select(F.col("key").alias(key), F.col("rest").alias(rest)).join(out.withColumnRenamed("key", key), key)
    return small.unionByName(back.select(*(F.col(rest).getField(c).alias(c) if c != text else F.col("whole").alias(text) for c in own), *_ADDED))


_SOUGHT = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("k", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("left", pa.int64())])
