"""Deduplication of repeated passages with a logarithmic family of sparse suffix arrays.

A symbol goes where a run of ``length`` symbols around it also starts anywhere else. Symbols are the bytes of a text
or its words (``[^\\x20\\x09-\\x0D]+``, verbatim); figures below are those for bytes.

Sparse suffixes. Among the 32-byte strings of every window of 400 bytes, the one with the least hash (the
leftmost of equals) is the window's anchor; equal windows have their anchors at equal places, so suffixes need be
indexed at anchors only. Windows of one anchor are split in two by where the anchor stands, so that all windows
of an entry share at least 216 bytes with it: an entry is (key: fingerprint of those bytes; context: fingerprint
of all bytes its windows cover; n: how often it was met; doc and first: one place where it stands). Words have
anchors of 8 in windows of 50; few of these stand twice by chance, so the anchor alone is the key.

Suffix arrays. They are sparse, and sorted by (key, context), not by the bytes themselves: any order does in which
suffixes that share 216 bytes stand together. Each task sorts the entries of its shard and joins equal ones; the
batch's array is dealt out by ranges of (key, context), so that a key with very many contexts goes to several tasks.

Index family. A new batch's array is merged with those of all levels in one sorted scan: entries that fall
together are long matches as a whole, and neighbours that share a key only are matches of at least 216 bytes
whose extent is settled on the bytes. Then levels of equal size merge, so that n batches leave at most log2(n) levels.

Edge cases: null and empty texts have no symbols; texts under ``length`` symbols keep all; rows repeated in full are
documents of their own and remove each other; rows that share a doc_id are told apart by their text; texts of any
length are taken in overlapping pieces; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import Workspace, ship, sweep

LENGTH = 400
#: Symbols of a text that are indexed at once. A symbol takes some hundred bytes meanwhile.
PIECE = 1 << 18
#: Entries that a task sorts at once.
SHARD = 1 << 18
BATCHES = 4
#: Contexts of one key beyond which its windows are counted one by one, over all tasks, instead of together in one.
HOT = 2048
#: Entries or keys with over this share of all rows are marked by a broadcast, of at most as many rows as its inverse.
HOT_SHARE = 1000
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Unit:
    """What texts are sequences of: the length of a repeated run, that of an anchor, and the bytes of a symbol's code.

    ``sides``: whether the windows of an anchor are split in two, so that more than the anchor is shared.
    """

    name: str
    length: int
    sample: int
    code: int
    sides: bool
    seed: int

    @property
    def window(self) -> int:
        return self.length - self.sample + 1

    @property
    def half(self) -> int:
        return self.window // 2


BYTES = Unit("bytes", LENGTH, 32, 1, True, 0)
WORDS = Unit("words", 50, 8, 8, False, 2)


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES, _BYTES2 = _table(11), _table(12)
_BASE, _BASE2 = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LETTERS = np.where(_SPACE, np.uint64(0), _BYTES)


def rolling(data: np.ndarray, length: int, table: np.ndarray | None = _BYTES, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of each run of ``length`` symbols, by doubling; runs of powers of two are joined."""
    if data.size < length:
        return np.empty(0, np.uint64)
    n = data.size - length + 1
    step, have, out, done, power = 1, data if table is None else table[data], None, 0, int(base)
    while step <= length:
        times = np.uint64(power)
        if length & step:
            part = have[done : done + n]
            out = part.copy() if out is None else out * times + part
            done += step
        if step * 2 <= length:
            have = have[:-step] * times + have[step:]
        power, step = power * power % (1 << 64), step * 2
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of blocks, forwards and backwards."""
    n = values.size - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-values.size // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: values.size] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and stop."""
    gap = np.concatenate(([True], _SPACE[np.frombuffer(text, np.uint8)], [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[::2], edges[1::2]


def word_codes(text: bytes) -> np.ndarray:
    """A 64-bit fingerprint of each word, its length included."""
    out, begin = [], 0
    while begin < len(text):  # in stretches that end with a word
        end = begin + PIECE
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        data = np.frombuffer(text, np.uint8, min(end, len(text)) - begin, begin)
        start, stop = word_spans(text[begin:end])
        if start.size:
            size = stop - start
            at = np.zeros(data.size, np.int64)  # place in the word
            at[start[0] :] = np.arange(start[0], data.size) - np.repeat(start, np.diff(np.append(start, data.size)))
            powers = np.multiply.accumulate(np.full(int(at.max()) + 1, _BASE2))
            h = np.add.reduceat(_LETTERS[data] * powers[at], start) + size.astype(np.uint64)
            h = (h ^ (h >> np.uint64(29))) * _ODD
            out.append(h ^ (h >> np.uint64(32)))
        begin = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def symbols(text: bytes, unit: Unit) -> np.ndarray:
    return np.frombuffer(text, np.uint8) if unit.code == 1 else word_codes(text)


def entries(parts: list[np.ndarray], unit: Unit = BYTES) -> tuple[np.ndarray, ...]:
    """Index entries of a few sequences: number of the sequence, first and last window start, key, context."""
    length, sample, half = unit.length, unit.sample, unit.half
    begin = np.concatenate(([0], np.cumsum([len(t) for t in parts]))).astype(np.int64)
    data = np.concatenate(parts) if parts else np.empty(0, np.uint8)
    nothing = tuple(np.empty(0, np.int64) for _ in range(5))
    if data.size < length:
        return nothing
    h = rolling(data, sample, _BYTES if unit.code == 1 else None)
    h *= _ODD
    place = np.uint64((1 << 24) - 1)
    h &= ~place
    h |= np.arange(h.size, dtype=np.uint64)
    anchor = (sliding_min(h, unit.window) & place).astype(np.int32)
    del h
    keep = np.zeros(anchor.size, bool)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= length:
            keep[a : b - length + 1] = True
    starts = np.flatnonzero(keep)
    if not starts.size:
        return nothing
    at = anchor[starts].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    lo, hi, at = starts[new], starts[np.concatenate((new[1:], [starts.size])) - 1], at[new]
    if unit.sides:  # windows that start close before their anchor share what follows it, the others what precedes it
        near, far = np.maximum(lo, at - half), np.minimum(hi, at - half - 1)
        r, f = near <= hi, lo <= far
        first, last = np.concatenate((near[r], lo[f])), np.concatenate((hi[r], far[f]))
        a, side = np.concatenate((at[r], at[f])), np.concatenate((np.zeros(r.sum(), int), np.ones(f.sum(), int)))
        low, top = np.where(side == 0, a, a - half - 1), np.where(side == 0, a + length - half, a + sample)
    else:
        first, last, a, side, low, top = lo, hi, at, np.zeros(at.size, int), at, at + sample
    digest, view, c = xxhash.xxh3_64_intdigest, memoryview(data.tobytes()), unit.code
    key = np.array([digest(view[c * x : c * y], s) for x, y, s in zip(low.tolist(), top.tolist(), (side + unit.seed).tolist(), strict=True)], np.uint64)
    context = np.array([digest(view[c * x : c * (y + length)], z) for x, y, z in zip(first.tolist(), last.tolist(), (a - first).tolist(), strict=True)], np.uint64)
    number = np.searchsorted(begin, first, side="right") - 1
    return number, first - begin[number], last - begin[number], key.view(np.int64), context.view(np.int64)


def _pieces(sequence: np.ndarray, unit: Unit) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of a sequence that hold each window once, with their offsets."""
    for i in range(0, max(1, len(sequence) - unit.length + 1), PIECE):
        yield i, sequence[i : i + PIECE + unit.length - 1]


def _index_batches(batches: Iterator[pa.RecordBatch], units: tuple[Unit, ...] = (BYTES,)) -> Iterator[pa.RecordBatch]:
    """Rows (doc, hash, text) to entries (doc, hash, first, last, key, context, unit: its place in ``units``)."""
    for batch in batches:
        docs, hashes = (np.asarray(batch.column(i).to_pylist(), np.int64) for i in (0, 1))
        for u, unit in enumerate(units):
            held, owner, offset, size = [], [], [], 0

            def flush(u=u, unit=unit) -> pa.RecordBatch:
                number, first, last, key, context = entries(held, unit)
                row, off = np.array(owner, np.int64)[number], np.array(offset, np.int64)[number]
                columns = [docs[row], hashes[row], first + off, last + off, key, context]
                made = [pa.array(c, pa.int64()) for c in columns] + [pa.array(np.full(first.size, u, np.int32))]
                return pa.RecordBatch.from_arrays(made, ["doc", "hash", "first", "last", "key", "context", "unit"])

            for i, t in enumerate(batch.column(2)):
                text = t.as_py()
                if text is None or len(text) < unit.length:
                    continue
                sequence = symbols(text, unit)
                if sequence.size < unit.length:
                    continue
                for off, piece in _pieces(sequence, unit):
                    if held and size + piece.size > PIECE:
                        yield flush()
                        held, owner, offset, size = [], [], [], 0
                    held.append(piece)
                    owner.append(i)
                    offset.append(off)
                    size += piece.size
            if held:
                yield flush()


#: An entry of a suffix array: what it is sorted by, how often it was met, whether the last batch has it, and one place of it.
ENTRY = ("key", "context", "n", "new", "doc", "first")


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for i in range(len(ENTRY))]


def _joined(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted entries with equal neighbours made one: n is added up, new if any is, the place is the first one's."""
    key, context, n, new, doc, first = columns
    heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (context[1:] != context[:-1]))))
    return [key[heads], context[heads], np.add.reduceat(n, heads), np.maximum.reduceat(new, heads), doc[heads], first[heads]]


def _array_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ENTRY to the suffix arrays of shards of about SHARD entries."""

    def flush(held: list) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        key, context, _, _, doc, first = columns
        order = np.lexsort((first, doc, context, key))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _joined([c[order] for c in columns])], ENTRY)

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(_columns(batch))
            size += batch.num_rows
        if size >= SHARD:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted scan over merged arrays: rows of ENTRY with equal ones joined, and near.

    near: a neighbour has the same key; also set for the first and last row of a task, whose neighbours are elsewhere.
    """

    def made(columns: list[np.ndarray], near: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + [pa.array(near)], [*ENTRY, "near"])

    last, before = None, True  # the row not yet given out, and whether the one ahead of it has its key
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = _columns(batch)
        if last is not None:
            columns = [np.concatenate(c) for c in zip(last, columns, strict=True)]
        columns = _joined(columns)
        same = columns[0][1:] == columns[0][:-1]
        ahead = np.concatenate(([before], same))
        last, before = [c[-1:] for c in columns], bool(ahead[-1])
        if same.size:
            yield made([c[:-1] for c in columns], ahead[:-1] | same)
    if last is not None:
        yield made(last, np.array([True]))


def _context_batches(batches: Iterator[pa.RecordBatch], units: tuple[Unit, ...] = (BYTES,)) -> Iterator[pa.RecordBatch]:
    """Rows (doc, hash, text, list of entries) to (key, whole, doc, hash, first, codes, hot, unit)."""
    names = ["key", "whole", "doc", "hash", "first", "codes", "hot", "unit"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int32()]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        size = 0
        for doc, h, text, parts in zip(*batch.columns, strict=True):
            doc, h, text, parts = doc.as_py(), h.as_py(), text.as_py(), parts.as_py()
            sequences = {u: symbols(text, units[u]) for u in {p["unit"] for p in parts}}
            for p in parts:
                codes = sequences[p["unit"]][p["first"] : p["last"] + units[p["unit"]].length].tobytes()
                for column, x in zip(out, (p["key"], p["whole"], doc, h, p["first"], codes, p["hot"], p["unit"]), strict=True):
                    column.append(x)
                size += len(codes)
            if size > 8 * PIECE:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                out, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _windows(contexts: list[bytes], unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two fingerprints of every window of every context, and how many each has."""
    length = unit.length
    begin = np.concatenate(([0], np.cumsum([len(c) // unit.code for c in contexts]))).astype(np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8 if unit.code == 1 else np.uint64)
    keep = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(begin[:-1], begin[1:], strict=True)])
    one = rolling(data, length, _BYTES if unit.code == 1 else None)[keep]
    two = rolling(data if unit.code == 1 else data ^ (data >> np.uint64(31)), length, _BYTES2 if unit.code == 1 else None, _BASE2)[keep]
    return one, two, np.diff(begin) - length + 1


def _window_batches(batches: Iterator[pa.RecordBatch], units: tuple[Unit, ...] = (BYTES,)) -> Iterator[pa.RecordBatch]:
    """Rows of _context_batches to their windows: (doc, hash, start, whole, unit, and two fingerprints)."""
    names = ["doc", "hash", "start", "whole", "unit", "one", "two"]
    for batch in batches:
        rows = batch.to_pydict()
        for u in sorted(set(rows["unit"])):
            mine = [i for i, x in enumerate(rows["unit"]) if x == u]
            step = max(1, PIECE // (4 * units[u].length))
            for some in (mine[i : i + step] for i in range(0, len(mine), step)):
                one, two, counts = _windows([rows["codes"][i] for i in some], units[u])
                owner = np.repeat(np.array(some), counts)
                at = np.arange(owner.size) - np.repeat(np.cumsum(counts) - counts, counts)
                columns = [pa.array(np.array(rows[c], np.int64)[owner]) for c in ("doc", "hash")]
                columns += [pa.array(np.array(rows["first"], np.int64)[owner] + at), pa.array(np.array(rows["whole"], bool)[owner])]
                columns += [pa.array(np.full(owner.size, u, np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names)


def shared_windows(contexts: list[bytes], unit: Unit = BYTES) -> list[np.ndarray]:
    """For each context, which of its windows also stand in another one (or twice)."""
    one, two, counts = _windows(contexts, unit)
    by = np.argsort(one, kind="stable")
    same = (one[by[1:]] == one[by[:-1]]) & (two[by[1:]] == two[by[:-1]])
    twice = np.zeros(one.size, bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    return np.split(twice, np.cumsum(counts)[:-1])


def _extent_batches(batches: Iterator[pa.RecordBatch], units: tuple[Unit, ...] = (BYTES,)) -> Iterator[pa.RecordBatch]:
    """Rows of _context_batches without hot, sorted by unit and key, to removed ranges (doc, hash, start, stop, unit)."""

    def flush(rows: list) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        u = rows[0][6]
        for row, hit in zip(rows, shared_windows([r[5] for r in rows], units[u]), strict=True):
            if row[1]:  # wholly removed already
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                for column, x in zip(out, (row[2], row[3], row[4] + a, row[4] + b - 1 + units[u].length), strict=True):
                    column.append(x)
        made = [pa.array(c, pa.int64()) for c in out] + [pa.array([u] * len(out[0]), pa.int32())]
        return pa.RecordBatch.from_arrays(made, ["doc", "hash", "start", "stop", "unit"])

    held, size, key = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and ((row[6] != held[0][6]) or row[0] != key and size > PIECE * units[row[6]].code):
                yield flush(held)
                held, size = [], 0
            held.append(row)
            key = row[0]
            size += len(row[5])
    if held:
        yield flush(held)


class IndexFamily:
    """Levels, each a suffix array: rows of ENTRY sorted by (key, context). Level i holds 2**i batches or nothing."""

    def __init__(self, work: Workspace):
        self.work = work
        self.levels: dict[int, DataFrame] = {}
        self.names: dict[int, str] = {}
        self.n = 0

    def merge(self, arrays: list[DataFrame], name: str) -> DataFrame:
        """One sorted array of several: dealt out by ranges, brought in order within them, and scanned once."""
        rows = arrays[0]
        for more in arrays[1:]:
            rows = rows.unionByName(more)
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = rows.repartitionByRange(n, "key", "context").sortWithinPartitions("key", "context", "doc", "first")
        return self.work.save(dealt.mapInArrow(_scan_batches, "key bigint, context bigint, n bigint, new bigint, doc bigint, first bigint, near boolean"), name)

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge-scan a batch (rows of ENTRY, sorted by shard) with all levels, then take it in.

        Returns the long matches known by then: rows of ENTRY that were met more than once (as a whole) or are near another.
        """
        i, work = self.n, self.work
        held = [level.withColumn("new", F.lit(0).cast("long")).select(*ENTRY) for level in self.levels.values()]
        met = self.merge([batch, *held], f"met{i}")
        # as in a binary counter, the batch carries over every full level
        carried = [j for j in range(len(self.levels) + 1) if all(k in self.levels for k in range(j))][-1]
        if carried == len(self.levels):  # all levels are full: what has just met is their merge
            merged, name = met, f"met{i}"
        elif carried:
            name = f"level{i}"
            merged = self.merge([batch, *[self.levels[j].select(*ENTRY) for j in range(carried)]], name)
        else:  # its shards come in order when it is next merged
            merged, name = batch, ""
        for j in range(carried):
            self.levels.pop(j)
            work.drop(self.names.pop(j) or "-")
        self.levels[carried], self.names[carried] = merged, name
        self.n += 1
        return met.filter("n > 1 or near")


def removed_ranges(docs: DataFrame, work: Workspace, batches: int = BATCHES, units: tuple[Unit, ...] = (BYTES,)) -> DataFrame:
    """``docs`` (doc, hash, text) to ranges of symbols to remove: doc, hash, start, stop, unit; they may overlap."""
    spark = docs.sparkSession
    made = docs.mapInArrow(lambda rows: _index_batches(rows, units), "doc bigint, hash bigint, first bigint, last bigint, key bigint, context bigint, unit int")
    index = work.save(made, "index")
    one = F.lit(1).cast("long")
    rows = index.select("key", "context", one.alias("n"), one.alias("new"), "doc", "first")
    family, found = IndexFamily(work), None
    for b in range(batches):
        own = rows.filter(F.pmod(F.xxhash64("doc"), F.lit(batches)) == b)
        array = work.save(own.mapInArrow(_array_batches, "key bigint, context bigint, n bigint, new bigint, doc bigint, first bigint"), f"array{b}")
        found = family.add(array)

    # keys with very many contexts; these go by (key, context) below, and so spread
    many = found.filter("near").groupBy("key").agg(F.count(F.lit(1)).alias("_contexts")).filter(F.col("_contexts") > HOT).select(F.col("key").alias("_many"))
    found = work.save(found.join(many, F.col("key") == F.col("_many"), "left").select("key", "context", "n", "near", F.col("_many").isNotNull().alias("hot")), "found")
    # Rows of hot entries are marked first, by a broadcast of at most HOT_SHARE rows; in the join for the others they go
    # by fingerprints of their own, which spread and meet nothing.
    floor = index.count() / HOT_SHARE
    hottest = found.filter(F.col("n") > floor).select("key", "context", F.struct("n", "near", "hot").alias("_hottest"))
    rows = index.join(F.broadcast(hottest), ["key", "context"], "left")
    rows = rows.withColumn("_c", F.when(F.col("_hottest").isNotNull(), F.xxhash64("doc", "hash", "first", "last")).otherwise(F.col("context")))
    others = found.filter(F.col("n") <= floor).select(F.col("key").alias("_wk"), F.col("context").alias("_wc"), F.struct("n", "near", "hot").alias("_other"))
    rows = rows.join(others, (F.col("key") == F.col("_wk")) & (F.col("_c") == F.col("_wc")), "left").withColumn("_as", F.coalesce("_hottest", "_other")).filter("_as is not null")
    marked = rows.select("doc", "hash", "first", "last", "key", "context", "unit", (F.col("_as.n") > 1).alias("whole"), F.col("_as.near").alias("split"), F.col("_as.hot").alias("hot"))
    marked = work.save(marked, "marked")
    work.drop(*[n for n in list(work.paths) if n != "marked"])
    sweep(spark)

    # of wholly removed entries in split keys one of each context is enough to compare the others with
    place = F.struct("doc", "hash", "first", "last")
    one = marked.filter("split and whole").groupBy("key", "context", "unit").agg(F.min(place).alias("p"), F.max("hot").alias("hot")).select("p.*", "key", F.lit(True).alias("whole"), "hot", "unit")
    rest = marked.filter("split and not whole").select("doc", "hash", "first", "last", "key", "whole", "hot", "unit")
    asked = one.unionByName(rest).groupBy("doc", "hash").agg(F.collect_list(F.struct("key", "whole", "first", "last", "hot", "unit")).alias("parts"))
    texts = docs.join(asked, ["doc", "hash"]).dropDuplicates(["doc", "hash"]).select("doc", "hash", "text", "parts")
    schema = "key bigint, whole boolean, doc bigint, hash bigint, first bigint, codes binary, hot boolean, unit int"
    contexts = work.save(texts.mapInArrow(lambda rows: _context_batches(rows, units), schema), "contexts")
    sweep(spark)
    n = max(24, int(spark.conf.get("spark.sql.shuffle.partitions")))
    few = contexts.filter("not hot").drop("hot").repartition(n, "key").sortWithinPartitions("unit", "key")
    settled = few.mapInArrow(lambda rows: _extent_batches(rows, units), "doc bigint, hash bigint, start bigint, stop bigint, unit int")
    # windows of hot keys are counted by their own fingerprints, added up before they move
    windows = contexts.filter("hot").mapInArrow(lambda rows: _window_batches(rows, units), "doc bigint, hash bigint, start bigint, whole boolean, unit int, one bigint, two bigint")
    twice = windows.groupBy("unit", "one", "two").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("unit", "one", "two")
    width = F.element_at(F.array(*[F.lit(u.length).cast("long") for u in units]), F.col("unit") + 1)
    hot = windows.filter("not whole").join(twice, ["unit", "one", "two"], "left_semi").select("doc", "hash", "start", (F.col("start") + width).alias("stop"), "unit")
    full = marked.filter("whole").select("doc", "hash", F.col("first").alias("start"), (F.col("last") + width).alias("stop"), "unit")
    ranges = work.save(full.unionByName(settled).unionByName(hot), "ranges")
    work.drop("marked", "contexts")
    sweep(spark)
    return ranges


def _runs(ranges: list | None) -> list[list[int]]:
    """Ranges that overlap or touch made one, in order."""
    out: list[list[int]] = []
    for r in sorted((r["start"], r["stop"]) for r in ranges or ()):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append([*r])
    return out


def _cut_batches(batches: Iterator[pa.RecordBatch], as_text: bool, unit: Unit = BYTES) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, ranges, passages) to what is cut, what stays, and the words in repeated passages."""
    names = ["_row", "n_bytes", "n_removed", "n_spans", "spans", "kept", "n_left", "n_repeat_words"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.string() if as_text else pa.binary(), pa.int64(), pa.int64()]
    for batch in batches:
        out: list[list] = [[] for _ in kinds]
        for text, ranges, passages in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
            text, spans = text.as_py() or b"", _runs(ranges.as_py())
            left = len(text) - sum(b - a for a, b in spans)
            if spans and unit.code > 1:
                start, stop = word_spans(text)
                left = start.size - sum(b - a for a, b in spans)
                spans = [[int(start[a]), int(stop[b - 1])] for a, b in spans]
            kept, upto = [], 0
            for a, b in spans:
                kept.append(text[upto:a])
                upto = b
            kept.append(text[upto:])
            stays = b"".join(kept)
            row = (
                len(text), sum(b - a for a, b in spans), len(spans), [{"start": a, "stop": b} for a, b in spans],
                stays.decode("utf-8", "ignore") if as_text else stays, left, sum(b - a for a, b in _runs(passages.as_py())),
            )
            for column, x in zip(out, row, strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names)


def cut(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", batches: int = BATCHES, as_text: bool = False, unit: Unit = BYTES, passages: Unit | None = None
) -> DataFrame:
    """``keep`` plus n_bytes, n_removed, n_spans, spans, kept (the remaining bytes, or characters) and n_left (symbols), for each row.

    ``spans`` are in bytes. With ``passages`` also n_repeat_words: the words in repeated runs of that unit, which stay.
    """
    spark = docs.sparkSession
    ship(spark)
    own = F.struct(*[F.col(c) for c in keep])
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"),
        F.col(text).cast("binary").alias("text"), own.alias("_row"),
    )
    found = removed_ranges(rows.select("doc", "hash", "text"), Workspace(spark, "suffixes"), batches, (unit, passages) if passages else (unit,))
    own = lambda u: F.collect_set(F.when(F.col("unit") == u, F.struct("start", "stop")))
    lists = found.groupBy("doc", "hash").agg(own(0).alias("ranges"), own(1).alias("passages"))
    joined = rows.join(lists, ["doc", "hash"], "left").select("_row", "text", "ranges", "passages")
    columns = f"n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,stop:bigint>>, kept {'string' if as_text else 'binary'}, n_left bigint"
    out = joined.mapInArrow(lambda rows: _cut_batches(rows, as_text, unit), f"_row {joined.schema['_row'].dataType.simpleString()}, {columns}, n_repeat_words bigint")
    return out.select("_row.*", "n_bytes", "n_removed", "n_spans", "spans", "kept", "n_left", *(["n_repeat_words"] if passages else []))


def remove_repeats(docs: DataFrame, text: str = "text", batches: int = BATCHES, unit: Unit = BYTES) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``; a character that a cut splits goes with it.

    Documents of which nothing stays are dropped; other columns are kept as they are.
    """
    own = docs.columns
    others = [c for c in own if c != text]
    packed = docs.select("doc_id", text, F.struct(*[F.col(c) for c in others]).alias("_others"))
    out = cut(packed, ("_others",), text, batches, as_text=True, unit=unit).filter("n_spans = 0 or n_left > 0")
    return out.select("_others.*", F.col("kept").alias(text)).select(*own)
