"""Benchmark decontamination by suffix arrays of the training texts.

The documents are taken in shards of bounded size. Each shard's words become numbers and get a suffix array;
every suffix of every benchmark item is binary-searched in it, which gives its longest verbatim match and
where that is; those of at least a window's length are followed to all their occurrences.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` once A-Z are lower-cased. A window is ``width`` consecutive
words of an item, or all of an item that has fewer.

Edge cases: null and empty texts have no words and are clean; an item without words has no window; a null
item_id reads as an empty string; items that share an id count once; repeated documents are each reported; an
empty benchmark leaves all documents clean; a document larger than a shard is a shard of its own. Only the text
and the columns in ``keep`` are read; those named like a result are replaced by it.

The benchmark is read in blocks of at most about ``block_bytes``, each broadcast on its own, with the documents
passed over once for each block.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import suffix
from docloom.llm.store import Workspace, ship

WIDTH = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
HITS = "array<struct<start:bigint,stop:bigint>>"
MATCHES = "array<struct<item_id:string,item_start:bigint,doc_start:bigint,length:bigint>>"
OUTPUTS = ("n_words", "n_hit", "n_items", "items", "matches", "contaminated")

#: Every byte that separates words becomes a space, A-Z become a-z, the rest stay; all separators are ASCII.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Items:
    """The benchmark items of one block: words in a row, with an end after each item."""

    def __init__(self, rows: Sequence[tuple[str, bytes]], width: int):
        self.ids = [i for i, _ in rows]
        self.words: list[bytes | None] = []
        start, limit, window, owner = [], [], [], []
        for k, (_, text) in enumerate(rows):
            words = words_of(text)
            base, n = len(self.words), len(words)
            self.words += words + [None]
            start += range(base, base + n)
            limit += range(n, 0, -1)
            window += [min(width, n)] * n
            owner += [k] * n
        self.start, self.limit, self.window, self.owner = (np.array(x, np.int64) for x in (start, limit, window, owner))
        self.base = np.zeros(len(rows), np.int64)
        if self.start.size:
            first = np.unique(self.owner, return_index=True)
            self.base[first[0]] = self.start[first[1]]


def match_shard(texts: Sequence[bytes | None], items: Items) -> tuple[list[int], list[list], list[list], list[list]]:
    """For each text: words, runs of hit words, ids of items with an occurring window, longest matches that lie in it."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    counts, codes = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        codes.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    n_docs = len(texts)
    starts = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)))
    size = int(starts[-1])
    # document ends are codes below all words, each its own, so that no match goes past one
    text = np.empty(size + suffix.PAD, np.int64)
    text[size:] = -2
    for i, c in enumerate(codes):
        text[starts[i] : starts[i] + c.size] = c + n_docs
        text[starts[i + 1] - 1] = i
    query = np.full(len(items.words) + suffix.PAD, -3, np.int64)
    query[: len(items.words)] = [-3 if w is None else known[w] + n_docs if w in known else -1 for w in items.words]
    runs: list[list] = [[] for _ in texts]
    found: list[list] = [[] for _ in texts]
    matches: list[list] = [[] for _ in texts]
    if not items.start.size or not sum(counts):
        return counts, runs, found, matches
    order = suffix.suffix_array(text[:size])

    best, where = suffix.longest(text, order, query, items.start, items.limit)
    hit = np.flatnonzero(best >= items.window)
    hit = hit[items.limit[hit] >= items.window[hit]]
    if not hit.size:
        return counts, runs, found, matches
    doc_of = lambda at: np.searchsorted(starts, at, side="right") - 1
    for q, d in zip(hit.tolist(), doc_of(where[hit]).tolist(), strict=True):
        owner = int(items.owner[q])
        matches[d].append({"item_id": items.ids[owner], "item_start": int(items.start[q] - items.base[owner]), "doc_start": int(where[q] - starts[d]), "length": int(best[q])})

    width = items.window[hit]
    lo = suffix.search(text, order, query, items.start[hit], width)
    hi = suffix.search(text, order, query, items.start[hit], width, after=True)
    # equal windows of several items are followed once
    _, first, same = np.unique(np.stack((lo, width)), axis=1, return_index=True, return_inverse=True)
    at, window = suffix.expand(lo[first], hi[first])
    at, w = order[at], width[first][window]
    cover = np.zeros(size + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + w, -1)
    inside = np.concatenate(([0], (np.cumsum(cover[:size]) > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(inside))
    owners = doc_of(edges[::2])
    for d, a, b in zip(owners.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        runs[d].append({"start": int(a - starts[d]), "stop": int(b - starts[d])})
    holders: list[set] = [set() for _ in range(first.size)]
    for k, q in zip(same.ravel().tolist(), hit.tolist(), strict=True):
        holders[k].add(items.ids[int(items.owner[q])])
    for pair in np.unique(doc_of(at) * first.size + window).tolist():
        found[pair // first.size].append(holders[pair % first.size])
    return counts, runs, [sorted(set().union(*f)) if f else [] for f in found], matches


def _slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``limit`` bytes, or one row."""
    sizes = [len(x) if x is not None else 0 for x in texts.to_pylist()]
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def find(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` plus n_words, n_hit, n_items, items, matches and contaminated, for each document."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    kept = [c for c in keep if c not in OUTPUTS]
    rows = docs.select(F.col(text).cast("binary").alias("_text"), F.struct(*[F.col(c) for c in kept]).alias("_row"))
    work = Workspace(spark, "decontaminate") if n_blocks > 1 else None
    for b in range(n_blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).collect()
        shared = spark.sparkContext.broadcast([(r.item_id, bytes(r.text) if r.text is not None else b"") for r in block])

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Items(shared.value, width)
            kinds = [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string())]
            kinds.append(pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())])))
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("_text"))
                for i, j in _slices(texts, SHARD_BYTES):
                    counts, *lists = match_shard(texts.slice(i, j - i).to_pylist(), known)
                    part = batch.slice(i, j - i)
                    made = [pa.array(counts, pa.int64()), *(pa.array(x, kind) for x, kind in zip(lists, kinds, strict=True))]
                    n = batch.num_columns
                    last = [part.column(k) for k in range(n)]
                    yield pa.RecordBatch.from_arrays([*last, *made], [*batch.schema.names, "_n", f"_hits{b}", f"_items{b}", f"_matches{b}"])

        rows = rows.drop("_n") if "_n" in rows.columns else rows
        if b == n_blocks - 1:  # the text itself is not needed beyond the last block
            drop_text = True
        else:
            drop_text = False
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if not (drop_text and f.name == "_text")), "_n bigint", f"_hits{b} {HITS}", f"_items{b} array<string>", f"_matches{b} {MATCHES}"])

        def shorter(batches: Iterator[pa.RecordBatch], match=match, drop_text=drop_text) -> Iterator[pa.RecordBatch]:
            for out in match(batches):
                yield out.drop_columns(["_text"]) if drop_text else out

        rows = rows.mapInArrow(shorter, schema)
        if work is not None:
            rows = work.save(rows, f"block{b}")
    hits = F.sort_array(F.concat(*[F.col(f"_hits{b}") for b in range(n_blocks)]))
    # runs in order of start; what each adds beyond the furthest end so far
    none = F.lit(0).cast("long")
    covered = F.aggregate(
        hits, F.struct(none.alias("upto"), none.alias("n")),
        lambda a, x: F.struct(F.greatest(a["upto"], x["stop"]).alias("upto"), (a["n"] + F.greatest(none, x["stop"] - F.greatest(a["upto"], x["start"]))).alias("n")),
        lambda a: a["n"],
    )
    found = F.array_sort(F.array_distinct(F.concat(*[F.col(f"_items{b}") for b in range(n_blocks)])))
    return rows.select(
        "_row.*", F.col("_n").alias("n_words"), covered.alias("n_hit"), F.size(found).cast("long").alias("n_items"), found.alias("items"),
        F.concat(*[F.col(f"_matches{b}") for b in range(n_blocks)]).alias("matches"), (covered > 0).alias("contaminated"),
    )


def longest_matches(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """For each (item_id, item_start): the longest verbatim match in the corpus and the document and place of it."""
    rows = found.select(F.col(key), F.explode("matches").alias("m")).select(key, "m.*")
    best = F.max_by(F.struct(key, "doc_start"), F.struct("length", -F.coalesce(F.col(key), F.lit(-1)), -F.col("doc_start")))
    return rows.groupBy("item_id", "item_start").agg(F.max("length").alias("length"), best.alias("_at")).select("item_id", "item_start", "length", "_at.*")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with no window of the benchmark, with their own columns."""
    own = docs.columns
    packed = docs.select(F.col(text).alias("_t"), F.struct(*[F.col(c) for c in own]).alias("_own"))
    return find(packed, benchmark, ["_own"], "_t").filter(~F.col("contaminated")).select("_own.*")
