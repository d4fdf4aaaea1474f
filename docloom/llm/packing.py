"""Best-fit packing of documents into bins of equal capacity, under conflicts.

Documents longer than a bin are cut into pieces. Pieces are placed in order of length, the longest first, each in
the compatible bin with the least room that takes it (the lowest number of equals), or in a new one. A bin's source
bitmap and duplicate-cluster bitmap say which it already holds; it takes no second piece of a source or cluster.

Bins are found by room: one heap of bins for each free length, and a bitmap of the lengths that have any, whose next
set bit is the successor. Where the tightest bins conflict the search goes on to the next length. Sources and
clusters with over a ``1 / HOT`` share of a group have heaps of the bins that lack them, so that a hot one, in which
nearly all bins conflict, does not scan them all.

Documents are packed in groups of about ``GROUP`` pieces, by hash, in parallel; a hot source spreads over all
groups. Only lengths and keys move, never texts.

Edge cases: a null or empty text takes the place of its end mark alone; a null source or cluster conflicts with
nothing; repeated rows are pieces of their own (of one cluster); pieces of one document may share a bin
with no other of its source; an empty table gives an empty result; input columns other than those named are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.minhash import near_duplicates
from docloom.llm.store import Workspace, ship

CAPACITY = 2048
GROUP = 20_000
PERCENT = 80
HOT = 32
SCHEMA = "doc_id bigint, piece int, bin bigint, slot int, start bigint, length bigint, source string, cluster bigint"


class Bins:
    """The open bins of one group."""

    def __init__(self, capacity: int, hot: tuple[int, ...]):
        self.capacity = capacity
        self.room: list[int] = []
        self.held: list[int] = []
        # for None all bins, for a hot bit those that lack it: (heaps by room, bitmap of the rooms that have bins)
        self.heaps: dict[int | None, list[list[int]]] = {k: [[] for _ in range(capacity + 1)] for k in (None, *hot)}
        self.some: dict[int | None, int] = dict.fromkeys(self.heaps, 0)

    def _list(self, b: int) -> None:
        room, held = self.room[b], self.held[b]
        if room:
            for bit, heaps in self.heaps.items():
                if bit is None or not held & bit:
                    heapq.heappush(heaps[room], b)
                    self.some[bit] |= 1 << room

    def place(self, length: int, bits: int, hot: int | None) -> int:
        """Put a piece in its bin: the number of the bin."""
        heaps, room = self.heaps[hot], length
        while above := self.some[hot] >> room:
            room += (above & -above).bit_length() - 1
            heap, passed, found = heaps[room], [], None
            while heap:
                b = heapq.heappop(heap)
                if self.room[b] != room or hot is not None and self.held[b] & hot:
                    continue  # it has moved on since it was listed
                if not self.held[b] & bits:
                    found = b
                    break
                passed.append(b)
            for b in passed:
                heapq.heappush(heap, b)
            if not heap:
                self.some[hot] &= ~(1 << room)
            if found is not None:
                self.room[found] -= length
                self.held[found] |= bits
                self._list(found)
                return found
            room += 1
        self.room.append(self.capacity - length)
        self.held.append(bits)
        self._list(len(self.room) - 1)
        return len(self.room) - 1


def pack_pieces(pieces: list[tuple[int, str | None, int | None]], capacity: int = CAPACITY) -> list[int]:
    """The bin of each piece (length, source, cluster), placed in the order given."""
    sources, clusters = Counter(p[1] for p in pieces), Counter(p[2] for p in pieces)
    keys = [("s", k, n) for k, n in sources.items() if k is not None and n > 1]
    keys += [("c", k, n) for k, n in clusters.items() if k is not None and n > 1]
    bit = {(kind, k): 1 << i for i, (kind, k, _) in enumerate(keys)}
    share = {bit[kind, k]: n for kind, k, n in keys if n > len(pieces) / HOT}
    bins = Bins(capacity, tuple(share))
    out = []
    for length, source, cluster in pieces:
        own = [b for b in (bit.get(("s", source), 0), bit.get(("c", cluster), 0)) if b]
        hot = max((b for b in own if b in share), key=share.__getitem__, default=None)
        out.append(bins.place(length, sum(own), hot))
    return out


def _pack_group(table: pa.Table, capacity: int) -> pa.Table:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("length", "doc_id", "piece", "start", "source", "cluster", "group")), strict=True), key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2], r[5] or 0))
    at = pack_pieces([(r[0], r[4], r[5]) for r in rows], capacity)
    slots: Counter = Counter()
    out: list[list] = [[] for _ in range(8)]
    for r, b in zip(rows, at, strict=True):
        for column, x in zip(out, (r[1], r[2], (r[6] << 32) + b, slots[b], r[3], r[0], r[4], r[5]), strict=True):
            column.append(x)
        slots[b] += 1
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    names = ["doc_id", "piece", "bin", "slot", "start", "length", "source", "cluster"]
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)


def words_in(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def pack(docs: DataFrame, capacity: int = CAPACITY, text: str = "text", source: str = "source", cluster: Column | None = None, group: int = GROUP, words: Column | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, bin, slot in it, start (in words), length, source, cluster.

    ``length`` counts words and an end mark. ``cluster`` says which documents must not meet; by default those
    with one text do not. ``words`` is their length; by default that of the text.
    """
    spark = docs.sparkSession
    ship(spark)
    own = F.xxhash64(F.col(text)) if cluster is None else cluster.cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), own.alias("cluster"), (words_in(F.col(text)) if words is None else words).alias("_n"))
    # written once without the texts: pieces are what fills the groups, so they are counted first
    rows, most = Workspace(spark, "packing").save(rows, "rows"), capacity - 1
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / most).cast("int") - 1, F.lit(0)))))
    rows = rows.withColumn("start", F.col("piece").cast("long") * most).withColumn("length", F.least(F.lit(most).cast("long"), F.col("_n") - F.col("start")) + 1)
    n_groups = max(1, math.ceil(rows.count() / group))
    rows = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(77), "doc_id", "piece"), F.lit(n_groups)))
    return rows.drop("_n").groupBy("group").applyInArrow(lambda t: _pack_group(t, capacity), SCHEMA)


def pack_near(docs: DataFrame, capacity: int = CAPACITY, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """``pack`` with the components of near duplicates as clusters; texts without words meet their copies only."""
    copy = F.xxhash64("text")
    carry = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), copy.alias("copy"), words_in(F.col("text")).alias("n"))
    # rows without an id are compared too, each text under a number of its own
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), copy).alias("doc_id"), "text", carry.alias("_own"))
    near = near_duplicates(named, percent=percent, carry=F.col("_own"))
    rows = near.select("_row.*", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("_row.copy")).alias("component"))
    return pack(rows, capacity, cluster=F.col("component"), group=group, words=F.col("n"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Bins, pieces and the share of the capacity that is used."""
    return packed.agg(
        F.count_distinct("bin").alias("n_bins"), F.count(F.lit(1)).alias("n_pieces"),
        (F.sum("length") / (F.count_distinct("bin") * F.lit(capacity))).alias("filled"),
    )
