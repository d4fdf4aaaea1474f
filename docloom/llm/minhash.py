"""Near-duplicate detection: fast similarity sketches, banding, exact verification, components.

Sketch. Every element is thrown into a bin in each round, with a fresh hash; a bin keeps the least value of the
first round in which anything fell into it. After as many rounds as bins, each further round throws all elements
into one bin, so that every coordinate fills. Two sketches agree in a coordinate with probability equal to the
Jaccard similarity, concentrated at least as well as independent draws.

Banding. Documents with one shingle set are one class. Classes that agree in a whole band share a bucket; with 32 bands
of 4 coordinates, a pair at similarity 0.85 is missed with probability 6e-11 (5e-8 at 0.8). Buckets with the same
members are one. In a bucket, members are compared by eight bits of each coordinate, and those that agree in too few
of them for the similarity asked for are set apart; a linked pair is set apart with probability ``TAIL`` at most.
What is left of a bucket is a few groups, passed on as chains, so that no member has many neighbours.

Verification. The connected parts of those chains hold texts of real likeness only. A part is compared inside one task,
on full shingle sets, by an index from shingles to members, unless two are already joined. A part too large for a task
is first compared with ``HUBS`` of its members, in one pass over its chunks; those that are joined by this to its largest
component are not compared with each other again: only the others meet every chunk. Each text moves once, but for
large parts. Only joining links leave the tasks, fewer than there are classes.

Words are ``[^\\x20\\x09-\\x0D]+`` once A-Z are lower-cased; the set is all runs of ``width`` words, or the whole
sequence if it is shorter.

Edge cases: null and empty texts have an empty set and are their own component; rows that share a doc_id count
as one node; a null doc_id belongs to the class of its text, and its component is that class's least doc_id, if
it has any; an empty table gives an empty result; only doc_id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.components import connected_components
from docloom.llm.store import Workspace, ship

WIDTH = 5
BINS, BAND = 128, 4
PERCENT = 85
#: Most probable share of linked pairs that the comparison of sketches sets apart.
TAIL = 1e-10
#: Members of a large part that all others are compared with first.
HUBS = 16
#: Members of a chunk, about, and their shingles in all; a block is two chunks at most.
BLOCK, BLOCK_SHINGLES = 4096, 4 << 20
#: Entries of a block's index that are looked up at once.
STEP = 4 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    w = np.array([digest(x) for x in words], np.uint64)
    n = max(1, w.size - width + 1)
    out = np.full(n, min(width, w.size), np.uint64)
    for j in range(min(width, w.size)):
        out = mix(out * _STEP + w[j : j + n])
    return np.unique(out)


_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * _STEP)


def sketch(elements: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The coordinates as 32-bit values."""
    n = elements.size
    bits = bins.bit_length() - 1
    out, filled, done = np.zeros(bins, np.uint64), np.zeros(bins, bool), 0
    while done < bins and not filled.all():
        rounds = min(bins - done, max(1, 1536 // n), 1 << 7)
        x = mix(elements[None, :] ^ _SEEDS[done : done + rounds, None])
        # bin, then round, then value: the first of each bin is what it keeps
        key = ((x & np.uint64(bins - 1)) << np.uint64(64 - bits)) | (np.arange(rounds, dtype=np.uint64)[:, None] << np.uint64(57 - bits)) | (x >> np.uint64(7 + bits))
        key = np.sort(key, axis=None)
        at = (key >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        new = first[~filled[at[first]]]
        out[at[new]] = mix(key[new] + np.uint64((done + 1) * int(_STEP) % (1 << 64)))
        filled[at[new]] = True
        done += rounds
    rest = np.flatnonzero(~filled)
    if rest.size:
        out[rest] = mix(mix(elements[None, :] ^ _SEEDS[bins + rest][:, None]).min(axis=1) + _STEP)
    return (out >> np.uint64(32)).astype(np.uint32)


def bands(coordinates: np.ndarray, size: int = BAND) -> np.ndarray:
    """One 64-bit hash for each band, its number included."""
    c = coordinates.reshape(-1, size).astype(np.uint64)
    h = np.arange(1, c.shape[0] + 1, dtype=np.uint64) * _STEP
    for j in range(size):
        h = mix(h * _STEP + c[:, j])
    return h.astype(np.int64)


def least_agreement(percent: int, bins: int = BINS, tail: float = TAIL) -> int:
    """The most coordinates that all but ``tail`` of pairs at the similarity agree in."""
    p, below = percent / 100, 0.0
    for k in range(bins + 1):
        below += math.comb(bins, k) * p**k * (1 - p) ** (bins - k)
        if below > tail:
            return k
    return bins


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        sizes, keys, lists, short = [], [], [], []
        for t in texts:
            s = shingles(t.as_py())
            c = sketch(s) if s.size else None
            sizes.append(s.size)
            keys.append(None if c is None else xxhash.xxh3_128_digest(s.tobytes()))
            lists.append(np.empty(0, np.int64) if c is None else bands(c))
            short.append(None if c is None else c.astype(np.uint8).tobytes())
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
        flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
        made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
        out = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), made, pa.array(short, pa.binary()), *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_shingles", "set_key", "bands", "sketch", *batch.schema.names[2:]])


def alike(ids: list[int], side: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, percent: int = PERCENT, least: int | None = None) -> list[tuple[int, int]]:
    """Chains through the groups of members whose sketches may belong to linked sets.

    ``side``: where both 0 and 1 occur, only pairs across are compared, as in ``link_block``.
    """
    least = least_agreement(percent) if least is None else least
    across = bool(side.any() and not side.all())
    left, links = np.ones(len(ids), bool), []
    for begin in range(len(ids)):
        if not left[begin]:
            continue
        left[begin] = False
        wave, last = [begin], begin
        while wave:
            i = wave.pop()
            rest = np.flatnonzero(left & (side != side[i]) if across else left)
            rest = rest[100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i])]
            if not rest.size:
                continue
            for k in rest[(sketches[rest] == sketches[i]).sum(axis=1) >= least].tolist():
                links.append((ids[last], ids[k]))
                left[k] = False
                wave.append(k)
                last = k
    return links


def link_block(ids: list[int], side: np.ndarray, texts: list[bytes], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join all of a block's members that are joined at all.

    ``side``: 0 or 1; where both occur, only pairs across are compared (pairs within are another block's).
    Members are taken breadth first; each is compared with those not yet reached, so that a group held together
    by one member costs little more than one pass.
    """
    sets = [shingles(t) for t in texts]
    sizes = np.array([s.size for s in sets])
    across = bool(side.any() and not side.all())
    # the members of shingle e, less those found gone when it was last made: owners[starts[e] : starts[e + 1]]
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    of = np.cumsum(np.concatenate(([False], flat[1:] != flat[:-1])), dtype=np.int32)[: flat.size]
    mine, owners = np.empty(flat.size, np.int32), np.repeat(np.arange(len(ids), dtype=np.int32), sizes)[order]
    mine[order] = of
    mine, n = np.split(mine, np.cumsum(sizes)[:-1]), int(of.max(initial=-1)) + 1
    starts, indexed = np.searchsorted(of, np.arange(n + 1)), len(ids)
    del flat, order, sets
    links, left, wave = [], np.ones(len(ids), bool), []
    # across two sides, a reached member still has to meet the other side's members, so both are kept in turn
    for begin in range(len(ids)):
        if not left[begin]:
            continue
        left[begin] = False
        wave = [begin]
        while wave:
            i = wave.pop()
            rest = np.flatnonzero(left & (side != side[i]) if across else left)
            rest = rest[(100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))]
            if not rest.size:
                continue
            if 2 * np.count_nonzero(left) < indexed:
                stay = left[owners]
                of, owners, indexed = of[stay], owners[stay], np.count_nonzero(left)
                starts = np.searchsorted(of, np.arange(n + 1))
            same = np.zeros(len(ids), np.int64)
            for part in np.array_split(mine[i], 1 + mine[i].size * indexed // STEP):
                many = starts[part + 1] - starts[part]
                at = np.repeat(starts[part] - np.cumsum(many) + many, many) + np.arange(many.sum())
                same += np.bincount(owners[at], minlength=len(ids))
            same = same[rest]
            for k in rest[100 * same >= percent * (sizes[i] + sizes[rest] - same)].tolist():
                links.append((ids[i], ids[k]))
                left[k] = False
                wave.append(k)
    return links


def _by_block(batches: Iterator[pa.RecordBatch], links_of) -> Iterator[pa.RecordBatch]:
    """Rows that begin with their block, sorted by it; ``links_of`` makes pairs of the rows of each."""

    def flush(rows: list) -> pa.RecordBatch:
        links = links_of(rows) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    held: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


def _alike_batches(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, rep, size, sketch)."""
    least = least_agreement(percent)

    def links_of(rows: list) -> list:
        sketches = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1)
        return alike([r[2] for r in rows], np.array([r[1] for r in rows]), np.array([r[3] for r in rows]), sketches, percent, least)

    return _by_block(batches, links_of)


def _link_batches(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, doc_id, text)."""
    return _by_block(batches, lambda rows: link_block([r[2] for r in rows], np.array([r[1] for r in rows]), [r[3] for r in rows], percent))


def _hub_batches(batches: Iterator[pa.RecordBatch], percent: int = PERCENT) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, doc_id, text) with a block's hubs (side 0) first: the links of each row to them."""
    block, hubs = None, []
    for batch in batches:
        links: list = []
        for at, side, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != block:
                block, hubs = at, []
            own = shingles(text)
            if side == 0:
                hubs.append((node, own))
                continue
            for hub, elements in hubs:
                if hub == node or 100 * min(own.size, elements.size) < percent * max(own.size, elements.size):
                    continue
                at_most = np.minimum(np.searchsorted(elements, own), elements.size - 1)
                same = int(np.count_nonzero(elements[at_most] == own))
                if 100 * same >= percent * (own.size + elements.size - same):
                    links.append((node, hub))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])


def _pairs_of_chunks(rows: DataFrame, group: str, chunks: str, node: str) -> DataFrame:
    """``rows`` once for each block of two chunks that their chunk is in: with ``block`` and ``side``."""
    rows = rows.withColumn("_c", F.pmod(F.xxhash64(node), F.col(chunks)).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col(chunks) - 1)))
    block = F.concat_ws(":", group, F.least("_c", "_o"), F.greatest("_c", "_o"))
    return rows.withColumn("block", block).withColumn("side", (F.col("_c") > F.col("_o")).cast("int")).drop("_c", "_o")


def _repeats(reps: DataFrame) -> bool:
    """Does a doc_id stand for more than one set? Ids that rows share are rare, and a distinct of all bands is dear."""
    return bool(reps.groupBy("rep").count().filter("count > 1").limit(1).count())


def _candidates(reps: DataFrame, work: Workspace, percent: int, parts: int) -> DataFrame:
    """Chains of classes (a, b) that may be linked, found in the buckets of the bands."""
    # rows of one doc_id may have several sets in one bucket
    banded = reps.select("rep", F.explode("bands").alias("band")) if not _repeats(reps) else reps.select("rep", F.explode("bands").alias("band")).distinct()
    own = [F.bit_xor(F.xxhash64(F.lit(i), "rep")).alias(f"h{i}") for i in (1, 2)]
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *own).filter("n > 1")
    # many bands hold the same members: one of them will do
    buckets = work.save(buckets.groupBy("n", "h1", "h2").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("chunks")), "buckets")
    members = banded.hint("shuffle_merge").join(buckets, "band").select(F.col("band").cast("string").alias("band"), "chunks", "rep")
    members = _pairs_of_chunks(members, "band", "chunks", "rep").select("block", "side", "rep")
    members = members.hint("shuffle_merge").join(reps.select("rep", "size", "sketch"), "rep").select("block", "side", "rep", "size", "sketch")
    members = members.repartition(parts, "block").sortWithinPartitions("block")
    return work.save(members.mapInArrow(lambda rows: _alike_batches(rows, percent), "a bigint, b bigint"), "alike")


def _verified(parts: DataFrame, rows: DataFrame, weights: DataFrame, work: Workspace, percent: int, n: int) -> DataFrame:
    """Links (a, b) that join all members of each part (node, component) that are joined at all."""
    # the chunks of a part, bounded in members and in shingles
    pieces = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), F.sum("size") / F.lit(BLOCK_SHINGLES)))
    sizes = parts.join(weights.hint("shuffle_merge"), "node").groupBy("component").agg(F.greatest(pieces, F.lit(1)).cast("int").alias("chunks"), F.count(F.lit(1)).alias("n"))
    sizes = work.save(sizes, "sizes")
    columns = ["block", "side", "doc_id", "text"]

    def texts(members: DataFrame, *order: str) -> DataFrame:
        # never a broadcast, whose size would depend on the input: candidates grow with it
        out = members.hint("shuffle_merge").join(rows, "doc_id").select(*columns).repartition(max(n, 24), "block")
        return out.sortWithinPartitions("block", *order)

    small = parts.join(sizes.filter("chunks = 1"), "component").select(F.col("component").cast("string").alias("block"), F.lit(0).alias("side"), F.col("node").alias("doc_id"))
    blocks = texts(small)
    links = work.save(blocks.mapInArrow(lambda b: _link_batches(b, percent), "a bigint, b bigint"), "links")
    large = sizes.filter("chunks > 1")
    if not large.limit(1).count():
        return links

    # large parts: every member against some, so that what is left to compare is small where most are copies of one text
    members = work.save(parts.join(large, "component").select("component", "chunks", "node"), "large")
    # a hash below HUBS / n: about so many, without an order over the part
    share = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(1 << 40)) < (F.lit(HUBS) * (1 << 40) / F.col("n"))
    hubs = members.join(large.select("component", "n"), "component").filter(share)
    own = members.select(F.concat_ws(":", "component", F.pmod(F.xxhash64("node"), F.col("chunks"))).alias("block"), F.lit(1).alias("side"), F.col("node").alias("doc_id"))
    each = hubs.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(F.concat_ws(":", "component", "c").alias("block"), F.lit(0).alias("side"), F.col("node").alias("doc_id"))
    first = work.save(texts(own.unionByName(each), "side").mapInArrow(lambda b: _hub_batches(b, percent), "a bigint, b bigint"), "hubs")
    joined = connected_components(first, work, "reached")
    grouped = members.join(joined.select("node", F.col("component").alias("group")), "node", "left").withColumn("group", F.coalesce("group", "node"))
    counts = grouped.groupBy("component", "group").agg(F.count(F.lit(1)).alias("n_group"))
    most = counts.groupBy("component").agg(F.max(F.struct("n_group", "group")).alias("m"), F.sum("n_group").alias("n_all"))
    most = most.select("component", F.col("m.group").alias("main"), (F.col("n_all") - F.col("m.n_group")).alias("n_rest"))
    most = most.join(large.select("component", F.col("chunks").alias("main_chunks"), "n"), "component")
    most = most.withColumn("chunks", F.ceil(F.col("n_rest") * F.col("main_chunks") / F.col("n")).cast("int")).filter("chunks > 0")
    grouped = grouped.drop("chunks").join(most, "component")
    rest = grouped.filter("group <> main")
    inner = _pairs_of_chunks(rest.withColumn("part", F.concat(F.lit("r"), "component")), "part", "chunks", "node").select("block", "side", F.col("node").alias("doc_id"))
    chunk = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    other = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    outer = rest.withColumn("c", chunk("chunks")).withColumn("o", other("main_chunks")).withColumn("side", F.lit(0))
    outer = outer.unionByName(grouped.filter("group = main").withColumn("o", chunk("main_chunks")).withColumn("c", other("chunks")).withColumn("side", F.lit(1)))
    outer = outer.select(F.concat_ws(":", "component", "c", "o").alias("block"), "side", F.col("node").alias("doc_id"))
    last = work.save(texts(inner.unionByName(outer)).mapInArrow(lambda b: _link_batches(b, percent), "a bigint, b bigint"), "rest")
    return links.unionByName(first).unionByName(last)


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT, carry: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable) and kept (doc_id = component_id), for each row.

    Sets with a similarity of ``percent`` or more are linked. ``carry``, a struct made of each row, comes along as _row.
    """
    spark = docs.sparkSession
    ship(spark)
    work = Workspace(spark, "minhash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    schema, own, whole = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, sketch binary", [], rows
    if carry is not None:
        whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), carry.alias("_row"))
        schema, own = f"{schema}, _row {whole.schema['_row'].dataType.simpleString()}", ["_row"]
    sketched = work.save(whole.mapInArrow(_sketch_batches, schema), "sketched")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # classes of equal sets, each under its least doc_id; equal sets have equal sketches
    classes = sketched.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = work.save(classes, "classes")
    # rows that share a doc_id count as one node, whatever their texts: each of its sets is compared
    reps = classes.filter("rep is not null")
    parts = work.save(connected_components(_candidates(reps, work, percent, max(n, 24)), work, "candidates"), "parts")
    links = _verified(parts, rows, reps.groupBy(F.col("rep").alias("node")).agg(F.sum("size").alias("size")), work, percent, n)
    joined = connected_components(links, work, "joined")

    found = classes.join(joined, classes["rep"] == joined["node"], "left").select("set_key", F.coalesce("component", "rep").alias("_component"))
    out = sketched.select("doc_id", "n_shingles", "set_key", *own).join(found, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    out = work.save(out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), *own), "result")
    work.drop(*[name for name in list(work.paths) if name != "result"])
    return out


def deduplicate(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one with the least doc_id, with its own columns; repeated rows go too."""
    # one shuffle of the rows by one key serves the join and the removal of repeated rows; a null id has a key too
    key = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63)))
    kept = near_duplicates(docs, text, percent).filter("kept").select(key("doc_id").alias("_key")).distinct()
    rows = docs.select(key("doc_id").alias("_key"), F.struct(*docs.columns).alias("_row"))
    return rows.join(kept.hint("shuffle_merge"), "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
