"""The prefix trie of conversations, built level by level.

Turns are numbered in order and each is named by the SHA-256 of its role and text (equal names are taken for equal turns).
Conversations with one sequence of turns are one class: its least conv_id stands for it, and its members end at one node.

Down: at each depth the live classes are grouped by (parent node, next turn); a node's name is its depth and the least
conv_id of its members. A class that is alone in its node needs no more grouping: what it has left is a chain of nodes of
its own. So there are as many levels as two different conversations have turns in common, and one more.
Up: level by level, each node adds what its children say (leaves, savings) and the chain that hangs on it.

Skew: turns are numbered by ranges with counted offsets, never in one task for a conversation. Groups
with over a ``1 / HOT`` share of a level's classes are at most ``HOT`` and reach their members by a broadcast; all
others by a shuffled join. Savings along a chain are summed in blocks. SHA-256 over a class's members is sequential by
definition: the ids come to it in sorted chunks of ``CHUNK`` bytes, one task for a class, which keeps none of them.

Edge cases: rows without a conv_id belong to no conversation and are left out; null turns come first, equal turns are
ordered by role and text, repeated rows are turns of their own; null roles and texts are empty; a conversation may be left
without turns and ends at the root; an empty table gives an empty result, without a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.store import Workspace, ship
from docloom.operators.numbering import number_rows

FAMILY, HEADS = 5, 9
HOT, LEAST_HOT = 1024, 4096
CHUNK = 4096
BLOCK = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def numbered_turns(turns: DataFrame, work: Workspace) -> DataFrame:
    """conv_id, pos (from 1), key and size (UTF-8 bytes of the text) of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    keep = {"conv_id": F.col("conv_id"), "key": key, "size": F.octet_length("text").cast("long")}
    out = work.save(number_rows(rows, order, ("conv_id",), "pos", keep, work=work), "turns")
    work.drop("ranges-pos")
    return out


def rebuilt(turns: DataFrame, work: Workspace, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of conversations that share beginnings, as a branching corpus has them; and (conv_id, n_turns) of each.

    Conversation c takes the first h turns of conversation c - c % family, then its own after its first h;
    h = crc32(c in decimal) % heads.
    """
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    c = sizes.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    c = c.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    c = c.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("n_turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    c = work.save(c.select("conv_id", "base", "h", "taken", "n_turns"), "conversations")
    # a base has less than ``heads`` turns to give and a bounded family to give them to
    first = turns.filter(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "key", "size").join(c, "base").filter("pos <= h")
    own = turns.join(c.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").withColumn("pos", F.col("taken") + F.col("pos") - F.col("h"))
    out = first.select("conv_id", "pos", "key", "size").unionByName(own.select("conv_id", "pos", "key", "size"))
    return work.save(out, "rebuilt"), c.select("conv_id", "n_turns")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (name, conv_id) to runs of one name: name, first conv_id, n, decimal ids with commas between."""
    out: list[list] = [[], [], [], []]
    held: bytearray = bytearray()
    name, first, n = None, 0, 0

    def close() -> None:
        for column, x in zip(out, (name, first, n, bytes(held)), strict=True):
            column.append(x)

    def made() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["name", "first", "n", "ids"])
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        for x, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if n and (x != name or len(held) >= CHUNK):
                close()
                held.clear()
                n = 0
            if not n:
                name, first = x, c
            held += (b"," if held else b"") + b"%d" % c
            n += 1
        if out[0]:
            yield made()
    if n:
        close()
    yield made()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (name, first) to one row for each name: name, rep, n, ends_sha256."""
    names = ["name", "rep", "n", "ends_sha256"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
    name, rep, n, digest = None, 0, 0, None
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for x, first, some, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest is not None and x == name:
                digest.update(b",")
                n += some
            else:
                if digest is not None:
                    for column, v in zip(out, (name, rep, n, digest.hexdigest()), strict=True):
                        column.append(v)
                name, rep, n, digest = x, first, some, hashlib.sha256()
            digest.update(ids)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((name, rep, n, digest.hexdigest()), kinds, strict=True)], names)


def classes_of(turns: DataFrame, convs: DataFrame, work: Workspace) -> DataFrame:
    """One row for each distinct sequence of turns: rep (least conv_id), n (members), n_turns, ends_sha256 (over all members' ids).

    A sequence is named by its length and two exclusive ors of 64-bit hashes of (place, turn), so that turns never meet in one task.
    """
    hashed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "key")).alias(f"h{seed}")
    named = convs.join(turns.groupBy("conv_id").agg(hashed(1), hashed(2)), "conv_id", "left")
    name = F.unhex(F.sha2(F.concat_ws(":", "n_turns", "h1", "h2"), 256))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = work.save(named.select(name.alias("name"), "conv_id", "n_turns"), "named")
    chunks = named.select("name", "conv_id").repartitionByRange(parts, "name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(_chunks, "name binary, first bigint, n bigint, ids binary")
    digests = chunks.repartition(parts, "name").sortWithinPartitions("name", "first").mapInArrow(_digests, "name binary, rep bigint, n bigint, ends_sha256 string")
    digests = work.save(digests, "digests")
    lengths = named.join(digests.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").select(F.col("conv_id").alias("rep"), "n_turns")
    return work.save(digests.join(lengths, "rep").select("rep", "n", "n_turns", "ends_sha256"), "classes")


def _sum_after(rows: DataFrame, value: Column) -> DataFrame:
    """Rows (rep, pos) with ``saved``: the sum of ``value`` from their place to the end, in blocks of places."""
    rows = rows.withColumn("_v", value).withColumn("_block", F.floor(F.col("pos") / BLOCK))
    totals = rows.groupBy("rep", "_block").agg(F.sum("_v").alias("_t"))
    later = F.coalesce(F.sum("_t").over(Window.partitionBy("rep").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = totals.select("rep", "_block", later.alias("_later"))
    within = F.sum("_v").over(Window.partitionBy("rep", "_block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_within", within).join(later, ["rep", "_block"]).withColumn("saved", F.col("_within") + F.col("_later")).drop("_v", "_block", "_within", "_later")


def build(turns: DataFrame, convs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``turns`` (conv_id, pos from 1 without gaps, key, size) and ``convs`` (conv_id, n_turns) to one row for each node.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens: each node's
    (n_convs - 1) times the size of its last turn, over its subtree; ends_sha256 over the members that end in it.
    """
    spark = turns.sparkSession
    ship(spark)
    work = work or Workspace(spark, "trie")
    classes = classes_of(turns, convs, work)
    found = classes.agg(F.min("rep"), F.sum("n"), F.count(F.lit(1))).first()
    if not found[2]:
        return spark.createDataFrame([], NODES)
    # the turns of the classes' first members, ordered so that a level reads its own
    own = turns.join(classes.select(F.col("rep").alias("conv_id"), "n", "n_turns"), "conv_id").select(F.col("conv_id").alias("rep"), "pos", "key", "size", "n", "n_turns")
    own = work.save(own.sortWithinPartitions("pos"), "own")

    # down; level 0 is the root
    root = F.lit(found[0]).cast("long")
    top = spark.range(1).select(root.alias("conv_id"), F.lit(None).cast("long").alias("parent"), F.lit(found[1]).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("size"))
    levels = [top.join(classes.filter("n_turns = 0").select(root.alias("conv_id"), "ends_sha256"), "conv_id", "left")]
    live, chains = classes.filter("n_turns > 0").select("rep", root.alias("node")), None
    n_live, depth = found[2], 0
    while n_live:
        depth += 1
        rows = live.join(own.filter(F.col("pos") == depth), "rep").select("rep", "node", "key", "size", "n", "n_turns")
        groups = rows.groupBy("node", "key").agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.count(F.lit(1)).alias("n_classes"), F.max("size").alias("size"))
        groups = work.save(groups, f"groups{depth}")
        to, some = groups.select("node", "key", "conv_id", "n_classes"), max(LEAST_HOT, n_live // HOT)
        if n_live > some:
            few = F.broadcast(to.filter(F.col("n_classes") > some))  # at most HOT rows
            rest = rows.join(few.select("node", "key"), ["node", "key"], "left_anti").join(to.filter(F.col("n_classes") <= some).hint("shuffle_merge"), ["node", "key"])
            rows = rows.join(few, ["node", "key"]).unionByName(rest)
        else:
            rows = rows.join(to, ["node", "key"])
        members = work.save(rows.select("rep", "conv_id", "n_classes", "n_turns"), f"members{depth}")
        ended = members.filter(F.col("n_turns") == depth).select("conv_id", "rep").join(classes.select("rep", "ends_sha256"), "rep").select("conv_id", "ends_sha256")
        levels.append(groups.select("conv_id", F.col("node").alias("parent"), "n_convs", "size").join(ended, "conv_id", "left"))
        going = members.filter(F.col("n_turns") > depth)
        alone = going.filter("n_classes = 1").select("rep", F.lit(depth).cast("long").alias("start"))
        chains = alone if chains is None else chains.unionByName(alone)
        live = going.filter("n_classes > 1").select("rep", F.col("conv_id").alias("node"))
        n_live = live.count()

    # chains: each node has the class's members and one child, but for the last
    ends, tails = None, None
    if chains is not None:
        links = own.join(chains, "rep").filter("pos > start")
        links = work.save(_sum_after(links, (F.col("n") - 1) * F.col("size")), "chains")
        last = F.col("pos") == F.col("n_turns")
        done = links.filter(last).select("rep", "pos").join(classes.select("rep", "ends_sha256"), "rep")
        ends = links.select(
            F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        ).join(done.select(F.col("rep").alias("conv_id"), F.col("pos").alias("depth"), "ends_sha256"), ["conv_id", "depth"], "left")
        tails = links.filter(F.col("pos") == F.col("start") + 1).select(F.col("rep").alias("conv_id"), "start", F.col("saved").alias("tail"))

    # up
    out, below = ends, None
    for d in range(depth, -1, -1):
        at = levels[d]
        if tails is not None:
            at = at.join(tails.filter(F.col("start") == d).select("conv_id", "tail"), "conv_id", "left")
        else:
            at = at.withColumn("tail", F.lit(None).cast("long"))
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
            at = at.join(sums, "conv_id", "left")
        else:
            at = at.withColumns({k: F.lit(None).cast("long") for k in ("c", "l", "s")})
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        chained = F.when(F.col("tail").isNotNull(), 1).otherwise(0)
        below = work.save(
            at.select(
                "conv_id", "parent", "n_convs", (zero("c") + chained).cast("long").alias("n_children"), F.greatest(zero("l") + chained, F.lit(1)).cast("long").alias("n_leaves"),
                (zero("s") + zero("tail") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"), "ends_sha256",
            ), f"done{d}",
        )
        done = below.withColumn("depth", F.lit(d).cast("long")).withColumnRenamed("parent", "parent_conv_id")
        out = done if out is None else out.unionByName(done)
    columns = [c.split()[0] for c in NODES.split(", ")]
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(*columns)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    work = Workspace(turns.sparkSession, "trie")
    rows = numbered_turns(turns, work)
    return build(rows, rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")), work)


def rebuilt_trie(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """The trie of the conversations that ``rebuilt`` makes."""
    work = Workspace(turns.sparkSession, "trie")
    return build(*rebuilt(numbered_turns(turns, work), work, family, heads), work)
