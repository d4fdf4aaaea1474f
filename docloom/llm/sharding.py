"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters every record by seeded hashes into buckets sized to fit in memory; pass two draws a
Fisher-Yates permutation of each bucket (Spark's ``shuffle`` of an array is the inside-out form of it)
and gives each record its place.

The law that holds is ``key``: the shard is the one with the largest seeded hash of (key, shard), so one
more shard takes rows only into itself.

Edge cases: a null key hashes like any other value; null or empty texts count as 0 bytes; rows repeated in
full each get a slot of their own; an empty table gives an empty result; extra columns are carried through,
and those named like an output column are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.store import Workspace

SEED = 20_240_607
#: Bytes of text of a bucket, about, and the least cells of a shard that buckets are made of.
BUCKET_BYTES = 8 << 20
CELLS = 1 << 14
OUTPUTS = ("shard", "slot", "grown_shard", "bucket")


def _weight(key: str, seed: int, shard: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key), F.lit(shard))


def shard_of(key: str, n_shards: int, seed: int = SEED) -> Column:
    """The shard whose seeded hash of the key is largest (the first of equals)."""
    weights = F.array(*[_weight(key, seed, s) for s in range(n_shards)])
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def grown_shard_of(key: str, n_shards: int, seed: int = SEED) -> Column:
    """The shard of the same key once there are ``n_shards + 1`` of them."""
    most = F.array_max(F.array(*[_weight(key, seed, s) for s in range(n_shards)]))
    return F.when(_weight(key, seed, n_shards) > most, F.lit(n_shards)).otherwise(shard_of(key, n_shards, seed)).cast("int")


def external_shuffle(
    df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 24, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All columns of ``df`` plus shard, slot (gapless from 0 in each shard), grown_shard and bucket.

    A record's cell is its shard and a hash of its key and text; a bucket is a run of cells of one shard, as many as
    the bytes of ``text`` ask for. Equal keys with different texts spread over the buckets of their shard, so only rows
    that are equal in both can make a bucket larger than ``bucket_bytes``; its records are sorted with spilling, and
    only row numbers are ever held in an array.
    """
    spark = df.sparkSession
    work = Workspace(spark, "shards")
    df = df.drop(*OUTPUTS)

    def celled(rows: DataFrame, n_cells: int) -> DataFrame:
        return rows.withColumn("shard", shard_of(key, n_shards, seed)).withColumn("_cell", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key), F.col(text)), F.lit(n_cells)))

    # cells grow with the bytes: where there are more buckets than cells, they are counted again, finer
    n_cells, per_shard = 0, CELLS
    while per_shard > n_cells:
        n_cells = CELLS if not n_cells else 1 << (4 * per_shard - 1).bit_length()
        sized = celled(df.select(key, text), n_cells).withColumn("_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8)
        cells = work.save(sized.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.sum("_bytes").alias("_bytes")), f"cells{n_cells}")
        total = cells.agg(F.sum("_bytes")).first()[0] or 0
        per_shard = max(1, math.ceil(total / n_shards / bucket_bytes))
    bucket = F.col("shard") * F.lit(per_shard) + F.floor(F.col("_cell") * F.lit(float(per_shard)) / F.lit(float(n_cells))).cast("int")

    # The permutations: one row for each bucket, in a fixed place and order, so that a task run again draws the same.
    sizes = cells.withColumn("bucket", bucket).groupBy("shard", "bucket").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    places = n_shards * per_shard
    orders = (
        sizes.repartition(places, "bucket")
        .sortWithinPartitions("bucket")
        .select(F.col("bucket").alias("_bucket"), "_start", F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), seed).alias("_order"))
    )

    # both sides are dealt alike by bucket, to a stated number of tasks, so the records move once
    in_bucket = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 2), F.col(key)), F.col(key), F.crc32(F.coalesce(F.col(text), F.lit(""))))
    scattered = celled(df, n_cells).withColumn("bucket", bucket).drop("_cell").repartition(places, "bucket")
    numbered = scattered.withColumn("_rn", F.row_number().over(in_bucket))
    return (
        numbered.join(orders.hint("merge"), F.col("bucket") == F.col("_bucket"))
        .withColumn("slot", F.col("_start") + F.element_at("_order", F.col("_rn")))
        .withColumn("grown_shard", grown_shard_of(key, n_shards, seed))
        .drop("_bucket", "_start", "_order", "_rn")
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write the shards as Parquet folders ``shard=N``, each in order of slot."""
    shuffled.repartition("shard", "bucket").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
