"""Gapless numbers in an order, without a window that holds all rows (or all rows of a hot group) in one task.

Rows are dealt out by ranges of the order and sorted there; a row's place in its range, less the place where its group
begins there, plus the counts of the group in the ranges before is its number. A range is a bounded share of the
rows, whatever the groups are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.tables import Workspace


def number_rows(
    rows: DataFrame, order: list[Column], by: tuple[str, ...] = (), name: str = "number", keep: dict[str, Column] | None = None,
    parts: int | None = None, work: Workspace | None = None,
) -> DataFrame:
    """``rows`` with their number from 1 in ``order``, within the values of ``by``.

    ``keep`` names the columns that go on (by default all), so that those which only the order needs move once. Rows
    that are equal in the order get their numbers in any order; null keys of ``by`` are one group; an empty table gives an
    empty result. The ranges are written once, since a second sampling of them could fall otherwise.
    """
    work = work or Workspace(rows.sparkSession, "numbers")
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = keep or {c: F.col(c) for c in rows.columns}
    keys = [F.col(k) for k in by]
    dealt = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    dealt = work.save(dealt.select(*[c.alias(k) for k, c in keep.items()], *own, "_at", F.shiftright("_at", 33).alias("_range")), f"ranges-{name}")
    # one row for each range and group; without groups as many rows as ranges
    groups = [c for c in dealt.columns if c.startswith("_k")]
    starts = dealt.groupBy(*groups, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select(*[F.col(g).alias(f"{g}s") for g in groups], F.col("_range").alias("_r"), (before - F.col("_first") + 1).alias("_shift"))
    same = F.col("_range") == F.col("_r")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}s"))
    return dealt.join(starts, same).select(*keep, (F.col("_at") + F.col("_shift")).cast("long").alias(name))
