"""Calibration and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as X


def class_separation(scored: DataFrame, score: str, inside: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Least score inside, most outside, and whether a threshold parts them."""
    got = scored.groupBy(*by).agg(F.min(F.when(inside, F.col(score))).alias("min_inside"), F.max(F.when(~inside, F.col(score))).alias("max_outside"))
    return got.withColumn("separable", F.col("min_inside") > F.col("max_outside"))


def gate_errors(probed: DataFrame, inside: Column, passed: str = "relevant") -> DataFrame:
    """Rows that should pass and do not, and that should not and do."""
    return probed.agg(F.count_if(inside & ~F.col(passed)).alias("false_rejects"), F.count_if(~inside & F.col(passed)).alias("pass_throughs"), F.count(F.lit(1)).alias("n"))


def upper_median(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The value at place n div 2 (from 0) of the sorted values, and the largest.

    Each distinct value is one row with its count before any are brought together, so a group's task holds its
    distinct values only.
    """
    from pyspark.sql import Window

    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    upto = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("_upto", upto).withColumn("_half", F.floor(F.sum("_n").over(w) / 2))
    return placed.groupBy(*by).agg(F.min(F.when(F.col("_upto") > F.col("_half"), F.col(value))).alias("median"), F.max(value).alias("most"))


def reply_metrics(reply: Column, titles: list[str]) -> Column:
    """struct(words, cites, leaks): length, whether a title is named, whether Han letters or thoughts leak."""
    named = F.lit(False)
    for t in titles:
        named = named | F.contains(reply, F.lit(t))
    return F.struct(X.word_count(reply).alias("words"), named.alias("cites"), (X.has_han(reply) | F.contains(reply, F.lit("<think>"))).alias("leaks"))
