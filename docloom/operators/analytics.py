"""Corpus analytics over course rows: totals, ranks, shares, set algebra, samples.

``courses``: program, semester, course, credits and what else a function names. All ties are broken by named columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def program_totals(courses: DataFrame, by: Sequence[str] = ("program",), amount: str = "credits") -> DataFrame:
    return courses.groupBy(*by).agg(F.sum(amount).alias("total"), F.count(F.lit(1)).alias("n_courses"))


def course_lists(courses: DataFrame, by: Sequence[str] = ("program", "semester"), item: str = "course", order: str = "course") -> DataFrame:
    """The items of each group in order, joined by commas."""
    items = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(item).cast("string").alias("v")))), lambda x: x["v"])
    return courses.groupBy(*by).agg(F.array_join(items, ", ").alias("items"))


def programs_of_course(courses: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """One row for each lower-cased name: the first spelling, and how many programmes teach it."""
    return courses.groupBy(F.lower(name).alias("key")).agg(
        F.min_by(name, order).alias("name"), F.count_distinct("program").alias("n_programs"), F.count(F.lit(1)).alias("n_rows"),
    )


def rank_by(rows: DataFrame, amount: str, tie: str, within: Sequence[str] = ()) -> DataFrame:
    """place (row number, ties broken) and rank (ties share) by amount, the largest first.

    Without ``within`` one task orders all rows: for tables of programmes, not of courses.
    """
    w = Window.partitionBy(*within)
    return rows.withColumn("place", F.row_number().over(w.orderBy(F.desc(amount), tie))).withColumn("rank", F.rank().over(w.orderBy(F.desc(amount))))


def extremes(rows: DataFrame, amount: str, tie: str) -> DataFrame:
    """The largest and the smallest row's tie column, in one pass without a global sort."""
    return rows.agg(F.min_by(tie, F.struct(-F.col(amount), F.col(tie))).alias("most"), F.min_by(tie, F.struct(F.col(amount), F.col(tie))).alias("least"))


def heaviest(totals: DataFrame, by: str = "program", slot: str = "semester", amount: str = "total") -> DataFrame:
    """The heaviest and lightest slot of each group; the first of equals."""
    return totals.groupBy(by).agg(
        F.min_by(slot, F.struct(-F.col(amount), F.col(slot))).alias("heaviest"), F.max(amount).alias("most"),
        F.min_by(slot, F.struct(F.col(amount), F.col(slot))).alias("lightest"), F.min(amount).alias("least"),
    )


def in_every(rows: DataFrame, item: str, group: str, digits: float = 1.0) -> DataFrame:
    """Relational division: items that occur in every group (or in a ``digits`` share of them).

    Pairs are made distinct first, so a hot item counts groups, not rows.
    """
    pairs = rows.select(item, group).distinct()
    n = pairs.agg(F.count_distinct(group).alias("_all"))
    counted = pairs.groupBy(item).agg(F.count(F.lit(1)).alias("n_groups"))
    return counted.crossJoin(F.broadcast(n)).filter(F.col("n_groups") >= F.col("_all") * digits).drop("_all")


def group_shares(courses: DataFrame, by: Sequence[str], kinds: dict[str, Column], amount: str = "credits") -> DataFrame:
    """Counts and sums of each kind of row, beside all."""
    out = [F.count(F.lit(1)).alias("n_all"), F.sum(amount).alias("sum_all")]
    for name, test in kinds.items():
        out += [F.count_if(test).alias(f"n_{name}"), F.sum(F.when(test, F.col(amount)).otherwise(0.0)).alias(f"sum_{name}")]
    return courses.groupBy(*by).agg(*out)


def year_of(semester: Column) -> Column:
    return (F.floor((semester - 1) / 2) + 1).cast("long")


def by_year(totals: DataFrame, by: str = "program", semester: str = "semester", amount: str = "total") -> DataFrame:
    return totals.groupBy(by, year_of(F.col(semester)).alias("year")).agg(F.sum(amount).alias("total"))


def cumulative(totals: DataFrame, by: str = "program", slot: str = "semester", amount: str = "total") -> DataFrame:
    """Running total up to each slot and what remains after it."""
    upto = Window.partitionBy(by).orderBy(slot).rowsBetween(Window.unboundedPreceding, 0)
    done, every = F.sum(amount).over(upto), F.sum(amount).over(Window.partitionBy(by))
    return totals.withColumn("done", done).withColumn("remaining", every - F.col("done"))


def histogram(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def largest_with_ties(rows: DataFrame, by: Sequence[str], amount: str) -> DataFrame:
    """All rows that have their group's largest amount, by an aggregate and a join: no sort of a group."""
    most = rows.groupBy(*by).agg(F.max(amount).alias(amount))
    return rows.join(most, [*by, amount], "left_semi")


def with_fallback(rows: DataFrame, test: Column, groups: DataFrame, by: str, value: str, text: str) -> DataFrame:
    """The values of the rows that pass, or the fallback text for groups without any."""
    return groups.join(rows.filter(test).select(by, value), by, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit(text)))


def deviation(totals: DataFrame, by: str = "program", amount: str = "total", margin: float = 1.0) -> DataFrame:
    """Distance from the group's mean, and whether it is above, below or about it."""
    gap = F.col(amount) - F.avg(amount).over(Window.partitionBy(by))
    return totals.withColumn("gap", gap).withColumn("band", F.when(F.col("gap") > margin, "above").when(F.col("gap") < -margin, "below").otherwise("about"))


def form_share(rows: DataFrame, by: str, form: str, amount: str) -> DataFrame:
    """Rows, share of the group's rows and sum, for each form in each group."""
    counted = rows.groupBy(by, form).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("sum"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def pairwise_sets(rows: DataFrame, group: str, item: str, slot: str | None = None, first: int = 5) -> DataFrame:
    """For each two groups (of a stated, small set of groups; in each slot): sizes of what is shared and of what only one has,
    with the first few of each, in order.

    Every group is one row with its sorted set, so pairs are of groups, never of items.
    """
    keys = [slot] if slot else []
    sets = rows.groupBy(group, *keys).agg(F.array_sort(F.collect_set(item)).alias("s"))
    a = sets.select(F.col(group).alias("a"), *keys, F.col("s").alias("sa"))
    b = sets.select(F.col(group).alias("b"), *keys, F.col("s").alias("sb"))
    pairs = (a.join(b, keys).filter("a < b") if keys else a.join(b, F.col("a") < F.col("b")))
    show = lambda c: F.array_join(F.slice(F.array_sort(c), 1, first), ",")
    both, only_a, only_b = F.array_intersect("sa", "sb"), F.array_except("sa", "sb"), F.array_except("sb", "sa")
    size = lambda c: F.size(c).cast("long")
    return pairs.select(*keys, "a", "b", size(both).alias("n_both"), size(only_a).alias("n_only_a"), size(only_b).alias("n_only_b"), show(both).alias("both"), show(only_a).alias("only_a"), show(only_b).alias("only_b"))


def stratified(rows: DataFrame, stratum: str, key: str, quotas: dict[str, int], seed: str = "7") -> DataFrame:
    """As many rows of each stratum as its quota says, in the order of seeded hashes."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key)
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(stratum) == name, F.lit(n)).otherwise(quota)
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= quota).drop("_r")


def distinct_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key; aggregated map-side, so a hot key moves one row from each task."""
    own = F.struct(*rows.columns)
    return rows.select(key.alias("_k"), F.col(order).alias("_o"), own.alias("_row")).groupBy("_k").agg(F.min_by("_row", "_o").alias("_row")).select("_row.*")


def counts(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def length_stats(rows: DataFrame, text: Column) -> DataFrame:
    from docloom.functions.text import word_count

    n = word_count(text)
    return rows.agg(F.floor(F.sum(n) / F.count(F.lit(1))).alias("avg_words"), F.min(n).alias("min_words"), F.max(n).alias("max_words"))


def fan_out(rows: DataFrame, templates: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Each row with each template, its {names} replaced by columns: template (from 0) and text."""
    made = []
    for t in templates:
        text = F.lit(t)
        for name, column in values.items():
            text = F.replace(text, F.lit("{" + name + "}"), F.col(column).cast("string"))
        made.append(text)
    return rows.select("*", F.posexplode(F.array(*made)).alias("template", "text"))


def variety(templates: dict[str, Sequence[str]]) -> tuple[int, int]:
    """Keys and variants in all."""
    return len(templates), sum(len(v) for v in templates.values())
