"""Line-level operators: page splitting, repeated headers and footers, the question form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

PAGE_MARK = r"<<<PAGE \d+>>>"
#: Longest line that can be a header or footer, and the least number of parts of a text for the step to apply.
SHORT_LINE, LEAST_PARTS = 80, 4


def split_pages(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """key, page (from 0; what precedes the first mark counts) and text."""
    return docs.select(key, F.posexplode(F.split(text, PAGE_MARK, -1)).alias("page", "text"))


def _lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?|\n$", "\n"), "\n", -1)


def boilerplate_lines(pages: DataFrame, key: str = "source", share: float = 0.5) -> DataFrame:
    """key and line: short lines on at least ``share`` of the parts of a text (two at least)."""
    parts = pages.groupBy(key).agg(F.count(F.lit(1)).alias("_parts")).filter(F.col("_parts") >= LEAST_PARTS)
    lines = pages.select(key, "page", F.explode(_lines(F.col("text"))).alias("line")).select(key, "page", X.strip(F.col("line")).alias("line"))
    lines = lines.filter((F.col("line") != "") & (F.length("line") <= SHORT_LINE)).distinct()
    counted = lines.groupBy(key, "line").agg(F.count(F.lit(1)).alias("_n"))
    floor = F.greatest(F.lit(2), F.floor(F.col("_parts") * share))
    return counted.join(parts, key).filter(F.col("_n") >= floor).select(key, "line")


def strip_boilerplate(docs: DataFrame, key: str = "source", text: str = "text", share: float = 0.5) -> DataFrame:
    """key and text without page marks and repeated lines.

    The kept lines come together again in order, one text in one row as it came.
    """
    pages = split_pages(docs, key, text)
    bad = boilerplate_lines(pages, key, share).groupBy(key).agg(F.collect_set("line").alias("_bad"))
    none = F.expr("cast(array() as array<string>)")
    joined = pages.join(bad, key, "left")
    kept = F.filter(_lines(F.col("text")), lambda s: ~F.array_contains(F.coalesce("_bad", none), X.strip(s)))
    page = joined.select(key, F.struct("page", F.array_join(kept, "\n").alias("t")).alias("p"))
    return page.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "\n").alias("text"))


#: Labels of the form's fields, in the order they are tried.
FORM_LABELS = (
    ("category", r"(?iuU)^\s*Chủ\s*đề\s*:\s*(.*)$"),
    ("question", r"(?iuU)^\s*Câu\s*hỏi\s*:\s*(.*)$"),
    ("answer", r"(?iuU)^\s*Đáp\s*án\s*:\s*(.*)$"),
    ("source", r"(?iuU)^\s*Tài\s*liệu\s*tham\s*(?:khảo|chiếu)\s*:\s*(.*)$"),
)


def parse_form(lines: DataFrame, order: str = "ord", line: str = "line", form: str | None = None) -> DataFrame:
    """item, category, question, answer and source of each item of a form given line by line.

    A line "Câu N" begins an item; a label begins a field; other lines go on with the open one. Items without a
    question or an answer go. ``form`` names a column whose forms are parsed apart; without it the lines are one form
    and so meet in one task.
    """
    keys = [form] if form else []
    df = lines.select(*keys, F.col(order).alias("_o"), X.strip(F.col(line)).alias("_t"))
    df = df.filter((F.col("_t") != "") & ~F.col("_t").rlike("^[_\\-—•]+$"))
    label, value = F.lit(None).cast("string"), F.col("_t")
    for name, pattern in reversed(FORM_LABELS):
        hit = F.col("_t").rlike(pattern)
        label = F.when(hit, F.lit(name)).otherwise(label)
        value = F.when(hit, X.strip(F.regexp_extract("_t", pattern, 1))).otherwise(value)
    df = df.select(*keys, "_o", F.col("_t").rlike(r"(?iuU)^\s*Câu\s+\d+\s*$").alias("_begins"), label.alias("_label"), value.alias("_value"))
    # one window for both: a line that begins an item leaves no field open
    upto = Window.partitionBy(*keys).orderBy("_o")
    open_ = F.when(F.col("_begins"), F.struct(F.lit(None).cast("string").alias("f"))).when(F.col("_label").isNotNull(), F.struct(F.col("_label").alias("f")))
    df = df.withColumns({"item": F.sum(F.col("_begins").cast("long")).over(upto), "_field": F.last(open_, True).over(upto)["f"]})
    df = df.filter((F.col("item") > 0) & ~F.col("_begins") & F.col("_field").isNotNull() & (F.col("_value") != "") & ~((F.col("_field") == "category") & F.col("_label").isNull()))
    # a later label of the same field replaces what it held, if it has a value of its own
    fields = df.groupBy(*keys, "item", "_field").agg(F.sort_array(F.collect_list(F.struct("_o", "_value"))).alias("_all"), F.max(F.when(F.col("_label").isNotNull(), F.col("_o"))).alias("_top"))
    texts = F.transform(F.filter("_all", lambda x: F.col("_top").isNull() | (x["_o"] >= F.col("_top"))), lambda x: x["_value"])
    fields = fields.select(*keys, "item", "_field", texts.alias("_texts"))
    fields = fields.select(*keys, "item", "_field", F.array_join("_texts", " ").alias("_plain"), F.array_join("_texts", " | ").alias("_bars"))
    pick = lambda name, c: F.coalesce(F.max(F.when(F.col("_field") == name, F.col(c))), F.lit("")).alias(name)
    out = fields.groupBy(*keys, "item").agg(pick("category", "_plain"), pick("question", "_plain"), pick("answer", "_plain"), pick("source", "_bars"))
    return out.filter("question <> '' and answer <> ''")
