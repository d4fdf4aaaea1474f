"""Course records and programmes from rows of plan tables.

A plan is a sequence of paragraphs and table rows, in order; what a row means depends on the last semester, group,
track and degree system above it. These carry forward by windows over each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

# ---- fixed values ----
PLAN_FILE = r"(?iu)(k\d{2}|ke-hoach|khung.?ch[uư]?[oơ]ng.?tr[iì]nh)"
HEADER_CELLS = ("tt", "mã hp", "ma hp", "tên học phần", "ten hoc phan", "số tín chỉ", "so tin chi", "hptq", "ktđg", "ktdg")
GROUPS = {"bắt buộc": "Bắt buộc", "tự chọn": "Tự chọn"}
FOR_SYSTEM = "dành cho hệ đào tạo"
SYSTEMS = {"cử nhân": "Cử nhân", "kỹ sư": "Kỹ sư"}
SEMESTER = r"(?iuU)H[oọ]c\s*k[yỳ]\s*(\d{1,2})"
META = {"ngành:": "nganh", "chuyên ngành:": "chuyen_nganh", "khoa:": "khoa", "loại hình đào tạo:": "loai_hinh"}
REQUIRED, ELECTIVE, TRACK = "Bắt buộc", "Tự chọn", "Định hướng chuyên ngành"
# ---- end of fixed values ----


def is_plan(name: Column) -> Column:
    return name.rlike(PLAN_FILE) & F.lower(name).endswith(".docx")


def collapse(cells: Column) -> Column:
    """Neighbouring equal cells count once."""
    return F.filter(cells, lambda c, i: (i == 0) | (c != F.get(cells, i - 1)))


def blank_merged(cells: Column) -> Column:
    """A cell equal to the one on its left is emptied."""
    return F.transform(cells, lambda c, i: F.when((i > 0) & (c == F.get(cells, i - 1)), F.lit("")).otherwise(c))


def is_header(cells: Column) -> Column:
    return _has_headers(F.transform(cells, lambda c: F.lower(X.strip(c))))


def _has_headers(cells: Column, low=lambda c: c) -> Column:
    return (F.size(cells) >= 3) & (F.size(F.filter(cells, lambda c: low(c).isin(*HEADER_CELLS))) >= 3)


def credit(text: Column) -> Column:
    """The leading number, comma or point."""
    return F.expr("cast(null as double)") if text is None else F.nullif(F.regexp_extract(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit(".")), r"^\s*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def classify(cells: Column) -> Column:
    """struct(kind, name, credits) of a row that opens a group, system or track; kind is null for others."""
    cells = F.transform(cells, X.strip)
    opened = opening(cells, F.transform(cells, F.lower))
    return F.struct(opened["kind"].alias("kind"), opened["name"].alias("name"), credit(opened["amount"]).alias("credits"))


def opening(cells: Column, low: Column) -> Column:
    """struct(kind, name, amount) from cells without space at their ends and these in lower case, the amount as written; null for a row that opens nothing."""
    a, b, c = (F.coalesce(F.get(cells, i), F.lit("")) for i in (0, 1, 2))
    opens = lambda kind, name, amount: F.struct(F.lit(kind).alias("kind"), name.alias("name"), amount.alias("amount"))

    def labelled(i: int, amount: Column) -> list[tuple[Column, Column]]:
        label = F.get(low, i)
        out = [(label == k, opens("group", F.lit(v), amount)) for k, v in GROUPS.items()]
        return out + [(label.contains(FOR_SYSTEM) & label.rlike(rf"(?U){FOR_SYSTEM}\s*{k}"), opens("system", F.lit(v), amount)) for k, v in SYSTEMS.items()]

    track_at_1 = opens("track", b, c)
    tests = [*labelled(0, b), (a.rlike(r"^\d+\.\d+$") & (b != "") & ~b.rlike(r"^\s*0?\d{4,6}\s*$"), track_at_1)]
    tests += [((a == "") & t, v) for t, v in [(b.rlike(r"(?iuU)^\s*chuyên ngành\b"), track_at_1), *labelled(1, c)]]
    out = F.lit(None).cast("struct<kind:string,name:string,amount:string>")
    for test, value in reversed(tests):
        out = F.when(test, value).otherwise(out)
    return out


def read_rows(rows: DataFrame) -> DataFrame:
    """Adds semester, group, track, system, kind and the collapsed cells to plan rows (source, ord, kind, cells).

    ``course_records``, ``semester_totals`` and ``programs`` take these rows in place of plan rows, so that a caller of several
    can store them and have plans read once.
    """
    if "label" in rows.columns:
        return rows
    # each step has columns of its own: what a lambda refers to is computed anew for each element
    df = rows.select("source", "ord", F.col("kind").alias("block"), F.transform("cells", lambda c: X.squeeze(F.coalesce(c, F.lit("")))).alias("cells"))
    df = df.withColumn("cells", F.when(F.col("block") == "row", collapse(F.col("cells"))).otherwise(F.col("cells")))
    df = df.withColumn("_open", (F.col("block") == "row") & ~_has_headers(F.col("cells"), F.lower))
    # a first cell of digits alone, as courses have, opens nothing; squeezed cells hold no line ends, so all are lowered as one text
    number = F.coalesce(F.get("cells", 0), F.lit("")).rlike("^[0-9]+$")
    df = df.withColumn("_low", F.when(~number, F.split(F.lower(F.array_join("cells", "\n")), "\n", -1)))
    first = F.coalesce(F.get("_low", 0), F.lit(""))
    para = F.when(F.col("block") == "para", F.regexp_extract(F.array_join("cells", " "), SEMESTER, 1))
    named = F.when(F.col("_open") & first.startswith("h"), F.regexp_extract(first, "^" + SEMESTER, 1))  # few cells begin so
    df = df.withColumn("_new", F.nullif(F.coalesce(F.nullif(para, F.lit("")), named), F.lit("")).cast("int"))
    begins = F.col("_new").isNotNull()
    df = df.withColumn("_open", F.col("_open") & ~begins)
    df = df.withColumn("_opened", F.when(F.col("_open") & F.col("_low").isNotNull(), opening(F.col("cells"), F.col("_low"))))
    kind, name = F.col("_opened.kind"), F.col("_opened.name")
    # a semester resets all; a group resets the track and keeps the system; a system resets the track; a track sets the group
    group = F.when(begins, F.lit(REQUIRED)).when(kind == "group", name).when(kind == "track", F.lit(TRACK))
    track = F.when(begins, F.lit("")).when(kind == "track", name).when(kind.isin("group", "system"), F.lit(""))
    system = F.when(begins, F.lit("")).when(kind == "system", name)
    upto = Window.partitionBy("source").orderBy("ord")
    df = df.withColumns({n: F.last(c, True).over(upto) for n, c in (("semester", F.col("_new")), ("group", group), ("track", track), ("system", system))})
    inside = F.col("semester").isNotNull()
    within = lambda c, default: F.when(inside, F.col(c)).otherwise(F.lit(default)).alias(c)
    label = F.struct(kind.alias("kind"), name.alias("name"), credit(F.col("_opened.amount")).alias("credits"))
    return df.select(
        "source", "ord", "block", "cells", "semester", F.when(inside, label).alias("label"), (F.col("_open") & inside).alias("_row"),
        within("group", REQUIRED), within("track", ""), within("system", ""),
    )


def _is_total(cells: Column) -> Column:
    low = F.lower(F.coalesce(F.get(cells, 0), F.lit("")))
    return low.startswith("tổng") | low.startswith("tong")


def _course() -> Column:
    """Whether a row that was read is a course."""
    return F.col("label.kind").isNull() & ~_is_total(F.col("cells")) & (F.size("cells") >= 4) & (F.get("cells", 1) != "") & credit(F.get("cells", 3)).isNotNull()


def course_records(rows: DataFrame) -> DataFrame:
    """One row for each course: source, ord, semester, group, track, system, code, name, credits, credits_raw, requires, assessment."""
    df = read_rows(rows).filter(F.col("_row") & _course())
    cell = lambda i: F.coalesce(F.get("cells", i), F.lit(""))
    return df.select(
        "source", "ord", "semester", "group", "track", "system", cell(1).alias("code"), cell(2).alias("name"), credit(cell(3)).alias("credits"),
        cell(3).alias("credits_raw"), cell(4).alias("requires"), cell(5).alias("assessment"),
    )


def _semesters(rows: DataFrame) -> DataFrame:
    """``semester_totals`` of all semesters with a course too: _marks counts the rows that declare something, _n the courses."""
    df = read_rows(rows).filter("_row")
    raw = F.coalesce(F.get("cells", 1), F.lit(""))
    pair = lambda i: F.nullif(F.replace(F.regexp_extract(raw, r"^\s*(\d+(?:[.,]\d+)?)\s*/\s*(\d+(?:[.,]\d+)?)", i), F.lit(","), F.lit(".")), F.lit("")).cast("double")
    total = F.col("label.kind").isNull() & _is_total(F.col("cells"))
    course = F.when(_course(), credit(F.get("cells", 3)))
    df = df.select("source", "semester", "ord", "group", "system", "label.kind", "label.name", F.col("label.credits").alias("n"), total.alias("_is"), F.when(total, pair(1)).alias("_one"), F.when(total, pair(2)).alias("_two"), F.when(total, credit(raw)).alias("_raw"), course.alias("_course"))
    kind, name, n = F.col("kind"), F.col("name"), F.col("n")
    mark = kind.isNotNull() | F.col("_is")
    latest = lambda test, value: F.max_by(F.when(test, value), F.when(test & value.isNotNull(), F.col("ord")))
    named = lambda k: F.sort_array(F.collect_list(F.when((kind == k) & n.isNotNull(), F.struct("ord", name.alias("name"), n.alias("credits")))))
    got = df.filter(mark | F.col("_course").isNotNull()).groupBy("source", "semester").agg(
        latest(F.col("_is"), F.coalesce("_one", "_raw")).alias("_total"), latest(F.col("_is"), F.col("_one")).alias("total_bachelor"), latest(F.col("_is"), F.col("_two")).alias("total_engineer"),
        latest((kind == "group") & (name == REQUIRED), n).alias("required"), latest((kind == "group") & (name == ELECTIVE), n).alias("elective"), named("track").alias("_tracks"), named("system").alias("_systems"),
        F.coalesce(F.sum(F.when((F.col("group") == REQUIRED) & (F.col("system") == ""), F.col("_course"))), F.lit(0.0)).alias("listed_required"), F.count_if(mark).alias("_marks"), F.count("_course").alias("_n"),
    )
    plain = lambda c: F.transform(c, lambda x: F.struct(x["name"].alias("name"), x["credits"].alias("credits")))
    return got.select(
        "source", "semester", F.coalesce("_total", F.coalesce("required", F.lit(0.0)) + F.coalesce("elective", F.lit(0.0))).alias("total"),
        "required", "elective", "total_bachelor", "total_engineer", F.col("_total").isNull().alias("inferred"), "listed_required",
        F.coalesce(F.abs(F.col("listed_required") - F.col("required")) > 0.01, F.lit(False)).alias("mismatch"), plain("_tracks").alias("tracks"), plain("_systems").alias("systems"), "_marks", "_n",
    )


def semester_totals(rows: DataFrame) -> DataFrame:
    """source, semester and what the plan declares: total, required, elective, both systems' totals, inferred, listed, mismatch, systems, tracks."""
    return _semesters(rows).filter("_marks > 0").drop("_marks", "_n")


def metadata(rows: DataFrame, tables: int = 4, sources: DataFrame | None = None) -> DataFrame:
    """source and the labelled values of the first tables (table, ord, cells), the first of each kind; cohort from paragraphs.

    ``sources`` has a row for each source that is asked for, and keeps its columns; without it all sources of ``rows`` are.
    """
    cells = F.transform("cells", lambda c: X.squeeze(F.coalesce(c, F.lit(""))))
    cells = rows.filter((F.col("kind") == "row") & (F.col("table") < tables)).select("source", "ord", cells.alias("c"))
    first = lambda label: F.get(F.filter("c", lambda t: F.lower(t).startswith(label)), 0)
    cells = cells.select("source", "ord", *[X.strip(F.substring(first(label), len(label) + 1, 1 << 20)).alias(name) for label, name in META.items()])
    found = cells.groupBy("source").agg(*[F.coalesce(F.min_by(n, F.when(F.col(n).isNotNull(), F.col("ord"))), F.lit("")).alias(n) for n in META.values()])
    para = rows.filter(F.col("kind") == "para").select("source", "ord", F.regexp_extract(F.array_join("cells", " "), r"(?iuU)KHO[AÁ]\s*(\d+)", 1).alias("k"))
    cohort = para.filter("k <> ''").groupBy("source").agg(F.concat(F.lit("K"), F.min_by("k", "ord")).alias("khoa_hoc"))
    sources = rows.select("source").distinct() if sources is None else sources
    return sources.join(found, "source", "left").join(cohort, "source", "left").na.fill("", list(META.values()))


def programs(rows: DataFrame) -> DataFrame:
    """One row for each plan: totals over semesters, whether it has two systems, numbers of courses and of semesters with a mismatch, semesters as a nested array.

    Callers that leave out ``semesters`` have no lists collected, of semesters nor of tracks and systems in them.
    """
    each = _semesters(rows)
    told = F.col("_marks") > 0
    of = lambda c: F.when(told, c)
    fields = [c for c in each.columns if c not in ("source", "_marks", "_n")]
    got = each.groupBy("source").agg(
        F.count_if(told).alias("n_semesters"), F.sum(of(F.col("total"))).alias("total_credits"), F.sum(of(F.coalesce("total_engineer", "total"))).alias("total_credits_engineer"),
        F.max(of(F.col("total_engineer").isNotNull())).alias("two_systems"), F.sort_array(F.collect_list(of(F.struct(*fields)))).alias("semesters"), F.sum("_n").alias("n_courses"), F.count_if(told & F.col("mismatch")).alias("n_mismatch"),
    )
    return got.filter("n_semesters > 0")
