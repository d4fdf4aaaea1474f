"""Exact lookup of courses and programmes named in questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators.records import ELECTIVE
from docloom.tables import Workspace

# ---- fixed values: patterns over folded questions ----
STRONG = r"khung chuong trinh|chuong trinh (dao tao|hoc)|ke hoach dao tao|tien quyet|hoc ky\s*\d|nam thu\s*\d|nam \d"
WEAK = r"tin chi|mon hoc|hoc phan|hoc nhung gi"
HINT = r"\bnganh\b|chuyen nganh|khoa\s*\d|\bk\d{2}\b"
ASKS_PROGRAM = r"\bnganh\b|chuyen nganh|chuong trinh|toan khoa|ca khoa|ra truong|tot nghiep"
ASKS_COURSE = r"\bmon\b|\bmon hoc\b|hoc phan"
# ---- end of fixed values ----
# ---- fixed values: output wording ----
TRACK_OF = " — chuyên ngành "
ASSESSED_BY = ", đánh giá: "
COURSE_REQUIRES = ", học phần tiên quyết: "
CODE_IS = " (mã "
CREDITS_OF_GROUP = " tín chỉ, "
TRACKS_HEAD = "Học kỳ này có "
TRACKS_NAMED = " định hướng chuyên ngành LOẠI TRỪ NHAU ("
TRACKS_END = ") — sinh viên chỉ học MỘT định hướng, không cộng gộp cả hai."
SYSTEMS_ONLY = "Một số học phần chỉ dành cho hệ "
ELECTIVES_LISTED = "Nhóm tự chọn liệt kê "
ELECTIVES_NEEDED = " tín chỉ nhưng chỉ cần tích lũy "
CREDITS_END = " tín chỉ."
TRUE_TOTAL = "Vì vậy tổng tín chỉ THỰC PHẢI HỌC của học kỳ này là "
NOT_THE_SUM = ", KHÔNG phải tổng cộng của mọi học phần liệt kê."
REQUIRES = ", tiên quyết: "
IN_SEMESTER = ": học kỳ "
CREDITS_RAW = " tín chỉ ("
HAS_CODE = ", mã "
COURSE_NAMED = 'Học phần "'
COURSE_IN = '" có trong các chương trình sau:\n'
SEMESTER = "học kỳ "
PROGRAM_NAMED = "Chương trình: "
OF_COHORT = " (khoá "
OF_FACULTY = ", khoa "
WHOLE_LOAD = "Tổng khối lượng toàn khoá: "
CREDITS = " tín chỉ"
BACHELOR = " đối với hệ cử nhân, "
ENGINEER = " tín chỉ đối với hệ kỹ sư"
DIVIDED_IN = ", chia thành "
EACH_SEMESTER = " học kỳ.\nTín chỉ từng học kỳ: "
LIST_OF_SEMESTER = "\n\nDanh sách học phần học kỳ "
LIST_OF_PROGRAM = " của "
NO_DATA = "\n\nChương trình này không có dữ liệu học phần cho học kỳ "
WHOLE_CREDITS = " tín chỉ toàn khoá"
ENGINEER_HAS = " (hệ kỹ sư "
CREDITS_CLOSED = " tín chỉ)"
SEMESTERS_OF_COHORT = " học kỳ, khoá "
CATALOGUE = "Các ngành hiện CÓ kế hoạch đào tạo trong kho dữ liệu:\n"
NOTHING_ELSE = "\n\nNgoài các ngành trên, kho dữ liệu KHÔNG có kế hoạch đào tạo của ngành nào khác."
# ---- end of fixed values ----
LEAST_NAME = 8
#: Stands for no semester where rows are joined by it; no question can name it.
NO_SEMESTER = -100
#: Letters by which a name is looked up.
PREFIXES = (1, 2, 4, 8, 16)


def semester_of(question: Column) -> Column:
    """The absolute semester: with a year, its first or second; else the number given; null if none is."""
    q = X.fold(question)
    number = lambda p: F.nullif(F.regexp_extract(q, p, 1), F.lit("")).cast("int")
    sem, year = number(r"hoc ky\s*(\d{1,2})"), number(r"nam (?:thu\s*)?(\d)")
    return F.when(sem.isin(1, 2) & year.isNotNull(), (year - 1) * 2 + sem).otherwise(sem)


def program_label(name: Column, track: Column) -> Column:
    return F.when(F.coalesce(track, F.lit("")) != "", F.concat(name, F.lit(TRACK_OF), track)).otherwise(name)


def match_programs(questions: DataFrame, programs: DataFrame) -> DataFrame:
    """qid, source of the programmes whose folded name or track the question holds; the longest names only.

    Names are looked up by their first letters: no pairs of all questions and names.
    """
    names = programs.select("source", F.explode(F.array("nganh", "chuyen_nganh")).alias("n")).select("source", X.fold_name(F.col("n")).alias("key")).filter("key <> ''")
    return _longest(_held(questions, names, X.fold_name), ["qid", "source"])


def match_courses(questions: DataFrame, courses: DataFrame) -> DataFrame:
    """qid, source and ord of the courses of the longest folded name (8 letters at least) that the question holds."""
    names = _course_names(courses)
    return _best_name(questions, names).join(names, "key").select("qid", "source", "ord")


def _course_names(courses: DataFrame) -> DataFrame:
    return courses.select("source", "ord", X.fold(F.col("name")).alias("key")).filter(F.length("key") >= LEAST_NAME)


def _best_name(questions: DataFrame, names: DataFrame) -> DataFrame:
    """qid and the longest key; of equals the one that stands first. A key is looked up once, however many courses have it."""
    hits = _held(questions, names.groupBy("key").agg(F.min("ord").alias("ord")), X.fold)
    return hits.groupBy("qid").agg(F.max_by("key", F.struct(F.length("key"), -F.col("ord"))).alias("key"))


def _held(questions: DataFrame, names: DataFrame, fold) -> DataFrame:
    """qid and the rows of ``names`` whose key stands in the folded question, at any letter; each once for a question.

    A key is looked up by its first 1, 2, 4, 8 or 16 letters, as many as it has, and then compared whole with what the
    question has there. So a question of n letters gives at most 5 n rows, however many keys and lengths there are.
    """
    size = F.lit(PREFIXES[0])
    for n in PREFIXES[1:]:
        size = F.when(F.length("key") >= n, n).otherwise(size)
    known = names.filter("key <> ''").agg(F.max(F.length("key")).alias("_longest"), F.collect_set(size).alias("_sizes"))
    q = questions.select("qid", fold(F.col("text")).alias("_q")).filter("_q <> ''").crossJoin(F.broadcast(known)).filter("_longest > 0")
    starts = F.transform(F.sequence(F.lit(1), F.length("_q")), lambda i: F.substring(F.col("_q"), i, F.col("_longest")))
    found = q.select("qid", "_sizes", F.explode(F.array_distinct(starts)).alias("_at"))
    found = found.select("qid", "_at", F.explode("_sizes").alias("_n")).filter(F.length("_at") >= F.col("_n")).select("qid", "_at", F.left("_at", F.col("_n")).alias("_head"))
    keyed = names.filter("key <> ''").withColumn("_head", F.left("key", size))
    return found.join(keyed, "_head").filter(F.startswith("_at", "key")).select("qid", *names.columns).distinct()


def _longest(hits: DataFrame, columns: list[str]) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(F.length("key")))
    return hits.withColumn("_r", F.rank().over(order)).filter("_r = 1").select(*columns).distinct()


def is_curriculum(questions: DataFrame, programs: DataFrame, courses: DataFrame) -> DataFrame:
    """qid and asks: a strong sign, or a weak one with a hint, a programme or a course."""
    named = match_programs(questions, programs).select("qid").unionByName(match_courses(questions, courses).select("qid")).distinct().withColumn("_named", F.lit(True))
    q = X.fold(F.col("text"))
    asks = q.rlike(STRONG) | (q.rlike(WEAK) & (q.rlike(HINT) | F.coalesce("_named", F.lit(False))))
    return questions.join(named, "qid", "left").select("qid", asks.alias("asks"))


def course_line(name: str = "name") -> Column:
    """One course as a line of a list."""
    extra = F.concat(
        F.when(F.coalesce("assessment", F.lit("")) != "", F.concat(F.lit(ASSESSED_BY), F.col("assessment"))).otherwise(F.lit("")),
        F.when(F.coalesce("requires", F.lit("")) != "", F.concat(F.lit(COURSE_REQUIRES), F.col("requires"))).otherwise(F.lit("")),
    )
    return F.concat(F.lit("- "), F.col(name), F.lit(CODE_IS), F.col("code"), F.lit(", "), X.short_number(F.col("credits")), F.lit(CREDITS_OF_GROUP), F.lower("group"), extra, F.lit(")"))


def exclusive_note(courses: DataFrame, totals: DataFrame) -> DataFrame:
    """source, semester, note: tracks that exclude each other, systems, electives listed beyond what counts, the true total."""
    got = courses.groupBy("source", "semester").agg(
        F.sort_array(F.collect_set(F.nullif("track", F.lit("")))).alias("t"), F.sort_array(F.collect_set(F.nullif("system", F.lit("")))).alias("s"),
        F.sum(F.when(F.col("group") == ELECTIVE, F.col("credits")).otherwise(0.0)).alias("e"),
    ).join(totals.select("source", "semester", "elective", "total"), ["source", "semester"], "left")
    parts = F.array_compact(F.array(
        F.when(F.size("t") > 1, F.concat(F.lit(TRACKS_HEAD), F.size("t"), F.lit(TRACKS_NAMED), F.array_join("t", "; "), F.lit(TRACKS_END))),
        F.when(F.size("s") > 0, F.concat(F.lit(SYSTEMS_ONLY), F.array_join("s", ", "), F.lit("."))),
        F.when((F.col("elective") > 0) & (F.col("e") > F.col("elective")), F.concat(F.lit(ELECTIVES_LISTED), X.short_number(F.col("e")), F.lit(ELECTIVES_NEEDED), X.short_number(F.col("elective")), F.lit(CREDITS_END))),
        F.when(F.col("total") > 0, F.concat(F.lit(TRUE_TOTAL), X.short_number(F.col("total")), F.lit(NOT_THE_SUM))),
    ))
    return got.select("source", "semester", F.array_join(parts, " ").alias("note"))


def facts(questions: DataFrame, programs: DataFrame, courses: DataFrame, totals: DataFrame) -> DataFrame:
    """qid and facts: the block of exact data for each question that asks for any.

    programs: source, nganh, chuyen_nganh, khoa, loai_hinh, khoa_hoc, n_semesters, total_credits, total_credits_engineer,
    two_systems; courses and totals as in ``records``. Three branches: a named course in all its programmes; the programmes
    asked for, with the semester asked for; else the catalogue.
    """
    label = program_label(F.col("nganh"), F.col("chuyen_nganh"))
    work, names = Workspace(questions.sparkSession, "facts"), _course_names(courses)
    # one row for each question with what it names; a name of both kinds goes by the question's own words. Stored tables
    # look small where keys repeat, so that joins of questions are never broadcast
    where = match_programs(questions, programs).groupBy("qid").agg(F.sort_array(F.collect_set("source")).alias("_where"))
    named = questions.join(where.hint("merge"), "qid", "left").join(_best_name(questions, names).hint("merge"), "qid", "left")
    state = named.select("qid", X.fold(F.col("text")).alias("_q"), semester_of(F.col("text")).alias("sem"), "_where", "key", F.col("_where").isNotNull().alias("_p"), F.col("key").isNotNull().alias("_c"))
    state = state.filter(F.col("_q").rlike(STRONG) | (F.col("_q").rlike(WEAK) & (F.col("_q").rlike(HINT) | F.col("_p") | F.col("_c"))))
    both = F.col("_p") & F.col("_c")
    use_p = F.col("_p") & ~(both & ~F.col("_q").rlike(ASKS_PROGRAM) & F.col("_q").rlike(ASKS_COURSE))
    asked = work.save(state.select("qid", "sem", "_where", "key", use_p.alias("_p"), (F.col("_c") & ~use_p).alias("_c")), "asked")
    lines = lambda value, order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"]), "\n")

    # a text is made once for each name, or each set of programmes and semester, that is asked for
    by_name, by_program = asked.filter("_c").select("qid", "key"), asked.filter("_p").select("qid", "_where", F.coalesce("sem", F.lit(NO_SEMESTER)).alias("_sem"))
    rows = names.join(by_name.select("key").distinct(), "key").join(courses, ["source", "ord"]).join(programs.select("source", "nganh", "chuyen_nganh"), "source")
    extra = F.concat(
        F.when(F.coalesce("assessment", F.lit("")) != "", F.concat(F.lit(ASSESSED_BY), F.col("assessment"))).otherwise(F.lit("")),
        F.when(F.coalesce("requires", F.lit("")) != "", F.concat(F.lit(REQUIRES), F.col("requires"))).otherwise(F.lit("")),
    )
    line = F.concat(F.lit("- "), label, F.lit(IN_SEMESTER), F.col("semester"), F.lit(", "), X.short_number(F.col("credits")), F.lit(CREDITS_RAW), F.col("credits_raw"), F.lit("), "), F.lower("group"), F.lit(HAS_CODE), F.col("code"), extra)
    of_name = rows.groupBy("key").agg(F.min_by("name", F.struct("source", "ord")).alias("_name"), lines(line, ["source", "ord"]).alias("_l"))
    of_name = work.save(of_name.select("key", F.concat(F.lit(COURSE_NAMED), F.col("_name"), F.lit(COURSE_IN), F.col("_l")).alias("facts")), "names")
    of_course = by_name.join(of_name, "key").select("qid", "facts")

    by_semester = totals.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("semester", "total"))), lambda s: F.concat(F.lit(SEMESTER), s["semester"], F.lit(": "), X.short_number(s["total"]))), "; ").alias("_each"))
    head = F.concat(
        F.lit(PROGRAM_NAMED), label, F.lit(OF_COHORT), F.coalesce(F.nullif("khoa_hoc", F.lit("")), F.lit("?")), F.lit(OF_FACULTY), F.coalesce(F.nullif("khoa", F.lit("")), F.lit("?")), F.lit(", "), F.coalesce("loai_hinh", F.lit("")), F.lit(")\n"),
        F.lit(WHOLE_LOAD), X.short_number(F.col("total_credits")), F.lit(CREDITS),
        F.when(F.col("two_systems"), F.concat(F.lit(BACHELOR), X.short_number(F.col("total_credits_engineer")), F.lit(ENGINEER))).otherwise(F.lit("")),
        F.lit(DIVIDED_IN), F.col("n_semesters"), F.lit(EACH_SEMESTER), F.coalesce("_each", F.lit("")), F.lit("."),
    )
    listed = courses.groupBy("source", "semester").agg(lines(course_line(), ["ord"]).alias("_list")).join(exclusive_note(courses, totals), ["source", "semester"], "left")
    wanted = by_program.select("_where", "_sem").distinct().select("_where", "_sem", F.nullif("_sem", F.lit(NO_SEMESTER)).alias("sem"), F.explode("_where").alias("source"))
    found = wanted.join(programs, "source").join(by_semester, "source", "left")
    found = found.join(listed.withColumnRenamed("semester", "sem"), ["source", "sem"], "left")
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n"), F.col("note"))).otherwise(F.lit(""))
    detail = F.when(F.col("sem").isNull(), F.lit("")).when(F.col("_list").isNotNull(), F.concat(F.lit(LIST_OF_SEMESTER), F.col("sem"), F.lit(LIST_OF_PROGRAM), label, F.lit(":\n"), F.col("_list"), note)).otherwise(
        F.concat(F.lit(NO_DATA), F.col("sem"), F.lit("."))
    )
    blocks = found.groupBy("_where", "_sem").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source", F.concat(head, detail).alias("_v")))), lambda x: x["_v"]), "\n\n").alias("facts"))
    of_program = by_program.join(work.save(blocks, "programs"), ["_where", "_sem"]).select("qid", "facts")

    item = F.concat(
        F.lit("- "), label, F.lit(": "), X.short_number(F.col("total_credits")), F.lit(WHOLE_CREDITS),
        F.when(F.col("two_systems"), F.concat(F.lit(ENGINEER_HAS), X.short_number(F.col("total_credits_engineer")), F.lit(CREDITS_CLOSED))).otherwise(F.lit("")),
        F.lit(", "), F.col("n_semesters"), F.lit(SEMESTERS_OF_COHORT), F.coalesce(F.nullif("khoa_hoc", F.lit("")), F.lit("?")),
    )
    every = programs.agg(lines(item, ["source"]).alias("_l"))
    rest = asked.filter("not _p and not _c").crossJoin(F.broadcast(every))
    of_all = rest.select("qid", F.concat(F.lit(CATALOGUE), F.col("_l"), F.lit(NOTHING_ELSE)).alias("facts"))
    return of_course.unionByName(of_program).unionByName(of_all)
