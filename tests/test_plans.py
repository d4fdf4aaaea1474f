"""Plans, questions, a form and replies stated row by row."""

from pyspark.sql import functions as F

from docloom.operators import context as C
from docloom.operators import facts as L
from docloom.operators import lines as N
from docloom.operators import records as U
from plan_rows import ASKED, FORM, REPLIES, plan_rows, plan_tables

TRACK = "Định hướng chuyên ngành"


def test_course_records(spark):
    got = U.course_records(plan_rows(spark)).select("source", "semester", "code", "group", "track", "system", "credits").collect()
    assert sorted(tuple(r) for r in got) == [
        ("p1", 1, "01001", "Bắt buộc", "", "", 3.0), ("p1", 1, "01002", "Bắt buộc", "", "", 2.5), ("p1", 1, "01003", "Tự chọn", "", "", 2.0), ("p1", 1, "01004", "Tự chọn", "", "", 2.0),
        ("p1", 2, "01005", TRACK, "Chuyên ngành lạnh", "", 4.0), ("p1", 2, "01006", TRACK, "Chuyên ngành nhiệt", "", 4.0), ("p1", 2, "01007", TRACK, "", "Kỹ sư", 6.0), ("p2", 1, "01001", "Bắt buộc", "", "", 3.0),
    ]


def test_programs(spark):
    p = plan_tables(spark)[3]
    got = p.select("source", "n_semesters", "total_credits", "total_credits_engineer", "two_systems", "n_courses", "nganh", "chuyen_nganh", "khoa_hoc", F.size(F.filter("semesters", lambda s: s["mismatch"])).alias("n")).collect()
    assert {tuple(r) for r in got} == {("p1", 2, 11.0, 17.0, True, 7, "Kỹ thuật nhiệt", "Điện lạnh", "K50", 2), ("p2", 1, 2.0, 2.0, False, 1, "Công nghệ KT ô tô", "", None, 1)}


def test_semester_of(spark):
    asked = spark.createDataFrame(list(enumerate(ASKED)), "qid int, text string")
    assert [r.s for r in asked.orderBy("qid").select(L.semester_of(F.col("text")).alias("s")).collect()] == [1, None, None, 2, None, None]


def test_form(spark):
    got = N.parse_form(spark.createDataFrame(list(enumerate(FORM)), "ord int, line string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "A", "What is it?", "It is this.", "x | y"), (3, "B", "Q3", "A3", "")]


def test_replies(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(REPLIES)], "i int, context string, reply string").withColumn("o", C.citation_owners(F.col("context")))
    got = rows.select("i", C.repair_citations(F.col("reply"), F.col("o")).alias("reply"), C.is_refusal(F.col("reply"), F.col("o")).alias("refuses")).orderBy("i").collect()
    assert [r.reply for r in got] == ["Theo Điều 3 của Quy định A thì thế.", "Theo Điều 3 của Quy định C thì thế.", "Xem Quy định A mở rộng (Điều 7). Còn Điều 8 của Quy định A.", "Tài liệu không đề cập nội dung này."]
    assert [r.refuses for r in got] == [False, False, False, True]


def test_names_inside_questions(spark):
    """Names of any length from one letter on, at any letter; a question without names, empty and null ones; no names at all."""
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["k", "ky thuat", "ky thuat nhiet", "thuat", "nhiet dien", "x" * 300, "ky thuat"])], "source int, key string")
    texts = ["Kỹ thuật nhiệt điện", "thuat", "", None, "bao la", "a" + "x" * 400]
    asked = spark.createDataFrame(list(enumerate(texts)), "qid int, text string")
    folded = ["ky thuat nhiet dien", "thuat", "", "", "bao la", texts[5]]
    want = sorted((q, n.source) for q, f in enumerate(folded) for n in names.collect() if n.key in f)
    from docloom.functions import text as X

    assert sorted((r.qid, r.source) for r in L._held(asked, names, X.fold).collect()) == want
    assert L._held(asked, names.filter("false"), X.fold).count() == 0


def test_facts_are_joined_by_names_and_not_by_questions(spark):
    """Plans are read once and stored, and a text is made once for each name: few joins and no windows are left in the query."""
    from docloom.plans.catalogue import QUERIES

    plan = QUERIES["program_facts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") <= 8 and "Window" not in plan


def test_facts_of_year_nought(spark):
    """A semester below all is named as it is, not taken for none."""
    _, courses, totals, programs = plan_tables(spark)
    asked = spark.createDataFrame([(1, "Ngành Kỹ thuật nhiệt học kỳ 1 năm 0"), (2, "Ngành Kỹ thuật nhiệt có chương trình đào tạo gì")], "qid int, text string")
    got = {r.qid: r.facts for r in L.facts(asked, programs, courses, totals).collect()}
    assert "học kỳ -1" in got[1] and "học kỳ -1" not in got[2]


def _plan_of_query(spark, sf, name):
    from docloom.plans.catalogue import QUERIES

    return QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_plans_are_read_in_one_window(spark, sf):
    """Cells are squeezed once each, and what carries forward does so in one window of one order."""
    plan = _plan_of_query(spark, sf, "course_records")
    assert plan.count("Window [") == 1
    assert all(line.count("(?U)\\s+") <= 1 for line in plan.splitlines())


def test_programmes_are_summed_in_one_pass(spark, sf):
    """Plan rows are read once for semesters, courses and programmes; only metadata is joined, from rows that hold it."""
    plan = _plan_of_query(spark, sf, "program_rollup")
    assert plan.count("Window [") == 1 and plan.count("Join ") == 2


def test_forms_are_read_in_one_window(spark, sf):
    assert _plan_of_query(spark, sf, "form_parse").count("Window [") == 1


def test_programmes_without_their_semesters_collect_no_lists(spark, sf):
    """Only sums go on where the lists of semesters, tracks and systems are not asked for; their numbers stay."""
    assert "collect_list" not in _plan_of_query(spark, sf, "program_rollup")
    p = plan_tables(spark)[3]
    lists = F.size(F.filter("semesters", lambda s: s["mismatch"])).cast("long")
    assert p.filter(p.n_mismatch != lists).count() == 0 and {r[0] for r in p.select("n_mismatch").collect()} == {1, 2}


def test_rows_that_begin_with_a_number_may_be_headers(spark):
    """A first cell of digits opens nothing, but a header may stand behind it; the same row with other names is a course."""
    rows = [(0, "para", ["Học kỳ 1"]), (1, "row", ["1", "MÃ HP", "Tên học phần", "Số tín chỉ", "2,0"]), (2, "row", ["1", "HP1", "Toán", "2,0", ""]), (3, "row", ["2.1", "Chuyên ngành T1", "3,0"]), (4, "row", ["1", "HP2", "Lý", "3,0", ""])]
    got = U.course_records(spark.createDataFrame([("p", o, k, 9, c) for o, k, c in rows], "source string, ord long, kind string, table int, cells array<string>")).orderBy("ord").collect()
    assert [(r.code, r.track) for r in got] == [("HP1", ""), ("HP2", "Chuyên ngành T1")]
