"""Composed answers: wordings, gates, skipped questions, refusals, streams with repaired citations, table OCR."""

from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import answers as P
from docloom.sources import files
from docloom.streaming import answers as S

HITS = "qid int, rank int, title string, article string, text string, score double, rerank_score double"


def test_quotes_and_answers(spark):
    rows = [
        (1, 1, "A", "Điều 3", "Điều 3. Một  hai\nba", 0.4, None), (1, 2, "A", "Điều 3", "bỏ qua", 0.1, None), (1, 3, "B", None, "xa", 0.1, None),
        (2, 1, "A", None, "w " * 400, 0.1, 0.5), (2, 2, "B", "", "v " * 200, 0.1, 0.4),
        (3, 1, "A", None, "không đạt", 0.1, None), (4, 2, "A", None, "không có hạng một", 0.9, None), (5, 1, "A", "Điều 1", None, None, 0.9),
    ]
    hits = spark.createDataFrame(rows, HITS)
    quotes = {r.qid: (r.quote, r.refs) for r in P.quote_for(hits).collect()}
    assert quotes[1] == ("Theo A (Điều 3): Một hai ba", "Điều 3 — A | B") and set(quotes) == {1, 2, 5}
    assert quotes[2][0] == "Theo A: " + " ".join(["w"] * 110) + "..." and quotes[5][0] == "Theo A (Điều 1): "
    made = {r.qid: r.answer for r in P.answer_from_top(hits).collect()}
    assert set(made) == {1, 2, 3, 5} and "Bên cạnh đó" not in made[1]
    assert made[2].startswith("Theo A, quy định như sau: w w") and " Bên cạnh đó, B cũng quy định: " + " ".join(["v"] * 120) + "... Em nên" in made[2]
    asked = spark.createDataFrame([(2, "c", "q2"), (1, "c", "q1"), (3, "c", "q3"), (9, "c", "q9")], "qid int, category string, question string")
    found, skipped = P.faq(asked, hits)
    assert [(r.id, r.question) for r in found.orderBy("id").collect()] == [(1, "q1"), (2, "q2")]
    assert sorted(r.qid for r in skipped.collect()) == [3, 9]
    facts = spark.createDataFrame([(3, "x"), (3, "y"), (7, "z"), (1, ""), (2, None)], "qid int, facts string")
    got = {r.qid: (r.has_facts, r.relevant) for r in P.gate_or_facts(hits, facts).collect()}
    assert got[3] == (True, True) and got[7] == (True, True) and got[1] == (False, True) and got[2] == (False, True)
    assert P.quote_for(hits.limit(0)).count() == 0 and P.answer_from_top(hits.limit(0)).count() == 0


def test_breakdown_wording(spark):
    rows = [
        ("p", 1, 3, "Toán", 3.0, "Bắt buộc", "", ""), ("p", 2, 3, "Lý", 2.5, "Bắt buộc", "", ""), ("p", 3, 3, "Lạnh", 4.0, "Định hướng chuyên ngành", "N1", ""),
        ("p", 4, 3, "Đồ án", 6.0, "Bắt buộc", "", "Kỹ sư"), ("p", 5, 4, "Khóa luận", 6.0, "Tự chọn", None, None),
    ]
    courses = spark.createDataFrame(rows, "source string, ord int, semester int, name string, credits double, group string, track string, system string")
    totals = spark.createDataFrame([("p", 3, 15.5, 11.5, True)], "source string, semester int, total double, required double, mismatch boolean")
    got = {r.semester: r.sentence for r in P.breakdown(courses, totals, spark.createDataFrame([("p", "Nhiệt")], "source string, label string")).collect()}
    assert got[3] == (
        "Học kỳ 3 (học kỳ 1 năm thứ 2) ngành Nhiệt có 2 học phần bắt buộc, cộng lại 5.5 tín chỉ: Toán (3 tín chỉ); Lý (2.5 tín chỉ). "
        "Ngoài ra kỳ này có 1 định hướng chuyên ngành để chọn MỘT: N1 (4 tín chỉ, 1 học phần). Hệ kỹ sư học 1 học phần riêng (6 tín chỉ): Đồ án (6 tín chỉ). "
        'Lưu ý: kế hoạch đào tạo ghi ở dòng "Bắt buộc" là 11.5 tín chỉ — con số này đã gộp cả phần định hướng hoặc phần dành riêng cho hệ kỹ sư, nên em căn theo tổng 15.5 tín chỉ của cả học kỳ.'
    )
    assert got[4] == "Học kỳ 4 (học kỳ 2 năm thứ 2) ngành Nhiệt không có học phần bắt buộc chung, vì kỳ này chia riêng theo hệ đào tạo."


def test_comparison_of_equal_and_empty_programmes(spark):
    courses = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), ("b", "x")], "source string, name string")
    programs = spark.createDataFrame([("a", "A", 10.0, 2), ("b", "B", 10.0, 2), ("c", "C", 7.5, 0)], "source string, label string, total double, n_courses int")
    got = {(r.a, r.b): r for r in P.compare_programs(courses, programs).collect()}
    assert got["a", "b"].n_both == 2 and "hai ngành bằng nhau" in got["a", "b"].load and "ví dụ" not in got["a", "b"].overlap
    assert got["a", "c"].gap == 2.5 and "A nặng hơn 2.5 tín chỉ" in got["a", "c"].load and ", ví dụ: x, y" in got["a", "c"].overlap


def test_short_articles_and_topics(spark):
    long = "w " * 40
    df = spark.createDataFrame([(1, long, "Điểm học phần"), (2, "w " * 39, "Điểm học phần"), (3, long, "Điểm"), (4, None, None), (5, long, None)], "i int, text string, heading string")
    assert {r.i: r.topic for r in P.worth_asking(df).collect()} == {1: "Điểm học phần", 3: None, 5: None}


def test_refusals(spark):
    class Canned:
        def generate(self, prompts):
            return ["<think>x</think> Tài liệu không đề cập." if "mưa" in p else "Theo Quy chế, có." for p in prompts]

    context = "### Điều 1, Quy chế\nnội dung"
    asked = spark.createDataFrame([(1, "trời mưa?", context), (2, "nắng?", context), (3, "mưa", None)], "qid int, text string, context string")
    checked = P.refusal_check(asked, Canned())
    assert {r.qid: (r.reply, r.refuses) for r in checked.collect()} == {1: ("Tài liệu không đề cập.", True), 2: ("Theo Quy chế, có.", False), 3: ("Tài liệu không đề cập.", True)}
    assert tuple(P.refusal_rate(checked).first()) == (3, 2, 1)


def test_prompt_after_a_rejection(spark):
    n = F.lit(1)
    made = lambda a, facts, why: spark.range(1).select(P.rewrite_prompt(F.lit("q"), F.lit(a), F.lit(facts), n, n, n, n, F.lit(why)).alias("p")).first().p
    first, again = made("Toán (3 tín chỉ)", "", ""), made("ba", "dữ kiện", "numbers")
    assert P.LISTS_NOTHING not in first and "DỮ KIỆN TRA CỨU" not in first and "BỊ LOẠI" not in first
    assert P.LISTS_NOTHING in again and "\ndữ kiện\n" in again and "BỊ LOẠI VÌ: numbers." in again


def test_citations_are_repaired_as_an_answer_grows(spark, tmp_path):
    pieces = [(1, 0, "Theo Điều 3 của Quy"), (1, 1, " định B."), (1, 2, " Xong"), (2, 0, "Tài liệu không có."), (3, 0, "<think>a"), (3, 1, "</think>b")]
    spark.createDataFrame(pieces, "conv_id bigint, seq bigint, piece string").coalesce(1).write.parquet(str(tmp_path / "in"))
    contexts = spark.createDataFrame([(1, "### Điều 3, Quy định A\nx\n\n### Điều 5, Quy định B\ny"), (2, None)], "conv_id bigint, context string")
    stream = spark.readStream.schema("conv_id bigint, seq bigint, piece string").parquet(str(tmp_path / "in"))
    q = S.accumulate_repaired(stream, contexts).writeStream.format("memory").queryName("repaired").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.conv_id, r.seq): (r.answer, r.refuses) for r in spark.table("repaired").collect()}
    assert got == {
        (1, 0): ("Theo Điều 3 của Quy", False), (1, 1): ("Theo Điều 3 của Quy định A.", False), (1, 2): ("Theo Điều 3 của Quy định A. Xong", False),
        (2, 0): ("Tài liệu không có.", True), (3, 1): ("b", False),
    }


def test_table_ocr(spark):
    tables = {b"1": [[["a", None], ["1"]], []], b"2": [], b"3": [[["x"]], [["y"]]]}
    pages = spark.createDataFrame([("f", i, k) for i, k in enumerate(tables)] + [("f", 9, None)], "path string, page int, image binary")
    got = {r.page: r.text for r in files.table_ocr(pages, lambda image: tables[image]).collect()}
    assert got == {0: "| a |  |\n| --- | --- |\n| 1 |  |", 2: "| x |\n| --- |\n\n| y |\n| --- |"}


def test_ocr_sql_agrees_on_scanned_words(spark):
    """The SQL has no text of this language in the tables; here it has."""
    import duckdb

    from docloom.plans.catalogue import _ocr_sql

    texts = ["Chuơng trinh dào tao hoc hoc hoc", "quuơuơ quơ UƠ ưo ƯỎ", "Iý Iuật I", "éhoc hocé _hoc HOC Hoc hỌc", "tín chi, dịnh;quy dinh dinh dinh", "diểm diểu dạo dại", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = [r.x for r in df.orderBy("i").select(X.repair_ocr(F.col("text")).alias("x")).collect()]
    con = duckdb.connect()
    con.execute("create table d (i int, text varchar)")
    con.executemany("insert into d values (?, ?)", list(enumerate(texts)))
    assert [r[0] for r in con.execute(f"select {_ocr_sql('text')} from d order by i").fetchall()] == want
