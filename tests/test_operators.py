"""Retrieval, context, records, facts, curation, models."""

import numpy as np
import plan_rows
import pytest
from pyspark.sql import functions as F

from docloom.functions import models as M
from docloom.operators import context as C
from docloom.operators import curation as Q
from docloom.operators import facts as L
from docloom.operators import records as U
from docloom.operators import retrieval as R


def test_expansion_skips_substrings(spark):
    df = spark.createDataFrame([("Em bị đuổi học không",), ("buộc thôi học",), ("xin chào",)], "q string")
    got = [r.x for r in df.select(R.expand(F.col("q")).alias("x")).collect()]
    assert got == ["Em bị đuổi học không buộc thôi", "buộc thôi học cảnh báo tập", "xin chào"]


def test_fusion_grows_with_rank(spark):
    near = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "qid int, doc int, score double, rank int")
    lexical = spark.createDataFrame([(1, 11, 5.0, 1), (1, 12, 4.0, 2)], "qid int, doc int, bm25 double, rank int")
    got = {r.doc: r.rrf for r in R.fuse(near, lexical).collect()}
    assert got[11] > got[10] > got[12] and abs(got[11] - (1 / 62 + 1 / 61)) < 1e-12


def test_gate(spark):
    rows = [(1, 1, 0.2, 0.5), (2, 1, 0.31, 0.0), (3, 1, 0.2, 0.0005), (4, 1, 0.34, None), (5, 1, 0.36, None), (6, 1, None, None)]
    df = spark.createDataFrame(rows, "qid int, rank int, score double, rerank_score double")
    assert {r.qid: r.relevant for r in R.gate(df).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False}


def test_keep_close(spark):
    rows = [(1, 1, 0.8), (1, 2, 0.2), (1, 3, 0.19), (2, 1, 0.5), (2, 2, None), (3, 1, -1.0), (3, 2, -2.0)]
    df = spark.createDataFrame(rows, "qid int, rank int, rerank_score double")
    assert sorted((r.qid, r["rank"]) for r in R.keep_close(df).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]


def test_dense_blocks_agree(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(rows, "doc int, vector array<double>")
    asked = vectors.filter("doc < 7").withColumnRenamed("doc", "qid")
    whole = {(r.qid, r.doc, r["rank"]) for r in R.dense(asked, vectors, 5).collect()}
    assert whole == {(r.qid, r.doc, r["rank"]) for r in R.dense(asked, vectors, 5, block_bytes=150).collect()}
    v = np.array([x for _, x in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(7):
        assert {d for q, d, _ in whole if q == i} == set(np.argsort(-(v @ v[i]), kind="stable")[:5].tolist())


def test_approximate_search_recall(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    asked = vectors.filter("doc % 50 = 0").withColumnRenamed("doc", "qid")
    exact = {(r.qid, r.doc) for r in R.dense(asked, vectors, 10).collect()}
    found = {(r.qid, r.doc) for r in R.dense_approximate(asked, vectors, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_retrieve(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon"), (3, "alpha zeta"), (4, "eta theta")], "doc_id int, text string")
    encoder = M.HashEncoder(16)
    vectors = docs.select(F.col("doc_id").alias("doc"), M.encode(F.col("text"), encoder).alias("vector"))
    asked = spark.createDataFrame([(1, "alpha beta")], "qid int, text string").withColumn("vector", M.encode(F.col("text"), encoder))
    got = R.retrieve(asked, docs, vectors, M.OverlapScorer(), 2).orderBy("rank").collect()
    assert [r.doc for r in got] == [1, 3] and got[0].rerank_score == 1.0
    assert R.retrieve(asked, docs, vectors, None, 2).count() == 2


def test_generator_halves_batches(spark):
    class Small(M.EchoGenerator):
        def generate(self, prompts):
            if len(prompts) > 1:
                raise MemoryError
            return super().generate(prompts)

    df = spark.createDataFrame([("a\nb",), ("c",), ("d",)], "p string")
    assert sorted(r.o for r in M.generate(df, "p", "o", Small()).collect()) == ["b", "c", "d"]
    assert spark.createDataFrame([([3.0, 4.0],)], "v array<float>").select(M.unit(F.col("v")).alias("u")).first().u == [0.6, 0.8]


# ---- context


def test_context(spark):
    rows = [
        (1, 1, "s", "Điều 1", "T", "a b", "a b c d"), (1, 2, "s", "Điều 1", "T", "c d", "a b c d"), (1, 3, "s", "Điều 2", "T", "e f", " ".join("x" * 9)),
        (1, 4, "s", None, "T", "g h i j k", None), (1, 5, "s", None, "T", "l", None), (2, 1, "s", None, "T", " ".join("y" * 30), None), (2, 2, "s", None, "T", "z", None),
    ]
    df = spark.createDataFrame(rows, "qid int, rank int, source string, article string, title string, text string, full string")
    got = {r.qid: r for r in C.pack_context(df, budget=9).collect()}
    assert list(got[1].used) == [1, 3] and got[1].spent == 6
    assert got[1].context == "### Điều 1, T\na b c d\n\n### Điều 2, T\ne f"
    assert list(got[2].used) == [1]
    facts = C.pack_context(df.withColumn("facts", F.lit("f1 f2")), budget=9, facts="facts").filter("qid = 1").first()
    assert facts.context.startswith("f1 f2\n\n### Điều 1") and facts.spent == 8


def test_citations(spark):
    rows = [(1, 1, "B", "Điều 10"), (1, 2, "A", None), (1, 3, "B", "Điều 2"), (1, 4, "B", "Điều 10"), (1, 5, "A", "Điều x")]
    df = spark.createDataFrame(rows, "qid int, rank int, title string, article string")
    assert [r.citation for r in C.group_citations(df).orderBy("pos").collect()] == ["Điều 2, 10 — B", "Điều x — A"]


def test_follow_up_and_history(spark):
    rows = [(1, 0, "user", "Chuẩn đầu ra ngoại ngữ"), (1, 1, "assistant", "Có.\n\n---\nNguồn: A"), (1, 2, "user", "còn tin học"), (1, 3, "user", "một hai ba bốn năm sáu bảy tám chín mười mười một mười hai mười ba"), (1, 4, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.turn: r.query for r in C.follow_up(df).collect()}
    assert got[2] == "Chuẩn đầu ra ngoại ngữ còn tin học" and got[3].startswith("một hai")
    pairs = C.history_pairs(df).orderBy("pos").collect()
    assert [(p.question[:3], p.answer) for p in pairs] == [("một", "x"), ("Chu", "Có.")]


def test_messages(spark):
    df = spark.createDataFrame([([("q1", "a1")], "q2")], "h array<struct<question:string,answer:string>>, q string")
    got = df.select(C.messages(F.lit("s"), F.col("h"), F.col("q"), F.lit("ctx")).alias("m")).first().m
    assert [(m.role, m.content) for m in got] == [("system", "s"), ("user", "q1"), ("assistant", "a1"), ("user", "ctx\n\nq2")]


def test_whole_article(spark):
    df = spark.createDataFrame([(["a. b; c.", "b; c. d"],), (["x"],)], "p array<string>")
    assert [r.w for r in df.select(C.whole_article(F.col("p")).alias("w")).collect()] == ["a. b; c. d", None]
    chunks = spark.createDataFrame([("s::Điều 1::p10", "s", 3, "Điều 1", "z"), ("s::Điều 1::p2", "s", 2, "Điều 1", "y"), ("s::phần 2::Điều 1", "s", 9, "Điều 1", "other")], "chunk_id string, source string, ord int, article string, text string")
    assert {(r.part, tuple(r.parts)) for r in C.article_index(chunks).collect()} == {("", ("y", "z")), ("2", ("other",))}
    quotes = spark.createDataFrame([(1, "s", "Điều 1")], "quote_id int, source_part string, article string")
    assert C.first_quote(quotes, chunks).first().quote == "y"


def test_adapter_base(spark):
    df = spark.createDataFrame([('{"base_model_name_or_path": "m"}',), ("{}",)], "j string")
    assert [r.s for r in df.select(C.same_base(F.col("j"), F.lit("m")).alias("s")).collect()] == [True, False]


# ---- records and facts


def test_table_rows(spark):
    df = spark.createDataFrame([(["a", "a", "b", "a"],), (["TT", "Mã HP", "x", "KTĐG"],)], "c array<string>")
    got = df.select(U.collapse(F.col("c")).alias("k"), U.blank_merged(F.col("c")).alias("b"), U.is_header(F.col("c")).alias("h")).collect()
    assert list(got[0].k) == ["a", "b", "a"] and list(got[0].b) == ["a", "", "b", "a"] and [r.h for r in got] == [False, True]
    credits = spark.createDataFrame([("2(1.6,0.4,4)",), ("2,5",), ("x",), (None,)], "t string").select(U.credit(F.col("t")).alias("n")).collect()
    assert [r.n for r in credits] == [2.0, 2.5, None, None]
    names = spark.createDataFrame([("K50-a.docx",), ("k50.pdf",), ("ke-hoach-x.DOCX",), ("other.docx",)], "n string")
    assert [r.p for r in names.select(U.is_plan(F.col("n")).alias("p")).collect()] == [True, False, True, False]


@pytest.mark.parametrize(
    "cells,want",
    [
        (["Bắt buộc", "5"], ("group", "Bắt buộc", 5.0)), (["", "Tự chọn", "6", ""], ("group", "Tự chọn", 6.0)), (["2.1", "Chuyên ngành X", "12"], ("track", "Chuyên ngành X", 12.0)),
        (["7.1", "010203", "Môn", "2"], None), (["", "Chuyên ngành Y", "3"], ("track", "Chuyên ngành Y", 3.0)), (["Dành cho hệ đào tạo kỹ sư", "6"], ("system", "Kỹ sư", 6.0)), (["1", "Tự chọn", "2"], None),
    ],
)
def test_classify(spark, cells, want):
    got = spark.createDataFrame([(cells,)], "c array<string>").select(U.classify(F.col("c")).alias("x")).first().x
    assert (None if got.kind is None else tuple(got)) == want


def test_facts(spark):
    _, courses, totals, programs = plan_rows.plan_tables(spark)
    asked = spark.createDataFrame(list(enumerate(plan_rows.ASKED)), "qid int, text string")
    got = {r.qid: r.facts for r in L.facts(asked, programs, courses, totals).collect()}
    assert set(got) == {0, 1, 2, 3, 5}
    assert "học kỳ 1: 7; học kỳ 2: 4" in got[0] and "Toán cao cấp (mã 01001, 3 tín chỉ, bắt buộc, đánh giá: TN)" in got[0]
    assert got[1].startswith('Học phần "Kỹ thuật nhiệt"') and "2.5 tín chỉ (2,5)" in got[1]
    assert "Công nghệ KT ô tô: 2 tín chỉ" in got[2]
    assert "LOẠI TRỪ NHAU (Chuyên ngành lạnh; Chuyên ngành nhiệt)" in got[3] and "hệ Kỹ sư" in got[3]
    assert got[5].startswith("Chương trình: Công nghệ KT ô tô")


def test_semesters(spark):
    texts = {"học kỳ 2 năm 2": 4, "học kỳ 5": 5, "học kỳ 5 năm 3": 5, "năm thứ 3": None, "Học kỳ 1 năm thứ 4": 7}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(L.semester_of(F.col("t")).alias("s")).collect()] == list(texts.values())


# ---- curation


def reason(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r


A0 = "Học kỳ 2 có Toán (3 tín chỉ) và Lý (2 tín chỉ), thuộc năm thứ nhất của khoá học này."


@pytest.mark.parametrize(
    "q1,a1,want",
    [
        ("học kỳ 2?", A0, ""),
        ("học kỳ 2?", A0.replace("thứ nhất", "thứ 1"), ""),
        ("", A0, "empty"),
        ("học kỳ 2?", A0 + " Có 9 môn.", "extra_numbers"),
        ("học kỳ 2?", A0.replace("(3 tín chỉ)", ""), "lost_numbers"),
        ("học kỳ 2?", A0.replace("và Lý (2 tín chỉ)", "và Lý"), "item_credits"),
        ("học kỳ 2?", A0.replace("Học kỳ 2", "Danh sách gồm 2"), "lost_anchors"),
        ("học kỳ 2?", "Học kỳ 2 có Toán (3 tín chỉ), Lý (2 tín chỉ), năm thứ nhất.", "short"),
        ("học kỳ 2 năm 7?", A0, "question_numbers"),
        ("còn gì?", A0, "question_semester"),
    ],
)
def test_fact_gate(spark, q1, a1, want):
    assert reason(spark, lambda q, a, c, d: Q.fact_gate(q, a, c, d), "học kỳ 2 gồm những gì?", A0, q1, a1) == want


def test_other_gates(spark):
    refusal = "Tài liệu chưa có quy định về nội dung này."
    assert reason(spark, lambda q, a, c, d: Q.fact_gate(q, a, c, d), "x", refusal, "x", "Sinh viên được phép làm điều này theo đúng quy chế đào tạo.") == "refusal_flipped"
    assert reason(spark, Q.strict_gate, "a 1 1 b", "a 1 b") == "numbers"
    assert reason(spark, Q.strict_gate, "a b c d e f", "a") == "short"
    assert reason(spark, Q.strict_gate, "a 1", "a 1") == ""
    listed = "Quy định gồm: 1. Một việc cần làm. 2. Hai việc. 3. Không quá 16. Hết."
    assert reason(spark, lambda t: F.array_join(Q.enumerators(t), ","), listed) == "1,2,3"
    assert reason(spark, Q.layout_gate, listed, listed.replace("1. ", "- ").replace("2. ", "- ").replace("3. ", "- ")) == ""
    assert reason(spark, Q.layout_gate, listed, listed.replace("16. ", "")) == "lost_numbers"
    assert reason(spark, lambda t: Q.is_pasted(t).cast("string"), "Theo Quy chế, quy định như sau: x") == "true"
    assert reason(spark, lambda a, b: Q.keeps_content(a, b).cast("string"), "một hai bốn năm", "một hai bốn") == "true"


COMPOSED = "Theo Quy chế đào tạo (Điều 5), quy định như sau: Xếp loại 1. Khoản một dài. 2. Khoản hai dài hơn nhiều. Như vậy, em được xếp loại."


def test_restyle(spark):
    parts = spark.createDataFrame([(COMPOSED,)], "t string").select(Q.answer_parts(F.col("t")).alias("p")).first().p
    assert parts.label == "Quy chế đào tạo (Điều 5)" and parts.conclusion == "em được xếp loại."
    assert reason(spark, Q.restyle, COMPOSED) == "Em được xếp loại. Căn cứ Quy chế đào tạo (Điều 5): Xếp loại 1. Khoản một dài. 2. Khoản hai dài hơn nhiều."
    assert reason(spark, lambda t: Q.restyle(t, 5), COMPOSED).endswith("Xếp loại 1. Khoản một dài.")
    assert reason(spark, Q.restyle, "Câu trả lời thường.") is None


def test_merge_and_enrich(spark):
    rows = [(0, "c", "Hỏi gì?", "ngắn"), (1, "c", "hỏi GÌ", "một câu dài hơn"), (2, "b", "Khác", "x"), (3, "b", "Trống", " "), (4, "c", "hỏi, gì!", "ba chữ thôi bằng")]
    df = spark.createDataFrame(rows, "ord int, category string, question string, answer string")
    got = Q.merge_answers(df).orderBy("id").collect()
    assert [(r.id, r.ord) for r in got] == [(1, 2), (2, 1)]
    assert tuple(Q.merge_report(df).first()) == (5, 1, 2)
    rows = df.select(F.col("ord").alias("id"), "category", "question", "answer")
    basis = spark.createDataFrame([(0, "Quy chế (Điều 2)", "Điều 2. Nội dung"), (2, "L", "Nơi nhận: x")], "id int, label string, text string")
    made = {r.id: r.answer for r in Q.enrich(rows, basis).collect()}
    assert made[0].startswith("Theo Quy chế (Điều 2), quy định như sau: Nội dung Như vậy, ngắn Em nên") and made[1] == "một câu dài hơn"
    admin = rows.withColumn("answer", F.when(F.col("id").isin(0, 2), F.lit("Nơi nhận: như trên")).otherwise(F.col("answer")))
    fixed = {(r.question, r.answer) for r in Q.repair_admin(admin, basis).collect()}
    assert ("Hỏi gì?", "Theo Quy chế (Điều 2), quy định như sau: Nội dung") in fixed and not any(q == "Khác" for q, _ in fixed)


def test_training_parts(spark):
    df = spark.createDataFrame([(i, "Đáp án. " + Q.FULL_ADVICE) for i in range(5)] + [(5, "Giữ nguyên. ")], "i int, a string")
    got = [r.x for r in df.select(Q.vary_advice(F.col("a"), F.col("i")).alias("x")).collect()]
    assert got[:3] == ["Đáp án."] * 3 and got[3].endswith("cụ thể nhé.") and got[5] == "Giữ nguyên."
    rows = spark.createDataFrame([(1, "c", "Q?", "A"), (2, "c", "q? ", "B"), (3, "Ngoài phạm vi kho tri thức", "R", "no"), (4, "c", "S", "dropped")], "id int, category string, question string, answer string")
    contexts = spark.createDataFrame([(1, "ctx", True), (4, "ctx", False)], "id int, context string, relevant boolean")
    made = {r.id: [m.content for m in r.messages] for r in Q.training_messages(rows, contexts, "sys").collect()}
    assert made == {1: ["sys", "ctx\n\nQ?", "A"], 3: ["sys", "R", "no"]}
    groups = spark.createDataFrame([(["q1", "q2"], "r", "a")], "questions array<string>, reason string, advice string")
    assert Q.refusal_samples(groups).count() == 2
    assert reason(spark, lambda t: Q.json_object(t, "a int")["a"].cast("string"), 'so: {"a": 3} ok') == "3"


def test_retry_and_batches(spark):
    df = spark.createDataFrame([("o", "x", "y", "bad", ""), ("o", "x", "y", "", ""), ("o", None, None, "bad", "bad")], "o string, p1 string, p2 string, r1 string, r2 string")
    assert [r.x for r in df.select(Q.retry(df, "p1", "p2", "o", "r1", "r2").alias("x")).collect()] == ["y", "x", "o"]
    long = spark.createDataFrame([("x" * i,) for i in range(50)], "t string")
    sizes = [[len(r.t) for r in part] for part in Q.by_length(long, "t", 4).rdd.glom().collect()]
    assert sum(sizes, []) == list(range(50))
    lost = Q.lost_programs(spark.createDataFrame([(1, "ngành Kỹ thuật nhiệt", "ngành khác")], "id int, a0 string, a1 string"), spark.createDataFrame([("Kỹ thuật nhiệt", "")], "nganh string, chuyen_nganh string"))
    assert [list(r.lost) for r in lost.collect()] == [["Kỹ thuật nhiệt"]]


def test_repair_citations(spark):
    """Both orders, the two distances, ambiguous and unknown numbers, overlapping titles, signs in titles."""
    from docloom.operators import context as C

    context = "### Điều 3, Quy chế (A+B)\nx\n### Điều 4, Quy chế (A+B)\nx\n### Điều 5, Quy định $1 mới\nx\n### Điều 4, Luật\nx\n### Điều 6, Quy định\nx"
    cases = [
        ("Theo Điều 5 của Luật, đúng.", "Theo Điều 5 của Quy định $1 mới, đúng."),
        ("Theo Điều 3 của Quy chế (A+B).", "Theo Điều 3 của Quy chế (A+B)."),
        ("Theo Điều 4 của Quy định.", "Theo Điều 4 của Quy định."),  # two owners
        ("Theo Điều 9 của Quy định.", "Theo Điều 9 của Quy định."),  # unknown
        ("Luật (Điều 3) và Quy định $1 mới, Điều 6", "Quy chế (A+B) (Điều 3) và Quy định, Điều 6"),
        ("Điều 6 Quy định $1 mới", "Điều 6 Quy định"),  # the longest title at a place
        ("Điều 3. Luật", "Điều 3. Luật"),  # a full stop between
        ("Điều 3 " + "x" * 23 + " Luật", "Điều 3 " + "x" * 23 + " Quy chế (A+B)"),  # 25 between
        ("Điều 3 " + "x" * 24 + " Luật", "Điều 3 " + "x" * 24 + " Luật"),
        ("Luật " + "x" * 13 + " Điều 6", "Quy định " + "x" * 13 + " Điều 6"),  # 15 between
        ("Luật " + "x" * 14 + " Điều 6", "Luật " + "x" * 14 + " Điều 6"),
        ("Điều 3 và Điều 5 Luật", "Điều 3 và Điều 5 Quy chế (A+B)"),  # the leftmost mention counts
        ("không có gì", "không có gì"), ("", ""), (None, None),
    ]
    df = spark.createDataFrame([(i, context, r) for i, (r, _) in enumerate(cases)] + [(99, "no heads", "Điều 3 Luật")], "i int, context string, reply string")
    got = {r.i: r.out for r in df.select("i", C.repair_citations(F.col("reply"), C.citation_owners(F.col("context"))).alias("out")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases] and got[99] == "Điều 3 Luật"


def test_numbers_do_not_need_a_whole_category_in_one_task(spark):
    rows = spark.createDataFrame([("b" if i % 50 else None, f"q{i:03d}") for i in reversed(range(200))], "category string, question string")
    made = Q.numbered(rows, "category", "question")
    assert "Window" not in "".join(x for x in made._jdf.queryExecution().analyzed().toString().splitlines(True) if "category" in x.split("Project")[0])
    got = [(r.category, r.question) for r in made.orderBy("id").collect()]
    assert got == sorted(got, key=lambda r: (r[0] or "", r[1])) and [r.id for r in made.orderBy("id").collect()] == list(range(1, 201))
