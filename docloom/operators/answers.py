"""Answers composed from hits and plans: quotes, FAQ rows, breakdowns, comparisons, prompts, refusal checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import models as M
from docloom.functions import text as X
from docloom.operators import context as C
from docloom.operators.curation import FULL_ADVICE
from docloom.operators.numbering import number_rows
from docloom.operators.records import REQUIRED, TRACK
from docloom.operators.retrieval import TOP, gate

QUOTE_WORDS, EXCERPT_WORDS, MORE_WORDS = 110, 300, 120
LEAST_ARTICLE, LEAST_TOPIC = 40, 6
SEMESTERS_A_YEAR, EXAMPLES = 2, 6
# ---- fixed values: output wording ----
ACCORDING = "Theo "
AS_FOLLOWS = ", quy định như sau: "
MOREOVER = " Bên cạnh đó, "
ALSO_RULES = " cũng quy định: "
FAQ_NOTE = "Câu hỏi thường gặp; đáp án dựng từ văn bản trong kho tri thức"
SEMESTER_HAS = "Học kỳ {k} (học kỳ {half} năm thứ {year}) ngành {label}"
CORE = " có {n} học phần bắt buộc, cộng lại {sum} tín chỉ: {list}."
NO_CORE = " không có học phần bắt buộc chung, vì kỳ này chia riêng theo hệ đào tạo."
TRACKS_ARE = "Ngoài ra kỳ này có {n} định hướng chuyên ngành để chọn MỘT: {list}."
TRACK_IS = "{name} ({sum} tín chỉ, {n} học phần)"
SYSTEM_HAS = "Hệ {name} học {n} học phần riêng ({sum} tín chỉ): {list}."
SYSTEMS = ("Cử nhân", "Kỹ sư")
LABEL_DIFFERS = (
    'Lưu ý: kế hoạch đào tạo ghi ở dòng "Bắt buộc" là {required} tín chỉ — con số này đã gộp cả phần định hướng hoặc phần dành riêng '
    "cho hệ kỹ sư, nên em căn theo tổng {total} tín chỉ của cả học kỳ."
)
COURSE = "{name} ({credits} tín chỉ)"
SHARED = "Hai chương trình có {both} học phần trùng nhau. Riêng {a} có {only_a} học phần mà {b} không có"
FOR_EXAMPLE = ", ví dụ: "
AND_BACK = ". Ngược lại {b} có {only_b} học phần riêng"
LOADS = ". Về khối lượng, {a} là {total_a} tín chỉ còn {b} là {total_b} tín chỉ."
HEAVIER_HEAD = "Xét khối lượng tín chỉ, {a} có {total_a} tín chỉ và {b} có {total_b} tín chỉ"
SAME_LOAD = " — hai ngành bằng nhau về tổng khối lượng."
HEAVIER = " — {heavier} nặng hơn {gap} tín chỉ."
COUNTS = " Số học phần lần lượt là {n_a} và {n_b}. Em nên chọn theo định hướng nghề nghiệp chứ không chỉ theo khối lượng."
REWRITE = (
    "CÂU HỎI GỐC ({q_words} từ):\n{question}\n\nĐÁP ÁN GỐC ({a_words} từ):\n{answer}\n{facts}\nYÊU CẦU ĐỘ DÀI: câu hỏi khoảng "
    "{q_low}-{q_high} từ, câu trả lời khoảng {a_low}-{a_high} từ.\nViết lại cặp này, giữ nguyên 100% dữ kiện."
)
REWRITE_FACTS = "\nDỮ KIỆN TRA CỨU (chỉ được lấy thêm thông tin từ đây):\n{facts}\n"
LISTS_NOTHING = (
    "\nĐáp án gốc KHÔNG liệt kê học phần nào. Bản viết lại cũng TUYỆT ĐỐI không được liệt kê tên học phần, dù khối dữ kiện có sẵn. "
    "Câu hỏi này chỉ hỏi con số.\n"
)
REJECTED = (
    "\nBẢN VIẾT LẠI TRƯỚC ĐÓ BỊ LOẠI VÌ: {reason}.\nHãy làm lại và tránh đúng lỗi đó. Cách chắc nhất là GIỮ NGUYÊN danh sách học phần "
    "của đáp án gốc — cả tên môn lẫn số tín chỉ trong ngoặc, không thêm không bớt môn nào — và chỉ đổi cách viết những câu dẫn xung quanh.\n"
)
ASKED_WITH = "TÀI LIỆU:\n{context}\n\nCÂU HỎI: {question}"
# ---- end of fixed values ----


def fill(wording: str, **values: Column) -> Column:
    """The wording with its named places filled; a null value counts as empty."""
    parts, rest = [], wording
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(values[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def _when(test: Column, text: Column) -> Column:
    return F.when(test, text).otherwise(F.lit(""))


# ---- gates and quotes


def gate_or_facts(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """qid, has_facts and relevant: the retrieval gate passes, or exact facts were found.

    ``hits`` as for the gate; facts: qid, facts. Questions with facts only, without any hit, are relevant too.
    """
    known = facts.filter(F.coalesce("facts", F.lit("")) != "").select("qid").distinct().withColumn("_known", F.lit(True))
    joined = gate(hits).join(known, "qid", "full_outer")
    has = F.coalesce("_known", F.lit(False))
    return joined.select("qid", has.alias("has_facts"), (F.coalesce("relevant", F.lit(False)) | has).alias("relevant"))


def place(title: Column, article: Column) -> Column:
    """A title with its article in brackets, if it has one."""
    return F.coalesce(F.concat(title, F.lit(" ("), F.nullif(article, F.lit("")), F.lit(")")), title)


def _references(hits: DataFrame) -> DataFrame:
    """qid and refs: the grouped citations in one line."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "citation"))), lambda x: x["citation"])
    return C.group_citations(hits).groupBy("qid").agg(F.array_join(listed, " | ").alias("refs"))


def quote_for(hits: DataFrame, first: int = 3, n: int = QUOTE_WORDS) -> DataFrame:
    """qid, quote and refs: the best hit in its own words and all sources, for questions that the gate lets through.

    ``hits``: qid, rank, title, article, text, score, rerank_score; the ``first`` of each question count.
    """
    best = hits.filter(F.col("rank") <= first)
    body = X.truncate_words(X.without_label(F.coalesce("text", F.lit(""))), n)
    quoted = best.filter("rank = 1").select("qid", F.concat(F.lit(ACCORDING), place(F.col("title"), F.col("article")), F.lit(": "), body).alias("quote"))
    return quoted.join(gate(best).filter("relevant").select("qid"), "qid").join(_references(best), "qid")


def answer_from_top(hits: DataFrame) -> DataFrame:
    """qid and answer: an excerpt of the best hit and, where the second is of another place, a shorter one of that."""
    label = place(F.col("title"), F.col("article"))
    two = hits.filter(F.col("rank") <= 2).select("qid", "rank", label.alias("_l"), X.without_label(F.coalesce("text", F.lit(""))).alias("_t"))
    of = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    got = two.groupBy("qid").agg(of("_l", 1).alias("l1"), of("_t", 1).alias("t1"), of("_l", 2).alias("l2"), of("_t", 2).alias("t2")).filter("l1 is not null")
    more = F.regexp_replace(F.array_join(F.slice(X.words(F.col("t2")), 1, MORE_WORDS), " "), r"[ ,;.]+$", "")
    second = _when(F.coalesce(F.col("l2") != F.col("l1"), F.lit(False)), F.concat(F.lit(MOREOVER), F.col("l2"), F.lit(ALSO_RULES), more, F.lit("...")))
    excerpt = X.truncate_words(F.col("t1"), EXCERPT_WORDS)
    return got.select("qid", F.concat(F.lit(ACCORDING), F.col("l1"), F.lit(AS_FOLLOWS), excerpt, second, F.lit(" " + FULL_ADVICE)).alias("answer"))


def faq(questions: DataFrame, hits: DataFrame, k: int = TOP) -> tuple[DataFrame, DataFrame]:
    """Rows (qid, id, category, question, answer, source_refs, notes) for questions that pass the gate, and the questions skipped.

    questions: qid, category, question, a stated set, numbered in order of qid; hits as for ``quote_for``.
    """
    best = hits.filter(F.col("rank") <= k)
    made = gate(best).filter("relevant").select("qid").join(answer_from_top(best), "qid").join(_references(best), "qid")
    named = number_rows(questions.join(made, "qid"), [F.col("qid").asc()], name="_number")
    rows = named.select("qid", F.col("_number").cast("int").alias("id"), "category", "question", "answer", F.col("refs").alias("source_refs"), F.lit(FAQ_NOTE).alias("notes"))
    return rows, questions.join(made.select("qid"), "qid", "left_anti")


def worth_asking(articles: DataFrame, text: str = "text", heading: str = "heading") -> DataFrame:
    """Articles of 40 words at least, with topic: that of the heading, or null where it is under 6 characters."""
    topic = X.topic(F.col(heading))
    return articles.filter(X.word_count(F.coalesce(text, F.lit(""))) >= LEAST_ARTICLE).withColumn("topic", F.when(F.length(topic) >= LEAST_TOPIC, topic))


# ---- plans


def breakdown(courses: DataFrame, totals: DataFrame, labels: DataFrame) -> DataFrame:
    """source, semester and sentence: what is required of all, the tracks to choose from, each system's own courses.

    Sums are those of the courses listed; a declared figure that differs is named apart. courses: source, ord, semester,
    name, credits, group, track, system; totals: source, semester, total, required, mismatch; labels: source, label.
    """
    item = F.struct("ord", fill(COURSE, name=F.col("name"), credits=X.short_number(F.col("credits"))).alias("s"), F.col("credits").alias("c"))
    chosen = lambda test: F.sort_array(F.collect_list(F.when(test, item)))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x["s"]), "; ")
    total = lambda c: X.short_number(F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x["c"], F.lit(0.0))))
    in_system = lambda s: F.coalesce(F.col("system") == s, F.lit(False))
    core = (F.col("group") == REQUIRED) & (F.coalesce("system", F.lit("")) == "")
    got = courses.groupBy("source", "semester").agg(chosen(core).alias("_core"), *[chosen(in_system(s)).alias(f"_s{i}") for i, s in enumerate(SYSTEMS)])
    tracks = courses.filter((F.col("group") == TRACK) & (F.coalesce("track", F.lit("")) != ""))
    each = tracks.groupBy("source", "semester", "track").agg(F.min("ord").alias("ord"), F.sum("credits").alias("c"), F.count(F.lit(1)).alias("n"))
    one = fill(TRACK_IS, name=F.col("track"), sum=X.short_number(F.col("c")), n=F.col("n"))
    tracks = each.groupBy("source", "semester").agg(F.sort_array(F.collect_list(F.struct("ord", one.alias("s")))).alias("_tracks"))
    rows = got.join(tracks, ["source", "semester"], "left").join(totals.select("source", "semester", "total", "required", "mismatch"), ["source", "semester"], "left").join(labels, "source")
    k = F.col("semester")
    head = fill(SEMESTER_HAS, k=k, half=(k - 1) % SEMESTERS_A_YEAR + 1, year=F.floor((k - 1) / SEMESTERS_A_YEAR) + 1, label=F.col("label"))
    first = F.when(F.size("_core") > 0, fill(CORE, n=F.size("_core"), sum=total("_core"), list=listed("_core"))).otherwise(F.lit(NO_CORE))
    parts = [F.concat(head, first), F.when(F.size("_tracks") > 0, fill(TRACKS_ARE, n=F.size("_tracks"), list=listed("_tracks")))]
    parts += [F.when(F.size(f"_s{i}") > 0, fill(SYSTEM_HAS, name=F.lower(F.lit(s)), n=F.size(f"_s{i}"), sum=total(f"_s{i}"), list=listed(f"_s{i}"))) for i, s in enumerate(SYSTEMS)]
    parts.append(F.when(F.col("mismatch") & F.col("required").isNotNull(), fill(LABEL_DIFFERS, required=X.short_number(F.col("required")), total=X.short_number(F.col("total")))))
    return rows.select("source", "semester", F.concat_ws(" ", *parts).alias("sentence"))


def compare_programs(courses: DataFrame, programs: DataFrame, shown: int = EXAMPLES) -> DataFrame:
    """For each two programmes: a, b, n_both, n_only_a, n_only_b, gap (of totals), and two sentences, overlap and load.

    courses: source, name; programs: source, label, total, n_courses, a stated small set. A programme is one row with
    its sorted set of names, so pairs are of programmes, never of courses.
    """
    sets = courses.groupBy("source").agg(F.array_sort(F.collect_set("name")).alias("s"))
    whole = programs.join(sets, "source", "left").withColumn("s", F.coalesce("s", F.expr("cast(array() as array<string>)")))
    side = lambda x: whole.select(F.col("source").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("label", "total", "n_courses", "s")])
    pairs = side("a").join(side("b"), F.col("a") < F.col("b"))
    only_a, only_b = F.array_except("s_a", "s_b"), F.array_except("s_b", "s_a")
    la, lb, ta, tb = (F.col(c) for c in ("label_a", "label_b", "total_a", "total_b"))
    loads = {"a": la, "b": lb, "total_a": X.short_number(ta), "total_b": X.short_number(tb)}
    some = lambda c: _when(F.size(c) > 0, F.concat(F.lit(FOR_EXAMPLE), F.array_join(F.slice(F.array_sort(c), 1, shown), ", ")))
    overlap = F.concat(
        fill(SHARED, both=F.size(F.array_intersect("s_a", "s_b")), a=la, b=lb, only_a=F.size(only_a)), some(only_a),
        fill(AND_BACK, b=lb, only_b=F.size(only_b)), some(only_b), fill(LOADS, **loads),
    )
    heavier = F.when(ta == tb, F.lit(SAME_LOAD)).otherwise(fill(HEAVIER, heavier=F.when(ta > tb, la).otherwise(lb), gap=X.short_number(F.abs(ta - tb))))
    load = F.concat(fill(HEAVIER_HEAD, **loads), heavier, fill(COUNTS, n_a=F.col("n_courses_a"), n_b=F.col("n_courses_b")))
    size = lambda c: F.size(c).cast("long")
    return pairs.select(
        "a", "b", size(F.array_intersect("s_a", "s_b")).alias("n_both"), size(only_a).alias("n_only_a"), size(only_b).alias("n_only_b"),
        (ta - tb).alias("gap"), overlap.alias("overlap"), load.alias("load"),
    )


# ---- models


def rewrite_prompt(question: Column, answer: Column, facts: Column, q_low: Column, q_high: Column, a_low: Column, a_high: Column, reason: Column) -> Column:
    """The prompt for one rewrite; ``reason`` is why the last one was rejected, empty on the first turn."""
    known = _when(F.coalesce(facts, F.lit("")) != "", fill(REWRITE_FACTS, facts=facts))
    body = fill(
        REWRITE, question=question, answer=answer, facts=known, q_words=X.word_count(question), a_words=X.word_count(answer),
        q_low=q_low, q_high=q_high, a_low=a_low, a_high=a_high,
    )
    plain = _when(F.size(X.item_credits(F.coalesce(answer, F.lit("")))) == 0, F.lit(LISTS_NOTHING))
    return F.concat(body, plain, _when(F.coalesce(reason, F.lit("")) != "", fill(REJECTED, reason=reason)))


def refusal_check(asked: DataFrame, model: M.Generator) -> DataFrame:
    """qid, reply and refuses for questions that no document answers; ``asked``: qid, text, context.

    The model gets the context it would get in use; a reply that names one of its titles is no refusal.
    """
    prompted = asked.withColumn("_prompt", fill(ASKED_WITH, context=F.col("context"), question=F.col("text")))
    replied = M.generate(prompted, "_prompt", "_reply", model).withColumn("reply", X.without_thoughts(F.col("_reply")))
    return replied.select("qid", "reply", C.is_refusal(F.col("reply"), C.citation_owners(F.coalesce("context", F.lit("")))).alias("refuses"))


def refusal_rate(checked: DataFrame) -> DataFrame:
    """n, n_refused and n_answered, the last being replies made up."""
    return checked.agg(F.count(F.lit(1)).alias("n"), F.count_if("refuses").alias("n_refused"), F.count_if(~F.col("refuses")).alias("n_answered"))
