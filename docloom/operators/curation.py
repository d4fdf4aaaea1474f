"""Question-answer curation: merging, gates that facts survive, restyling, length bands, training messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators.facts import program_label
from docloom.operators.numbering import number_rows
from docloom.tables import Workspace

# ---- fixed values ----
Q_BANDS = ((6, 10), (11, 15), (16, 21), (22, 30))
A_BANDS = ((55, 90), (90, 125), (125, 160), (160, 200), (200, 250))
SEMESTER = r"(?iuU)(?:học\s*)?kỳ\s*(\d{1,2})"
REFUSAL = (
    r"(?iuU)(?:không|chưa|chẳng)\s+(?:\S+\s+){0,3}(?:có|nêu|ghi|nhắc|đề\s*cập|quy\s*định|tìm\s*thấy|nằm|thuộc|tra|xuất\s*hiện|cung\s*cấp|đưa\s*ra|nói)"
    r"|ngoài\s+phạm\s+vi|vượt\s+quá\s+phạm\s+vi|không\s+thuộc\s+phạm\s+vi"
)
ADMIN = r"(?iuU)Nơi nhận\s*:|HIỆU TRƯỞNG|chịu trách nhiệm thi hành (quyết định|văn bản) này|Ban hành kèm theo quyết định này|Lưu\s*:?\s*VT"
PASTED = r"(?isuU)^\s*Theo\b.{0,120}?(quy định như sau|như sau)\s*:"
SHAPE = r"(?sU)^Theo\s+(.{5,140}?),\s*quy định(?:\s+cụ thể)?\s+như sau:\s*(.*?)(?:\s*Như vậy,\s*(.*))?$"
STOCK_ADVICE = (
    r"(?U)\s*Em nên đối chiếu trực tiếp điều khoản nêu trên để nắm đầy đủ chi tiết;\s*nếu còn vướng mắc,\s*"
    r"em liên hệ Phòng Quản lý đào tạo hoặc cố vấn học tập\s*(của lớp\s*)?để được hướng dẫn cụ thể\.?\s*$"
)
ADVICE = (
    "",
    "",
    "",
    "Nếu trường hợp của em có tình tiết riêng, em mang bảng điểm tới gặp cố vấn học tập để được tính cụ thể nhé.",
    "Em liên hệ Phòng Quản lý đào tạo nếu cần xác nhận cho trường hợp cụ thể của mình.",
)
FULL_ADVICE = (
    "Em nên đối chiếu trực tiếp điều khoản nêu trên để nắm đầy đủ chi tiết; nếu còn vướng mắc, em liên hệ Phòng Quản lý đào tạo "
    "hoặc cố vấn học tập của lớp để được hướng dẫn cụ thể."
)
# ---- end of fixed values ----
COLUMNS = ("id", "category", "question", "answer", "source_refs", "notes", "origin")


def numbered(rows: DataFrame, category: str, order: str, name: str = "id") -> DataFrame:
    """Numbers from 1 by (category, order), by ranges of both: no task sees a category as a whole."""
    work = Workspace(rows.sparkSession, "numbered")
    return number_rows(work.save(rows, "rows"), [F.col(category).asc_nulls_first(), F.col(order).asc_nulls_first()], name=name, work=work)


def place_of(rows: DataFrame, order: str, name: str, span: int = 1 << 16) -> DataFrame:
    """Places from 0 by a whole-number column: places within each run of ``span`` values, plus the rows of the runs before."""
    run = F.floor(F.col(order) / span)
    sizes = rows.groupBy(run.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(F.col("_c").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = rows.withColumn("_run", run).withColumn("_place", F.row_number().over(Window.partitionBy("_run").orderBy(order)) - 1)
    joined = marked.join(sizes.select("_c", before.alias("_before")), F.col("_run").eqNullSafe(F.col("_c")))
    return joined.withColumn(name, F.col("_before") + F.col("_place")).drop("_c", "_before", "_place", "_run")


def merge_answers(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Rows with question and answer, one for each loosely equal question: the longest answer, the first of equals; numbered by (category, question)."""
    full = rows.filter((X.strip(F.coalesce("question", F.lit(""))) != "") & (X.strip(F.coalesce("answer", F.lit(""))) != ""))
    own = F.struct(*rows.columns)
    best = full.groupBy(X.loose_key(F.col("question")).alias("_k")).agg(F.max_by(own, F.struct(X.word_count(F.col("answer")), -F.col(order))).alias("r")).select("r.*")
    return numbered(best.drop("id"), "category", "question")


def merge_report(rows: DataFrame) -> DataFrame:
    """n_rows, n_empty and n_duplicates."""
    empty = (X.strip(F.coalesce("question", F.lit(""))) == "") | (X.strip(F.coalesce("answer", F.lit(""))) == "")
    got = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(empty).alias("n_empty"), F.count_distinct(F.when(~empty, X.loose_key(F.col("question")))).alias("_kept"))
    return got.select("n_rows", "n_empty", (F.col("n_rows") - F.col("n_empty") - F.col("_kept")).alias("n_duplicates"))


def enrich(rows: DataFrame, basis: DataFrame, least: int = 60, excerpt: int = 260) -> DataFrame:
    """Answers of under ``least`` words with a basis (id, label, text) become excerpt, old conclusion and advice; others stay."""
    old = X.without_lead(F.col("answer"))
    quote = X.truncate_words(X.without_label(F.col("_text")), excerpt)
    new = X.squeeze(F.concat(F.lit("Theo "), F.col("_label"), F.lit(", quy định như sau: "), quote, F.lit(" Như vậy, "), F.concat(F.lower(F.substring(old, 1, 1)), F.substring(old, 2, 1 << 30)), F.lit(" " + FULL_ADVICE)))
    joined = rows.join(basis.select("id", F.col("label").alias("_label"), F.col("text").alias("_text")), "id", "left")
    weak = (X.word_count(F.col("answer")) < least) & F.col("_text").isNotNull()
    return joined.withColumn("answer", F.when(weak, new).otherwise(F.col("answer"))).drop("_label", "_text")


def answer_parts(answer: Column) -> Column:
    """struct(label, excerpt, conclusion) of a composed answer; nulls where it has not that shape."""
    a = X.strip(answer)
    group = lambda i: F.when(a.rlike(SHAPE), X.strip(F.regexp_extract(a, SHAPE, i)))
    return F.struct(group(1).alias("label"), group(2).alias("excerpt"), group(3).alias("conclusion"))


def repair_admin(rows: DataFrame, basis: DataFrame, excerpt: int = 260) -> DataFrame:
    """Answers with pasted administrative text are rebuilt from a clean basis (id, label, text) or dropped; ids follow the order."""
    bad = F.col("answer").rlike(ADMIN)
    clean = basis.filter(~F.col("text").rlike(ADMIN)).select("id", F.col("label").alias("_label"), F.col("text").alias("_text"))
    joined = rows.join(clean, "id", "left")
    end = F.coalesce(answer_parts(F.col("answer"))["conclusion"], F.lit(""))
    end = F.when(end.rlike(ADMIN), F.lit("")).otherwise(end)
    tail = F.when(end != "", F.concat(F.lit(" Như vậy, "), F.lower(F.substring(end, 1, 1)), F.substring(end, 2, 1 << 30))).otherwise(F.lit(""))
    new = X.squeeze(F.concat(F.lit("Theo "), F.col("_label"), F.lit(", quy định như sau: "), X.truncate_words(X.without_label(F.col("_text")), excerpt), tail))
    out = joined.filter(~bad | F.col("_text").isNotNull()).withColumn("answer", F.when(bad, new).otherwise(F.col("answer"))).drop("_label", "_text")
    return numbered(out.drop("id"), "category", "question")


def clauses(text: Column) -> Column:
    """Numbered clauses of a squeezed text; what precedes the first is an element of its own."""
    return F.filter(F.transform(F.split(X.squeeze(text), rf"(?=(?<![0-9\p{{L}}_])\d{{1,2}}\.\s+[{X.UPPER}{X.LOWER}])"), X.strip), lambda c: c != "")


def clause_prefix(text: Column, budget: int = 170) -> Column:
    """The lead and the leading clauses within ``budget`` words, one at least."""
    parts = clauses(text)
    lead = (F.size(parts) > 1) & ~F.get(parts, 0).rlike(r"^\d{1,2}\.\s")
    first = F.when(lead, F.get(parts, 0))
    body = F.when(lead, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    start = F.struct(F.expr("cast(array() as array<string>)").alias("kept"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("stop"))

    def step(a: Column, c: Column) -> Column:
        n = X.word_count(c)
        over = a["stop"] | ((F.size(a["kept"]) > 0) & (a["n"] + n > budget))
        return F.when(over, F.struct(a["kept"].alias("kept"), a["n"].alias("n"), F.lit(True).alias("stop"))).otherwise(
            F.struct(F.concat(a["kept"], F.array(c)).alias("kept"), (a["n"] + n).alias("n"), F.lit(False).alias("stop"))
        )

    return F.concat_ws(" ", first, F.array_join(F.aggregate(body, start, step, lambda a: a["kept"]), " "))


def restyle(answer: Column, budget: int = 170) -> Column:
    """The conclusion first and the quotation shortened; null where the answer has not the composed shape."""
    parts = answer_parts(answer)
    quote, end = clause_prefix(parts["excerpt"], budget), F.coalesce(parts["conclusion"], F.lit(""))
    lead = X.raise_first(end)
    new = F.when(end != "", F.concat(lead, F.lit(" Căn cứ "), parts["label"], F.lit(": "), quote)).otherwise(F.concat(F.lit("Theo "), parts["label"], F.lit(", "), quote))
    new = X.squeeze(new)
    return F.when(new.rlike(r"[.;:]$"), new).otherwise(F.concat(new, F.lit(".")))


def refuses(text: Column) -> Column:
    """Does the first sentence refuse?"""
    first = F.regexp_extract(X.squeeze(F.coalesce(text, F.lit(""))), r"^[^.!?]{0,400}(?:[.!?]|$)", 0)
    return first.rlike(REFUSAL)


def _raw(text: Column) -> Column:
    return X.numbers(text)


def _normal(text: Column) -> Column:
    return X.numbers(X.ordinals_to_digits(text))


def _semesters(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(X.ordinals_to_digits(text), F.lit(SEMESTER), F.lit(1)))


def lost_semesters(before: Column, after: Column) -> Column:
    low = F.concat(F.lit(" "), X.fold(after), F.lit(" "))
    return F.filter(F.array_sort(_semesters(before)), lambda s: ~F.rlike(low, F.concat(F.lit(r"\bky\s*"), s, F.lit(r"\b"))))


def lost_programs(rows: DataFrame, programs: DataFrame, id_: str = "id") -> DataFrame:
    """id and labels of programmes that the old answer names and the new one does not; programmes are a stated small table."""
    labels = programs.select(program_label(F.col("nganh"), F.col("chuyen_nganh")).alias("label")).distinct().agg(F.collect_set("label").alias("_labels"))
    folded = rows.select(id_, X.fold(F.col("a0")).alias("_a"), X.fold(F.col("a1")).alias("_b")).crossJoin(F.broadcast(labels))
    lost = F.array_sort(F.filter("_labels", lambda x: F.contains(F.col("_a"), X.fold(x)) & ~F.contains(F.col("_b"), X.fold(x))))
    return folded.select(id_, lost.alias("lost")).filter(F.size("lost") > 0)


def _bigrams(text: Column) -> Column:
    t = X.content_terms(text)
    return F.array_distinct(F.transform(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(t, i + 1))))


def keeps_content(before: Column, after: Column, share: float = 0.75) -> Column:
    """Do enough of the content words stay? A stand-in for a word segmenter, which is external."""
    old = X.content_terms(before)
    return F.size(F.array_intersect(old, X.content_terms(after))) >= F.size(old) * share


def _blank(text: Column) -> Column:
    return X.strip(F.coalesce(text, F.lit(""))) == ""


def _lengths(before: Column, after: Column, share: float) -> Column:
    return X.word_count(after) < X.word_count(before) * share


def first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that fails, or an empty string."""
    out = F.lit("")
    for name, fails in reversed(checks):
        out = F.when(F.coalesce(fails, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def strict_gate(before: Column, after: Column) -> Column:
    """Reason why a rewrite fails: empty, numbers (as multisets), or half the length lost."""
    return first_reason([("empty", _blank(after)), ("numbers", _raw(before) != _raw(after)), ("short", _lengths(before, after, 0.5))])


def fact_gate(q0: Column, a0: Column, q1: Column, a1: Column, facts: Column | None = None, lost_anchors: Column | None = None, content: bool = False) -> Column:
    """Reason why a rewritten pair fails, or an empty string; the first in the order below.

    Numbers lost are looked for once ordinals are digits; numbers added, in the text as it stands.
    """
    extra = F.lit("") if facts is None else facts
    old, new = _normal(a0), _normal(a1)
    added = F.size(F.array_except(_raw(a1), F.array_union(old, _normal(extra)))) > 0
    anchors = F.size(lost_semesters(a0, a1)) > 0
    if lost_anchors is not None:
        anchors = anchors | F.coalesce(lost_anchors, F.lit(False))
    checks = [
        ("empty", _blank(q1) | _blank(a1)), ("extra_numbers", added), ("lost_numbers", F.size(F.array_except(old, new)) > 0),
        ("item_credits", X.item_credits(X.ordinals_to_digits(a0)) != X.item_credits(X.ordinals_to_digits(a1))), ("lost_anchors", anchors),
        ("refusal_flipped", refuses(a0) & ~refuses(a1)), ("short", _lengths(a0, a1, 0.9)),
    ]
    if content:
        checks.append(("lost_content", ~keeps_content(a0, a1)))
    checks += [("question_numbers", F.size(F.array_except(_raw(q1), _normal(q0))) > 0), ("question_semester", F.size(F.array_except(_semesters(q0), _semesters(q1))) > 0)]
    return first_reason(checks)


def enumerators(text: Column) -> Column:
    """Numbers whose every occurrence is an item number in a run 1, 2, 3 and so on."""
    pattern = r"(?<!\d)(?<!(?:Điều|điều|khoản|Khoản|điểm|Điểm|mục|Mục|chương|Chương) )(\d{1,2})\s*[.)]\s"
    t = F.coalesce(text, F.lit(""))
    found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    start = F.struct(F.lit(1).alias("next"), F.expr("cast(array() as array<int>)").alias("in_run"))

    def step(a: Column, n: Column) -> Column:
        return F.when((n == a["next"]) | (n == 1), F.struct((n + 1).alias("next"), F.concat(a["in_run"], F.array(n)).alias("in_run"))).otherwise(a)

    runs = F.transform(F.aggregate(found, start, step, lambda a: a["in_run"]), lambda x: x.cast("string"))
    every = X.numbers(t)
    times = lambda arr, v: F.size(F.filter(arr, lambda y: y == v))
    return F.array_sort(F.filter(F.array_distinct(every), lambda v: times(runs, v) >= times(every, v)))


def layout_gate(before: Column, after: Column, lost_anchors: Column | None = None) -> Column:
    """The gate for a new layout of one answer: item numbers may go, a quarter of the length too."""
    old, new = _normal(before), _normal(after)
    anchors = F.size(lost_semesters(before, after)) > 0
    if lost_anchors is not None:
        anchors = anchors | F.coalesce(lost_anchors, F.lit(False))
    return first_reason([
        ("empty", _blank(after)), ("extra_numbers", F.size(F.array_except(_raw(after), old)) > 0),
        ("lost_numbers", F.size(F.array_except(F.array_except(old, new), enumerators(before))) > 0),
        ("item_credits", X.item_credits(X.ordinals_to_digits(before)) != X.item_credits(X.ordinals_to_digits(after))), ("lost_anchors", anchors),
        ("refusal_flipped", refuses(before) & ~refuses(after)), ("short", _lengths(before, after, 0.75)),
    ])


def is_pasted(answer: Column) -> Column:
    return answer.rlike(PASTED)


def length_bands(rows: DataFrame, order: str, answer: str = "answer", number: Column | None = None) -> DataFrame:
    """Adds floor, q_low, q_high, a_low and a_high: bands in turn among those that the answer's facts fit in.

    ``number`` is the row's place from 0; without it rows are numbered by ``order``, a whole number.
    """
    n = F.size(F.array_distinct(X.numbers(F.col(answer))))
    floor = F.greatest(F.lit(40), 25 + 6 * n, F.size(X.words(F.col(answer)))).cast("long")
    bands = lambda values: F.array(*[F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high")) for a, b in values])
    df = (place_of(rows, order, "_i") if number is None else rows.withColumn("_i", number)).withColumn("floor", floor)
    fit = F.filter(bands(A_BANDS), lambda b: b["high"] >= F.col("floor"))
    a = F.when(F.size(fit) > 0, F.get(fit, (F.col("_i") % F.greatest(F.size(fit), F.lit(1))).cast("int"))).otherwise(F.struct(F.col("floor").alias("low"), F.floor(F.col("floor") * 1.25).alias("high")))
    q = F.get(bands(Q_BANDS), (F.col("_i") % len(Q_BANDS)).cast("int"))
    df = df.withColumn("_a", a).withColumn("_q", q)
    return df.select(*rows.columns, "floor", F.col("_q.low").alias("q_low"), F.col("_q.high").alias("q_high"), F.col("_a.low").alias("a_low"), F.col("_a.high").alias("a_high"))


def json_object(text: Column, schema: str) -> Column:
    """The first braces to the last, read as JSON; null where that fails."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def vary_advice(answer: Column, number: Column) -> Column:
    """Stock advice at the end gives way to variants in turn; answers without it stay."""
    t = X.strip(answer)
    cut = X.strip(F.regexp_replace(t, STOCK_ADVICE, ""))
    tail = F.get(F.array(*[F.lit(a) for a in ADVICE]), (number % len(ADVICE)).cast("int"))
    return F.when(cut == t, t).otherwise(F.rtrim(F.concat(cut, F.lit(" "), tail)))


def retry(rows: DataFrame, first: str, second: str, original: str, reason1: str, reason2: str) -> Column:
    """The first rewrite that passed its gate, else the original."""
    return F.coalesce(F.when(F.col(reason1) == "", F.col(first)), F.when(F.col(reason2) == "", F.col(second)), F.col(original))


def by_length(rows: DataFrame, text: str, parts: int) -> DataFrame:
    """Rows of like length together, for batches of even cost; a later sort by the order column restores them."""
    return rows.repartitionByRange(parts, F.length(text)).sortWithinPartitions(F.length(text))


def fit_budget(hits: DataFrame, budget: int, cost: str = "words") -> DataFrame:
    """The longest prefix of each question's hits, best first, within the budget; questions whose first does not fit are absent."""
    upto = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("spent", F.sum(cost).over(upto)).filter(F.col("spent") <= budget)


def training_messages(rows: DataFrame, contexts: DataFrame, system: str, refusal: str = "Ngoài phạm vi kho tri thức") -> DataFrame:
    """id and messages: one sample for each distinct question that has a relevant context or is a refusal.

    rows: id, category, question, answer; contexts: id, context, relevant.
    """
    own = F.struct(*rows.columns)
    first = rows.groupBy(X.question_key(F.col("question")).alias("_k")).agg(F.min_by(own, "id").alias("r")).select("r.*")
    joined = first.join(contexts, "id", "left").filter(F.coalesce("relevant", F.lit(False)) | (F.col("category") == refusal))
    asked = F.concat_ws("\n\n", F.nullif(F.coalesce("context", F.lit("")), F.lit("")), F.col("question"))
    one = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return joined.select("id", F.array(one("system", F.lit(system)), one("user", asked), one("assistant", vary_advice(F.col("answer"), F.col("id")))).alias("messages"))


def refusal_samples(groups: DataFrame, category: str = "Ngoài phạm vi kho tri thức") -> DataFrame:
    """One row for each question of each group (questions, reason, advice)."""
    return groups.select(F.lit(category).alias("category"), F.explode("questions").alias("question"), X.squeeze(F.concat_ws(" ", "reason", "advice")).alias("answer"))
