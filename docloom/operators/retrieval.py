"""Hybrid retrieval: BM25 postings, dense cosine, reciprocal rank fusion, gates.

Questions are a table and so is the corpus; every ranking is per question, with explicit ties. The question side is
a stated query set; the corpus side is never broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators.vectors import RERANK, Codes, build_codes, nearest, nearest_coded
from docloom.tables import Workspace

LEXICAL, DENSE, TOP, FUSION = 40, 80, 6, 60
#: The gates' thresholds: without reranking by cosine, with it by either score.
DENSE_ALONE, RERANK_LEAST, DENSE_LEAST = 0.35, 0.001, 0.30
#: Share of the best score that a passage needs to reach the context.
CONTEXT_SHARE = 0.25
#: Most bytes of a question table that is broadcast to the vectors; beyond, questions go in blocks.
QUERY_BYTES = 64 << 20

# ---- fixed values: colloquial phrase -> words of the regulations, in order ----
SYNONYMS = {
    "đuổi học": "buộc thôi học",
    "bị đuổi": "buộc thôi học",
    "thôi học": "buộc thôi học cảnh báo học tập",
    "trượt môn": "học phần không đạt học lại",
    "rớt môn": "học phần không đạt học lại",
    "học lại": "học lại học phần không đạt",
    "thi lại": "học phần không đạt đánh giá lại",
    "cải thiện điểm": "học cải thiện điểm học phần",
    "bằng giỏi": "xếp loại tốt nghiệp hạng giỏi",
    "bằng khá": "xếp loại tốt nghiệp hạng khá",
    "loại xuất sắc": "xếp loại tốt nghiệp hạng xuất sắc",
    "ra trường": "tốt nghiệp công nhận tốt nghiệp",
    "tốt nghiệp sớm": "tốt nghiệp thời gian đào tạo rút ngắn",
    "học phí": "học phí khoản thu miễn giảm",
    "nợ môn": "học phần chưa đạt tích lũy",
    "bảo lưu": "nghỉ học tạm thời bảo lưu kết quả",
    "nghỉ học": "nghỉ học tạm thời thôi học",
    "chuyển ngành": "chuyển ngành chuyển chương trình đào tạo",
    "chuyển trường": "chuyển trường tiếp nhận sinh viên",
    "tiếng anh": "ngoại ngữ chuẩn đầu ra VSTEP",
    "chứng chỉ tiếng anh": "chứng chỉ ngoại ngữ VSTEP chuẩn đầu ra",
    "tin học": "chuẩn đầu ra tin học MOS ICDL IC3 năng lực số",
    "gpa": "điểm trung bình tích lũy CPA GPA",
    "cpa": "điểm trung bình tích lũy CPA",
    "học bổng": "học bổng khuyến khích học tập",
    "cảnh cáo": "cảnh báo học tập",
    "học online": "đào tạo trực tuyến",
    "học trực tuyến": "đào tạo trực tuyến LMS",
    "bao nhiêu tín": "số tín chỉ khối lượng học tập",
    "mấy tín": "số tín chỉ khối lượng học tập",
}
# ---- end of fixed values ----


def expand(query: Column, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """The query and the words of each synonym phrase it holds, without words that it has as a substring."""
    low = F.lower(query)
    hits = [F.when(F.contains(low, F.lit(k)), F.array(*[F.lit(w) for w in v.split()])).otherwise(F.expr("cast(array() as array<string>)")) for k, v in synonyms.items()]
    extra = F.array_distinct(F.filter(F.concat(*hits), lambda w: ~F.contains(low, F.lower(w))))
    return F.when(F.size(extra) > 0, F.concat(query, F.lit(" "), F.array_join(extra, " "))).otherwise(query)


@dataclass(frozen=True)
class Index:
    """postings (term, doc, tf, len), frequencies (term, df, idf) and totals (n, mean length)."""

    postings: DataFrame
    frequencies: DataFrame
    totals: DataFrame


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", epsilon: float = 0.25) -> Index:
    """Term counts, document frequencies and lengths.

    A negative inverse frequency is replaced by ``epsilon`` times the mean of all of them. Counts are exact whole
    numbers; a term is one row, so frequent terms are pre-aggregated map-side.
    """
    # Terms are counted within each row, as runs of its sorted terms: postings need no shuffle.
    tokens = docs.select(F.col(key).alias("doc"), F.sort_array(X.terms(F.coalesce(F.col(text), F.lit("")))).alias("_t"))
    totals = tokens.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("_t").cast("long")).alias("mean"))
    starts = F.filter(F.transform("_t", lambda w, i: F.when((i == 0) | (w != F.get("_t", i - 1)), i)), lambda i: i.isNotNull())
    runs = tokens.select("doc", "_t", F.size("_t").cast("long").alias("len"), starts.alias("_s"))
    entry = F.transform("_s", lambda at, k: F.struct(F.get("_t", at).alias("term"), (F.coalesce(F.get("_s", k + 1), F.size("_t")) - at).cast("long").alias("tf")))
    postings = runs.select("doc", "len", F.explode(entry).alias("e")).select("e.term", "doc", "len", "e.tf")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return Index(postings, weigh(df, totals.select("n"), epsilon), totals)


def weigh(df: DataFrame, n: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """term, df and idf of term counts ``df`` in a corpus of ``n`` documents (one row)."""
    raw = df.crossJoin(F.broadcast(n)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, F.col("mean_idf") * epsilon).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))


def frequencies(docs: DataFrame, text: str = "text", epsilon: float = 0.25) -> DataFrame:
    """term, df and idf as ``build_index`` has them, for callers that ask for no postings: only counts of terms move."""
    words = docs.select(F.explode(F.array_distinct(F.split(X.term_line(F.coalesce(F.col(text), F.lit(""))), " "))).alias("term"))
    df = words.filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return weigh(df, docs.agg(F.count(F.lit(1)).alias("n")), epsilon)


def bm25(questions: DataFrame, index: Index, k: int = LEXICAL, k1: float = 1.5, b: float = 0.75, digits: int | None = None) -> DataFrame:
    """qid, doc, bm25 and rank of the ``k`` best documents of positive score; ``questions``: qid, text.

    Each occurrence of a term in the question counts. Equal scores rank by document.
    """
    asked = questions.select("qid", F.explode(X.terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighed = asked.join(index.frequencies, "term")
    # the questions' terms go to the postings if their checked size allows, and never the other way round
    size = questions.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    weighed = F.broadcast(weighed) if size <= QUERY_BYTES else weighed.hint("merge")
    hits = index.postings.join(weighed, "term").crossJoin(F.broadcast(index.totals))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = hits.groupBy("qid", "doc").agg(F.sum(part).alias("bm25"))
    if digits is not None:
        scored = scored.withColumn("bm25", F.round("bm25", digits))
    order = Window.partitionBy("qid").orderBy(F.desc("bm25"), "doc")
    return scored.filter("bm25 > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def dense(questions: DataFrame, vectors: DataFrame, k: int = DENSE, digits: int | None = None, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """qid, doc, score and rank of the ``k`` nearest by cosine, exactly; questions: qid, vector, a stated set; vectors: doc, vector."""
    return nearest(questions, vectors, k, digits, block_bytes)


def dense_approximate(questions: DataFrame, vectors: DataFrame, k: int = DENSE, rerank: int = RERANK, codes: Codes | None = None) -> DataFrame:
    """The same over ``rerank * k`` candidates that product codes rank first; every row is coded, here or in ``codes``."""
    codes = codes or build_codes(vectors, Workspace(vectors.sparkSession, "codes"))
    return nearest_coded(questions, vectors, codes, k, rerank)


def fuse(near: DataFrame, lexical: DataFrame, constant: int = FUSION) -> DataFrame:
    """qid, doc, score, bm25 and rrf: the sum of 1 / (constant + rank) over both lists."""
    a = near.select("qid", "doc", "score", F.col("rank").alias("r1"))
    b = lexical.select("qid", "doc", "bm25", F.col("rank").alias("r2"))
    part = lambda c: F.coalesce(1 / (F.lit(constant) + F.col(c)), F.lit(0.0))
    return a.join(b, ["qid", "doc"], "full_outer").withColumn("rrf", part("r1") + part("r2")).drop("r1", "r2")


def top(hits: DataFrame, by: str, k: int = TOP) -> DataFrame:
    """The ``k`` best of each question, with rank."""
    order = Window.partitionBy("qid").orderBy(F.desc_nulls_last(by), "doc")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def gate(hits: DataFrame) -> DataFrame:
    """qid, top_rerank, top_dense and relevant; ``hits``: qid, rank, score, rerank_score. Questions without hits are absent."""
    got = hits.groupBy("qid").agg(F.min_by("rerank_score", "rank").alias("top_rerank"), F.max(F.coalesce("score", F.lit(0.0))).alias("top_dense"))
    alone = F.col("top_dense") >= DENSE_ALONE
    both = (F.col("top_rerank") >= RERANK_LEAST) | (F.col("top_dense") >= DENSE_LEAST)
    return got.withColumn("relevant", F.when(F.col("top_rerank").isNull(), alone).otherwise(both))


def keep_close(hits: DataFrame, share: float = CONTEXT_SHARE) -> DataFrame:
    """Hits with at least ``share`` of the best score; all, where a score is null or the best is not positive."""
    of = Window.partitionBy("qid")
    best = F.first("rerank_score").over(of.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    missing = F.max(F.col("rerank_score").isNull()).over(of)
    marked = hits.withColumn("_best", best).withColumn("_missing", missing)
    return marked.filter(F.col("_missing") | (F.col("_best") <= 0) | (F.col("rerank_score") >= F.col("_best") * share) | (F.col("rank") == 1)).drop("_best", "_missing")


def retrieve(questions: DataFrame, docs: DataFrame, vectors: DataFrame, scorer=None, k: int = TOP) -> DataFrame:
    """Both searches, fused, reranked by ``scorer`` if one is given: qid, doc, scores, rerank_score, rank, text.

    questions: qid, text, vector; docs: doc_id, text; vectors: doc, vector. The scorer sees the question as asked;
    only the lexical search is expanded.
    """
    from docloom.functions.models import score as model_score

    index = build_index(docs)
    lexical = bm25(questions.select("qid", expand(F.col("text")).alias("text")), index)
    near = dense(questions.select("qid", "vector"), vectors, DENSE if scorer else k)
    hits = fuse(near, lexical).join(docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("passage")), "doc")
    hits = hits.join(questions.select("qid", F.col("text").alias("_asked")), "qid")
    rerank = model_score(F.col("_asked"), F.col("passage"), scorer) if scorer else F.lit(None).cast("double")
    hits = hits.withColumn("rerank_score", rerank).drop("_asked")
    return top(hits, "rerank_score" if scorer else "rrf", k).withColumnRenamed("passage", "text")


def pick_basis(hits: DataFrame, boilerplate: str | None = None) -> DataFrame:
    """The hit of each question that shares most terms with question and answer, with bonus for its reranking.

    ``hits``: qid, doc, rank, wanted (text), text, heading, rerank_score. ``boilerplate`` is a pattern in heading or
    beginning that costs 0.35. The first of equals wins.
    """
    want = X.content_terms(F.col("wanted"))
    share = F.size(F.array_intersect(want, X.content_terms(F.col("text")))) / F.greatest(F.size(want), F.lit(1))
    score = share + 0.3 * F.coalesce("rerank_score", F.lit(0.0))
    if boilerplate:
        head = F.concat_ws(" ", F.coalesce("heading", F.lit("")), F.substring("text", 1, 120))
        score = score - F.when(head.rlike(boilerplate), 0.35).otherwise(0.0)
    order = Window.partitionBy("qid").orderBy(F.desc("basis_score"), "rank")
    return hits.withColumn("basis_score", score).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
