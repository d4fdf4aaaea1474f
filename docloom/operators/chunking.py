"""Structure-aware chunking: article boundaries, chapters, sentence packing, merging of tiny pieces.

Order-dependent steps are folds over arrays, so a document is one row and never needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as X

TARGET, MOST, LEAST, OVERLAP = 400, 550, 40, 50
# ---- fixed values: patterns of the legal texts ----
ARTICLE = rf"(?U)Điều\s+(\d+)([a-z]?)\s*[.:]\s*(?=[{X.UPPER}])"
CHAPTER = r"(?iuU)CHƯƠNG\s+([IVXLCDM\d]+)\b\s*[.:]?\s*"
ENACTING = r"(?iu)ban hành kèm theo (quyết định|văn bản) này|chịu trách nhiệm thi hành (quyết định|văn bản) này|có hiệu lực (thi hành )?kể từ ngày ký|nơi nhận\s*:"
RECIPIENTS = r"(?iuU)\|?\s*Nơi nhận\s*:"
SIGNATURE = r"(?mU)^\s*\|?\s*(?:KT\.\s*|TL\.\s*|TM\.\s*)?(?:HIỆU TRƯỞNG|PHÓ HIỆU TRƯỞNG|CHỦ TỊCH HỘI ĐỒNG|DỰ THẢO)\s*\|?\s*$"
# ---- end of fixed values ----
_STRINGS = "array<string>"


def _none(kind: str = _STRINGS) -> Column:
    return F.expr(f"cast(array() as {kind})")


def sentences(text: Column, target: int = TARGET, most: int = MOST) -> Column:
    """Sentences and lines; those of over ``most`` words are cut every ``target`` words."""
    parts = F.filter(F.transform(F.split(text, r"(?U)(?<=[.?!;])\s+|\n"), X.strip), lambda s: s != "")

    def cut(s: Column) -> Column:
        w = X.words(s)
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(target))
        return F.when(F.size(w) > most, F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(target)), " "))).otherwise(F.array(s))

    return F.flatten(F.transform(parts, cut))


def pack_sentences(parts: Column, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, keep_tail: bool = True) -> Column:
    """Chunks of whole sentences: one ends when the next sentence would exceed ``most`` or at ``target`` words.

    The next begins with the last sentences of it, as many as it takes to reach ``overlap`` words. Where the last
    sentence ended a chunk, what was carried over makes a chunk of its own unless ``keep_tail`` is off. Equal chunks
    count once, the first.
    """
    item = "struct<s:string,n:int>"
    one = lambda x, f: F.get(F.transform(F.array(x), f), 0)

    def tail(open_: Column) -> Column:
        return F.aggregate(
            F.reverse(open_), F.struct(_none(f"array<{item}>").alias("kept"), F.lit(0).alias("n")),
            lambda a, x: F.when(a["n"] >= overlap, a).otherwise(F.struct(F.concat(F.array(x), a["kept"]).alias("kept"), (a["n"] + x["n"]).alias("n"))),
        )

    def joined(open_: Column) -> Column:
        return F.array_join(F.transform(open_, lambda x: x["s"]), " ")

    def state(done: Column, open_: Column, n: Column, fresh: Column) -> Column:
        return F.struct(done.alias("done"), open_.alias("open"), n.alias("n"), fresh.alias("fresh"))

    def closed(a: Column) -> Column:
        return one(tail(a["open"]), lambda t: state(F.concat(a["done"], F.array(joined(a["open"]))), t["kept"], t["n"], F.lit(False)))

    def step(a: Column, x: Column) -> Column:
        # close before the sentence, then again after it; n is the words of the open sentences
        full = (a["n"] + x["n"] > most) & (F.size(a["open"]) > 0)
        more = one(F.when(full, closed(a)).otherwise(a), lambda b: state(b["done"], F.concat(b["open"], F.array(x)), b["n"] + x["n"], F.lit(True)))
        return one(more, lambda c: F.when(c["n"] >= target, closed(c)).otherwise(c))

    counted = F.transform(parts, lambda s: F.struct(s.alias("s"), F.size(X.words(s)).alias("n")))
    start = state(_none(), _none(f"array<{item}>"), F.lit(0), F.lit(False))

    def finish(a: Column) -> Column:
        rest = (F.size(a["open"]) > 0) & (F.lit(keep_tail) | a["fresh"])
        return F.array_distinct(F.when(rest, F.concat(a["done"], F.array(joined(a["open"])))).otherwise(a["done"]))

    return F.aggregate(counted, start, step, finish)


def pieces(text: Column, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, keep_tail: bool = True) -> Column:
    """The text itself if it is short enough, else its chunks."""
    return F.when(X.word_count(text) <= most, F.array(text)).otherwise(pack_sentences(sentences(text, target, most), target, most, overlap, keep_tail))


def is_enacting(text: Column) -> Column:
    return (X.word_count(text) < 200) & text.rlike(ENACTING)


def strip_tail(text: Column, least: int = LEAST) -> Column:
    """Without recipients and signature at the end, where what stays has ``least`` words."""
    at = F.least(*[F.when(F.regexp_instr(text, F.lit(p)) > 0, F.regexp_instr(text, F.lit(p))) for p in (RECIPIENTS, SIGNATURE)])
    head = X.strip(F.substring(text, F.lit(1), at - 1))
    return F.when(at.isNotNull() & (X.word_count(head) >= least), head).otherwise(text)


def article_blocks(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """key, ord, part, article, heading, chapter and block, for each article of each text.

    The text is cut at every candidate; a fold keeps those whose (number, letter) grows, or that begin a new part
    with article 1 at the start of a line, and joins the others to what precedes them. What precedes the first
    article is no block, but its chapters count.
    """
    mark = "\u0001"
    cut = F.split(F.regexp_replace(F.col(text), rf"(?U)(?=Điều\s+\d+[a-z]?\s*[.:]\s*[{X.UPPER}])", mark), mark, -1)
    item = "struct<num:int,letter:string,part:int,t:string>"

    def step(a: Column, t: Column) -> Column:
        num = F.regexp_extract(t, ARTICLE, 1).cast("int")
        letter = F.regexp_extract(t, ARTICLE, 2)
        grows = (num > a["num"]) | ((num == a["num"]) & (letter > a["letter"]))
        restart = (num == 1) & ((a["before"] == "") | a["before"].endswith("\n")) & (F.size(a["out"]) > 0)
        part = a["part"] + F.when(~grows & restart, 1).otherwise(0)
        new = F.struct(num.alias("num"), letter.alias("letter"), part.alias("part"), t.alias("t"))
        last = F.element_at(a["out"], -1)
        more = F.struct(last["num"].alias("num"), last["letter"].alias("letter"), last["part"].alias("part"), F.concat(last["t"], t).alias("t"))
        taken = F.struct(num.alias("num"), letter.alias("letter"), part.alias("part"), F.concat(a["out"], F.array(new)).alias("out"), a["lead"].alias("lead"), t.alias("before"))
        joined = F.struct(
            a["num"].alias("num"), a["letter"].alias("letter"), a["part"].alias("part"),
            F.when(F.size(a["out"]) > 0, F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(more))).otherwise(a["out"]).alias("out"),
            F.when(F.size(a["out"]) == 0, F.concat(a["lead"], t)).otherwise(a["lead"]).alias("lead"), t.alias("before"),
        )
        return F.when(t.rlike(rf"^{ARTICLE}") & (grows | restart), taken).otherwise(joined)

    start = F.struct(F.lit(0).alias("num"), F.lit("").alias("letter"), F.lit(1).alias("part"), _none(f"array<{item}>").alias("out"), F.lit("").alias("lead"), F.lit("").alias("before"))
    folded = docs.select(F.col(key), F.aggregate(F.filter(cut, lambda t: t != ""), start, step).alias("_f"))
    rows = folded.select(key, F.col("_f.lead").alias("_lead"), F.posexplode("_f.out").alias("ord", "_b"))
    # the nearest chapter above: one in this text before the block's own start
    chapters = lambda t: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(t, F.lit(CHAPTER), F.lit(1))), -1)
    upto = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.last(chapters(F.col("_b.t")), True).over(upto), chapters(F.col("_lead")))
    after = F.substring(F.regexp_replace(F.col("_b.t"), rf"^{ARTICLE}", ""), 1, 300)
    title = X.strip(F.get(F.split(F.concat(F.lit(" "), after), r"(?U)\s+\d{1,2}[.)]\s", 2), 0))
    return rows.select(
        key, "ord", F.col("_b.part").alias("part"), F.concat(F.lit("Điều "), F.col("_b.num"), F.col("_b.letter")).alias("article"),
        F.array_join(F.slice(X.words(title), 1, 20), " ").alias("heading"), F.concat(F.lit("CHƯƠNG "), F.upper(above)).alias("chapter"), X.strip(F.col("_b.t")).alias("block"),
    )


def heading_blocks(docs: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """key, ord, heading (or null) and block, for texts cut at Markdown headings."""
    parts = F.split(F.col(text), r"(?m)(?=^#+\s+.*$)", -1)
    rows = docs.select(key, F.posexplode(parts).alias("ord", "_t"))
    heading = F.when(F.col("_t").rlike(r"^#+\s+"), X.strip(F.regexp_replace(F.regexp_extract("_t", r"^(#+\s+[^\n]*)", 1), "^[# ]+", "")))
    block = X.strip(F.regexp_replace("_t", r"^#+\s+[^\n]*", ""))
    return rows.select(key, "ord", heading.alias("heading"), block.alias("block")).filter("block <> ''")


def chunk_documents(docs: DataFrame, key: str = "source", text: str = "text", target: int = TARGET, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """Chunks (chunk_id, source, ord, text, word_count, chapter, article, heading): by articles where a text has any, else by headings."""
    by_article = article_blocks(docs.filter(F.col(text).rlike(rf"(?U)Điều\s+\d+[a-z]?\s*[.:]\s*[{X.UPPER}]")), key, text)  # no other text has any
    made = by_article.withColumn("_p", pieces(F.col("block"), target, most, overlap)).withColumn("_n", F.size("_p"))
    made = made.select("*", F.posexplode("_p").alias("_j", "_t")).filter(~is_enacting(F.col("_t"))).withColumn("_t", strip_tail(F.col("_t")))
    part = F.when(F.col("part") > 1, F.concat(F.lit("phần "), F.col("part"), F.lit("::"))).otherwise(F.lit(""))
    number = F.when(F.col("_n") > 1, F.concat(F.lit("::p"), F.col("_j") + 1)).otherwise(F.lit(""))
    first = made.select(
        F.concat(F.col(key), F.lit("::"), part, F.col("article"), number).alias("chunk_id"), F.col(key).alias("source"),
        (F.col("ord") * 100_000 + F.col("_j")).cast("long").alias("ord"), F.col("_t").alias("text"), X.word_count(F.col("_t")).alias("word_count"),
        "chapter", "article", F.when(F.col("heading") != "", F.col("heading")).alias("heading"),
    )
    others = docs.join(by_article.select(key).distinct(), key, "left_anti")
    rest = heading_blocks(others, key, text).withColumn("_p", pieces(F.col("block"), target, most, overlap))
    rest = rest.select("*", F.posexplode("_p").alias("_j", "_t")).filter(~is_enacting(F.col("_t")))
    body = strip_tail(F.when(F.col("heading").isNotNull(), F.concat(F.col("heading"), F.lit("\n"), F.col("_t"))).otherwise(F.col("_t")))
    count = F.row_number().over(Window.partitionBy(key).orderBy("ord", "_j"))
    second = rest.select(
        F.concat(F.col(key), F.lit("::c"), count).alias("chunk_id"), F.col(key).alias("source"), (F.col("ord") * 100_000 + F.col("_j")).cast("long").alias("ord"),
        body.alias("text"), X.word_count(body).alias("word_count"), F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("string").alias("article"), "heading",
    )
    return first.unionByName(second)


def merge_tiny(chunks: DataFrame, least: int = LEAST, key: str = "source") -> DataFrame:
    """Chunks of under ``least`` words join the one before them in their source; its labels stay."""
    order = Window.partitionBy(key).orderBy("ord")
    starts = (F.row_number().over(order) == 1) | (F.col("word_count") >= least)
    island = chunks.withColumn("_start", starts.cast("int")).withColumn("_island", F.sum("_start").over(order))
    parts = F.sort_array(F.collect_list(F.struct("ord", "text")))
    rest = [c for c in chunks.columns if c not in (key, "ord", "text", "word_count")]
    firsts = [F.min_by(c, "ord").alias(c) for c in rest]
    out = island.groupBy(key, "_island").agg(F.min("ord").alias("ord"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), *firsts)
    return out.withColumn("word_count", X.word_count(F.col("text"))).select(*chunks.columns)


def unique_ids(chunks: DataFrame, id_: str = "chunk_id", order: str = "ord") -> DataFrame:
    """The second and later of equal ids get "#1", "#2" and so on."""
    n = F.row_number().over(Window.partitionBy(id_).orderBy(order)) - 1
    return chunks.withColumn("_n", n).withColumn(id_, F.when(F.col("_n") > 0, F.concat(F.col(id_), F.lit("#"), F.col("_n"))).otherwise(F.col(id_))).drop("_n")


def chunk_stats(chunks: DataFrame, article: str = "article") -> DataFrame:
    """Number of chunks, least, mean (floored) and most words, and those with an article."""
    n = F.count(F.lit(1))
    return chunks.agg(
        n.alias("n_chunks"), F.min("word_count").alias("min_words"), F.floor(F.sum("word_count") / n).alias("avg_words"),
        F.max("word_count").alias("max_words"), F.count_if(F.coalesce(F.col(article), F.lit("")) != "").alias("n_articles"),
    )


def part_number(chunk_id: Column) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(chunk_id, r"::p(\d+)", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
