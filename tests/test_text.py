"""Cleaning, OCR repair, tokens, lines, chunks."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import chunking as K
from docloom.operators import lines as N


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "f,text,want",
    [
        (X.drop_controls, "a\x00b\tc\nd\x1fe", "ab\tc\nde"),
        (X.nfc, "é", "é"),
        (X.plain_marks, "a b\tc – d — ‘e’ “f”", "a b c - d - 'e' \"f\""),
        (X.drop_page_numbers, "a\n12\nTrang 12\n- 12 -\n12345\nb", "a\n12345\nb"),
        (X.dehyphenate, "đào-\ntạo và- \nx", "đàotạo và- \nx"),
        (X.collapse_space, "  a  b \n \n\n c ", "a b\n\nc"),
        (X.horn_u, "truờng quờ TRUỜNG", "trường quờ TRƯỜNG"),
        (X.horn_o, "tưong lưọng", "tương lượng"),
        (X.capital_i, "Iao ILO Ià", "lao ILO là"),
        (X.ocr_words, "Quy dinh dào tao hoc, Dào hocx tín chi", "Quy định đào tạo học, Đào hocx tín chỉ"),
        (X.fold, "Điều Kiện  ĐẶC-biệt!", "dieu kien dac biet"),
        (X.fold, "ếm", "em"),
        (X.fold_name, "CNKT ô tô, KT Nhiệt", "cong nghe ky thuat o to ky thuat nhiet"),
        (X.without_label, "Điều 5a. Học   phí", "Học phí"),
        (X.without_lead, "Theo Quy chế đào tạo, sinh viên được học.", "Sinh viên được học."),
        (X.title_from_name, "[26-08-2022] 3. qd-so-250-0001 Quy_định 20220826.pdf", "Quy định"),
        (X.title_from_name, "12345.pdf", "12345"),
        (X.topic, "Đánh giá kết quả học tập Sinh viên được đánh giá", "Đánh giá kết quả học tập"),
        (X.topic, "Quy chế này có hiệu lực", ""),
        (X.topic, "Điểm số 2022", ""),
        (X.first_title, "x" * 50, "x" * 38 + "…"),
        (X.without_thoughts, "<think>a\nb</think>\n ok", "ok"),
        (X.content_text, '[{"text":"a"},{"content":"b"},"c"]', "abc"),
        (X.content_text, '{"text":"a"}', "a"),
        (X.content_text, "plain", "plain"),
        (X.ordinals_to_digits, "năm Thứ nhất, thứ  ba", "năm thứ 1, thứ 3"),
        (lambda c: F.array_join(X.numbers(c), " "), "1,5 rồi 12 và 1.000,5 x", "1,5 1.000,5 12"),
        (lambda c: F.array_join(X.item_credits(c), " "), "A (3 tín chỉ), B ( 2,5 tín  chỉ), tổng 20 tín chỉ", "2,5 3"),
        (lambda c: X.truncate_words(c, 2), "a b, c d", "a b..."),
    ],
)
def test_functions(spark, f, text, want):
    assert one(spark, text, f) == want


def test_cleaning_is_idempotent(spark):
    text = "Trang 1\n  Đào-\ntạo  “x” y\n\n\n\n12\nương"
    once = one(spark, text, X.clean)
    assert one(spark, once, X.clean) == once
    assert unicodedata.is_normalized("NFC", once)


def test_number_rendering(spark):
    row = spark.createDataFrame([(3.0, 2.5, 17.25, -0.15)], "a double, b double, c double, d double")
    got = row.select(X.short_number(F.col("a")).alias("a"), X.short_number(F.col("b")).alias("b"), X.one_decimal(F.col("c")).alias("c"), X.signed_decimal(F.col("d")).alias("d")).first()
    assert tuple(got) == ("3", "2.5", f"{17.25:.1f}", f"{-0.15:+.1f}")


def test_changed_places(spark):
    df = spark.createDataFrame([("abcd", "abxd"), ("ab", "abc"), ("", "x")], "a string, b string")
    assert [r.n for r in df.select(X.changed_places(F.col("a"), F.col("b")).alias("n")).collect()] == [1, 0, 0]


# ---- pages and the form


def test_strip_boilerplate(spark):
    pages = "".join(f"<<<PAGE {i}>>>\nTRƯỜNG ĐẠI HỌC\nnội dung {i}\n{'dài ' * 30}\n" for i in range(1, 4))
    df = spark.createDataFrame([("a", pages), ("b", "<<<PAGE 1>>>\nx\n<<<PAGE 2>>>\nx")], "source string, text string")
    got = {r.source: r.text for r in N.strip_boilerplate(df).collect()}
    assert "TRƯỜNG" not in got["a"] and got["a"].count("nội dung") == 3 and got["a"].count("dài") == 90
    assert got["b"].split() == ["x", "x"]


def test_form_in_several_documents(spark):
    rows = [("f1", 0, "Câu 1"), ("f1", 1, "Câu hỏi: a"), ("f1", 2, "Đáp án: b"), ("f2", 0, "Câu 1"), ("f2", 1, "Câu hỏi: c"), ("f2", 2, "Đáp án:"), ("f2", 3, "d")]
    df = spark.createDataFrame(rows, "form string, ord int, line string")
    got = {(r.form, r.question, r.answer) for r in N.parse_form(df, form="form").collect()}
    assert got == {("f1", "a", "b"), ("f2", "c", "d")}


# ---- chunks


def packed(sentences, target, most, overlap):
    """Greedy packing, said plainly."""
    chunks, held = [], []
    count = lambda xs: sum(len(x.split()) for x in xs)

    def close():
        nonlocal held
        chunks.append(" ".join(held))
        tail = []
        while held and count(tail) < overlap:
            tail.insert(0, held.pop())
        held = tail

    for s in sentences:
        if held and count(held) + count([s]) > most:
            close()
        held = held + [s]
        if count(held) >= target:
            close()
    if held:
        chunks.append(" ".join(held))
    return list(dict.fromkeys(chunks))


@pytest.mark.parametrize("seed", range(5))
def test_packing(spark, seed):
    rng = random.Random(seed)
    texts = [[" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(1, 20))) + "." for _ in range(rng.randint(0, 60))] for _ in range(12)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s array<string>")
    got = {r.i: list(r.c) for r in df.select("i", K.pack_sentences(F.col("s"), 40, 55, 8).alias("c")).collect()}
    assert got == {i: packed(t, 40, 55, 8) for i, t in enumerate(texts)}


def test_sentences(spark):
    text = "Một câu. Hai câu; ba?\nbốn! " + " ".join(["x"] * 12)
    got = spark.createDataFrame([(text,)], "t string").select(K.sentences(F.col("t"), 5, 8).alias("s")).first().s
    assert list(got) == ["Một câu.", "Hai câu;", "ba?", "bốn!", "x x x x x", "x x x x x", "x x"]


LAW = (
    "QUYẾT ĐỊNH\nChương I MỞ ĐẦU\nĐiều 1. Phạm vi\nTheo Điều 3. Quy định khác.\nĐiều 2. Áp dụng 1. Khoản một theo Điều 1. Của luật\nĐiều 2a. Bổ sung\nChương II NỘI DUNG\n"
    "Điều 3. Hiệu lực\nĐiều 1. Phần mới\nĐiều 2. Tiếp theo"
)


def test_article_blocks(spark):
    got = K.article_blocks(spark.createDataFrame([("s", LAW)], "source string, text string")).orderBy("ord").collect()
    # the reference to article 3 reads as a boundary, for its number grows; later ones do not
    assert [(r.part, r.article, r.chapter) for r in got] == [(1, "Điều 1", "CHƯƠNG I"), (1, "Điều 3", "CHƯƠNG I"), (2, "Điều 1", "CHƯƠNG II"), (2, "Điều 2", "CHƯƠNG II")]
    assert got[0].heading == "Phạm vi Theo"


def test_chunk_documents(spark):
    long = "Điều 1. Dài\n" + " ".join(f"Câu số {i} có vài chữ." for i in range(200)) + "\nĐiều 2. Ngắn\nĐiều khoản có hiệu lực kể từ ngày ký.\nĐiều 3. Hết\nnội dung " + "chữ " * 220 + "\nNơi nhận: ai đó"
    heads = "mở đầu\n# Một\nnội dung\n## Hai\n\n# Ba\nxong"
    df = spark.createDataFrame([("law", long), ("md", heads)], "source string, text string")
    got = K.chunk_documents(df).orderBy("source", "ord").collect()
    law = [r for r in got if r.source == "law"]
    # article 2 only puts the text into force
    assert [r.chunk_id for r in law] == [f"law::Điều 1::p{i}" for i in range(1, len(law))] + ["law::Điều 3"] and len(law) > 3
    assert "Nơi nhận" not in law[-1].text and all(r.word_count <= K.MOST for r in law)
    assert [(r.chunk_id, r.text) for r in got if r.source == "md"] == [("md::c1", "mở đầu"), ("md::c2", "Một\nnội dung"), ("md::c3", "Ba\nxong")]


def test_merge_tiny_and_ids(spark):
    rows = [("a", "s", 0, "x y", 2, "A"), ("b", "s", 1, "z", 1, "B"), ("b", "s", 2, "p q r", 3, "C"), ("c", "s", 3, "w", 1, "D"), ("a", "t", 0, "v", 1, "E")]
    df = spark.createDataFrame(rows, "chunk_id string, source string, ord long, text string, word_count int, article string")
    got = K.merge_tiny(df, least=3).orderBy("source", "ord").collect()
    assert [(r.chunk_id, r.text, r.article) for r in got] == [("a", "x y\nz", "A"), ("b", "p q r\nw", "C"), ("a", "v", "E")]
    assert sorted(r.chunk_id for r in K.unique_ids(df).collect()) == ["a", "a#1", "b", "b#1", "c"]
    assert spark.createDataFrame([("x::p12",), ("x",)], "i string").select(K.part_number(F.col("i")).alias("n")).collect() == [(12,), (0,)]


def test_no_sentence_is_lost(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in docs.select("text", K.pieces(F.col("text"), 40, 55, 8).alias("p")).collect():
        assert set(re.split(r"\s+", r.text.strip())) == set(" ".join(r.p).split())


@pytest.mark.parametrize("first,high", [("ß", "ẞ"), ("ᾳ", "ᾼ"), ("ﬁ", "ﬁ"), ("é", "É"), ("ẞ", "ẞ"), ("đ", "Đ")])
def test_first_letter_is_raised_to_one_letter(spark, first, high):
    assert one(spark, f"{first}heit, die.", X.without_lead) == f"{high}heit, die."


def test_short_numbers_have_no_exponent(spark):
    numbers = {36217290.0: "36217290", 12345678.5: "12345678.5", 1e15: "1000000000000000", 0.0005: "0.0005", 9999999.0: "9999999", -2e7: "-20000000", 0.0: "0", 250.0: "250"}
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", X.short_number(F.col("x")).alias("s")).collect()
    assert {r.x: r.s for r in rows} == numbers


def test_repairs_are_searched_once(spark):
    """Texts without a fault meet three patterns and none of the repairs of words; a repair that one finds is the same as all in turn."""
    texts = ["", None, "plain text", "HOC dinh", "Quy DINH", "quy dinh ho", "tuơng duơng", "Quơ", "nưoc", "Io", "xhoc hocx", "ſ dể", "tín chi, tín chỉ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    each = X.ocr_words(X.capital_i(X.horn_o(X.horn_u(F.col("t")))))
    rows = df.select(X.repair_ocr(F.col("t")).alias("a"), each.alias("b"), X.changed_places(F.col("t"), F.col("t")).alias("n")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and [r.n for r in rows] == [None if t is None else 0 for t in texts]
    assert "\\b(?:" in X.WRONG_WORDS


def test_only_texts_that_may_change_go_to_python(spark):
    import re
    import unicodedata

    others = re.compile(X.COMPOSABLE)
    plain = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not others.match(chr(c))]
    joined = {d.split()[-1] for c in range(0x10000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    assert all(unicodedata.normalize("NFC", c) == c and unicodedata.combining(c) == 0 and f"{ord(c):04X}" not in joined for c in plain)
    texts = ["", None, "abc", "é", "tiếng Việt", "tiếng", "가", "각", "Å", "中文", "😀é"] * 20
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", X.nfc(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [t and unicodedata.normalize("NFC", t) for t in texts]


def test_terms_are_cut_at_all_that_is_no_letter_or_digit(spark):
    """Every code point, between letters: the ranges that are written out are those the class leaves."""
    from docloom.functions import text as T

    points = spark.createDataFrame([(i, chr(i)) for i in range(0x110000) if not 0xD800 <= i < 0xE000], "i int, c string")
    around = F.concat(F.lit(" Ba"), "c", "c", F.lit("9"), "c")
    want = F.filter(F.split(F.lower(around), "[^0-9a-zà-ỹ]+"), lambda w: w != "")
    assert points.filter((T.terms(around) != want) | (T.term_line(around) != F.array_join(want, " "))).count() == 0
