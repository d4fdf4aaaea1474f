"""Files, sinks and streams."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.sources import files as S
from docloom.streaming import answers as A


def docx(blocks):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = "".join(p(b) if isinstance(b, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:tcPr>{f'<w:gridSpan w:val=\"{n}\"/>' if n > 1 else ''}</w:tcPr>{p(t)}</w:tc>" for t, n in row) + "</w:tr>" for row in b) + "</w:tbl>" for b in blocks)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def xlsx(rows):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = "".join("<row>" + "".join(f'<c r="{c}{i}" t="inlineStr"><is><t>{t}</t></is></c>' for c, t in row) + "</row>" for i, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="One"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {s}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def ole_doc(text):
    """A legacy file of one UTF-16 piece, its streams in plain sectors."""
    raw = text.encode("utf-16-le")
    main = bytearray(4096 + len(raw) + (-len(raw)) % 512)
    struct.pack_into("<H", main, 10, 0x200)
    clx = b"\x02" + struct.pack("<I", 4 * 2 + 8) + struct.pack("<II", 0, len(text)) + struct.pack("<HIH", 0, 2048, 0)
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    main[2048 : 2048 + len(raw)] = raw
    table = clx + bytes(4096 - len(clx))
    sectors, fat = [], []

    def add(data):
        first = len(sectors)
        parts = [data[i : i + 512].ljust(512, b"\0") for i in range(0, len(data), 512)]
        for i, part in enumerate(parts):
            sectors.append(part)
            fat.append(first + i + 1 if i + 1 < len(parts) else 0xFFFFFFFE)
        return first

    a, b = add(bytes(main)), add(table)

    def entry(name, kind, start, size):
        e = bytearray(128)
        n = name.encode("utf-16-le") + b"\0\0"
        e[: len(n)] = n
        struct.pack_into("<H", e, 64, len(n))
        e[66] = kind
        struct.pack_into("<II", e, 116, start, size)
        return bytes(e)

    d = add(entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("WordDocument", 2, a, len(main)) + entry("1Table", 2, b, len(table)) + bytes(128))
    f = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat)))))
    head = bytearray(512)
    head[:8] = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
    struct.pack_into("<HH", head, 30, 9, 6)
    struct.pack_into("<I", head, 48, d)
    struct.pack_into("<II", head, 56, 4096, 0xFFFFFFFE)
    struct.pack_into("<I", head, 68, 0xFFFFFFFE)
    struct.pack_into("<109I", head, 76, f, *([0xFFFFFFFF] * 108))
    return bytes(head) + b"".join(sectors)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.docx").write_bytes(docx(["Đầu trang", [[("x", 2), ("y", 1)], [("1", 1), ("2", 1), ("3", 1)]], "Cuối"]))
    (tmp_path / "sub" / "b.xlsx").write_bytes(xlsx([[("A", "h1"), ("C", "h3")], [("B", "v")]]))
    (tmp_path / "c.doc").write_bytes(ole_doc("Điều 1. Phạm vi\rHết"))
    (tmp_path / "d.txt").write_bytes("dòng 1\nhỏng ".encode() + b"\xff x")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / ".hidden.txt").write_bytes(b"no")
    (tmp_path / "f.png").write_bytes(b"no")
    return str(tmp_path)


def test_files(spark, folder):
    taken, skipped = S.list_files(spark, folder)
    assert sorted(r.name for r in taken.collect()) == ["a.docx", "b.xlsx", "c.doc", "d.txt", "e.pdf"]
    assert [r.name for r in skipped.collect()] == ["f.png"]
    blocks = S.read_blocks(taken)
    assert [r.cells[0] for r in blocks.filter("kind = 'error'").collect()] == ["ValueError: no reader for .pdf"]
    text = {r.source: r.text for r in S.block_text(blocks).collect()}
    assert text["a.docx"] == "Đầu trang\n| x | x | y |\n| --- | --- | --- |\n| 1 | 2 | 3 |\nCuối"
    assert text["b.xlsx"] == "## Sheet: One\n| h1 |  | h3 |\n| --- | --- | --- |\n|  | v |  |"
    assert text["c.doc"] == "Điều 1. Phạm vi\nHết"
    assert text["d.txt"] == "dòng 1\nhỏng  x"
    own = S.read_blocks(taken, {"pdf": lambda b: [("para", 0, ["page"])]})
    assert own.filter("kind = 'error'").count() == 0


def test_markdown(spark):
    df = spark.createDataFrame([([["a", None], ["b\nc"]],), ([],)], "r array<array<string>>")
    assert [r.m for r in df.select(S.table_markdown(F.col("r")).alias("m")).collect()] == ["| a |  |\n| --- | --- |\n| b c |  |", ""]
    t = spark.createDataFrame([("a\x07b\x0bc  \r\x13LINK\x14d\x15\x02",)], "t string").select(S.plain_controls(F.col("t")).alias("x")).first().x
    assert t == "a|b\nc\nd"
    assert S.decode_auto("Điều một".encode("utf-16-le")) == "Điều một" and S.decode_auto(b"plain text here") == "plain text here"


def test_ocr_split(spark):
    pages = spark.createDataFrame([(1, "x" * 40, b"i"), (2, " short ", b"i")], "page int, text string, image binary")
    have, need = S.needs_ocr(pages)
    assert [r.page for r in have.collect()] == [1]
    assert [(r.page, r.text) for r in S.ocr(need, lambda b: "read").collect()] == [(2, "read")]


def test_question_files(spark, tmp_path):
    rows = [("1", "c", 'say "x"\nagain', "a", "s", None)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in S.QA_COLUMNS))
    S.write_qa(df.coalesce(1), str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*.csv"))
    folder = tmp_path / "qa"
    folder.mkdir()
    (folder / "a.csv").write_bytes(part.read_bytes())
    (folder / "a.bak.csv").write_bytes(part.read_bytes())
    (folder / "bad.csv").write_text("id,question\n1,q\n")
    got = S.read_qa(spark, str(folder)).collect()
    assert [(r.question, r.notes, r.origin) for r in got] == [('say "x"\nagain', "", "a.csv")]
    (tmp_path / "q.txt").write_text("one\n\n  \ntwo \n")
    assert sorted(r.question for r in S.read_questions(spark, str(tmp_path / "q.txt")).collect()) == ["one", "two"]


def test_tables_out_and_in(spark, tmp_path):
    df = spark.createDataFrame([("c1", "x", [0.5, 1.0])], "id string, text string, embedding array<double>")
    S.write_jsonl(df, str(tmp_path / "j"))
    assert S.read_jsonl(spark, str(tmp_path / "j"), df.schema).collect() == df.collect()
    S.write_vectors(df, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).schema["embedding"].dataType.simpleString() == "array<float>"
    S.write_version(df, str(tmp_path / "t"), "1")
    with pytest.raises(Exception):
        S.write_version(df, str(tmp_path / "t"), "1")
    staged = spark.createDataFrame([("a", "x"), ("b", "y")], "stem string, text string")
    names = spark.createDataFrame([("a.docx",)], "name string")
    assert {r.source for r in S.source_names(staged, names).collect()} == {"a.docx", "b.pdf"}
    made = S.rewrite_remote(df, "id", "text", lambda pairs: {i: p.upper() for i, p in pairs})
    assert made.first().rewritten == "X"


# ---- streams


def test_accumulate(spark, tmp_path):
    schema = "conv_id bigint, seq bigint, piece string"
    rows = [(1, 0, "<think>no"), (1, 1, "t</think> Xin"), (1, 2, " chào"), (2, 0, "a"), (2, 1, None)]
    df = spark.createDataFrame(rows, schema)
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = A.accumulate(stream).writeStream.format("memory").queryName("grown").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("grown").collect()} == {(1, 1, "Xin"), (1, 2, "Xin chào"), (2, 0, "a"), (2, 1, "a")}
    assert {(r.conv_id, r.answer) for r in A.accumulate_batch(df).collect()} == {(1, "Xin chào"), (2, "a")}


def test_conversation_store(spark, tmp_path):
    schema = "conv_id bigint, op string, text string"
    spark.createDataFrame([(1, "new", None), (1, "submit", " xin  chào "), (1, "finish", "x"), (2, "submit", "b"), (2, "delete", None)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = A.conversation_store(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("stored").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("stored").collect()} == {(1, "xin chào", 2, False), (2, "", 0, True)}
    stores = spark.createDataFrame([([("a", "t"), (None, "u"), ("", "v")], "gone")], "convos array<struct<id:string,title:string>>, active string")
    got = A.normalise_store(stores).first()
    assert [c.id for c in got.convos] == ["a"] and got.active == "a"


def test_windows_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = A.tumbling(stream, "1 hour", "10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("tumbled").select("start", "event_type", "n").collect())) == sorted(map(str, A.tumbling(events).select("start", "event_type", "n").collect()))


def test_sinks(spark, tmp_path):
    spark.createDataFrame([(1, 0.5), (2, 0.25)], "step int, loss double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("step int, loss double").parquet(str(tmp_path / "in"))
    for start, out in ((S.append_metrics, "log"), (S.stage_partial, "part")):
        q = start(stream, str(tmp_path / out), str(tmp_path / f"{out}-ck")).start()
        q.processAllAvailable()
        q.stop()
    assert spark.read.schema("step int").json(str(tmp_path / "log")).count() == 2
    assert spark.read.parquet(str(tmp_path / "part")).count() == 2
