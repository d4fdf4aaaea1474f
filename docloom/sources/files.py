"""File sources and sinks. Files are read by Spark (``binaryFile``), so any store that Spark reads will do.

Office formats are parsed with the standard library in Arrow-fed Python: DOCX and XLSX are zipped XML, legacy DOC is an
OLE2 container. PDF text layers and OCR need external engines, plugged in as functions.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as X

SUPPORTED = ("pdf", "docx", "doc", "xlsx", "xls", "txt", "md")
#: A page whose text layer has fewer characters goes to OCR.
LEAST_PAGE_CHARS = 30
BLOCKS = "source string, ord int, kind string, table int, cells array<string>"


def list_files(spark: SparkSession, path: str, supported: tuple[str, ...] = SUPPORTED) -> tuple[DataFrame, DataFrame]:
    """Files to read and files skipped: path, name, ext, length, content. Names that begin with a dot are in neither."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    files = files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "length", "content").filter(~F.col("name").startswith("."))
    return files.filter(F.col("ext").isin(*supported)), files.filter(~F.col("ext").isin(*supported)).drop("content")


def table_markdown(rows: Column) -> Column:
    """Rows of cells as a Markdown table: ragged rows padded, the first is the header, newlines become spaces."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " "))
    padded = F.transform(rows, lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.array(line(F.array_repeat(F.lit("---"), width)))
    body = F.transform(padded, line)
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(body, 1, 1), rule, F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0)))), "\n")).otherwise(F.lit(""))


def html_text(html: Column) -> Column:
    """All text of a page, tags and scripts out: the plain form; see the training-data operators for the main text."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    return X.squeeze(F.regexp_replace(t, "<[^>]*>", " "))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_blocks(content: bytes) -> list[tuple[str, int, list[str]]]:
    """Paragraphs and table rows in order: (kind, table number, cells)."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    text = lambda e: "".join((t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    out, table = [], 0
    for block in body if body is not None else ():
        if block.tag == f"{_W}p":
            out.append(("para", table, [text(block)]))
        elif block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                cells = []
                for cell in row.findall(f"{_W}tc"):
                    span = cell.find(f"{_W}tcPr/{_W}gridSpan")
                    value = "\n".join(text(p) for p in cell.findall(f"{_W}p"))
                    cells += [value] * (int(span.get(f"{_W}val", "1")) if span is not None else 1)
                out.append(("row", table, cells))
            table += 1
    return out


def xlsx_blocks(content: bytes) -> list[tuple[str, int, list[str]]]:
    """Every sheet: its name as a paragraph, then its rows."""
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    names = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
    out = []
    for i, (name, path) in enumerate(zip(names, sheets)):
        out.append(("para", i, [f"## Sheet: {name}"]))
        for row in ElementTree.fromstring(z.read(path)).iter(f"{_S}row"):
            cells: list[str] = []
            for c in row.findall(f"{_S}c"):
                letters = re.match("[A-Z]+", c.get("r", "") or "")
                if letters:
                    column = 0
                    for ch in letters[0]:
                        column = column * 26 + ord(ch) - 64
                    cells += [""] * (column - 1 - len(cells))
                v = c.find(f"{_S}v")
                if c.get("t") == "s" and v is not None:
                    cells.append(shared[int(v.text)])
                elif c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{_S}t")))
                else:
                    cells.append(v.text or "" if v is not None else "")
            out.append(("row", i, cells))
    return out


def _ole_streams(data: bytes) -> dict[str, bytes]:
    """The streams of an OLE2 container by name."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("not an OLE2 file")
    size, mini_size = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    first_dir, cutoff, first_mini = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0]
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    heads = list(struct.unpack_from("<109I", data, 76))
    more = struct.unpack_from("<I", data, 68)[0]
    while more < 0xFFFFFFFA:
        block = struct.unpack(f"<{size // 4}I", sector(more))
        heads += block[:-1]
        more = block[-1]
    fat: list[int] = []
    for h in heads:
        if h < 0xFFFFFFFA:
            fat += struct.unpack(f"<{size // 4}I", sector(h))

    def chain(i: int, table: list[int], part: Callable[[int], bytes]) -> bytes:
        out, seen = [], set()
        while i < 0xFFFFFFFA and i not in seen and i < len(table):
            seen.add(i)
            out.append(part(i))
            i = table[i]
        return b"".join(out)

    entries = chain(first_dir, fat, sector)
    found = {}
    for at in range(0, len(entries), 128):
        e = entries[at : at + 128]
        n = struct.unpack_from("<H", e, 64)[0]
        found[e[: max(0, n - 2)].decode("utf-16-le", "ignore")] = (e[66], struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<I", e, 120)[0])
    root = next((v for v in found.values() if v[0] == 5), None)
    mini = chain(root[1], fat, sector) if root else b""
    mini_table = list(struct.unpack(f"<{size // 4 * (len(raw := chain(first_mini, fat, sector)) // size)}I", raw)) if first_mini < 0xFFFFFFFA else []
    small = lambda i: mini[i * mini_size : (i + 1) * mini_size]
    return {k: (chain(s, mini_table, small) if n < cutoff else chain(s, fat, sector))[:n] for k, (kind, s, n) in found.items() if kind == 2}


def valid_share(text: str) -> float:
    """Share of characters that running text would have."""
    good = sum(c.isalnum() or c in " \n\r\t.,;:!?()[]-–/\"'%&|\x07\x0b\x0c" for c in text)
    return good / len(text) if text else 0.0


def decode_auto(raw: bytes) -> str:
    """UTF-16 or Windows-1252, whichever reads better."""
    return max((raw.decode("utf-16-le", "ignore"), raw.decode("cp1252", "ignore")), key=valid_share)


def doc_text(content: bytes) -> str:
    """Text of a legacy Word file, by its piece table; the whole main stream, guessed, where that cannot be read."""
    streams = _ole_streams(content)
    main = streams.get("WordDocument", b"")
    if len(main) < 0x1AA:
        return ""
    flags = struct.unpack_from("<H", main, 10)[0]
    table = streams.get("1Table" if flags & 0x200 else "0Table", b"")
    at, n = struct.unpack_from("<II", main, 0x1A2)
    clx, i, out = table[at : at + n], 0, []
    while i < len(clx):
        if clx[i] == 1:
            i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
            continue
        if clx[i] != 2:
            break
        size = struct.unpack_from("<I", clx, i + 1)[0]
        pieces = (size - 4) // 12
        ends = struct.unpack_from(f"<{pieces + 1}I", clx, i + 5)
        for p in range(pieces):
            where = struct.unpack_from("<I", clx, i + 5 + 4 * (pieces + 1) + 8 * p + 2)[0]
            k = ends[p + 1] - ends[p]
            if where & 0x40000000:
                begin = (where & 0x3FFFFFFF) // 2
                out.append(main[begin : begin + k].decode("cp1252", "ignore"))
            else:
                out.append(main[where : where + 2 * k].decode("utf-16-le", "ignore"))
        break
    return "".join(out) if out else decode_auto(main[0x200:])


def plain_controls(text: Column) -> Column:
    """Word's control characters as text: cells as bars, breaks as newlines, fields and the rest out; lines trimmed on the right."""
    t = F.translate(text, "\x07\x0b\x0c\r\x1e\x1f\xa0", "|\n\n\n-\x01 ")
    t = F.regexp_replace(F.regexp_replace(t, r"\x13[^\x14\x15]*\x14?|\x15", ""), r"[\x00-\x08\x0E-\x1F]", "")
    return F.regexp_replace(t, r"(?m)[ \t]+$", "")


_READERS: dict[str, Callable[[bytes], list[tuple[str, int, list[str]]]]] = {
    "docx": docx_blocks,
    "xlsx": xlsx_blocks,
    "doc": lambda b: [("para", 0, [line]) for line in doc_text(b).replace("\r", "\n").split("\n")],
    "txt": lambda b: [("para", 0, [line]) for line in b.decode("utf-8", "ignore").splitlines()],
    "md": lambda b: [("para", 0, [line]) for line in b.decode("utf-8", "ignore").splitlines()],
}


def read_blocks(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """Files (name, ext, content) to blocks (source, ord, kind: para, row or error, table, cells).

    A file that cannot be read gives one block of kind error and does not stop the others; so does one whose format has
    no reader here (PDF, for which pass one in ``readers``).
    """
    by_ext = {**_READERS, **(readers or {})}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, ext, content in zip(f["name"], f["ext"], f["content"], strict=True):
                try:
                    if ext not in by_ext:
                        raise ValueError(f"no reader for .{ext}")
                    out += [(name, i, kind, table, cells) for i, (kind, table, cells) in enumerate(by_ext[ext](bytes(content)))]
                except Exception as e:  # any broken file becomes a row that says so
                    out.append((name, 0, "error", 0, [f"{type(e).__name__}: {e}"]))
            yield pd.DataFrame(out, columns=["source", "ord", "kind", "table", "cells"])

    return files.select("name", "ext", "content").mapInPandas(run, BLOCKS)


def block_text(blocks: DataFrame) -> DataFrame:
    """source and text: paragraphs as lines, each table as Markdown, in order."""
    order = F.sort_array(F.collect_list(F.struct("ord", "kind", "table", "cells")))
    grouped = blocks.filter("kind <> 'error'").withColumn("_t", F.when(F.col("kind") == "row", F.col("table")).otherwise(-1 - F.col("ord"))).groupBy("source", "_t").agg(F.min("ord").alias("ord"), order.alias("b"))
    one = F.when(F.col("_t") >= 0, table_markdown(F.transform("b", lambda x: x["cells"]))).otherwise(F.array_join(F.transform("b", lambda x: F.array_join(x["cells"], "\n")), "\n"))
    lines = grouped.select("source", F.struct("ord", one.alias("t")).alias("x"))
    return lines.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))


def needs_ocr(pages: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pages with a text layer, and those for OCR."""
    few = F.length(X.strip(F.coalesce(text, F.lit("")))) < LEAST_PAGE_CHARS
    return pages.filter(~few), pages.filter(few)


def ocr(pages: DataFrame, read: Callable[[bytes], str], image: str = "image") -> DataFrame:
    """Adds text by an external engine."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(text=[read(bytes(x)) for x in f[image]])

    return pages.drop("text").mapInPandas(run, pages.drop("text").schema.add("text", "string"))


def table_ocr(pages: DataFrame, read: Callable[[bytes], list[list[list[str | None]]]], image: str = "image") -> DataFrame:
    """path, page and text: the tables that an external engine finds on each page, in Markdown, an empty line between them.

    ``read`` gives a page's tables as rows of cells. Empty tables and pages without any are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "page": f["page"], "_tables": [read(bytes(x)) for x in f[image]]})

    found = pages.select("path", "page", image).filter(F.col(image).isNotNull()).mapInPandas(run, "path string, page int, _tables array<array<array<string>>>")
    made = F.filter(F.transform("_tables", table_markdown), lambda t: F.coalesce(t, F.lit("")) != "")
    return found.select("path", "page", F.array_join(made, "\n\n").alias("text")).filter("text <> ''")


# ---- chunk, question and message files


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """id, text, metadata and a vector of floats; the collection is replaced."""
    df.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


QA_COLUMNS = ("id", "category", "question", "answer", "source_refs", "notes")
#: Name endings of backups, which no reader takes for sources.
BACKUPS = (".bak.csv", ".truoc-tinhchinh.csv")


def read_qa(spark: SparkSession, path: str, glob: str = "*.csv", required: tuple[str, ...] = ("question", "answer")) -> DataFrame:
    """Question files as strings, empty for missing; backups are left out, and so are files without the required columns."""
    raw = spark.read.option("pathGlobFilter", glob).format("binaryFile").load(path).select("path")
    paths = [r.path for r in raw.collect() if not r.path.endswith(BACKUPS)]  # one row for each file
    out = None
    for p in sorted(paths):
        df = spark.read.csv(p, header=True, multiLine=True, escape='"', quote='"')
        if not set(required) <= set(df.columns):
            continue
        df = df.select([F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]).withColumn("origin", F.lit(p.rsplit("/", 1)[-1]))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (*QA_COLUMNS, "origin")))
    return out.na.fill("")


def write_qa(df: DataFrame, path: str) -> None:
    """All fields quoted, with a header."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_version(df: DataFrame, root: str, version: str) -> str:
    """A new version beside the old ones, which stay as backups: a table cannot be written over while it is read."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").alias("question"))


def append_metrics(stream: DataFrame, path: str, checkpoint: str):
    """An append-only JSON log of a stream of metrics."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def stage_partial(stream: DataFrame, path: str, checkpoint: str):
    """Rewritten rows written batch by batch, so that a run goes on where it stopped."""
    return stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch={i}")).option("checkpointLocation", checkpoint)


def source_names(staged: DataFrame, originals: DataFrame) -> DataFrame:
    """Staged texts (stem, text) with the names of their originals; a missing one is taken for a PDF."""
    own = originals.select(F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"), "name").dropDuplicates(["stem"])
    return staged.join(own, "stem", "left").select(F.coalesce("name", F.concat("stem", F.lit(".pdf"))).alias("source"), "text")


def rewrite_remote(rows: DataFrame, id_: str, prompt: str, submit: Callable[[list[tuple[str, str]]], dict[str, str]]) -> DataFrame:
    """Adds rewritten, from a batch service that answers by id; null where it has none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = submit(list(zip(f[id_].astype(str), f[prompt], strict=True)))
            yield pd.DataFrame({id_: f[id_], "rewritten": [made.get(str(i)) for i in f[id_]]})

    done = rows.select(id_, prompt).mapInPandas(run, rows.select(id_).schema.add("rewritten", "string"))
    return rows.join(done, id_, "left")
