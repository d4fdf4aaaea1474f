"""Document folders as a data source: rows, partitions, offsets."""

import os

from docloom.sources import folder


def write(root, name, data, changed):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    os.utime(path, ns=(changed, changed))


def test_files_and_partitions(spark, tmp_path):
    for i in range(6):
        write(tmp_path, f"a/b{i}.txt", b"x" * (100_000 * i), 1_000 + i)
    for name in ("_SUCCESS", ".hidden/x.txt", "c.MD", "plain"):
        write(tmp_path, name, b"y", 9_000)
    folder.register(spark)
    rows = spark.read.format("docfolder").option("maxbytes", 400_000).load(str(tmp_path))
    got = {r.name: (r.ext, r.size, len(r.content)) for r in rows.collect()}
    assert got == {**{f"b{i}.txt": ("txt", 100_000 * i, 100_000 * i) for i in range(6)}, "c.MD": ("md", 1, 1), "plain": ("", 1, 1)}
    parts = folder.Reader({"path": str(tmp_path), "maxbytes": "400000"}).partitions()
    assert rows.rdd.getNumPartitions() == len(parts) and [len(p.files) for p in parts] == [2, 1, 1, 1, 1, 2]
    assert {r.name for r in spark.read.format("docfolder").option("exts", "md, .xlsx").load("file://" + str(tmp_path)).collect()} == {"c.MD"}


def test_empty_folders_and_files_that_go(spark, tmp_path):
    folder.register(spark)
    assert spark.read.format("docfolder").load(str(tmp_path)).count() == 0
    write(tmp_path, "a.txt", b"", 5)
    reader = folder.Reader({"path": str(tmp_path)})
    (part,) = reader.partitions()
    assert next(reader.read(part)).to_pylist()[0]["content"] == b""
    (tmp_path / "a.txt").unlink()
    assert next(reader.read(part)).to_pylist()[0]["content"] is None


def test_a_stream_goes_on_after_its_offset(spark, tmp_path):
    source, marks = tmp_path / "in", str(tmp_path / "marks")
    folder.register(spark)
    seen = []

    def run():
        rows = spark.readStream.format("docfolder").option("path", str(source)).load()
        query = rows.writeStream.foreachBatch(lambda df, i: seen.append(sorted(r.name for r in df.collect()))).option("checkpointLocation", marks).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    write(source, "one.txt", b"1", 10**9)
    write(source, "two.txt", b"2", 10**9)
    run()
    write(source, "three.txt", b"3", 2 * 10**9)
    run()
    assert [x for x in seen if x] == [["one.txt", "two.txt"], ["three.txt"]]
    stream = folder.StreamReader({"path": str(source)})
    start, end = stream.initialOffset(), stream.latestOffset()
    assert end == {"changed": 2 * 10**9, "path": str(source / "three.txt")}
    assert [f.path.rsplit("/", 1)[-1] for p in stream.partitions(start, end) for f in p.files] == ["one.txt", "two.txt", "three.txt"]
    assert stream.partitions(end, end) == []
