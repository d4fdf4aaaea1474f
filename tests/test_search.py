"""The stored index, dense search, codes and gapless numbers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import lexical as X
from docloom.operators import retrieval as R
from docloom.operators import vectors as V
from docloom.operators.numbering import number_rows
from docloom.tables import Workspace


def some_docs(spark, n=700, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(["aa", "bb", "cc", "dd", f"r{rng.randrange(60)}"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(60))), "clash") for i in range(n)] + [(n, None, ""), (n + 1, " . ", "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, term string")


def hits(df):
    return {(r.qid, r.doc, r["rank"], round(r.bm25, 6)) for r in df.collect()}


def test_index_outlives_queries_and_takes_batches(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 8)
    docs = some_docs(spark)
    asked = spark.createDataFrame([(i, f"r{i} r{i + 1} aa r{i}") for i in range(12)] + [(50, "nothing"), (51, None)], "qid int, text string")
    want = hits(R.bm25(asked, R.build_index(docs), k=5, digits=6))
    index = X.StoredIndex(spark, Workspace(spark, "test").root)
    assert X.search(asked, index).count() == 0 and index.segments() == []
    for i in range(3):
        index.add(docs.filter(F.col("doc_id") % 3 == i))
    index.add(docs.limit(0))
    assert len(index.segments()) == 3
    again = X.StoredIndex(spark, index.path)  # as another session would open it
    read = []
    assert hits(X.search(asked, again, k=5, digits=6, read=read)) == want
    assert read[0][0] < read[0][1]  # some postings could not enter the best and were not read
    freq = {r.term: r.df for r in R.build_index(docs).frequencies.collect()}
    assert {r.term: r.df for r in again.frequencies().collect()} == freq
    index.compact()
    assert len(index.segments()) == 1 and hits(X.search(asked, index, k=5, digits=6)) == want
    more = spark.createDataFrame([(9000, ""), (9001, "r1 r2 aa")], "doc_id bigint, text string")
    whole = docs.select("doc_id", "text").unionByName(more)
    assert hits(X.search(asked, index.add(more), k=5, digits=6)) == hits(R.bm25(asked, R.build_index(whole), k=5, digits=6))


def test_blocks_are_skipped_where_scores_differ(spark, monkeypatch):
    """Long texts with one mention cannot compete with short ones: most of their blocks stay unread."""
    monkeypatch.setattr(X, "BLOCK", 10)
    rows = [(i, "gold silver") for i in range(10)] + [(i, "gold " + "filler " * (50 + i)) for i in range(10, 500)]
    index = X.StoredIndex(spark, Workspace(spark, "test").root).add(spark.createDataFrame(rows, "doc_id bigint, text string"))
    read = []
    got = X.search(spark.createDataFrame([(1, "silver gold")], "qid int, text string"), index, k=5, first=1, read=read).collect()
    assert sorted(r.doc for r in got) == [0, 1, 2, 3, 4] and read[0][0] <= 3 and read[0][1] >= 50


def test_a_half_written_segment_is_not_read(spark):
    index = X.StoredIndex(spark, Workspace(spark, "test").root)
    index.add(spark.createDataFrame([(1, "alpha")], "doc_id bigint, text string"))
    spark.createDataFrame([("beta", 1)], "term string, df bigint").write.parquet(f"{index.path}/s000002/terms")
    assert index.segments() == ["s000001"] and [r.term for r in index.frequencies().collect()] == ["alpha"]
    index.add(spark.createDataFrame([(2, "gamma")], "doc_id bigint, text string"))
    assert index.segments() == ["s000001", "s000003"]


def test_rows_of_one_key_rank_apart(spark):
    rows = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha"), (2, "beta"), (3, "delta"), (4, "eta"), (5, "zeta"), (6, "iota")]
    index = X.StoredIndex(spark, Workspace(spark, "test").root).add(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = X.search(spark.createDataFrame([(1, "alpha")], "qid int, text string"), index).collect()
    assert sorted((r.doc is None, r.doc or 0) for r in got) == [(False, 1), (False, 1), (True, 0)] and {r["rank"] for r in got} == {1, 2, 3}


def test_vectors_without_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [3e300, 3e300]), (8, [1.0, 0.0, 0.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "doc int, vector array<double>")
    got = V.nearest(df.withColumnRenamed("doc", "qid"), df, 3, digits=6)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.qid, r["rank"])):
        found.setdefault(r.qid, []).append((r.doc, r.score))
    assert set(found) == {1, 7, 8, 9} and found[1] == [(1, 1.0), (9, 1.0), (9, 1.0)] and found[8] == [(8, 1.0)] and found[7][0] == (7, 1.0)
    assert V.nearest(df.withColumnRenamed("doc", "qid"), df.limit(0), 3).count() == 0
    codes = V.build_codes(df, Workspace(spark, "test"), sample=3)
    assert {(r.qid, r.doc) for r in V.nearest_coded(df.withColumnRenamed("doc", "qid"), df, codes, 3).collect()} >= {(1, 1), (8, 8), (7, 7)}


def test_ties_take_the_least_documents():
    assert sorted(V.best_of(np.array([0.5, 0.9, 0.5, 0.5]), [4, 9, 1, 3], 3)) == [1, 2, 3]


def test_codes_find_nine_of_ten_with_few_comparisons(spark):
    """Every id divisible by 50 against all rows: recall and the share of pairs that are compared exactly."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    asked = vectors.filter("doc % 50 = 0").withColumnRenamed("doc", "qid")
    exact = {(r.qid, r.doc) for r in R.dense(asked, vectors, 10).collect()}
    found = {(r.qid, r.doc) for r in R.dense_approximate(asked, vectors, 10).collect()}
    assert V.RERANK * 10 / vectors.count() < 0.05
    assert len(exact & found) / len(exact) >= 0.9


@pytest.mark.parametrize("by", [(), ("g",)])
def test_numbers_without_gaps(spark, by):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2]), rng.choice([None, *range(40)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, x int, i int").repartition(5)
    got = number_rows(df, [F.col("x").asc_nulls_first(), F.col("i").asc()], by, "n", parts=7).collect()
    want, seen = {}, {}
    for g, x, i in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        key = g if by else 0
        seen[key] = want[i] = seen.get(key, 0) + 1
    assert {r.i: r.n for r in got} == want
    assert number_rows(df.limit(0), [F.col("x").asc()]).count() == 0


def test_postings_are_written_in_parts_that_grow_with_the_batch(spark, monkeypatch):
    """A folder is no longer one task's: most rows of a file are a small share, and results stay."""
    monkeypatch.setattr(X, "BLOCK", 8)
    docs = some_docs(spark)
    asked = spark.createDataFrame([(i, f"r{i} r{i + 1} aa r{i}") for i in range(12)], "qid int, text string")
    want = hits(R.bm25(asked, R.build_index(docs), k=5, digits=6))
    for name, value in (("TOKENS", 128), ("RUN", 4), ("RANGE", 64)):
        monkeypatch.setattr(X, name, value, raising=False)
    index = X.StoredIndex(spark, Workspace(spark, "test").root).add(docs)
    rows = [r["count"] for r in index.postings().groupBy(F.input_file_name()).count().collect()]
    assert max(rows) < sum(rows) / 16
    assert hits(X.search(asked, index, k=5, digits=6)) == want


def test_scores_are_held_for_some_questions_at_a_time(spark):
    from docloom.operators import vectors as V

    assert V.ASKED * V.BLOCK * 8 <= 16 << 20
    rows = spark.createDataFrame([(i, [float(i % 7) + 1, float(i % 11), float(i % 13)]) for i in range(600)], "doc int, vector array<double>").coalesce(1)
    asked = rows.filter("doc < 520").withColumnRenamed("doc", "qid")
    got = V.nearest(asked, rows, 1, digits=6).collect()
    assert sorted(r.qid for r in got) == list(range(520)) and all(r.score == 1.0 for r in got)


def test_term_counts_need_no_index(spark, sf, tmp_path):
    """The query of all terms writes no table of its own, and has the terms, counts and weights of an index."""
    from docloom.plans import catalogue
    from docloom.tables import _ROOTS

    docs = some_docs(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = len(_ROOTS)
    got = {(r.term, r.df, r.idf) for r in catalogue.QUERIES["term_df"](spark, str(tmp_path)).collect()}
    assert len(_ROOTS) == made
    assert got == {(r.term, r.df, r.idf) for r in R.build_index(docs).frequencies.withColumn("idf", F.round("idf", 6)).collect()}
    assert R.frequencies(docs.limit(0)).count() == 0


def _moved(spark):
    """Bytes that all tasks so far have written for shuffles."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_an_index_is_built_and_read_without_moving_texts(spark, monkeypatch):
    """Blocks are inverted where their documents are, and sums by question and document stay in their task."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 200)))) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(300)}" for _ in range(20))) for i in range(60)], "qid int, text string")
    size = sum(len(text) for _, text in rows)
    before = _moved(spark)
    index = X.StoredIndex(spark, Workspace(spark, "test").root).add(docs)
    built = _moved(spark)
    got = hits(X.search(asked, index, k=5, digits=6))
    assert built - before < size / 8 and _moved(spark) - built < 2 * size
    assert got == hits(R.bm25(asked, R.build_index(docs), k=5, digits=6))
    assert index.places().agg(F.sum(F.size("docs"))).first()[0] == 4000
    monkeypatch.setattr(X, "ASKED", 7)
    monkeypatch.setattr(X, "TERMS", 11)
    assert hits(X.search(asked, index, k=5, digits=6)) == got
