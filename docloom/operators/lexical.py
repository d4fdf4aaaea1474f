"""A stored BM25 index: postings that outlive a query, batches that are added, and search that skips blocks.

A segment holds the postings of one batch. Each task puts its documents in order of length, cuts them into blocks of
``BLOCK`` and inverts a block at a time, so that neither texts nor postings move. A row is one term in one block: the places
of its documents in the block and its counts there, with the greatest count and the least length, from which no document of the
block can score more; keys and lengths stand once for each block, in the folder ``PLACES``. Rows are written in folders
by a hash of the term, sorted by term, so a query reads the folders and row groups of its own terms. Frequencies and
lengths are kept by segment and summed when read, so adding a batch rewrites nothing; ``compact`` merges segments once there
are ``SEGMENTS``.

Search. The bounds of a question's terms are summed by block. The best blocks are scored first; their k-th score is what a
block's bound must reach for its documents to be scored. The postings of a block meet in one task and are scored as a product of
two matrices, weights by terms and documents; only scores that can still enter a question's best go on. The result is exact.

Edge cases: null and empty texts count as documents without terms; rows that share a key, or have none, are documents of
their own, each with its own place in a ranking; an empty batch adds no segment, and an index without segments gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom.functions import text as X
from docloom.operators.retrieval import weigh
from docloom.tables import Workspace, ship

BLOCK, BUCKETS, SEGMENTS, FIRST = 128, 8, 8, 2
#: The folder of the blocks' own rows, beside those of terms.
PLACES = -1
#: Blocks for a task of a search; questions and terms of a block whose numbers are held at a time.
DEALT, ASKED, TERMS = 64, 256, 4096
#: Most bytes of questions whose terms are broadcast to the postings.
QUERY_BYTES = 64 << 20


def _schema(kind: str) -> str:
    return f"term string, block bigint, slots array<int>, tfs array<bigint>, most_tf bigint, least_len bigint, docs array<struct<doc:{kind},len:bigint>>, bucket int"


def _block(place: int, docs: pa.Array, lens: pa.Array, words: pa.Array) -> pa.RecordBatch:
    """The rows of one block: its terms, and one for its documents."""
    length = lens.to_numpy()
    cut = pc.split_pattern(words, " ")
    slot = np.repeat(np.arange(len(docs)), cut.value_lengths().to_numpy())
    has = length[slot] > 0  # an empty text is cut to one empty word
    coded = cut.flatten().filter(pa.array(has)).dictionary_encode()
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(docs) + slot[has], return_counts=True)
    term, slot = np.divmod(pairs, len(docs))
    begin = np.flatnonzero(np.diff(term, prepend=-1))
    n = begin.size
    ends = pa.array(np.concatenate([begin, [pairs.size] * 2]), pa.int32())
    lists = lambda values, kind: pa.ListArray.from_arrays(ends, pa.array(values, kind))
    least = lambda of, values: of.reduceat(values, begin) if n else np.empty(0)
    own = pa.StructArray.from_arrays([docs, lens], ["doc", "len"])
    nothing = lambda kind: pa.nulls(1, kind)
    columns = {
        "term": pa.concat_arrays([coded.dictionary, nothing(coded.dictionary.type)]),
        "block": pa.array(np.full(n + 1, place), pa.int64()),
        "slots": lists(slot, pa.int32()),
        "tfs": lists(tf, pa.int64()),
        "most_tf": pa.concat_arrays([pa.array(least(np.maximum, tf), pa.int64()), nothing(pa.int64())]),
        "least_len": pa.concat_arrays([pa.array(least(np.minimum, length[slot]), pa.int64()), nothing(pa.int64())]),
        "docs": pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(docs)], pa.int32()), own),
    }
    return pa.RecordBatch.from_pydict(columns)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            docs, lens, words, place = (c.slice(i, size) for c in batch.columns)
            yield _block(place[0].as_py(), docs, lens, words)


@dataclass(frozen=True)
class StoredIndex:
    """The index in the folder ``path``, which all executors share."""

    spark: SparkSession
    path: str

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def segments(self) -> list[str]:
        """Names of the complete segments; one that a lost job left half written has no mark and is not read."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
        done = [n for n in names if fs.exists(self._fs(f"{self.path}/{n}/totals/_SUCCESS")[1])]
        # a merged segment names those it stands for
        gone = {x for n in done for x in n.split(".")[1:]}
        return [n for n in done if n.split(".")[0] not in gone]

    def _read(self, what: str) -> DataFrame | None:
        out = None
        for n in self.segments():
            part = self._part_of(n, what).withColumn("segment", F.lit(n))
            out = part if out is None else out.unionByName(part)
        return out

    def _part_of(self, name: str, what: str) -> DataFrame:
        reader = self.spark.read
        if what in ("postings", "places"):  # a batch without any term has no files to tell the columns
            rows = reader.schema(_schema(self.spark.read.parquet(f"{self.path}/{name}/totals").first()["kind"])).parquet(f"{self.path}/{name}/postings")
            return rows.filter(F.col("bucket") != PLACES).drop("docs") if what == "postings" else rows.filter(F.col("bucket") == PLACES).select("block", "docs")
        return reader.parquet(f"{self.path}/{name}/{what}")

    def _write(self, name: str, rows: DataFrame, kind: str) -> None:
        """A segment of ``rows`` as ``_block`` makes them; each task writes its own part of a folder. Totals go last: their mark completes the segment."""
        bucket = F.coalesce(F.pmod(F.xxhash64("term"), F.when(F.col("term").isNotNull(), BUCKETS)).cast("int"), F.lit(PLACES))
        rows.withColumn("bucket", bucket).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/{name}/postings")
        stored = self.spark.read.schema(_schema(kind)).parquet(f"{self.path}/{name}/postings")
        totals = stored.filter(F.col("bucket") == PLACES).select(F.size("docs").cast("long").alias("n"), F.aggregate("docs", F.lit(0).cast("long"), lambda s, d: s + d["len"]).alias("length"))
        totals = totals.agg(F.sum("n").alias("n"), F.sum("length").alias("length")).select("n", "length", F.lit(kind).alias("kind"))
        if totals.first()["n"] is None:  # an empty batch
            fs, p = self._fs(f"{self.path}/{name}")
            fs.delete(p, True)
            return
        stored.filter(F.col("bucket") != PLACES).groupBy("term").agg(F.sum(F.size("slots").cast("long")).alias("df")).write.parquet(f"{self.path}/{name}/terms")
        totals.coalesce(1).write.parquet(f"{self.path}/{name}/totals")

    def _next(self, stands_for: list[str] | None = None) -> str:
        fs, p = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        number = 1 + max([int(n.split(".")[0][1:]) for n in names if n[:1] == "s"], default=0)
        return ".".join([f"s{number:06d}", *[n.split(".")[0] for n in stands_for or []]])

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", compact: bool = True) -> "StoredIndex":
        """Index a batch; segments are merged once there are ``SEGMENTS``."""
        ship(self.spark)
        size, kind = BLOCK, docs.schema[key].dataType.simpleString()
        line = docs.select(F.col(key).alias("doc"), X.term_line(F.coalesce(F.col(text), F.lit(""))).alias("words"))
        spaces = F.length("words") - F.length(F.replace(F.col("words"), F.lit(" "), F.lit("")))
        line = line.select("doc", F.when(F.col("words") == "", 0).otherwise(spaces + 1).cast("long").alias("len"), "words")
        # a place names its task too, so those of all blocks differ
        line = line.sortWithinPartitions("len", F.col("doc").asc_nulls_first()).withColumn("place", F.monotonically_increasing_id())
        rows = line.mapInArrow(lambda batches: _blocks(batches, size), _schema(kind).replace(", bucket int", ""))
        self._write(self._next(), rows, kind)
        if compact and len(self.segments()) >= SEGMENTS:
            self.compact()
        return self

    def compact(self) -> "StoredIndex":
        """All segments as one; blocks stay as they are, under new numbers. The old ones go once the new one is complete."""
        old = self.segments()
        if len(old) < 2:
            return self
        rows, begin = None, 0
        kind = self._read("totals").first()["kind"]
        for n in old:
            part = self.spark.read.schema(_schema(kind)).parquet(f"{self.path}/{n}/postings")
            last = part.agg(F.max("block")).first()[0]
            part = part.withColumn("block", F.col("block") + F.lit(begin))
            begin += 1 + last
            rows = part if rows is None else rows.unionByName(part)
        self._write(self._next(old), rows.drop("bucket"), kind)
        for n in old:
            fs, p = self._fs(f"{self.path}/{n}")
            fs.delete(p, True)
        return self

    def postings(self) -> DataFrame:
        """segment, bucket, term, block, slots (places in the block), tfs (counts there), most_tf, least_len."""
        return self._read("postings")

    def places(self) -> DataFrame:
        """segment, block, docs (doc, len) in order of their places."""
        return self._read("places")

    def totals(self) -> DataFrame:
        """n and mean length, one row."""
        return self._read("totals").agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("mean"))

    def frequencies(self, epsilon: float = 0.25) -> DataFrame:
        """term, df, idf; a negative inverse frequency is ``epsilon`` times the mean of all."""
        df = self._read("terms").groupBy("term").agg(F.sum("df").alias("df"))
        return weigh(df, self.totals().select("n"), epsilon)


def _part(weight: Column, tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _score(rows: pa.Table, own: pa.Table, schema: pa.Schema, mean: float, k1: float, b: float) -> pa.Table:
    """qid, doc and bm25 of a block. ``rows``: slots and tfs of terms, with asks (qid, weight, least); ``own``: docs and the qids that want it."""
    if not rows.num_rows or not own.num_rows:
        return schema.empty_table()
    docs = own["docs"].combine_chunks().flatten()
    asks, slots = rows["asks"].combine_chunks(), rows["slots"].combine_chunks()
    n, size, length = rows.num_rows, len(docs), docs.field("len").to_numpy()
    slot, tf = slots.flatten().to_numpy(), rows["tfs"].combine_chunks().flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(slots.value_lengths().to_numpy())])
    term = np.repeat(np.arange(n), np.diff(ends))
    part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[slot] / mean))
    ask, of = asks.flatten(), np.repeat(np.arange(n), asks.value_lengths().to_numpy())
    wanted = pc.is_in(ask.field("qid"), value_set=own["qids"].combine_chunks().flatten())
    ask, of = ask.filter(wanted), of[wanted.to_numpy(zero_copy_only=False)]
    coded, weight = ask.field("qid").dictionary_encode(), ask.field("weight").to_numpy()
    code = coded.indices.to_numpy()
    least = np.full(len(coded.dictionary), -np.inf)
    least[code] = pc.fill_null(ask.field("least"), -np.inf).to_numpy()
    found = []
    for i in range(0, least.size, ASKED):
        some = (code >= i) & (code < i + ASKED)
        scores = np.zeros((min(ASKED, least.size - i), size))
        for j in range(0, n, TERMS):
            now, held = some & (of >= j) & (of < j + TERMS), slice(ends[j], ends[min(n, j + TERMS)])
            weights, parts = np.zeros((scores.shape[0], min(TERMS, n - j))), np.zeros((min(TERMS, n - j), size))
            weights[code[now] - i, of[now] - j] = weight[now]
            parts[term[held] - j, slot[held]] = part[held]
            scores += weights @ parts
        q, at = np.nonzero((scores > 0) & (scores >= least[i : i + ASKED, None]))
        found.append(pa.table([coded.dictionary.take(pa.array(q + i)), docs.field("doc").take(pa.array(at)), pa.array(scores[q, at])], schema=schema))
    return pa.concat_tables(found) if found else schema.empty_table()


def search(questions: DataFrame, index: StoredIndex, k: int = 40, k1: float = 1.5, b: float = 0.75, digits: int | None = None, first: int = FIRST, read: list | None = None) -> DataFrame:
    """qid, doc, bm25 and rank of the ``k`` best documents of positive score, as ``retrieval.bm25`` has them.

    ``read``, if given, is extended by (rows of postings that were read, rows of the questions' terms).
    """
    spark = index.spark
    if not index.segments():
        return spark.createDataFrame([], f"qid {questions.schema['qid'].dataType.simpleString()}, doc bigint, bm25 double, rank int")
    work = Workspace(spark, "search")
    asked = questions.select("qid", F.explode(X.terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weighed = asked.join(index.frequencies(), "term").crossJoin(F.broadcast(index.totals().select("mean")))
    weighed = weighed.select("qid", "term", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket"), (F.col("qtf") * F.col("idf")).alias("weight"), "mean")
    weighed = work.save(weighed, "weighed")
    small = (questions.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= QUERY_BYTES
    sent = F.broadcast if small else (lambda df: df.hint("merge"))
    hits = index.postings().join(sent(weighed), ["bucket", "term"])
    # a term of negative weight adds nothing at best
    most = F.greatest(_part(F.col("weight"), F.col("most_tf"), F.col("least_len"), F.col("mean"), k1, b), F.lit(0.0))
    bounds = work.save(hits.groupBy("qid", "segment", "block").agg(F.sum(most).alias("bound"), F.count(F.lit(1)).alias("rows")), "bounds")
    best = Window.partitionBy("qid").orderBy(F.desc("bound"), "segment", "block")
    ahead = bounds.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= first).select("qid", "segment", "block")
    asked = index.postings().join(sent(weighed.select("bucket", "term").distinct()), ["bucket", "term"], "left_semi").select("segment", "block", "term", "slots", "tfs")
    mean, places = index.totals().first()["mean"], index.places()
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-places.count() // DEALT))
    kinds = f"qid {weighed.schema['qid'].dataType.simpleString()}, doc {places.schema['docs'].dataType.elementType['doc'].dataType.simpleString()}, bm25 double"

    def scored(blocks: DataFrame, least: DataFrame | None = None) -> DataFrame:
        """Scores of the questions' ``blocks``, which are few where no ``least`` is known; postings move once, by block, before they meet the questions."""
        ship(spark)
        blocks = blocks.groupBy("segment", "block").agg(F.collect_set("qid").alias("qids"))
        told = weighed.join(sent(least), "qid", "left") if least is not None else weighed.withColumn("least", F.lit(None).cast("double"))
        asks = told.filter("qid is not null").groupBy("term").agg(F.collect_list(F.struct("qid", "weight", "least")).alias("asks"))
        rows, by = asked, ["segment", "block"]
        if least is None and small:
            rows = rows.join(F.broadcast(blocks.select(*by)), by, "left_semi")
        rows = rows.repartition(dealt, *by).join(sent(asks), "term")
        own = places.join(blocks, by).repartition(dealt, *by)
        schema = to_arrow_schema(StructType.fromDDL(kinds))
        out = rows.groupBy(*by).cogroup(own.groupBy(*by)).applyInArrow(lambda a, b_: _score(a, b_, schema, mean, k1, b), kinds)
        return out.withColumn("bm25", F.round("bm25", digits)) if digits is not None else out

    order = Window.partitionBy("qid").orderBy(F.desc("bm25"), "doc")
    ranked = lambda rows: rows.filter("bm25 > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # sums in another order and rounding may differ by little; terms of negative weight count nowhere else
    least = ranked(scored(ahead)).filter(F.col("rank") == k).select("qid", (F.col("bm25") - 1e-9 - (10.0**-digits if digits is not None else 0)).alias("least"))
    least = work.save(least, "least")
    wanted = bounds.join(sent(least), "qid", "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    wanted = work.save(wanted.select("qid", "segment", "block", "rows"), "wanted")
    if read is not None:
        read.append((wanted.agg(F.sum("rows")).first()[0] or 0, bounds.agg(F.sum("rows")).first()[0] or 0))
    return ranked(scored(wanted, least))
