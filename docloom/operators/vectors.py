"""Nearest vectors by cosine in dense blocks: exact, and over product codes with an exact second look.

Vectors are normalised once and packed, some thousands to a row, as one matrix; a pair of blocks is one matrix product in
a task, which passes on at most ``k`` rows for each question. The stated questions meet every block of vectors;
their blocks are broadcast if their checked size allows, else paired by Spark.

Codes: the components are cut into groups, each group is coded by the nearest of 256 trained words, so a
vector is as many bytes as there are groups. Every row is coded; the words are trained on a bounded sample. Codes rank the
candidates, of which ``rerank`` times ``k`` for each question are compared exactly.

Edge cases: vectors that are null, empty, all zero or hold a null, NaN or infinite component have no direction and are
left out; vectors of another length meet only questions of that length; equal scores rank by document; repeated rows are
rows of their own; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.tables import Workspace, ship

#: Vectors of a block; questions whose scores over a block are held at a time; bytes of packed questions that are broadcast.
BLOCK, ASKED, QUESTION_BYTES = 4096, 256, 64 << 20
#: Bytes of a code, words of each group, vectors of the training sample at most, training rounds.
GROUPS, CODEWORDS, SAMPLE, ROUNDS = 16, 256, 16_384, 12
RERANK = 8


def usable(rows: DataFrame, vector: str = "vector") -> DataFrame:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.filter(v.isNotNull() & (F.size(v) > 0) & fine)


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    m = flat.reshape(-1, dim).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # components near the ends of the range neither vanish nor overflow
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        sizes = np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            for i in range(0, at.size, BLOCK):
                some = pa.array(at[i : i + BLOCK])
                flat = vectors.take(some).flatten().to_numpy(zero_copy_only=False)
                yield dim, ids.take(some), _unit(flat, dim)


def _row(dim: int, ids: pa.Array, data: bytes, names: tuple[str, ...]) -> pa.RecordBatch:
    many = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), many, pa.array([data], pa.binary())], list(names))


def packed(rows: DataFrame, id: str, vector: str = "vector", prefix: str = "") -> DataFrame:
    """dim, ids and a matrix of unit vectors (doubles) for each block; names begin with ``prefix``."""
    ship(rows.sparkSession)
    names = (f"{prefix}dim", f"{prefix}ids", f"{prefix}matrix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, m in _by_dim(batches):
            yield _row(dim, ids, m.tobytes(), names)

    kind = rows.schema[id].dataType.simpleString()
    return usable(rows, vector).select(id, vector).mapInArrow(run, f"{names[0]} int, {names[1]} array<{kind}>, {names[2]} binary")


def best_of(scores: np.ndarray, docs: list, k: int) -> list[int]:
    """Places of the ``k`` highest scores; of equals those of the least documents."""
    if scores.size > k:
        edge = np.partition(scores, scores.size - k)[scores.size - k]
        sure, equal = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        return sure.tolist() + sorted(equal.tolist(), key=docs.__getitem__)[: k - sure.size]
    return list(range(scores.size))


def _pair_blocks(questions: DataFrame, blocks: DataFrame, block_bytes: int) -> DataFrame:
    """Each block of questions beside each block of vectors of its length."""
    size = questions.agg(F.sum(F.octet_length("q_matrix"))).first()[0] or 0
    return blocks.join(F.broadcast(questions) if size <= block_bytes else questions.hint("shuffle_hash"), F.col("dim") == F.col("q_dim"))


def _scored(pairs: DataFrame, k: int, digits: int | None, kinds: tuple[str, str], decode=None) -> DataFrame:
    """qid, doc, score: the ``k`` best of each question in each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim, data, q_data = batch.column(0)[i].as_py(), batch.column(2)[i].as_buffer(), batch.column(4)[i].as_buffer()
                ids, q_ids = batch.column(1)[i].values, batch.column(3)[i].values
                m = np.frombuffer(data).reshape(-1, dim) if decode is None else decode(data, dim)
                q, docs = np.frombuffer(q_data).reshape(-1, dim), ids.to_pylist()
                for j in range(0, len(q), ASKED):
                    scores = q[j : j + ASKED] @ m.T
                    if digits is not None:
                        np.round(scores, digits, out=scores)
                    at = [best_of(s, docs, k) for s in scores]
                    rows, columns = np.repeat(np.arange(len(at)), [len(a) for a in at]), np.array([x for a in at for x in a], np.int64)
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(rows + j)), ids.take(pa.array(columns)), pa.array(scores[rows, columns])], ["qid", "doc", "score"])

    return pairs.select("dim", "ids", "matrix", "q_ids", "q_matrix").mapInArrow(run, f"qid {kinds[0]}, doc {kinds[1]}, score double")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(questions: DataFrame, vectors: DataFrame, k: int, digits: int | None = None, block_bytes: int = QUESTION_BYTES) -> DataFrame:
    """qid, doc, score and rank of the ``k`` nearest by cosine, exactly; questions: qid, vector; vectors: doc, vector."""
    kinds = (questions.schema["qid"].dataType.simpleString(), vectors.schema["doc"].dataType.simpleString())
    pairs = _pair_blocks(packed(questions, "qid", prefix="q_"), packed(vectors, "doc"), block_bytes)
    return _ranked(_scored(pairs, k, digits, kinds), k)


@dataclass(frozen=True)
class Codes:
    """A coded index: blocks (dim, ids, matrix: codes), and the words of each length of vector."""

    blocks: DataFrame
    words: dict[int, np.ndarray]


def train_words(m: np.ndarray, groups: int = GROUPS, words: int = CODEWORDS, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """(groups, words, components of a group): the words of product codes, by k-means in each group; short groups end in zeros."""
    wide = -(-m.shape[1] // groups)
    m = np.pad(m, ((0, 0), (0, wide * groups - m.shape[1]))).reshape(len(m), groups, wide)
    rng = np.random.default_rng(seed)
    out = np.empty((groups, words, wide))
    for g in range(groups):
        x = m[:, g]
        c = x[rng.choice(len(x), words, replace=len(x) < words)] + 0.0
        for _ in range(rounds):
            at = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
            n = np.bincount(at, minlength=words)
            sums = np.stack([np.bincount(at, x[:, j], words) for j in range(wide)], axis=1)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        out[g] = c
    return out


def encode(m: np.ndarray, words: np.ndarray) -> np.ndarray:
    groups, _, wide = words.shape
    m = np.pad(m, ((0, 0), (0, wide * groups - m.shape[1]))).reshape(len(m), groups, wide)
    return np.stack([(m[:, g] @ words[g].T - (words[g] ** 2).sum(1) / 2).argmax(1) for g in range(groups)], axis=1).astype(np.uint8)


def decoded(codes: np.ndarray, words: np.ndarray, dim: int) -> np.ndarray:
    return words[np.arange(words.shape[0])[None, :], codes].reshape(len(codes), -1)[:, :dim]


def build_codes(vectors: DataFrame, work: Workspace, sample: int = SAMPLE, groups: int = GROUPS) -> Codes:
    """Code every row of ``vectors`` (doc, vector) and write the blocks.

    Words are trained, for each length of vector, on the ``sample`` rows of least hash; that bound is all the driver gets.
    """
    vectors = usable(vectors)
    picked = vectors.withColumn("_h", F.xxhash64("doc")).orderBy("_h").limit(sample).select("vector").collect()
    by_dim: dict[int, list] = {}
    for r in picked:
        by_dim.setdefault(len(r["vector"]), []).append(r["vector"])
    words = {d: train_words(_unit(np.array(v, np.float64).ravel(), d), min(groups, d)) for d, v in by_dim.items()}
    # lengths that the sample lacks are too rare for codes: their words are drawn, and reranking does the rest
    shared, kind = vectors.sparkSession.sparkContext.broadcast(words), vectors.schema["doc"].dataType.simpleString()
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, m in _by_dim(batches):
            yield _row(dim, ids, encode(m, _words_for(shared.value, dim, groups)).tobytes(), ("dim", "ids", "matrix"))

    coded = vectors.select("doc", "vector").mapInArrow(run, f"dim int, ids array<{kind}>, matrix binary")
    return Codes(work.save(coded, "codes"), words)


def _words_for(words: dict[int, np.ndarray], dim: int, groups: int) -> np.ndarray:
    if dim not in words:
        m = np.random.default_rng(dim).standard_normal((CODEWORDS * 4, dim))
        words[dim] = train_words(m / np.sqrt((m * m).sum(1, keepdims=True)), min(groups, dim), rounds=3)
    return words[dim]


def nearest_coded(questions: DataFrame, vectors: DataFrame, codes: Codes, k: int, rerank: int = RERANK, block_bytes: int = QUESTION_BYTES) -> DataFrame:
    """As ``nearest``, over candidates that the codes rank first: ``rerank * k`` exact comparisons for each question."""
    kinds = (questions.schema["qid"].dataType.simpleString(), vectors.schema["doc"].dataType.simpleString())
    shared = questions.sparkSession.sparkContext.broadcast(codes.words)

    def decode(data, dim: int) -> np.ndarray:
        words = _words_for(shared.value, dim, GROUPS)
        return decoded(np.frombuffer(data, np.uint8).reshape(-1, words.shape[0]), words, dim)

    pairs = _pair_blocks(packed(questions, "qid", prefix="q_"), codes.blocks, block_bytes)
    short = _ranked(_scored(pairs, rerank * k, None, kinds, decode), rerank * k).select("qid", "doc")
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    asked = usable(questions).select("qid", double(F.col("vector")).alias("_q"))
    pairs = short.join(usable(vectors).select("doc", double(F.col("vector")).alias("_v")), "doc").join(asked, "qid").filter(F.size("_q") == F.size("_v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    score = dot("_q", "_v") / (F.sqrt(dot("_q", "_q")) * F.sqrt(dot("_v", "_v")))
    return _ranked(pairs.select("qid", "doc", score.alias("score")), k)
