"""Centroid clustering with adaptive bounds, in whole numbers.

Each vector keeps an upper bound of the distance to its centroid, lower bounds of the distances to its several next
nearest centroids, and one lower bound for all the rest. After the centroids have moved, the bounds are widened by how
far they moved. A vector whose upper bound is under all its lower bounds stays without any distance computed; else its
own distance is computed anew; else, if the bound of the rest is beyond it, only the listed centroids are compared and
ordered; only where the order cannot be certified so are all centroids scanned. How many are listed adapts: a quarter of the
centroids at first, one fewer after each round that scanned under a twentieth of the vectors, an eighth at least.

Distances are exact integers. Bounds are floating-point numbers, widened by more than their rounding, and only strict
inequalities certify, so ties (the smaller number wins) are always settled on exact distances.

Vectors stay where they are: each round reads them with their bounds and writes them anew, in tasks over batches; only
one row of sums for each centroid and task is shuffled. The centroids (``k`` times ``dims`` integers, both
parameters) are all that reaches the driver.

Edge cases: vectors that are null, of another length, or hold a null, NaN or infinite component are left out; components
beyond ``MOST`` once scaled are held at it, so that squared distances fit in 64 bits; with fewer than ``k`` vectors each is
a centroid; equal start vectors are separate centroids, of which the smaller number gets all and the others stay as they
are; a null id hashes as the empty string; repeated rows and ids count as rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.store import Workspace, ship

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
MOST = 1 << 27
#: What was needed for a vector in a round.
CERTAIN, TIGHTENED, LISTED, SCANNED = range(4)
STEP = 4096
_ULPS = 2.0**-48


def whole(column: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double."""
    bound = float(MOST)
    scaled = lambda x: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), F.lit(float(scale)) * x.cast("double")))).cast("int")
    return F.transform(column, scaled)


def usable(column: Column, dims: int = DIMS) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return column.isNotNull() & (F.size(column) == dims) & F.forall(column, fine)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``x`` to all rows of ``c``."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # every sum is exact in floating point
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((x.shape[0], c.shape[0]), np.int64)
    for k in range(c.shape[0]):
        d = x - c[k]
        out[:, k] = (d * d).sum(1)
    return out


def _above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + _ULPS)


def _below(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - _ULPS)


@dataclass
class State:
    """Bounds of some vectors: ``near`` lists other centroids, ``lower`` their bounds, ``rest`` that of all not listed."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray


def scan(x: np.ndarray, c: np.ndarray, listed: int) -> State:
    """Everything anew from exact distances to all centroids."""
    d = squared(x, c)
    order = np.argsort(d, axis=1, kind="stable")  # of equals the smaller number first
    by = np.take_along_axis(d, order, 1)
    listed = min(listed, c.shape[0] - 1)
    rest = _below(by[:, listed + 1]) if listed + 1 < c.shape[0] else np.full(x.shape[0], np.inf)
    return State(order[:, 0], _above(by[:, 0]), order[:, 1 : listed + 1], _below(by[:, 1 : listed + 1]), rest)


def reassign(x: np.ndarray, c: np.ndarray, moved: np.ndarray, s: State, listed: int) -> tuple[State, np.ndarray]:
    """The state after the centroids have moved to ``c``, and what was needed for each vector."""
    if s.near.shape[1] > listed:  # the farthest are no longer listed: the rest's bound covers them
        order = np.argsort(s.lower, axis=1, kind="stable")
        near, lower = np.take_along_axis(s.near, order, 1), np.take_along_axis(s.lower, order, 1)
        s = State(s.cluster, s.upper, near[:, :listed], lower[:, :listed], np.minimum(s.rest, lower[:, listed]))
    upper = (s.upper + moved[s.cluster]) * (1 + _ULPS)
    lower = s.lower - moved[s.near]
    lower -= (np.abs(s.lower) + moved[s.near]) * _ULPS
    rest = s.rest - moved.max(initial=0.0)
    rest = np.where(np.isfinite(rest), rest - (np.abs(s.rest) + moved.max(initial=0.0)) * _ULPS, np.inf)
    s = State(s.cluster.copy(), upper, s.near.copy(), lower, rest)
    need = np.zeros(x.shape[0], np.int8)

    floor = np.minimum(s.lower.min(axis=1, initial=np.inf), s.rest)
    at = np.flatnonzero(s.upper >= floor)
    need[at] = TIGHTENED
    diff = x[at] - c[s.cluster[at]]
    own = (diff * diff).sum(1)
    s.upper[at] = _above(own)
    still = s.upper[at] >= floor[at]
    at, own = at[still], own[still]

    some = s.upper[at] < s.rest[at]
    for i in range(0, int(some.sum()), STEP):
        which, mine = at[some][i : i + STEP], own[some][i : i + STEP]
        diff = x[which][:, None, :] - c[s.near[which]]
        d = np.concatenate((mine[:, None], (diff * diff).sum(2)), axis=1)
        who = np.concatenate((s.cluster[which][:, None], s.near[which]), axis=1)
        order = np.lexsort((who, d), axis=1)
        d, who = np.take_along_axis(d, order, 1), np.take_along_axis(who, order, 1)
        s.cluster[which], s.upper[which] = who[:, 0], _above(d[:, 0])
        s.near[which], s.lower[which], need[which] = who[:, 1:], _below(d[:, 1:]), LISTED
    at = at[~some]
    for i in range(0, at.size, STEP):
        which = at[i : i + STEP]
        new = scan(x[which], c, s.near.shape[1])
        s.cluster[which], s.upper[which], s.near[which], s.lower[which], s.rest[which] = new.cluster, new.upper, new.near, new.lower, new.rest
        need[which] = SCANNED
    return s, need


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(values.shape[0] + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, flat.size // rows if rows else 0)


BOUNDS = "cluster int, upper double, near array<int>, lower array<double>, rest double, need tinyint, distance bigint"


def _pass(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None, listed: int) -> DataFrame:
    """One round of assignment: ``_id``, ``x`` and the bounds."""
    shared = rows.sparkSession.sparkContext.broadcast((centroids, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, old = shared.value
        moved = None if old is None else _above(((c - old) ** 2).sum(1))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = _matrix(batch.column(1), n).astype(np.int64)
            if moved is None:
                parts = [scan(x[i : i + STEP], c, listed) for i in range(0, n, STEP)]
                s = State(*[np.concatenate([getattr(p, f) for p in parts]) for f in State.__dataclass_fields__])
                need = np.full(n, SCANNED, np.int8)
            else:
                cluster, upper, near, lower, rest = batch.columns[2:7]
                s = State(cluster.to_numpy(), upper.to_numpy(), _matrix(near, n), _matrix(lower, n), rest.to_numpy())
                s, need = reassign(x, c, moved, s, listed)
            diff = x - c[s.cluster]
            out = [batch.column(0), batch.column(1), pa.array(s.cluster, pa.int32()), pa.array(s.upper), _lists(s.near, pa.int32()), _lists(s.lower, pa.float64())]
            out += [pa.array(s.rest), pa.array(need), pa.array((diff * diff).sum(1), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, ["_id", "x", "cluster", "upper", "near", "lower", "rest", "need", "distance"])

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, x array<int>, {BOUNDS}")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id: str = "vec_id", vector: str = "embedding", needs: list | None = None) -> tuple[DataFrame, list[list[int]]]:
    """One row for each usable vector (its id, cluster, distance: squared, whole), and the final centroids.

    The start is the ``k`` vectors with the least sha256 of ``seed:id``. ``needs``, if given, is extended by a dict for
    each round: how many vectors needed what (``CERTAIN`` to ``SCANNED``).
    """
    spark = vectors.sparkSession
    ship(spark)
    work = Workspace(spark, "centroids")
    rows = vectors.select(F.col(id).alias("_id"), F.col(vector).alias("_v")).filter(usable(F.col("_v"), dims)).select("_id", whole(F.col("_v"), scale).alias("x"))
    first = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)).orderBy("_h", "x").limit(k)
    centroids = np.array([r["x"] for r in first.collect()], np.int64).reshape(-1, dims)
    kind = vectors.schema[id].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"{id} {kind}, cluster int, distance bigint"), []
    before, listed, least = None, max(1, k // 4), max(1, k // 8)
    for i in range(rounds + 1):
        rows = work.save(_pass(rows, centroids, before, listed), f"round{i}")
        work.drop(f"round{i - 1}")
        if i == rounds and needs is None:
            break
        sums = [F.sum(F.col("x")[j].cast("long")).alias(f"s{j}") for j in range(dims)]
        counts = [F.count_if(F.col("need") == w).alias(f"need{w}") for w in range(4)]
        found = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *counts, *sums).collect()
        if needs is not None:
            needs.append({w: sum(r[f"need{w}"] for r in found) for w in range(4)})
        before = centroids.copy()
        if i < rounds:
            for r in found:
                centroids[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(dims)]
            # where listed bounds settle all but few vectors, fewer will do
            if i and sum(r[f"need{SCANNED}"] for r in found) * 20 < sum(r["n"] for r in found):
                listed = max(least, listed - 1)
    return rows.select(F.col("_id").alias(id), "cluster", "distance"), centroids.tolist()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia (null beyond 64 bits) and centroid_sha256; the centroids' rows, at most ``k``, are broadcast."""
    spark = assigned.sparkSession
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fit = lambda n: n if n < 1 << 63 else None
    rows = [(c, fit(sums.get(c, 0)), fit(sum(sums.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    own = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(own), "cluster").select(assigned.columns[0], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
