"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, trained here in numpy.

Inputs. A word's vector is the mean of a hashed word embedding and of hashed embeddings of its character runs of
3 to 5 bytes, edges marked, and of its beginnings of 4 to 7 bytes. Two gated recurrent layers read a window of words, one each way; attention weighs the
states; a logistic unit gives the window's score. A document's score is that of its highest window, over all
overlapping windows of the whole text.

Training. Labels belong to documents, so a document is a bag of windows: at first all its windows carry its label,
then, in rounds, only the highest one. Every window of a training text is used. Of each class at most
``TRAIN_DOCS`` labelled documents are taken, by hash, as far as their texts have ``TRAIN_BYTES`` together; rows whose
crc32 of the doc_id is 0 modulo 5 are held out. There are so many passes that there are ``TRAIN_STEPS`` steps
at least. No column but the text is an input of a score.

Edge cases: null and empty texts score as a window without words; null labels, and those of documents that are not
there or have no text, are not learnt from; documents that share a doc_id are taken all or none; without
labelled rows, or with one class only, every score is that class's (0 without any); repeated rows score alike; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.decontaminate import words_of
from docloom.llm.store import ship

WINDOW, STRIDE = 64, 48
#: Bounds of the labelled sample: documents of each class, and bytes of their texts; and the least number of steps.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_STEPS = {0: 4000, 1: 2000}, 32 << 20, 400
GRAMS = (3, 4, 5)
#: Lengths of a word's beginnings, its edge mark included: stems, which endings leave as they are.
STEMS = (5, 6, 7, 8)
GRAM_ROWS, WORD_ROWS = 1 << 15, 1 << 14
DIM, HIDDEN = 16, 8
SLICE = 4 << 20
#: Windows of a training step, about; and passes over the highest windows before they are picked anew.
STEP_WINDOWS, ROUND_PASSES = 1024, 4
#: Least certainty (z) at which an embedding starts from document counts, what a unit of it is, and the least documents of a part.
PRIME_LEAST, PRIME_SCALE, PRIME_DOCS = 3.5, 1.0, 5
#: What a toxic window counts beside a clean one.
TOXIC_WEIGHT = 3.0
#: Texts of a training step.
STEP_TEXTS = 16
_MULT = np.uint64(0x9E3779B97F4A7C15)


def gram_ids(words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of the embedding table for each distinct word's parts, with how many each word has.

    The words' own rows come first, then runs of each length in turn, then beginnings; rows stand in order of word.
    """
    size = np.array([len(w) + 2 for w in words], np.int64)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8).astype(np.uint64)
    whole = np.fromiter((zlib.crc32(w) & (WORD_ROWS - 1) for w in words), np.int64, len(words)) + GRAM_ROWS
    parts = [(whole, np.ones(len(words), np.int64))]
    for n in GRAMS:
        count = np.maximum(size - n + 1, 0)
        owner = np.repeat(np.arange(len(words)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + begin[owner]
        h = np.full(at.size, n, np.uint64)
        for j in range(n):
            h = (h ^ data[at + j]) * _MULT
            h ^= h >> np.uint64(29)
        parts.append(((h >> np.uint64(20)).astype(np.int64) & (GRAM_ROWS - 1), count))
    for n in STEMS:
        has = (size >= n).astype(np.int64)
        at = begin[size >= n]
        h = np.full(at.size, n + 256, np.uint64)
        for j in range(n):
            h = (h ^ data[at + j]) * _MULT
            h ^= h >> np.uint64(29)
        parts.append(((h >> np.uint64(20)).astype(np.int64) & (GRAM_ROWS - 1), has))
    return parts


def _sum_by(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if group.size else np.empty(0, np.int64)
    out = np.zeros((n, values.shape[1]), np.float32)
    if first.size:
        out[group[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def windows_of(n: int) -> np.ndarray:
    """Starts of the overlapping windows of n words; the last one reaches the end."""
    return np.arange(max(1, -(-(n - (WINDOW - STRIDE)) // STRIDE))) * STRIDE


class Bag:
    """Texts as numbered words and their windows."""

    def __init__(self, texts: list[list[bytes]]):
        number: defaultdict = defaultdict()
        number.default_factory = lambda: len(number) + 1
        codes = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]
        self.words = list(number)
        self.codes = np.concatenate([*codes, np.zeros(WINDOW, np.int64)])
        size = np.array([c.size for c in codes], np.int64)
        begin = np.cumsum(size) - size
        starts = [windows_of(int(n)) for n in size]
        self.owner = np.repeat(np.arange(len(texts)), [s.size for s in starts])
        self.start = (np.concatenate(starts) if starts else np.empty(0, np.int64)) + begin[self.owner]
        self.length = np.minimum(WINDOW, begin[self.owner] + size[self.owner] - self.start)

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (0: none) and mask of some windows."""
        step = np.arange(WINDOW)
        mask = step < self.length[which, None]
        return np.where(mask, self.codes[np.minimum(self.start[which, None] + step, self.codes.size - 1)], 0), mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters and passes. Directions are stacked: index 0 reads forwards, 1 backwards."""

    def __init__(self, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "table": draw(GRAM_ROWS + WORD_ROWS, DIM, scale=0.3),
            "wx": draw(2, DIM, 3 * HIDDEN, scale=DIM**-0.5),
            "wh": draw(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5),
            "bx": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "v": draw(2 * HIDDEN, scale=0.3),
            "w": draw(2 * HIDDEN, scale=0.3),
            "b": np.full(1, -1.0, np.float32),
        }
        self.known = np.ones(GRAM_ROWS + WORD_ROWS, bool)
        self.seen = {k: np.full(v.shape if k != "table" else (v.shape[0], 1), 1e-10, np.float32) for k, v in self.p.items()}

    def prime(self, texts: list[list[bytes]], labels: np.ndarray, least: float = PRIME_LEAST, scale: float = PRIME_SCALE, documents: int = PRIME_DOCS) -> None:
        """Start the first coordinate of each embedding at how surely its part marks a class by document counts.

        The measure is the two-sample z of its shares of toxic and clean documents; what stays under ``least`` starts at 0.
        So a part of few documents that all are toxic is told from the words that one document happens to have. Parts of
        under ``documents`` training texts stay at nothing, so that no text is learnt by its own words.
        """
        n = np.array([np.count_nonzero(labels == 0), np.count_nonzero(labels == 1)], np.float64)
        seen = np.zeros((2, GRAM_ROWS + WORD_ROWS))
        for t, y in zip(texts, labels, strict=True):
            seen[int(y), np.unique(np.concatenate([r for r, _ in gram_ids(sorted(set(t)))]))] += 1
        share = seen.sum(axis=0) / n.sum()
        z = (seen[1] / n[1] - seen[0] / n[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n).sum())
        self.p["table"][:, 0] = np.where(np.abs(z) >= least, np.clip(z, -8, 8) * scale, 0)
        self.known = seen.sum(axis=0) >= documents
        self.p["table"][~self.known] = 0

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of distinct words (row 0: no word), and what their gradient needs."""
        parts = gram_ids(words)
        x = np.zeros((len(words) + 1, DIM), np.float32)
        for rows, count in parts:
            some = np.flatnonzero(count)
            if some.size:
                x[1 + some] += np.add.reduceat(self.p["table"][rows], (np.cumsum(count) - count)[some], axis=0)
        scale = (1 / np.sqrt(np.maximum(sum(c for _, c in parts), 1))).astype(np.float32)
        x[1:] *= scale[:, None]
        return x, np.concatenate([r for r, _ in parts]), np.concatenate([np.repeat(np.arange(len(words)), c) for _, c in parts]), scale

    def forward(self, gates: np.ndarray, codes: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list | None]:
        """Logits of windows; gates: (2, words, 3 * HIDDEN) input parts of the gates."""
        n, wh, h2 = codes.shape[0], self.p["wh"], 2 * HIDDEN
        both = np.stack((codes.T, codes.T[::-1]))
        live = np.stack((mask.T, mask.T[::-1])).astype(np.float32)[..., None]
        h = np.zeros((2, n, HIDDEN), np.float32)
        states, trace = np.empty((WINDOW, 2, n, HIDDEN), np.float32), []
        for t in range(WINDOW):
            gx = np.stack((gates[0][both[0, t]], gates[1][both[1, t]]))
            gh = h @ wh
            zr = _sigmoid(gx[..., :h2] + gh[..., :h2])
            z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
            c = np.tanh(gx[..., h2:] + r * gh[..., h2:])
            new = h + live[:, t] * (1 - z) * (c - h)
            if keep:
                trace.append((h, z, r, c, gh[..., h2:]))
            h = new
            states[t] = h
        # the backward states stand in reading order again
        s = np.concatenate((states[:, 0], states[::-1, 1]), axis=-1)
        e = np.where(mask.T, s @ self.p["v"], -1e9)
        a = np.exp(e - e.max(axis=0)) * mask.T
        a = a / np.maximum(a.sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", a, s)
        return pooled @ self.p["w"] + self.p["b"][0], ([both, live, trace, s, a, pooled] if keep else None)

    def backward(self, saved: list, d: np.ndarray, n_words: int) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters, and of the gates' input parts (2, words, 3 * HIDDEN)."""
        both, live, trace, s, a, pooled = saved
        g = {"w": pooled.T @ d, "b": np.array([d.sum()], np.float32)}
        dp = d[:, None] * self.p["w"]
        da = np.einsum("nh,tnh->tn", dp, s)
        de = a * (da - (a * da).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", de, s)
        ds = a[..., None] * dp + de[..., None] * self.p["v"]
        ds = np.stack((ds[..., :HIDDEN], ds[::-1, :, HIDDEN:]), axis=1)
        wh = self.p["wh"]
        g["wh"] = np.zeros_like(wh)
        dgx = np.empty((WINDOW, 2, d.size, 3 * HIDDEN), np.float32)
        dh = np.zeros((2, d.size, HIDDEN), np.float32)
        for t in range(WINDOW - 1, -1, -1):
            h, z, r, c, ghc = trace[t]
            dh = dh + ds[t]
            m = live[:, t]
            dz = -m * dh * (c - h) * z * (1 - z)
            dc = m * dh * (1 - z) * (1 - c * c)
            dr = dc * ghc * r * (1 - r)
            dgx[t] = np.concatenate((dz, dr, dc), axis=-1)
            dgh = np.concatenate((dz, dr, dc * r), axis=-1)
            g["wh"] += h.transpose(0, 2, 1) @ dgh
            dh = dh * (1 - m * (1 - z)) + dgh @ wh.transpose(0, 2, 1)
        dgates = np.stack([_sum_by(dgx[:, k].reshape(-1, 3 * HIDDEN), both[k].reshape(-1), n_words + 1) for k in (0, 1)])
        return g, dgates

    def gates(self, x: np.ndarray) -> np.ndarray:
        return np.stack([x @ self.p["wx"][k] for k in (0, 1)]) + self.p["bx"]

    def step(self, bag: Bag, label: np.ndarray, rate: float) -> float:
        """One step of adaptive gradients on a bag of documents; their mean loss."""
        x, rows, owner, scale = self.inputs(bag.words)
        gates = self.gates(x)
        which = np.arange(bag.owner.size)
        codes, mask = bag.rows(which)
        logit, saved = self.forward(gates, codes, mask, keep=True)
        y = label[bag.owner]
        q = _sigmoid(logit)
        d = ((q - y) * np.where(y == 1, TOXIC_WEIGHT, 1.0) / y.size).astype(np.float32)
        loss = float(-(y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7)).mean())
        g, dgates = self.backward(saved, d, len(bag.words))
        g["wx"] = np.stack([x.T @ dgates[j] for j in (0, 1)])
        g["bx"] = dgates.sum(axis=1, keepdims=True)
        dx = sum(dgates[j] @ self.p["wx"][j].T for j in (0, 1))[1:] * scale[:, None]
        for name, grad in g.items():
            self.seen[name] += grad * grad
            self.p[name] -= rate * grad / np.sqrt(self.seen[name])
        used, at = np.unique(rows, return_inverse=True)
        grad = _sum_by(dx[owner], at.ravel(), used.size) * self.known[used, None]
        self.seen["table"][used] += (grad * grad).mean(axis=1, keepdims=True)
        self.p["table"][used] -= rate * grad / np.sqrt(self.seen["table"][used])
        return loss

    def highest(self, texts: list[list[bytes]], chunk: int = 512) -> list[list[bytes]]:
        """The words of each text's highest window."""
        bag = Bag(texts)
        gates = self.gates(self.inputs(bag.words)[0]) if bag.words else np.zeros((2, 1, 3 * HIDDEN), np.float32) + self.p["bx"]
        parts = [np.arange(i, min(i + chunk, bag.owner.size)) for i in range(0, bag.owner.size, chunk)]
        logit = np.concatenate([self.forward(gates, *bag.rows(which))[0] for which in parts])
        order = np.lexsort((-logit, bag.owner))
        first = order[np.concatenate(([True], bag.owner[order][1:] != bag.owner[order][:-1]))]
        at = np.array([windows_of(len(t)).size for t in texts])
        nth = first - (np.cumsum(at) - at)
        return [t[k * STRIDE : k * STRIDE + WINDOW] for t, k in zip(texts, nth.tolist(), strict=True)]

    def scores(self, texts: list[list[bytes]], chunk: int = 512) -> np.ndarray:
        """The highest window score of each text."""
        bag = Bag(texts)
        gates = self.gates(self.inputs(bag.words)[0]) if bag.words else np.zeros((2, 1, 3 * HIDDEN), np.float32) + self.p["bx"]
        out = np.full(len(texts), -np.inf, np.float32)
        for i in range(0, bag.owner.size, chunk):
            which = np.arange(i, min(i + chunk, bag.owner.size))
            logit, _ = self.forward(gates, *bag.rows(which))
            np.maximum.at(out, bag.owner[which], logit)
        return _sigmoid(out.astype(np.float64))


def _steps(net: Network, texts: list[list[bytes]], labels: np.ndarray, rng: np.random.Generator, batch: int, rate: float) -> None:
    """One pass over all windows of all texts, in steps of ``batch`` texts, or fewer if they have very many windows."""
    size = np.array([windows_of(len(t)).size for t in texts])
    order, cuts = rng.permutation(len(texts)), [0]
    for j in range(1, order.size):
        if j - cuts[-1] == batch or size[order[cuts[-1] : j + 1]].sum() > STEP_WINDOWS:
            cuts.append(j)
    for j, k in zip(cuts, [*cuts[1:], order.size], strict=True):
        some = order[j:k]
        net.step(Bag([texts[x] for x in some]), labels[some], rate)


def train(rows: list[tuple[bytes, int]], passes: tuple[int, int] = (1, 2), batch: int = STEP_TEXTS, seed: int = 7, rate: float = 0.05) -> Network | float:
    """A network from (text, label) rows; where a class is missing, the constant score instead.

    ``passes``: over all windows; and rounds, each of which picks every text's highest window anew and learns from these
    alone in a few passes. ``batch``: texts of a step, whatever the number of rows.
    """
    labels = np.array([y for _, y in rows], np.float32)
    if not rows or labels.min() == labels.max():
        return float(labels[0]) if rows else 0.0
    rng = np.random.Generator(np.random.PCG64(seed))
    texts = [words_of(text) for text, _ in rows]
    net = Network(seed)
    net.prime(texts, labels)
    for _ in range(passes[0]):
        _steps(net, texts, labels, rng, batch, rate)
    each = max(ROUND_PASSES, -(-TRAIN_STEPS // (max(1, passes[1]) * -(-len(texts) // batch))))
    for _ in range(passes[1]):
        highest = [net.highest(texts[i : i + batch]) for i in range(0, len(texts), batch)]
        windows = [w for part in highest for w in part]
        for _ in range(each):
            _steps(net, windows, labels, rng, batch, rate)
    return net


def held_out(key: str = "doc_id"):
    """Is the row's label kept for the test? A null key's is not learnt from, but is not held out either."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: dict[int, int] = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> list[tuple[bytes, int]]:
    """At most ``bound`` labelled texts of each class (0, 1) that are not held out, in a fixed order, of ``most_bytes`` in all.

    The sample is chosen from ids, labels and sizes; only its texts come to the driver.
    """
    named = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & ~held_out("_id"))
    named = named.groupBy("_id").agg(F.max("_y").alias("_y"))
    texts = docs.select(F.col("doc_id").alias("_id"), F.octet_length("text").alias("_size")).filter("_id is not null and _size is not null")
    sizes = texts.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_size"))
    rows = named.join(sizes, "_id").withColumn("_h", F.xxhash64("_id"))
    picked = None
    for y in (0, 1):
        part = rows.filter(F.col("_y") == y).orderBy("_h", "_id").limit(bound[y])
        picked = part if picked is None else picked.unionByName(part)
    # no more rows than the sum of the bounds; an id is taken with all its rows, or not at all where they are too many
    chosen, left, room = [], dict(bound), most_bytes
    for r in sorted(picked.collect(), key=lambda r: (r["_h"], r["_id"])):
        if r["_n"] <= left[r["_y"]] and r["_size"] <= room:
            chosen.append((r["_id"], r["_y"]))
            left[r["_y"]] -= r["_n"]
            room -= r["_size"]
    wanted = docs.sparkSession.createDataFrame(chosen, f"_id {docs.schema['doc_id'].dataType.simpleString()}, _y int")
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter("text is not null").join(F.broadcast(wanted), F.col("doc_id") == F.col("_id"))
    got = found.select("doc_id", "text", "_y").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    return [(bytes(r.text), r["_y"]) for r in got]


def score(docs: DataFrame, model: Network | float, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus score and predicted, for each row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model.p if isinstance(model, Network) else model)
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(text).cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        if isinstance(net, dict):
            made = Network.__new__(Network)
            made.p = net
            net = made
        for batch in batches:
            texts, n, i = batch.column(1), batch.num_rows, 0
            out = np.empty(n)
            while i < n:
                held, size, j = [], 0, i
                while j < n and (not held or size < SLICE):
                    t = texts[j].as_py()
                    held.append(words_of(t))
                    size += len(t or b"")
                    j += 1
                out[i:j] = net if isinstance(net, float) else net.scores(held)
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["_row", "score", "predicted"])

    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, score double, predicted int"
    return rows.mapInArrow(run, schema).select("_row.*", "score", "predicted")
