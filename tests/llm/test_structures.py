"""Centroid clustering, token counts and the prefix trie."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from docloom.llm import centroids, prefix_trie, token_counts

# ---- centroids


def lloyd(rows, k, rounds, dims, scale=256, seed=2):
    """The same in plain whole numbers, all distances each round."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [list(x) for _, x in start]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for j in range(len(cents)):
            own = [x for (_, x), a in zip(kept, at) if a == j]
            if own:
                cents[j] = [sum(c) // len(own) for c in zip(*own)]
    return sorted((i is None, i or 0, near(x)[1], near(x)[0]) for i, x in kept), cents


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("x", T.StringType()), T.StructField("need", T.StringType())])


def vectors(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (6, dims))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 6] + rng.normal(0, 0.4, dims)]) for i in range(n)]
    rows += [(n, None), (n + 1, [0.5] * (dims - 1)), (n + 2, [None] + [0.0] * (dims - 1)), (n + 3, [float("nan")] + [0.0] * (dims - 1)), (n + 4, [float("inf")] * dims)]
    return rows + [rows[0], rows[0], (None, rows[1][1]), (n + 5, [-0.001] * dims), (n + 6, [0.0] * dims), (n + 7, [0.0] * dims)]


@pytest.mark.parametrize("k,dims", [(12, 8), (1, 3), (400, 4)])
def test_clusters_equal_plain_rounds(spark, k, dims):
    rows = vectors(200, dims)
    df = spark.createDataFrame([(i, v, 0, "clash", "clash") for i, v in rows], VECTORS).repartition(3)
    needs = []
    got, cents = centroids.cluster(df, k=k, dims=dims, needs=needs)
    want, final = lloyd(rows, k, centroids.ROUNDS, dims)
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in got.collect()) == want and cents == final
    if k == 12:  # the bounds do settle vectors without all distances
        assert sum(n[centroids.SCANNED] for n in needs[1:]) < sum(sum(n.values()) for n in needs[1:]) / 2
        assert all(sum(n.values()) == len(want) for n in needs)
    own = centroids.with_inertia(got, cents).collect()
    assert {r.inertia for r in own} == {sum(w[3] for w in want)}
    for r in own:
        assert r.cluster_inertia == sum(w[3] for w in want if w[2] == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, final[r.cluster])).encode()).hexdigest()


def test_clusters_of_nothing_and_of_huge_components(spark):
    none, cents = centroids.cluster(spark.createDataFrame([], VECTORS), dims=4)
    assert none.count() == 0 and cents == [] and centroids.with_inertia(none, cents).count() == 0
    huge = [(1, [3e38] * 4, 0, "", ""), (2, [-3e38] * 4, 0, "", ""), (3, [1.0] * 4, 0, "", "")]
    got, _ = centroids.cluster(spark.createDataFrame(huge, VECTORS), k=1, dims=4)
    most = centroids.MOST
    assert {r.vec_id: r.distance for r in got.collect()}[1] == 4 * (most - sum((most, -most, 256)) // 3) ** 2


def test_bounds_hold_at_each_round():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (500, 6))
    c = x[:20].copy()
    s = centroids.scan(x, c, 5)
    for _ in range(6):
        new = c + rng.integers(-25, 26, c.shape)
        s, _ = centroids.reassign(x, new, centroids._above(((new - c) ** 2).sum(1)), s, 5)
        c = new
        d = centroids.squared(x, c)
        assert (s.cluster == d.argmin(1)).all()
        true = np.sqrt(d)
        assert (s.upper >= true[np.arange(500), s.cluster]).all()
        assert (s.lower <= np.take_along_axis(true, s.near, 1)).all()
        others = np.ones_like(d, bool)
        np.put_along_axis(others, s.near, False, 1)
        others[np.arange(500), s.cluster] = False
        assert (s.rest[:, None] <= np.where(others, true, np.inf)).all()


# ---- token counts


FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("name", FILES)
def test_counts_equal_the_library(rows, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    counter, library = token_counts.Counter(token_counts.read_vocabulary(path)), Tokenizer.from_file(path)
    rng = random.Random(2)
    signs = "ab AB'sSteéÉ́ΣσςİıẞßǅⅫ²½0१٣字かハ゛  \u0085\x1c​\n\r\t<|>endoftxsar💩👩‍👧̣̀ﬁ\x00_llreveꟋ"
    texts = [r[1] for r in rows if r[1]]
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 30)))
        texts.append(t + rng.choice(["", "", "<|endoftext|>", "<|startoftext|>x", "<|ENDOFTEXT|>"]) + t[:3])
    texts += ["abcdefgh" * 20_000, "<|endoftext|>" * 3, "'s" * 50]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_merges_against_the_plain_rule():
    """Against scanning all pairs each time, with random rules."""
    rng = random.Random(6)
    for _ in range(200):
        rules, known = [], list("abc")
        for _ in range(rng.randrange(1, 12)):
            pair = (rng.choice(known), rng.choice(known))
            if pair not in rules:
                rules.append(pair)
                known.append("".join(pair))
        number, pairs, joined = token_counts.number_merges(rules, "")
        rank = {p: i for i, p in enumerate(rules)}
        word = [rng.choice("abc") for _ in range(rng.randrange(1, 40))]
        plain = list(word)
        while len(plain) > 1:
            best = min((rank.get(p, 1 << 30), i) for i, p in enumerate(zip(plain, plain[1:])))
            if best[0] == 1 << 30:
                break
            i = best[1]
            plain[i : i + 2] = ["".join(plain[i : i + 2])]
        assert token_counts.count_merged([number[c] for c in word], pairs, joined) == len(plain)


def test_token_counts_of_rows(spark, docs, no_docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path).collect())
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 2048) for r in rows)
    assert any(r[3] for r in got)
    assert token_counts.count_tokens(no_docs, path).count() == 0
    assert token_counts.count_tokens(spark.createDataFrame([(None, "a b")], "doc_id bigint, text string"), path).collect()[0].n_tokens == 2


def test_other_vocabularies_are_refused(tmp_path):
    import json

    import public_tokenizers

    made = json.loads(open(public_tokenizers.path(FILES[0])).read())
    for part, value in (("model", made["model"] | {"type": "Unigram"}), ("normalizer", {"type": "StripAccents"}), ("pre_tokenizer", {"type": "Whitespace"})):
        (tmp_path / "v.json").write_text(json.dumps(made | {part: value}))
        with pytest.raises(ValueError):
            token_counts.read_vocabulary(str(tmp_path / "v.json"))
    with pytest.raises(ValueError):
        token_counts.read_vocabulary(public_tokenizers.path(FILES[0]), most_bytes=1000)


# ---- prefix trie


TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("depth", T.StringType()), T.StructField("node", T.StringType())])


def plain_trie(turns, again):
    """All prefixes as tuples."""
    own = {}
    for c, t, r, x, *_ in turns:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    if again:
        built = {}
        for c, v in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = own.get(c - c % 5, [])[:h] + v[h:]
        own = built
    nodes = {}
    for c, v in own.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    sha = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    out = set()
    for p, members in nodes.items():
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = sum(not any(len(k) == len(q) + 1 and k[: len(q)] == q for k in nodes) for q in below)
        saved = sum((len(nodes[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in below)
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved, sha([c for c in members if len(own[c]) == len(p)])))
    return out


def some_turns(seed=0):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        for i in range(rng.randrange(1, 9)):
            rows.append((c, i, "user" if i % 2 == 0 else "assistant", rng.choice(["hi", "é", "", None, "well " * 3]), "clash", "clash"))
    rows += [(c, i, "user", f"copy {i}", "", "") for c in (100, 105, 106, 110) for i in range(12)]  # copies, long
    rows += [(200, i, "user", f"copy {i}", "", "") for i in range(11)] + [(201, 0, "user", "x" * 9000, "", "")]
    rows += [(c, None, None, None, "", "") for c in (300, 301)] + [(None, 1, "user", "gone", "", ""), (302, 1, "b", "2", "", ""), (302, 1, "a", "9", "", ""), (302, 1, "a", "1", "", ""), (302, None, "z", "z", "", "")]
    return rows + [rows[3], rows[3], rows[-1]]


@pytest.mark.parametrize("again", [False, True])
def test_trie_equals_plain_prefixes(spark, monkeypatch, again):
    if not again:  # groups by a broadcast, ids in many chunks, sums in many blocks
        monkeypatch.setattr(prefix_trie, "LEAST_HOT", 2)
        monkeypatch.setattr(prefix_trie, "HOT", 8)
        monkeypatch.setattr(prefix_trie, "CHUNK", 5)
        monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = some_turns()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    made = prefix_trie.rebuilt_trie(df) if again else prefix_trie.prefix_trie(df)
    assert [tuple(r) for r in made.filter("depth = 0").collect()][0][:3] == (0, 0, None)
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows, again)


def test_trie_of_nothing(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], TURNS)).count() == 0
    lone = prefix_trie.prefix_trie(spark.createDataFrame([(7, None, None, None, "", "")], TURNS)).collect()
    assert sorted((r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in lone) == [(0, 1, 1, 1, 0), (1, 1, 0, 1, 0)]


def test_ids_of_a_class_come_in_chunks():
    import pyarrow as pa

    names, ids = [b"a"] * 2000 + [b"b"] * 3, [*range(2000), 5, 6, 7]
    batches = [pa.RecordBatch.from_arrays([pa.array(names[i : i + 700], pa.binary()), pa.array(ids[i : i + 700], pa.int64())], ["name", "conv_id"]) for i in range(0, 2003, 700)]
    chunks = list(prefix_trie._chunks(iter(batches)))
    assert sum(c.num_rows for c in chunks) > 2
    got = {r["name"]: r for b in prefix_trie._digests(iter(chunks)) for r in b.to_pylist()}
    for x in (b"a", b"b"):
        own = [i for n, i in zip(names, ids) if n == x]
        assert (got[x]["rep"], got[x]["n"], got[x]["ends_sha256"]) == (own[0], len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())


@pytest.mark.parametrize("name", ["op11_centroids", "op13_trie", "quality_ablations"])
def test_new_queries_equal_sql(spark, sf, name):
    import duckdb

    from docloom.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("embeddings", "conversations", "documents"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = con.sql(ORACLES[name])
    assert set(got.columns) == set(want.columns)
    cell = lambda x: None if x is None else str(x)
    assert sorted(tuple(map(cell, r)) for r in got.select(*want.columns).collect()) and sorted(tuple(cell(v) or "" for v in r) for r in got.select(*want.columns).collect()) == sorted(tuple(cell(v) or "" for v in r) for r in want.fetchall())


def test_cells_grow_with_the_bytes(spark, docs, monkeypatch):
    """More buckets than cells at first: none is larger than one cell's rows, and all rows keep their gapless places."""
    from docloom.llm import sharding

    monkeypatch.setattr(sharding, "CELLS", 2)
    out = sharding.external_shuffle(docs, n_shards=2, bucket_bytes=2000).select("doc_id", "shard", "slot", "bucket").collect()
    assert len(out) == docs.count() and len({r.bucket for r in out}) > 2 * 2
    for s in (0, 1):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
