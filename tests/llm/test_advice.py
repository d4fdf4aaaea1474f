"""What the advice of round 1 asked for, against brute force."""

import random
from collections import Counter

import numpy as np
from test_curation import multiset, shingle_set

from docloom.llm import minhash, packing


def components(texts, percent):
    """The least id reachable, for texts by id."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    return {i: root(i) for i in sets}


def test_near_duplicates_at_another_percent(docs, rows):
    texts = {r[0]: r[1] for r in rows}
    want = components(texts, 80)
    assert want != components(texts, 85)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, percent=80).collect()} == want
    assert multiset(minhash.deduplicate(docs, percent=80), "doc_id") == Counter((i,) for i, c in want.items() if i == c)


def test_near_copies_share_no_bin(spark, docs, rows):
    """Copies and near copies of different sources, with and without ids."""
    got = packing.pack_near(docs, capacity=4096).collect()
    texts = {r[0]: r[1] for r in rows}
    want = components(texts, 80)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in packing.pack(docs, capacity=4096).collect())
    for b in set(r.bin for r in got):
        held = [r for r in got if r.bin == b]
        for key in ([r.source for r in held if r.source is not None], [want[r.doc_id] for r in held], [texts[r.doc_id] for r in held]):
            assert len(key) == len(set(key))
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:-1] + ["other"])
    some = spark.createDataFrame([(1, " ".join(words), "a"), (2, near, "b"), (None, near + " x", "c"), (None, near + " y", "d"), (3, "", "e"), (4, "", "f"), (5, None, "g")], "doc_id bigint, text string, source string")
    packed = packing.pack_near(some).collect()
    by_source = {r.source: r.bin for r in packed}
    assert len({by_source[s] for s in "abcd"}) == 4 and by_source["e"] != by_source["f"]
    assert {(r.doc_id, r.source) for r in packed} == {(r.doc_id, r.source) for r in some.collect()}


def test_op9_packing_parts_near_copies(spark, tmp_path):
    from docloom.llm.queries import QUERIES

    words = [f"w{i}" for i in range(60)]
    some = [(1, " ".join(words), "a"), (2, " ".join(words[:-1] + ["other"]), "b")]
    spark.createDataFrame(some, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert len({r.bin for r in QUERIES["op9_packing"](spark, str(tmp_path)).collect()}) == 2


def test_groups_are_counted_in_pieces(spark):
    long = spark.createDataFrame([(1, " ".join(["w"] * 12_700), "a")], "doc_id bigint, text string, source string")
    got = packing.pack(long, capacity=128, group=20).collect()
    assert len(got) == 100 and len({r.bin >> 32 for r in got}) == 5


def test_links_do_not_depend_on_sketches(rows, monkeypatch):
    """Block by block against pairwise comparison, also with sketches that agree nowhere."""
    rng = random.Random(3)
    texts = [t for t in {r[0]: r[1] for r in rows}.values() if t and t.split()]
    monkeypatch.setattr(minhash, "STEP", 5000, raising=False)
    marks = iter(range(1, 1 << 20))
    monkeypatch.setattr(minhash, "sketch", lambda s: np.full(minhash.BINS, next(marks), np.uint32))
    sets = [shingle_set(t) for t in texts]
    alike = lambda a, b, percent: 100 * len(a & b) >= percent * len(a | b)
    for percent in (80, 85):
        for side in (np.zeros(len(texts), int), np.array([rng.randrange(2) for _ in texts])):
            ids = list(range(len(texts)))
            across = bool(side.any())
            pairs = [(a, b) for a in ids for b in ids if a < b and (not across or side[a] != side[b]) and alike(sets[a], sets[b], percent)]
            links = minhash.link_block(ids, side, [t.encode() for t in texts], percent)
            assert all((min(x), max(x)) in pairs for x in links) and pairs
            assert joined(links, ids) == joined(pairs, ids)


def joined(links, ids):
    up = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return up


def test_blocks_are_bounded_in_shingles(spark, monkeypatch):
    """Long texts make small blocks; the links are those of one block."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*words, f"end{i}"])) for i in range(12)] + [(20, None), (21, "alone"), (21, "alone again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {(i, 0) for i in range(12)} | {(20, 20), (21, 21)}


def test_components_with_hubs(spark):
    """Hubs of the least and of the largest id, chains, loops and repeated edges."""
    from docloom.llm import components
    from docloom.llm.store import Workspace

    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + i, 201 + i) for i in range(15)] + [(399, 300 + i) for i in range(40)]
    nodes = sorted({x for e in edges for x in e})
    want = {n: c for n, c in joined(edges, nodes).items() if any(n in e and e[0] != e[1] for e in edges)}
    df = spark.createDataFrame(edges + edges[:9], "a bigint, b bigint")
    assert {r.node: r.component for r in components.connected_components(df, Workspace(spark, "test")).collect()} == want
