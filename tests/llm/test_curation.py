"""The deduplicating, filtering and packing operators against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate, license, minhash, packing, rules, sharding, suffix, suffix_family


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def multiset(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---- suffix arrays


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_search(seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, [2, 3, 50][seed % 3], 300)
    order = suffix.suffix_array(codes)
    assert order.tolist() == sorted(range(300), key=lambda i: codes[i:].tolist())
    text = np.concatenate((codes, np.full(suffix.PAD, -2)))
    query = np.concatenate((codes[40:60], rng.integers(0, 3, 10), np.full(suffix.PAD, -3)))
    start = np.arange(30)
    best, where = suffix.longest(text, order, query, start, 30 - start)

    def match(i):
        return max(next((k for k in range(30 - i) if p + k >= 300 or codes[p + k] != query[i + k]), 30 - i) for p in range(300))

    assert best.tolist() == [match(i) for i in range(30)]
    assert all(codes[w : w + n].tolist() == query[i : i + n].tolist() for i, (n, w) in enumerate(zip(best, where)) if n)


def test_suffix_array_empty_and_single():
    assert suffix.suffix_array(np.empty(0, np.int64)).size == 0
    assert suffix.suffix_array(np.array([5])).tolist() == [0]


# ---- decontamination


ITEMS = [(1, None), (2, ""), (3, "..."), (4, "two words"), (5, "one"), (None, "a b c d")]


def hits(text, items):
    doc, hit, found = words(text), set(), set()
    for item_id, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for p in range(len(doc) - n + 1):
                if doc[p : p + n] == w[i : i + n]:
                    hit.update(range(p, p + n))
                    found.add("" if item_id is None else str(item_id))
    return len(doc), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("block_bytes", [1 << 24, 900])
def test_decontamination(spark, docs, rows, block_bytes):
    items = ITEMS + [(6, " ".join(words(rows[14][1])[:30])), (7, " ".join(words(rows[14][1])[5:40])), (8, rows[-6][1]), (8, rows[20][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find(docs, bench, block_bytes=block_bytes)
    want = Counter((r[0], *hits(r[1], items)) for r in rows)
    assert Counter((r.doc_id, int(r.n_words), r.n_hit, tuple(r["items"])) for r in got.collect()) == want
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert multiset(clean, "doc_id") == Counter((r[0],) for r in rows if not hits(r[1], items)[1])


def test_longest_matches(spark, docs, rows):
    text = words(rows[15][1])
    bench = spark.createDataFrame([(1, "zzz " + " ".join(text[3:25]) + " qqq")], "item_id bigint, text string")
    best = {r.item_start: r for r in decontaminate.longest_matches(decontaminate.find(docs, bench)).collect()}
    assert best[1].length == 22 and best[1].doc_start == 3
    assert best[2].length == 21


def test_decontamination_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find(no_docs, none).count() == 0
    assert decontaminate.find(docs, none).filter("contaminated").count() == 0


# ---- near duplicates


def shingle_set(text):
    w = split((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows, percent=85):
    sets = {r[0]: shingle_set(r[1]) for r in rows}
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates(docs, rows):
    want = near(rows)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    left = minhash.deduplicate(docs)
    assert left.columns == docs.columns
    assert multiset(left, "doc_id") == Counter((i,) for i, (_, c) in want.items() if i == c)


def test_near_duplicates_in_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 3)
    want = near(rows)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_edges(spark, no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    some = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(some).collect()}
    assert got == {(None, 2, 7, False), (7, 2, 7, True), (None, 0, None, True)}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40, 1000):
        base = rng.integers(0, 1 << 62, n).astype(np.uint64)
        for share in (0.5, 0.9):
            other = np.unique(np.concatenate((base[: int(n * share)], rng.integers(0, 1 << 62, n - int(n * share)).astype(np.uint64))))
            base = np.unique(base)
            true = np.intersect1d(base, other).size / np.union1d(base, other).size
            estimate = (minhash.sketch(base) == minhash.sketch(other)).mean()
            assert abs(estimate - true) < 6 * (0.25 / minhash.BINS) ** 0.5


def test_sketch_fills_every_coordinate():
    for n in (1, 3, 200):
        marks = minhash.sketch(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(7919))
        assert np.count_nonzero(marks) > minhash.BINS - 2
        if n == 1:
            assert np.unique(marks).size > minhash.BINS // 2


# ---- suffix-array deduplication


def cut(texts, n=suffix_family.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.blake2b(d[i : i + n], digest_size=12).digest() for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[hashlib.blake2b(d[i : i + n], digest_size=12).digest()] > 1:
                gone[i : i + n] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out.append((len(d), int(gone.sum()), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_suffix_family(docs, rows, batches):
    want = Counter(zip([r[0] for r in rows], cut([r[1] for r in rows])))
    got = Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in suffix_family.cut(docs, batches=batches).collect())
    assert got == want


def test_suffix_family_hot_keys(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_family, "HOT", 1)
    monkeypatch.setattr(suffix_family, "HOT_SHARE", 10**9)
    want = Counter(zip([r[0] for r in rows], cut([r[1] for r in rows])))
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))) for r in suffix_family.cut(docs).collect()) == want


def test_pieces_hold_every_window_once(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_family, "PIECE", 1000)
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (399, 400, 401, 999, 1000, 1001, 1399, 1400, 5000)] + [b"a" * 3000, None, b""]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array([7] * len(texts), pa.int64()), pa.array(texts, pa.binary())], ["doc", "hash", "text"])
    seen = Counter()
    for out in suffix_family._index_batches(iter([batch])):
        for d, a, b in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), out.column(3).to_pylist()):
            seen.update((d, i) for i in range(a, b + 1))
    assert seen == Counter((d, i) for d, t in enumerate(texts) if t for i in range(len(t) - 399))


@pytest.mark.parametrize("hot", [1, 2048])
def test_suffix_family_overlaps(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_family, "HOT", hot)
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("abcdefgh \n"), n))
    p = text(1200)
    texts = [text(300) + p[:700] + text(200), text(50) + p[300:] + text(20), text(10) + p[:500] + text(10) + p[600:1100], p[100:499], text(900) * 3, "ab" * 900]
    some = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_family.cut(some).collect()}
    assert [got[i] for i in range(len(texts))] == cut(texts)


def test_remove_repeats(docs, no_docs, rows):
    left = suffix_family.remove_repeats(docs)
    assert left.columns == docs.columns
    want = Counter()
    for r, (n, gone, _, kept) in zip(rows, cut([r[1] for r in rows])):
        if n == 0 or gone < n:
            want[r[0], kept.decode("utf-8", "ignore")] += 1
    assert Counter((r.doc_id, r.text or "") for r in left.collect()) == want
    assert suffix_family.cut(no_docs).count() == 0


# ---- quality rules


def measures(text):
    w = split(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines)


def test_quality_ledger(docs, rows, no_docs):
    book = rules.apply_policy(rules.ledger(docs))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in book.collect())
    assert got == Counter((r[0], *measures(r[1])) for r in rows)
    base = {(r.doc_id, r.f) for r in book.select("doc_id", rules.failed(F.col("bits"), rules.BASE).alias("f")).collect()}
    assert base == {(r[0], (m := measures(r[1]))[0] < 50 or 100 * m[4] > 50 * m[0]) for r in rows}
    left = rules.filter_documents(docs)
    assert left.columns == docs.columns
    assert multiset(left, "doc_id") == Counter((r.doc_id,) for r in book.filter("kept").collect())
    assert rules.ledger(no_docs).count() == 0


def test_ablations(docs):
    book = rules.ledger(docs)
    rows = [r.bits for r in book.collect()]
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in rules.ablations(book).collect()}
    for i, rule in enumerate(rules.RULES):
        b = 1 << i
        assert got[rule.name] == (sum(bool(x & b) for x in rows), sum(x == b for x in rows), sum(not x & ~b for x in rows))


# ---- licenses


def places(text):
    w = words(text)
    found = []
    for phrase, label in license.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(found)


def test_license_base(spark, docs, rows, no_docs):
    extra = ["CC BY cc-by, CC.BY-NC", "ALL rights\nreserved all rights reserved", "general public license" * 2, "nothing here", "the GNU General Public License v2 or MIT License", None]
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id bigint, text string"))
    texts = [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(extra)]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license.scan(some).collect())
    want = Counter()
    for i, t in texts:
        n, found = places(t)
        want[i, n, len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))] += 1
    assert got == want
    assert license.scan(no_docs).count() == 0


@pytest.mark.parametrize("i", range(len(license.RULES)))
def test_every_match_holds_keyword_and_literal(i):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    rule = license.RULES[i]
    held = license.literals(rule)

    @settings(max_examples=15, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(rule.regex, fullmatch=True))
    def check(text):
        assert rule.keyword in text and any(x in text for x in held)

    check()


def test_license_suppression(spark):
    texts = {
        1: "This work is licensed under the Apache License, Version 2.0.",
        2: "Licensed under CC BY-NC 4.0.",
        3: "SPDX-License-Identifier: MIT",
        4: "Permission is hereby granted, free of charge, to any person obtaining a copy",
        5: "we saw the license of the driver",
        6: "Released into the public domain. Copyright (c) 2020 Me.",
        7: "A Creative Commons Attribution-ShareAlike work",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license.scan(df).collect()}
    assert got[1] == ("apache-2.0", 0.9)
    assert got[2][0] == "cc-by,cc-by-nc"  # the base label stays beside the one that contains it
    assert got[3] == ("mit", 0.99)
    assert got[4] == ("mit", 0.9)
    assert got[5] == ("", 0.0)
    assert got[6][0] == "copyright,public-domain"
    assert got[7][0] == "cc-by-sa"
    assert len(license.RULES) >= 200


# ---- sharding


def test_external_shuffle(spark, docs, rows, no_docs, tmp_path):
    out = sharding.external_shuffle(docs, n_shards=5, bucket_bytes=6000)
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5)
        assert 0 <= r.shard < 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    grown = {r.doc_id: r.shard for r in sharding.external_shuffle(docs, n_shards=6, bucket_bytes=6000).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    again = sharding.external_shuffle(docs.repartition(7), n_shards=5, bucket_bytes=6000).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in again if r.doc_id != 12 and r.doc_id != 0) == Counter((r.doc_id, r.shard, r.slot) for r in got if r.doc_id != 12 and r.doc_id != 0)
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    assert sharding.external_shuffle(no_docs).count() == 0


def test_shuffle_orders_differ_from_input(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    order = [r.doc_id for r in sharding.external_shuffle(df, n_shards=1).orderBy("slot").collect()]
    assert order != sorted(order) and sorted(order) == list(range(500))


# ---- packing


def test_packing_matches_plain_best_fit():
    import random

    for seed in range(20):
        rng = random.Random(seed)
        pieces = [(rng.randint(1, 60), rng.choice(["a"] * 5 + list("bcdef") + [None]), rng.choice([None, 1, 1, *range(20)])) for _ in range(rng.choice([3, 60, 300]))]
        pieces.sort(key=lambda p: -p[0])
        room, held, want = [], [], []
        for n, s, c in pieces:
            fit = [i for i in range(len(room)) if room[i] >= n and not ({("s", s), ("c", c)} & held[i])]
            if not fit:
                room.append(100)
                held.append(set())
                fit = [len(room) - 1]
            best = min(fit, key=lambda i: (room[i], i))
            room[best] -= n
            held[best] |= {(k, v) for k, v in (("s", s), ("c", c)) if v is not None}
            want.append(best)
        assert packing.pack_pieces(pieces, 100) == want


def test_pack(docs, rows, no_docs):
    got = packing.pack(docs, capacity=128, group=40).collect()
    bins, lengths = defaultdict(list), Counter()
    for r in got:
        bins[r.bin].append(r)
        lengths[r.doc_id] += r.length - 1
    assert all(sum(r.length for r in b) <= 128 for b in bins.values())
    for b in bins.values():
        for field in ("source", "cluster"):
            seen = [getattr(r, field) for r in b if getattr(r, field) is not None]
            assert len(seen) == len(set(seen))
        assert sorted(r.slot for r in b) == list(range(len(b)))
    want = Counter()
    for r in rows:
        want[r[0]] += len(split(r[1]))
    assert lengths == want
    assert packing.pack(no_docs).count() == 0


def kept_by_rules(text):
    n, chars, symbols, dup, repeat, lines = measures(text)
    letters = len(re.findall(r"[A-Za-z\x80-\U0010ffff]", text or ""))
    return not (n < 50 or 100 * repeat > 50 * n or chars < 2 * n or chars > 20 * n or 10 * symbols > 5 * n or 10 * dup > 5 * lines or 10 * letters < 5 * chars)


def test_pipeline_equals_brute_force(spark, docs, rows, tmp_path):
    """Each stage on what its predecessor kept, against the plain versions above: near duplicates at 80 percent, passages of 50 words."""
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, " ".join(words(rows[20][1])[3:18])), (2, "no such words here")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out, want = docs, [(r[0], r[1]) for r in rows]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        if name == "quality":
            want = [(i, t) for i, t in want if kept_by_rules(t)]
        elif name == "near_duplicates":
            found = near(want, 80)
            want = [(i, t) for i, t in dict(want).items() if found[i][1] == i]
        elif name == "repeats":
            before = want
            want = [(i, kept) for (i, _), (gone, n, kept) in zip(want, cut_words([t for _, t in want])) if gone == 0 or gone < n]
            assert want != before
        elif name == "decontaminate":
            want = [(i, t) for i, t in want if not hits(t, items)[1]]
        if name == "packing":
            lengths = Counter()
            for r in out.collect():
                lengths[r.doc_id] += r.length - 1
            assert lengths == Counter({i: len(split(t)) for i, t in want}) and set(lengths) == {i for i, _ in want}
        else:
            assert out.columns == docs.columns
            assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want) and want
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == out.count()


def test_crc_is_of_utf8(spark, sf):
    from docloom.llm.queries import QUERIES

    got = {r.doc_id: (r.size, r.text_crc32) for r in QUERIES["op6_shards"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert got[r.doc_id] == (len(r.text.encode()) + 8, zlib.crc32(r.text.encode()))


# ---- repeated passages, in words


def cut_words(texts, n=50):
    """n_repeat_words of each text, and what stays of it."""
    seen, out = Counter(), []
    for t in texts:
        w = split(t)
        seen.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for t in texts:
        places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        w, gone = split(t), set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept, upto = "", 0
        for i in sorted(gone):
            if i - 1 not in gone:
                kept += (t or "")[upto : places[i][0]]
            upto = places[i][1]
        out.append((len(gone), len(w), kept + (t or "")[upto:]))
    return out


def passages(seed=11):
    rng = random.Random(seed)
    p = [" ".join("w%d" % rng.randrange(300) for _ in range(n)) for n in (49, 50, 51, 60, 130)]
    some = lambda n: " ".join("x%d" % rng.randrange(10**6) for _ in range(n))
    texts = [f"{some(20)} {q}\n{some(30)}" for q in p for _ in range(3)] + [p[4], " " + p[4][200:] + "\t\n " + some(5), some(400), "a " * 200, "b" * 5000, None, ""]
    return texts + [some(70_000)] + [some(10) + " " + p[3].replace(" ", "\n") + " é " + some(60)]


def test_passages_of_words(spark):
    texts = passages()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = cut_words(texts)
    both = {r.doc_id: r for r in suffix_family.cut(df, passages=suffix_family.WORDS).collect()}
    assert [both[i].n_repeat_words for i in range(len(texts))] == [w[0] for w in want]
    assert [(both[i].n_bytes, both[i].n_removed, both[i].n_spans, bytes(both[i].kept)) for i in range(len(texts))] == cut(texts)
    left = {r.doc_id: r.text or "" for r in suffix_family.remove_repeats(df, unit=suffix_family.WORDS).collect()}
    assert left == {i: kept for i, (gone, n, kept) in enumerate(want) if gone == 0 or gone < n}


def test_passages_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(suffix_family, "HOT", 1)
    texts = passages(12)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_repeat_words for r in suffix_family.cut(df, passages=suffix_family.WORDS).collect()}
    assert [got[i] for i in range(len(texts))] == [w[0] for w in cut_words(texts)]


def test_word_codes_by_pieces(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abé") for _ in range(rng.choice([1, 3, 40, 3000]))) for _ in range(60)).encode() + b"  \n"
    want = suffix_family.word_codes(text)
    for piece in (1, 7, 100):
        monkeypatch.setattr(suffix_family, "PIECE", piece)
        assert np.array_equal(suffix_family.word_codes(text), want)
    assert len(set(want.tolist())) == len(set(text.split())) and want.size == len(text.split())
    assert len(set(suffix_family.word_codes(b"ab ba aab aba a aa aaa").tolist())) == 7


def test_arrays_are_sorted_and_scanned():
    """Shards, their arrays and the merge-scan against a plain count."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 6, 500), rng.integers(0, 4, 500), np.ones(500, int), rng.integers(0, 2, 500), rng.integers(0, 50, 500), rng.integers(0, 9, 500)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 70], pa.int64()) for c in rows], suffix_family.ENTRY) for i in range(0, 500, 70)]
    made = list(suffix_family._array_batches(iter(batches)))
    assert len(made) == 1 and made[0].num_rows == 24
    order = np.lexsort((rows[1], rows[0]))
    dealt = [pa.RecordBatch.from_arrays([pa.array(c[order][i : i + 70], pa.int64()) for c in rows], suffix_family.ENTRY) for i in range(0, 500, 70)]
    scanned = [r for b in suffix_family._scan_batches(iter(dealt)) for r in b.to_pylist()]
    want = Counter(zip(rows[0].tolist(), rows[1].tolist()))
    assert [((r["key"], r["context"]), r["n"]) for r in scanned] == sorted(want.items()) and all(r["near"] for r in scanned)
    alone = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 3, 5, 6], pa.int64())] + [pa.array([1] * 4 + [7, 7], pa.int64())] * 5, suffix_family.ENTRY)
    assert [(r["key"], r["n"], r["near"]) for b in suffix_family._scan_batches(iter([alone])) for r in b.to_pylist()] == [(1, 1, True), (2, 1, False), (3, 2, False), (5, 7, False), (6, 7, True)]
