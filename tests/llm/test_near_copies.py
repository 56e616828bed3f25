"""The pipeline's near-copy stage against plain Jaccard similarities of all pairs."""

import random

import numpy as np
from test_edges import empty, odd  # noqa: F401

import corpus_pipeline
from hoptrace.llm import near_copies as near
from hoptrace.llm.near_copies import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    """doc_id: least doc_id reachable over pairs of similarity 0.8."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            s, t = sets[a], sets[b]
            if s == t or (min(len(s), len(t)) * 5 >= 4 * max(len(s), len(t)) and 5 * len(s & t) >= 4 * len(s | t)):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def fixture():
    """Texts with copies of one to eight changed words, chains of copies of copies, and a passage most of them share."""
    rng = random.Random(5)
    passage = " ".join(f"common{i}" for i in range(40))
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 30, 120, 400]))]
        texts.append(" ".join(words))
        for _ in range(6):
            if rng.random() < 0.4:
                words = texts[-1].split()
            changed = list(words)
            for _ in range(rng.randrange(9)):
                changed[rng.randrange(len(changed))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(changed))
        if rng.random() < 0.7:
            texts[-1] += " " + passage
    texts += [None, "", " \n", passage, passage.upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies(spark):
    rows = fixture()
    want = groups(rows)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["kept"]} == set(want.values())
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_group(spark):
    """Repeated rows, doc_ids with several texts, null ids and columns with names of the stage's own."""
    text, copy = " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i}" for i in range(101))
    rows = [(1, text, "a", 1), (1, text, "a", 1), (1, text, "b", 2), (2, copy, "c", 3), (5, text, "d", 4), (5, "quite another text of more than five words", "e", 5), (None, copy, "f", 6), (None, None, "g", 7), (None, "", "h", 8), (7, " ", "i", 9), (None, "alone among the null ids in every word", "j", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _HASH string, Node int").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    assert kept == sorted([(1, text), (5, "quite another text of more than five words"), (7, " "), (None, "alone among the null ids in every word")], key=repr)


def test_bitmap_bound():
    """Differing parity bits never exceed the sets' symmetric difference."""
    rng = np.random.default_rng(4)
    for n in (1, 10, 300, 5000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: 4 * n // 5], b[: n // 5]]))
        assert np.bitwise_count(near.parity_bitmap(a) ^ near.parity_bitmap(b)).sum() <= len(np.setxor1d(a, b))


def test_stage_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(k for k, v in want.items() if k == v)


def test_stages_on_odd_rows(odd, empty, spark):
    """Every stage on nulls, empty and very long texts, repeated rows and clashing names, and on an empty table."""
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, odd, sf), stage(spark, empty, sf)
        assert none.count() == 0 and none.columns == got.columns
        if name != "packed":
            assert got.columns == odd.columns
            known = {(r["doc_id"], r["lang"], r["source"], r["size"]) for r in odd.collect()}
            assert {(r["doc_id"], r["lang"], r["source"], r["size"]) for r in got.collect()} <= known
        if name in ("secrets", "packed"):
            assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in odd.collect()}


def test_shared_passage(spark, monkeypatch):
    """A passage in texts of all sizes, in lists of several parts and none of it ordered last: few pairs, none lost."""
    rng = random.Random(8)
    passage = " ".join(f"common{i}" for i in range(30))
    rows = []
    for i in range(400):
        words = [f"w{rng.randrange(10**6)}" for _ in range(int(20 * 1.012**i))]
        rows.append((2 * i, " ".join(words) + " " + passage))
        if i % 10 == 0:
            words[rng.randrange(len(words))] = "other"
            rows.append((2 * i + 1, " ".join(words) + " " + passage))
    decided, verified = [], near._verified
    monkeypatch.setattr(near, "_verified", lambda pairs, *rest: decided.append(pairs.count()) or verified(pairs, *rest))
    monkeypatch.setattr(near, "MEMBERS", 8)
    monkeypatch.setattr(near, "MOST_OFTEN", 0)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == groups(rows)
    assert sum(decided) < len(rows) * 10


def test_chance_shingles(spark, monkeypatch):
    """Texts that share a passage of a few shingles with others by chance, and near copies: the former make no pairs."""
    rng = random.Random(9)
    phrases = [" ".join(f"p{i}x{k}" for k in range(6)) for i in range(300)]
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**7)}" for _ in range(150)]
        for at in sorted(rng.sample(range(150), 3)):
            words[at] = rng.choice(phrases)
        rows.append((2 * i, " ".join(words)))
        if i % 10 == 0:
            words[75] = "other"
            rows.append((2 * i + 1, " ".join(words)))
    made, likely = [], near._likely
    monkeypatch.setattr(near, "MOST_OFTEN", 0)
    monkeypatch.setattr(near, "_likely", lambda pairs, facts: made.append(pairs.distinct().count()) or likely(pairs, facts))
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = groups(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) == 300
    assert sum(made) < 100


def test_prefixes_meet_often():
    """Similar sets share as many of their prefixes as asks the filter, also at the least similarity and size."""
    rng = np.random.default_rng(6)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for n in (*range(1, 60), 100, 999):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for b in (rng.permutation(a)[: (4 * n + 4) // 5], np.concatenate([rng.permutation(a)[: (8 * n + 8) // 9], rng.integers(0, 1 << 63, n // 9).astype(np.uint64)])):
            both = len(np.intersect1d(a, b))
            if 5 * both < 4 * (n + len(b) - both):
                continue
            met = len(np.intersect1d(near.prefix(a, none), near.prefix(np.unique(b), none)))
            assert all(met > (4 * k + 4) // 5 // near.SPARE for k in (n, len(b)))
