"""SpotSigs against loops: anchors, signatures, the document that follows, likeness, classes of near duplicates."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import islice

import pytest
from xxhash import xxh3_128_digest

from hoptrace.llm import common, components, spot_signatures as sp
from hoptrace.llm.common import staged

SCHEMA = "doc_id long, text string, lang string, n long, sigs int, copy string, node long, n_chars int"
MORE = (1, 2, "c", 3, 4)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA).repartition(3)


def split(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def loop_anchors(rows):
    docs, counts = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        docs[lang] += 1
        counts[lang].update(set(split(text)))
    return {w for lang, n in docs.items() if n >= 0.01 * len(rows) for w, k in counts[lang].items() if k > 1 and k >= 0.75 * n}


def loop_signatures(text, anchors):
    words, out = split(text), set()
    is_anchor = [w in anchors for w in words]
    for i, w in enumerate(words):
        near = is_anchor[: sp.GAP] if i < sp.GAP else is_anchor[i - sp.GAP : i]
        if w in anchors or not any(near):
            chain = list(islice((words[k] for k in range(i + 1, len(words)) if not is_anchor[k]), 3))
            if len(chain) == 3:
                out.add((w, *chain))
    return out or ({tuple(words)} if words else set())


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def loop(rows):
    """Each row's contract columns and its class, with sets as fingerprints."""
    anchors = loop_anchors(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), xxh3_128_digest((r[1] or "").encode())))
    sets = [loop_signatures(t, anchors) for _, t, _ in order]
    root = list(range(len(order)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    names = defaultdict(list)
    for i, r in enumerate(order):
        if r[0] is not None:
            names[find(i)].append(r[0])
    out = []
    for i, (doc_id, text, _) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        cut = len(text) // 3
        changed = text[: len(text) - cut] + nxt[:cut]
        other = loop_signatures(changed, anchors)
        row = (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), round(alike(sets[i], other), 9), round(alike(sets[i], sets[(i + 1) % len(order)]), 9), min(names[find(i)], default=None))
        out.append((row, frozenset(sets[i]), frozenset(other)))
    return out


def result(spark, docs):
    rows = staged(sp.edited(docs, sp.common_words(docs)), "edited")
    classes = sp.near_duplicates(rows)
    return rows.drop("n", "sigs", *sp.BITMAP).join(classes, "fingerprint").collect()


def check(got, want):
    rows = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9), r["class_id"]) for r in got)
    assert rows == Counter(w[0] for w in want)
    # fingerprints are equal where the sets are
    prints = [{r["fingerprint"] for r in got}, {r["edited_fingerprint"] for r in got}]
    assert [len(p) for p in prints] == [len({w[1] for w in want}), len({w[2] for w in want})]
    assert len(prints[0] | prints[1]) == len({w[1] for w in want} | {w[2] for w in want})


VOCABULARY = ["the", "of", "and"] + [f"w{i}" for i in range(400)]


def prose(rng, n):
    return [rng.choice(VOCABULARY[:3]) if rng.random() < 0.2 else rng.choice(VOCABULARY[3:]) for _ in range(n)]


def test_corpus_with_copies(spark):
    rng = random.Random(7)
    rows = []
    for g in range(60):
        words = prose(rng, rng.randint(1, 200))
        for _ in range(rng.choice([1, 1, 2, 6])):
            near = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                near[rng.randrange(len(near))] = rng.choice(VOCABULARY)
            if rng.random() < 0.3:
                near += prose(rng, rng.randint(0, 20))
            rows.append((rng.randrange(10**9), " ".join(near).title() if g % 5 == 0 else " ".join(near), rng.choice(["en", "en", "fr", None])))
    want = loop(rows)
    assert 1 < len({w[0][5] for w in want}) < len(rows)
    check(result(spark, frame(spark, rows)), want)


def test_list_of_one_group_and_strangers(spark):
    """Many near copies of one text, and texts that share a passage with them alone, meet in the same lists."""
    rng = random.Random(3)
    base, rows = prose(rng, 300), []
    for i in range(150):
        near = list(base)
        for _ in range(3):
            near[rng.randrange(len(near))] = f"x{i}"
        rows.append((i, " ".join(near), "en"))
    rows += [(1000 + i, " ".join(base[:40] + prose(rng, 40)), "en") for i in range(40)] + [(2000 + i, " ".join(prose(rng, 80)), "en") for i in range(80)]
    want = loop(rows)
    check(result(spark, frame(spark, rows)), want)
    assert len({w[0][5] for w in want if w[0][0] < 150}) == 1


def test_group_about_the_least_similarity(spark, monkeypatch):
    """A large group of short near copies, some 0.8 similar, the shortest to none: linked without the pairs of the group."""
    rng = random.Random(12)
    base, rows = [w for i in range(20) for w in ("the", f"a{i}", f"b{i}", f"c{i}")], []
    for i in range(600):
        near = list(base)
        for k in rng.sample(range(20), rng.choice([1, 1, 1, 2])):
            near[4 * k + 1] = f"x{i}y{k}"
        rows.append((i, " ".join(near[: 4 * rng.choice([15, 19, 20, 20, 20])]), "en"))
    want, decided, verified = loop(rows), [], sp._verified
    monkeypatch.setattr(sp, "_verified", lambda pairs, sets: decided.append(pairs.count()) or verified(pairs, sets))
    check(result(spark, frame(spark, rows)), want)
    assert sum(decided) < len(rows) * 25


def test_few_tables_are_written(spark, monkeypatch):
    """Links of a large group are put together once: later rounds join its root alone, and a round without links joins nothing."""
    rng = random.Random(5)
    base, rows = [w for i in range(20) for w in ("the", f"a{i}", f"b{i}", f"c{i}")], []
    for i in range(300):
        near = list(base)
        for k in rng.sample(range(20), rng.choice([1, 1, 1, 2])):
            near[4 * k + 1] = f"x{i}y{k}"
        rows.append((i, " ".join(near[: 4 * rng.choice([15, 19, 20, 20, 20])]), "en"))
    want, names, written = loop(rows), [], common.written
    monkeypatch.setattr(common, "written", lambda df, path, *by: names.append(path.rpartition("/")[2].split("-")[1]) or written(df, path, *by))
    check(result(spark, frame(spark, rows)), want)
    assert names.count("large") <= 6


@pytest.mark.parametrize("n", [0, 1, 30, 300])
def test_components_with_more_links(spark, n):
    rng = random.Random(n)
    first, more = ([(rng.randrange(200), rng.randrange(200)) for _ in range(n // k)] for k in (2, 1))
    more += [(k, k + 1) for k in range(300, 300 + n)]  # a chain
    root = {k: k for k in range(601)}
    for u, v in first + more:
        if root[u] == root[v]:
            continue
        low, high = sorted((root[u], root[v]))
        root = {k: low if r == high else r for k, r in root.items()}
    links = "u long, v long"
    nodes = staged(spark.range(601).selectExpr("id AS node", "id AS root"), "nodes")
    roots = components.merged(nodes, spark.createDataFrame(first, links))
    assert {r["node"]: r["root"] for r in components.merged(roots, spark.createDataFrame(more, links)).collect()} == root


ODD = [
    (1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, "one", "en"), (5, "the one", "en"), (6, "the of and", "en"), (7, "Ünïcödé ΣΑΣ Σ K İ the same words again", "en"),
    (7, "a text with the same id", "en"), (7, "a text with the same id", "en"), (None, "a null id of the text", "fr"), (None, None, None), (8, " ".join(f"name{i}" for i in range(300)), "xx"),
    (2**62 + 1, " ".join(f"the word{i % 977}x{i % 31} of" for i in range(30_000)), "en"), (2**62, " ".join(f"the word{i % 977}x{i % 31} of" for i in range(29_000)), "en"), (-5, "a\x1cb c\x85d the e f g h", "en"),
]


@pytest.mark.parametrize("some", [slice(0, None), slice(0, 1), slice(9, 11), slice(4, 6)])
def test_odd_rows(spark, some):
    check(result(spark, frame(spark, ODD[some])), loop(ODD[some]))


def test_empty(spark):
    assert result(spark, frame(spark, [])) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got, want = sp.op11_spot_signatures(spark, sf).collect(), loop(rows)
    check(got, want)
    assert sum(r["near_edited"] for r in got) > 5 * sum(r["near_next"] for r in got)


def test_length_partitions():
    borders = sp.length_borders(3000)
    part = lambda n: sum(b <= n for b in borders)
    for n in range(1, 1500):
        assert part(n * 5 // 4) - part(n) in (0, 1)
