"""The filter audit and the Merkle manifest against plain loops, on odd rows and over the sizes where trees change shape."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from hoptrace.llm import filter_audit, manifest_tree
from hoptrace.llm.oracle import ORACLE
from hoptrace.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, key string, at long, node string"
MORE = ("x", 1, "k", 5, "n")
LONG = " ".join(f"Word{i % 977}x{i % 31}" for i in range(40_000))


def docs(spark, rows):
    return spark.createDataFrame([(*r, *MORE) for r in rows], SCHEMA).repartition(3)


ODD = [
    (1, None, "en", None, None), (2, "", "en", "", 0), (3, "same text", None, "a", 9), (4, "same text", "en", "b", 9), (4, "same text", "en", "b", 9), (None, "same text", "en", "a", 9),
    (5, " ".join(f"w{i}" for i in range(60)), "en", "a", 1), (6, " ".join(f"w{i % 9}" for i in range(60)), "fr", "a", 1), (7, "AB cd # " * 30, "fr", None, 1), (8, LONG, "fr", "a", 1), (9, LONG, "fr", "b", 1),
    (10, "ÉK İ ABC", "de", "é", 2**60), (2**62 + 1, " \n\t ", "de", "a", -1), (None, None, None, None, None),
]


def loop_audit(rows, labels):
    fails = []
    for doc_id, text, _, source, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        mask = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, *_ in rows),
        }
        own = [l for l in labels if l[0] == doc_id and doc_id is not None]
        fails.append((source or "", mask, any(l[1] == 1 for l in own), any(l[2] == 1 for l in own)))
    out = Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order, 1):
                gone, left = [x for x in left if x[1][f]], [x for x in left if not x[1][f]]
                every = [x for x in mine if x[1][f]]
                alone = [x for x in every if sum(x[1].values()) == 1]
                steps.append(("".join(order), k, f, len(left), len(gone), len(every) - len(gone), len(alone), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        for s in steps:
            out[(part, s[0], s[1], *s[3:], sum(t[4] for t in steps if t[2] == s[2]))] += 1
    return out


def test_audit_on_odd_rows(spark):
    labels = [(3, 1, 0), (3, 0, 1), (6, 1, None), (8, None, 1), (None, 1, 1), (77, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.mask_weights(filter_audit.failure_rows(docs(spark, ODD)), frame)).collect()
    assert Counter(map(tuple, got)) == loop_audit(ODD, labels)
    assert filter_audit.audit(filter_audit.mask_weights(filter_audit.failure_rows(docs(spark, [])), frame)).count() == 0


def test_swaps_visit_every_order():
    for n in range(1, 6):
        order = list(range(n))
        seen = {tuple(order)}
        for k in filter_audit.adjacent_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert seen == set(permutations(range(n)))


def test_equal_parts_of_a_diagram_are_one_node():
    diagram = filter_audit.Diagram("ABC", {m: (1, 0, 0) for m in range(8)})
    assert [len(level) for level in diagram.levels] == [1, 1, 1]
    diagram = filter_audit.Diagram("ABC", {0: (4, 1, 0), 5: (2, 0, 1)})
    for k in filter_audit.adjacent_swaps(3):
        diagram.swap(k)
        assert diagram.weight[diagram.root] == (6, 1, 1) and all(len(level) <= 2 for level in diagram.levels)


# --- manifest --------------------------------------------------------------------------------------------------------
def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """All levels, and each first node's path to the top."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            first = a - a % 16
            paths[i].append((nodes[first:a], nodes[a + 1 : first + 16]))
        at = [a // 16 for a in at]
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def loop_manifest(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((r[0] is None, r[0] or 0, leaf(*r), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    root, above = climb([trees[s][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for (_, _, own, r), path in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1]):
            path = path + above[k]
            hand = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                hand = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for left, right in path:
                hand = h(*left, hand, *right)
            out[(r[0], own, trees[s][0], root, h(*[x for left, right in path for x in (*left, *right)]), hand, hand == root)] += 1
    return out


@pytest.mark.parametrize("sizes", [(1,), (16,), (17, 1), (300, 256, 257, 2)])
def test_manifest_of_many_sizes(spark, sizes):
    rows = [(i * 7 + 1000 * k, f"Text {i}", "en", f"s{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    got = manifest_tree.manifest(manifest_tree.document_leaves(docs(spark, rows))).collect()
    assert Counter(map(tuple, got)) == loop_manifest(rows)


def test_manifest_of_a_deep_tree_and_many_sources(spark):
    rows = [(i, f"Text {i}", "en", "deep", i) for i in range(4400)] + [(10_000 + i, "T", "en", f"s{i}", i) for i in range(270)]
    got = manifest_tree.manifest(manifest_tree.document_leaves(docs(spark, rows))).collect()
    assert Counter(map(tuple, got)) == loop_manifest(rows)


def test_manifest_of_odd_rows(spark):
    got = manifest_tree.manifest(manifest_tree.document_leaves(docs(spark, ODD))).collect()
    assert Counter(map(tuple, got)) == loop_manifest(ODD)
    assert manifest_tree.manifest(manifest_tree.document_leaves(docs(spark, []))).count() == 0


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_filter_audit"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    columns = sorted(got.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall())
