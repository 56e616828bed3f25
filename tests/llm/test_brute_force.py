"""The URL templates and the pipeline against plain loops over the same rows."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
from test_contracts import SF, secret_spans, words
from test_near_copies import groups
from tokenizers import Tokenizer

import corpus_pipeline
from hoptrace.llm import quality_fm, queries, secret_scan, url_templates as U


def wildcard(s):
    body, ending = re.sub(r"\.[A-Za-z]{1,5}$", "", s), re.search(r"(\.[A-Za-z]{1,5})?$", s)[0]
    digits = sum(c.isdigit() for c in body)
    mixed = re.fullmatch(r"[A-Za-z0-9_-]{12,}", body) and digits >= 2 and re.search("[A-Za-z]", body)
    if re.fullmatch(r"[0-9._:-]+", body) or re.fullmatch(r"[0-9a-fA-F-]{16,}", body) or mixed or re.search(r"[0-9]{4,}", body):
        return "*" + ending
    return s


def templates(rows, max_children=U.MAX_CHILDREN, z=U.Z, strength=U.STRENGTH, least=U.LEAST_PURITY):
    """{(host, path): (template, purity, verdict)} of (host, path, label or None) rows."""
    now = {}
    for h, p, _ in rows:
        now[h, p] = tuple(wildcard(x) for x in p.split("/") if x)
    depth = max(map(len, now.values()), default=0)
    labels = [x for _, _, x in rows if x is not None]
    base = sum(labels) / len(labels) if labels else 1.0
    for level in range(depth):
        n = Counter((h, now[h, p][:level], now[h, p][level]) for h, p, _ in rows if len(now[h, p]) > level)
        children, total = Counter(), Counter()
        for (h, parent, _), k in n.items():
            children[h, parent] += 1
            total[h, parent] += k
        for (h, p), s in now.items():
            if len(s) > level and children[h, s[:level]] > max_children and n[h, s[:level], s[level]] * max_children < total[h, s[:level]]:
                now[h, p] = (*s[:level], "*", *s[level + 1 :])
    for level in reversed(range(depth)):
        siblings = defaultdict(lambda: defaultdict(lambda: [0, 0]))
        for h, p, x in rows:
            s = now[h, p]
            if len(s) > level:
                one = siblings[h, s[:level], s[level + 1 :]][s[level]]
                one[0] += x is not None
                one[1] += x or 0
        merging = set()
        for node, own in siblings.items():
            all_k, all_g, alike = sum(k for k, _ in own.values()), sum(g for _, g in own.values()), []
            for child, (k, g) in own.items():
                rest, share = all_k - k, all_g / all_k if all_k else 0
                apart = k and rest and 0 < share < 1 and abs(g / k - (all_g - g) / rest) / (share * (1 - share) * (1 / k + 1 / rest)) ** 0.5 > z
                alike += [] if apart else [child]
            merging |= {(node, child) for child in alike if len(alike) > 1}
        for (h, p), s in now.items():
            if len(s) > level and ((h, s[:level], s[level + 1 :]), s[level]) in merging:
                now[h, p] = (*s[:level], "*", *s[level + 1 :])
    k, g = Counter(), Counter()
    for h, p, x in rows:
        k[h, now[h, p]] += x is not None
        g[h, now[h, p]] += x or 0
    out = {}
    for h, p, _ in rows:
        s = now[h, p]
        purity = (g[h, s] + strength * base) / (k[h, s] + strength)
        out[h, p] = ("/" + "/".join(s), round(purity, 9), "block" if purity < least else "allow")
    return out


def test_templates(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        host = rng.choice(["a.com", "a.com", "b.com"])
        kind = rng.choice(["spam", "news", "tag", "u", ""])
        path = {"spam": f"/spam/{i}.html", "news": f"/news/{rng.randrange(3)}/x{rng.randrange(90)}", "tag": f"/tag/{rng.choice('abcdefgh')}{rng.choice('abcdefghijklm')}/y", "u": f"/u/{i:020x}/p", "": rng.choice(["/", "", "//", "/index.html"])}[kind]
        rows.append((i, host, path, None if rng.random() < 0.4 else int(rng.random() > (0.8 if kind == "spam" else 0.1))))
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, h, p, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows if x is not None], "page_id long, label int")
    want = templates([r[1:] for r in rows], max_children=20)
    got = U.judge_urls(pages, labels, [], max_children=20).collect()
    assert {(r["host"], r["path"]): (r["template"], round(r["purity"], 9), r["verdict"]) for r in got} == want
    assert {v[2] for v in want.values()} == {"allow", "block"}


def test_deep_paths(spark):
    """Branches some hundred segments down are narrowed, merged and judged as those at the top are."""
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        p = ["top", rng.choice("ab"), *["m"] * 95]
        p[60] = rng.choice(["good", "bad"])
        p[90] = f"x{rng.randrange(60)}y"
        p += [f"z{rng.randrange(4)}"] * rng.choice([1, 2])
        rows.append((i, "a.com" if i % 3 else "b.com", "/" + "/".join(p), None if rng.random() < 0.3 else int(rng.random() > (0.9 if "bad" in p else 0.1))))
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, h, p, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows if x is not None], "page_id long, label int")
    want = templates([r[1:] for r in rows], max_children=20)
    got = U.judge_urls(pages, labels, [], max_children=20).collect()
    assert {(r["host"], r["path"]): (r["template"], round(r["purity"], 9), r["verdict"]) for r in got} == want
    assert {v[2] for v in want.values()} == {"allow", "block"} and any("/m/*/m" in v[0] for v in want.values())


def test_op3_whole_table(spark):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.QUERIES["op3_url_templates"](spark, SF).collect()
    number = {p["page_id"]: int(re.search(r"([0-9]+)[^0-9]*$", re.sub(r"[?#].*$", "", p["url"]))[1]) for p in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    want = templates([(r["host"], r["path"], quality.get(number[r["page_id"]])) for r in got])
    for r in got:
        template, purity, verdict = want[r["host"], r["path"]]
        assert (r["template"], round(r["purity"], 9)) == (template, purity) and (r["rule"] is not None or r["verdict"] == verdict)


def test_pipeline(spark):
    """Every stage on what the stage before kept, each against a loop."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        seen[name] = (before, docs.collect())
        assert name == "packed" or docs.columns == columns
    before, after = seen["quality"]
    table = spark.createDataFrame(before)
    score = {r["doc_id"]: r["score"] for r in quality_fm.classify(table, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(k for k, v in score.items() if v >= 0.3)
    before, after = seen["near_dedup"]
    component = groups([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(k for k, v in component.items() if k == v)
    before, after = seen["secrets"]
    texts = {r["doc_id"]: r["text"] for r in after}
    added = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == 3] for r in secret_scan.judged(secret_scan.scan(spark.createDataFrame(before))).collect()}
    for r in before:
        cover = {i for a, _, b in secret_spans(r["text"]) for i in range(a, b)} | {i for s in added[r["doc_id"]] for i in range(s["start"], s["end"])}
        assert texts[r["doc_id"]] == "".join("*" if i in cover else c for i, c in enumerate(r["text"]))
    before, after = seen["mixture"]
    size, total, taken = {r["doc_id"]: len(words(r["text"])) for r in before}, Counter(), Counter()
    for r in before:
        total[r["source"]] += size[r["doc_id"]]
    for r in after:
        taken[r["source"]] += size[r["doc_id"]]
    target = {r["source"]: r["target"] for r in corpus_pipeline.mixing.source_targets(spark.createDataFrame([(r["source"], size[r["doc_id"]]) for r in before], "source string, size long")).collect()}
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(size[r["doc_id"]] for r in before if r["source"] == s) and taken[s] <= 2 * total[s]
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2
    before, after = seen["packed"]
    tok, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(int)
    for r in before:
        want[r["doc_id"]] += len(tok.encode(r["text"], add_special_tokens=False).ids) + 1
    got, bins, ids = defaultdict(int), defaultdict(list), {r["doc_id"]: [*tok.encode(r["text"], add_special_tokens=False).ids, 2] for r in before}
    for r in after:
        got[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
    assert got == want and all(sum(n for _, n in b) <= 1024 for b in bins.values())
