"""FASTQ in splits: borders anywhere give the same reads, and nothing is shuffled."""

import gzip
import random

import pytest

from hoptrace.sources.fastq import read_fastq, read_records

KEYS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def split(spark):
    before = {k: spark.conf.get(k) for k in KEYS}

    def to(n):
        spark.conf.set(KEYS[0], str(n))
        spark.conf.set(KEYS[1], "0")

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def records(rng, n):
    """Qualities and headers that begin like each other's lines; an empty quality."""
    out = []
    for i in range(n):
        seq = "".join(rng.choices("ACGT", k=rng.randrange(1, 12)))
        qual = rng.choice(["@", "+", "I"]) + "I" * (len(seq) - 1) if i % 5 else ""
        out.append((f"r{i}", f"@r{i} x @y", seq, qual))
    return out


def text(rows, end="\n", last=True):
    lines = [x for _, h, s, q in rows for x in (h, s, "+", q)]
    return end.join(lines) + (end if last else "")


def want(rows):
    return sorted((n, s, q or "I" * len(s)) for n, _, s, q in rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_border(spark, tmp_path, split, end):
    rng = random.Random(1)
    a, b = records(rng, 9), records(rng, 4)
    (tmp_path / "a.fq").write_text(text(a, end), newline="")
    (tmp_path / "b.fq").write_text(text(b, end, last=False), newline="")
    ids = set()
    for n in (3, 11, 17, 40, 10_000):
        split(n)
        got = read_fastq(spark, [str(tmp_path / x) for x in ("b.fq", "a.fq")], 2).collect()
        assert sorted((r["name"], r["seq"], r["qual"]) for r in got) == sorted(want(a) + want(b))
        ids.add(frozenset(r["id"] for r in got))
    assert len(ids) == 1 and len(next(iter(ids))) == 13


def test_gzip_short_end_and_plan(spark, tmp_path, split):
    rows = records(random.Random(2), 50)
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write(text(rows))
    split(64)
    assert sorted((r["name"], r["seq"], r["qual"]) for r in read_fastq(spark, str(tmp_path / "a.fq.gz")).collect()) == want(rows)
    (tmp_path / "s.fq").write_text("@a\nAC\n+\nII\n@b\nACG\n")
    assert sorted((r["name"], r["seq"], r["qual"]) for r in read_fastq(spark, str(tmp_path / "s.fq")).collect()) == [("a", "AC", "II"), ("b", "ACG", "III")]
    (tmp_path / "e.fq").write_text("")
    assert read_fastq(spark, str(tmp_path / "e.fq")).collect() == []
    plan = read_records(spark, str(tmp_path / "s.fq"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
