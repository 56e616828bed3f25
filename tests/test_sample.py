"""End to end on a simulated genome."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from hoptrace.counters import RUNS, counted, counting
from hoptrace.operators.genotype import evaluate
from hoptrace.params import Params
from hoptrace.plans.sample import run_sample, run_samples
from hoptrace.sources.library import ReadLibrary
from hoptrace.sources.text import read_insertions

from simulate import simulate


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    folder = tmp_path_factory.mktemp("world")
    return folder, simulate(folder)


def test_recall_and_precision(spark, world):
    folder, truth = world
    reads = ReadLibrary((str(folder / "r1.fq"), str(folder / "r2.fq")), "s1")
    gff = run_sample(spark, reads, str(folder / "te.fa"), str(folder / "genome.fa"), str(folder / "out"), with_genotype=True)
    found = read_insertions(spark, gff)
    seen = RUNS["s1"]
    assert seen["insertions"]["calls"] == found.count() == sum(seen["insertions"][k] for k in ("by_junctions", "by_support_only")) and seen["trimmed"]["reads"] > 0
    assert seen["junction-calls"]["calls"] - seen["true-calls"]["calls"] == seen["false-junctions"]["calls"] >= 0
    known = spark.createDataFrame([(c, s, e) for c, s, e, _ in truth], "chrom string, start long, end long")
    r = evaluate(found, known).first()
    assert r["recovered"] >= 0.85 * len(truth) and r["true_calls"] >= 0.85 * r["n_calls"], r
    named = {(x["start"], x["te_name"]) for x in found.collect()}
    assert sum(any(n == name and abs(a - s) <= 10 for a, n in named) for _, s, _, name in truth) >= 0.7 * len(truth)
    rows = spark.read.text(gff.replace(".gff", ".characTErized.txt")).collect()
    assert rows[0][0].startswith("strain\tTE\tTSD") and len(rows) > 1 and all("homozygous" in x[0] for x in rows[1:])


def test_many_sites_with_errors_and_repeats(spark, tmp_path):
    """200 sites at depth 12, with reading errors, an indel between any two sites and 25 copies that the genome has too."""
    truth = simulate(tmp_path, sites=200, genome_size=600_000, depth=12, errors=0.004, indels=200, resident=25)
    reads = ReadLibrary((str(tmp_path / "r1.fq"), str(tmp_path / "r2.fq")), "s1")
    gff = run_sample(spark, reads, str(tmp_path / "te.fa"), str(tmp_path / "genome.fa"), str(tmp_path / "out"), str(tmp_path / "genome.out"), p=Params(mismatch_allowance=2))
    r = evaluate(read_insertions(spark, gff), spark.createDataFrame([(c, s, e) for c, s, e, _ in truth], "chrom string, start long, end long")).first()
    assert r["recovered"] >= 0.85 * len(truth) and r["true_calls"] >= 0.85 * r["n_calls"], r
    assert RUNS["s1"]["matched"]["reads"] >= RUNS["s1"]["shared"]["calls"] > 0


def test_runs_at_once_count_apart(spark):
    def run(name):
        with counting(name) as own:
            for n in (3, 5):
                counted(spark.range(n * len(name)), f"step{n}", rows=F.count("*"), top=F.max("id"))
            return own

    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(run, ["a", "bb"]))
    assert got == [RUNS[x] for x in ("a", "bb")] == [{f"step{n}": {"rows": n * k, "top": n * k - 1} for n in (3, 5)} for k in (1, 2)]
    counted(spark.range(2), "outside", rows=F.count("*"))
    assert all("outside" not in x for x in RUNS.values())


def test_failing_sample_gives_none(spark, world):
    folder, _ = world
    bad = ReadLibrary((str(folder / "missing.fq"),), "bad")
    assert run_samples(spark, [bad], str(folder / "te.fa"), str(folder / "genome.fa"), str(folder / "many")) == [None]
    with pytest.raises(ValueError):
        run_samples(spark, [bad, bad], "", "", "")
    with pytest.raises(ValueError):
        ReadLibrary((), "none")
