"""Stored regions: sites get the reads that reach them, and files read fall with the sites."""

import random

import pytest
from pyspark.sql import functions as F

from hoptrace.operators import genotype
from hoptrace.params import Params
from hoptrace.sources import regions
from hoptrace.sources.sam import genome_reads

ROWS = "ordinal long, name string, flag int, ref_index int, ref_name string, ref_start int, ref_end int, cigar string, nm int"
P = Params(region=1000)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(5)
    path, rows = str(tmp_path_factory.mktemp("aln") / "reads.parquet"), []
    for i in range(3000):
        contig, at, n = rng.randrange(3), rng.randrange(20_000), rng.choice([50, 100, 400 if i % 50 == 0 else 90, 2500 if i % 300 == 0 else 90])
        rows.append((i, f"r{i}", 16 * (i % 2), contig, ("1", "01", "chr/x=y")[contig], at, at + n, f"{n}M", i % 3 // 2))
    rows.append((9999, "unmapped", 4, None, None, None, None, None, None))
    frame = spark.createDataFrame(rows, ROWS)
    return regions.write_regions(frame, path, P), frame


def files_read(df):
    """Files that the scan of the alignments opened, from the metrics of the executed plan."""
    seen = {}

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "FileSourceScanExec" and "region" in node.relation().partitionSchema().simpleString():
            seen[node.id()] = node.metrics().get("numFiles").get().value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(seen.values())


def test_spanners(spark, stored):
    path, frame = stored
    rng = random.Random(6)
    sites = spark.createDataFrame([(c, rng.randrange(1, 20_000)) for c in ("1", "01", "chr/x=y", "none") for _ in range(40)] + [("1", 1000), ("1", 1001), ("01", 1)], "chrom string, pos long")
    rows = lambda reads: sorted(map(tuple, genotype.count_spanners(sites, genome_reads(reads), P).collect()))
    assert rows(regions.region_reads(spark, path, sites)) == rows(frame)


def test_files_fall_with_sites(spark, stored):
    path, _ = stored
    took = []
    for n in (1, 10, 60):
        sites = spark.createDataFrame([(c, 300 * i + 500) for i in range(n) for c in ("01",)], "chrom string, pos long")
        df = regions.region_reads(spark, path, sites)
        df.collect()
        assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()
        took.append(files_read(df))
    assert 0 < took[0] < took[1] < took[2] and took[0] * 5 < len(spark.read.parquet(path).inputFiles())


def test_no_alignment(spark, tmp_path):
    empty = spark.createDataFrame([], ROWS)
    path = regions.write_regions(empty, str(tmp_path / "none.parquet"), P)
    sites = spark.createDataFrame([("1", 5)], "chrom string, pos long")
    assert regions.is_regional(spark, path) and genotype.count_spanners(sites, genome_reads(regions.region_reads(spark, path, sites)), P).select("spanners").collect()[0][0] == 0
    assert not regions.is_regional(spark, str(tmp_path / "other.parquet"))
