"""What queries leave on disk, and what they copy to all tasks."""

from pathlib import Path

import pytest

from hoptrace.plans.queries import QUERIES
from hoptrace.staging import discard, settled, shared_folder, staged

SF = "/root/testdata/sf0.001"


def bytes_below(folder: str, known: set[Path] = frozenset()) -> int:
    return sum(f.stat().st_size for f in set(Path(folder.removeprefix("file:")).rglob("*.parquet")) - known)


@pytest.mark.parametrize("name", ["find_insertions", "filter_reference_overlaps", "evaluate_calls", "gff_roundtrip", "genotype", "false_junction"])
def test_tables_on_the_way_are_deleted(spark, name):
    folder = shared_folder(spark)
    before = set(Path(folder.removeprefix("file:")).rglob("*.parquet"))
    got = QUERIES[name](spark, SF)
    reads = Path(f"{SF}/lineitem.parquet").stat().st_size
    assert got.count() > 0 and bytes_below(folder, before) < reads // 3  # all reads were left there


@pytest.mark.parametrize("name", ["reference_match", "shared_insertions"])
def test_places_around_elements_are_not_copied(spark, name):
    got = QUERIES[name](spark, SF)
    assert got.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_settled_and_discarded(spark):
    made = []

    def make():
        made.append(staged(spark.range(5), "five"))
        return made[0].filter("id > 2")

    out = settled(spark, make, "two")
    assert out.count() == 2 and not Path(made[0]._staged_at.removeprefix("file:")).exists()
    discard(out)
    assert not Path(out._staged_at.removeprefix("file:")).exists()
