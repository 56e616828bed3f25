"""Greedy pairing over bins against a plain loop, in one island of a million bases and in many small ones."""

import random
from collections import Counter
from dataclasses import replace

import pytest

from hoptrace.operators import calls, islands
from hoptrace.params import DEFAULT


def by_loop(lefts, rights, window):
    """Each left, ascending, takes the nearest open right within the window, the smaller of two."""
    free, out = sorted(rights), []
    for left in sorted(lefts):
        near = [r for r in free if abs(r - left) <= window]
        took = min(near, key=lambda r: (abs(r - left), r), default=None)
        if took is not None:
            free.remove(took)
        out.append((left, took))
    return Counter(out + [(None, r) for r in free])


def rows(spark, lefts, rights, chrom="c"):
    found = [(chrom, 1, "left", x) for x in lefts] + [(chrom, 1, "right", x) for x in rights]
    return spark.createDataFrame(found, "chrom string, cluster_id long, side string, position long").repartition(5)


def got(df):
    return Counter((r["left_pos"], r["right_pos"]) for r in df.collect())


@pytest.mark.parametrize("long_island, island_bin", [(2000, 50_000), (3, 70), (3, 500)])
def test_bins_equal_the_loop(spark, long_island, island_bin):
    rng = random.Random(1)
    lefts = {x for x in (rng.randrange(30_000) for _ in range(700))}
    rights = {x for x in (rng.randrange(30_000) for _ in range(700))} | {x + 5 for x in list(lefts)[:200]}
    p = replace(DEFAULT, long_island=long_island, island_bin=island_bin)
    assert got(calls.pair_breakpoints(rows(spark, lefts, rights), p)) == by_loop(lefts, rights, p.pair_window)


def test_one_island_of_a_million_bases(spark):
    """Nowhere a gap of a window, so that every bin depends on the one before."""
    rng, lefts, rights, at = random.Random(2), [], [], 0
    while at < 1_000_000:
        at += rng.randrange(1, 60)
        (lefts if rng.random() < 0.5 else rights).append(at)
    quick, free = islands.paired(sorted([(x, 1, x) for x in lefts] + [(x - 100, 0, x) for x in rights]), [], 100)
    want = Counter(quick + [(None, r) for r in free])
    assert got(calls.pair_breakpoints(rows(spark, lefts, rights))) == want


def test_chain_that_never_settles(spark):
    """Every choice hangs on the one before: all bins are paired again, one after the other."""
    lefts, rights = list(range(0, 4000, 40)), list(range(-19, 4000, 40))
    p = replace(DEFAULT, long_island=3, island_bin=400)
    assert got(calls.pair_breakpoints(rows(spark, lefts, rights[1:]), p)) == by_loop(lefts, rights[1:], p.pair_window)


def test_stretch_equals_the_loop():
    rng = random.Random(4)
    for _ in range(200):
        lefts, rights = ({rng.randrange(400) for _ in range(rng.randrange(30))} for _ in range(2))
        out, free = islands.paired(sorted([(x, 1, x) for x in lefts] + [(x - 20, 0, x) for x in rights]), [], 20)
        assert Counter(out + [(None, r) for r in free]) == by_loop(lefts, rights, 20)
