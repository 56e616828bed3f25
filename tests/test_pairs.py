"""Paired mapping: repeats, weak mates, flags, and what happens without a model."""

import random

import pytest

from hoptrace.operators import align, pairs
from hoptrace.sources.fasta import reference_of
from simulate import revcomp

READS = "id long, name string, seq string, qual string, mate int"
LIBRARY = "ref_index int, ref_name string, ref_length int, seq string"


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    unit = dna(150)
    genome = "".join(dna(700) + unit for _ in range(30)) + dna(700)  # 30 equal copies
    frame = spark.createDataFrame([(0, "c0", len(genome), genome), (1, "c1", 5000, other := dna(5000))], LIBRARY)
    return rng, genome, other, reference_of(frame, 4096)


def fragment(genome, at, size, n=100):
    return genome[at : at + n], revcomp(genome[at + size - n : at + size])


def rows(spark, fragments):
    out = [(2 * i + m, f"f{i}/{m + 1}", s, "I" * len(s), m + 1) for i, f in enumerate(fragments) for m, s in enumerate(f) if s]
    return spark.createDataFrame(out, READS)


def test_pairs(spark, world):
    rng, genome, other, ref = world
    sure = [(a := rng.randrange(20_000), rng.randrange(370, 430)) for _ in range(60)]
    fragments = [fragment(genome, a, s) for a, s in sure]
    # read 1 all inside the 17th copy, its mate outside: 30 places alone, one beside its mate
    at = 850 * 16 + 700 + 20
    fragments.append(fragment(genome, at, 400))
    # a mate with a mismatch every ten bases has no seed at all
    weak = list(fragment(genome, 3000, 400)[1])
    for i in range(4, 100, 10):
        weak[i] = "ACGT"[("ACGT".index(weak[i]) + 1) % 4]
    fragments.append((genome[3000:3100], "".join(weak)))
    fragments.append((genome[5000:5100], revcomp(other[1000:1100])))  # mates on two sequences
    fragments.append((genome[6000:6100], "".join(rng.choices("ACGT", k=100))))  # a mate from elsewhere
    fragments.append((revcomp(genome[9000:9100]), genome[8700:8800]))  # the first read is the reverse one
    reads = rows(spark, fragments)
    got = {r["name"]: r for r in pairs.align_pairs(reads, ref).collect()}
    for i, (a, s) in enumerate(sure):
        one, two = got[f"f{i}/1"], got[f"f{i}/2"]
        assert (one["ref_start"], two["ref_end"], one["flag"], two["flag"]) == (a, a + s, 1 | 2 | 32 | 64, 1 | 2 | 16 | 128)
    assert got["f60/1"]["ref_start"] == at and got["f60/1"]["nm"] == 0 and got["f60/1"]["flag"] & 2
    assert got["f61/2"]["ref_end"] > 3380 and got["f61/2"]["flag"] == 1 | 2 | 16 | 128 and "f61/2" not in {r["name"] for r in align.align(reads, ref, k=15, w=10).collect()}
    assert (got["f62/1"]["flag"], got["f62/2"]["flag"], got["f62/2"]["ref_name"]) == (1 | 32 | 64, 1 | 16 | 128, "c1")
    assert got["f63/1"]["flag"] == 1 | 8 | 64 and "f63/2" not in got
    assert (got["f64/1"]["flag"], got["f64/2"]["flag"], got["f64/2"]["ref_start"]) == (1 | 2 | 16 | 64, 1 | 2 | 32 | 128, 8700)


def test_few_pairs_have_no_model(spark, world):
    _, genome, _, ref = world
    got = {r["name"]: (r["ref_start"], r["flag"]) for r in pairs.align_pairs(rows(spark, [fragment(genome, 100, 400), (genome[900:1000], "")]), ref).collect()}
    assert got == {"f0/1": (100, 1 | 32 | 64), "f0/2": (400, 1 | 16 | 128), "f1/1": (900, 1 | 8 | 64)}
