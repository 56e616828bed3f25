"""Scalar rules on literal cases."""

import pytest
from pyspark.sql import functions as F

from hoptrace import functions as H
from hoptrace.operators import calls, cluster, genotype, mates, reference, trim
from hoptrace.params import DEFAULT


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_reverse_complement(spark):
    assert one(spark, H.reverse_complement(F.lit("ACGTN"))) == "NACGT"
    assert one(spark, H.reverse_complement(F.lit("acgtRYn"))) == "nYRacgt"


@pytest.mark.parametrize(
    ("case", "expected"),
    [
        (dict(qstart=36, qend=99, tstart=0, tend=63, seq="G" * 36 + "C" * 64), ("r1:end:5", "G" * 36, "5")),
        (dict(qstart=0, qend=63, tstart=366, tend=429, seq="C" * 64 + "G" * 36), ("r1:start:3", "G" * 36, "3")),
        (dict(qstart=0, qend=99, tstart=100, tend=199), ("r1:middle", "A" * 100, "middle")),
        (dict(qstart=3, qend=99, tstart=0, tend=96), None),
        (dict(qstart=36, qend=99, tstart=0, tend=63, mismatch=5), None),
        (dict(qstart=9, qend=99, tstart=0, tend=90), None),
        (dict(qstart=10, qend=99, tstart=0, tend=89), ("r1:end:5", "A" * 10, "5")),
        (dict(qstart=0, qend=96, tstart=100, tend=196), ("r1:middle", "A" * 100, "middle")),
        (dict(qstart=0, qend=95, tstart=100, tend=195), None),
        (dict(qstart=36, qend=99, tstart=0, tend=63, strand="-"), None),
        (dict(qstart=0, qend=63, tstart=0, tend=63, strand="-", seq="C" * 64 + "G" * 36), ("r1:start:5", "G" * 36, "5")),
        (dict(qstart=36, qend=99, tstart=366, tend=429, strand="-", seq="G" * 36 + "C" * 64), ("r1:end:3", "G" * 36, "3")),
        (dict(qstart=36, qend=99, tstart=0, tend=63, seq=""), None),
    ],
)
def test_trim(spark, case, expected):
    v = dict(read_name="r1", seq="A" * 100, qual="I" * 100, qlen=100, te_len=430, mismatch=0, strand="+") | case
    v["match"] = v["qend"] - v["qstart"] + 1 - v["mismatch"]
    got = one(spark, H.trim_read(), **v)
    assert (got and (got["name"], got["seq"], got["junction_type"])) == expected


def test_junctions(spark):
    info = lambda tag, strand: (lambda r: r and tuple(r))(one(spark, H.junction_info(F.lit("r/1" + tag), F.lit(strand), F.lit(100), F.lit(200))))
    assert info(":start:5", "+") == ("right", 100, "5") and info(":end:5", "+") == ("left", 200, "5")
    assert info(":start:3", "-") == ("left", 200, "3") and info(":end:3", "-") == ("right", 100, "3")
    assert info(":middle", "+") is None and info("", "+") is None
    ways = [one(spark, H.te_orientation(F.lit(s), F.lit(e))) for s, e in (("left", "5"), ("right", "3"), ("right", "5"), ("left", "3"))]
    assert ways == ["+", "+", "-", "-"]


def test_names(spark):
    assert [one(spark, H.strip_tag(F.lit(n))) for n in ("a/1:end:5", "a/2:start:3", "a/1:middle", "M00:1:2:3/1")] == ["a/1", "a/2", "a/1", "M00:1:2:3/1"]
    assert [tuple(one(spark, H.split_mate(F.lit(n)))) for n in ("r_1/1", "r_1/2", "nomate")] == [("r_1", "1"), ("r_1", "2"), ("nomate", "")]


def test_tags(spark):
    assert one(spark, H.parse_tags(F.lit("NM:i:3\tMD:Z:5A\tNM:i:4"))) == {"NM": "4", "MD": "5A"}


def test_borders(spark):
    score = lambda *v: one(spark, H.boundary_score(*map(F.lit, v)))
    assert score(0, 99, 100, 0, 99, 100) == 4 and score(3, 95, 100, 3, 90, 100) == 0 and score(2, 97, 100, 5, 97, 100) == 3


def test_status(spark):
    status = lambda f, s: one(spark, H.classify_status(F.lit(float(f)), F.lit(s)))
    assert status(5, 0) == "homozygous" and status(10, 10) == "heterozygous" and status(1, 50) == "somatic_insertion"
    assert "homozygous" in status(20, 1) and status(12, 30) == "heterozygous"


def test_tsd(spark):
    rule = lambda a, b: tuple(one(spark, H.tsd_interval(F.lit(a).cast("long"), F.lit(b).cast("long"))))
    assert rule(1002, 1000) == (1000, 1002, True) and rule(1019, 1000) == (1000, 1019, True) and rule(1020, 1000) == (1000, 1000, False)
    assert rule(999, 1000) == (999, 999, False) and rule(None, 7) == (7, 7, False) and rule(7, None) == (7, 7, False)
    assert one(spark, H.tsd_text(F.lit("acgtac"), F.lit(2), F.lit(4))) == "CGT" and one(spark, H.tsd_text(F.lit("acg"), F.lit(9), F.lit(11))) == "..."


JUNCTION = "chrom string, cluster_id long, side string, position long, name string, te_name string, te_end string"


def test_calls(spark):
    rows = spark.createDataFrame([("c", 1, "left", 1002, "a", "T", "5"), ("c", 1, "right", 1000, "b", "T", "3"), ("c", 1, "left", 5002, "d", "T", "5"), ("c", 1, "right", 5000, "e", "T", "3")], JUNCTION)
    got = calls.call_insertions(rows).orderBy("start").collect()
    assert [(r["start"], r["end"], r["left_junction"], r["right_junction"], len(r["tsd"])) for r in got] == [(1000, 1002, 1, 1, 3), (5000, 5002, 1, 1, 3)]


def test_family_vote(spark):
    rows = spark.createDataFrame([("c", 1, "left", 5, str(i), t, "5") for i, t in enumerate(["B", "A", "NA", "NA", "NA"])] + [("c", 2, "left", 5, "x", "NA", "5")], JUNCTION)
    got = {r["cluster_id"]: r["te_name"] for r in rows.groupBy("cluster_id").agg(calls.family_mode(F.col("te_name")).alias("te_name")).collect()}
    assert got == {1: "A", 2: "NA"}


READ = "chrom string, name string, strand string, gstart long, gend long"


def test_support_only(spark):
    def sites(plus, minus):
        rows = [("c", f"p{i}", "+", e - 50, e) for i, e in enumerate(plus)] + [("c", f"m{i}", "-", s, s + 50) for i, s in enumerate(minus)]
        return [(r["start"], r["end"], r["left_support"], r["right_support"]) for r in calls.support_only_calls(cluster.clusters(spark.createDataFrame(rows, READ))).collect()]

    assert sites([900, 920], [1100, 1120]) == [(920, 1100, 2, 2)]
    assert sites([1150, 1160], [1100, 1120]) == [] and sites([900, 920], []) == []


def test_fallback_after_filter(spark):
    """A cluster that loses its junction call to a filter may give one from support."""
    rows = [("c", "j/1:end:5", "+", 900, 1002), ("c", "k/1:start:3", "+", 1000, 1100), ("c", "p1", "+", 850, 950), ("c", "p2", "+", 850, 951), ("c", "m1", "-", 1050, 1150), ("c", "m2", "-", 1060, 1160)]
    full = spark.createDataFrame([("j/1", "c", 900, 1100), ("k/1", "c", 900, 1100)], "read_name string, chrom string, gstart long, gend long")
    reads = spark.createDataFrame(rows, READ)
    repeat = spark.createDataFrame([("j/1:end:5", "T", "+"), ("k/1:start:3", "T", "+")], "name string, te_name string, strand string")
    kept = calls.find_insertions(reads, repeat).collect()
    assert [(r["start"], r["end"], r["te_name"], r["left_support"], r["right_support"]) for r in kept] == [(1000, 1002, "T", 2, 2)]
    lost = calls.find_insertions(reads, repeat, full).collect()
    assert [(r["start"], r["end"], r["tsd"]) for r in lost] == [(951, 1050, "supporting_reads")]


def test_false_fraction(spark):
    """Exactly three tenths of the reads on both sides are enough."""
    made = spark.createDataFrame([("c", 1, 100, 102, "T", "+", 102, 100)], "chrom string, cluster_id long, start long, end long, te_name string, strand string, left_pos long, right_pos long")
    names = [("left", 102, "l{}:end:5"), ("right", 100, "r{}:start:3")]
    reads = spark.createDataFrame([("c", 1, side, at, name.format(i)) for side, at, name in names for i in range(10)], "chrom string, cluster_id long, side string, position long, name string")
    full = lambda n: spark.createDataFrame([(f"{s}{i}", "c", 90, 112) for s in "lr" for i in range(n)], "read_name string, chrom string, gstart long, gend long")
    assert calls.false_junctions(made, reads, full(3)).count() == 1 and calls.false_junctions(made, reads, full(2)).count() == 0
    assert calls.false_junctions(made, reads, full(3).filter("read_name like 'l%'")).count() == 0


def test_mates(spark):
    repeat = spark.createDataFrame([("p1/1:end:5", "T", "+"), ("p2/1:end:5", "T", "+"), ("p2/2:middle", "T", "+"), ("odd:end:5", "T", "+")], "name string, te_name string, strand string")
    reads = spark.createDataFrame([(f"p{i}/{m}",) for i in (1, 2, 3) for m in (1, 2)], "name string")
    assert [r["name"] for r in mates.support_mates(repeat, reads).collect()] == ["p1/2"]
    assert sorted(r["name"] for r in mates.junction_fullreads(repeat, reads).collect()) == ["p1/1", "p2/1"]
    assert mates.junction_fullreads(repeat, reads.unionByName(spark.createDataFrame([("odd",)], "name string"))).filter("name = 'odd'").count() == 0
    named = mates.te_family(spark.createDataFrame([("p1/1:end:5",), ("x:end:5",)], "name string"), repeat)
    assert {r["name"]: r["te_name"] for r in named.collect()} == {"p1/1:end:5": "T", "x:end:5": "NA"}


def test_spanners_and_genotype(spark):
    read = lambda s, n, cigar, nm: ("c", "r", "+", s + 1, s + n, cigar, nm)
    reads = spark.createDataFrame([read(900, 200, "200M", 0), read(900, 200, "200M", 2), read(900, 150, "150M50S", 0), read(998, 200, "200M", 0)], READ + ", cigar string, nm int")
    sites = spark.createDataFrame([("c", 1000), ("nowhere", 1000)], "chrom string, pos long")
    assert {r["chrom"]: r["spanners"] for r in genotype.count_spanners(sites, reads).collect()} == {"c": 1, "nowhere": 0}
    call = spark.createDataFrame([("c", 2000, 2002, 3, 3), ("c", 3000, 3000, 3, 0)], "chrom string, start long, end long, left_junction long, right_junction long")
    assert [(r["status"], r["spanners"]) for r in genotype.genotype(call, reads).collect()] == [("homozygous", 0)]


def test_reference(spark):
    te = spark.createDataFrame([("c", 1000, 1500, "T", "+", True, 2), ("c", 1000, 1500, "U", "-", False, 1)], "chrom string, te_start long, te_end long, te_name string, strand string, intact boolean, ord long")
    reads = spark.createDataFrame([("c", "a/1:end:5", "+", 901, 1000), ("c", "b/1:start:5", "+", 1501, 1600)], READ)
    rows = cluster.junctions(cluster.clusters(reads)).withColumn("te_name", F.lit("T"))
    got = reference.shared_insertions(reference.match_reference(rows, te)).collect()
    assert [(r["start"], r["end"], r["te_name"], r["left_junction"], r["right_junction"]) for r in got] == [(1000, 1500, "T", 1, 1)] and got[0]["note"].startswith("Shared")
    calls_ = spark.createDataFrame([("c", 1100, 1102, "T"), ("c", 1100, 1102, "Other"), ("c", 9000, 9002, "T"), ("c", 1505, 1506, "U"), ("c", 1506, 1507, "U")], "chrom string, start long, end long, te_name string")
    assert sorted((r["start"], r["te_name"]) for r in reference.filter_reference_overlaps(calls_, te).collect()) == [(1100, "Other"), (1506, "U"), (9000, "T")]


def test_sequence_less_record(spark):
    """A record without sequence takes the length seen last and reaches the read's end; if it wins, its read is lost."""
    rows = [(0, "a", 0, "T", 430, 0, "36S64M", "A" * 100, "I" * 100, 0, 0), (1, "b", 0, "T", 430, 0, "64M", "*", "*", 0, 0)]
    recs = spark.createDataFrame(rows, "ordinal long, name string, flag int, ref_name string, ref_length int, ref_start int, cigar string, seq string, qual string, nm int, ref_index int").withColumn("bag", F.lit(1))
    got = {r["read_name"]: r for r in trim.element_alignments(recs, ["bag"]).collect()}
    assert (got["a"]["qstart"], got["a"]["qend"], got["a"]["tend"], got["a"]["match"]) == (36, 99, 63, 64)
    assert got["b"]["qlen"] == 100 and got["b"]["qend"] == 163 and got["b"]["seq"] == ""
    assert [r["name"] for r in trim.trimmed_reads(trim.element_alignments(recs, ["bag"])).collect()] == ["a:end:5"]
    assert DEFAULT.range_allowance == 1000
