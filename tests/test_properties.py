"""Set-at-a-time operators against one-row-at-a-time loops on random cases."""

import random

from hoptrace.operators import calls, cluster, rangejoin
from hoptrace.params import Params
from hoptrace.streaming import session_clusters

READ = "chrom string, name string, strand string, gstart long, gend long"


def test_clusters_equal_the_loop(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for case in range(40):
        reads = sorted((s, s + rng.randrange(20, 3000)) for s in (rng.randrange(1, 60_000) for _ in range(rng.randrange(1, 40))))
        if case == 0:
            reads = [(1, 100), (1100, 1200), (2201, 2300)]  # a gap of exactly the allowance joins, one more does not
        high, number = None, 0
        for i, (s, e) in enumerate(reads):
            number += high is None or s > high + 1000
            high = max(high or 0, e)
            rows.append((f"c{case}", f"r{i}", "+", s, e))
            expected[f"c{case}", f"r{i}"] = number
    df = spark.createDataFrame(rows, READ)
    for bin_ in (1_000_000, 5_000):
        got = {(r["chrom"], r["name"]): r["cluster_id"] for r in cluster.clusters(df, Params(cluster_bin=bin_)).collect()}
        assert got == expected
    assert session_clusters(df).count() == len(set((c, n) for (c, _), n in expected.items()))


def paired(lefts, rights):
    out, rest = [], sorted(rights)
    for a in sorted(lefts):
        best = min(rest, key=lambda r: (abs(r - a), r), default=None)
        if best is not None and abs(best - a) <= 100:
            rest.remove(best)
            out.append((a, best))
        else:
            out.append((a, None))
    return {*out, *((None, r) for r in rest)}


def test_pairs_equal_the_loop(spark):
    rng, rows, expected = random.Random(6), [], {}
    cases = [([100], [98]), ([100], [500]), ([100, 5000], [98, 4998]), ([100], [90, 110])]
    cases += [(rng.sample(range(400), rng.randrange(6)), rng.sample(range(400), rng.randrange(1, 6))) for _ in range(60)]
    cases += [(rng.sample(range(4000), 300), rng.sample(range(4000), 300)), (rng.sample(range(2_000_000), 400), rng.sample(range(2_000_000), 400)), ([0, 100], [100, 200, 201])]
    for k, (a, b) in enumerate(cases):
        rows += [("c", k, s, x) for s, xs in (("left", a), ("right", b)) for x in xs]
        expected[k] = paired(a, b)
    got = {}
    for r in calls.pair_breakpoints(spark.createDataFrame(rows, "chrom string, cluster_id long, side string, position long")).collect():
        got.setdefault(r["cluster_id"], set()).add((r["left_pos"], r["right_pos"]))
    assert got == {k: v for k, v in expected.items() if v}


def test_overlap_joins(spark):
    rng = random.Random(7)
    make = lambda n: [("c", s, s + rng.randrange(900)) for s in (rng.randrange(30_000) for _ in range(n))]
    a, b = make(60), make(40)
    left, right = (spark.createDataFrame(x, "chrom string, start long, end long") for x in (a, b))
    hit = sorted(x for x in a if any(x[1] - 7 <= y[2] and x[2] + 7 >= y[1] for y in b))
    assert sorted(map(tuple, rangejoin.overlapping(left, right, ["chrom"], 7, 500, "left_semi").collect())) == hit
    assert rangejoin.overlapping(left, right, ["chrom"], 7, 500, "left_anti").count() == len(a) - len(hit)


def test_session_clusters_of_a_stream(spark, tmp_path):
    """Reads that come in files, in order of place, give the clusters of the whole table; the last ones close with the watermark."""
    rng = random.Random(11)
    rows = sorted((c, "+-"[rng.randrange(2)], s, s + rng.randrange(30, 200)) for c in ("c", "d") for s in (rng.randrange(200_000) for _ in range(150)))
    rows.sort(key=lambda r: r[2])
    schema = "chrom string, strand string, gstart long, gend long"
    whole = spark.createDataFrame(rows, schema)
    for k in range(0, len(rows), 60):
        spark.createDataFrame(rows[k : k + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("end", "+", 10_000_000, 10_000_100)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = session_clusters(stream, lateness=250_000).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    got = sorted(map(tuple, spark.table("sessions").collect()))
    assert got == sorted(map(tuple, session_clusters(whole).collect())) and len(got) > 20
