"""The BAM sink against our own reader, failing tasks, and BAM that is not on a local path."""

import random
from pathlib import Path

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from hoptrace.sinks import bam as sink
from hoptrace.sources import files
from hoptrace.sources.bam import BamReader, read_bam

ROWS = "ordinal long, name string, flag int, ref_index int, ref_name string, ref_length int, ref_start int, cigar string, ref_end int, seq string, qual string, nm int"
REFS = [("c1", 90_000_000), ("é2", 5000), ("empty", 7)]


def made(n):
    rng, out = random.Random(3), []
    for i in range(n):
        size, ref = rng.randrange(1, 150), rng.choice([0, 0, 1, None])
        seq = "".join(rng.choices("ACGTN", k=size))
        qual = "".join(chr(rng.randrange(33, 74)) for _ in seq) if rng.random() < 0.8 else None
        start = None if ref is None else rng.randrange(0, REFS[ref][1] - 200)
        place = (ref, *REFS[ref], start, f"{size}M2D", start + size + 2) if ref is not None else (None,) * 6
        out.append((i, f"read{i}", 4 if ref is None else 16 * (i % 2), *place, seq, qual, rng.choice([None, 0, 3])))
    return out


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(REFS)], "ref_index int, ref_name string, ref_length int")


def test_round_trip(spark, contigs, tmp_path):
    rows, path = made(2500), str(tmp_path / "out.bam")
    for coalesced in ("true", "false"):  # written again: the first parts are replaced
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
        sink.write_bam(spark.createDataFrame(rows, ROWS).repartition(5), contigs, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = sorted(p.name for p in Path(path).iterdir())
    assert len(names) > 1 and all(n.startswith("part-") for n in names)
    got = read_bam(spark, path, 20_000)
    assert sorted(map(tuple, got.drop("ordinal").collect()), key=repr) == sorted((tuple(r[1:]) for r in rows), key=repr)
    inside = [[(r["ref_index"], r["ref_start"]) for r in read_bam(spark, f"{path}/{n}").orderBy("ordinal").collect()] for n in names]
    flat = [x for part in inside for x in part]
    assert flat == sorted(flat, key=lambda x: (x[0] is None, x))


def test_empty(spark, contigs, tmp_path):
    sink.write_bam(spark.createDataFrame([], ROWS), contigs, str(tmp_path / "none.bam"))
    assert read_bam(spark, str(tmp_path / "none.bam")).count() == 0


def test_failed_task_leaves_nothing(spark, contigs, tmp_path):
    rows = spark.createDataFrame(made(400), ROWS).withColumn("name", F.when(F.col("ordinal") == 399, F.repeat(F.lit("x"), 400)).otherwise(F.col("name")))
    with pytest.raises(Exception, match="255"):
        sink.write_bam(rows, contigs, str(tmp_path / "bad.bam"))
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_bins():
    assert [sink.interval_bin(*x) for x in ((0, 1), (16_383, 16_385), (1 << 14, 1 << 15), (0, 1 << 17), (0, 1 << 29))] == [4681, 585, 4682, 585, 0]


def test_other_file_system(spark, contigs, tmp_path, monkeypatch):
    """Ranges of bytes come through the file system that a URI names."""
    rows, path = made(300), tmp_path / "out.bam"
    sink.write_bam(spark.createDataFrame(rows, ROWS).coalesce(1), contigs, str(path))
    other = fs._MockFileSystem()
    other.create_dir("store")
    for p in path.iterdir():
        with other.open_output_stream(f"store/{p.name}") as out:
            out.write(p.read_bytes())
    asked = []
    monkeypatch.setattr(files, "located", lambda uri: asked.append(uri) or (other, uri.removeprefix("mock://")))
    reader = BamReader({"path": "mock://store", "splitbytes": "3000"})
    splits = reader.partitions()
    got = [r[1:] for s in splits for r in reader.read(s)]
    assert len(splits) > 2 and asked and sorted(got, key=repr) == sorted((tuple(r[1:]) for r in rows), key=repr)
    monkeypatch.undo()
    assert sorted(map(tuple, read_bam(spark, path.as_uri()).drop("ordinal").collect()), key=repr) == sorted(got, key=repr)
